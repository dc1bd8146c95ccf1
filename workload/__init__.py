"""Registered queries over the given tables, each with an equivalent SQL text where SQL can express it."""
