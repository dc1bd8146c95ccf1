"""Lazy DataFrame operators over observations."""
