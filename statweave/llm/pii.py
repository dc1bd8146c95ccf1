"""Information-theoretic sanitisation of personal data.

Patterns find protected entities: e-mail and IP addresses, card and telephone numbers. Words near them may give an entity away although
no pattern knows them, such as a name. How strongly a term reveals an entity is estimated from the whole corpus: the share of the
documents with the term in which it stands near the entity, and the bits by which knowing the term sharpens the guess. Terms beyond
both thresholds are spans too, wherever they occur, however few places they stand in: a term and an entity that had nothing to do with
each other would meet by chance in ``together * 2**-bits`` documents, so that the bits bound how often k meetings are chance, by
``(e / 2**bits) ** k``. Spans are generalised to a tag of their kind. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.llm.frames import stored

KINDS = ["email", "ip", "card", "phone", "term"]
# What counts as a candidate. Possessive repeats and the look-behind only keep the search linear; \G allows a match that
# begins where the last one ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried at all.
_NEEDS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
}
TERM_LETTERS = 3
NEAR = 48
"""Characters on each side of an entity in which terms are counted."""
SHARE, BITS = 0.5, 6.0
"""A term reveals an entity if it stands near it in that share of all documents with the term and sharpens the guess by that many bits."""


def _valid(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "ip", found.rlike(rf"^(?:{part}\.){{3}}{part}$"))
        .when(kind == "card", F.length(digits).between(16, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )


def _hits(text: Column) -> Column:
    """All candidates of all kinds: number, length of the text before it since the last one, the match, its surroundings."""
    none = F.array().cast("array<struct<kind:string,nth:int,gap:int,found:string,before:string,after:string>>")
    return F.concat(*[F.when(text.rlike(_NEEDS[k]), _candidates(text, k, p)).otherwise(none) for k, p in PATTERNS.items()])


def _candidates(text: Column, kind: str, pattern: str) -> Column:
    # Zipped rather than looked up by index: Spark would split the text anew for every match.
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    zipped = F.arrays_zip(found.alias("found"), between.alias("before"), F.slice(between, F.lit(2), F.lit(1 << 30)).alias("after"))
    return F.transform(
        F.filter(zipped, lambda z: z["found"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("int").alias("nth"), F.length(z["before"]).alias("gap"), z["found"].alias("found"),
            F.right(z["before"], F.lit(NEAR)).alias("before"), F.left(z["after"], F.lit(NEAR)).alias("after"),
        ),
    )


def row_key(text: str = "text") -> Column:
    """Rows of the same id and text are alike and share their spans."""
    return F.xxhash64("doc_id", text)


def entities(docs: DataFrame) -> DataFrame:
    """Protected entities: key, kind, start, end (code points, end exclusive), entity, before, after. Equal rows count once."""
    hits = docs.select(row_key().alias("key"), F.explode(_hits(F.col("text"))).alias("h")).select("key", "h.*")
    hits = stored(hits, "pii-hits").dropDuplicates(["key", "kind", "nth"])
    # The start of a match: all gaps up to it and all matches before it.
    start = F.expr("sum(gap + length(found)) over (partition by key, kind order by nth) - length(found)")
    placed = hits.withColumn("start", start).where(_valid(F.col("kind"), F.col("found")))
    entity = F.when(F.col("kind") == "email", F.lower("found")).otherwise(F.regexp_replace("found", r"[\x20().-]", ""))
    return placed.select(
        "key", "kind", "start", (F.col("start") + F.length("found")).alias("end"), F.concat_ws(":", "kind", entity).alias("entity"), "before", "after"
    )


def _terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters; short ones among them are left out by ``long_enough``."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))


def long_enough() -> Column:
    return F.length("term") >= TERM_LETTERS


def revealing_terms(docs: DataFrame, found: DataFrame, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """Terms that give an entity away: term, entity, together (documents), with_term, share, bits. Counts cover all documents."""
    near = found.select("key", "entity", F.concat_ws(" ", "before", "after").alias("near"))
    near = near.select("key", "entity", F.explode(_terms(F.col("near"))).alias("term")).where(long_enough()).distinct()
    together = stored(near.groupBy("term", "entity").agg(F.count("*").alias("together")), "pii-together")
    holding = found.groupBy("entity").agg(F.count_distinct("key").alias("with_entity"))
    counts = docs.select(F.explode(_terms(F.col("text"))).alias("term")).where(long_enough()).groupBy("term").agg(F.count("*").alias("with_term"))
    total = docs.count()
    rated = (
        together.join(counts, "term").join(holding, "entity")
        .withColumn("share", F.least(F.col("together") / F.col("with_term"), F.lit(1.0)))
        .withColumn("bits", F.log2(F.col("share") * float(max(total, 1)) / F.col("with_entity")))
    )
    return rated.where((F.col("share") >= share) & (F.col("bits") >= bits)).select("term", "entity", "together", "with_term", "share", "bits")


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every occurrence of the terms in all documents, as whole words: key, kind, start, end.

    Documents that hold a term are found first; only their texts are taken apart. Spark broadcasts the terms while they are few.
    """
    held = docs.select(row_key().alias("key"), F.explode(_terms(F.col("text"))).alias("term"))
    marked = stored(held.join(terms.select("term").distinct(), "term").groupBy("key").agg(F.collect_set("term").alias("terms")), "pii-marked")
    texts = docs.select(row_key().alias("key"), "text").join(marked, "key").dropDuplicates(["key"])
    gaps = F.transform(F.split("text", r"\p{L}+", -1), lambda x: F.length(x))
    words = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))
    zipped = F.posexplode(F.arrays_zip(words.alias("word"), gaps.alias("gap")))
    taken = texts.select("key", "terms", zipped).select("key", "terms", F.col("pos").alias("nth"), "col.word", "col.gap")
    placed = taken.where("word is not null").withColumn("start", F.expr("sum(gap + length(word)) over (partition by key order by nth) - length(word)"))
    hit = placed.where(F.array_contains("terms", F.lower("word")))
    return hit.select("key", F.lit("term").alias("kind"), "start", (F.col("start") + F.length("word")).alias("end"))


def all_spans(docs: DataFrame, **how) -> DataFrame:
    """Spans of all kinds, each once: key, kind, start, end."""
    found = stored(entities(docs), "pii-entities")
    terms = stored(revealing_terms(docs, found, **how), "pii-terms")
    return stored(found.select("key", "kind", "start", "end").unionByName(term_spans(docs, terms)), "pii-spans")


def listed(spans: str) -> Column:
    """A column of spans as text: kind:start:end, comma-joined."""
    named = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(named, s["rank"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, **how) -> DataFrame:
    """Personal data of every document: doc_id, counts by kind, base (spans of the patterns) and spans (all, terms included), as arrays
    of rank (of the kind), start, end in this order.

    docs: doc_id, text. Null and empty texts have none. Rows of equal id and text share their spans; rows without doc_id are searched
    like any other. An empty table gives an empty result.
    """
    spans = all_spans(docs, **how)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    by_row = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("spans"))
    none = F.array().cast("array<struct<rank:int,start:int,end:int>>")
    rows = docs.select("doc_id", row_key().alias("key")).join(by_row, "key", "left").withColumn("spans", F.coalesce("spans", none))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.filter("spans", lambda s: s["rank"] < 4).alias("base"), "spans"
    )


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """The documents with all columns, every span of their text replaced by a tag of its kind; overlapping spans become one."""
    spans = all_spans(docs, **how)
    order = F.expr("max(end) over (partition by key order by start, end rows between unbounded preceding and 1 preceding)")
    runs = spans.withColumn("reach", order).withColumn("fresh", (F.coalesce("reach", F.lit(-1)) <= F.col("start")).cast("int"))
    runs = runs.withColumn("run", F.expr("sum(fresh) over (partition by key order by start, end rows unbounded preceding)"))
    merged = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end")).alias("kind"))
    listed = merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cut"))
    columns = docs.columns
    whole = docs.select(F.struct("*").alias("row"), F.col("text"), row_key().alias("key")).join(listed, "key", "left")
    piece = lambda s, i: F.concat(
        _between(F.col("text"), F.when(i > 0, F.get(F.col("cut"), i - 1)["end"]).otherwise(F.lit(0)), s["start"]),
        F.lit("["), F.upper(s["kind"]), F.lit("]"),
    )
    last = F.get("cut", F.size("cut") - 1)["end"]
    clean = F.concat(F.array_join(F.transform("cut", piece), ""), _between(F.col("text"), last, F.length("text")))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(clean).alias("text")
    return whole.select(*[text if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start.cast("int") + 1, (end - start).cast("int"))
