"""Licence scans with a positional index of telling words.

Templates are licence notices. Their telling words are posted with their positions. A template is a candidate wherever its mandatory key
phrase stands in a file, which says where the template would begin. There all its posted words vote by relative position, weighted by
their inverse document frequency, and a template that gathers enough of its weight is accepted. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.llm.frames import stored

WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_GAP = r"[^0-9a-z\x{80}-\x{10FFFF}]+"

# Phrases whose places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label, notice, mandatory key phrase.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "dedicated to the public domain under cc0", "cc0"),
    ("proprietary", "copyright all rights reserved", "all rights reserved"),
]
COMMON = set("the of and to in is by for a as any this with or without are under all person terms 0 2 3 4 at on use free copy person subject".split())
"""Words too plain to be posted."""
ENOUGH = 0.6
"""Share of a template's weight that must agree on one place."""


def _postings() -> list[tuple[int, str, str, str, int, int, str, int]]:
    rows = []
    for t, (label, notice, key) in enumerate(TEMPLATES):
        words, phrase = notice.split(), key.split()
        offset = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase) if " ".join(phrase) in notice else 0
        rows += [(t, label, key, w, i, offset) for i, w in enumerate(words) if w not in COMMON]
    return rows


def file_words(text: Column) -> Column:
    """Lower-cased words: letters, digits and everything beyond ASCII."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def _phrase_places(words: Column, phrase: list[str], label: str) -> Column:
    first = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull())
    hits = F.filter(first, lambda i: F.slice(words, i + 1, len(phrase)) == F.array(*map(F.lit, phrase)))
    return F.transform(hits, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("at")))


def _places(words: Column, text: Column, phrases: dict[str, str]) -> Column:
    """Where the words of the phrases stand consecutively: label and word index."""
    pattern = "|".join(_GAP.join(p.split()) for p in phrases)
    found = F.concat(*[_phrase_places(words, phrase.split(), label) for phrase, label in phrases.items()])
    none = F.array().cast("array<struct<label:string,at:bigint>>")
    return F.when(F.lower(text).rlike(pattern), found).otherwise(none)


def _votes(keys: Column, words: Column) -> Column:
    """The posted words that stand where a key phrase says: its place, and the templates and places that agree."""
    fields = ["template", "key", "word", "place", "key_at"]
    posted = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(fields, (t, key, w, i, at))]) for t, _, key, w, i, at in _postings()])
    agrees = lambda k: lambda p: (p["key"] == k["label"]) & (F.get(words, (k["at"] + p["place"] - p["key_at"]).cast("int")) == p["word"])
    named = lambda p: F.struct(p["template"].alias("template"), p["place"].alias("place"))
    return F.transform(keys, lambda k: F.struct(k["at"].alias("stands"), F.transform(F.filter(posted, agrees(k)), named).alias("agreed")))


def scan(docs: DataFrame) -> DataFrame:
    """Licences of every file: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per input row.

    docs: doc_id, text. Null and empty texts have no words, no places (first_word, last_word null), empty labels and score 0. Repeated rows
    and rows without doc_id are scanned like any other. An empty table gives an empty result.
    score: the largest share of a template's weight that agrees, for accepted templates; at least 0.5 where a fixed phrase stands.
    """
    spark = docs.sparkSession
    postings = spark.createDataFrame(_postings(), "template int, label string, key string, word string, place int, key_at int")
    vocabulary = F.array(*[F.lit(w) for w in sorted({p[3] for p in _postings()})])

    worded = docs.select("doc_id", "text", file_words(F.col("text")).alias("words"))
    keys = {key: key for _, _, key in TEMPLATES}
    files = worded.select(
        F.monotonically_increasing_id().alias("file"), "doc_id", F.size("words").cast("long").alias("n_words"),
        _places(F.col("words"), F.col("text"), PHRASES).alias("places"), _places(F.col("words"), F.col("text"), keys).alias("keys"),
        F.array_intersect("words", vocabulary).alias("present"), "words",
    )
    files = stored(files.withColumn("votes", _votes(F.col("keys"), F.col("words"))).drop("words", "keys"), "license-files")  # so that the row numbers stay

    votes = files.select("file", F.explode("votes").alias("v")).select("file", "v.stands", F.explode("v.agreed").alias("a")).select("file", "stands", "a.*")
    total = files.count()
    df = files.select(F.explode("present").alias("word")).groupBy("word").agg(F.log(F.lit(float(total + 1)) / (F.count("*") + 0.5)).alias("idf"))
    weighted = postings.join(df, "word", "left").withColumn("idf", F.greatest(F.coalesce("idf", F.log(F.lit(2.0 * total + 2))), F.lit(0.01)))
    whole = weighted.groupBy("template").agg(F.sum("idf").alias("whole"))

    verified = (
        votes.join(weighted.select("template", "label", "place", "idf"), ["template", "place"])
        .groupBy("file", "template", "label", "stands").agg(F.sum("idf").alias("votes"))
        .join(whole, "template").withColumn("share", F.col("votes") / F.col("whole")).where(f"share >= {ENOUGH}")
    )
    accepted = verified.groupBy("file").agg(F.collect_set("label").alias("added"), F.max("share").alias("share"))

    places = F.col("places")
    base = F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"])))
    both = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("added", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size(places) > 0, F.lit(0.5)).otherwise(0.0))
    return files.drop("votes", "present").join(accepted, "file", "left").select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform(places, lambda p: p["at"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.least(score, F.lit(1.0)).alias("score"),
    )
