"""Collocations from count streams in prefix and suffix order.

Every phrase of 1 to `longest` words is counted once, over all texts. The counts are then read as a stream sorted by the words from the
last to the first, and again sorted from the first to the last. In such an order a phrase stands right before all that extend it, so one
pass over the sorted rows gives every phrase the counts of its beginnings and the largest count among its extensions: rows of all lengths
advance in lockstep, and nothing is looked up by hash. The suffix order gives the counts of the rests and the extensions to the left, the
prefix order those of the first parts and the extensions to the right.

A stream is dealt to tasks by ranges of its order, wherever the borders fall: a word that begins a third of all phrases spreads over many
tasks. What a task's first rows need from before, and its last phrase from behind, is one summary per task, carried over afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statweave.llm import kernel
from statweave.llm.frames import map_batches, stored, with_bytes

CHUNK_BYTES = 4 << 20
"""Texts of about this size are counted together before their counts are shuffled."""
CELL_BYTES = 8 << 20
"""Text bytes per cell: a cell's phrases are added up at once, in one task's memory."""
MOST_PARTS = 100_000
FOLD_ROWS = 1_000_000
SALTS = 64
UNKNOWN = "und"

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE = ~_BREAK
_INSIDE[[32, 9]] = False


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Languages, bytes and offsets of runs of rows with about CHUNK_BYTES of text."""
    langs, parts, ends, size = [], [], [np.zeros(1, np.int64)], 0
    for batch in batches:
        for rows, buf, offs in kernel.slices(batch):
            langs += rows.column("lang").to_pylist()
            parts.append(buf)
            ends.append(offs[1:] + size)
            size += len(buf)
            if size >= CHUNK_BYTES:
                yield langs, np.concatenate(parts), np.concatenate(ends)
                langs, parts, ends, size = [], [], [np.zeros(1, np.int64)], 0
    if langs:
        yield langs, np.concatenate(parts), np.concatenate(ends)


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in turn, its document, and whether the next one continues its piece."""
    start, end, first = kernel.find_words(buf, offs, _INSIDE)
    lengths = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=lengths[1:])
    flat = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(lengths), pa.py_buffer(buf[_INSIDE[buf]]))
    coded = flat.dictionary_encode()
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    piece = np.searchsorted(np.flatnonzero(_BREAK[buf]), start)
    follows = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), doc, follows


def _phrases(longest: int, cells: int):
    """Counts of the phrases of a task's texts, in one block per chunk, cell and language.

    A block holds its phrases, each ended by a line break (no phrase has one inside), and their counts, both compressed. The empty phrase
    counts the words. A phrase's cell follows from its words alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for langs, buf, offs in _chunks(batches):
            vocabulary, word, doc, follows = _words(kernel.lower_ascii(buf), offs)
            if not len(word):
                continue
            names, lang_of = np.unique(np.array(langs, object).astype(str), return_inverse=True)
            _, ends, data = vocabulary.buffers()
            ends = np.frombuffer(ends, np.int64, len(vocabulary) + 1)
            hashed = kernel.range_hash(kernel.rolling(np.frombuffer(data, np.uint8)), ends[:-1], ends[1:])
            # Words of different languages are different units; a longer phrase is a pair of the phrase before its last unit, and that.
            unit, key = np.unique(lang_of[doc] * len(vocabulary) + word, return_inverse=True)
            text, cell_of = vocabulary.take(pa.array(unit % len(vocabulary))), hashed[unit % len(vocabulary)]
            at, current, spelled, lang, named = np.arange(len(key)), key, text, unit // len(vocabulary), cell_of
            totals = np.bincount(lang_of[doc], minlength=len(names))
            found = [(pa.array([""] * len(names), pa.large_string()), np.arange(len(names)), np.zeros(len(names), np.uint64), totals)]
            for n in range(1, longest + 1):
                if n > 1:
                    fits = at + n - 1 < len(key)
                    at, current = at[fits], current[fits]
                    goes_on = follows[at + n - 2]
                    at, current = at[goes_on], current[goes_on]
                    pairs, current = np.unique(current * len(unit) + key[at + n - 1], return_inverse=True)
                    head, tail = pairs // len(unit), pairs % len(unit)
                    lang, named = lang[head], kernel.mix(named[head] * np.uint64(3) + cell_of[tail])
                    spelled = pc.binary_join_element_wise(spelled.take(pa.array(head)), text.take(pa.array(tail)), pa.scalar(" ", pa.large_string()))
                found.append((spelled, lang, named, np.bincount(current, minlength=len(spelled))))
            phrases, group = pa.concat_arrays([p for p, *_ in found]), np.concatenate([g for _, g, _, _ in found])
            group = (np.concatenate([h for _, _, h, _ in found]) % np.uint64(cells)).astype(np.int64) * len(names) + group
            times = np.concatenate([t for *_, t in found])
            del found, spelled, text, current, at, key  # the phrases are copied in order below
            order = np.argsort(group, kind="stable")
            group, times, phrases = group[order], times[order].astype("<i4"), phrases.take(pa.array(order))
            lines = pc.binary_join_element_wise(phrases, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
            _, ends, data = lines.buffers()
            ends, data = np.frombuffer(ends, np.int64, len(lines) + 1, lines.offset * 8), memoryview(data)
            begin = np.flatnonzero(np.diff(group, prepend=-1))
            stop = np.append(begin[1:], len(group))
            yield pa.record_batch(
                [
                    pa.array(group[begin] // len(names), pa.int64()), pa.array(names[group[begin] % len(names)].tolist(), pa.string()),
                    pa.array([packer.compress(data[ends[a] : ends[b]]) for a, b in zip(begin, stop)], pa.binary()),
                    pa.array([packer.compress(times[a:b].tobytes()) for a, b in zip(begin, stop)], pa.binary()),
                ],
                names=["cell", "lang", "phrases", "times"],
            )
            del phrases, lines, data, ends, group, times, order
            pa.default_memory_pool().release_unused()

    return run


def _opened(phrases: bytes, times: bytes) -> pa.Table:
    """The phrases of a block, with their line breaks, and their counts."""
    unpacker = zstandard.ZstdDecompressor()
    data = unpacker.decompress(phrases)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    lines = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data))
    return pa.table({"phrase": lines, "f": np.frombuffer(unpacker.decompress(times), "<i4").astype(np.int64)})


def _added(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables)
    coded = whole["phrase"].combine_chunks().dictionary_encode()
    # Exact: sums of counts in doubles, far below 2**53.
    total = np.bincount(coded.indices.to_numpy(), weights=whole["f"].to_numpy(), minlength=len(coded.dictionary))
    return pa.table({"phrase": coded.dictionary, "f": total.astype(np.int64)})


def _frequent(least: int):
    """Adds up the blocks of one cell and language after another (rows come sorted by these); keeps frequent phrases and word totals."""

    def closed(lang: str, held: list[pa.Table]) -> pa.RecordBatch:
        whole = _added(held)
        whole = whole.filter(pc.or_(pc.greater_equal(whole["f"], least), pc.equal(whole["phrase"], "\n")))
        phrase = pc.utf8_rtrim(whole["phrase"], "\n").combine_chunks().cast(pa.string())
        return pa.record_batch([pa.array([lang] * len(whole), pa.string()), phrase, whole["f"].combine_chunks()], names=["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size = None, [], 0
        for batch in batches:
            for cell, lang, phrases, times in zip(*(batch.column(c) for c in ("cell", "lang", "phrases", "times"))):
                key = (cell.as_py(), lang.as_py())
                if key != current:
                    if held:
                        yield closed(current[1], held)
                    current, held, size = key, [], 0
                held.append(_opened(phrases.as_py(), times.as_py()))
                size += len(held[-1])
                if size >= FOLD_ROWS:
                    held = [_added(held)]
                    size = 0
        if held:
            yield closed(current[1], held)

    return run


def phrase_counts(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `longest` words that occur `least` times or more (lang, words, f), and all words by language (lang, n)."""
    texts = with_bytes(docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text"), "lang")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(16, -(-size // CELL_BYTES))
    parts = min(cells, MOST_PARTS)
    blocks = map_batches(texts, _phrases(longest, cells), "cell long, lang string, phrases binary, times binary")
    dealt = blocks.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "lang")
    counted = stored(map_batches(dealt, _frequent(least), "lang string, phrase string, f long", 64), "phrase-counts")
    # A language's total stands in one cell, as the count of the empty phrase.
    stream = counted.where("phrase <> ''").select("lang", F.split("phrase", " ").alias("words"), "f")
    return stream, stored(counted.where("phrase = ''").select("lang", F.col("f").alias("n")), "phrase-totals")


# --- one pass over a sorted stream --------------------------------------------------------------------------------------------


def _lockstep(longest: int):
    """Rows of one range in order, with the counts of their beginnings (heads) and the largest count of an extension by one word.

    A row whose beginning stands in an earlier range has null there. The last row of each length below `longest` is marked as open, since
    the next range may extend it. A row without words sums the range up: its last counts by length, the largest count that extends an
    open row of earlier ranges by length, and the shortest phrase of the range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: list[int | None] = [None] * (longest + 1)  # count of the phrase of each length that is being extended
        held: dict[int, pa.RecordBatch] = {}  # and its row, until its last extension has passed
        grown = [0] * (longest + 1)
        before = [0] * (longest + 1)
        shortest, schema = longest + 1, None

        def closed(row: pa.RecordBatch, ext: int, is_open: bool) -> pa.RecordBatch:
            out = row.set_column(row.schema.get_field_index("ext"), "ext", pa.array([ext], pa.int64()))
            return out.set_column(out.schema.get_field_index("is_open"), "is_open", pa.array([is_open]))

        for batch in batches:
            if not len(batch):
                continue
            depth = pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False)
            f, at = batch.column("f").to_numpy(), np.arange(len(batch))
            heads = np.full((len(batch), longest - 1), -1, np.int64)
            ext, deferred = np.zeros(len(batch), np.int64), np.zeros(len(batch), bool)
            finished = []
            for d in range(1, longest):
                own = np.flatnonzero(depth == d)
                of = np.searchsorted(own, at, "right") - 1  # the latest phrase of this length at or before each row
                longer = depth > d
                heads[longer, d - 1] = np.where(of < 0, -1 if last[d] is None else last[d], f[own[np.maximum(of, 0)]] if len(own) else 0)[longer]
                grows = np.flatnonzero(depth == d + 1)
                earlier = grows[of[grows] < 0]
                if len(earlier):
                    if last[d] is None:
                        before[d] = max(before[d], int(f[earlier].max()))
                    else:
                        grown[d] = max(grown[d], int(f[earlier].max()))
                if len(own):
                    np.maximum.at(ext, own[of[grows[of[grows] >= 0]]], f[grows[of[grows] >= 0]])
                    if d in held:
                        finished.append(closed(held.pop(d), grown[d], False))
                    last[d], grown[d] = int(f[own[-1]]), int(ext[own[-1]])
                    deferred[own[-1]] = True
            shortest = min(shortest, int(depth.min()))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(heads.reshape(-1)), longest - 1).cast(pa.list_(pa.int64()))
            out = pa.record_batch(
                [*columns, lists, pa.array(ext), pa.array(np.zeros(len(batch), bool)), pa.array(np.full(len(batch), part, np.int32))],
                names=[*batch.schema.names, "heads", "ext", "is_open", "part"],
            )
            schema = out.schema
            for row in np.flatnonzero(deferred).tolist():
                held[int(depth[row])] = out.slice(row, 1)
            yield from finished
            yield out.filter(pa.array(~deferred))
        if schema is not None:
            yield from (closed(row, grown[d], True) for d, row in held.items())
            sums = [[-1 if x is None else x for x in last[1:longest]] + before[1:longest] + [shortest]]
            given = {"heads": sums, "ext": [0], "is_open": [False], "part": [part]}
            yield pa.record_batch([pa.array(given.get(x.name, [None]), x.type) for x in schema], names=schema.names)

    return run


def _carried(summaries: list, longest: int) -> list[tuple]:
    """What each range takes from those before it (counts by length) and behind it (largest extension by length)."""
    m = longest - 1
    out, last = [], [-1] * m
    for part, sums in summaries:
        out.append([part, list(last), [0] * m])
        last = [new if new >= 0 else old for new, old in zip(sums[:m], last)]
    ahead = [0] * m
    for row, (_, sums) in zip(reversed(out), reversed(summaries)):
        row[2] = list(ahead)
        # A range that begins with a phrase of the same or a smaller length ends what stood open before it.
        ahead = [max(sums[m + d], ahead[d] if sums[2 * m] > d + 1 else 0) for d in range(m)]
    return [tuple(row) for row in out]


def in_order(stream: DataFrame, order: Column, longest: int, heads: str, ext: str) -> DataFrame:
    """The stream with the counts of the beginnings of every phrase in this order of its words, by length, and its largest extension.

    order: the words as an array, first the one by which the stream is sorted first. Memory does not depend on the stream: tasks keep one
    row per length, and one summary per task goes through the driver.
    """
    spark = stream.sparkSession
    columns = stream.columns
    keys = [F.get(order, F.lit(i)).alias(f"_k{i}") for i in range(longest)]
    names = ["lang", *[f"_k{i}" for i in range(longest)]]
    ranged = stream.select("*", *keys).repartitionByRange(*names).sortWithinPartitions(*names).select(*columns)
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in ranged.schema)
    passed = stored(map_batches(ranged, _lockstep(longest), f"{schema}, heads array<long>, ext long, is_open boolean, part int", 20_000), "phrase-order")
    summaries = passed.where("words is null").select("part", "heads").orderBy("part").collect()
    carried = spark.createDataFrame(_carried([tuple(r) for r in summaries], longest), "part int, from_before array<long>, from_behind array<long>")
    rows = passed.where("words is not null").join(F.broadcast(carried), "part")
    depth = F.size("words")
    known = F.transform("heads", lambda x, i: F.when(i >= depth - 1, F.lit(None)).when(x < 0, F.get("from_before", i)).otherwise(x))
    behind = F.when(F.col("is_open"), F.get("from_behind", depth - 1)).otherwise(0)
    return rows.select(*columns, known.alias(heads), F.greatest("ext", F.coalesce(behind, F.lit(0))).alias(ext))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, scale: int = 1_000_000, inside_percent: int = 50) -> DataFrame:
    """Phrases of 2 to `longest` words by language, scored at their weakest cut: lang, phrase, words, a, l, r, n, score.

    docs: lang, text; other columns are left out. Texts are lower-cased (A-Z) and cut into pieces at `.,;:!?` and line breaks, pieces into
    words at spaces and tabs; a phrase lies within a piece. a, l, r: occurrences of the phrase, of the part before the cut and of the part
    behind it; score: floor(scale * a * a / (l * r)), in exact decimals; of equal cuts the first counts. Phrases that occur fewer than
    `least` times are left out, and so are those inside a longer one (by containment: one that is longer by a word) that occurs
    at least inside_percent as often. n: all words of the language.

    A null lang is `und`. Null and empty texts have no words. Repeated rows count as often as they stand. An empty table, and one
    without frequent phrases, gives an empty result.
    """
    stream, totals = phrase_counts(docs, longest, least)
    stream = in_order(stream, F.reverse("words"), longest, "rests", "left_ext")
    stream = in_order(stream, F.col("words"), longest, "firsts", "right_ext")
    depth = F.size("words")
    found = stream.where((depth > 1) & (100 * F.greatest("left_ext", "right_ext") < inside_percent * F.col("f")))

    def cut(k: Column) -> Column:
        return F.struct(F.get("firsts", k - 1).alias("l"), F.get("rests", depth - k - 1).alias("r"), k.alias("k"))

    cuts = found.select("lang", "words", F.col("f").alias("a"), F.transform(F.sequence(F.lit(1), depth - 1), cut).alias("cuts"))
    weakest = F.array_min(F.expr(f"""
        transform(cuts, c -> struct(
            cast({scale} as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0))
            div (cast(c.l as decimal(38,0)) * cast(c.r as decimal(38,0))) as score, c.k as k, c.l as l, c.r as r))"""))
    scored = cuts.select("lang", F.array_join("words", " ").alias("phrase"), "words", "a", weakest.alias("w"))
    return scored.join(totals, "lang").select("lang", "phrase", "words", "a", "w.l", "w.r", "n", F.col("w.score").cast("long").alias("score"))


def best_of_language(found: DataFrame, limit: int) -> DataFrame:
    """The first rows of each language by score, then frequency, then phrase in the order of its bytes; rank starts at 1."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = parts.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(f"_r <= {limit}")
    ranked = some.drop("_salt", "_r").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(f"rank <= {limit}")
