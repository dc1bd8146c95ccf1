"""Word deduplication with automata of repeated phrases.

Passages that may recur come from anchors (see `repeats`): contexts seen twice, and the single windows of contexts that share an anchor
but differ. They are dealt to shards by content and sorted by name, a hash of all their words. A shard leaves out passages whose name
stands alone, confirms which of the others recur, compiles these into an Aho-Corasick automaton over words, and streams all others
through it; every occurrence but the first is marked. A passage in very many documents reaches its shard once per task that read it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm import kernel, repeats
from statweave.llm.frames import map_batches, stored

WINDOW, GRAM = 20, 5
SHARD_WORDS = 400_000
"""Words of candidate passages that one automaton is made for at a time."""
HOLD_BYTES = 1 << 25
"""Texts that a task gathers before it collapses repetitions among their passages."""


def word_units(buf: np.ndarray, offs: np.ndarray) -> repeats.Units:
    return repeats.Units(*kernel.word_hashes(buf, offs))


_PASSAGE = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("words", pa.binary())])


def _candidates(text: bytes, start: np.ndarray, count: np.ndarray, window: int) -> tuple[bytes, tuple[np.ndarray, ...]]:
    """The text with single spaces, and of its passages: name, start, count, and where they begin and end in that text."""
    buf = np.frombuffer(text, np.uint8)
    left, right, _ = kernel.find_words(buf, np.array([0, len(buf)]))
    sums = kernel.unit_sums(kernel.range_hash(kernel.rolling(buf), left, right))
    whole = count > 0  # negative: single windows, as many
    many = -count[~whole]
    single = np.unique(np.repeat(start[~whole] - np.cumsum(many) + many, many) + np.arange(many.sum()))
    start, count = np.concatenate([start[whole], single]), np.concatenate([count[whole], np.ones(len(single), np.int64)])
    order = np.lexsort((count, start))
    start, count = start[order], count[order]
    ok = start + count - 1 + window <= len(left)
    ok[1:] &= (start[1:] != start[:-1]) | (count[1:] != count[:-1])  # a context of one window may stand there as both
    start, count = start[ok], count[ok]
    end = start + count - 1 + window
    to = np.cumsum(right - left + 1) - 1  # ends of the words, one space between them
    begin = to - (right - left)
    return b" ".join(text.split()), (kernel.range_hash(sums, start, end).view(np.int64), start, count, begin[start], to[end - 1])


def _passages(window: int):
    """Texts of passages that may recur; of passages equal within the task only the first, the others are settled (no words)."""

    def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts = [text for _, text, _ in held]
        name, start, count, begin, end = (np.concatenate(x) for x in zip(*[c for *_, c in held]))
        which = np.repeat(np.arange(len(held)), [len(c[0]) for *_, c in held])
        doc = np.array([d for d, *_ in held], np.int64)[which]
        # Documents come in ascending order, so the first passage seen is the earliest here.
        order = np.argsort(name, kind="stable")
        new = np.ones(len(name), bool)
        new[order[1:]] = name[order[1:]] != name[order[:-1]]
        anywhere = kernel.mix(doc.view(np.uint64) ^ kernel.mix(start.astype(np.uint64))).view(np.int64)
        route = np.where(new, name, anywhere)
        part = np.cumsum(np.where(new, end - begin, 0)) // HOLD_BYTES
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(name)]
        for some in (slice(a, b) for a, b in zip(cuts, cuts[1:])):
            places = zip(*(x[some].tolist() for x in (new, which, begin, end)))
            words = [texts[w][i:j] if n else None for n, w, i, j in places]
            columns = (route[some], doc[some], start[some], count[some], words)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _PASSAGE.types)], schema=_PASSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = number = 0
        for doc_id, texts, start, count in repeats.each_document(batches):
            if not texts or not len(start):
                continue
            text, found = _candidates(texts[0], start, count, window)
            if not len(found[0]):
                continue
            held.append((doc_id, text, found))
            size, number = size + len(text), number + len(found[0])
            if size >= HOLD_BYTES or number >= repeats.HOLD_ROWS // 4:
                yield from out(held)
                held, size, number = [], 0, 0
        if held:
            yield from out(held)

    return run


class _Ids(dict):
    """Numbers of words, given as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def locate(passages: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """Occurrences that are not the first of their passage. passages: document, start, count, words; any order."""
    number = _Ids().__getitem__
    texts = [tuple(map(number, words.split())) for *_, words in passages]
    times: dict[tuple, int] = {}
    for t in texts:
        times[t] = times.get(t, 0) + 1
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    patterns = {t: k for k, t in enumerate(t for t, n in times.items() if n > 1)}
    if not patterns:
        return []
    for t, k in patterns.items():
        machine.add_word(t, k)
    machine.make_automaton()
    length = [len(t) for t in patterns]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for (doc, start, count, _), t in zip(passages, texts):
        for end, k in machine.iter(t):
            if length[k] == len(t):  # a shorter one inside is a passage of its own elsewhere
                found.setdefault(k, []).append((doc, start, count))
    out = []
    for places in found.values():
        places = sorted(set(places))
        out += places[1:]
    return out


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """Of rows sorted by passage name: those settled before, and those whose name another row shares.

    Equal passages have equal names, so a name that stands alone is of a passage that does not recur.
    """
    tail, shared = None, False  # the last passage so far, and whether the one before it has its name
    for batch in batches:
        settled = batch.column("words").is_null()
        rows = batch.filter(pc.invert(settled))
        if tail is not None:
            rows = pa.Table.from_batches([tail, rows]).combine_chunks().to_batches()[0]
        if not len(rows):
            yield batch.filter(settled), rows
            continue
        name = rows.column("route").to_numpy()
        same = np.concatenate([[shared], name[1:] == name[:-1]])
        keep = same.copy()
        keep[:-1] |= same[1:]
        tail, shared = rows.slice(len(rows) - 1), bool(same[-1])
        yield batch.filter(settled), rows.slice(0, len(rows) - 1).filter(pa.array(keep[:-1]))
    if tail is not None:
        yield tail.slice(0, 0), tail if shared else tail.slice(0, 0)


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every occurrence but the first, from rows sorted by passage name."""
    held: list[tuple] = []
    size, last = 0, None
    place = ("doc_id", "start", "count")

    def out(found) -> pa.RecordBatch:
        doc, start, count = zip(*found) if found else ((), (), ())
        return pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int32()), "count": pa.array(count, pa.int32())})

    for settled, rows in _recurring(batches):
        for route, *passage in zip(*(rows.column(k).to_pylist() for k in ("route", *place, "words"))):
            if size >= SHARD_WORDS and route != last:
                yield out(locate(held))
                held, size = [], 0
            held.append(tuple(passage))
            size += passage[2] + 19
            last = route
        yield settled.select(place)
    yield out(locate(held))


def _cleaned(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc_id, texts, start, count in repeats.each_document(batches):
            for text in texts:
                words = text.split()
                gone = repeats.covered(len(words), start, count, window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words)
                out.append((doc_id, len(words), int(gone.sum()), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
            if len(out) >= 500:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs of windows that also start earlier: doc_id, start, count (of consecutive windows), in words."""
    runs = repeats.window_runs(docs, word_units, window, min(GRAM, window))
    # Whole contexts have a positive count, contexts whose windows are looked at one by one a negative one.
    undecided = F.col("kind") == repeats.UNDECIDED
    settled = F.col("kind") == repeats.SETTLED
    wanted = runs.where(~settled).select("doc_id", "start", F.when(undecided, -F.col("count")).otherwise(F.col("count")).alias("count"))
    schema = "route long, doc_id long, start int, count int, words binary"
    passages = repeats.beside_text(docs.where("doc_id is not null"), wanted, _passages(window), schema)
    shards = passages.repartition("route").sortWithinPartitions("route")
    later = stored(map_batches(shards, _located, "doc_id long, start int, count int"), "passage-repeats")
    return later.unionByName(runs.where(settled).select("doc_id", "start", "count"))


def remove_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What is left of every text when all words go that a repeated window of words covers.

    docs: doc_id, text. A word goes if it lies in `window` consecutive words that also start earlier: in a smaller doc_id, or in the same
    document further left. Returns doc_id, n_words, n_removed, kept (words joined by one space), kept_sha256; one row per input row. Null
    and empty texts have no words. Rows without doc_id neither remove nor lose anything. Rows repeated with one id are one document.
    An empty table gives an empty result.
    """
    gone = repeated_passages(docs, window)
    return repeats.beside_text(docs, gone, _cleaned(window), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
