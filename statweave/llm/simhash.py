"""Near duplicates by SimHash with deletion variants.

A fingerprint of 64 bits is cut into two halves. Of two fingerprints that differ in at most two bits, one half differs in at most one, so
they share a variant: that half with one bit left out. Every distinct fingerprint is indexed by its 64 variants, an equality join on the
variants brings candidates together, and the whole distance decides. Pairs are found once: a pair with equal halves only under the first
variant.

Where many fingerprints share a variant, nothing is paired: they are indexed again by variants of their other half, cut in two, and, if
they are still many, by variants of the quarter that is left. A variant of the last level leaves 11 bits free, so at most 2048 different
fingerprints can share it. Halves that very many fingerprints have are known from a count beforehand and start at the second level, so no
task meets all of their holders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm import kernel
from statweave.llm.frames import _stars as stars
from statweave.llm.frames import components, map_batches, stored, with_bytes

SEED = 42
LIMIT = 256
"""Fingerprints of one variant that are compared with each other; more go to the next level."""
HOT_SHARES = 1000
"""A half, or fingerprint, counts as hot if at least one of so many parts of all have it, so there are at most twice as many hot ones."""
JOIN_ROWS = 50_000


# --- fingerprints -------------------------------------------------------------------------------------------------------------


def _spelled(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words, each followed by one space, and where each begins (one more entry at the end)."""
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start + 1, out=at[1:])
    out = np.full(at[-1], 32, np.uint8)
    source = np.arange(at[-1]) + np.repeat(start - at[:-1], end - start + 1)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = buf[source[inside]]
    return out.tobytes(), at


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of hashes the bits that more than half of them have; an empty run gives zero."""
    counts = np.diff(first)
    bits = np.zeros((len(counts), 64), np.int64)
    filled = np.flatnonzero(counts)
    if len(filled):
        step = max(1, (1 << 24) // 64)
        for a in range(0, len(hashes), step):  # so that the unpacked bits of a very long text stay bounded
            part = np.unpackbits(hashes[a : a + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            own = filled[(first[filled] < a + len(part)) & (first[filled + 1] > a)]
            bits[own] += np.add.reduceat(part, np.maximum(first[own] - a, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * bits > counts[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in kernel.slices(batch):
                low = kernel.lower_ascii(buf)
                start, end, first = kernel.find_words(low, offs)
                text, at = _spelled(low, start, end)
                words = np.diff(first)
                grams = np.where(words == 0, 0, np.maximum(words - n + 1, 1))
                bounds = np.concatenate([[0], np.cumsum(grams)])
                begin = np.repeat(first[:-1] - bounds[:-1], grams) + np.arange(bounds[-1])
                stop = begin + np.repeat(np.minimum(words, n), grams)
                digest, seed = xxhash.xxh64_intdigest, SEED
                hashes = [digest(text[a:b], seed) for a, b in zip(at[begin].tolist(), (at[stop] - 1).tolist())]
                prints = _majority(np.array(hashes, np.uint64), bounds)
                yield pa.record_batch([rows.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and print: SimHash of the n-word shingles of every text, repeats included, as a signed long.

    A shingle's hash is XXH64 (seed 42) of its words, joined by one space; a shorter text is one shingle; without words the print is 0.
    """
    return map_batches(with_bytes(docs, "doc_id"), _sign(n), "doc_id long, print long")


# --- variants -----------------------------------------------------------------------------------------------------------------

WIDTH = {1: 32, 2: 16, 3: 8}
"""Bits of a piece at each level: halves of the fingerprint, halves of its other half, halves of the piece that is left then."""
_NONE = np.zeros(0, np.uint64)
_ROWS = "above long, own long, print long, rest long"


def _one_of(some: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Which pieces are in a small sorted array."""
    if not len(some):
        return np.zeros(len(piece), bool)
    return some[np.minimum(np.searchsorted(some, piece), len(some) - 1)] == piece


def _variants(level: int, hot: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)):
    """Every variant of each row at a level: above (variants of earlier levels), own (side, bit left out, other bits), print, rest (bits
    that no level has cut yet), and whether a hot half has it.
    """
    width = WIDTH[level]
    mask = np.uint64((1 << width) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.column("rest").to_numpy().view(np.uint64)
            halves = [rest & mask, rest >> np.uint64(width) & mask]
            for side, piece in enumerate(halves):
                held = _one_of(hot[side], piece)
                for bit in range(width):
                    below = np.uint64((1 << bit) - 1)
                    left = (piece >> np.uint64(bit + 1) << np.uint64(bit)) | (piece & below)
                    own = np.uint64((side * width + bit) << (width - 1)) | left
                    marked = held | _one_of(hot[side], piece ^ np.uint64(1 << bit))
                    yield pa.record_batch(
                        [batch.column("above"), pa.array(own.view(np.int64)), batch.column("print"), pa.array(halves[1 - side].view(np.int64)), pa.array(marked)],
                        names=["above", "own", "print", "rest", "hot"],
                    )

    return run


def _near(level: int, distance: int, limit: int | None):
    """Links among the rows of each variant, as stars; rows of variants that more than `limit` have pass on unpaired (over).

    Rows come sorted by variant. Memory holds a batch, and what one variant has before it is known to be too many.
    """
    width = WIDTH[level]

    def pairs(own: np.ndarray, rest: np.ndarray, prints: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, d = np.arange(len(own)), 1
        bit = (own >> np.uint64(width - 1)) & np.uint64(width - 1)
        while len(at := at[at + d < len(own)]) and len(at := at[group[at + d] == group[at]]):
            other = at + d
            differ = np.bitwise_count(prints[at] ^ prints[other])
            near = (differ <= distance) & (differ > 0)
            if level == 1:  # a pair with equal halves has all variants in common and counts under the first
                near &= (np.bitwise_count(rest[at] ^ rest[other]) < differ) | (bit[at] == 0)
            yield prints[at[near]], prints[other[near]]
            d += 1

    def linked(own, rest, prints, group) -> Iterator[pa.RecordBatch]:
        found = list(pairs(own, rest, prints, group))
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            for star in stars(iter([pa.record_batch([pa.array(a), pa.array(b)], names=["u", "v"])])):
                none = pa.nulls(len(star), pa.int64())
                yield pa.record_batch([none, none, *star.columns, pa.array(np.zeros(len(star), bool))], names=["above", "own", "print", "rest", "over"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flowing = None, None  # rows of the last variant so far, or the variant whose rows pass on

        for batch in _and_end(batches):
            rows = [b for b in (held, batch) if b is not None]
            held = None
            if not rows:
                continue
            table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            above, own = table.column("above").to_numpy(), table.column("own").to_numpy().view(np.uint64)
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (above[1:] != above[:-1])
            begin, group = np.flatnonzero(new), np.cumsum(new) - 1
            size = np.diff(np.append(begin, len(own)))
            large = size > limit if limit else np.zeros(len(size), bool)
            large[0] |= flowing == (above[0], own[0])
            flowing = (above[-1], own[-1]) if large[-1] else None
            stays = np.zeros(len(size), bool)
            if batch is not None and not large[-1]:  # the last variant may go on in the next batch
                stays[-1] = True
                held = table.slice(begin[-1])
            over = np.flatnonzero(large[group])
            if len(over):
                columns = [table.column(c).take(pa.array(over)) for c in ("above", "own", "print", "rest")]
                yield pa.record_batch([*columns, pa.array(np.ones(len(over), bool))], names=["above", "own", "print", "rest", "over"])
            use = np.flatnonzero((~large & ~stays & (size > 1))[group])
            prints, rest = table.column("print").to_numpy().view(np.uint64), table.column("rest").to_numpy().view(np.uint64)
            yield from linked(own[use], rest[use], prints[use], group[use])

    return run


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if len(b))
    yield None


def _hot_halves(prints: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves that at least one of HOT_SHARES parts of all fingerprints have, and more than `limit`."""
    least = max(limit, prints.count() // HOT_SHARES)
    low, high = F.col("print").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("print", 32)
    halves = prints.select(F.posexplode(F.array(low, high)).alias("side", "half"))
    rows = halves.groupBy("side", "half").count().where(f"count > {least}").select("side", "half").collect()
    return tuple(np.sort(np.array([r.half for r in rows if r.side == s], np.uint64)) for s in (0, 1))


def near_links(prints: DataFrame, distance: int = 2, limit: int = LIMIT) -> DataFrame:
    """Links between distinct fingerprints (column print) that differ in at most `distance` bits, at most 3: a, b.

    Links within one variant are given as stars, so equal components follow, not all pairs.
    """
    if not 0 <= distance <= 3:
        raise ValueError("one of two halves differs in at most one bit only up to three differing bits")
    rows = prints.select(F.lit(0).cast("long").alias("above"), "print", F.col("print").alias("rest"))
    variants = map_batches(rows, _variants(1, _hot_halves(prints, limit)), f"{_ROWS}, hot boolean", JOIN_ROWS)
    links, direct = [], variants.where("hot").select("own", "print", "rest")
    pending = variants.where("not hot")
    for level in (1, 2, 3):
        met = pending.select("above", "own", "print", "rest").repartition("above", "own").sortWithinPartitions("above", "own")
        met = stored(map_batches(met, _near(level, distance, limit if level < 3 else None), f"{_ROWS}, over boolean", JOIN_ROWS), f"simhash-near-{level}")
        links.append(met.where("not over").select(F.col("print").alias("a"), F.col("rest").alias("b")))
        over = met.where("over")
        if level == 1:
            over = over.select("own", "print", "rest").unionByName(direct).withColumnRenamed("own", "above")
        elif level == 2:
            over = over.withColumn("above", F.shiftleft("above", 20).bitwiseOR(F.col("own"))).drop("own", "over")
        if level == 3 or over.isEmpty():
            break
        pending = map_batches(over.select("above", "print", "rest"), _variants(level + 1), f"{_ROWS}, hot boolean", JOIN_ROWS)
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, n: int = 3, distance: int = 2) -> DataFrame:
    """Fingerprint and component of every document: doc_id, print (signed long), component; one row per input row.

    docs: doc_id long, text string; other columns are left out. Documents link when their fingerprints differ in at most `distance` bits;
    component is the smallest doc_id reachable. Null and empty texts have fingerprint 0 and link like any other. Rows without doc_id link
    with nothing and have no component. Repeated rows, and rows that repeat an id with another text, are judged by their own fingerprint.
    An empty table gives an empty result.
    """
    signed = stored(fingerprints(docs.select("doc_id", "text"), n), "simhash-prints")
    nodes = stored(signed.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-nodes")
    joined = components(near_links(nodes.where("least is not null").select("print"), distance), "simhash-components")
    rooted = nodes.join(joined.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_print = stored(rooted.join(component, "root").select("print", "copies", "component"), "simhash-named")
    # A fingerprint that many documents have would meet all of them in one task; there are at most HOT_SHARES such.
    many = signed.count() // HOT_SHARES
    hot = F.broadcast(of_print.where(f"copies > {many}").select("print", "component"))
    rest = of_print.where(f"copies <= {many}").select("print", "component")
    found = signed.join(hot, "print").unionByName(signed.join(hot.select("print"), "print", "left_anti").join(rest, "print"))
    return found.select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))
