"""Mixing sources to target weights by minimum-cost flow.

A document may belong to several overlapping sources. Documents are aggregated by membership pattern, and tokens flow from patterns
to the quotas of their sources: the first copy of a pattern's tokens is free, every further copy costs more, so repetition is spread
where it is cheapest. The flow runs over patterns and sources only. Then each pattern's amount is filled with documents in seeded
order; whole copies go to all documents, the rest to those that come first.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm import kernel
from statweave.llm.frames import local_table, map_batches, stored

MAX_COPIES = 2
PLACES = 1 << 40
"""The seeded order has this many places."""


class _Flow:
    """Successive shortest paths with potentials; arcs come in pairs, an arc and its reverse."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        """Send as much as possible at the least cost; all costs are non-negative at the start."""
        n = len(self.out)
        height = [0] * n
        while True:
            far, by, queue = [None] * n, [-1] * n, [(0, source)]
            far[source] = 0
            while queue:
                d, x = heapq.heappop(queue)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    if self.room[e] <= 0:
                        continue
                    y = self.to[e]
                    step = d + self.cost[e] + height[x] - height[y]
                    if far[y] is None or step < far[y]:
                        far[y], by[y] = step, e
                        heapq.heappush(queue, (step, y))
            if far[sink] is None:
                return
            for x in range(n):
                height[x] += far[x] if far[x] is not None else far[sink]
            amount, x = None, sink
            while x != source:
                amount = self.room[by[x]] if amount is None else min(amount, self.room[by[x]])
                x = self.to[by[x] ^ 1]
            x = sink
            while x != source:
                self.room[by[x]] -= amount
                self.room[by[x] ^ 1] += amount
                x = self.to[by[x] ^ 1]


def route(patterns: list[tuple[tuple, int]], quotas: dict, max_copies: int = MAX_COPIES) -> list[int]:
    """Tokens that each pattern gives, at the least cost of repetition.

    patterns: (sources, tokens); quotas: tokens wanted by each source. Copy k of a pattern's tokens costs k * k - 1 a token.
    """
    sources = list(quotas)
    place = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    flow = _Flow(2 + len(patterns) + len(sources))
    arcs = []
    for i, (members, tokens) in enumerate(patterns):
        arcs.append([flow.arc(0, 2 + i, tokens, k * k - 1) for k in range(1, max_copies + 1)])
        for s in members:
            flow.arc(2 + i, place[s], tokens * max_copies, 0)
    for s in sources:
        flow.arc(place[s], 1, int(round(quotas[s])), 0)
    flow.run(0, 1)
    return [sum(flow.room[e ^ 1] for e in own) for own in arcs]


def source_targets(sizes: dict, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0) -> dict:
    """Tokens wanted from each source: weights by name order (null last), repeating, over share of all tokens.

    A source gives at most `most` times its size; what lies above goes to the others by weight until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    fixed: dict = {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, whole = total - sum(fixed.values()), sum(weight[s] for s in free)
        above = [s for s in free if rest * weight[s] / whole > most * sizes[s]]
        if not above:
            return fixed | {s: rest * weight[s] / whole for s in free}
        fixed |= {s: most * sizes[s] for s in above}
        if len(above) == len(free):
            return fixed


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offs in kernel.slices(batch):
            _, _, first = kernel.find_words(buf, offs)
            names = [n for n in rows.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(np.diff(first), pa.int64())], names=[*names, "size"])


def word_sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, sources, the kept columns and the number of words; docs: doc_id, sources array<string>, text."""
    rows = docs.select("doc_id", "sources", *keep, F.col("text").cast("binary").alias("text"))
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return map_batches(rows, _counted, f"doc_id long, sources array<string>{kept}, size long")


def mix(docs: DataFrame, targets=None, max_copies: int = MAX_COPIES, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id long, sources array<string> (the sources it belongs to; null stands for one of its own), text string.
    targets: words wanted by source, a function of the sources' sizes (default `source_targets`). keep: further columns to pass on.
    Returns doc_id, sources, size, source_size and target (of its first source), taken (size times the copies taken); one row per
    input row. Null and empty texts have size 0 and take nothing. Rows without doc_id have a place by their text. Repeated rows and ties
    in the seeded order are told apart by their size or are alike; alike rows are taken or left in an order that reruns repeat. An empty table gives an
    empty result. Only one row per pattern and source reaches the driver.
    """
    spark = docs.sparkSession
    named = docs.withColumn("name", F.coalesce("doc_id", F.xxhash64("text")))
    sized = word_sizes(named, "name", *keep).withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "name"), F.lit(PLACES))).drop("name")
    sized = stored(sized, "mix-sizes")
    patterns = sized.groupBy("sources").agg(F.sum("size").alias("tokens"), F.count("*").alias("rows")).collect()
    names = [tuple(p["sources"]) if p["sources"] is not None else (None,) for p in patterns]
    sizes: dict = {}
    for members, p in zip(names, patterns):
        for s in members:
            sizes[s] = sizes.get(s, 0) + p["tokens"]
    wanted = (targets or source_targets)(sizes) if sizes else {}
    amounts = route([(m, p["tokens"]) for m, p in zip(names, patterns)], wanted, max_copies)

    plan = []
    for members, p, amount in zip(names, patterns, amounts):
        copies, rest = divmod(amount, p["tokens"]) if p["tokens"] else (0, 0)
        bins = math.isqrt(p["rows"]) + 1  # as many bins as rows in a bin, for a pattern of any size
        plan.append((p["sources"], int(copies), int(rest), int(bins), int(sizes[members[0]]), float(wanted[members[0]])))
    plan = local_table(spark, plan, "sources array<string>, copies long, rest long, bins long, source_size long, target double")

    # Place in the seeded order: first by bin, whose sums are few rows for each pattern, then inside a bin.
    same = F.col("s.sources").eqNullSafe(F.col("p.sources"))
    rows = sized.alias("s").join(plan.alias("p"), same).select("s.*", "copies", "rest", "bins", "source_size", "target")
    rows = rows.withColumn("bin", F.floor(F.col("place") * F.col("bins") / F.lit(float(PLACES))))
    key = F.coalesce(F.to_json("sources"), F.lit(""))
    rows = rows.withColumn("pattern", F.xxhash64(key))
    sums = rows.groupBy("pattern", "bin").agg(F.sum("size").alias("bin_size"), F.max("rest").alias("rest"))
    sums = sums.selectExpr(
        "pattern", "bin", "rest", "bin_size",
        "sum(bin_size) over (partition by pattern order by bin) - bin_size as before",
    )
    # Only the bin in which the rest ends needs an order inside; the bins before are taken whole, those behind not at all.
    # That is one bin of a pattern at most, so the edges are as small as the plan and travel like it.
    edge = sums.where("before < rest and before + bin_size > rest").select("pattern", "bin", "before").collect()
    edge = local_table(spark, [tuple(r) for r in edge], "_p long, _b long, before long")
    joined = rows.join(edge, F.col("pattern") == F.col("_p"), "left")
    whole = F.when(F.col("_b").isNull(), F.col("rest") > 0).otherwise(F.col("bin") < F.col("_b"))
    joined = joined.withColumn("extra", whole.cast("long"))
    inside = joined.where("bin = _b").selectExpr(
        "*", "sum(size) over (partition by pattern, bin order by place, doc_id, size rows unbounded preceding) as upto"
    )
    # The document at the edge is taken if that comes nearer to the target.
    inside = inside.withColumn("extra", (F.col("before") + F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long")).drop("upto")
    both = joined.where("_b is null or bin <> _b").unionByName(inside)
    taken = F.col("size") * F.least(F.col("copies") + F.col("extra"), F.lit(max_copies))
    return both.select("doc_id", "sources", "size", "source_size", "target", taken.alias("taken"), *keep)


def mixed(docs: DataFrame, source: str = "source", **how) -> DataFrame:
    """The documents of the mix with all columns, as often as the mix takes them; null sources are one source.

    Rows are told apart by id, source and text, so null and repeated ids do not mix. Rows that agree in all three are alike: what the mix
    takes of them is dealt evenly, and the first of them gives what is left over. Null and empty texts are in no mix. An empty table gives
    an empty result.
    """
    key = F.xxhash64("doc_id", source, "text")
    taken = mix(docs.select("doc_id", F.array(source).alias("sources"), "text", key.alias("_key")), keep=("_key",), **how)
    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("long")
    copies = taken.groupBy("_key").agg(F.sum(share).alias("_copies"), F.count("*").alias("_alike")).where("_copies > 0")
    copies = stored(copies.selectExpr("_key", "_copies div _alike as _each", "_copies % _alike as _over"), "mix-copies")
    rows = docs.select(F.struct("*").alias("row"), key.alias("_key"))
    times = lambda n: F.explode(F.sequence(F.lit(1), n))
    # The copies grow with the documents, so this join shuffles at every size.
    out = rows.join(copies.where("_each > 0").hint("merge"), "_key").select("row", times(F.col("_each"))).select("row.*")
    over = copies.where("_over > 0")
    if over.isEmpty():
        return out
    first = rows.join(over, "_key").groupBy("_key").agg(F.first("row").alias("row"), F.first("_over").alias("_over"))
    return out.unionByName(first.select("row", times(F.col("_over"))).select("row.*"))
