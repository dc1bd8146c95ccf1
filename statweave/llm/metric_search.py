"""Exact top-k search by inner product in M-trees.

Inner products become distances by one more coordinate that makes all vectors equally long: the nearest vectors are then those of
highest inner product. Vectors are dealt to pages around routing vectors; a page is an M-tree: routing entries with covering radii
and distances to their parent, and leaves with the distances to theirs. A query visits entries in the order of their lower bounds
and skips all that the triangle inequality rules out, mostly without computing a distance. Scores are exact integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm.frames import grouped, map_batches, stored

SCALE = 256
PIVOTS = 256
"""Routing vectors: a sample of bounded size. It only shapes the pages; every vector is stored in one."""
PAGE_ROWS = 4096
CHUNK_ROWS = 65_536
BLOCK_QUERIES = 128
LEAF = 48


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary()), ("norm", pa.float64())])
    for batch in batches:
        out = []
        for i, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            if i is None or not values.is_valid or values.values.null_count:
                continue
            x = values.values.to_numpy(zero_copy_only=False).astype(float)
            if not np.isfinite(x).all():
                continue
            q = np.floor(SCALE * x).astype(np.int64)
            out.append((i, len(q), q.tobytes(), float((q.astype(float) ** 2).sum())))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def quantised(vectors: DataFrame) -> DataFrame:
    """Integer vectors of all usable rows: vec_id, dim, vector (64-bit integers), norm (squared length)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(rows, _quantised, "vec_id long, dim int, vector binary, norm double")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dim)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that gives all the same length; queries get 0 there instead."""
    x = vectors.astype(float)
    return np.concatenate([x, np.sqrt(np.maximum(0, longest - (x**2).sum(1)))[:, None]], 1)


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, ((points - to) ** 2).sum(-1)))


def build_page(ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, longest: float) -> dict:
    """An M-tree of one page below a routing vector: leaves around routing entries, each with radius and parent distance."""
    points = lifted(vectors, longest)
    count = max(1, len(ids) // LEAF)
    # Routing entries: far from one another, by repeated choice of the farthest point.
    picks, near = [0], distances(points, points[0])
    while len(picks) < count and near.max() > 0:
        picks.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[picks[-1]]))
    routing = points[picks]
    square = (points**2).sum(1)[:, None] - 2 * points @ routing.T + (routing**2).sum(1)
    leaf = square.argmin(1)
    order = np.argsort(leaf, kind="stable")
    leaf, ids, vectors, points = leaf[order], ids[order], vectors[order], points[order]
    to_parent = np.sqrt(np.maximum(0, ((points - routing[leaf]) ** 2).sum(1)))
    begin = np.searchsorted(leaf, np.arange(len(picks) + 1))
    radius = np.array([to_parent[a:b].max() if b > a else 0.0 for a, b in zip(begin[:-1], begin[1:])])
    return {
        "ids": ids, "vectors": vectors, "to_parent": to_parent, "begin": begin, "routing": routing, "radius": radius,
        "routing_to_centre": distances(routing, centre), "centre": centre, "cover": float(distances(points, centre).max()),
    }


def search(query: np.ndarray, own: int, pages: list[dict], k: int, longest: float) -> list[tuple[int, int]]:
    """The k best (score, id) of the pages, best first; ties to the smaller id. Entries beyond the k-th best are never computed."""
    q = np.append(query.astype(float), 0.0)
    base = float((q**2).sum()) + longest
    slack = 1e-7 * (base**0.5 + 1)
    exact = longest < 2**52 and base < 2**52
    probe = query.astype(float) if exact else query
    best: list[tuple[int, int]] = []  # a heap with the worst at the top: score, minus id
    reach = float("inf")
    queue: list[tuple[float, int, int, int, float]] = []
    for p, d in enumerate(distances(np.stack([page["centre"] for page in pages]), q).tolist() if pages else []):
        queue.append((max(0.0, d - pages[p]["cover"]), 0, p, 0, d))
    heapq.heapify(queue)
    while queue:
        bound, level, p, node, d = heapq.heappop(queue)
        if bound > reach + slack:
            break
        page = pages[p]
        if level == 0:
            rough = np.abs(d - page["routing_to_centre"]) - page["radius"]  # from stored distances alone
            some = np.flatnonzero(rough <= reach + slack)
            far = distances(page["routing"][some], q)
            for n, x in zip(some.tolist(), far.tolist()):
                lower = max(0.0, x - float(page["radius"][n]))
                if lower <= reach + slack:
                    heapq.heappush(queue, (lower, 1, p, n, x))
            continue
        a, b = int(page["begin"][node]), int(page["begin"][node + 1])
        some = a + np.flatnonzero(np.abs(d - page["to_parent"][a:b]) <= reach + slack)
        # A leaf that is wanted whole is not copied.
        scores = page["plain" if exact else "vectors"][slice(a, b) if len(some) == b - a else some] @ probe
        if len(best) == k:  # what scores below the k-th best is left out for all at once
            able = np.flatnonzero(scores >= best[0][0])
            some, scores = some[able], scores[able]
        for s, i in zip(scores.tolist(), page["ids"][some].tolist()):
            entry = (int(s), -i)
            if i == own or (len(best) == k and entry <= best[0]):
                continue
            (heapq.heappush if len(best) < k else heapq.heapreplace)(best, entry)
        if len(best) == k:
            reach = max(0.0, base - 2.0 * best[0][0]) ** 0.5
    return [(s, -i) for s, i in sorted(best, key=lambda e: (-e[0], -e[1]))]


_PAGE = {"ids": np.int64, "vectors": np.int64, "to_parent": float, "begin": np.int64, "routing": float, "radius": float, "routing_to_centre": float, "centre": float}


def _build(longest: float):
    schema = pa.schema([("page", pa.int64()), ("dim", pa.int32()), ("rows", pa.int64()), *((n, pa.binary()) for n in _PAGE), ("cover", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "page"):
            dim = table["dim"][0].as_py()
            ids, vectors = table["vec_id"].to_numpy(), _matrix(table["vector"], dim)
            centre = lifted(_matrix(table["centre"].slice(0, 1), dim), longest)[0]
            made = build_page(ids, vectors, centre, longest)
            row = [table["page"][0].as_py(), dim, len(ids), *(np.ascontiguousarray(made[n], t).tobytes() for n, t in _PAGE.items()), made["cover"]]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

    return run


def _read_page(row: dict, plain: bool) -> dict:
    dim = row["dim"]
    page = {n: np.frombuffer(row[n], t) for n, t in _PAGE.items()} | {"cover": row["cover"]}
    page["vectors"] = page["vectors"].reshape(len(page["ids"]), dim)
    page["routing"] = page["routing"].reshape(-1, dim + 1)
    if plain:
        page["plain"] = page["vectors"].astype(float)
    return page


def _answer(k: int, longest: float):
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "grp"):
            rows = table.to_pylist()
            queries = [r for r in rows if r["query"] is not None]
            pages = [_read_page(r, longest < 2**52) for r in rows if r["query"] is None]
            out = []
            for r in queries:
                vector = np.frombuffer(r["vectors"], np.int64)
                out += [(r["query"], r["query_id"], i, s) for s, i in search(vector, r["query_id"], pages, k, longest)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k rows of highest integer inner product for every query: query_id, rank, vec_id, score.

    vectors: vec_id long, embedding array. Queries are the rows whose vec_id is divisible by `every`; candidates are all rows of another
    vec_id and the same number of components. Components become floor(256 * x). Rows with a null id or vector, or with a null or
    non-finite component, take no part. Repeated rows are candidates each; repeated queries are answered once. Ties go to the
    smaller vec_id. Vectors without components score 0. An empty table gives an empty result.
    Queries meet pages in blocks; a task holds one block and the pages of one chunk.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors), "vectors")
    total, longest = rows.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    longest = float(longest)
    # Routing vectors of each dimension, by a hash of their id.
    pivots = (
        rows.withColumn("nth", F.expr("row_number() over (partition by dim order by xxhash64(vec_id), vec_id, vector)"))
        .where(F.col("nth") <= max(1, min(PIVOTS, total // 64))).select("dim", "nth", "vector")
    )
    centres: dict[int, list[bytes]] = {}
    for r in pivots.collect():
        centres.setdefault(r["dim"], []).append(bytes(r["vector"]))
    shared = spark.sparkContext.broadcast({d: np.frombuffer(b"".join(sorted(c)), np.int64).reshape(-1, d) for d, c in centres.items() if d})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routing = {d: lifted(c, longest) for d, c in shared.value.items()}
        for batch in batches:
            nth, centre = [], []
            for dim, vector in zip(batch.column("dim").to_pylist(), batch.column("vector").to_pylist()):
                x = lifted(np.frombuffer(vector, np.int64).reshape(1, -1), longest)[0] if dim else None
                nth.append(int(((routing[dim] - x) ** 2).sum(1).argmin()) if dim else 0)
                centre.append(shared.value[dim][nth[-1]].tobytes() if dim else b"")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "dim", "vector")), pa.array(nth, pa.int32()), pa.array(centre, pa.binary())],
                names=["vec_id", "dim", "vector", "nth", "centre"],
            )

    placed = stored(map_batches(rows, assign, "vec_id long, dim int, vector binary, nth int, centre binary"), "vector-places")
    sizes = placed.groupBy("dim", "nth").agg(F.ceil(F.count("*") / PAGE_ROWS).cast("int").alias("parts"))
    paged = placed.join(sizes, ["dim", "nth"]).withColumn("page", F.xxhash64("dim", "nth", F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts"))))
    paged = paged.select("page", "dim", "vec_id", "vector", "centre").repartition("page").sortWithinPartitions("page")
    schema = "page long, dim int, rows long, " + ", ".join(f"{n} binary" for n in _PAGE) + ", cover double"
    pages = stored(map_batches(paged, _build(longest), schema), "vector-pages")

    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "dim", "vector").distinct()
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    chunks = max(1, -(-total // CHUNK_ROWS))
    key = lambda block, chunk: F.xxhash64("dim", block, chunk).alias("grp")
    some = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    page_rows = (
        pages.withColumn("chunk", F.pmod("page", F.lit(chunks)).cast("int")).withColumn("block", some(blocks))
        .select(key("block", "chunk"), F.lit(None).cast("long").alias("query"), F.lit(None).cast("long").alias("query_id"), "dim", *_PAGE, "cover")
    )
    query = F.xxhash64("vec_id", "vector")
    query_rows = (
        asked.withColumn("block", F.pmod(query, F.lit(blocks)).cast("int")).withColumn("chunk", some(chunks))
        .select(key("block", "chunk"), query.alias("query"), F.col("vec_id").alias("query_id"), "dim",
                *[(F.col("vector") if n == "vectors" else F.lit(None).cast("binary")).alias(n) for n in _PAGE], F.lit(0.0).alias("cover"))
    )
    met = query_rows.unionByName(page_rows).repartition("grp").sortWithinPartitions("grp")
    found = map_batches(met, _answer(k, longest), "query long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
