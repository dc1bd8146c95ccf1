"""N-gram Jaccard join by prefix trees.

Two texts link when their sets of word n-grams overlap by a given share of their union. Sets that can link share an n-gram among
the first few of a global order (rare before frequent, then by hash), so those prefixes choose which sets meet; a parity sketch
then rules out pairs that differ in too many n-grams. What is left falls into small families. The sets of a family, ordered by
frequency, are stored in a trie, and every set walks it: siblings share the overlap of their common beginning, and a subtree is
left as soon as its remaining length cannot reach the needed overlap. Links give components.

Copies of one set are one node from the start. A family of any size is dealt to blocks of bounded size; blocks whose sets are
already in one component need no comparison, all others are compared pairwise, so no link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statweave.llm import kernel
from statweave.llm.frames import components, grouped, map_batches, stored, with_bytes

FREQUENT_TERMS = 1_000_000
"""At most so many n-grams count as frequent, those in most documents. It bounds what is broadcast and changes no result."""
COUNT_CHUNK = 2_000_000
REPEATED = 3
"""Documents of a chunk that hold an n-gram for it to be counted as repeated."""
PAIR_RUN = 64
"""Sets that share a prefix n-gram are paired at once up to this number; larger runs are compared by sketches, in blocks."""
RUN_BLOCK = 2048
BLOCK_SETS, BLOCK_GRAMS = 1024, 2_000_000


def gram_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text, lower-cased; a text of fewer words is one n-gram, an empty one has none."""
    words, first = kernel.word_hashes(kernel.lower_ascii(buf), offs)
    grams = kernel.gram_hash(words, n)
    sums = kernel.unit_sums(words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(kernel.range_hash(sums, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_node(grams: np.ndarray) -> int | None:
    """One 64-bit name for a set of n-grams."""
    if not len(grams):
        return None
    return int(kernel.mix(np.array([kernel.mix(grams ^ np.uint64(len(grams))).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])


def parity_sketch(grams: np.ndarray) -> bytes:
    """One bit per slot, toggled by each n-gram: sketches of two sets differ in at most as many bits as the sets in n-grams."""
    bits = max(64, 1 << int(len(grams) - 1).bit_length())
    return np.packbits((np.bincount((grams >> np.uint64(20)) & np.uint64(bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, after the longer one is folded to the size of the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def largest_difference(a: int, b: int, percent: int) -> int:
    """Most n-grams in which linked sets of these sizes can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


# --- frequent n-grams -------------------------------------------------------------------------------------------------------


def _count_repeated(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= REPEATED
            return pa.record_batch({"gram": grams[some].view(np.int64), "n": counts[some].astype(np.int64)})

        for batch in batches:
            for _, buf, offs in kernel.slices(batch):
                for grams in gram_sets(buf, offs, n):
                    held.append(grams)
                    size += len(grams)
                if size >= COUNT_CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def frequent_grams(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of n-grams in very many documents, as counted over all documents; chunks report what they see repeated."""
    counts = stored(
        map_batches(with_bytes(docs), _count_repeated(n), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts"
    )
    # The lowest number of documents, a power of the square root of 2, that few enough n-grams reach.
    steps = counts.groupBy(F.floor(2 * F.log2("n")).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()
    least, held = None, 0
    for row in steps:
        held += row["count"]
        if held > FREQUENT_TERMS:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.uint64)
    rows = counts.where(F.floor(2 * F.log2("n")) >= least).select("gram").toArrow()
    return np.sort(rows.column("gram").to_numpy().view(np.uint64))


# --- candidate families -----------------------------------------------------------------------------------------------------


def _describe(n: int, percent: int, frequent):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary()), ("grams", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        seen: set[int] = set()
        for batch in batches:
            for rows, buf, offs in kernel.slices(batch):
                ids = rows.column("doc_id").to_pylist()
                out: list[tuple] = []
                for i, grams in zip(ids, gram_sets(buf, offs, n)):
                    size = len(grams)
                    node = set_node(grams) if i is not None else None
                    if node is None or node in seen:
                        out.append((i, size, node, None, None))
                        continue
                    seen.add(node)
                    # At least ceil(percent of size) must be shared, so one of the first others + 1 is.
                    prefix = size - -(-percent * size // 100) + 1
                    at = np.searchsorted(often, grams)
                    common = often[np.minimum(at, len(often) - 1)] == grams if len(often) else np.zeros(size, bool)
                    ordered = np.concatenate([grams[~common], grams[common]])[:prefix]
                    out.append((i, size, node, parity_sketch(grams), ordered.view(np.int64)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def _meet(percent: int):
    """Pairs of nodes within runs of the same n-gram, from rows sorted by n-gram and node; of a long run, (n-gram, node)."""

    def pairs_of(gram: int, node: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        if len(node) > PAIR_RUN:
            return np.full(len(node), gram), node, True
        a, b = np.triu_indices(len(node), 1)
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        near = 100 * low >= percent * high
        return node[a[near]], node[b[near]], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            a, b, long = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((long, b, a))
            a, b, long = a[order], b[order], long[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (long[1:] != long[:-1])
            return pa.record_batch({"a": a[new], "b": b[new], "long_run": long[new]})

        def work(gram, node, size) -> None:
            nonlocal count
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
            gram, node, size = gram[new], node[new], size[new]
            begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            length = np.diff(np.append(begin, len(gram)))
            two = begin[length == 2]
            low, high = np.minimum(size[two], size[two + 1]), np.maximum(size[two], size[two + 1])
            two = two[100 * low >= percent * high]
            if len(two):
                found.append((node[two], node[two + 1], np.zeros(len(two), bool)))
                count += len(two)
            for at, m in zip(begin[length > 2].tolist(), length[length > 2].tolist()):
                a, b, long = pairs_of(gram[at], node[at : at + m], size[at : at + m])
                if len(a):
                    found.append((a, b, np.full(len(a), long)))
                    count += len(a)

        for batch in batches:
            cols = tuple(batch.column(c).to_numpy() for c in ("gram", "node", "n"))
            if rest is not None:
                cols = tuple(np.concatenate(x) for x in zip(rest, cols))
            if not len(cols[0]):
                continue
            # The last run may go on in the next batch.
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            work(*(c[:cut] for c in cols)) if cut else None
            rest = tuple(c[cut:] for c in cols)
            if count >= 500_000:
                yield flush()
                found, count = [], 0
        if rest is not None and len(rest[0]):
            work(*rest)
        if found:
            yield flush()

    return run


def _close(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_pylist() for k in ("na", "nb", "sa", "sb")}
            keep = [sketch_distance(x, y) <= largest_difference(m, n, percent) for m, n, x, y in zip(c["na"], c["nb"], c["sa"], c["sb"])]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare_runs(percent: int):
    """Spanning forests of the close pairs of each group; rows are sorted by group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "grp"):
            node, size, part = (table[c].to_numpy() for c in ("node", "n", "part"))
            sketch = table["sketch"].to_pylist()
            forest = Forest(len(node))
            by: dict[int, list[int]] = {}
            for k, x in enumerate(sketch):
                by.setdefault(len(x), []).append(k)
            several = len(np.unique(part)) > 1
            for long, own in by.items():
                for short, other in by.items():
                    if not short <= long <= 2 * short:
                        continue
                    x = np.frombuffer(b"".join(sketch[k] for k in own), np.uint64).reshape(len(own), -1)
                    y = np.frombuffer(b"".join(sketch[k] for k in other), np.uint64).reshape(len(other), -1)
                    if long > short:
                        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                    mine, theirs = np.array(own), np.array(other)
                    for i in range(len(own)):
                        apart = np.bitwise_count(y ^ x[i]).sum(1, dtype=np.int64)
                        both = size[theirs] + size[mine[i]]
                        near = (100 + percent) * apart <= (100 - percent) * both
                        if several:  # pairs within a block meet elsewhere
                            near &= part[theirs] != part[mine[i]]
                        for j in theirs[near].tolist():
                            forest.join(int(mine[i]), j)
            to = [int(node[forest.find(k)]) for k in range(len(node))]
            yield pa.record_batch([pa.array(node), pa.array(to, pa.int64())], schema=schema)

    return run


def _long_runs(runs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Close pairs among many sets that share an n-gram, as edges of spanning forests; runs: gram, node.

    A run is dealt to blocks, and every two blocks meet in a task of their own.
    """
    sizes = runs.groupBy("gram").agg(F.ceil(F.count("*") / RUN_BLOCK).cast("int").alias("blocks"))
    rows = runs.join(sizes, "gram").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("other", other).select(
        F.xxhash64("gram", F.least("part", "other"), F.greatest("part", "other")).alias("grp"), "node", "part"
    )
    met = dealt.join(sketches, "node").select("grp", "node", "part", "n", "sketch").repartition("grp").sortWithinPartitions("grp")
    return map_batches(met, _compare_runs(percent), "a long, b long").where("a <> b").distinct()


# --- trie join --------------------------------------------------------------------------------------------------------------


class _Trie:
    """Sets of ranked n-grams, each an ascending sequence; a node holds the run of ranks that its sets share next."""

    __slots__ = ("run", "depth", "children", "ends", "least", "most")

    def __init__(self, run: np.ndarray, depth: int):
        self.run, self.depth, self.children, self.ends = run, depth, [], []
        self.least, self.most = 1 << 60, 0


def build_trie(ranked: list[np.ndarray]) -> _Trie:
    """Trie over the sequences; depth is the length of the common beginning including the node's own run."""
    order = sorted(range(len(ranked)), key=lambda i: ranked[i].astype(">u4").tobytes())
    root = _Trie(np.zeros(0, np.int64), 0)
    path, last = [root], None
    for i in order:
        seq = ranked[i]
        common = 0
        if last is not None:
            m = min(len(last), len(seq))
            differ = np.flatnonzero(last[:m] != seq[:m])
            common = int(differ[0]) if len(differ) else m
        while path[-1].depth > common:
            node = path[-1]
            above = path[-2].depth
            if above >= common:
                path.pop()
                continue
            # The new sequence leaves inside this run: split it.
            head = _Trie(node.run[: common - above], common)
            node.run = node.run[common - above :]
            path[-2].children[-1] = head
            head.children.append(node)
            path[-1] = head
        if len(seq) > common:
            node = _Trie(seq[common:], len(seq))
            path[-1].children.append(node)
            path.append(node)
        path[-1].ends.append(i)
        last = seq
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            stack.extend((c, False) for c in node.children)
            continue
        for c in node.children:
            node.least, node.most = min(node.least, c.least), max(node.most, c.most)
        if node.ends:
            node.least, node.most = min(node.least, node.depth), max(node.most, node.depth)
    return root


class Forest:
    """Union of small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def trie_links(sets: list[np.ndarray], percent: int, known: Forest | None = None) -> Forest:
    """Components of the sets under links of at least percent overlap, found by walks through their trie.

    known: sets that are already known to be connected; they need no comparison.
    """
    forest = known or Forest(len(sets))
    grams, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, -counts))] = np.arange(len(grams))
    ends = np.cumsum([len(s) for s in sets])
    ranked = [np.sort(rank[where[e - len(s) : e]]) for s, e in zip(sets, ends.tolist())]
    root = build_trie(ranked)
    mark = np.zeros(len(grams), np.int64)
    for i, seq in enumerate(ranked):
        size = len(seq)
        mark[seq] = 1
        stack = [(c, 0, 0) for c in root.children]
        while stack:
            node, above, shared = stack.pop()
            if not node.children and all(forest.find(j) == forest.find(i) for j in node.ends):
                continue
            shared += int(mark[node.run].sum())
            for j in node.ends:
                if j != i and (100 + percent) * shared >= percent * (size + node.depth):
                    forest.join(i, j)
            # What can still be shared: n-grams of the probe behind this run, and no more than the longest set below has.
            left = size - int(np.searchsorted(seq, node.run[-1], "right"))
            best = shared + min(left, node.most - node.depth)
            if (100 + percent) * best >= percent * (size + node.least):
                stack.extend((c, node.depth, shared) for c in node.children)
        mark[seq] = 0
    return forest


def _join_groups(n: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "grp"):
            nodes, labels, sets = [], [], []
            seen: set[int] = set()
            for batch in table.to_batches():
                want, label = batch.column("node").to_pylist(), batch.column("label").to_pylist()
                buf, offs = kernel.flat(batch.column("text"))
                for k, grams in enumerate(gram_sets(buf, offs, n)):
                    if want[k] in seen or set_node(grams) != want[k]:  # an id that stands for several texts
                        continue
                    seen.add(want[k])
                    nodes.append(want[k])
                    labels.append(label[k])
                    sets.append(grams)
            if len(nodes) < 2:
                continue
            forest, first = Forest(len(nodes)), {}
            for k, label in enumerate(labels):
                if label is not None:
                    forest.join(k, first.setdefault(label, k))
            trie_links(sets, percent, forest)
            to = [nodes[forest.find(k)] for k in range(len(nodes))]
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(to, pa.int64())], schema=schema)

    return run


def _linked(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges within groups; members: node, doc_id, label, grp."""
    rows = docs.join(members, "doc_id").select("grp", "node", "label", F.col("text").cast("binary").alias("text"))
    rows = rows.repartition("grp").sortWithinPartitions("grp")
    return map_batches(rows, _join_groups(n, percent), "a long, b long").where("a <> b")


def _blocks(members: DataFrame, by: list[str]) -> DataFrame:
    """Deal the members of each group to blocks of bounded size."""
    sizes = members.groupBy(*by).agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks")
    )
    return members.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def gram_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Documents with the size of their n-gram set and the component they belong to.

    docs: doc_id long, text string; other columns are left out. Two documents link when 100 * shared n-grams >= percent * union.
    Returns doc_id, n_grams, node (a name of the set, null without words) and component (the smallest doc_id reachable by links),
    one row per input row. Null and empty texts have no set, n_grams 0 and only themselves. Rows without doc_id link with nothing
    and have no component. Repeated rows are copies; an id with several texts connects what these texts link to only through
    their own sets. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    frequent = spark.sparkContext.broadcast(frequent_grams(docs, n))
    described = stored(
        map_batches(with_bytes(docs, "doc_id"), _describe(n, percent, frequent), "doc_id long, n long, node long, sketch binary, grams array<long>"),
        "gram-sets",
    )
    nodes = described.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))

    rows = described.where("grams is not null").select(F.explode("grams").alias("gram"), "node", "n")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    met = rows.repartition("gram").sortWithinPartitions("gram", "node").mapInArrow(_meet(percent), "a long, b long, long_run boolean")
    met = stored(met.distinct(), "gram-pairs")
    sketches = described.where("sketch is not null").select("node", "n", "sketch").dropDuplicates(["node"])
    pairs = (
        met.where("not long_run")
        .join(sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    )
    # Stored, as the next step runs in Python too: two in one stage keep twice the Python workers on every executor.
    near = stored(map_batches(pairs.select("a", "b", "na", "nb", "sa", "sb"), _close(percent), "a long, b long"), "gram-near")
    runs = met.where("long_run").select(F.col("a").alias("gram"), F.col("b").alias("node"))
    families = components(near.unionByName(_long_runs(runs, sketches, percent)), "gram-families")

    members = nodes.join(families.withColumnRenamed("root", "family"), "node")
    members = stored(_blocks(members, ["family"]), "gram-members")
    label = F.lit(None).cast("long").alias("label")
    first = members.select("node", "doc_id", label, F.xxhash64("family", "block").alias("grp"))
    links = stored(_linked(docs, first, n, percent), "gram-links")

    wide = members.where("blocks > 1")
    if not wide.isEmpty():
        # A set lies in one block, so its component there is its label.
        found = _relabelled(wide.drop("blocks", "block").withColumn("label", F.col("node")), links)
        across = stored(_linked(docs, _representatives(found), n, percent), "gram-links-representatives")
        found = stored(_split(_relabelled(found, across)), "gram-split")
        links = links.unionByName(across)
        if not found.isEmpty():
            links = links.unionByName(stored(_linked(docs, _block_pairs(found), n, percent), "gram-links-blocks"))

    joined = components(links, "gram-components")
    named = nodes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    of_node = named.join(least, "root").select("node", "component")
    return (
        described.select("doc_id", F.col("n").alias("n_grams"), "node")
        .join(of_node, "node", "left")
        .select("doc_id", "n_grams", "node", F.coalesce("component", "doc_id").alias("component"))
    )


def _relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members whose label was linked to a smaller one take that; links: a (a label), b."""
    new = links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "label")
    return members.join(new, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def _split(members: DataFrame) -> DataFrame:
    """Members of families that still have several labels."""
    spread = members.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return members.join(spread.select("family"), "family")


def _representatives(found: DataFrame) -> DataFrame:
    """One set of each component, in blocks of its family: most copies of a large family connect through these."""
    reps = found.groupBy("family", "label").agg(F.min_by(F.struct("node", "doc_id", "n"), F.col("node") != F.col("label")).alias("r")).select("family", "label", "r.*")
    return _blocks(reps, ["family"]).select("node", "doc_id", "label", F.xxhash64("family", "block", F.lit("r")).alias("grp"))


def _block_pairs(found: DataFrame) -> DataFrame:
    """Every pair of blocks that can hold sets of different components. A family's main component has blocks of its own."""
    sizes = found.groupBy("family", "label").agg(F.count("*").alias("size"))
    main = sizes.groupBy("family").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    parts = found.join(main, "family").withColumn("main", F.col("label") == F.col("main"))
    parts = _blocks(parts, ["family", "main"])
    counts = parts.groupBy("family").agg(
        F.coalesce(F.max(F.when(F.col("main"), F.col("blocks"))), F.lit(0)).alias("m"),
        F.coalesce(F.max(F.when(~F.col("main"), F.col("blocks"))), F.lit(0)).alias("r"),
    )
    other = F.when(F.col("main"), F.sequence(F.lit(0), F.col("r") - 1)).otherwise(F.sequence(F.lit(0), F.col("m") + F.col("r") - 1))
    own = F.when(F.col("main"), F.col("r") + F.col("block")).otherwise(F.col("block"))
    dealt = parts.join(counts, "family").withColumn("own", own).withColumn("other", F.explode(other))
    pair = F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other"), F.lit("p"))
    return dealt.select("node", "doc_id", "label", pair.alias("grp"))


def first_of_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of every component the one of smallest doc_id stays, with all columns.

    Rows repeated with equal id and text become one; rows without doc_id and texts without words all stay.
    """
    found = gram_components(docs, n, percent)
    stay = found.where("doc_id = component").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(stay, "doc_id", "left_semi")
    copies = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    once = named.select(F.struct("*").alias("row"), copies.alias("nth")).where("nth = 1").select("row.*")
    return once.unionByName(docs.where("doc_id is null"))
