"""MinHash near-dedup with an LSH forest.

A document's set is that of its distinct 5-word shingles. Every distinct set is
a node with TREES short signatures. For each tree the nodes are put in the order
of their signatures (one range-partitioned sort for all trees), and neighbours
in that order that share a prefix of at least MIN_DEPTH values are candidates.
The depth adapts to the region: a prefix shared by at most NEAR + 1 nodes makes
all of them candidates of one another; in a denser region only longer prefixes
do, and where even the longest is shared by more, each node meets the next in
the order and the region's centre: that node which stands in most such regions
over all trees. (Copies of one original that were edited apart share its
prefixes more often than one another's, so the original is the centre wherever
it stands, and a region costs one comparison a member.)

What a dense region may hold beyond that is made up for in a last pass: of each
region of MIN_DEPTH values with more than NEAR + 1 nodes, all those that are not
yet in one component are compared with one another on their full sets, in blocks
of bounded numbers and shingles that give no more rows than they take. Before that,
nodes go that can't be linked to another component: two linked sets share one of
the rarest quarter of either's shingles, so a node none of whose rarest shingles
another component has among its own is left out. Texts that share boilerplate only
are thus never sent. A region of one component costs nothing here; in others the
blocks of the largest component don't meet one another. So a pair is compared if it shares MIN_DEPTH values in any tree, however
crowded.

The other candidates are confirmed on their full sets in two rounds: first one
for each node or pair of components (a forest), then those that are still in
different components. A group of thousands of near copies so costs about one
comparison a member.

Defined cases: null or empty texts and texts without words have the empty set
and no links; fewer than 5 words are one shingle; a null doc_id is kept only if
no row of its group has an id; rows of equal doc_id are a row each and may have different sets, each of them linked for itself; equal
sets are linked; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgauge.llm.common import connected_components, text_batches, written

SHINGLE, SIMILARITY = 5, 75
TREES, MIN_DEPTH, MAX_DEPTH, NEAR = 24, 3, 5, 8
#: Marks the rows of regions whose longest, or shortest, prefix is shared by more than NEAR others.
DENSE, CROWDED = 2, 3
#: Nodes and shingles of a block in a crowded region, and columns of a matrix of shingles.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1_000_000, 4096
#: Classes of shingles whose frequencies put them in order, rare ones first.
CLASSES = 1 << 18
#: Comparisons with one node that a task makes; more are split.
HUB = 256

_rng = np.random.default_rng(20240131)
FACTOR = _rng.integers(1, 1 << 32, TREES * MAX_DEPTH, dtype=np.uint32) | np.uint32(1)
OFFSET = _rng.integers(0, 1 << 32, TREES * MAX_DEPTH, dtype=np.uint32)
PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
MIX, HALF = np.uint64(0xC4CEB9FE1A85EC53), np.uint64(32)


class Shingler:
    """Texts -> sorted distinct 64-bit shingle hashes; word hashes are kept up to a bound."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known, digest = self.words, xxhash.xxh3_64_intdigest
        if len(known) > 300_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(h) < SHINGLE:
            return np.asarray([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        n = len(h) - SHINGLE + 1
        out = np.zeros(n, np.uint64)
        for i, p in enumerate(PLACE):
            x = (h[i : i + n] ^ (h[i : i + n] >> HALF)) * p
            out += x ^ (x >> HALF)
            out *= MIX
        out ^= out >> HALF
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> HALF).astype(np.uint32) ^ shingles.astype(np.uint32)
    low = np.full(len(FACTOR), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        part = x[np.newaxis, i : i + 1024] * FACTOR[:, np.newaxis]
        part += OFFSET[:, np.newaxis]
        np.minimum(low, part.min(1), out=low)
    return low


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, h1 (a 64-bit hash of the set, which names its node), its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler()
        for part, texts in text_batches(batches):
            n, h1, sig = [], [], []
            for t in texts:
                s = of(t)
                n.append(len(s))
                h1.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("text_key")), pa.array(n, pa.int64()), pa.array(np.asarray(h1, np.uint64).view(np.int64)), pa.array(sig, pa.binary())], ["doc_id", "text_key", "n_shingles", "h1", "sig"])

    return keyed(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, h1 long, sig binary")


def tree_keys(sets: DataFrame) -> DataFrame:
    """sets(node, sig) -> a row for each tree: k1 (tree and MIN_DEPTH values), k2 (the deeper values), node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nodes = np.asarray(b.column(0))
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, TREES, MAX_DEPTH).astype(np.uint64)
            k1 = np.zeros(sig.shape[:2], np.uint64)
            for d in range(MIN_DEPTH):
                k1 = (k1 ^ sig[:, :, d]) * PLACE[d]
                k1 ^= k1 >> HALF
            k1 = (k1 >> np.uint64(8)) | (np.arange(TREES, dtype=np.uint64) << np.uint64(56))[np.newaxis]
            k2 = (sig[:, :, MIN_DEPTH] << HALF) | sig[:, :, MIN_DEPTH + 1]
            yield pa.RecordBatch.from_arrays([pa.array(k1.ravel().view(np.int64)), pa.array(k2.ravel().view(np.int64)), pa.array(np.repeat(nodes, TREES))], ["k1", "k2", "node"])

    return sets.select("node", "sig").mapInArrow(run, "k1 long, k2 long, node long")


def runs(*keys: np.ndarray) -> np.ndarray:
    """Length of the run of equal keys that each row stands in."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return np.repeat(np.diff(np.append(at, len(new))), np.diff(np.append(at, len(new))))


def neighbours(k1: np.ndarray, k2: np.ndarray, node: np.ndarray, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of which the later row isn't among the first `old`: by prefixes that few share, and next in order.

    Then the rows whose longest prefix is shared by more, and those whose shortest
    is, or may be, as the region goes on before or after these rows.
    """
    deeper = k2.view(np.uint64) >> HALF
    few3, few4, few5 = (runs(*k) <= NEAR + 1 for k in ((k1,), (k1, deeper), (k1, k2)))
    left, right = [], []
    for j in range(1, NEAR + 1):
        if j >= len(k1):
            break
        same = k1[:-j] == k1[j:]
        if j > 1:
            same &= few3[j:] | (few4[j:] & (deeper[:-j] == deeper[j:])) | (few5[j:] & (k2[:-j] == k2[j:]))
        at = np.flatnonzero(same)
        at = at[at + j >= old]
        left.append(node[at])
        right.append(node[at + j])
    crowded = ~few3 | (k1 == k1[0]) | (k1 == k1[-1])
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
    return np.minimum(a, b), np.maximum(a, b), np.flatnonzero(~few5), np.flatnonzero(crowded)


def candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sets(node, sig) -> pairs a < b with their weight (how many trees brought the pair up), and (k1, node) of regions that are or may be crowded."""
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["k1", "k2", "node"]
    names = ["a", "b", "pid", "side", "k1", "k2"]

    def batch_of(a: np.ndarray, b: np.ndarray, pid: int | None = None, side: int | None = None, k1: np.ndarray | None = None, k2: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(a)
        keys = [pa.nulls(n, pa.int64()) if k is None else pa.array(k, pa.int64()) for k in (k1, k2)]
        marks = [pa.nulls(n, pa.int32()) if x is None else pa.array(np.full(n, x, np.int32)) for x in (pid, side)]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *marks, *keys], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, head = TaskContext.get().partitionId(), 0
        tail = [np.zeros(0, np.int64)] * 3
        for b in batches:
            if not b.num_rows:
                continue
            rows = [np.asarray(c) for c in b.columns]
            if head < NEAR:  # the first rows also meet the last of the partition before
                few = [r[: NEAR - head] for r in rows]
                yield batch_of(few[2], few[2], pid, 0, few[0])
                head += len(few[0])
            old = len(tail[0])
            rows = [np.concatenate(x) for x in zip(tail, rows, strict=True)]
            a, b, dense, crowded = neighbours(*rows, old)
            yield batch_of(a, b)
            k1, k2, node = rows
            yield batch_of(node[dense], node[dense], None, DENSE, k1[dense], k2[dense])
            yield batch_of(node[crowded], node[crowded], None, CROWDED, k1[crowded])
            tail = [r[-NEAR:] for r in rows]
        if len(tail[0]):
            yield batch_of(tail[2], tail[2], pid, 1, tail[0])

    keys = tree_keys(sets).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = written(keys.mapInArrow(walk, "a long, b long, pid int, side int, k1 long, k2 long"))
    last = found.where("side = 1").select((F.col("pid") + 1).alias("pid"), "k1", "a")
    first = found.where("side = 0").select("pid", "k1", F.col("b").alias("b"))
    across = last.join(first, ["pid", "k1"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # A node has a row for each tree at most; some rows come twice, where a region goes on in the next batch.
    dense = found.where(f"side = {DENSE}").groupBy(F.col("a").alias("node")).agg(F.collect_set(F.struct("k1", "k2")).alias("places"))
    dense = dense.select("node", F.size("places").alias("n"), F.explode("places").alias("place"))
    centre = dense.groupBy("place").agg(F.max(F.struct("n", "node")).alias("m")).select("place", F.col("m.node").alias("centre"))
    around = dense.join(centre, "place").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    pairs = found.where("side is null").select("a", "b").unionByName(across).unionByName(around).groupBy("a", "b").agg(F.count("*").alias("weight"))
    return pairs, found.where(f"side = {CROWDED}").select("k1", F.col("a").alias("node")).distinct()


def spanning(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Of a matrix of links between rows and columns, those of a spanning forest."""
    rows, cols = [], []
    new_row, new_col = linked.any(1), linked.any(0)
    for i in np.flatnonzero(new_row):
        if not new_row[i]:
            continue
        new_row[i], todo = False, [int(i)]
        while todo:
            r = todo.pop()
            for c in np.flatnonzero(linked[r] & new_col).tolist():
                new_col[c] = False
                more = np.flatnonzero(linked[:, c] & new_row).tolist()
                new_row[more] = False
                rows += [r, *more]
                cols += [c] * (1 + len(more))
                todo += more
    return rows, cols


def in_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: products of 0/1 matrices over the shingles that both sides have."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (left, right))
    both = np.intersect1d(a, b)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right))
    at_a, at_b = (np.searchsorted(both, x) for x in (a, b))
    at_a[at_a == len(both)] = 0
    at_b[at_b == len(both)] = 0
    for start in range(0, len(both), COLUMNS):
        sides = []
        for x, row, at, n in ((a, row_a, at_a, len(left)), (b, row_b, at_b, len(right))):
            m = np.zeros((n, COLUMNS), np.float32)
            i = np.flatnonzero((at >= start) & (at < start + COLUMNS))
            i = i[both[at[i]] == x[i]]
            m[row[i], at[i] - start] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def rarest(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set of which a set that is similar enough has one among its own."""
    order = np.lexsort((shingles, counts[(shingles % np.uint64(CLASSES)).astype(np.int64)]))
    return shingles[order[: len(shingles) - -(-SIMILARITY * len(shingles) // 100) + 1]]


def linkable(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """nodes(node, c), texts(node, text) -> node, n (shingles) of those that share one of their rarest shingles with another component. Only CLASSES sums reach the driver."""
    own = texts.join(nodes, "node")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = Shingler(), np.zeros(CLASSES, np.int64)
        for _, ts in text_batches(batches):
            flat = np.concatenate([np.zeros(0, np.uint64), *map(of, ts)]) % np.uint64(CLASSES)
            total += np.bincount(flat.astype(np.int64), minlength=CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["class", "n"])

    counts = np.zeros(CLASSES, np.int64)
    for r in own.select("text").mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[r["class"]] = r["n"]

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler()
        for part, ts in text_batches(batches):
            sets = [of(t) for t in ts]
            few = [rarest(x, counts).view(np.int64) for x in sets]
            at = np.repeat(np.arange(len(few)), [len(x) for x in few])
            node, c = (part.column(part.schema.get_field_index(k)).take(pa.array(at)) for k in ("node", "c"))
            size = np.asarray([len(x) for x in sets], np.int64)[at]
            yield pa.RecordBatch.from_arrays([node, c, pa.array(size), pa.array(np.concatenate([np.zeros(0, np.int64), *few]))], ["node", "c", "n", "shingle"])

    tokens = written(own.select("node", "c", "text").mapInArrow(rare, "node long, c long, n long, shingle long"))
    shared = tokens.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("shingle")
    return tokens.join(shared, "shingle", "left_semi").select("node", "n").distinct()


def crowded_links(crowd: DataFrame, comp: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between nodes that share a crowded region but no component, on full sets.

    crowd(k1, node), comp(node, component), texts(node, text) -> a < b. The nodes of a
    region are dealt into blocks by hash, the largest component's apart from the
    others; all blocks but two of the largest component's meet. A meeting of two
    blocks gives a spanning forest of its links, so never more rows than went in.
    """
    spark = crowd.sparkSession
    c = crowd.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    several = c.groupBy("k1").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("k1")
    c = written(c.join(several, "k1"))
    if c.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    c = written(c.join(linkable(c.select("node", "c").distinct(), texts), "node"))
    blocks = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    sizes = c.groupBy("k1", "c").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    mixed = sizes.groupBy("k1").agg(F.max(F.struct("size", "c", "shingles")).alias("m"), F.sum("size").alias("size"), F.sum("shingles").alias("every"), F.count("*").alias("components")).where("components > 1")
    mixed = mixed.select("k1", F.col("m.c").alias("top"), blocks(F.col("m.size"), F.col("m.shingles")).alias("nl"), blocks(F.col("size") - F.col("m.size"), F.col("every") - F.col("m.shingles")).alias("nr"))
    rows = written(c.drop("n").join(mixed, "k1"))
    if rows.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    block = F.when(F.col("c") == F.col("top"), F.pmod(F.xxhash64("node"), F.col("nl"))).otherwise(F.col("nl") + F.pmod(F.xxhash64("node"), F.col("nr"))).cast("int")
    other = F.explode(F.when(F.col("block") < F.col("nl"), F.sequence(F.col("nl"), F.col("nl") + F.col("nr") - 1)).otherwise(F.sequence(F.lit(0), F.col("nl") + F.col("nr") - 1))).alias("other")
    met = rows.withColumn("block", block).select("k1", "node", "c", "block", other).select("k1", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "c")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler()
        for part, ts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("node")), pa.array([of(t).tobytes() for t in ts], pa.binary())], ["node", "shingles"])

    shingles = texts.join(rows.select("node").distinct(), "node", "left_semi").mapInArrow(sets, "node long, shingles binary")
    met = met.join(shingles, "node").select("k1", "i", "j", "block", "node", "c", "shingles").repartition("k1", "i", "j").sortWithinPartitions("k1", "i", "j", "block")

    def links_of(i: int, j: int, block: np.ndarray, node: np.ndarray, c: np.ndarray, sets_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        of = [np.frombuffer(x, np.uint64) for x in sets_]
        size = np.asarray([len(x) for x in of], np.float32)
        both = in_common([of[k] for k in left], [of[k] for k in right])
        linked = (100 * both >= SIMILARITY * (size[left][:, None] + size[right][None] - both)) & (c[left][:, None] != c[right][None])
        x, y = spanning(linked)
        return node[left[x]], node[right[y]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        kept: list[bytes] = []

        def solve(cut: int) -> Iterator[pa.RecordBatch]:
            k1, i, j = (x[:cut] for x in held[:3])
            new = np.flatnonzero((k1[1:] != k1[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for s, e in zip([0, *new], [*new, cut], strict=True):
                a, b = links_of(i[s], j[s], *(x[s:e] for x in held[3:]), kept[s:e])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

        for whole in batches:
            for start in range(0, whole.num_rows, 2 * BLOCK):
                b = whole.slice(start, 2 * BLOCK)
                rows_ = [np.asarray(x) for x in b.columns[:6]]
                held = [np.concatenate(x) for x in zip(held, rows_, strict=True)] if held else rows_
                kept += b.column(6).to_pylist()
                last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
                cut = len(last) - int(last.sum())  # whole meetings only; the last one may go on
                if cut:
                    yield from solve(cut)
                    held, kept = [x[cut:] for x in held], kept[cut:]
        if held:
            yield from solve(len(kept))

    return met.mapInArrow(compare, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    A node's text is sent once for each HUB of its partners, ahead of theirs, so a
    hub of many pairs is spread over tasks and its text isn't repeated by pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = Shingler(), np.zeros(0, np.uint64)
        for part, these in text_batches(batches):
            yes = []
            bs = part.column(part.schema.get_field_index("b")).to_pylist()
            for i, (b, t) in enumerate(zip(bs, these, strict=True)):
                s = of(t)
                if b is None:
                    own = s
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                if both and 100 * both >= SIMILARITY * (len(own) + len(s) - both):
                    yes.append(i)
            yield part.select(["a", "b"]).take(pa.array(yes, pa.int64()))

    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).alias("salts"))
    salted = pairs.select("a", "b").join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    left = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    right = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    rows = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(run, "a long, b long")


def joined(comp: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Components comp(node, component) after what the candidates (a, b, weight) confirm; one pair of each two components goes first."""
    of = lambda c, side: c.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    named = lambda p, c: p.join(of(c, "a"), "a", "left").join(of(c, "b"), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")
    first = named(pairs, comp).groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max(F.struct("weight", "a", "b")).alias("m")).select("m.a", "m.b")
    comp = merged(comp, written(confirmed(written(first), texts)))
    return merged(comp, written(confirmed(written(named(pairs, comp).select("a", "b")), texts)))


def merged(comp: DataFrame, links_: DataFrame) -> DataFrame:
    """comp(node, component) with further links (a, b) between nodes."""
    of = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    more = links_.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    higher = written(connected_components(more)).select(F.col("node").alias("component"), F.col("component").alias("top"))
    known = comp.join(higher, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = higher.select(F.col("component").alias("node"), F.col("top").alias("component")).join(comp, "node", "left_anti")
    return written(known.unionByName(alone))


def links(every: DataFrame, docs: DataFrame) -> DataFrame:
    """shingled rows -> node (a set's h1), component over confirmed links."""
    rep = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key")))
    sets = every.where("n_shingles > 0").groupBy(F.col("h1").alias("node")).agg(F.coalesce(rep, F.min(F.struct("doc_id", "text_key"))).alias("at"), F.first("sig").alias("sig"))
    pairs, crowd = candidates(sets)
    pairs, crowd = written(pairs), written(crowd)
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowd.select("node")).distinct()
    # One row of each set has its text fetched: found by id and text together, so copies of one text are spread.
    row = lambda doc_id, key: F.xxhash64(doc_id, key).alias("row")
    place = sets.select("node", row("at.doc_id", "at.text_key")).join(wanted, "node", "left_semi")
    texts = written(keyed(docs).select(row("doc_id", "text_key"), "text").join(place.hint("merge"), "row").select("node", "text").dropDuplicates(["node"]))
    best = written(pairs.groupBy("b").agg(F.max(F.struct("weight", "a")).alias("m")).select("m.a", "b"))
    comp = written(connected_components(confirmed(best, texts)))
    comp = joined(comp, pairs.join(best, ["a", "b"], "left_anti"), texts)
    rest = written(crowded_links(crowd, comp, texts))
    return comp if rest.isEmpty() else merged(comp, rest)


def decided(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> a row for each of its rows: doc_id, text_key, n_shingles, component_id, kept."""
    every = written(shingled(docs))
    comp = written(links(every, docs))
    # Only sets that several rows have, or that are linked, need their component looked up: named by its smallest doc_id.
    groups = every.where("n_shingles > 0").groupBy("h1").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"))
    group = groups.join(comp.withColumnRenamed("node", "h1"), "h1", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "h1"))
    low = group.groupBy("component").agg(F.min("doc").alias("component_id"))
    top = written(group.select("h1", "component").join(low, "component").drop("component"))
    out = every.drop("sig").join(top, "h1", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    return decided(docs).drop("text_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group the rows of the smallest doc_id stay; all columns are kept."""
    gone = decided(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"]), "left_anti")
