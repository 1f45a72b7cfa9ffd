"""Removal of repeated byte strings by column-wise construction of suffix orders.

A byte goes if a LENGTH-byte string that covers it also starts anywhere else.

1. Anchors. Of every LENGTH-byte string the GRAM-byte gram of smallest hash is an
   anchor: equal strings hold equal anchors at equal offsets, so repeated
   strings meet at an anchor. Anchors that occur once are dropped.
2. Contexts. The bytes that strings over an anchor can reach, LENGTH - GRAM to
   the left and LENGTH to the right, are the anchor's context. Contexts that
   occur twice are removed whole; they stay as one string each.
3. Columns. The distinct contexts of one anchor are a collection of strings
   aligned at the anchor. From the last column to the first, one symbol of each
   string is inserted a round: the order of the suffixes is updated by a stable
   sort on the new symbols (the collection's Burrows-Wheeler column), the common
   prefixes of neighbours by range minima over the old ones. A suffix whose
   common prefix with a neighbour reaches LENGTH starts a repeated string. Rounds
   need only the column before; the symbols come as one sequential pass over
   sorted shuffle files. (One order over all suffixes of all documents would
   take as many rounds over all data as the longest document has bytes.)
4. Large groups. A group of more than GROUP contexts is halved by the column in
   which its strings start: those of either half have more bytes in common than
   the anchor, by which they are regrouped, again and again until each group is
   small enough or its strings start in one column and are equal. So no group has
   to fit into one task, and a collision of group keys only makes a group larger.

Defined cases: null and empty texts have 0 bytes; a null doc_id is an id like
others, and rows of equal doc_id are texts of their own; texts of fewer than LENGTH bytes
lose nothing; repeated rows and equal texts repeat each other; further columns
are ignored; an empty table gives an empty result. Strings are compared byte by
byte; copies of whole texts are told by 128 bits of hashes, spans go back to
their texts by 64, equal contexts are told by two hashes (of their anchor and of
themselves).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgauge.llm.common import text_batches, written

LENGTH, GRAM, GROUP = 200, 32, 20_000
LEFT = LENGTH - GRAM
#: Distinct texts that a task remembers, so that it sends the anchors of each once (more are only sent again).
SEEN = 500_000
#: Cells of a block of contexts in a task.
BLOCK_CELLS = 4_000_000

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
A, B, HALF = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD), np.uint64(32)
BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
CHUNK = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> HALF)) * A
    return (x ^ (x >> HALF)) * B


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, anchor hashes and context hashes of a text's anchors."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = BYTE[np.frombuffer(data, np.uint8)]
    h, base = c, BASE
    for size in (1, 2, 4, 8, 16):
        h = h[:-size] * np.uint64(base) + h[size:]
        base = base * base % (1 << 64)
    h = mixed(h)
    w = LEFT + 1
    low = sliding(h, w, np.minimum)
    # a gram is an anchor if it is the smallest of some string that holds it
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(sliding(padded, w, np.maximum) == h)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(c * powers(BASE, n)[:-1], out=sums[1:])
    a, b = np.maximum(at - LEFT, 0), np.minimum(at + LENGTH, n)
    context = (sums[b] - sums[a]) * powers(INVERSE, n)[a]
    context = mixed(context + (at - a).astype(np.uint64) * A + (b - at).astype(np.uint64) * B)
    return at, h[at].view(np.int64), context.view(np.int64)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> anchor, context, text_key, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, texts in text_batches(batches):
            cols: list[tuple] = []
            for key, text in zip(part.column(part.schema.get_field_index("text_key")).to_pylist(), texts, strict=True):
                if key in seen:
                    continue
                seen.add(key)
                at, h, c = anchors(text.encode("utf-8", "surrogatepass"))
                cols.append((h, c, np.full(len(at), key, np.int64), at))
            if len(seen) > SEEN:
                seen.clear()
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*cols, strict=True)], ["anchor", "context", "text_key", "pos"])

    return docs.select(F.xxhash64("text").alias("text_key"), "text").where(F.octet_length("text") >= LENGTH).mapInArrow(run, "anchor long, context long, text_key long, pos long")


def repeated_starts(cells: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each string (row) and column 0..LEFT: does a LENGTH-byte string that starts there start in another row of its group too?

    cells: symbols by row and column, -1 outside the text. Rows of a group are adjacent.
    """
    n, width = cells.shape
    out = np.zeros((n, LEFT + 1), bool)
    order = np.arange(n)
    common = np.zeros(n, np.int32)  # common prefix of each place with the one before, of suffixes from this column on
    edge = np.ones(n, bool)
    edge[1:] = group[1:] != group[:-1]
    for column in range(width - 1, -1, -1):
        symbol = cells[order, column].astype(np.int64)
        key = group[order] * 258 + symbol + 1
        by = np.argsort(key, kind="stable")
        new, sorted_key, sorted_symbol = order[by], key[by], symbol[by]
        fresh = np.zeros(n, np.int32)
        same = np.flatnonzero((sorted_key[1:] == sorted_key[:-1]) & (sorted_symbol[1:] >= 0)) + 1
        if len(same):
            # between neighbours of equal symbol: the least common prefix on the way from one's old place to the other's
            bounds = np.stack([by[same - 1] + 1, by[same] + 1], 1).ravel()
            fresh[same] = np.minimum.reduceat(np.append(common, 0), bounds)[::2] + 1
        order, common = new, fresh
        if column <= LEFT:
            long = common >= LENGTH
            hit = long.copy()
            hit[:-1] |= long[1:]
            out[order[hit], column] = True
    return out


def context_cells(contexts: list[bytes], lefts: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Symbols by column, -1 outside the context and outside of what strings starting in columns [low, high] cover."""
    cells = np.full((len(contexts), LEFT + LENGTH), -1, np.int16)
    for i, (c, left, low, high) in enumerate(zip(contexts, lefts.tolist(), lows.tolist(), highs.tolist(), strict=True)):
        first = LEFT - left
        a, b = max(first, low), min(first + len(c), high + LENGTH)
        if a < b:
            cells[i, a:b] = np.frombuffer(c, np.uint8)[a - first : b - first]
    return cells


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, past) byte of each maximal run of repeated strings, relative to the anchor."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return [(int(a) - LEFT, int(b) - 1 - LEFT + LENGTH) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def column_wise(contexts: DataFrame) -> DataFrame:
    """(g, anchor, context, left, low, high, bytes) -> (anchor, context, spans), for contexts with a repeated string; groups by g."""
    spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def solve(g: np.ndarray, anchor: np.ndarray, context: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
        new = np.ones(len(g), bool)  # a context that repeated rows brought twice counts once
        new[1:] = (g[1:] != g[:-1]) | (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]) | (low[1:] != low[:-1])
        g, anchor, context, left, low, high = (x[new] for x in (g, anchor, context, left, low, high))
        _, group = np.unique(g, return_inverse=True)
        found = repeated_starts(context_cells([d for d, n in zip(data, new, strict=True) if n], left, low, high), group)
        hit = np.flatnonzero(found.any(1))
        return pa.RecordBatch.from_arrays([pa.array(anchor[hit]), pa.array(context[hit]), pa.array([[{"a": a, "b": b} for a, b in spans_of(found[i])] for i in hit], spans)], ["anchor", "context", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(7)]
        limit = BLOCK_CELLS // (LEFT + LENGTH)
        for b in batches:
            for start in range(0, b.num_rows, limit):
                for k, c in zip(held, b.slice(start, limit).columns, strict=True):
                    k += c.to_pylist()
                if len(held[0]) >= limit:  # whole groups only; the last one may go on
                    cut = len(held[0])
                    while cut and held[0][cut - 1] == held[0][-1]:
                        cut -= 1
                    if cut:
                        yield solve(*[np.asarray(k[:cut], np.int64) for k in held[:6]], held[6][:cut])
                        held = [k[cut:] for k in held]
        if held[0]:
            yield solve(*[np.asarray(k, np.int64) for k in held[:6]], held[6])

    order = ["g", "anchor", "context", "low"]
    parts = contexts.repartition("g").sortWithinPartitions(*order).select("g", "anchor", "context", "left", "low", "high", "bytes")
    return parts.mapInArrow(run, "anchor long, context long, spans array<struct<a:int,b:int>>")


def halved(contexts: DataFrame) -> DataFrame:
    """Groups by strings that start in the lower or the upper half of the columns: regrouped by all bytes that such strings have in common, with the new sizes."""
    mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("low").alias("low"), mid.alias("high")), F.struct((mid + 1).alias("low"), F.col("high").alias("high"))))
    c = contexts.select("anchor", "context", "left", "bytes", half.alias("h")).select("anchor", "context", "left", "bytes", "h.low", "h.high")
    first = F.lit(LEFT) - F.col("left")  # the column of the first byte
    starts = F.least(F.col("high"), first + F.octet_length("bytes") - LENGTH) >= F.greatest(F.col("low"), first)
    common = F.substring("bytes", F.col("high") - first + 1, F.col("low") + LENGTH - F.col("high"))
    c = c.where(starts).withColumn("g", F.xxhash64("anchor", "low", "high", common))
    return c.join(c.groupBy("g").agg(F.count("*").alias("size")).where("size > 1"), "g")


def in_groups(strings: DataFrame) -> DataFrame:
    """(anchor, context, left, bytes, size) -> (anchor, context, spans) through groups of at most GROUP contexts, or of equal strings."""
    rows = strings.withColumns({"g": F.col("anchor"), "low": F.lit(0), "high": F.lit(LEFT)})
    parts = [column_wise(rows.where(F.col("size") <= GROUP))]
    large = rows.where(F.col("size") > GROUP)
    while not large.isEmpty():
        halves = written(halved(large))
        parts.append(column_wise(halves.where((F.col("size") <= GROUP) & (F.col("low") < F.col("high")))))
        # All strings of such a group start in one column: those whose bytes another context has are repeated.
        one = halves.where("low = high").withColumn("string", F.substring("bytes", F.col("low") - LEFT + F.col("left") + 1, F.lit(LENGTH)))
        twice = one.groupBy("g", "low", "string").agg(F.min("context").alias("m"), F.max("context").alias("n")).where("m <> n").select("g", "low", "string")
        span = F.array(F.struct((F.col("low") - LEFT).alias("a"), (F.col("low") - LEFT + LENGTH).alias("b")))
        parts.append(one.join(twice, ["g", "low", "string"]).select("anchor", "context", span.alias("spans")))
        large = halves.where((F.col("size") > GROUP) & (F.col("low") < F.col("high")))
    return reduce(DataFrame.unionByName, parts)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """text_key -> spans [a, b) of bytes that repeated strings cover (they may overlap, and reach past the text's ends)."""
    rows = anchor_rows(docs)
    place = F.xxhash64("text_key", "pos")
    often = rows.groupBy("anchor").agg(F.min(place).alias("m"), F.max(place).alias("n")).where("m <> n").select("anchor")
    some = written(rows.join(often, "anchor"))
    contexts = some.groupBy("anchor", "context").agg(F.min(place).alias("m"), F.max(place).alias("n"), F.min(F.struct("text_key", "pos")).alias("at"))
    contexts = written(contexts.select("anchor", "context", (F.col("m") != F.col("n")).alias("often"), "at"))
    groups = contexts.groupBy("anchor").agg(F.count("*").alias("size")).where("size > 1")
    # Bytes of one occurrence of each context that has others beside it.
    wanted = contexts.join(groups, "anchor").groupBy("at.text_key").agg(F.collect_list(F.struct("anchor", "context", "at.pos", "size")).alias("wanted"))
    # One row of each text is read, found by id and text together (a null id is an id like others), so many rows of one id don't meet.
    row = lambda key: F.xxhash64("doc_id", key).alias("row")
    one = docs.select("doc_id", F.xxhash64("text").alias("text_key")).groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).select("text_key", row("text_key"))
    texts = docs.select(row(F.xxhash64("text")), "text").join(wanted.join(one, "text_key"), "row").where(F.xxhash64("text") == F.col("text_key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ts in text_batches(batches):
            for text, want in zip(ts, part.column(part.schema.get_field_index("wanted")).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for k in range(0, len(want), 20_000):
                    some_ = want[k : k + 20_000]
                    lefts = [min(LEFT, w["pos"]) for w in some_]
                    yield pa.RecordBatch.from_arrays([pa.array([w["anchor"] for w in some_], pa.int64()), pa.array([w["context"] for w in some_], pa.int64()), pa.array(lefts, pa.int32()), pa.array([data[w["pos"] - left : w["pos"] + LENGTH] for w, left in zip(some_, lefts, strict=True)], pa.binary()), pa.array([w["size"] for w in some_], pa.int64())], ["anchor", "context", "left", "bytes", "size"])

    strings = written(texts.select("text", "wanted").mapInArrow(cut, "anchor long, context long, left int, bytes binary, size long"))
    partly = in_groups(strings)
    whole = F.array(F.struct(F.lit(-LEFT).alias("a"), F.lit(LENGTH).alias("b")))
    spans = contexts.where("often").select("anchor", "context", whole.alias("spans")).unionByName(partly.join(contexts.where("often"), ["anchor", "context"], "left_anti"))
    found = some.distinct().join(spans, ["anchor", "context"]).select("text_key", F.transform("spans", lambda s: F.struct((F.col("pos") + s["a"]).alias("a"), (F.col("pos") + s["b"]).alias("b"))).alias("spans"))
    return found.groupBy("text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def removed_runs(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of the covered bytes; a clipped span of fewer than LENGTH bytes holds no string."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, a), min(n, b)) for a, b in spans):
        if b - a < LENGTH:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept, spans]."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    twin = F.xxhash64(F.lit(1), "text")  # with the key, 128 bits tell copies
    twice = docs.select(F.xxhash64("text").alias("text_key"), twin.alias("twin")).groupBy("text_key", "twin").agg(F.count("*").alias("copies")).where("copies > 1")
    twice = twice.groupBy("text_key").agg(F.collect_list("twin").alias("twins"))  # one, but for unlike texts of one key
    joined = keyed.join(repeated_spans(docs).join(twice, "text_key", "full"), "text_key", "left")
    joined = joined.select("doc_id", "text", "spans", F.coalesce(F.array_contains("twins", twin), F.lit(False)).alias("copied"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    more = ", kept binary, spans array<struct<a:bigint,b:bigint>>" if with_bytes else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches):
            col = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
            rows = []
            for text, spans, copied in zip(texts, col("spans").to_pylist(), col("copied").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                n = len(data)
                runs = removed_runs([(0, n)] if copied else [(s["a"], s["b"]) for s in spans or ()], n)
                ends = [0, *(x for r in runs for x in r), n]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"a": a, "b": b} for a, b in runs]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            cols = [pa.array(c, k) for c, k in list(zip(zip(*rows, strict=True), kinds, strict=True))[: 6 if with_bytes else 4]]
            yield pa.RecordBatch.from_arrays([col("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: len(cols) + 1])

    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
