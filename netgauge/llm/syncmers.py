"""Document fingerprints from closed syncmers.

A k-mer of characters is an anchor if the smallest of its inner s-mers (by
hash) is its first or its last: a choice that looks at nothing outside the
k-mer, so equal passages get equal anchors wherever they stand. A fingerprint
is the SKETCH anchors of smallest hash, and of a longer text all anchors whose
hash is below PART, with their positions: it grows with the text. Two
fingerprints are compared by the anchors that both have at a consistent shift.

Defined cases: null and empty text have the empty fingerprint; texts without an
anchor (shorter than k) have one anchor, the hash of the whole; two empty
fingerprints are alike (1.0); equal texts have equal fingerprints; rows of
equal doc_id follow one another in the order of their texts' xxhash64; a null
doc_id comes first and may be of any orderable type; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from netgauge.llm.common import text_batches, written

K, S, SKETCH = 16, 8, 64
#: Anchors with a 32-bit hash below this (a sixteenth of all) are in every fingerprint.
PART = 1 << 28
#: Shifts of shared anchors within so many characters of the commonest are one alignment.
SLACK = 32

B1, B2, B3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
SHIFT = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> SHIFT)) * B2
    return (x ^ (x >> SHIFT)) * B3


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all closed syncmers of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(c)
    if n >= K:
        h, base = mixed(c), int(B1)
        for size in (1, 2, 4):
            h = h[:-size] * np.uint64(base) + h[size:]
            base = base * base % (1 << 64)
        s = mixed(h)
        w = K - S + 1
        low, size = s, 1
        while size * 2 <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < w:
            low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
        at = np.flatnonzero((s[: len(low)] == low) | (s[w - 1 :] == low))
        if len(at):
            return at, mixed(h[at] * np.uint64(base) + h[at + S])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.zeros(1, np.int64), np.asarray([whole], np.uint64)


def sketch(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes, positions), by position, of the SKETCH anchors of smallest hash and all below PART; of equal anchors the first counts."""
    at, h = anchors(text)
    h = (h >> SHIFT).astype(np.int64)
    if len(h) > 8 * SKETCH:  # only these can be among the smallest: the bound is the hash of rank 4 * SKETCH
        for rank in (4 * SKETCH, len(h) - 1):
            bound = max(np.partition(h, rank)[rank], PART - 1)
            keep = h <= bound
            if rank == len(h) - 1 or len(np.unique(h[keep])) >= SKETCH:
                at, h = at[keep], h[keep]
                break
    h, first = np.unique(h, return_index=True)
    size = max(SKETCH, int(np.searchsorted(h, PART)))
    h, at = h[:size], at[first][:size]
    order = np.argsort(at, kind="stable")
    return h[order], at[order]


def as_string(fp: tuple[np.ndarray, np.ndarray]) -> str:
    return " ".join(f"{h:08x}@{p}" for h, p in zip(fp[0].tolist(), fp[1].tolist(), strict=True))


def known(h: np.ndarray) -> int:
    """The hash up to which a fingerprint has every anchor of its text."""
    return max(int(h.max()), PART - 1) if len(h) >= SKETCH else 1 << 32


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of anchors in common (Dice, estimated on the hashes that both fingerprints cover) that also agree on one shift."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    bound = min(known(a[0]), known(b[0]))
    low = a[0][i] <= bound
    size = int((a[0] <= bound).sum() + (b[0] <= bound).sum() - low.sum())
    i, j = i[low], j[low]
    if not len(i):
        return 0.0
    shift = np.sort(a[1][i] - b[1][j])
    same = int(np.max(np.searchsorted(shift, shift + SLACK, side="right") - np.arange(len(shift))))
    jaccard = same / size
    return round(2 * jaccard / (1 + jaccard), 6)


def packed(fp: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Hashes and steps between positions, each as four planes of bytes: the steps' upper planes are zeros, which compress away."""
    steps = np.diff(fp[1], prepend=0)
    return b"".join(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in (fp[0], steps))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(2, 4, -1)
    h, steps = (np.ascontiguousarray(x.T).view("<u4").ravel().astype(np.int64) for x in planes)
    return h, np.cumsum(steps)


def against(fp: tuple[np.ndarray, np.ndarray], ep: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, bytes]:
    """What tells ep from fp: a bit for each anchor of fp that ep has too, and ep's others."""
    pair = lambda x: x[0] << 32 | x[1]
    stays, more = np.isin(pair(fp), pair(ep)), ~np.isin(pair(ep), pair(fp))
    return np.packbits(stays).tobytes(), packed((ep[0][more], ep[1][more]))


def restored(fp: tuple[np.ndarray, np.ndarray], stays: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
    kept = np.unpackbits(np.frombuffer(stays, np.uint8), count=len(fp[0])).astype(bool)
    other = unpacked(more)
    h, at = np.concatenate([fp[0][kept], other[0]]), np.concatenate([fp[1][kept], other[1]])
    order = np.argsort(at, kind="stable")
    return h[order], at[order]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to as many of the next text's first (or all)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The rows are range-partitioned and sorted by doc_id once; every task walks
    its rows with the next one in hand. The last row of each task meets the
    first of the next in a second small pass over two rows a partition. Between
    the passes the results are kept packed, an edited fingerprint by what tells
    it from its text's own.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    short = f"doc_id {id_type}, n_chars long, sha binary, fp binary, stays binary, more binary, near_edited double, near_next double"

    def result(doc_id: object, text: str, fp: tuple, following: str, next_fp: tuple) -> tuple:
        e = edited(text, following)
        ep = fp if e == text else sketch(e)
        return doc_id, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest(), packed(fp), *against(fp, ep), likeness(fp, ep), likeness(fp, next_fp)

    def batch_of(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in rows], schema=types)

    id_arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    done = pa.schema(list(zip(names, [id_arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)))
    small = pa.schema([("doc_id", id_arrow), ("n_chars", pa.int64()), *((c, pa.binary()) for c in ("sha", "fp", "stays", "more")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    edge = pa.schema([*small, ("pid", pa.int32()), ("side", pa.int32()), ("text", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last: tuple | None = None
        for part, texts in text_batches(batches):
            rows = []
            for doc_id, text in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), texts, strict=True):
                fp = sketch(text)
                if last is None:
                    rows.append((doc_id, *[None] * 7, pid, 0, text))
                else:
                    rows.append((*result(*last, text, fp), None, None, None))
                last = (doc_id, text, fp)
            yield batch_of(rows, edge)
        if last is not None:
            yield batch_of([(last[0], *[None] * 7, pid, 1, last[1])], edge)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches):
            following = [t or "" for t in part.column(part.schema.get_field_index("following")).to_pylist()]
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            yield batch_of([result(i, t, sketch(t), f, sketch(f)) for i, t, f in zip(ids, texts, following, strict=True)], small)

    def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, n, sha, fp, stays, more, near_edited, near_next in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = unpacked(fp)
                rows.append((doc_id, n, sha.hex(), as_string(own), as_string(restored(own, stays, more)), near_edited, near_next))
            yield batch_of(rows, done)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    rows = written(ordered.mapInArrow(walk, f"{short}, pid int, side int, text string"))
    # Which partition follows which: one narrow row a partition; the texts then meet by that number.
    ends = rows.where("side = 0").select("pid")
    after = ends.withColumn("following", F.coalesce(F.lead("pid").over(Window.orderBy("pid")), F.min("pid").over(Window.partitionBy())))
    first = rows.where("side = 0").select(F.col("pid").alias("following"), F.col("text").alias("following_text"))
    last = rows.where("side = 1").select("pid", "doc_id", "text")
    edges = last.join(after, "pid").join(first, "following").select("doc_id", "text", F.col("following_text").alias("following"))
    return rows.where("side is null").select(*small.names).unionByName(edges.mapInArrow(join, short)).mapInArrow(write_out, out)
