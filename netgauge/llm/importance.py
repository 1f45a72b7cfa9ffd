"""Importance resampling towards a target: documents whose hashed word runs look like the target's are drawn more often.

Features are runs of 1 and 2 words, counted in BUCKETS buckets by CRC-32. A
bucket's gain is the log ratio of its shares in target and corpus; a document's
weight is the mean gain of its features, and the drawn documents are the highest
by weight plus Gumbel noise, which a hash of the id gives.

CRCs. A batch's distinct features are put in the order of their lengths in bytes,
so those of one length are a matrix of bytes; the CRCs of all its rows are
updated a column at a time, and the buckets are scattered back to where the
features stand.

Scale. A task adds up its own counts of the BUCKETS buckets before the shuffle,
and only BUCKETS sums reach the driver, whatever the corpus. The cut-off of the
draw comes from the histogram of the scores, whole numbers within a range that
the gains bound; only the documents at or above it are sorted, by range, and get
their ranks from their partition's offset. Nothing is ordered in one task.

Defined cases: null and empty texts, and texts without words, have no features,
weight 0 and are never drawn; a null doc_id has the noise of the id `null` and
comes after equal scores; rows of equal doc_id are a row each; an empty target or
an empty table works with counts of 0; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgauge.llm.common import ragged, text_batches, written

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Features of more bytes are few and stand alone in their matrix: their CRC is taken in one go.
LONG = 512
#: Cells of a matrix of bytes.
CELLS = 4_000_000

# Letters that are lower-cased, and what a word is made of.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def crc_table() -> np.ndarray:
    """CRC-32 of every byte, from the reversed polynomial."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> np.uint32(1) ^ np.uint32(0xEDB88320), crc >> np.uint32(1))
    return crc


TABLE = crc_table()


def crcs(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of byte strings that follow one another in data, in ascending order of length."""
    out = np.zeros(len(lengths), np.uint32)
    first = np.flatnonzero(np.diff(lengths, prepend=-1))
    at = 0
    for low, high in zip(first.tolist(), [*first[1:].tolist(), len(lengths)], strict=True):
        n = int(lengths[low])
        if n > LONG:
            for i in range(low, high):
                out[i] = zlib.crc32(data[at : at + n])
                at += n
            continue
        step = max(1, CELLS // max(n, 1))
        for start in range(low, high, step):
            rows = min(step, high - start)
            matrix = np.ascontiguousarray(data[at : at + rows * n].reshape(rows, n).T)
            crc = np.full(rows, 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = TABLE[(crc ^ column) & np.uint32(0xFF)] ^ crc >> np.uint32(8)
            out[start : start + rows] = ~crc
            at += rows * n
    return out


def feature_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, text by text; the number of features and of words of each text."""
    codes: dict[str, int] = {" ": 0}
    flat, n_words = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = WORD.findall(t.translate(FOLD))
        n_words[i] = len(words)
        flat.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)))
    word = np.concatenate([np.zeros(0, np.int64), *flat])
    raw = [w.encode("utf-8", "surrogatepass") for w in codes]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    place, data = np.cumsum(size) - size, np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(texts)), n_words)
    n = len(codes)
    feature, of = word, owner
    for k in range(1, RUN):  # a run is named by its words' codes, a digit of base n each
        inside = owner[: len(word) - k] == owner[k:] if len(word) > k else np.zeros(0, bool)
        runs = np.flatnonzero(inside)
        name = word[runs]
        for j in range(1, k + 1):
            name = name * n + word[runs + j]
        feature, of = np.concatenate([feature, name]), np.concatenate([of, owner[runs]])
    distinct, where = np.unique(feature, return_inverse=True)
    # The words of a run, with spaces between; a word alone has 0, no word's code, before it.
    digits, rest = [], distinct
    for _ in range(RUN):
        digits.append(rest % n)
        rest = rest // n
    digits = np.stack(digits[::-1], 1)
    pieces = np.zeros((len(distinct), 2 * RUN - 1), np.int64)
    pieces[:, ::2] = digits
    there = np.ones(pieces.shape, bool)
    there[:, ::2] = digits > 0
    there[:, 1::2] = digits[:, :-1] > 0
    piece_size = np.where(there, size[pieces], 0)
    length = piece_size.sum(1)
    order = np.argsort(length, kind="stable")
    step, bucket = max(1, CELLS // 16), np.zeros(len(distinct), np.int64)
    for start in range(0, len(order), step):
        some = order[start : start + step]
        sizes = piece_size[some].ravel()
        bytes_ = data[ragged(place[pieces[some].ravel()], sizes)]
        bucket[some] = crcs(bytes_, length[some]) % np.uint32(BUCKETS)
    by = np.argsort(of, kind="stable")
    return bucket[where][by], np.bincount(of, minlength=len(texts)).astype(np.int64), n_words


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket: BUCKETS sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, part in text_batches(batches):
            total += np.bincount(feature_buckets(part)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the corpus, both with one more of each bucket."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_features, weight, n_words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches):
            bucket, n, words = feature_buckets(texts)
            sums = np.concatenate([[0], np.cumsum(gain[bucket])])[np.concatenate([[0], np.cumsum(n)])]
            mean = np.diff(sums) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(n), pa.array(mean), pa.array(words)], ["doc_id", "n_features", "weight", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_features long, weight long, n_words long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise, in thousandths, of a hash of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, percent: int) -> DataFrame:
    """scored(doc_id, n_words, score, ...) written once -> with rank: 1, 2, 3, ... of the percent of eligible rows with the highest scores."""
    spark = scored.sparkSession
    eligible = F.col("n_words") >= LEAST_WORDS
    # A row for each score: scores are whole numbers within the range of gains and noise.
    scores = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n"))
    down = F.sum("n").over(Window.orderBy(F.desc("score")))
    wanted = F.floor(percent * F.sum("n").over(Window.partitionBy()) / 100)
    cut = scores.withColumns({"reach": down, "wanted": wanted}).where("reach - n < wanted").agg(F.min("score").alias("low"), F.max("wanted").alias("wanted")).first()
    if cut["low"] is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    high = eligible & (F.col("score") >= cut["low"])
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            place = pa.array(np.arange(n + 1, n + 1 + b.num_rows))
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), place], [*b.schema.names, "part", "place"])

    # Rows equal in score and id differ by their weight's place in the order at most, so they may be dealt apart by it.
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema)
    top = written(scored.where(high).repartitionByRange(parts, *order, "n_features").sortWithinPartitions(*order, "n_features").mapInArrow(number, f"{fields}, part int, place long"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = top.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # a row a partition
    rank = F.col("before") + F.col("place")
    ranked = top.join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= cut["wanted"], rank).cast("long")).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_features, weight, score, rank (null where a document isn't drawn)."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = written(weighted(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return drawn(scored, percent).select("doc_id", "n_features", "weight", "score", "rank")
