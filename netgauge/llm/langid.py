"""Language ID by prediction by partial matching over bytes.

For every language a variable-order context tree (contexts of 0 to ORDER
bytes) is counted on labelled text and then frozen. The code length of a byte
is that of PPM with method C escapes: in the longest context seen,
-log2(count / (total + distinct)) if the byte followed it, else the escape's
length -log2(distinct / (total + distinct)) plus the length in the next shorter
context, down to a uniform byte. Since the statistics are frozen, the length of
each (context, byte) seen in training is a constant: these go into one sorted
table for all languages, and only bytes unseen in full context walk down the
orders.

A text's language is the one with the shortest code. The score is the winner's
share of 2 ** (-bits per byte * SHARPNESS) over the languages: a posterior that
doesn't saturate on long texts.

Defined cases: null, empty and letterless texts are `und` with score 0; ties go
to the language first in alphabetical order; a language without any labelled
text that has a letter isn't learnt, and with none at all every text is `und`;
several rows of one doc_id and text count once in training; whole texts are scored whatever their length; repeated rows give
repeated results; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netgauge.llm.common import text_batches

#: Longest context in bytes.
ORDER = 3
#: Training bound: so many distinct texts a language, those of smallest crc32(doc_id); each is learnt whole.
SAMPLE_ROWS = 400
SHARPNESS = 8.0
UND = "und"

LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes ending at each position as one integer; the text is preceded by zero bytes."""
    key = np.zeros(len(data), np.uint32)
    for i in range(n - 1, -1, -1):
        key <<= np.uint32(8)
        key[i:] |= data[: len(data) - i].astype(np.uint32) if i else data.astype(np.uint32)
    return key


#: counts[lang][n]: the sorted grams of n + 1 bytes (a context of n bytes and the byte after it), and how often each occurs.
Counts = dict[str, list[tuple[np.ndarray, np.ndarray]]]


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The counts of one language's texts; contexts don't cross texts."""
    data = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    return [np.unique(np.concatenate([grams(d, n + 1) for d in data] or [np.zeros(0, np.uint32)]), return_counts=True) for n in range(ORDER + 1)]


class Model:
    """Frozen code lengths of all languages. Bounded by the training sample, not by the corpus."""

    def __init__(self, by_lang: Counts):
        self.langs = sorted(by_lang)
        counts = [by_lang[lang] for lang in self.langs]
        # levels[n]: keys of contexts of n bytes + the byte, in any language; lengths by language; the same of escapes from contexts of n bytes
        self.keys, self.bits, self.contexts, self.escapes = [], [], [], []
        for n in range(ORDER + 1):
            keys = np.unique(np.concatenate([c[n][0] for c in counts] or [np.zeros(0, np.uint32)]))
            contexts = np.unique(keys >> np.uint32(8))
            bits = np.zeros((len(keys), len(self.langs)), np.float32)
            escapes = np.zeros((len(contexts), len(self.langs)), np.float32)
            for j, c in enumerate(counts):
                k, v = c[n]
                own, first, distinct = np.unique(k >> np.uint32(8), return_index=True, return_counts=True)
                total = np.add.reduceat(v, first) if len(v) else np.zeros(0, np.int64)
                esc = np.log2((total + distinct) / distinct)
                escapes[np.searchsorted(contexts, own), j] = esc
                fallback = escapes[np.searchsorted(contexts, keys >> np.uint32(8)), j] + self.shorter(keys, n, j)
                bits[:, j] = fallback
                bits[np.searchsorted(keys, k), j] = np.log2(np.repeat(total + distinct, distinct) / v)
            self.keys.append(keys)
            self.bits.append(bits)
            self.contexts.append(contexts)
            self.escapes.append(escapes)
        # The full-context table as an open-addressed hash: a byte costs one probe instead of a binary search.
        top = self.keys[ORDER]
        self.mask = np.uint32((1 << max(8, (4 * len(top)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        left = np.arange(len(top), dtype=np.int32)
        at = self.slot(top)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + np.uint32(1)) & self.mask
        self.slot_keys = np.where(self.slots >= 0, top[self.slots] if len(top) else 0, 0).astype(np.uint32)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(2654435761)) >> np.uint32(7)) & self.mask

    def shorter(self, keys: np.ndarray, n: int, j: int) -> np.ndarray:
        """Lengths in contexts of fewer than n bytes."""
        return self.walk(keys, n - 1)[:, j] if n else np.full(len(keys), 8.0)

    def walk(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Lengths of the last byte of each key by contexts of at most n bytes, for all languages."""
        if n < 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        own = keys & np.uint32((1 << 8 * (n + 1)) - 1) if n < 3 else keys
        out = np.empty((len(keys), len(self.langs)), np.float32)
        i = np.searchsorted(self.keys[n], own)
        i[i == len(self.keys[n])] = 0
        hit = self.keys[n][i] == own if len(self.keys[n]) else np.zeros(len(own), bool)
        out[hit] = self.bits[n][i[hit]]
        rest = own[~hit]
        if len(rest):
            more = self.walk(rest, n - 1)
            c = np.searchsorted(self.contexts[n], rest >> np.uint32(8))
            c[c == len(self.contexts[n])] = 0
            if len(self.contexts[n]):
                known = self.contexts[n][c] == rest >> np.uint32(8)
                more[known] += self.escapes[n][c[known]]
            out[~hit] = more
        return out

    def lengths(self, data: np.ndarray) -> np.ndarray:
        """Code length in bits of a text's bytes, by language."""
        total = np.zeros(len(self.langs))
        for start in range(0, len(data), 1 << 20):
            keys = grams(data[max(0, start - ORDER) : start + (1 << 20)], ORDER + 1)[min(start, ORDER) :]
            at = self.slot(keys)
            row = self.slots[at]
            for _ in range(4):
                off = np.flatnonzero((row >= 0) & (self.slot_keys[at] != keys))
                if not len(off):
                    break
                at[off] = (at[off] + np.uint32(1)) & self.mask
                row[off] = self.slots[at[off]]
            hit = (row >= 0) & (self.slot_keys[at] == keys)
            total += self.bits[ORDER][row[hit]].sum(0, dtype=np.float64)
            if not hit.all():
                total += self.walk(keys[~hit], ORDER).sum(0, dtype=np.float64)
        return total

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score, bits per byte of the best code."""
        if not self.langs or not LETTER.search(text):
            return UND, 0.0, 0.0
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        rate = self.lengths(data) / len(data)
        best = int(np.argmin(rate))
        share = np.exp2((rate[best] - rate) * SHARPNESS)
        return self.langs[best], round(float(1 / share.sum()), 6), round(float(rate[best]), 6)


def held_out(doc_id: object = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame) -> DataFrame:
    """lang, o, h: of each language the SAMPLE_ROWS texts with a letter of smallest (o, h), o a hash of doc_id, h of the text.

    Every task keeps at most that many a language, so repeated rows and a language
    of a third of all rows weigh on no task.
    """
    o = F.crc32(F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", o.alias("o"), F.xxhash64("text").alias("h"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[int, int]]] = {}
        for b in batches:
            langs = np.asarray(b.column(0).to_pylist(), object)
            for lang in set(langs.tolist()):
                at = pa.array(langs == lang)
                new = zip(b.column(1).filter(at).to_pylist(), b.column(2).filter(at).to_pylist(), strict=True)
                kept[lang] = heapq.nsmallest(SAMPLE_ROWS, {*kept.get(lang, ()), *new})
        rows = [(lang, *x) for lang, xs in kept.items() for x in xs]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "o", "h"])

    few = labelled.mapInArrow(least, "lang string, o long, h long").distinct()
    return few.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("o", "h"))).where(f"rn <= {SAMPLE_ROWS}").drop("rn")


def added(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    seen = np.zeros(len(keys), np.int64)
    np.add.at(seen, at, np.concatenate([x[1], y[1]]))
    return keys, seen


def sampled_grams(docs: DataFrame) -> DataFrame:
    """lang, n, gram, seen of the sample, a row a gram: a language's texts, SAMPLE_ROWS at most, meet in one task, so their rows don't grow with the number of tasks."""
    o = F.crc32(F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    texts = docs.where(~held_out() & F.col("lang").isNotNull()).select("lang", o.alias("o"), F.xxhash64("text").alias("h"), "text")
    texts = texts.join(F.broadcast(sample(docs)), ["lang", "o", "h"], "left_semi").dropDuplicates(["lang", "o", "h"]).select("lang", "text").repartition("lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counts = {}
        for part, ts in text_batches(batches):
            langs = part.column(part.schema.get_field_index("lang")).to_pylist()
            for lang in sorted(set(langs)):
                new = counted([t for t, x in zip(ts, langs, strict=True) if x == lang])
                held[lang] = [added(x, y) for x, y in zip(held[lang], new, strict=True)] if lang in held else new
        for lang, levels in held.items():
            for n, (keys, seen) in enumerate(levels):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([n] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(seen, pa.int64())], ["lang", "n", "gram", "seen"])

    return texts.mapInArrow(count, "lang string, n int, gram long, seen long")


def train(docs: DataFrame) -> Model:
    """Fits on the sample. Grams are counted in the tasks; only the sample's distinct grams reach the driver."""
    by_lang: Counts = {}
    for (lang, n), g in sampled_grams(docs).toPandas().sort_values("gram").groupby(["lang", "n"]):
        by_lang.setdefault(lang, [(np.zeros(0, np.uint32), np.zeros(0, np.int64))] * (ORDER + 1))[n] = (g["gram"].to_numpy(np.uint32), g["seen"].to_numpy(np.int64))
    return Model(by_lang)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs + lang_pred, score, bits_per_byte. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, texts in text_batches(batches):
            found = [m.predict(t) for t in texts]
            cols = [part.column(part.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())], [*names, "lang_pred", "score", "bits_per_byte"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names).mapInArrow(run, f"{kept}, lang_pred string, score double, bits_per_byte double")
