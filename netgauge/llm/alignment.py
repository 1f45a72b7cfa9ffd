"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often pairs do so in the corpus.

Both tokenizers encode a text; each token is a range of its bytes. With
pandas.merge_asof, keyed by document and byte, each token's start finds the token
of the other side that covers it. The union of both directions is all overlaps. Where
two tokens that overlap end together, a group ends; tokens of one group are
linked, each with each.

Scale. Encoding gives one narrow row a document with its distinct pairs of ids and
how often they are linked, written once. Pairs are counted with partial sums
before the shuffle. The FREQUENT pairs of highest counts come back by broadcast,
which their number bounds; rarer ones, none of which can be hot, by a shuffled
join. A group's links are counted by its sizes, and its pairs from its distinct
ids, so a long run without a common end costs its distinct pairs only.

Defined cases: null and empty texts, and texts that a tokenizer doesn't give back
byte by byte, have no tokens and zeros; special tokens' strings are plain text;
rows of equal doc_id are a document each; texts of any length are aligned whole;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netgauge.llm.bpe import byte_alphabet
from netgauge.llm.common import ragged, text_batches, written

#: Pairs of ids whose counts are broadcast, at most; they have the highest counts.
FREQUENT = 200_000
#: Occurrences of pairs that are expanded at once, and links of a group beyond which its ids are first made distinct.
BLOCK, LARGE = 4_000_000, 4096
#: Characters of a batch.
BATCH = 1_000_000


class Pieces:
    """A tokenizer's ids and bytes of texts."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return self.data[ragged(self.starts[ids], self.lengths[ids])].tobytes()


class ByteLevel(Pieces):
    """A byte-level BPE file of the tokenizers library; a space goes before the text."""

    def __init__(self, file: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_buffer(file)
        self.of.encode_special_tokens = True
        self.of.no_truncation()
        self.of.no_padding()
        back = byte_alphabet()
        vocab = self.of.get_vocab()
        tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        super().__init__(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.of.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class WordPieces(Pieces):
    """A sentencepiece model, which adds the space itself."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor

        self.of = SentencePieceProcessor(model_proto=file)
        tokens = []
        for i in range(self.of.get_piece_size()):
            piece = self.of.id_to_piece(i)
            tokens.append(bytes([int(piece[1:-1], 16)]) if self.of.is_byte(i) else piece.replace("▁", " ").encode())
        super().__init__(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.of.encode(texts, num_threads=1)


@lru_cache(2)
def tokenizers_of(a: bytes, b: bytes) -> tuple[Pieces, Pieces]:
    return ByteLevel(a), WordPieces(b)


def tokens_of(texts: list[str], whole: list[bytes], of: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts in a row, the number of each text's, and whether its tokens' bytes are the whole text."""
    ids = of.encode(texts)
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
    ends = np.concatenate([[0], np.cumsum(of.lengths[flat])])[np.concatenate([[0], np.cumsum(n)])]
    data, size = of.bytes_of(flat), np.fromiter(map(len, whole), np.int64, len(whole))
    good = np.diff(ends) == size
    if not good.all() or data != b"".join(whole):
        good &= np.asarray([data[a:b] == w for a, b, w in zip(ends[:-1].tolist(), ends[1:].tolist(), whole, strict=True)], bool)
    return flat, n, good


def token_frame(flat: np.ndarray, n: np.ndarray, of: Pieces) -> pd.DataFrame:
    """A row a token: doc, id, and its range of bytes. Ranges of a document begin where those of the one before end, so they are keyed by document."""
    size = of.lengths[flat]
    end = np.cumsum(size)
    return pd.DataFrame({"start": end - size, "end": end, "doc": np.repeat(np.arange(len(n)), n), "id": flat, "row": np.arange(len(flat))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """row_a, row_b of all tokens that overlap, each pair once: each start looks up the covering token of the other side."""
    cover = lambda left, right: pd.merge_asof(left[["start", "row"]], right[["start", "row"]].assign(begin=right["start"]), on="start", suffixes=("", "_other"))
    down = cover(a, b).rename(columns={"row": "row_a", "row_other": "row_b"})
    up = cover(b, a).rename(columns={"row": "row_b", "row_other": "row_a"})
    up = up[up["start"].to_numpy() > up["begin"].to_numpy()]  # tokens that start together have been found
    return pd.concat([down[["row_a", "row_b"]], up[["row_a", "row_b"]]])


def grouped(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token: groups end where tokens that overlap end together."""
    o = overlaps(a, b)
    row_a, row_b = o["row_a"].to_numpy(), o["row_b"].to_numpy()
    both = a["end"].to_numpy()[row_a] == b["end"].to_numpy()[row_b]
    out = []
    for frame, last in ((a, row_a[both]), (b, row_b[both])):
        ends = np.zeros(len(frame), np.int64)
        ends[last] = 1
        out.append(np.cumsum(ends) - ends)  # documents end in a common end, so groups never cross them
    return out[0], out[1]


def expanded(code: np.ndarray, one_a: np.ndarray, group_a: np.ndarray, id_b: np.ndarray, one_b: np.ndarray, start_b: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair code, links), distinct: each entry of the left side with all entries of its group on the right."""
    n = size_b[group_a]
    partner = ragged(start_b[group_a], n)
    return summed(np.repeat(code, n) + id_b[partner], np.repeat(one_a, n) * one_b[partner])


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first) if len(first) else n


def linked_pairs(doc: np.ndarray, id_a: np.ndarray, group_a: np.ndarray, id_b: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc of each group -> (doc, pair, links): the distinct pairs of ids (a << 32 | b) of each document and how often they are linked, by document."""
    groups = len(doc)
    sides = [(group_a, id_a, np.ones(len(id_a), np.int64)), (group_b, id_b, np.ones(len(id_b), np.int64))]
    large = np.bincount(group_a, minlength=groups) * np.bincount(group_b, minlength=groups) > LARGE
    if large.any():  # ids of long groups are made distinct, with their numbers
        for k, (group, ids, _) in enumerate(sides):
            within = large[group]
            key, n = summed(group[within] << 32 | ids[within], np.ones(int(within.sum()), np.int64))
            group, ids, n = np.concatenate([group[~within], key >> 32]), np.concatenate([ids[~within], key & 0xFFFFFFFF]), np.concatenate([np.ones(int((~within).sum()), np.int64), n])
            order = np.argsort(group, kind="stable")
            sides[k] = group[order], ids[order], n[order]
    (group_a, id_a, one_a), (group_b, id_b, one_b) = sides
    size_b = np.bincount(group_b, minlength=groups)
    start_b = np.cumsum(size_b) - size_b
    wide_a, wide_b = (int(x.max(initial=0)) + 1 for x in (id_a, id_b))
    code = (doc[group_a] * wide_a + id_a) * wide_b
    cuts = np.flatnonzero(np.diff(np.cumsum(size_b[group_a]) // BLOCK, prepend=-1))
    parts = [expanded(code[i:j], one_a[i:j], group_a[i:j], id_b, one_b, start_b, size_b) for i, j in zip(cuts, [*cuts[1:], len(code)][: len(cuts)], strict=True)]
    pair, n = summed(*map(np.concatenate, zip(*parts, strict=True))) if len(parts) > 1 else parts[0] if parts else (np.zeros(0, np.int64),) * 2
    return pair // (wide_a * wide_b), (pair // wide_b % wide_a) << 32 | pair % wide_b, n


class Digits:
    """Decimal ids with each of the three separators behind: eight bytes a piece, zeros in front, which are left out of what is written."""

    def __init__(self, size: int):
        pieces = [f"{i}{end}".encode() for end in ",|;" for i in range(size)]
        self.size = size
        self.lengths = np.fromiter(map(len, pieces), np.uint8, len(pieces))
        self.pieces = np.frombuffer(b"".join(x.rjust(8, b"\0") for x in pieces), np.uint64)

    def groups(self, id_a: np.ndarray, group_a: np.ndarray, id_b: np.ndarray, group_b: np.ndarray, n: int, ends: np.ndarray) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each run of groups that ends (exclusively) at ends."""
        size_a, size_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        until = np.cumsum(size_a + size_b)
        place_a = np.arange(len(id_a)) + (np.cumsum(size_b) - size_b)[group_a]
        place_b = np.arange(len(id_b)) + np.cumsum(size_a)[group_b]
        pieces = np.empty(len(id_a) + len(id_b), np.int64)
        pieces[place_a], pieces[place_b] = id_a, id_b
        pieces[until - size_b - 1] += self.size
        pieces[until - 1] += 2 * self.size
        data = self.pieces[pieces].view(np.uint8)
        data = data[data != 0].tobytes()
        tokens = np.concatenate([[0], until])[ends]
        at = np.concatenate([[0], np.cumsum(self.lengths[pieces], dtype=np.int64)])[tokens].tolist()
        return [data[i : max(i, j - 1)] for i, j in zip([0, *at[:-1]], at, strict=True)]


def aligned(texts: list[str], a: Pieces, b: Pieces, digits: Digits) -> dict[str, list]:
    """Columns of a row for each text: n_a, n_b, n_groups, n_links, groups_sha256, pairs, links."""
    whole = [b" " + t.encode() for t in texts]
    sides = [tokens_of(texts, whole, p) for p in (a, b)]
    good = sides[0][2] & sides[1][2] & np.fromiter(map(bool, texts), bool, len(texts))
    (flat_a, n_a), (flat_b, n_b) = ((flat[np.repeat(good, n)], np.where(good, n, 0)) for flat, n, _ in sides)
    left, right = token_frame(flat_a, n_a, a), token_frame(flat_b, n_b, b)
    group_a, group_b = grouped(left, right)
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    doc = np.zeros(groups, np.int64)
    doc[group_a] = left["doc"].to_numpy()
    id_a, id_b = left["id"].to_numpy(), right["id"].to_numpy()
    n_groups = np.bincount(doc, minlength=len(texts))
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, doc, np.bincount(group_a, minlength=groups) * np.bincount(group_b, minlength=groups))
    written_ = digits.groups(id_a, group_a, id_b, group_b, groups, np.cumsum(n_groups))
    of, pair, n = linked_pairs(doc, id_a, group_a, id_b, group_b)
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (pair, n)]
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": [hashlib.sha256(x).hexdigest() if x else "" for x in written_], "pairs": lists[0], "links": lists[1]}


FACTS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}


def alignments(docs: DataFrame, byte_level: str, word_pieces: str) -> DataFrame:
    """docs(doc_id, text), the tokenizers' files -> doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links. The broadcast holds the two files, whose size is fixed."""
    files = []
    for path in (byte_level, word_pieces):
        with open(path, "rb") as f:
            files.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(files))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers_of(*shared.value)
        digits = Digits(max(len(a.lengths), len(b.lengths)))
        for part, texts in text_batches(batches, limit=BATCH):
            found = aligned(texts, a, b, digits)
            columns = [pa.array(found[c], kind) for c, kind in FACTS.items()]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), *columns, found["pairs"], found["links"]], ["doc_id", *FACTS, "pairs", "links"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """rows(pair, ...), each pair once a document -> pair, n (documents), best: whether n is the highest of its A id. An A id is one of a fixed vocabulary, so the broadcast is bounded."""
    counts = written(rows.groupBy("pair").agg(F.count("*").alias("n")))
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return written(counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def frequent_from(counts: DataFrame) -> int:
    """The count from which at most FREQUENT pairs are; by classes of counts, 64 to each doubling."""
    grade = F.floor(F.log2("n") * 64)
    classes = counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("pairs"), F.min("n").alias("low"))
    reach = F.sum("pairs").over(Window.orderBy(F.desc("grade")))  # a few thousand classes at most
    low = classes.withColumn("reach", reach).where(F.col("reach") <= FREQUENT).agg(F.min("low")).first()[0]
    return 1 << 62 if low is None else low


def scored(docs: DataFrame, byte_level: str, word_pieces: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    facts = written(alignments(docs, byte_level, word_pieces).withColumn("row", F.monotonically_increasing_id()))  # a row's number stands once it is written
    rows = facts.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.links")
    counts = pair_counts(rows)
    low = frequent_from(counts)
    often = F.broadcast(counts.where(F.col("n") >= low))
    hits = rows.join(often, "pair").unionByName(rows.join(often.select("pair"), "pair", "left_anti").join(counts.where(F.col("n") < low), "pair"))
    sums = hits.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return facts.drop("pairs", "links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", whole("n_best"), whole("count_sum"), "groups_sha256")
