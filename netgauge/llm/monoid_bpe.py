"""Byte-level BPE by monoid tree reduction: halves are encoded alone and joined at their boundary.

Both steps of encoding are a monoid over concatenation, so each is a tree.

Splitting. A text is halved down to TEXT_LEAF characters, each leaf is split by
the word pattern. A match depends only on the characters from its start to two
beyond its end, so of a left half all matches that end two characters before its
end stand; from the first other one on, the text is split anew into a growing
part of the right half, until a match ends where the right half has a match
begin: the right half's own matches stand from there.

Merging. A match is halved down to WORD_LEAF bytes, whose ids come from plain
merges. Two neighbouring tokens are stable if their bytes together encode to just
these two. A sequence all of whose neighbours are stable is the encoding of its
bytes: the first merge over a boundary would also be the first of that pair alone.
So if the tokens at the join of two halves are stable, the encodings are
concatenated; else a window around the join is encoded anew and grows, on the
side where it isn't stable yet, until it is. The tokens outside of it stand.

Decoding concatenates the bytes of halves.

Defined cases: null and empty text give no ids; special tokens' strings are plain
text; texts and words of any length are encoded whole; repeated rows give
repeated results; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netgauge.llm import bpe
from netgauge.llm.common import ragged, text_batches

#: Characters of a text, bytes of a word and tokens of a decoded run that are not halved any further.
TEXT_LEAF, WORD_LEAF, TOKEN_LEAF = 4096, 16, 4096
#: Characters beyond a match's end that its choice can depend on (a contraction's two letters, the end of white space).
BEYOND = 2
#: Words and pairs of tokens that a worker keeps between batches.
CACHE = 200_000


class Ranks(bpe.Tokenizer):
    """A rank file: any two tokens whose bytes together are a token merge into it, lowest rank first. A token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        size = max(self.ids.values()) + 1
        self.tokens = [b""] * size
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.ranks = {(a, b): (i, i) for token, i in self.ids.items() for cut in range(1, len(token)) if (a := self.ids.get(token[:cut])) is not None and (b := self.ids.get(token[cut:])) is not None}
        self.first = [self.ids[bytes([b])] for b in range(256)]
        self.first_of, self.merged = np.asarray(self.first, np.int64), np.arange(size)
        keys = np.fromiter((a * size + b for a, b in self.ranks), np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter((i for i, _ in self.ranks.values()), np.int64, len(keys))[order]


def split(text: str, leaf: int = TEXT_LEAF) -> list[str]:
    """The word pattern's matches, by halves."""
    if len(text) <= leaf:
        return bpe.words_of(text)
    middle = len(text) // 2
    left, right = text[:middle], text[middle:]
    return joined_matches(left, split(left, leaf), right, split(right, leaf))


def joined_matches(left: str, before: list[str], right: str, after: list[str]) -> list[str]:
    stand, start = len(before), len(left)
    while stand and start > len(left) - BEYOND:  # a match stands if it ends BEYOND characters before the end
        stand -= 1
        start -= len(before[stand])
    if stand < len(before) and start + len(before[stand]) <= len(left) - BEYOND:
        start += len(before[stand])
        stand += 1
    taken, grow = 0, 2
    reach = 0
    while True:
        more = min(len(after), taken + grow)
        reach += sum(map(len, after[taken:more]))
        taken, grow = more, 2 * grow
        begins, at = {0: 0}, 0
        for k, m in enumerate(after[:taken]):
            at += len(m)
            begins[at] = k + 1
        new, end = bpe.words_of(left[start:] + right[:reach]), start - len(left)
        for k, m in enumerate(new):
            end += len(m)
            if end in begins and (end <= reach - BEYOND or taken == len(after)):
                return before[:stand] + new[: k + 1] + after[begins[end] :]


class Encoder:
    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.lengths = np.fromiter(map(len, ranks.tokens), np.int64, len(ranks.tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(ranks.tokens), np.uint8)
        self.words: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def stable(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            tokens = self.ranks.tokens
            known = self.pairs[a, b] = self.ranks.merge(tokens[a] + tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        tokens, i, j, grow = self.ranks.tokens, len(left) - 1, 1, 1
        while True:
            window = self.ranks.merge(b"".join([*map(tokens.__getitem__, left[i:]), *map(tokens.__getitem__, right[:j])]))
            low = i == 0 or self.stable(left[i - 1], window[0])
            high = j == len(right) or self.stable(window[-1], right[j])
            if low and high:
                return left[:i] + window + right[j:]
            i = i if low else max(0, i - grow)
            j = j if high else min(len(right), j + grow)
            grow *= 2

    def reduced(self, word: bytes, leaves: dict[bytes, list[int]]) -> list[int]:
        if len(word) <= WORD_LEAF:
            return leaves[word]
        middle = len(word) // 2
        return self.join(self.reduced(word[:middle], leaves), self.reduced(word[middle:], leaves))

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; a word that is a token is that token."""
        if len(self.words) > CACHE:
            self.words.clear()
        whole = self.ranks.ids
        found = {w: [whole[w]] for w in words if w in whole}
        new = [w for w in words if w not in found and w not in self.words]
        todo, leaves = list(new), set()
        while todo:
            w = todo.pop()
            if len(w) <= WORD_LEAF:
                leaves.add(w)
            else:
                todo += [w[: len(w) // 2], w[len(w) // 2 :]]
        some = list(leaves)
        of = dict(zip(some, self.ranks.merge_many(some), strict=True))
        found.update((w, self.reduced(w, of)) for w in new)
        out = [found[w] if w in found else self.words[w] for w in words]
        self.words.update((w, found[w]) for w in new if len(w) <= 64)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; each distinct word of the texts is encoded once."""
        codes: defaultdict[str, int] = defaultdict()
        codes.default_factory = codes.__len__
        by_text = [np.fromiter(map(codes.__getitem__, split(t)), np.int64) for t in texts]
        ids = self.encode_words([w.encode() for w in codes])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        pool = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        return [pool[ragged(starts[t], lengths[t])].astype("<u4") for t in by_text]

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' bytes, by halves."""
        if len(ids) <= TOKEN_LEAF:
            return self.data[ragged(self.starts[ids], self.lengths[ids])].tobytes()
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


def encode_decode(docs: DataFrame, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids, decoded]. The broadcast holds the vocabulary, whose size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(Ranks(ranks_path))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for part, texts in text_batches(batches):
            ids = enc.encode(texts)
            decoded = [enc.decode(x) for x in ids]
            cols = [part.column(part.schema.get_field_index("doc_id")), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
            if with_ids:
                cols += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
