"""BPE encoding and decoding over a minimal acyclic transducer of frequent words.

The words that the corpus repeats most are compiled, with the ids they encode
to, into a shared-suffix (minimal, acyclic) automaton. Every arc carries the
number of words that sort before those it leads to, so the sum along a path is
the word's ordinal, which indexes a pool of ids. The tables are flat arrays,
read where the broadcast holds them. Words outside the lexicon are merged
exactly by rank.

Defined cases: null and empty text give no ids; a special token's string in a
text is that token, as in the tokenizers library; texts of any length are
encoded whole, one inner batch at a time; repeated rows give repeated results;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netgauge.llm.common import ragged, text_batches, written

#: Words that the lexicon holds, and the longest word in bytes: these bound its size on the driver and in a broadcast.
LEXICON_WORDS, LEXICON_BYTES = 100_000, 48
#: Words whose merges a worker keeps between batches.
CACHE_WORDS = 100_000
#: No such merge.
NO_RANK = 1 << 62


# Ranges that the regex module's newer Unicode calls letters (first line) or numbers (second), and byte-level BPE doesn't.
NEWER_LETTERS = "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
NEWER_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"


def word_pattern() -> regex.Pattern:
    """Byte-level BPE's word pattern."""
    cut = {k: "".join("-".join(f"\\U{int(x, 16):08x}" for x in run.split("-")) for run in runs.split()) for k, runs in (("L", NEWER_LETTERS), ("N", NEWER_NUMBERS))}
    letter, number = (rf"[\p{{{k}}}--[{cut[k]}]]" for k in "LN")
    other = rf"(?:[^\s\p{{L}}\p{{N}}]|[{cut['L']}{cut['N']}])"
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+")


# The word pattern of byte-level BPE.
JVM_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
WORDS = word_pattern()
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in the tokenizer's file -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Vocabulary, merge ranks and special tokens of a byte-level BPE file, without any encoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        raw = {t: bytes(back[c] for c in t) for t in vocab if t not in self.special}
        self.ids = {b: vocab[t] for t, b in raw.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(self.ids[raw[a]], self.ids[raw[b]]): (r, self.ids[raw[a] + raw[b]]) for r, (a, b) in enumerate(pairs)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for b, i in self.ids.items():
            self.tokens[i] = b
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.first = [self.ids[bytes([b])] for b in range(256)]
        keys = np.fromiter((a * size + b for a, b in self.ranks), np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        self.merged = np.fromiter((i for _, i in self.ranks.values()), np.int64, len(self.ranks))
        self.first_of = np.asarray(self.first, np.int64)
        self.special_pattern = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of a long word: the adjacent pair of lowest rank, leftmost first, merges until none is left. O(n log n)."""
        parts = [self.first[b] for b in word]
        n = len(parts)
        ranks = self.ranks
        after, before = list(range(1, n)) + [-1], [-1, *range(n - 1)]
        heap = [(r[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i] = ranks[(a, b)][1]
            parts[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if r := ranks.get((parts[i], parts[k])):
                    heapq.heappush(heap, (r[0], i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((parts[h], parts[i]))):
                heapq.heappush(heap, (r[0], h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Exact BPE of many words at once: each round merges every word's pair of lowest rank, the leftmost of equals."""
        out: list[list[int]] = [[] for _ in words]
        short = [i for i, w in enumerate(words) if 0 < len(w) <= 256]
        for i, w in enumerate(words):
            if len(w) > 256:
                out[i] = self.merge(w)
        if not short:
            return out
        lengths = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
        parts = self.first_of[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        owner = np.repeat(np.arange(len(short)), lengths)
        rank = self.rank_of(parts, np.append(parts[1:], 0))
        rank[np.cumsum(lengths) - 1] = NO_RANK
        while len(parts):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(parts)))
            done = least == NO_RANK
            if done.any():
                flat = parts.tolist()
                for s, n, o in zip(starts[done].tolist(), sizes[done].tolist(), owner[starts[done]].tolist(), strict=True):
                    out[short[o]] = flat[s : s + n]
                keep = np.repeat(~done, sizes)
                parts, owner, rank, least, sizes = parts[keep], owner[keep], rank[keep], least[~done], sizes[~done]
                if not len(parts):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.diff(owner[at], prepend=-1) != 0]
            parts[at] = self.merged[rank[at]]
            keep = np.ones(len(parts), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            parts, owner, rank = parts[keep], owner[keep], rank[keep]
            right = at[np.append(owner[1:], -1)[at] == owner[at]]
            rank[at] = NO_RANK
            rank[right] = self.rank_of(parts[right], parts[right + 1])
            left = at[at > 0]
            left = left[owner[left - 1] == owner[left]] - 1
            rank[left] = self.rank_of(parts[left], parts[left + 1])
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.tokens) + b
        i = np.searchsorted(self.pair_keys, key)
        i[i == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], NO_RANK)


def words_of(text: str) -> list[str]:
    return ASCII_WORDS.findall(text) if text.isascii() else WORDS.findall(text)


def splitter(special_pattern: str) -> Callable[[str], list[str]]:
    """Text -> words; special tokens' strings stand alone, marked by a leading NUL pair that no word pattern yields alone."""
    special = re.compile(f"({special_pattern})") if special_pattern else None

    def split(text: str) -> list[str]:
        if special is None or not special.search(text):
            return words_of(text)
        out: list[str] = []
        for i, part in enumerate(special.split(text)):
            out += [Special(part)] if i % 2 else words_of(part)
        return out

    return split


class Special(str):
    """A special token's string; equal only to another of its kind."""

    __slots__ = ()

    def __hash__(self) -> int:
        return hash(("special", str(self)))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Special) and str.__eq__(self, other)

    def __ne__(self, other: object) -> bool:
        return not self == other


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Sorted insertion into a minimal acyclic automaton; the result is one buffer of int32 tables.

    Layout: [n_arcs, n_words, n_ids, root] + arc keys (state * 256 + byte,
    ascending) + arc targets + arc addends + final flags by state + offsets of
    the words' ids + ids.
    """
    register: dict[tuple, int] = {}
    arcs: list[dict[int, int]] = [{}]
    final: list[bool] = [False]

    def replace(path: list[tuple[int, int, int]]) -> None:
        for parent, byte, child in reversed(path):
            sign = (final[child], tuple(arcs[child].items()))
            arcs[parent][byte] = register.setdefault(sign, child)

    path: list[tuple[int, int, int]] = []
    last = b""
    for word in sorted(entries):
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        replace(path[common:])
        del path[common:]
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte, len(arcs) - 1))
            state = len(arcs) - 1
        final[state] = True
        last = word
    replace(path)
    # Words below each state, bottom-up by an explicit stack; then only the states still reachable get numbers.
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        open_ = [t for t in arcs[s].values() if t not in below]
        if open_:
            stack += open_
        else:
            below[s] = int(final[s]) + sum(below[t] for t in arcs[s].values())
            stack.pop()
    number = {s: i for i, s in enumerate(sorted(below))}
    keys, targets, addends = [], [], []
    for s in sorted(below):
        add = int(final[s])
        for byte, t in sorted(arcs[s].items()):
            keys.append(number[s] * 256 + byte)
            targets.append(number[t])
            addends.append(add)
            add += below[t]
    ids = [entries[w] for w in sorted(entries)]
    offsets = np.cumsum([0, *map(len, ids)])
    flags = [int(final[s]) for s in sorted(below)]
    tables = [[len(keys), len(ids), int(offsets[-1]), len(flags)], keys, targets, addends, flags, offsets, [i for x in ids for i in x]]
    return np.concatenate([np.asarray(t, np.int32) for t in tables]).tobytes()


class Lexicon:
    """The automaton over flat arrays; looks up many words at once, one byte of each per step."""

    def __init__(self, flat: np.ndarray):
        arcs, words, ids, states = (int(x) for x in flat[:4])
        at = 4
        cut = []
        for n in (arcs, arcs, arcs, states, words + 1, ids):
            cut.append(flat[at : at + n])
            at += n
        self.keys, self.targets, self.addends, self.final, self.offsets, self.ids = cut

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of each word, -1 for those the lexicon lacks."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        out = np.full(n, -1, np.int64)
        if not len(self.keys):
            return out
        live = np.flatnonzero((lengths > 0) & (lengths <= LEXICON_BYTES))
        state, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for step in range(int(lengths[live].max(initial=0))):
            key = (state[live] * 256 + data[starts[live] + step]).astype(np.int32)
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            hit = self.keys[arc] == key
            live, arc = live[hit], arc[hit]
            state[live] = self.targets[arc]
            total[live] += self.addends[arc]
            end = lengths[live] == step + 1
            done = live[end]
            done = done[self.final[state[done]] == 1]
            out[done] = total[done]
            live = live[~end]
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts. The JVM's letter classes only choose which words are worth an entry; ids come from exact merges."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(JVM_WORDS), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequent_words(docs: DataFrame) -> DataFrame:
    """(word, n): the most frequent words of all texts, LEXICON_WORDS at most; words that occur once are none of them.

    The words above a cut-off are chosen where they are: the counts' classes (64
    to each doubling, so at most a few thousand rows) tell which cut-off at most
    LEXICON_WORDS words reach.
    """
    counts = written(count_words(docs).where((F.octet_length("word") <= LEXICON_BYTES) & (F.col("n") > 1)))
    grade = F.floor(F.log2("n") * 64)
    reach = F.sum("words").over(Window.orderBy(F.desc("grade")))
    cut = counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("words")).withColumn("reach", reach).where(F.col("reach") <= LEXICON_WORDS).agg(F.min("grade")).first()[0]
    return counts.where(grade >= (1 << 40 if cut is None else cut))


def build_lexicon(docs: DataFrame, tok: Tokenizer) -> bytes:
    """The frequent words compiled with their ids. Only they reach the driver, whatever the number of texts and tasks."""
    words = [r["word"].encode() for r in frequent_words(docs).select("word").collect()]
    return compile_lexicon(dict(zip(words, tok.merge_many(words), strict=True)))


class Encoder:
    """Encodes and decodes lists of texts in a worker."""

    def __init__(self, lexicon: Lexicon, tok: Tokenizer):
        self.lexicon, self.tok, self.special, self.split = lexicon, tok, tok.special, splitter(tok.special_pattern)
        tokens = tok.tokens
        self.token_len = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_data = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[bytes, list[int]] = {}

    def rare(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words that the lexicon lacks."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        found = dict(zip(new, self.tok.merge_many(new), strict=True))
        ids = [self.cache.get(w) or found.get(w, []) for w in words]
        self.cache.update((w, x) for w, x in found.items() if len(w) <= 64)
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        codes: defaultdict[str, int] = defaultdict()
        codes.default_factory = codes.__len__
        by_text = [np.fromiter(map(codes.__getitem__, self.split(t)), np.int64) for t in texts]
        unique = list(codes)
        words = [str(w).encode() for w in unique]
        known = self.lexicon.ordinals(words)
        lex = self.lexicon
        more: list[int] = []
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        hit = np.flatnonzero(known >= 0)
        starts[hit] = lex.offsets[known[hit]]
        lengths[hit] = lex.offsets[known[hit] + 1] - starts[hit]
        specials = {i for i, w in enumerate(unique) if isinstance(w, Special)}
        base = len(lex.ids)
        rare = [i for i in np.flatnonzero(known < 0).tolist() if i not in specials]
        for i, ids in [*zip(rare, self.rare([words[i] for i in rare]), strict=True), *((i, [self.special[str(unique[i])]]) for i in specials)]:
            starts[i], lengths[i] = base + len(more), len(ids)
            more += ids
        pool = np.concatenate([lex.ids, np.asarray(more, np.int64)])
        flat = np.concatenate(by_text) if by_text else np.zeros(0, np.int64)
        per_word = lengths[flat]
        ids = pool[ragged(starts[flat], per_word)]
        ends = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum([len(x) for x in by_text])] if by_text else np.zeros(0, np.int64)
        return ids.astype("<u4"), np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of the ids; bytes that are no UTF-8 become U+FFFD."""
        lengths = self.token_len[ids]
        data = self.token_data[ragged(self.token_at[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode_decode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids, decoded]."""
    spark = docs.sparkSession
    tok = Tokenizer(tokenizer_path)
    shared = spark.sparkContext.broadcast((build_lexicon(docs, tok), tok))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, tok = shared.value
        enc = Encoder(Lexicon(np.frombuffer(lexicon, np.int32)), tok)
        for part, texts in text_batches(batches):
            ids, counts = enc.encode(texts)
            decoded = enc.decode(ids, counts)
            ends = np.cumsum(counts).tolist()
            by_text = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            cols = [part.column(part.schema.get_field_index("doc_id")), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in by_text]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            if with_ids:
                cols += [pa.array([x.astype(np.int32) for x in by_text], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
