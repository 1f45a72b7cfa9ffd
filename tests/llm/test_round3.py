"""Alignment, monoid BPE and importance resampling against plain definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from netgauge.llm import alignment, entry, importance, langid, line_dedup, monoid_bpe, neardup, quality, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, weight long, score string"
HARD = [
    "hello world, it's a test", "", None, "Größe  und   Maß\n\n\n  ende ", "a▁b has the space mark", "<|endoftext|> is text </s> <0x41>", "=" * 3000, " " * 500 + "x", "\U0001f600\U0001f601 中文字 한국어 ́", "\t\r\n\x00 \x0b",
    "x" * 20_000, "word " * 4000, "'" * 50 + "re 'll 's", "0123456789" * 30, "ß" * 999, "hello world, it's a test", "ſ ½ Ⅷ ²", "a  b   c    d     e",
]


def rows_of(texts):
    return [(i if i < len(texts) - 3 else (None if i == len(texts) - 1 else 5), t, "en", 3, "s") for i, t in enumerate(texts)]


def random_texts(n, seed=4):
    rng = random.Random(seed)
    alphabet = "aabbcde  \n\t'srevmld'  0123,.!?éüß中文字한   ́"
    return ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 50, 300]))) for _ in range(n)]


# ---- monoid BPE


@pytest.fixture(scope="module")
def ranks():
    return monoid_bpe.Ranks(entry.tokenizer_path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def tiktoken_encoding(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


@pytest.mark.parametrize("text_leaf,word_leaf", [(1, 1), (4, 2), (33, 5), (4096, 16)])
def test_halves_joined_equal_the_whole(ranks, tiktoken_encoding, monkeypatch, text_leaf, word_leaf):
    """Whatever the leaves, the tree gives what tiktoken gives, and the bytes come back."""
    monkeypatch.setattr(monoid_bpe, "WORD_LEAF", word_leaf)
    monkeypatch.setattr(monoid_bpe, "TOKEN_LEAF", word_leaf)
    monkeypatch.setattr(monoid_bpe.split, "__defaults__", (text_leaf,))
    texts = [t or "" for t in HARD if text_leaf > 1 or len(t or "") < 5000] + random_texts(400)
    enc = monoid_bpe.Encoder(ranks)
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert got.tolist() == tiktoken_encoding.encode_ordinary(t), t[:60]
        assert enc.decode(got) == t.encode()


def test_unreachable_tokens_and_windows_that_grow():
    """A word that is a token is that token even if no merges reach it; windows grow until both sides are stable."""
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    import tempfile

    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc", b"cd", b"dab", b"aab", b"bcd", b"xyzw"]
    with tempfile.NamedTemporaryFile(suffix=".tiktoken") as f:
        f.write(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
        f.flush()
        ranks = monoid_bpe.Ranks(f.name)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 60))) for _ in range(2000)] + ["xyzw", "axyzw"]
    monoid_leaf, monoid_bpe.WORD_LEAF = monoid_bpe.WORD_LEAF, 2
    try:
        assert [x.tolist() for x in monoid_bpe.Encoder(ranks).encode(texts)] == want.encode_ordinary_batch(texts)
    finally:
        monoid_bpe.WORD_LEAF = monoid_leaf


def test_op12_rows(spark, tiktoken_encoding):
    """Null, empty and long texts, repeated ids and further columns."""
    docs = spark.createDataFrame(rows_of(HARD), SCHEMA)
    path = entry.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    want = Counter()
    for i, t, *_ in rows_of(HARD):
        ids = tiktoken_encoding.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, monoid_bpe.encode_decode(docs, path).collect())) == want
    assert monoid_bpe.encode_decode(docs.where("false"), path).count() == 0
    full = monoid_bpe.encode_decode(docs, path, with_ids=True)
    assert Counter(bytes(r["decoded"]) for r in full.collect()) == Counter((t or "").encode() for t in HARD)


# ---- importance resampling


def plain_draw(docs, target, percent=25, seed=7):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]

    of = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in of for b in f), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in s}
    rows = []
    for d, words, f in of:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    order = order[: percent * len(order) // 100]
    ranks = {}
    for k, r in enumerate(order):
        ranks.setdefault(r, []).append(k + 1)
    return Counter((*r[:4], ranks[r].pop(0) if ranks.get(r) else None) for r in rows)


def test_crcs_equal_zlib():
    rng = np.random.default_rng(1)
    words = sorted((rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in [0, 1, 1, 2, 7, 7, 7, 30, 511, 512, 513, 9000]), key=len)
    got = importance.crcs(np.frombuffer(b"".join(words), np.uint8), np.asarray([len(w) for w in words]))
    assert got.tolist() == [zlib.crc32(w) for w in words]


@pytest.mark.parametrize("cells", [8, 4_000_000])
def test_op13_equals_the_plain_draw(spark, monkeypatch, cells):
    """Ties, repeated and null ids, texts without words, upper case beyond A-Z, long words, blocks of any size."""
    monkeypatch.setattr(importance, "CELLS", cells)
    rng = random.Random(8)
    words = ["Alpha", "beta", "ΓAMMA", "délta", "x1", "1,000", "a_b", "q" * 700, "İ", "the", "of"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 19, 20, 40, 200]))) for _ in range(150)] + [None, "", "!!! ...", "same words here " * 10, "same words here " * 10]
    docs = [(i if i < 140 else rng.choice([None, 7, 8]), t) for i, t in enumerate(texts)] + [(9, texts[5]), (9, texts[5])]
    target = ["Alpha beta the of", None, "délta x1 beta beta", ""]
    d = spark.createDataFrame([(i, t, "en", 3, "s") for i, t in docs], SCHEMA)
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate(target)], "item_id string, text string")
    assert Counter(map(tuple, importance.resampled(d, t).collect())) == plain_draw(docs, target)
    assert Counter(map(tuple, importance.resampled(d, t.where("false")).collect())) == plain_draw(docs, [])
    assert importance.resampled(d.where("false"), t).count() == 0
    assert Counter(map(tuple, importance.resampled(d, t, percent=100).collect())) == plain_draw(docs, target, 100)


# ---- alignment


def plain_alignment(texts):
    """Groups, links and counts by walking over the bytes."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from netgauge.llm.bpe import byte_alphabet

    a_of = Tokenizer.from_file(entry.tokenizer_path())
    a_of.encode_special_tokens = True
    b_of = SentencePieceProcessor(model_file=entry.tokenizer_path("piece_bpe_32k.model"))
    back = byte_alphabet()
    docs = []
    for t in texts:
        whole = b" " + (t or "").encode()
        a, b = (a_of.encode(" " + t, add_special_tokens=False).ids, b_of.encode(t)) if t else ([], [])
        a_bytes = [bytes(back[c] for c in a_of.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in a]
        b_bytes = [bytes([int(b_of.id_to_piece(i)[1:-1], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            docs.append(None)
            continue
        ends = [list(np.cumsum([len(x) for x in side])) for side in (a_bytes, b_bytes)]
        common, groups = sorted(set(ends[0]) & set(ends[1])), []
        i = j = 0
        for e in common:
            k, m = i, j
            while k < len(a) and ends[0][k] <= e:
                k += 1
            while m < len(b) and ends[1][m] <= e:
                m += 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        docs.append((len(a), len(b), groups))
    held = Counter()
    for d in docs:
        held.update({(x, y) for g in (d[2] if d else []) for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = Counter()
        for g in d[2]:
            ca, cb = Counter(g[0]), Counter(g[1])
            for x, m in ca.items():
                for y, n in cb.items():
                    links[x, y] += m * n
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2])
        out.append((d[0], d[1], len(d[2]), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("frequent,block,large", [(200_000, 4_000_000, 4096), (40, 16, 3), (0, 4_000_000, 0)])
def test_op11_equals_walking_over_the_bytes(spark, monkeypatch, frequent, block, large):
    """Texts that don't come back, runs without a common end, repeated ids; frequent and rare pairs and blocks of any size."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "LARGE", large)
    texts = HARD + random_texts(60)
    rows = rows_of(texts)
    want = Counter((i, *x) for (i, *_), x in zip(rows, plain_alignment(texts), strict=True))
    args = entry.tokenizer_path(), entry.tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, alignment.scored(docs, *args).collect())) == want
    assert alignment.scored(docs.where("false"), *args).count() == 0


def test_alignment_pairs(spark):
    """The operator's own rows hold the linked ids."""
    docs = spark.createDataFrame([(1, "hello"), (2, None)], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in alignment.alignments(docs, entry.tokenizer_path(), entry.tokenizer_path("piece_bpe_32k.model")).collect()}
    assert rows[2]["pairs"] == [] and rows[2]["groups_sha256"] == ""
    assert len(rows[1]["pairs"]) >= 1 and sum(rows[1]["links"]) == rows[1]["n_links"]


# ---- line dedup with the growing threshold


def plain_lines(rows, only_met):
    """(doc_id, text, text hash) rows -> Counter of (doc_id, kept line), by all pairs of distinct lines; null ids first, then the row of smallest text hash. only_met: beyond 2 edits only pairs that have a chunk in common near the same place."""
    chunks = {}

    def meet(a, b, t):
        for x in (a, b):
            if x not in chunks:
                _, keys, at = line_dedup.chunks(line_dedup.Substrings(x), np.array([0]), np.array([len(x)]))
                chunks[x] = list(zip(keys.tolist(), at.tolist(), strict=True))
        return not only_met or t <= line_dedup.THRESHOLD or any(k == m and abs(i - j) <= t for k, i in chunks[a] for m, j in chunks[b])

    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][2], k))
    first = {}
    for place, k in enumerate(order):
        for n, line in enumerate((rows[k][1] or "").split("\n")):
            if line and not line.isspace():
                first.setdefault(line, (place, n))
    lines = sorted(first, key=len)
    limit = line_dedup.limits(np.asarray([len(x) for x in lines], np.int64)).tolist()
    parent = {x: x for x in first}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n, b in enumerate(lines):
        for a in lines[n + 1 :]:
            if len(a) - len(b) > limit[n]:
                break
            if limit[n] and find(a) != find(b) and line_dedup.distance_within(a, b, limit[n]) and meet(a, b, limit[n]):
                x, y = sorted((find(a), find(b)), key=first.get)
                parent[y] = x
    out = Counter()
    for place, k in enumerate(order):
        out.update((rows[k][0], line) for n, line in enumerate((rows[k][1] or "").split("\n")) if line and not line.isspace() and first[find(line)] == (place, n))
    return out


def kept_lines(df):
    return Counter((r["doc_id"], line) for r in line_dedup.deduplicated(df, True).select("doc_id", "text").collect() for line in r["text"].split("\n") if line and not line.isspace())


def edited(rng, line, n):
    for _ in range(n):
        at = rng.randrange(len(line))
        kind = rng.random()
        line = line[:at] + (rng.choice("abcdefgh ") if kind < 0.8 else "") + line[at + (kind < 0.6 or kind >= 0.8) :]
    return line


def line_rows(spark, docs):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(7)).withColumn("removed_lines", F.lit("x"))
    keys = {r["text"]: r["k"] for r in df.select("text", F.xxhash64("text").alias("k")).collect()}
    return df, [(d, t, keys[t]) for d, t in docs]


def test_growing_threshold_equals_all_pairs(spark):
    """Repeated and null ids, rows that are equal, lines of every length class with 0 to 8 % edits, clashing columns."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 6, 9, 14, 20, 30, 60) for _ in range(6)]
    docs = []
    for k in range(90):
        lines = [edited(rng, x, rng.randint(0, max(1, len(x) // 14))) for x in rng.sample(base, 4)] + [f"only of row {k} {rng.random()}", "", "  "]
        docs.append((rng.choice([None, None, k, k, k, k, 3, 4]), "\n".join(lines)))
    docs += [docs[5], docs[5], (50, None), (None, ""), (1, "a first and only line of the corpus"), (9, "a first and only line of the corpus\na second of it"), (9, "this unique text stands nowhere else\nneither does this other sentence")]
    df, rows = line_rows(spark, docs)
    got, least, most = kept_lines(df), plain_lines(rows, False), plain_lines(rows, True)
    assert least <= got <= most and got.total() - least.total() <= 3
    assert (9, "this unique text stands nowhere else") in got
    assert set(df.columns) <= set(line_dedup.deduplicated(df, True).columns)
    assert line_dedup.drop_repeats(df).columns == df.columns


def test_lines_of_equal_periods(spark):
    """A chunk that stands many times in a line counts at all its places."""
    rng = random.Random(5)
    docs = []
    for k in range(12):
        period = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40))
        docs += [(2 * k, period * 10), (2 * k + 1, edited(rng, period * 10, 9))]
    df, rows = line_rows(spark, docs)
    assert plain_lines(rows, False) == kept_lines(df) == plain_lines(rows, True)


def test_variants_of_one_line_do_not_all_meet(spark):
    """Variants of one line that are near it meet it, not one another; those too far from it give few pairs to verify."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    base = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30))
    counts = []
    for n in (250, 1000):
        lines = [base] + [edited(rng, base, rng.randint(1, 16)) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
        shared = line_dedup.chunked(df).distinct()
        sizes = shared.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        weight = shared.join(sizes, "key").groupBy("h1").agg(F.sum(F.log2("size")).alias("weight"))
        rows = shared.join(sizes.select("key"), "key").join(weight.join(line_dedup.signed(df), "h1"), "h1")
        counts.append(line_dedup.central_candidates(rows).count())
    assert counts[0] < 8 * 250 and counts[1] < 8 * 1000


def test_gram_parities_bound_the_edits():
    """No more bits flip than the filter allows."""
    rng = random.Random(9)
    for _ in range(200):
        a = "".join(rng.choice("abcdef ") for _ in range(rng.randint(60, 200)))
        n = rng.randint(0, 12)
        b = edited(rng, a, n)
        sides = [line_dedup.gram_parities(line_dedup.Substrings(x), np.array([0]), np.array([len(x)])) for x in (a, b)]
        flips = sum(bin((int(x[0]) ^ int(y[0])) & (1 << 64) - 1).count("1") for x, y in zip(*sides, strict=True))
        assert flips <= 2 * line_dedup.GRAM * n - abs(len(a) - len(b))


def test_ring_counts_bound_the_edits():
    """No more bits flip than the filter allows, in lines with counts beyond the ring too."""
    rng = random.Random(10)
    for k in range(200):
        a = "".join(rng.choice("abcdef \u0436\U0001f600") for _ in range(rng.randint(60, 2000 if k % 4 == 0 else 200)))
        n = rng.randint(0, 12)
        b = edited(rng, a, n)
        sides = [line_dedup.ring_counts(line_dedup.Substrings(x), np.array([0]), np.array([len(x)])) for x in (a, b)]
        flips = sum(bin((int(x[0]) ^ int(y[0])) & (1 << 64) - 1).count("1") for x, y in zip(*sides, strict=True))
        assert flips <= 2 * n - abs(len(a) - len(b))


def test_lines_with_one_phrase_in_common_do_not_meet(spark):
    """Of the pairs of long lines that are alike in a phrase only, most don't leave the join."""
    rng = random.Random(11)
    letters = "eeeeetttaaoinshrdlu   "
    lines = ["".join(rng.choice(letters) for _ in range(270)) + "a phrase of sixty characters that all of these lines do have" + "".join(rng.choice(letters) for _ in range(270)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = line_dedup.chunked(df).drop("lines").join(line_dedup.signed(df), "h1").selectExpr("*", "h1 as c")
    assert line_dedup.far_candidates(rows).count() < 60 * 59 / 2 / 3


# ---- suffix dedup


def plain_removed(texts, n=200):
    """(bytes removed, kept) of each text by looking up every n-byte string."""
    starts = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if starts[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((int(gone.sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_repeats_of_null_and_equal_ids(spark):
    """Rows without an id and rows of one id are texts like others."""
    rng = random.Random(3)
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared, other = own(230), own(260)
    texts = [own(300) + shared + own(300), own(400) + shared, own(100) + other + own(90), other + own(250), own(500), own(500)]
    ids = [None, 2, None, 7, 7, 7]
    texts += [texts[4], own(10) + shared[:200], None]
    ids += [7, None, None]
    want = Counter((i, n, hashlib.sha256(kept).hexdigest()) for i, (n, kept) in zip(ids, plain_removed([(t or "").encode() for t in texts]), strict=True))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.deduplicated(df).collect()) == want


# ---- near-dedup: who can be linked


def test_rarest_shingles_meet():
    """Of two sets that are similar enough, each has one of the other's rarest among its own."""
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 5, neardup.CLASSES)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, len(x) // 4) + 1))
        y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, 4)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= neardup.SIMILARITY * (len(x) + len(y) - both):
            assert len(np.intersect1d(neardup.rarest(x, counts), neardup.rarest(y, counts)))


def test_boilerplate_is_never_sent(spark):
    """Pages that share most words but too few shingles can't be linked; a near copy among them can."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    boiler = [word() for _ in range(300)]
    texts = [" ".join(boiler + [word() for _ in range(130)]) for _ in range(200)]
    texts.append(texts[0].rsplit(" ", 3)[0])
    nodes = spark.createDataFrame([(i, i) for i in range(len(texts))], "node long, c long")
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    assert {r["node"] for r in neardup.linkable(nodes, rows).collect()} == {0, 200}
    assert neardup.linkable(nodes.withColumn("c", nodes["node"] * 0), rows).count() == 0


def test_bags_leave_out_nothing_near():
    rng = random.Random(12)
    pairs, t = [], []
    for _ in range(500):
        a = "".join(rng.choice("abcdef éß") for _ in range(rng.randint(60, 300)))
        b = edited(rng, a, rng.randint(0, 25))
        pairs.append((a, b) if len(a) >= len(b) else (b, a))
        t.append(rng.randint(3, 20))
    near = np.asarray([line_dedup.distance_within(a, b, k) for (a, b), k in zip(pairs, t, strict=True)])
    ok = line_dedup.possible(pairs, np.asarray(t))
    assert not (near & ~ok).any() and (~near & ~ok).any()


# ---- language and quality: very long texts, columns of clashing names


def test_long_texts_and_clashing_columns_change_no_prediction(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    long = " ".join(r["text"] for r in docs.where("lang = 'en'").limit(20).collect()) * 60
    assert len(long) > 1_000_000
    more = docs.unionByName(spark.createDataFrame([(900_001, long, "en"), (900_002, None, None), (900_003, "", "en")], docs.schema))
    odd = more.withColumns({c: F.lit("x") for c in ("score", "label", "quality", "held_out", "lang_pred", "predicted", "n_words", "row", "v", "h")})
    model = langid.train(more)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).select("doc_id", "lang_pred", "score").collect()}
    assert got == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(more.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score").collect()}
    assert got[900_001][0] == "en" and got[900_002][0] == got[900_003][0] == langid.UND
    plain = {r["doc_id"]: (round(r["score"], 9), r["predicted"]) for r in quality.scored(more.select("doc_id", "text"), labels).collect()}
    assert {r["doc_id"]: (round(r["score"], 9), r["predicted"]) for r in quality.scored(odd, labels).collect()} == plain
    assert set(plain) == {r["doc_id"] for r in more.collect()} and all(0 <= s <= 1 for s, _ in plain.values())


def test_pipeline_loses_no_line_of_rows_of_one_id(spark):
    """What stands nowhere else in the corpus is still there after line dedup, whatever ids its row shares."""
    own = ["the quick brown fox went over a lazy dog", "seven grey wizards brewed strong coffee at dawn", "harbour lights are dim when fog comes in", "nobody ever counted all of those pebbles", "a violin lay broken below dusty stairs"]
    shared = "a line that all have in this small corpus"
    docs = [(9, own[0] + "\n" + shared), (9, own[1] + "\n" + shared), (None, own[2] + "\n" + shared), (None, own[3]), (3, own[4]), (3, own[4])]
    kept = Counter(line for r in line_dedup.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect() for line in r["text"].split("\n"))
    assert kept == Counter([*own, shared])


def spread(rng, line, n):
    """n replacements at even distances, which leave no long run of characters."""
    chars = list(line)
    for k in range(n):
        chars[(2 * k + 1) * len(chars) // (2 * n)] = rng.choice("ABCDEFGH")
    return "".join(chars)


def test_evenly_spaced_edits_meet(spark):
    """As many edits as the threshold allows, at even distances: every near copy goes."""
    rng = random.Random(11)
    docs, n = [], 150
    for k in range(n):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60 + 3 * k))
        docs += [(2 * k, line), (2 * k + 1, spread(rng, line, len(line) // 20))]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string"), True).collect()}
    assert [got[k] for k in range(2 * n)] == [0, 1] * n


def test_chunks_of_near_lines_meet():
    """Every pair within the threshold has a chunk in common near the same place, and none of it is filtered out."""
    rng = random.Random(12)
    lines, pairs = [], []
    for k in range(600):
        size = rng.choice([60, 61, 79, 80, 99, 100, 119, 200, 399, 1000])
        line = "".join(rng.choice(["abcd", "abcdefghijklmnopqrstuvwxyz"][k % 2]) for _ in range(rng.choice([7, 40, size]))) * size
        line = line[:size]
        copy = (spread if k % 3 else edited)(rng, line, size // 20)
        if copy != line and min(len(line), len(copy)) >= line_dedup.LONG_CHARS and line_dedup.distance_within(line, copy, int(line_dedup.limits(np.asarray([min(len(line), len(copy))]))[0])):
            pairs.append((len(lines), len(lines) + 1))
            lines += [line, copy]
    length = np.asarray([len(x) for x in lines])
    row, key, at = line_dedup.chunks(line_dedup.Substrings("".join(lines)), np.cumsum(length) - length, length)
    found = {}
    for r, k, i in zip(row.tolist(), key.tolist(), at.tolist(), strict=True):
        found.setdefault(r, {}).setdefault(k, []).append(i)
    rows = [(k % 2**64, r, length[r], min(x), max(x)) for r, chunks in found.items() for k, x in chunks.items()]
    left = {(int(x["key"]), int(x["h1"])) for x in line_dedup.met(np.array(rows, line_dedup.CHUNK_ROW))}
    assert len(pairs) > 400
    for a, b in pairs:
        t = min(length[a], length[b]) // line_dedup.PER_EDIT
        assert any((k % 2**64, a) in left and (k % 2**64, b) in left and abs(i - j) <= t for k in found[a].keys() & found[b].keys() for i in found[a][k] for j in found[b][k])


@pytest.mark.parametrize("ahead", [1, 64])
def test_rows_that_meet_stay(monkeypatch, ahead):
    """The filter of chunk rows leaves out no row that has a fitting one, in keys of many rows too."""
    monkeypatch.setattr(line_dedup, "AHEAD", ahead)
    rng = np.random.default_rng(3)
    rows = np.zeros(3000, line_dedup.CHUNK_ROW)
    rows["key"], rows["h1"] = rng.integers(0, 12, 3000), np.arange(3000)
    rows["n"], rows["low"] = rng.integers(60, 2000, 3000), rng.integers(0, 4000, 3000)
    rows["high"] = rows["low"] + rng.integers(0, 2, 3000) * rng.integers(0, 50, 3000)
    key, n, low, high = (rows[c].astype(np.int64) for c in ("key", "n", "low", "high"))
    t = np.minimum(n[:, None], n) // line_dedup.PER_EDIT
    fits = (key[:, None] == key) & (abs(n[:, None] - n) <= t) & (low[:, None] - high <= t) & (low - high[:, None] <= t)
    np.fill_diagonal(fits, False)
    want, got = set(np.flatnonzero(fits.any(1)).tolist()), set(line_dedup.met(np.concatenate([rows, rows[::7]]))["h1"].tolist())
    assert want <= got and (ahead == 1 or got == want)


def test_groups_as_written():
    """Eight bytes a piece at most, and the plain text of the groups of each document, also of those without any."""
    digits = alignment.Digits(100_001)
    assert digits.pieces.itemsize == 8 and len(digits.pieces) == 3 * digits.size
    rng = np.random.default_rng(8)
    sides = [[rng.integers(0, 100_001, rng.integers(1, 4)).tolist() for _ in range(200)] for _ in "ab"]
    flat = lambda side: (np.array(sum(side, [])), np.repeat(np.arange(200), list(map(len, side))))
    ends = np.array([0, 3, 3, 150, 200])
    text = lambda i, j: ";".join("|".join(",".join(map(str, side[g])) for side in sides) for g in range(i, j)).encode()
    assert digits.groups(*flat(sides[0]), *flat(sides[1]), 200, ends) == [text(i, j) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
