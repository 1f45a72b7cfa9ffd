"""Operators against brute force, on the smallest tables and on odd rows."""

import base64
import collections
import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("netgauge.llm")
from netgauge.llm import bpe, chat, decontam, langid, line_dedup, neardup, quality, suffix_dedup, syncmers, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"
ODD = [(1, None), (2, ""), (3, "   \n\n"), (4, "one two three"), (5, "one two three"), (5, "one two three"), (6, "a b c d e f g h i j " * 400), (7, "ÄÖ ß 中文 \U0001f600"), (8, "a b c d e f g h i j " * 400 + "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", None, 0, "x", "y") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(docs):
    return sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())


def test_language_grams_dont_grow_with_partitions(docs):
    """A gram of a language is one row before any aggregation, with the same counts, however the documents are dealt."""
    one, many = ({tuple(r) for r in langid.sampled_grams(d).collect()} for d in (docs.coalesce(1), docs.repartition(13)))
    assert one == many and one
    assert langid.sampled_grams(docs.repartition(13)).count() == len({r[:3] for r in one})


def test_bpe_leaves_no_file_outside_the_shared_folder(spark, tmp_path, monkeypatch):
    import tempfile

    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    lexicon = bpe.Lexicon(np.frombuffer(bpe.compile_lexicon({b"ab": [1, 2], b"abc": [3]}), np.int32))
    assert lexicon.ordinals([b"abc", b"ab", b"a"]).tolist() == [1, 0, -1]
    assert not hasattr(bpe.Lexicon, "mapped") and not list(tmp_path.iterdir())


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_bpe(request, which):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode(df, path("byte_bpe_50k.json")).collect())
    want = []
    for i, text in rows(df):
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_anchors_are_context_free():
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(500))
    at, h = syncmers.anchors(text)
    inner = {x for p, x in zip(at.tolist(), h.tolist()) if 100 <= p <= 400 - syncmers.K}
    assert inner <= set(syncmers.anchors(text[100:400])[1].tolist())


def test_fingerprints_grow_with_the_text():
    """A passage of 3 % that moved is still found at one shift, and packing loses nothing."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage, short = text(3_000), text(900)
    a, b = syncmers.sketch(text(20_000) + passage + text(77_000)), syncmers.sketch(text(70_000) + passage + text(27_000))
    shared = dict(zip(*a)).keys() & dict(zip(*b)).keys()
    shifts = collections.Counter(dict(zip(*b))[h] - dict(zip(*a))[h] for h in shared)
    assert shifts[50_000] >= 20 and syncmers.likeness(a, b) > 0.015
    assert len(syncmers.sketch(short)[0]) == 64 and max(syncmers.sketch(short)[0]) > 1 << 24
    for x, y in ((a, b), (a, a), (b, syncmers.sketch("")), (syncmers.sketch(""), a), (syncmers.sketch(short), syncmers.sketch("x"))):
        assert syncmers.as_string(syncmers.unpacked(syncmers.packed(x))) == syncmers.as_string(x)
        assert syncmers.as_string(syncmers.restored(x, *syncmers.against(x, y))) == syncmers.as_string(y)


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("t", [1, 2, 3])
def test_edit_distance_and_keys(t):
    rng = random.Random(t)
    pairs = []
    for _ in range(400):
        a = [rng.choice("abc") for _ in range(rng.randint(24, 80))]
        b = list(a)
        for _ in range(rng.randint(0, t + 1)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        a, b = "".join(a), "".join(b)
        pairs.append((a, b) if len(a) >= len(b) else (b, a))
    near = [edits(*p) <= t for p in pairs]
    assert line_dedup.within(pairs, t).tolist() == near
    for (a, b), yes in zip(pairs, near):
        if yes and len(b) > t:
            s, r = line_dedup.Substrings(b), line_dedup.Substrings(a)
            index = set(np.concatenate(line_dedup.index_keys(s, np.array([0]), np.array([len(b)]), t)).tolist())
            assert index & set(line_dedup.probe_keys(r, np.array([0]), np.array([len(a)]), t)[1].tolist())


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_line_dedup(request, which):
    df = request.getfixturevalue(which)
    texts = dict(rows(df))
    first = {}
    for i in sorted(texts):
        for k, line in enumerate(texts[i].split("\n")):
            if line and not line.isspace():
                first.setdefault(line, (i, k))
    parent = {x: x for x in first}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lines = [x for x in first if len(x) >= line_dedup.MIN_CHARS]
    pairs = [(a, b) for a in lines for b in lines if (len(a), a) > (len(b), b) and len(a) - len(b) <= 2]
    for (a, b), ok in zip(pairs, line_dedup.within(pairs, 2) if pairs else []):
        if ok:
            x, y = sorted((find(a), find(b)), key=first.get)
            parent[y] = x
    got = {r["doc_id"]: [x["line"] for x in r["removed"]] for r in line_dedup.digest(df).collect()}
    assert got == {i: [k for k, line in enumerate(t.split("\n")) if line and not line.isspace() and first[find(line)] != (i, k)] for i, t in texts.items()}


def test_line_dedup_grows_with_the_line(spark):
    """A changed number in a long line and one edit in a short one are near copies; edits(a, b) bounds every link."""
    rng = random.Random(5)
    base = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(k)) for k in (25, 40, 90)]
    lines = [*base, *(x.replace(x.split()[7][:5], "20241", 1) for x in base), "Chapter nine: on", "Chapter nine, on", "ab", "ac"]
    got = line_dedup.digest(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), grow=True).collect()
    assert {r["doc_id"] for r in got if r["n_removed"]} == {3, 4, 5, 7}
    for a, b in ((a, b) for a in lines for b in lines if len(a) >= len(b)):
        for t in (1, 3, 9, 40):
            assert line_dedup.distance_within(a, b, t) == (edits(a, b) <= t)


def test_decontamination(spark, none):
    item = "A train leaves Rome at 9 and goes 60 km in 2 hours, how far does Anna ride in 5 hours today"
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "")], "item_id long, text string")
    other = item.replace("60", "80").replace("Anna", "Peter").replace("5", "6")
    mixed = "the sum of 3 and 3 is asked of every pupil in the town"
    texts = [item, f"Well. {other}? Yes.", "nothing of it", None, "", "short one", "a short one here", mixed.replace("3 and 3", "4 and 5")]
    docs = spark.createDataFrame([(10 + i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    bench = bench.union(spark.createDataFrame([(5, mixed)], bench.schema))
    found = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.contaminated(docs.drop("key"), bench).collect()}
    assert found[(10, 1)] is True and found[(11, 1)] is False and found[(15, 2)] is True
    assert {d for d, _ in found} == {10, 11, 15}  # in 17 one value of the item stands for two: not the same question
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()) == [12, 13, 14, 16, 17]
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(none, bench).count() == 0


def test_language(docs, odd, none):
    model = langid.train(docs)
    r = langid.identify(docs, model).withColumn("held", langid.held_out()).where("held").collect()
    assert np.mean([x["lang"] == x["lang_pred"] for x in r]) > 0.95
    found = {x["doc_id"]: x for x in langid.identify(odd, model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[7]["lang_pred"] != "und"
    assert langid.identify(none, langid.train(none)).count() == 0


def test_code_lengths_match_the_definition():
    texts = ["abracadabra", "banana band", "cab"]
    m = langid.Model({"x": langid.counted(texts)})
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        b = b"\0" * langid.ORDER + t.encode()
        for i in range(langid.ORDER, len(b)):
            for n in range(langid.ORDER + 1):
                counts[b[i - n : i]][b[i]] += 1

    def bits(context, byte):
        c = counts.get(context)
        if c is None:
            return bits(context[1:], byte) if context else 8.0
        total, distinct = sum(c.values()), len(c)
        if byte in c:
            return np.log2((total + distinct) / c[byte])
        return np.log2((total + distinct) / distinct) + (bits(context[1:], byte) if context else 8.0)

    for t in ("abra band", "zzz"):
        b = b"\0" * langid.ORDER + t.encode()
        want = sum(bits(b[i - langid.ORDER : i], b[i]) for i in range(langid.ORDER, len(b)))
        assert m.lengths(np.frombuffer(t.encode(), np.uint8))[0] == pytest.approx(want, rel=1e-4)


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = quality.scored(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([x["predicted"] == x["quality"] for x in r]) > 0.9
    assert {x["score"] for x in quality.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(none, labels).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", None), (2, "http://b/", ""), (3, "http://c/", "x" * 300_000), (4, None, "x" * 300_000), (5, "http://e/", "é\r\n\r\nWARC/1.1"), (6, "http://f/", "é\r\n\r\nWARC/1.1")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    made = warc.write_archives(pages, folder)
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for split in (97, 1 << 20):
        got = {r["page_id"]: r for r in warc.read_archives(spark, folder, made, split, True).collect()}
        assert {i: r["refers_to"] for i, r in got.items()} == {1: 2, 2: None, 3: 4, 4: None, 5: 6, 6: None}
        for i, r in got.items():
            assert r["payload_bytes"] == len(html[i]) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html[i]).digest()).decode()
            assert r["payload"] == (html[i] if r["record_type"] == "response" else None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_perspectives(spark):
    c = spark.createDataFrame([(1, t, ("user", "bot", "ann")[t % 3], f"t{t}") for t in range(300)] + [(1, None, None, None), (2, 0, "system", "s"), (None, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    r = chat.rotate(c).orderBy("block").collect()
    assert {(x["conv_id"], x["speaker"]) for x in r} == {(1, "user"), (1, "bot"), (1, "ann"), (1, "unknown"), (None, "user")}
    whole = "".join(x["text"] for x in r if (x["conv_id"], x["speaker"]) == (1, "bot"))
    said = [whole[s["start"] : s["end"]] for x in r if (x["conv_id"], x["speaker"]) == (1, "bot") for s in x["spans"]]
    assert said == [f"t{t}<|im_end|>" for t in range(300) if t % 3 == 1]
    assert chat.rotate(c.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_near_dedup(request, which):
    df = request.getfixturevalue(which)
    sets = {}
    for i, t in rows(df):
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.deduplicated(df).collect()}
    assert got == {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("which", ["docs", "odd", "none", "crowded"])
def test_suffix_dedup(request, which, monkeypatch):
    if which == "crowded":
        monkeypatch.setattr(suffix_dedup, "GROUP", 1)
    df = request.getfixturevalue("docs" if which == "crowded" else which)
    n, texts = suffix_dedup.LENGTH, [(i, t.encode()) for i, t in rows(df)]
    seen = collections.Counter(b[p : p + n] for _, b in texts for p in range(len(b) - n + 1))
    want = []
    for i, b in texts:
        keep = bytearray(b"\1" * len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                keep[p : p + n] = bytes(n)
        runs = sum(1 for p in range(len(b)) if not keep[p] and (p == 0 or keep[p - 1]))
        want.append((i, len(b), keep.count(0), runs, hashlib.sha256(bytes(x for x, k in zip(b, keep) if k)).hexdigest()))
    got = sorted(tuple(r) for r in suffix_dedup.deduplicated(df).collect())
    assert got == sorted(want)


@pytest.mark.parametrize("hub", [0, 9_999])
def test_near_dedup_finds_copies_edited_apart(spark, hub):
    """Each of many copies reaches the similarity with their original alone, whatever its id."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [(hub, " ".join(words))]
    for copy in range(150):
        edited = list(words)
        for k in rng.sample(range(6, 194), 5):
            edited[k] = f"x{copy}y{k}"
        texts.append((1_000 + copy, " ".join(edited)))
    got = neardup.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {min(hub, 1_000)}
