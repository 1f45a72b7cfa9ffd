"""Operators against independent definitions, and the cases that their docstrings define."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("netgauge.llm")
from pyspark.sql import functions as F  # noqa: E402

from netgauge.llm import bpe, chat, common, decontam, langid, neardup, quality, suffix_dedup, syncmers, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "   \n\n"), (4, "one two three"), (5, "one two three"), (5, "one two three"), (5, "quite another text under the same id"), (6, "a b c d e f g h i j " * 400), (7, "ÄÖ ß 中文 \U0001f600"), (None, "no id at all, but a text of some length")]
WORD = (1 << 64) - 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 1.0) for i, t in ODD], "doc_id long, text string, lang string, score double")


def test_scratch_is_shared_and_removed(spark):
    path = common.scratch_dir(spark)
    common.stored(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3 and path.startswith(common.scratch_root(spark))
    common.delete(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


# ---- syncmers by definition ----


def mixed(x):
    x = ((x ^ (x >> 32)) * int(syncmers.B2)) & WORD
    return ((x ^ (x >> 32)) * int(syncmers.B3)) & WORD


def slow_sketch(text):
    """Every k-mer is looked at by itself, with plain integers."""
    c = [mixed(ord(x) + 1) for x in text]
    base, k, s = int(syncmers.B1), syncmers.K, syncmers.S
    value = lambda i, n: sum(x * pow(base, n - 1 - j, 1 << 64) for j, x in enumerate(c[i : i + n])) & WORD
    small = [mixed(value(i, s)) for i in range(len(c) - s + 1)]
    found = {}
    for i in range(len(c) - k + 1):
        inner = small[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(mixed(value(i, k)) >> 32, i)
    if not found and text:
        found = {int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little") >> 32: 0}
    kept = sorted(found)
    kept = kept[: max(64, sum(h < 1 << 28 for h in kept))]
    return {h: found[h] for h in kept}


def slow_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    known = lambda x: max(max(x), (1 << 28) - 1) if len(x) >= 64 else 1 << 32
    bound = min(known(a), known(b))
    both = [a[h] - b[h] for h in a.keys() & b.keys() if h <= bound]
    same = max((sum(x <= y <= x + 32 for y in both) for x in both), default=0)
    j = same / len({h for h in a.keys() | b.keys() if h <= bound}) if both else 0
    return round(2 * j / (1 + j), 6)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("which", ["docs", "odd", "none", "one id"])
def test_syncmers_by_definition(spark, docs, odd, which, parts):
    df = {"docs": docs.where("length(text) < 1500 or doc_id < 3"), "odd": odd, "none": odd.limit(0), "one id": docs.where("doc_id between 20 and 60 and length(text) < 900").withColumn("doc_id", F.lit(7))}[which]
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"].encode()))
    text = [r["text"] for r in rows]
    print_of = {t: slow_sketch(t) for t in set(text)}
    as_string = lambda f: " ".join(f"{h:08x}@{p}" for h, p in sorted(f.items(), key=lambda x: x[1]))
    want = []
    for i, r in enumerate(rows):
        n, after = len(text[i]) // 4, text[(i + 1) % len(text)]
        e = text[i][: len(text[i]) - n] + after[:n]
        f, g = print_of[text[i]], slow_sketch(e)
        want.append((r["doc_id"], len(text[i]), hashlib.sha256(e.encode()).hexdigest(), as_string(f), as_string(g), slow_likeness(f, g), slow_likeness(f, print_of[after])))
    got = [tuple(r) for r in syncmers.fingerprints(df.repartition(parts)).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("kind", ["smallint", "decimal(20,0)", "string"])
def test_syncmers_take_ids_of_any_type(docs, kind):
    few = docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = syncmers.fingerprints(few)
    assert got.schema["doc_id"].dataType == few.schema["doc_id"].dataType and got.count() == 5


# ---- language ID ----


def test_every_language_is_learnt(spark):
    """Neither many rows of one id nor their number hides another language, and whole texts are learnt."""
    one = next(i for i in range(99) if not held(i))
    many = [(one, "aa bb cc dd " * 20, "aa")] * 3000 + [(i, "xyz zyx yyz " * 9, "zz") for i in range(30)]
    many += [(i, "0 " * 6000 + "qqww wwqq " * 50, "late") for i in range(40)] + [(i, t, "empty") for i, t in enumerate([None, "", "12 3"] * 9)]
    df = spark.createDataFrame(many, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(df)
    assert model.langs == ["aa", "late", "zz"]
    assert [model.predict(t)[0] for t in ("bb aa", "zyx", "wwqq", "")] == ["aa", "zz", "late", "und"]
    kept = langid.sample(df).groupBy("lang").count().collect()
    assert dict(map(tuple, kept)) == {"aa": 1, "late": 40 - sum(held(i) for i in range(40)), "zz": 30 - sum(held(i) for i in range(30))}


def held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 == 1


def test_sample_is_the_smallest_hashes(docs, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 5)
    import zlib

    want = {}
    for r in docs.withColumn("h", F.xxhash64("text")).collect():
        if r["lang"] is not None and r["doc_id"] is not None and not held(r["doc_id"]) and re.search(r"[^\W\d_]", r["text"] or ""):
            want.setdefault(r["lang"], set()).add((zlib.crc32(f"t{r['doc_id']}".encode()), r["h"]))
    got = {}
    for r in langid.sample(docs.repartition(7)).collect():
        got.setdefault(r["lang"], []).append((r["o"], r["h"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:5] for k, v in want.items()}


def test_language_held_out_accuracy(docs):
    found = langid.identify(docs, langid.train(docs)).where(langid.held_out()).collect()
    known = [r for r in found if r["lang"] is not None and r["lang_pred"] != "und"]
    assert np.mean([r["lang"] == r["lang_pred"] for r in known]) > 0.95


# ---- quality ----


def slow_score(model, row):
    z = model.intercept
    for w, rule in model.weights:
        z += w if all(row[n] <= x if op == "<=" else row[n] > x for n, op, x in rule) else 0.0
    return round(1 / (1 + math.exp(-z)), 9)


def test_rules_score_as_their_definition_says(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stats = quality.measured(docs)
    marks = labels.where("quality is not null").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(stats.where(~quality.held_out()).join(marks, "doc_id").drop("doc_id"))
    assert model.weights and all(rule for _, rule in model.weights)
    for r in stats.withColumn("s", model.score()).collect():
        assert r["s"] == pytest.approx(slow_score(model, r), abs=2e-9)


def test_statistics_by_definition(spark):
    text = "Ab c! 12 d.\n\nAb c\n\u00e9\u00e9 $$"
    got = spark.createDataFrame([(text,), (None,)], "text string").select(*[c.alias(k) for k, c in quality.statistics(F.col("text")).items()]).collect()
    words, lines = text.lower().split(), [x for x in text.split("\n") if x]
    letters = [c for c in text if c.isalpha()]
    want = {"chars": len(text), "words": len(words), "lines": len(lines), "word_length": len(text) / len(words), "line_length": len(text) / len(lines), "letters": len(letters) / len(text), "capitals": sum(c.isupper() for c in letters) / len(letters), "digits": 2 / len(text), "symbols": 2 / len(text), "stops": 2 / len(words), "exclamations": 1 / len(words), "distinct_words": len(set(words)) / len(words), "distinct_lines": len(set(lines)) / len(lines)}
    assert {k: got[0][k] for k in want} == pytest.approx(want)
    assert set(got[1]) == {0.0}


def test_quality_ranks_held_out_rows(spark):
    """The area under the curve over held-out rows of the middle table: a constant score would have 0.5."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality is not null")
    rows = quality.scored(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert good and bad and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9


@pytest.mark.parametrize("marks", ["both", "ones", "zeros", "nulls", "repeated"])
def test_quality_with_little_to_learn(spark, marks):
    """Equal texts of both labels, one class, null and repeated labels: the share of label 1, never an error."""
    texts = spark.createDataFrame([(i, "the same text", "clash") for i in range(20)], "doc_id long, text string, label string")
    of = {"both": lambda i: i % 2, "ones": lambda i: 1, "zeros": lambda i: 0, "nulls": lambda i: None, "repeated": lambda i: 1}[marks]
    rows = [(i, of(i)) for i in range(20)] + ([(i, 0) for i in range(20)] if marks == "repeated" else [])
    got = quality.scored(texts, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
    used = [of(r["doc_id"]) for r in got if not r["held_out"]]
    want = 0.5 if marks == "nulls" else np.mean(used)
    assert len(got) == 20 and all(r["score"] == pytest.approx(want, abs=1e-5) and r["predicted"] == (want >= 0.3) for r in got)


# ---- BPE ----


def test_lexicon_holds_the_most_frequent_words(spark, docs, monkeypatch):
    import collections

    monkeypatch.setattr(bpe, "LEXICON_WORDS", 300)
    seen = collections.Counter(w for r in docs.collect() if r["text"] for w in re.findall(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+", r["text"]))
    got = {r["word"]: r["n"] for r in bpe.frequent_words(docs).collect()}
    assert 200 < len(got) <= 300 and all(n > 1 for n in got.values())
    least = min(got.values())
    letters = {w: n for w, n in seen.items() if n > least * 1.02 and w.strip().isascii() and w.strip().isalpha() and len(w.strip()) > 2}
    assert letters.keys() <= got.keys()
    assert bpe.frequent_words(docs.limit(0)).count() == 0


# ---- WARC ----


def test_warc_reads_long_records_and_false_magic(spark, tmp_path):
    """Records over several reads, payloads that hold gzip magic and whole archives, clashing columns; ranges of any size."""
    rng = random.Random(2)
    long = "".join(chr(rng.randrange(32, 0x500)) for _ in range(1_500_000))
    rows = [(1, "http://a/", long, "x"), (2, "http://b/", "\x1f\u008b\x08" * 50, "x"), (3, None, long[:700_000], "x"), (4, "u", long, "x"), (None, "u", None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    made = warc.write_archives(pages.repartition(2), f"file://{tmp_path}")
    for split in (1000, 1 << 20):
        got = {r["page_id"]: r for r in warc.read_archives(spark, f"file://{tmp_path}", made, split, True).collect()}
        assert {i: r["refers_to"] for i, r in got.items()} == {1: 4, 2: None, 3: None, 4: None, None: None}
        for i, _, html, _ in rows:
            payload = (html or "").encode()
            assert got[i]["payload_bytes"] == len(payload) and got[i]["payload"] == (None if i == 1 else payload)


# ---- near-dedup ----


def components(sets):
    """Smallest id reachable, by comparing all pairs."""
    ids, comp = sorted(sets), {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: find(i) for i in ids}


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_dedup_in_a_crowded_region(spark):
    """Variants of a text that isn't there, most of them unlike one another, and copies of some just above the bar; chains; no centre."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]

    def edited(of, k):
        out = list(of)
        for at in rng.sample(range(6, 194), k):
            out[at] = f"x{rng.randrange(10**9)}"
        return out

    texts = {1_000 + i: edited(words, 5) for i in range(900)}
    texts |= {3_000 + i: edited(texts[1_000 + i], 5) for i in range(250)}
    link = edited(words, 5)
    for i in range(60):
        texts[5_000 + i] = link = edited(link, 4)
    sets = {i: shingles(" ".join(t)) for i, t in texts.items()}
    want = components(sets)
    assert len(set(want.values())) > 500 and len(set(want.values())) < len(want) - 250
    got = neardup.deduplicated(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_crowded_regions_meet_in_blocks(spark, monkeypatch):
    """Links of unlike components in a region connect what all pairs connect, whatever the block size, and are few."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(120), 2 if k % 3 else 5):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    comp_of = {k: 0 if k < 30 else k - k % 2 for k in range(90)}
    regions = {7: range(20, 90), 8: range(28), 9: (60, 80, 81)}
    pairs = {(a, b) for r in regions.values() for a in r for b in r if a < b and comp_of[a] != comp_of[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}

    def joined(links):
        group = {k: comp_of[k] for k in range(90)}
        for a, b in links:
            x, y = group[a], group[b]
            group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
        return group

    comp = spark.createDataFrame([(k, c) for k, c in comp_of.items() if k != c], "node long, component long")
    crowd = spark.createDataFrame([(r, k) for r, ks in regions.items() for k in ks], "k1 long, node long")
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    for block in (3, 512):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {(r["a"], r["b"]) for r in neardup.crowded_links(crowd, comp, nodes).collect()}
        assert got <= pairs and joined(got) == joined(pairs)
        assert block < 512 or len(got) < 140 < len(pairs)
    assert neardup.crowded_links(crowd.where("k1 = 8"), comp, nodes).count() == 0


def test_near_dedup_takes_rows_of_one_id_apart(spark):
    """Two texts under one doc_id are linked each for itself; null ids; clashing columns."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (None, b), (None, "alone at last in this table"), (5, None), (6, a)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, h1 string, component int")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in neardup.deduplicated(df).collect()))
    assert got == sorted([(1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (0, 56, 1, False), (0, 2, 0, True), (5, 0, 5, True), (6, 56, 1, False)])
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.keep_one(df).collect()) == sorted([(1, a), (1, b), (0, "alone at last in this table"), (5, "")])


# ---- decontamination ----


def test_names_at_a_sentence_start_are_slots(spark):
    item = "Anna bought 3 apples. Ben bought 4 apples. Carl Smith bought 5 apples. Dora bought 6 apples."
    other = "Peter bought 7 apples. Quinn bought 8 apples. Rosa bought 9 apples. Sam bought 10 apples."
    wrong = "Peter bought 7 apples. Peter bought 8 apples. Peter bought 9 apples. Peter bought 7 apples."
    units = "A van drives 60 km in 2 hours and then rests for 10 minutes by the road"
    table = " ".join(str(i % 7) for i in range(3000))
    bench = spark.createDataFrame([(1, item, "x"), (2, units, "x"), (3, "1 2 3 4 5 6 7", "x"), (None, "a nameless item of several plain words", "x")], "item_id long, text string, doc_id string")
    texts = {10: item, 11: other, 12: units.upper(), 13: table, 14: "Intro. " * 20_000 + other + " end" * 20_000, 15: units.replace("60 km", "75 KM").replace("10", "٤٢"), 16: wrong, 17: "see a nameless item of several plain words here", 18: None}
    rows = [*texts.items(), (11, other), (11, "another text of this id"), (None, item)]
    docs = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, item_id string")
    found = sorted(((r["doc_id"] or 0, r["item_id"] or 0, r["exact"]) for r in decontam.contaminated(docs, bench).collect()))
    assert found == [(0, 1, True), (10, 1, True), (11, 1, False), (12, 2, True), (14, 1, False), (15, 2, False), (16, 1, False), (17, 0, True)]
    left = sorted((r["doc_id"], r["text"][:3] if r["text"] else "") for r in decontam.decontaminate(docs, bench).collect())
    assert left == [(11, "ano"), (13, "0 1"), (18, "")]


def test_one_value_of_the_item_stands_for_one_of_the_document(spark):
    item = "the sum of 3 and 3 and 3 is asked of every pupil in the town each day"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("3", "8")), (2, item.replace("3 and 3 and 3", "4 and 5 and 6"))], "doc_id long, text string")
    assert [r["doc_id"] for r in decontam.by_document(docs, bench).collect()] == [1]


@pytest.mark.parametrize("name", ["op4_decontamination", "op7_warc", "op8_perspectives", "op9_minhash"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from netgauge.llm import entry

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


# ---- suffix dedup ----


def removed(texts):
    """Per text: bytes, bytes removed, runs, hash of the rest, by looking at every string of LENGTH bytes."""
    import collections

    n = suffix_dedup.LENGTH
    seen = collections.Counter(b[p : p + n] for _, b in texts for p in range(len(b) - n + 1))
    for i, b in texts:
        keep = bytearray(b"\1" * len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                keep[p : p + n] = bytes(n)
        runs = sum(1 for p in range(len(b)) if not keep[p] and (p == 0 or keep[p - 1]))
        yield i, len(b), keep.count(0), runs, hashlib.sha256(bytes(x for x, k in zip(b, keep) if k)).hexdigest()


@pytest.mark.parametrize("group", [3, 40, 20_000])
def test_suffix_dedup_of_one_hot_passage(spark, monkeypatch, group):
    """A passage of 150 bytes in all texts, with like surroundings in some: groups of any size, at every depth, give the same."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, ends = text(150), [text(90) for _ in range(6)]
    rows = [(i, text(60) + rng.choice(ends)[rng.randrange(60) :] + passage + rng.choice(ends)[: rng.randrange(90)] + text(40)) for i in range(120)]
    rows += [(500, text(400) * 2), (501, "é" * 150), (502, "x" * 5000), (503, passage), (504, None), (505, rows[0][1])]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    want = sorted(removed([(i, (t or "").encode()) for i, t in rows]))
    assert sum(w[2] > 0 for w in want) > 20
    assert sorted(map(tuple, suffix_dedup.deduplicated(df).collect())) == want


# ---- perspectives ----


def test_turns_without_order_are_cut_into_parts(spark):
    """A conversation of which all turns are null, or equal; ties, repeated rows, a very long text, clashing columns."""
    rng = random.Random(6)
    rows = [(1, None, rng.choice(["ann", "bob", "system", None]), f"{rng.randrange(400)} said") for _ in range(3000)] + [(1, 5, "ann", "end"), (1, 5, "ann", "end")]
    rows += [(2, 7, "user", "same")] * 700 + [(2, 8, "bot", "x" * 200_000), (3, 0, "system", "s")]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "conv_id long, turn long, role string, text string, speaker string, part int").repartition(3)
    got = {}
    for r in chat.rotate(df).orderBy("block", "part").collect():
        assert r["n_turns"] <= chat.MOST
        whole = got.setdefault((r["conv_id"], r["speaker"]), [""])
        assert r["first_char"] == len(whole[0]) and r["n_chars"] == len(r["text"])
        whole[0] += r["text"]
        whole += [(s["start"], s["end"]) for s in r["spans"]]
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "user"), (2, "bot")}
    for (conv, speaker), (whole, *spans) in got.items():
        want, marks = "", []
        for turn, role, text in sorted((-1 if t is None else t, r or "unknown", x) for c, t, r, x in rows if c == conv):
            want += "<|im_start|>" + ("assistant" if role == speaker else "system" if role == "system" else f"user name={role}") + "\n"
            if role == speaker:
                marks.append((len(want), len(want) + len(text) + len("<|im_end|>")))
            want += text + "<|im_end|>\n"
        assert whole == want and spans == marks
