"""Every stage of the pipeline against brute force on its own input."""

import hashlib
import os
import sys

import numpy as np
import pytest

pytest.importorskip("netgauge.llm")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402

from netgauge.llm import langid, line_dedup  # noqa: E402
from netgauge.llm.oracles import ORACLES  # noqa: E402

SF = "/root/testdata/sf0.001"
LINE = "A line of some length that many documents have, with number 4711 in it and more words"
ODD = [(9001, None), (9002, ""), (9003, "12 34 \n 5"), (9004, LINE + "\nown line of the first"), (9005, LINE.replace("4711", "4712") + "\nown line of the second"), (9006, LINE + "\nown line of the second"), (9006, LINE), (None, "a text without an id, long enough to be told apart from others")]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input, output) of every stage, each written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.where("doc_id < 70").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(extra)
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/out"
        stage(spark, docs, SF).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((name, docs, result))
        docs = result
    return out


def texts(df):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.select("doc_id", "text").collect()))


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["language ID", "line dedup", "near-dedup", "decontamination", "encoding"]
    for _, before, after in stages[:-1]:
        assert before.columns == after.columns


def test_language_stage_drops_what_has_no_letter(stages):
    _, before, after = stages[0]
    assert texts(after) == [t for t in texts(before) if any(c.isalpha() for c in t[2])]
    learned = {r["lang"] for r in before.where(~langid.held_out() & F.col("lang").isNotNull()).collect()}
    assert {r["lang"] for r in after.collect()} <= learned


def test_line_stage_keeps_the_first_of_each_class(stages):
    """All pairs of distinct lines are compared by edit distance."""
    _, before, after = stages[1]
    rows = [(i if has else None, t) for has, i, t in texts(before)]
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate(t.split("\n")):
            if line and not line.isspace():
                at = (i is not None, i or 0, k)
                first[line] = min(first.get(line, at), at)
    parent = {x: x for x in first}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lines = sorted(first, key=len)
    limit = dict(zip(lines, line_dedup.limits(np.asarray([len(x) for x in lines])).tolist()))
    for n, b in enumerate(lines):
        for a in lines[n + 1 :]:
            if len(a) - len(b) > limit[b]:
                break
            if limit[b] and find(a) != find(b) and line_dedup.distance_within(a, b, limit[b]):
                x, y = sorted((find(a), find(b)), key=first.get)
                parent[y] = x
    want = []
    for i, t in rows:
        keep, seen, gone = [], 0, 0
        for k, line in enumerate(t.split("\n")):
            real = bool(line) and not line.isspace()
            repeat = real and first[find(line)] != (i is not None, i or 0, k)
            seen, gone = seen + real, gone + repeat
            keep += [] if repeat else [line]
        if not gone or gone < seen:
            want.append((i is not None, i or 0, "\n".join(keep)))
    assert texts(after) == sorted(want)


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    from test_cases import components, shingles

    _, before, after = stages[2]
    rows = texts(before)
    sets = {k: shingles(t) for k, (_, _, t) in enumerate(rows)}
    comp = components({k: s for k, s in sets.items() if s})
    least = {}
    for k, c in comp.items():
        ids = rows[k][:2]
        if ids[0]:
            least[c] = min(least.get(c, ids), ids)
    assert texts(after) == sorted(rows[k] for k in sets if k not in comp or comp[k] not in least or rows[k][:2] == least[comp[k]])


def test_decontamination_stage_drops_what_sql_finds(spark, stages):
    import duckdb

    _, before, after = stages[3]
    con = duckdb.connect()
    con.register("documents", before.select("doc_id", "text").toPandas())
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    bad = {r[0] for r in con.execute(f"select doc_id from ({ORACLES['op4_decontamination']})").fetchall()}
    assert texts(after) == [t for t in texts(before) if not (t[0] and t[1] in bad)]


def test_encoding_stage_equals_the_library(stages):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    _, before, after = stages[4]
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = []
    for has, i, text in texts(before):
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((has, i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after.collect()) == sorted(want)


def test_run_gives_the_last_stages_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
