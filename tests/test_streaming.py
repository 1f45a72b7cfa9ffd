"""A stream gives what the batch gives; archives come back as written."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netgauge import catalog
from netgauge.operators import detector
from netgauge.sources import archives, bundles
from netgauge.sources.store import Store
from netgauge.streaming import feeds, ingest, scoring, summing
from netgauge.streaming.sinks import Ledger, by_time

SF = "/root/testdata/sf0.001"


def test_changes_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Two halves of the series, each by a query of its own on one checkpoint, give what the batch gives over the whole."""
    s = catalog.series(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    got = set()
    for i, (since, until) in enumerate((("2024-01-01", "2024-01-16"), ("2024-01-16", "2025-01-01"))):
        s.where((F.col("ts") >= since) & (F.col("ts") < until)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(s.schema).parquet(f"{tmp_path}/in")
        rows = []
        q = ingest.blocking_changes(stream, ["probe_cc", "input"]).writeStream.foreachBatch(lambda df, n, rows=rows: rows.extend(df.collect())).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
        assert rows or i
        got |= {(r["probe_cc"], r["input"], r["ts"], r["blocked"]) for r in rows}
    want = detector.changes(detector.moving_average(s, ["probe_cc", "input"]), ["probe_cc", "input"])
    assert got == {(r["probe_cc"], r["input"], r["ts"], r["blocked"]) for r in want.collect()}


def test_moving_average_over_many_chunks(spark, monkeypatch):
    """Chunks of any size give the plain fold's means, ties in time included."""
    rng = random.Random(1)
    xs = [rng.choice([0.0, 0.8, 2.0, None]) for _ in range(500)]
    rows = spark.createDataFrame([("a" if i % 7 else "b", f"2024-01-{1 + i // 100:02d} 00:00:{i // 2 % 60:02d}", i, x) for i, x in enumerate(xs)], "k string, t string, uid long, x double").withColumn("ts", F.col("t").cast("timestamp"))
    want = {}
    for k in "ab":
        mean = None
        for r in sorted((r for r in rows.collect() if r["k"] == k and r["x"] is not None), key=lambda r: (r["ts"], r["uid"])):
            mean = r["x"] if mean is None else 0.98 * mean + 0.02 * r["x"]
            want[r["uid"]] = round(mean, 9)
    for chunk in (7, 1000):
        monkeypatch.setattr(detector, "CHUNK", chunk)
        assert {r["uid"]: round(r["mean"], 9) for r in detector.moving_average(rows, ["k"]).collect()} == want


def record(**more):
    return json.dumps({"report_id": "r", "probe_cc": "it", "probe_asn": "AS1", "test_name": "openvpn", "measurement_start_time": "2024-01-02 03:04:05", "test_keys": {"success": False}} | more)


def prints(spark, page, address="10.9.9.9"):
    """Fingerprints of answers and of responses."""
    rows = lambda *r: spark.createDataFrame(list(r), scoring.PRINTS)
    return rows(("dns", address, "full", "", "nat", [])), rows(("page", page, "full", "body", "isp", []), ("server", "blocker/", "prefix", "header.server", "fp", ["IT"]))


def web(uid, body=None, address=None, server=None, **more):
    keys = {"blocking": None, "accessible": None, "queries": [{"answers": [{"ipv4": address}]}] if address else [], "requests": [{"response": {"body": body, "headers": {"Server": server} if server else {}}}]}
    return uid, record(test_name="web_connectivity", test_keys=keys, **more)


def of(df):
    return sorted(str(sorted(r.asDict().items(), key=lambda x: x[0])) for r in df.collect())


UID = "20240102030405.000000_IT_{}_{:016d}"


def test_scored_stream_equals_batch(spark, tmp_path, monkeypatch):
    """All tables equal the batch, row for row: over restarts, after the fingerprints changed, failed to load, and after a batch that broke between two tables."""
    (tmp_path / "in").mkdir()
    parts = [
        [web(UID.format("webconnectivity", 1), "the old block page"), web(UID.format("webconnectivity", 2), address="10.9.9.9"), (UID.format("openvpn", 3), record()), (UID.format("openvpn", 3), record()), ("u4", "{broken")],
        [web(UID.format("webconnectivity", 5), "the old block page"), web(UID.format("webconnectivity", 6), "a new block page", server="blocker/2"), (UID.format("openvpn", 7), record(probe_cc="ZZ"))],
        [web(UID.format("webconnectivity", 8), "the old block page"), (UID.format("openvpn", 9), json.dumps({"format": "json", "content": json.loads(record(test_keys={"success": True}))}))],
        [web(UID.format("webconnectivity", 10), "a new block page, again"), ("u11", record(report_id=None))],
    ]
    state = {"page": "old block", "broken": False}

    def load():
        if state["broken"]:
            raise OSError("away")
        return prints(spark, state["page"])

    want, sink = {t: [] for t in (scoring.FACTS, scoring.OPENVPN)}, f"{tmp_path}/out"

    def arrive(i, expected, started=()):
        (tmp_path / f"in/{i}.json").write_text("".join(json.dumps({"measurement_uid": u, "body": b}) + "\n" for u, b in parts[i]))
        batch = spark.createDataFrame(sorted(set(parts[i])), "measurement_uid string, body string")
        for table, rows in scoring.derived(batch, expected).items():
            want[table] += of(rows)

    def run(**more):
        scoring.start(spark, f"{tmp_path}/in", sink, f"{tmp_path}/cp", load, once=True, **more).awaitTermination(240)

    def same():
        for table, rows in want.items():
            assert of(scoring.read(spark, sink, table)) == sorted(rows)

    arrive(0, prints(spark, "old block"))
    run()
    same()
    assert {r["measurement_uid"][-1]: r["confirmed"] for r in scoring.read(spark, sink, scoring.FACTS).collect()} == {"1": "t", "2": "t", "3": "f"}
    # the batch breaks after the facts were written: nothing of it is seen, and it is done again
    state["page"] = "new block"
    arrive(1, prints(spark, "new block"))
    before, commit = dict(want), Ledger.commit
    monkeypatch.setattr(Ledger, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(Ledger, "commit", commit)
    assert scoring.read(spark, sink, scoring.FACTS).count() == 3 and before
    run()
    same()
    assert {r["measurement_uid"][-1] for r in scoring.read(spark, sink, scoring.FACTS).where("confirmed = 't'").collect()} == {"1", "2", "6"}
    # one stream over two batches; the fingerprints fail to load in between, so the copy stays
    arrive(2, prints(spark, "new block"))
    arrive(3, prints(spark, "new block"))
    loads = []

    def once_then_away():
        loads.append(1)
        state["broken"] = len(loads) > 1
        return load()

    scoring.start(spark, f"{tmp_path}/in", sink, f"{tmp_path}/cp", once_then_away, files=1, once=True, seconds=10, clock=itertools.count(0, 20).__next__).awaitTermination(240)
    assert len(loads) >= 2
    same()
    assert scoring.read(spark, sink, scoring.POSTS).count() == 11
    # fewer folders, the same rows; a batch that is repeated after that does nothing
    assert scoring.compact(spark, sink) == 3 and scoring.compact(spark, sink) is None
    assert len(Ledger(spark, sink).commits()) == 1
    scoring.appended(Ledger(spark, sink), batch_of(spark, parts[0]), 0)
    same()


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "measurement_uid string, body string")


def test_spooled_posts_have_their_hour(spark):
    d = batch_of(spark, [(UID.format("tor", 1), "x"), ("u2", "y"), (None, None)])
    assert sorted(map(tuple, d.select(*by_time()).collect()), key=str) == [("20240102", "03", "IT", "tor"), (None,) * 4, (None,) * 4]


def test_files_appear_whole(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.put("a/b.json", "one")
    store.put("a/b.json", "two")
    assert store.get("a/b.json") == "one" and store.names("a") == ["b.json"] and store.names("none") == []


def test_counters_stream_equals_batch(spark, tmp_path):
    fact = catalog.msm(spark, SF).withColumn("measurement_start_time", F.col("measurement_start_time").cast("timestamp"))
    fact.coalesce(2).write.parquet(f"{tmp_path}/in")
    urls, now = catalog.views.url_list(spark, SF), F.lit("2024-01-20").cast("timestamp")
    for n, count in enumerate((ingest.daily_counters, ingest.weekly_counters)):
        stream = spark.readStream.schema(fact.schema).parquet(f"{tmp_path}/in")
        q = count(ingest.recent_web(stream, urls, now)).writeStream.outputMode("complete").format("memory").queryName(f"counters{n}").option("checkpointLocation", f"{tmp_path}/c{n}").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(str, spark.table(f"counters{n}").collect())) == sorted(map(str, count(ingest.recent_web(fact, urls, now)).collect()))


BODIES = "measurement_uid string, day string, hour string, cc string, test string, body string"


def folded(rows, budget):
    """The serial fold: a bundle closes at the line that brings it over the budget. -> uid: (group, bundle, line)"""
    out, state = {}, {}
    for uid, *group, body in sorted({r[0]: r for r in sorted(rows, reverse=True)}.values(), key=lambda r: (r[1:5], r[0])):
        bundle, line, size = state.get(tuple(group), (0, 0, 0))
        out[uid] = (*group, bundle, line)
        size += len(body.encode()) + 1
        state[tuple(group)] = (bundle + 1, 0, 0) if size > budget else (bundle, line + 1, size)
    return out


@pytest.mark.parametrize("budget,block", [(1, 1), (300, 1), (300, 2), (2000, 3), (10**9, 8)])
def test_cuts_equal_the_serial_fold(spark, monkeypatch, budget, block):
    """Hours of one line and of thousands, lines longer than a bundle and than a block of bundles."""
    monkeypatch.setattr(bundles, "BLOCK", block)
    rng = random.Random(budget + block)
    rows = [(f"u{i:05d}", "20240102", rng.choice(["03"] * 30 + ["04", "05"]), rng.choice(["IT", "IT", "FR"]), "tor", json.dumps({"x": "y" * (rng.choice([0, 5, 40, 90]) if rng.random() < 0.99 else rng.choice([700, 3000, 9000]))})) for i in range(3000)]
    rows += [(f"v{i}", "20240103", "00", "DE", "t", json.dumps({"n": i})) for i in range(3)]
    places = bundles.bundled(spark.createDataFrame(rows, BODIES), budget)[1]
    got = {r["measurement_uid"]: (r["day"], r["hour"], r["cc"], r["test"], r["bundle"], r["linenum"]) for r in places.collect()}
    assert got == folded(rows, budget)
    assert bundles.bundled(spark.createDataFrame([], BODIES), budget)[1].count() == 0


def test_bundles_and_locators(spark, tmp_path):
    """Bundles come back by locator; what doesn't parse is an empty record with its place; bundles that nobody asks for aren't read; doing it again changes nothing."""
    rows = [(f"u{i}", "20240102", f"{i % 2:02d}", "IT", "openvpn", "{broken" if i == 3 else record(n=i)) for i in range(9)]
    d = spark.createDataFrame(rows + [("u5", "20240102", "01", "IT", "openvpn", record(n="other"))], BODIES)
    path = f"{tmp_path}/raw"
    at = bundles.write_bundles(d.union(d).repartition(5), path, budget=300)
    where = {r["measurement_uid"]: (r["s3path"], r["linenum"]) for r in at.collect()}
    assert at.count() == 9 and {n for _, n in where.values()} == {0, 1, 2} and at.where("report_id = 'r'").count() == 8
    back = {r["measurement_uid"]: r["body"] for r in bundles.bodies(spark, path, at.where("measurement_uid <> 'u0'")).collect()}
    assert back.pop("u5") in (record(n=5), record(n="other"))
    assert back == {u: "{}" if u == "u3" else b for u, *_, b in rows if u not in ("u0", "u5")}
    files = {p.relative_to(path): p.read_bytes() for p in (tmp_path / "raw").rglob("*.gz")}
    assert {str(p) for p in files} == {p for p, _ in where.values()} and not (tmp_path / "raw/_attempt-").exists() and not list(tmp_path.rglob("_attempt*"))
    again = bundles.write_bundles(d.repartition(3), path, budget=300)
    assert {r["measurement_uid"]: (r["s3path"], r["linenum"]) for r in again.collect()} == where
    assert {p.relative_to(path): p.read_bytes() for p in (tmp_path / "raw").rglob("*.gz")} == files
    assert archives.archive(spark, path, "20240102", "20240103", ["IT"]).count() == 9
    (tmp_path / "raw/day=20240102/hour=00/cc=IT/test=openvpn/000099-x.jsonl.gz").write_bytes(b"not gzip")
    one = at.where("measurement_uid = 'u7'")
    assert [r["body"] for r in bundles.bodies(spark, path, spark.createDataFrame(one.collect(), one.schema)).collect()] == [record(n=7)]


class Counted:
    """An open file that counts the bytes read from it."""

    def __init__(self, file):
        self.file, self.bytes, self.reads = file, 0, 0

    def size(self):
        return self.file.size()

    def read_at(self, n, at):
        out = self.file.read_at(n, at)
        self.bytes, self.reads = self.bytes + len(out), self.reads + 1
        return out


@pytest.mark.parametrize("n,block", [(0, 100), (1, 100), (50, 1), (3000, 1), (3000, 5000), (9000, 1), (200, 10**9)])
def test_lines_by_block(tmp_path, n, block):
    """Any gzip reader sees the lines; k lines cost the end of the file and at most k blocks; files without an index are read through."""
    import gzip

    from pyarrow.fs import LocalFileSystem

    from netgauge.sources import blocks

    rng, fs = random.Random(n + block), LocalFileSystem()
    lines = ["".join(rng.choice("abcdeü字 \r\t\x85") for _ in range(rng.choice([0, 1, 30, 200]))) for _ in range(n)]
    for name in ("a", "b"):
        out = blocks.BlockFile(fs.open_output_stream(f"{tmp_path}/{name}", compression=None), block)
        for x in lines:
            out.add(x.encode())
        out.close()
    packed = (tmp_path / "a").read_bytes()
    plain = "".join(f"{x}\n" for x in lines).encode()
    assert packed == (tmp_path / "b").read_bytes() and gzip.decompress(packed) == plain
    (tmp_path / "plain").write_bytes(gzip.compress(plain[:1000]) + gzip.compress(plain[1000:]))
    for some in ([], list(range(n)), sorted(rng.choices(range(n + 3), k=4)), [n, n, n + 7]):
        want = [lines[i] if i < n else None for i in some]
        with fs.open_input_file(f"{tmp_path}/a") as f:
            counted = Counted(f)
            assert list(blocks.found_lines(counted, some)) == want
            first, places, end = blocks.index_of(f, f.size())
            widest = max(np.diff([*places, end]), default=0)
            assert len(first) <= blocks.MOST and counted.reads <= 2 + len(set(some))
            assert counted.bytes <= blocks.TAIL + 16 * len(first) + 46 + len(set(some)) * widest
        with fs.open_input_file(f"{tmp_path}/plain") as f:
            assert list(blocks.found_lines(f, some)) == want
    for wrong in (b"", b"not gzip", packed[:-1], packed[: len(packed) // 2]):
        (tmp_path / "w").write_bytes(wrong)
        with fs.open_input_file(f"{tmp_path}/w") as f:
            assert blocks.index_of(f, len(wrong)) is None


def test_lines_of_many_bundles(spark, tmp_path):
    """Locators of several bundles in any order, twice, without a line, with nulls; a bundle of many blocks; Spark reads the files as any others."""
    rows = [(f"u{i:04d}", "20240102", f"{i % 3:02d}", "IT", "tor", json.dumps({"n": i, "x": "é" * (i % 50)}, ensure_ascii=False)) for i in range(2000)]
    path = f"{tmp_path}/raw"
    at = bundles.write_bundles(spark.createDataFrame(rows, BODIES), path, budget=40_000, block=500)
    assert spark.read.option("basePath", path).text(path).count() == 2000
    want = sorted((r[0], r[5]) for r in rows)
    assert sorted(map(tuple, bundles.bodies(spark, path, at.union(at).repartition(7)).collect())) == sorted(want + want)
    one = at.where("measurement_uid = 'u0007'").first()
    odd = spark.createDataFrame([("far", one["s3path"], 10**6), ("null", None, 1), ("none", one["s3path"], None), ("low", one["s3path"], -1), ("u0007", one["s3path"], one["linenum"])], "measurement_uid string, s3path string, linenum int")
    assert list(map(tuple, bundles.bodies(spark, path, odd).collect())) == [("u0007", rows[7][5])]
    assert bundles.bodies(spark, path, odd.where("false")).count() == 0
    with pytest.raises(Exception, match="gone"):
        bundles.bodies(spark, path, odd.where("measurement_uid = 'u0007'").withColumn("s3path", F.lit("gone.gz"))).collect()


def test_attempts_leave_nothing(tmp_path):
    """Files of an attempt that failed or came twice never get their name."""
    import pyarrow as pa

    rows = lambda *names: iter([pa.RecordBatch.from_pydict({"file": list(names), "value": ["x"] * len(names)})])
    w = bundles.BundleWriter(f"file://{tmp_path}/raw", "a1")
    w.write(rows("day=1/a.gz", "day=1/b.gz"))  # this attempt's message is lost
    good = w.write(rows("day=1/a.gz", "day=1/b.gz"))
    w.commit([good, None])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.gz")) == ["raw/day=1/a.gz", "raw/day=1/b.gz"] and not (tmp_path / "raw/_attempt-").exists() and not list(tmp_path.rglob("_attempt*"))
    w = bundles.BundleWriter(f"file://{tmp_path}/raw", "a2")
    w.abort([w.write(rows("day=1/c.gz"))])
    assert len(list(tmp_path.rglob("*.gz"))) == 2 and not (tmp_path / "raw/_attempt-a2").exists()


def test_posts_and_secrets(spark, tmp_path):
    (tmp_path / "u1.post").write_text(json.dumps({"format": "json", "content": {"a": 1}, "nym": "x"}))
    (tmp_path / "u2.post").write_text(json.dumps({"format": "yaml", "content": "a: 1"}))
    (tmp_path / "u3.post").write_text(json.dumps({"a": 2}))
    got = {r["measurement_uid"]: r["a"] for r in archives.posts(spark, f"{tmp_path}/*.post").select("measurement_uid", F.try_variant_get("v", "$.a", "int").alias("a")).collect()}
    assert got == {"u1": 1, "u3": 2}


def test_swap_and_export(spark, tmp_path):
    path = f"{tmp_path}/dim"
    assert archives.swapped(spark.range(5), path, 1, 10).count() == 5
    with pytest.raises(ValueError, match="expected"):
        archives.swapped(spark.range(50), path, 1, 10)
    assert archives.current(spark, path).count() == 5
    archives.export_months(catalog.msm(spark, SF).select("measurement_uid", "measurement_start_time"), f"{tmp_path}/months")
    assert [p.name for p in tmp_path.glob("months/yyyymm=*")] == ["yyyymm=202401"]
    (tmp_path / "f.csv").write_text("name,scope,pattern,confidence_no_fp,expected_countries\na,isp,x,5,\"it, zz,fr\"\nb,nat,y,odd,\n")
    got = [(r["name"], r["confidence_no_fp"], r["expected_countries"]) for r in archives.fingerprint_lists(spark, f"{tmp_path}/f.csv").orderBy("name").collect()]
    assert got == [("a", 5, ["FR", "IT"]), ("b", None, [])]


def test_lists(spark, tmp_path):
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists/global.csv").write_text("url,category_code\nhttp://a.org/,NEWS\nnot a url,NEWS\n")
    (tmp_path / "lists/it.csv").write_text("url,category_code\nhttp://b.org/,CULTR\n")
    assert sorted((r["url"], r["cc"]) for r in archives.url_lists(spark, f"{tmp_path}/lists", least=1).collect()) == [("http://a.org/", "ZZ"), ("http://b.org/", "IT")]
    (tmp_path / "asn.json").write_text('{"1": [["Org", "US", "20200101", "A", "x"], ["Old", "US", "20100101", "A", "x"]]}')
    assert archives.asn_names(spark, f"{tmp_path}/asn.json").count() == 2


KEYS = ["probe_cc", "input"]


def series_with_reports(spark):
    s = catalog.series(spark, SF)
    return s.select("probe_cc", "input", F.col("ts").cast("timestamp").alias("ts"), F.col("uid").cast("long").alias("uid"), F.col("x").cast("double").alias("x"), F.when(F.col("uid") % 7 != 0, F.concat(F.lit("r"), "uid")).alias("report_id"))


def plain_feed(rows, country=None):
    told = [r for r in rows if r["input"] and r["report_id"] and country in (None, r["probe_cc"])]
    return [(r["ts"], r["uid"], r["probe_cc"], r["input"], r["blocked"]) for r in sorted(told, key=lambda r: (r["ts"], r["uid"]), reverse=True)]


def test_feeds_and_snapshots_from_state(spark, tmp_path, monkeypatch):
    """Changes, monthly means and feeds equal the batch over a restart, and over a new checkpoint that begins with a snapshot and reads weeks again."""
    monkeypatch.setattr(feeds, "FEED", 5)
    monkeypatch.setattr(feeds.feed, "__defaults__", (5,))
    # four months: the series, moved on month by month
    one = series_with_reports(spark)
    s = one
    for k in range(1, 4):
        s = s.unionByName(one.where(f"uid % {k + 1} = 0").withColumns({"ts": F.expr(f"ts + interval {31 * k} days"), "uid": F.col("uid") + k * 1_000_000}))
    s = spark.createDataFrame(s.collect(), s.schema)
    means = detector.moving_average(s, KEYS)
    changes = detector.changes(means, KEYS).collect()
    assert len(changes) > 10
    sink, cut = f"{tmp_path}/out", "2024-02-20"

    def arrive(name, rows):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def run(name, state, to, restored=None):
        feeds.start(spark, spark.readStream.schema(s.schema).parquet(f"{tmp_path}/{name}"), to, state, KEYS, restored, once=True).awaitTermination(240)

    def same(to, state, want_changes):
        got = feeds.table(spark, to, feeds.CHANGES, KEYS).collect()
        as_set = lambda rows: sorted((r["probe_cc"], r["input"], r["ts"], r["uid"], r["blocked"]) for r in rows)
        assert as_set(got) == as_set(want_changes)

    arrive("in", s.where(F.col("ts") < cut))
    run("in", f"{tmp_path}/cp", sink)
    kept = feeds.state_of(spark, f"{tmp_path}/cp")
    kept = spark.createDataFrame(kept.collect(), kept.schema)  # the snapshot, as of the cut
    arrive("in", s.where(F.col("ts") >= cut))
    run("in", f"{tmp_path}/cp", sink)
    same(sink, f"{tmp_path}/cp", changes)
    for month in ("2024-02-01", "2024-03-01", "2024-04-01", "2024-06-01"):
        want = {(r["probe_cc"], r["input"]): round(r["mean"], 9) for r in detector.snapshot(means, KEYS, month).collect()}
        assert {(r["probe_cc"], r["input"]): round(r["mean"], 9) for r in feeds.snapshot(spark, sink, f"{tmp_path}/cp", month, KEYS).collect()} == want
    assert plain_feed(feeds.overall(spark, sink, KEYS, 5).collect()) == plain_feed(changes)[:5]
    for cc in {r["probe_cc"] for r in changes}:
        assert plain_feed(feeds.feeds(spark, sink, KEYS).collect(), cc) == plain_feed(changes, cc)[:5]
    # a new checkpoint from the snapshot, with six weeks read again: no event twice, none missed
    arrive("again", s.where(F.col("ts") >= F.expr(f"timestamp '{cut}' - interval 42 days")))
    run("again", f"{tmp_path}/cp2", f"{tmp_path}/out2", kept)
    same(f"{tmp_path}/out2", f"{tmp_path}/cp2", [r for r in changes if str(r["ts"]) >= cut])


def test_counters_are_equal_at_any_state_of_merging(spark, tmp_path, monkeypatch):
    """Stream, batch and replay; merges at any time; a batch that breaks before its commit and comes again; rows that are years late."""
    fact = catalog.msm(spark, SF).select(F.col("measurement_start_time").cast("timestamp").alias("measurement_start_time"), "probe_cc", F.col("probe_asn").cast("long").alias("probe_asn"), "input")
    fact = fact.unionByName(fact.limit(50).withColumn("measurement_start_time", F.expr("measurement_start_time - interval 900 days")))
    rows = fact.collect()
    sink = f"{tmp_path}/out"

    def same(sink_, n):
        want = summing.typed(summing.partial(spark.createDataFrame(rows[:n], fact.schema), "day"), "day")
        assert sorted(map(str, summing.read(spark, sink_).collect())) == sorted(map(str, want.collect()))

    def run(sink_, state):
        summing.start(spark, spark.readStream.schema(fact.schema).parquet(f"{tmp_path}/in"), sink_, f"{tmp_path}/{state}", once=True).awaitTermination(120)

    cuts = [0, 200, 500, 900, len(rows)]
    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        spark.createDataFrame(rows[a:z], fact.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 2:
            commit = Ledger.commit
            monkeypatch.setattr(Ledger, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(Exception, match="lost"):
                run(sink, "cp")
            same(sink, a)
            monkeypatch.setattr(Ledger, "commit", commit)
        run(sink, "cp")
        same(sink, z)
        summing.merge(spark, sink)
        same(sink, z)
    run(f"{tmp_path}/again", "cp2")  # the whole once more, in one batch
    same(f"{tmp_path}/again", len(rows))
