"""Lookups, ids and archive upkeep on rows small enough to read."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from netgauge.functions import legacy
from netgauge.operators import lookup
from netgauge.sources import archives
from netgauge.streaming.ingest import Refreshed


def test_trivial_id(spark):
    d = spark.createDataFrame([(bytearray(), "2021-02-03 00:00:00"), (bytearray(), "soon"), (None, None)], "raw binary, t string")
    ids = [r[0] for r in d.select(legacy.trivial_id(F.col("raw"), F.col("t"))).collect()]
    assert ids == ["01202102037f9c2ba4e88f827d61604550760585", "01000000007f9c2ba4e88f827d61604550760585", "01000000007f9c2ba4e88f827d61604550760585"]


def test_ip_number(spark):
    d = spark.createDataFrame([("1.2.3.4",), ("1.2.3",), ("1.2.3.256",), ("::1",), (None,)], "ip string")
    assert [r[0] for r in d.select(lookup.ip_number(F.col("ip"))).collect()] == [16909060, None, None, None, None]


def test_located_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "0.0.0.5"), (2, "0.1.0.0"), (3, None), (4, "x"), (5, "0.0.0.5")], "id int, ip string")
    ranges = spark.createDataFrame([(0, 9, "IT", 7, "Org"), (65000, 70000, "FR", 8, "Other")], "first long, last long, cc string, asn long, org string")
    got = {r["id"]: (r["geo_cc"], r["geo_asn"]) for r in lookup.located(rows, ranges).collect()}
    assert got == {1: ("IT", 7), 2: ("FR", 8), 3: ("ZZ", 0), 4: ("ZZ", 0), 5: ("IT", 7)}


def test_located_in_numbers_beyond_ipv4(spark):
    """A number of more than 32 bits is no address: its range holds none, one that only reaches there ends at the last."""
    rows = spark.createDataFrame([(1, "16.0.0.5"), (2, "255.255.255.255"), (3, "0.0.0.1"), (4, "0.0.0.9")], "id int, ip string")
    ranges = spark.createDataFrame([(1 << 32, (1 << 32) + 99, "FAR", 1, ""), ((1 << 32) - 10, (1 << 32) + 20, "END", 2, ""), (-5, 3, "LOW", 3, "")], "first long, last long, cc string, asn long, org string")
    assert {r["id"]: r["geo_cc"] for r in lookup.located(rows, ranges).collect()} == {1: "ZZ", 2: "END", 3: "LOW", 4: "ZZ"}


def test_both_families_with_many_suppliers(spark, tmp_path):
    """Ranges beyond 32 bits don't come round to the small ones (8,590 suppliers and more, as at 60 times sf0.1)."""
    import duckdb

    from netgauge import catalog

    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    n = s.count()
    many = s.crossJoin(spark.range(60_000 // n).withColumnRenamed("id", "k")).withColumn("s_suppkey", F.col("s_suppkey") + F.col("k") * n)
    many.drop("k").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["j15_both_families"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for t in ("events", "supplier"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(catalog.oracle_sql()["j15_both_families"]).fetchall())


def test_addresses_sort_as_they_are(spark):
    """Keys are Python's addresses, in any form, and null where Python refuses."""
    import ipaddress
    import random

    rng = random.Random(1)
    texts = ["::", "::1", "1::", "2001:DB8::1", "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1::8", "1:2:3:4:5:6:7", ":::", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "12345::", "g::", "::ffff:1.2.3.256", "1.2.3.4", "255.255.255.255", "1:2:3:4:5:6:7::", "", "x"]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(200)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(50)]
    got = {r["ip"]: r["k"] for r in spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", lookup.address_key(F.col("ip")).alias("k")).collect()}
    for t in texts:
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            assert got[t] is None, t
            continue
        a = getattr(a, "ipv4_mapped", None) or a
        assert got[t] == f"{a.version}{int(a):0{a.max_prefixlen // 4}x}", t


def test_located_in_ranges_of_any_length(spark):
    """The whole of a family is one range; ranges go on over partitions; families don't mix."""
    import ipaddress
    import random

    rng = random.Random(2)
    rows = [(i, str(ipaddress.IPv4Address(rng.getrandbits(32)) if i % 2 else ipaddress.IPv6Address(rng.getrandbits(128)))) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, ip string")
    ranges = lambda *r: spark.createDataFrame(list(r), "first string, last string, cc string, asn long, org string")
    got = {r["id"]: r["geo_cc"] for r in lookup.located(df, ranges(("0.0.0.0", "255.255.255.255", "AA", 1, ""))).collect()}
    assert got == {i: "AA" if i % 2 else "ZZ" for i, _ in rows}
    cut = [0, 1 << 125, 1 << 126, (1 << 126) + 5, 1 << 127, 1 << 128]
    r = [(str(ipaddress.IPv6Address(a)), str(ipaddress.IPv6Address(z - 1)), f"C{k}", k, "") for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if k != 2]
    got = {x["id"]: x["geo_asn"] for x in lookup.located(df, ranges(*r)).collect()}
    want = {i: 0 if i % 2 else next((k for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a <= int(ipaddress.ip_address(ip)) < z and k != 2), 0) for i, ip in rows}
    assert got == want


def test_body_matches(spark):
    bodies = spark.createDataFrame([("a", "blocked by law, blocked"), ("b", None), ("c", "")], "uid string, body string")
    prints = spark.createDataFrame([("one", "blocked"), ("two", "locked by"), ("empty", "")], "name string, pattern string")
    assert sorted(map(tuple, lookup.body_matches(bodies, prints).collect())) == [("a", "one"), ("a", "two")]
    assert lookup.body_matches(bodies, prints.where("false")).count() == 0


def test_decoded(spark):
    text = base64.b64encode(b"hello").decode()
    d = spark.createDataFrame([(text, "base64"), (text, None)], "v string, f string")
    assert [r[0] for r in d.select(lookup.decoded(F.col("v"), F.col("f"))).collect()] == ["hello", text]


def test_sync_moves_its_watermark(spark, tmp_path):
    fact = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(10)], "uid long, input string")
    assert archives.sync(fact, "uid", -1, 6, f"{tmp_path}/t") == 5
    assert archives.sync(fact, "uid", 5, 100, f"{tmp_path}/t") == 9
    assert archives.sync(fact, "uid", 9, 100, f"{tmp_path}/t") == 9
    rows = spark.read.parquet(f"{tmp_path}/t")
    assert (rows.count(), rows.where("input = ''").count()) == (10, 5)


def test_exports(spark, tmp_path):
    d = spark.range(10).select((F.col("id") + 1).alias("b"), F.col("id").alias("a"))
    archives.export_result(d.coalesce(1), f"{tmp_path}/r")
    assert next(tmp_path.glob("r/*.csv")).read_text().startswith("a,b\n")
    archives.export_result(d.limit(0), f"{tmp_path}/none")
    assert "".join(p.read_text() for p in tmp_path.glob("none/*.csv")) == ""
    d.createOrReplaceTempView("small_table")
    archives.export_table(spark, "small_table", f"{tmp_path}/t")
    assert next(tmp_path.glob("t/*.csv")).read_text().startswith("b,a\n1,0\n")
    archives.export_chunks(d.coalesce(1), f"{tmp_path}/c", rows=4)
    assert len(list(tmp_path.glob("c/*.gz"))) == 3


def test_posts_are_replayed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.post").write_text('{"format": "json"}')
    q = archives.replayed_posts(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("replayed").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r[0] for r in spark.table("replayed").collect()] == ['{"format": "json"}']


def test_refresh_keeps_the_old_copy(spark):
    now, loads = [0.0], []

    def load():
        loads.append(1)
        if len(loads) == 2:
            raise OSError("away")
        return spark.range(len(loads))

    table = Refreshed(load, 10, lambda: now[0])
    assert table().count() == 1
    now[0] = 11
    assert table().count() == 1
    assert table().count() == 3
    with pytest.raises(OSError):
        Refreshed(lambda: (_ for _ in ()).throw(OSError("away")))


def test_simhash_of_known_texts(spark):
    from netgauge.functions.legacy import simhash

    d = spark.createDataFrame([(1, ""), (2, "hello"), (3, None)], "id long, text string")
    got = {r["id"]: r["simhash"] % (1 << 64) for r in simhash(d, "id", "text").collect()}
    assert got == {1: 16825458760271544958, 2: 36330143249342482, 3: 16825458760271544958}


def test_simhash_keeps_shingles_in_their_task(spark):
    """Any characters and lengths, equal keys together; what is shuffled is a row a text, not one a shingle."""
    import hashlib
    import random

    rng = random.Random(3)
    texts = ["", "ab", None, "\U0001f600é語x", *("".join(rng.choices("abAé語𐐷 9_-", k=rng.choice((3, 4, 5, 700)))) for _ in range(60))]
    rows = [(i % 50, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "id long, text string")
    joined = {}
    clean = d.select("id", F.concat_ws("", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))).alias("t")).collect()
    for key, t in clean:
        joined.setdefault(key, []).append(t)
    want = {}
    for key, ts in joined.items():
        sums = [0] * 64
        for t in ts:
            for k in range(max(1, len(t) - 3)):
                low = int.from_bytes(hashlib.md5(t[k : k + 4].encode()).digest()[8:], "big")
                sums = [s + (1 if low >> i & 1 else -1) for i, s in enumerate(sums)]
        want[key] = sum(1 << i for i, s in enumerate(sums) if s > 0)
    out = legacy.simhash(d, "id", "text")
    assert {r["id"]: r["simhash"] % (1 << 64) for r in out.collect()} == want
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_bundles_go_on_together():
    """Small blocks leave a task in one batch, in order; a change in any key begins a block."""
    import numpy as np
    import pyarrow as pa

    from netgauge.sources import bundles

    keys = [("d", "h", "c", "t", k) for k in range(50)]
    out = bundles.keyed([(k, {"row": np.arange(k[4] % 3), "measurement_uid": pa.array([str(k[4])] * (k[4] % 3), pa.string())}) for k in keys])
    assert out.num_rows == sum(k % 3 for k in range(50))
    assert [(r["block"], r["row"], r["measurement_uid"]) for r in out.to_pylist()] == [(k, i, str(k)) for k in range(50) for i in range(k % 3)]
    assert np.diff(np.append(bundles.changes(out, 5), out.num_rows)).tolist() == [k % 3 for k in range(50) if k % 3]


def test_measurement_uid(spark):
    import hashlib

    from netgauge.functions.scalar import measurement_uid

    r = spark.sql("select timestamp '2024-01-02 03:04:05.123456' as t, 'IT' as cc, 'web_connectivity' as test, 'body' as b").select(measurement_uid(*map(F.col, ("t", "cc", "test", "b"))).alias("u")).first()
    assert r["u"] == "20240102030405.123456_IT_webconnectivity_" + hashlib.sha512(b"body").hexdigest()[:16]


def test_edits_that_do_nothing_are_refused(spark):
    from netgauge.operators.versioned import edited_list

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "url string, n int")
    assert sorted(map(tuple, edited_list(rows, rows.where("n = 1"), spark.createDataFrame([("c", 3)], rows.schema)).collect())) == [("b", 2), ("c", 3)]
    with pytest.raises(ValueError, match="isn't in the list"):
        edited_list(rows, spark.createDataFrame([("z", 1)], rows.schema), rows)
    with pytest.raises(ValueError, match="changes nothing"):
        edited_list(rows, rows.where("n = 1"), rows.where("n = 1"))


def test_legacy_report_id(spark):
    import hashlib
    import string

    r = spark.sql("select timestamp '2014-01-02 03:04:05' as t, 'IT' as cc, 'AS1' as asn, 'dnst' as test, cast(null as string) as v, 'Rome' as city").select(legacy.legacy_report_id(*map(F.col, ("t", "cc", "asn", "test", "v", "city"))).alias("r")).first()
    digest = hashlib.sha512(b"ITAS1dnst0.0.0Rome").digest()
    assert r["r"] == "20140102T030405Z_" + "".join(string.ascii_letters[b % 52] for b in digest)[:50]
