"""Bundles of measurements: files of JSON lines that close at the first line beyond a byte budget, named by what they hold, and where each line is.

The cuts of a group (day, hour, country, test) depend on one another: a bundle
begins where the one before closed. They are found without a pass over the group
in one task, and without bodies. Rows get their offset in bytes by sums of
range-sorted partitions. An offset at which a bundle may begin leads to the next
one; offsets are dealt into blocks of BLOCK budgets, and a block tells for each
offset at which it can be entered where the chain from there leaves it. Pointer
doubling over these few entries, in rounds that grow with the logarithm of the
blocks, tells where the group's own chain enters each block, and every block then
marks its cuts.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from netgauge.sources.blocks import BLOCK_BYTES, MOST, BlockFile, found_lines
from netgauge.sources.store import written

#: Bytes of lines after which a bundle is full.
BUNDLE_BYTES = 20_000_000
PARTS = ["day", "hour", "cc", "test"]
#: Budgets in a block of offsets.
BLOCK = 8
#: An offset that no bundle begins at.
NOWHERE = -1
#: Rows of blocks that a task gives on at once.
OUT_ROWS = 20_000
#: Characters of bodies that a fetch gives on at once.
OUT_CHARS = 2_000_000


def lines(measurements: DataFrame) -> DataFrame:
    """measurements(measurement_uid, day, hour, cc, test, body) -> with value (an unparsable body is `{}`), its size with a line end, a hash and a row number; written once."""
    value = F.when(F.try_parse_json("body").isNotNull(), F.translate("body", "\n", " ")).otherwise("{}")
    parts = [F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in PARTS]
    d = measurements.select(*parts, "measurement_uid", value.alias("value")).where("measurement_uid is not null")
    return written(d.withColumns({"size": F.octet_length("value") + 1, "hash": F.xxhash64("value"), "row": F.monotonically_increasing_id()}))


def changes(rows: pa.RecordBatch | pa.Table, n: int) -> np.ndarray:
    """The rows at which one of the first n columns (without nulls) isn't that of the row before, and the first row."""
    differ = np.ones(rows.num_rows, bool)
    differ[1:] = False
    for k in range(n):
        c = rows.column(k)
        differ[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
    return np.flatnonzero(differ)


def key_at(rows: pa.RecordBatch | pa.Table, i: int, n: int) -> tuple:
    return tuple(rows.column(k)[i].as_py() for k in range(n))


def offsets(rows: DataFrame) -> DataFrame:
    """rows(day, hour, cc, test, measurement_uid, size, hash, row), narrow -> one row of each uid (that of the smallest hash), with the bytes and rows of its group before it (before, idx)."""
    spark = rows.sparkSession
    once = rows.groupBy("measurement_uid").agg(F.min(F.struct("hash", "row", *PARTS, "size")).alias("m")).select("measurement_uid", "m.*").drop("hash")
    order, parts = [*PARTS, "measurement_uid"], int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, bytes_, n = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            size = np.asarray(b.column(b.schema.get_field_index("size"))).astype(np.int64)
            first = changes(b, 4)
            sums = np.concatenate([[0], np.cumsum(size)])
            run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(size))))
            before, idx = sums[:-1] - sums[first][run_of], np.arange(len(size)) - first[run_of]
            if key_at(b, 0, 4) == last:  # the group goes on from the batch before
                before, idx = before + np.where(run_of == 0, bytes_, 0), idx + np.where(run_of == 0, n, 0)
            last, bytes_, n = key_at(b, len(size) - 1, 4), int(before[-1] + size[-1]), int(idx[-1] + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(before), pa.array(idx)], [*b.schema.names, "part", "before", "idx"])

    columns = once.select(*PARTS, "measurement_uid", "row", F.col("size").cast("long").alias("size"))
    schema = "day string, hour string, cc string, test string, measurement_uid string, row long, size long, part int, before long, idx long"
    local = written(columns.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    totals = local.groupBy(*PARTS, "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*PARTS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only groups that go over a partition's edge: two rows a partition at most.
    moved = totals.select(*PARTS, "part", F.sum("bytes").over(earlier).alias("more_bytes"), F.sum("n").over(earlier).alias("more_n")).where("more_n is not null")
    j = local.join(F.broadcast(moved), [*PARTS, "part"], "left")
    return j.select(*PARTS, "measurement_uid", "row", "size", (F.col("before") + F.coalesce("more_bytes", F.lit(0))).alias("before"), (F.col("idx") + F.coalesce("more_n", F.lit(0))).alias("idx"))


def next_starts(before: np.ndarray, end: np.ndarray, budget: int) -> np.ndarray:
    """For each row at which a bundle begins: the row whose line closes it (or the number of rows)."""
    return np.searchsorted(end, before + budget, side="right")


def blockwise(rows: DataFrame, solve: Callable[[tuple, dict], dict | None], schema: str) -> DataFrame:
    """rows(day, hour, cc, test, block, before, ...) through solve(keys, columns) one block of a group at a time, in order of before. What solve gives goes on in batches of many blocks."""
    names = rows.columns

    def solved(held: pa.Table, cuts: list[int]) -> Iterator[tuple[tuple, dict]]:
        at = {c: held.column(c) for c in names[5:]}
        at = {c: v.combine_chunks() if pa.types.is_string(v.type) else v.to_numpy() for c, v in at.items()}
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            keys = key_at(held, a, 5)
            if out := solve(keys, {c: v[a:z] for c, v in at.items()}):
                yield keys, out

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            cuts = changes(held, 5).tolist()
            yield from solved(held, cuts)
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from solved(held, [0, held.num_rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for block in blocks(batches):
            some.append(block)
            n += len(next(iter(block[1].values())))
            if n > OUT_ROWS:
                yield keyed(some)
                some, n = [], 0
        if some:
            yield keyed(some)

    order = [*PARTS, "block"]
    return rows.repartition(*order).sortWithinPartitions(*order, "before").select(*names).mapInArrow(run, schema)


KEYS = "day string, hour string, cc string, test string, block long"


def keyed(some: list[tuple[tuple, dict]]) -> pa.RecordBatch:
    """The columns of many blocks, below their keys."""
    names = list(some[0][1])
    of = pa.array(np.repeat(np.arange(len(some)), [len(x[names[0]]) for _, x in some]))
    heads = [pa.array([keys[k] for keys, _ in some], pa.int64() if k == 4 else pa.string()).take(of) for k in range(5)]
    parts = [[x[c] for _, x in some] for c in names]
    return pa.RecordBatch.from_arrays([*heads, *(pa.concat_arrays(p) if isinstance(p[0], pa.Array) else pa.array(np.concatenate(p)) for p in parts)], [*PARTS, "block", *names])


def entries(rows: DataFrame, budget: int) -> DataFrame:
    """offsets rows with their block -> day, hour, cc, test, block, entry: the first cut in each block that has one; and (last, last_idx): the block's last cut."""
    width = BLOCK * budget
    large = rows.groupBy(*PARTS).agg(F.max("block").alias("top")).where("top > 0").drop("top")
    some = rows.join(large, PARTS)
    near = F.when((F.col("block") > 0) & (F.col("before") - F.col("block") * width <= budget), F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block"))

    def solve(keys: tuple, t: dict) -> dict | None:
        """Where the chain from each offset at which the block can be entered leaves it."""
        before, size, idx = t["before"], t["size"], t["idx"]
        low, high = keys[4] * width, (keys[4] + 1) * width
        end, own = before + size, int(np.searchsorted(before, high))
        if not own or before[own - 1] < low:
            return None
        close = next_starts(before[:own], end, budget)
        target = np.where(close < len(end), end[np.minimum(close, len(end) - 1)], NOWHERE)
        leaves, last = np.full(own, NOWHERE, np.int64), np.arange(own)
        for i in range(own - 1, -1, -1):
            k = close[i] + 1
            if target[i] == NOWHERE or target[i] >= high:
                leaves[i] = target[i]
            elif k < own:
                leaves[i], last[i] = leaves[k], last[k]
        first = int(np.searchsorted(before, low))
        can = np.arange(first, own) if keys[4] == 0 else np.arange(first, min(own, int(np.searchsorted(before, low + budget, side="right")) + 1))
        return {"entry": before[can], "leaves": leaves[can], "last": before[last[can]], "last_idx": idx[last[can]]}

    dealt = some.select(*PARTS, F.explode(near).alias("block"), "before", "size", "idx")
    steps = written(blockwise(dealt, solve, f"{KEYS}, entry long, leaves long, last long, last_idx long"))
    hop = steps.select(*PARTS, "entry", "leaves")
    reached = written(hop.where("entry = 0").select(*PARTS, "entry"))
    while True:
        more = written(reached.join(hop, [*PARTS, "entry"]).where(F.col("leaves") != NOWHERE).select(*PARTS, F.col("leaves").alias("entry")).join(reached, [*PARTS, "entry"], "left_anti"))
        if more.isEmpty():
            break
        reached = written(reached.unionByName(more))
        hop = written(hop.join(hop.select(*PARTS, F.col("entry").alias("leaves"), F.col("leaves").alias("further")), [*PARTS, "leaves"]).select(*PARTS, "entry", F.col("further").alias("leaves")))
    return steps.drop("leaves").join(reached, [*PARTS, "entry"])


def placed(rows: DataFrame, budget: int = BUNDLE_BYTES) -> DataFrame:
    """offsets rows -> day, hour, cc, test, measurement_uid, row, bundle (0, 1, ... of the group) and linenum (0-based within it)."""
    rows = written(rows.withColumn("block", F.floor(F.col("before") / (BLOCK * budget))))
    into = written(entries(rows, budget))
    own = into.select(*PARTS, "block", "entry")
    carried = into.select(*PARTS, (F.col("block") + 1).alias("block"), F.col("last").alias("carry"), F.col("last_idx").alias("carry_idx"))
    joined = rows.join(own, [*PARTS, "block"], "left").join(carried, [*PARTS, "block"], "left")
    # A group of one block is entered at 0; a block without an entry has no cut.
    joined = joined.withColumn("entry", F.coalesce("entry", F.when(F.col("block") == 0, 0).otherwise(F.lit(None)), F.lit(1 << 62)).cast("long"))
    joined = joined.select(*PARTS, "block", "before", "size", "idx", "row", "measurement_uid", "entry", F.coalesce("carry", F.lit(NOWHERE)).alias("carry"), F.coalesce("carry_idx", F.lit(NOWHERE)).alias("carry_idx"))

    def solve(keys: tuple, t: dict) -> dict:
        before, size, idx, entry, carry, carry_idx = (t[c] for c in ("before", "size", "idx", "entry", "carry", "carry_idx"))
        close = next_starts(before, before + size, budget)
        at, starts = int(np.searchsorted(before, entry[0])), []
        while at < len(before):
            starts.append(at)
            at = int(close[at]) + 1
        starts = np.asarray(starts, np.int64)
        of = np.searchsorted(starts, np.arange(len(before)), side="right") - 1
        begins = np.where(of >= 0, before[starts[np.maximum(of, 0)]] if len(starts) else 0, carry)
        line = idx - np.where(of >= 0, idx[starts[np.maximum(of, 0)]] if len(starts) else 0, carry_idx)
        return {"row": t["row"], "measurement_uid": t["measurement_uid"], "begins": begins, "linenum": line}

    cut = written(blockwise(joined, solve, f"{KEYS}, row long, measurement_uid string, begins long, linenum long"))
    # A row a bundle.
    number = cut.where("linenum = 0").select(*PARTS, "begins", (F.row_number().over(Window.partitionBy(*PARTS).orderBy("begins")) - 1).alias("bundle"))
    return cut.join(number, [*PARTS, "begins"]).select("row", *PARTS, F.col("bundle").cast("long").alias("bundle"), F.col("linenum").cast("int").alias("linenum"), "measurement_uid")


def bundled(measurements: DataFrame, budget: int = BUNDLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """measurements(measurement_uid, day, hour, cc, test, body) -> their lines, written once, and the place of one line of each uid."""
    stored = lines(measurements)
    return stored, written(placed(offsets(stored.drop("value")), budget))


def named(places: DataFrame) -> DataFrame:
    """places -> day, hour, cc, test, bundle, n, name: the hash of a bundle's uids. A bundle's bytes bound the list."""
    b = places.groupBy(*PARTS, "bundle").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("measurement_uid")).alias("uids"))
    return b.select(*PARTS, "bundle", "n", F.sha2(F.array_join("uids", "\n"), 256).alias("name"))


def file_of(name: Column) -> Column:
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), k) for k in PARTS])
    return F.concat(folder, F.lit("/"), F.lpad(F.col("bundle").cast("string"), 6, "0"), F.lit("-"), F.substring(name, 1, 32), F.lit(".jsonl.gz"))


def opened(path: str) -> tuple[object, str]:
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Moved(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class BundleWriter(DataSourceArrowWriter):
    """Two phases: tasks write files under names of their attempt, the commit gives those of successful attempts their own names."""

    def __init__(self, path: str, attempt: str, block: int = BLOCK_BYTES):
        self.path, self.attempt, self.block = path.rstrip("/"), attempt, block

    def files(self) -> tuple[object, str]:
        return opened(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = self.files()
        folder = f"{root}/_attempt-{self.attempt}/{uuid.uuid4().hex}"
        out, done = None, []
        for b in iterator:
            for name, value in zip(b.column(b.schema.get_field_index("file")).to_pylist(), b.column(b.schema.get_field_index("value")).to_pylist(), strict=True):
                if not done or done[-1][1] != name:
                    if out:
                        out.close()
                    if not done:
                        fs.create_dir(folder)
                    done.append((f"{folder}/{len(done)}", name))
                    out = BlockFile(fs.open_output_stream(done[-1][0], compression=None), self.block)
                out.add(value.encode())
        if out:
            out.close()
        return Moved(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = self.files()
        made = set()
        for m in messages:
            for attempt, name in m.files if m else ():
                folder = f"{root}/{name}".rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder)
                    made.add(folder)
                fs.move(attempt, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileType

        fs, root = self.files()
        if fs.get_file_info(f"{root}/_attempt-{self.attempt}").type == FileType.Directory:
            fs.delete_dir(f"{root}/_attempt-{self.attempt}")


class BundleFiles(DataSource):
    """Rows (file, value), sorted by file within a partition, each file within one partition -> gzipped lines in blocks."""

    @classmethod
    def name(cls) -> str:
        return "bundle_files"

    def writer(self, schema: object, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"], self.options["attempt"], int(self.options["block"]))


def write_bundles(measurements: DataFrame, path: str, budget: int = BUNDLE_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """Writes the bundles' files below path; returns the locators (measurement_uid, report_id, input, s3path, linenum) of what was written.

    The same measurements give the same files and locators, in whatever order and
    however often they come. Bodies are shuffled once, to their bundles.
    """
    spark = measurements.sparkSession
    spark.dataSource.register(BundleFiles)
    stored, places = bundled(measurements, budget)
    where = written(places.join(named(places).select(*PARTS, "bundle", "name"), [*PARTS, "bundle"]).select("row", "measurement_uid", file_of(F.col("name")).alias("file"), "linenum"))
    rows = stored.select("row", "value").join(where.select("row", "file", "linenum"), "row").repartition("file").sortWithinPartitions("file", "linenum").select("file", "value")
    rows.write.format("bundle_files").option("attempt", uuid.uuid4().hex).option("path", path).option("block", max(block, budget // (MOST // 2))).mode("append").save()
    v = F.try_parse_json("value")
    head = stored.select("row", *[F.coalesce(F.try_variant_get(v, f"$.{c}", "string"), F.lit("")).alias(c) for c in ("report_id", "input")])
    return where.join(head, "row").select("measurement_uid", "report_id", "input", F.col("file").alias("s3path"), "linenum")


def settled(measurements: DataFrame, as_of: str) -> DataFrame:
    """Only hours that ended an hour ago are bundled."""
    hour = F.to_timestamp(F.concat(F.col("day"), F.col("hour")), "yyyyMMddHH")
    return measurements.where(hour + F.expr("interval 2 hours") <= F.lit(as_of).cast("timestamp"))


def bodies(spark: SparkSession, path: str, locators: DataFrame) -> DataFrame:
    """locators(measurement_uid, s3path, linenum) -> measurement_uid, body: the lines they point to.

    Locators meet at their bundle; of each bundle its index and the blocks with
    wanted lines are read, once each. Locators beyond a bundle's last line, or
    with a null, give no row; a bundle that isn't there is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(path.rstrip("/"))
        for name, rows in runs(batches):
            with fs.open_input_file(f"{root}/{name}") as file:
                uids: deque[str] = deque()
                out: list[tuple[str, str]] = []
                held = 0

                def numbers_of(rows: Iterator[tuple[str, int]] = rows, uids: deque[str] = uids) -> Iterator[int]:
                    for uid, n in rows:
                        uids.append(uid)
                        yield n

                for line in found_lines(file, numbers_of()):
                    uid = uids.popleft()
                    if line is not None:
                        out.append((uid, line))
                        held += len(line)
                    if held > OUT_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["measurement_uid", "body"])
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["measurement_uid", "body"])

    wanted = locators.select(F.col("measurement_uid").cast("string"), "s3path", F.col("linenum").cast("long").alias("linenum")).where("s3path is not null and linenum >= 0")
    return wanted.repartition("s3path").sortWithinPartitions("s3path", "linenum").mapInArrow(run, "measurement_uid string, body string")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple[str, int]]]]:
    """Batches of (uid, file, line) in order of file -> each file with its (uid, line), as they come."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for name, some in groupby(rows, key=lambda r: r[1]):
        yield name, ((uid, n) for uid, _, n in some)
