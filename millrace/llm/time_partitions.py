"""Adaptive time partitions: a table as Parquet files, one for each run of calendar units that fits a limit of rows.

The years from the first to the last moment are siblings. A node of more than ``limit`` rows splits into all its months,
days or hours. Siblings within the limit, empty ones too, are grouped into runs in time order: each joins the directly
preceding one's run where that stays within the limit, else starts one. Leaves are the runs that hold rows, the hours
above the limit, and all rows without a moment. A leaf's rows, in order, fill parts of ``limit`` rows, one file each.

Runs are found for all parents at once: cumulative counts give for each sibling where the run that it would start must
end (its next start, by one sorted pass over the counts and the bounds that they are compared with); pointer doubling by
self-joins marks the starts that are reached from the first sibling of each stretch; the last start up to a sibling,
a window of its parent, is its run.

Rows are sorted once, by range, into a copy in the shared folder, so a row's rank is its partition's offset plus its
place. Leaves follow each other in that order, so a file is an interval of ranks: rows meet files by an equi-join on
rank / limit, whose keys have ``limit`` rows each, and files that overlap such a bucket are few. Ties are broken by a hash
of the row and then by chance, so a moment, or a row, that a third of the table repeats is dealt to many tasks.

``rewrite`` leaves alone the files whose leaf, part and rows (number and two 64-bit sums of hashes) recur, writes the
others and removes those that no leaf has any more.

Defined cases: null moments form the leaf ``null``; null order columns sort last; repeated rows are kept, each as a row;
a null identifier is spelled null in the digest of a file's identifiers; an empty table gives no files; columns of any
name pass through, in the table's order. The number of siblings of a parent is bounded by the calendar.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, cut, free_names, shared_dir, table
from millrace.llm.store import attempt_name, located, publish, remove, saved

UNITS = ("y", "m", "d", "h")
NONE = -1
MANIFEST = "leaf string, part long, path string, n_rows long, n_new long, ids_sha256 string, a decimal(38,0), b decimal(38,0)"


def unit_counts(rows: DataFrame, moment: Column) -> DataFrame:
    """Rows (level, y, m, d, h, n): the number of rows of each year, month, day and hour that holds any; units below are -1.

    The hour's fields come straight from the value, so no time zone moves them.
    """
    parts = dict(zip(UNITS, (F.year, F.month, F.dayofmonth, F.hour), strict=True))
    hours = rows.where(moment.isNotNull()).select(*(f(moment).alias(u) for u, f in parts.items())).groupBy(*UNITS).agg(F.count("*").alias("n"))
    rolled = hours.rollup(*UNITS).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    level = F.element_at(F.create_map(*(F.lit(x).cast("long") for x in (7, 1, 3, 2, 1, 3, 0, 4))), F.col("g"))
    return cut(rolled.where("g <> 15").select(level.cast("int").alias("level"), *(F.coalesce(u, F.lit(NONE)).alias(u) for u in UNITS), "n"))


def siblings(counts: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Rows (level, y, m, d, h, parent, pos, n) of all children of split nodes and of the root, empty ones too; and the most that a parent has."""
    first, last = counts.where("level = 1").agg(F.min("y"), F.max("y")).first()
    spark = counts.sparkSession
    if first is None:
        first, last = 0, -1
    years = spark.range(first, last + 1).select(F.lit(1).alias("level"), F.col("id").cast("int").alias("y"), *(F.lit(NONE).alias(u) for u in UNITS[1:]), F.lit("").alias("parent"), F.col("id").cast("int").alias("pos"))
    days = F.dayofmonth(F.last_day(F.make_date("y", F.greatest("m", F.lit(1)), F.lit(1))))
    low, high = F.when(F.col("level") < 3, 1).otherwise(0), F.when(F.col("level") == 1, 12).when(F.col("level") == 2, days).otherwise(23)
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    name = F.concat_ws("/", F.lpad(F.col("y").cast("string"), 4, "0"), F.when(F.col("level") > 1, two("m")), F.when(F.col("level") > 2, two("d")))
    split = counts.where((F.col("level") < 4) & (F.col("n") > limit)).select("level", *UNITS, name.alias("parent"), F.explode(F.sequence(low, high)).alias("pos"))
    at = lambda k: F.when(F.col("level") == k, F.col("pos")).otherwise(F.col(UNITS[k])).alias(UNITS[k])
    lower = split.select((F.col("level") + 1).alias("level"), "y", at(1), at(2), at(3), "parent", "pos")
    known = ["level", *UNITS]
    out = years.unionByName(lower).join(counts, known, "left").select(*known, "parent", "pos", F.coalesce("n", F.lit(0)).alias("n"))
    return out, max(31, last + 1 - first)


def next_starts(within: DataFrame, limit: int) -> DataFrame:
    """Rows (parent, pos, n, next, reached) for siblings within the limit, of rows (parent, pos, n, total, stretch).

    total is the cumulative count of the parent. The run that starts at a sibling ends before the first sibling whose
    cumulative count passes that before the start by more than the limit.
    """
    point, bound = F.struct(F.col("total").alias("at"), F.lit(0).alias("asks")), F.struct((F.col("total") - F.col("n") + limit + 1).alias("at"), F.lit(1).alias("asks"))
    events = within.select("parent", "stretch", "pos", "n", F.explode(F.array(point, bound)).alias("e")).select("parent", "stretch", "pos", "n", "e.at", "e.asks")
    stretch = Window.partitionBy("parent", "stretch")
    from_above = stretch.orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = events.select("parent", "pos", "n", "asks", F.min(F.when(F.col("asks") == 0, F.col("pos"))).over(from_above).alias("next"), (F.col("pos") == F.min("pos").over(stretch)).alias("reached"))
    return found.where("asks = 1").drop("asks")


def reached_starts(steps: DataFrame, most: int) -> DataFrame:
    """Rows (parent, pos, n, reached): pointer doubling over next, for at most ``most`` siblings of a parent.

    After k rounds, reached covers the first 2 ** k starts of each stretch and next leaps 2 ** k starts.
    """
    steps = cut(steps)
    for _ in range(most.bit_length()):
        hit = steps.where("reached and next is not null").select("parent", F.col("next").alias("pos"), F.lit(True).alias("hit"))
        leap = steps.select("parent", F.col("pos").alias("next"), F.col("next").alias("leap"))
        steps = steps.join(hit, ["parent", "pos"], "left").join(leap, ["parent", "next"], "left")
        steps = cut(steps.select("parent", "pos", "n", F.col("leap").alias("next"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")))
    return steps.select("parent", "pos", "n", "reached")


def leaves(rows: DataFrame, moment: Column, limit: int) -> DataFrame:
    """Rows (leaf, n, start): each leaf with its number of rows and the rank of its first row."""
    found, most = siblings(unit_counts(rows, moment), limit)
    of_parent = Window.partitionBy("parent").orderBy("pos")
    total = lambda c: F.sum(c).over(of_parent.rowsBetween(Window.unboundedPreceding, 0))
    found = cut(found.withColumn("over", F.col("n") > limit).withColumn("total", total("n")).withColumn("stretch", total(F.col("over").cast("int"))))
    marked = reached_starts(next_starts(found.where("not over").select("parent", "pos", "n", "total", "stretch"), limit), most)
    start = F.last(F.when(F.col("reached"), F.col("pos")), ignorenulls=True).over(of_parent.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("first", start).groupBy("parent", "first").agg(F.max("pos").alias("last"), F.sum("n").alias("n"))
    runs = runs.unionByName(found.where("over and level = 4").select("parent", F.col("pos").alias("first"), F.col("pos").alias("last"), "n")).where("n > 0")
    root = F.col("parent") == ""
    spelled = lambda c: F.lpad(F.col(c).cast("string"), F.when(root, 4).otherwise(2), F.lit("0"))
    leaf = F.concat(F.when(root, "").otherwise(F.concat("parent", F.lit("/"))), spelled("first"), F.lit("-"), spelled("last"))
    # in time order: the year of the first member, then the parent's and the member's place below it
    year = F.when(root, F.col("first")).otherwise(F.split("parent", "/")[0].cast("int"))
    named = cut(runs.select(leaf.alias("leaf"), year.alias("year"), F.concat_ws("/", F.when(~root, F.col("parent")), spelled("first")).alias("place"), "n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    years = named.groupBy("year").agg(F.sum("n").alias("n")).select("year", before(Window.orderBy("year")).alias("earlier"))  # calendar years only
    timed = named.withColumn("inside", before(Window.partitionBy("year").orderBy("place"))).join(years, "year").select("leaf", "n", (F.col("earlier") + F.col("inside")).alias("start"))
    untimed = rows.agg(F.count("*").alias("all"), F.count(F.when(moment.isNull(), 1)).alias("n")).where("n > 0").select(F.lit("null").alias("leaf"), "n", (F.col("all") - F.col("n")).alias("start"))
    return timed.unionByName(untimed)


def files_of(found: DataFrame, limit: int) -> DataFrame:
    """Rows (leaf, part, start, n): parts of ``limit`` rows of each leaf."""
    parts = found.select("leaf", "n", "start", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n") / limit))).alias("part"))
    before = (F.col("part") - 1) * limit
    return parts.select("leaf", "part", (F.col("start") + before).alias("start"), F.least(F.lit(limit), F.col("n") - before).alias("n"))


class Sorted:
    """A table's rows in the order of moment and ``order``, kept in ``folder``, with the rank of each."""

    def __init__(self, rows: DataFrame, moment: Column, order: list[str], folder: str):
        self.columns, self.moment, self.folder = rows.columns, moment, folder
        self.at, self.rank, self.file, a, tie, chance = free_names(rows.columns, "at", "rank", "file", "moment", "tie", "chance")
        self.hashed = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind]
        keys = [F.col(a).asc_nulls_last(), *(F.col(f"`{c}`").asc_nulls_last() for c in order), tie, chance]
        keyed = rows.select("*", moment.alias(a), F.xxhash64(*self.hashed).alias(tie), F.rand(11).alias(chance))
        placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(a, tie, chance).withColumn(self.at, F.monotonically_increasing_id())
        self.rows = saved(placed, f"{folder}/sorted")
        # a row for each partition of the copy
        sizes = self.rows.groupBy(F.shiftright(self.at, 33).alias("p")).agg(F.count("*").alias("n"))
        self.offsets = saved(sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")), f"{folder}/offsets")

    def dealt(self, files: DataFrame, limit: int, name: str) -> DataFrame:
        """The rows with their rank and their file, a struct of start and all other columns of files."""
        rest = [c for c in files.columns if c not in ("start", "n")]
        ends = F.array_distinct(F.array(F.floor(F.col("start") / limit), F.floor((F.col("start") + F.col("n") - 1) / limit)))
        near = files.select(F.explode(ends).alias("bucket"), F.struct("start", *rest).alias("file")).groupBy("bucket").agg(F.array_sort(F.collect_list("file")).alias("files"))
        near = saved(near, f"{self.folder}/{name}")
        p, offset, bucket, of = free_names([*self.rows.columns, self.rank, self.file], "p", "offset", "bucket", "files")
        place = F.col(self.at).bitwiseAND((1 << 33) - 1)
        ranked = self.rows.withColumn(p, F.shiftright(self.at, 33)).join(self.offsets.select(F.col("p").alias(p), F.col("offset").alias(offset)), p)
        ranked = ranked.withColumn(self.rank, F.col(offset) + place).drop(p, offset, self.at).withColumn(bucket, F.floor(F.col(self.rank) / limit))
        met = ranked.join(near.select(F.col("bucket").alias(bucket), F.col("files").alias(of)), bucket)
        file = F.element_at(F.filter(of, lambda f: f["start"] <= F.col(self.rank)), -1)
        return met.withColumn(self.file, file).drop(bucket, of)


def _hashes(columns: list[Column]) -> tuple[Column, Column]:
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def _writer(out: str, layout: str, n_columns: int, id_place: int, held_bytes: int = 32 << 20):
    """Streams rows that are sorted by file into Parquet files; extra columns: leaf, part, is_new, a, b."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, root = located(out)
        store.create_dir(f"{root}/data", recursive=True)
        store.create_dir(f"{root}/attempts", recursive=True)
        now = None

        class File:
            def __init__(self, key, schema):
                self.key, self.name, self.attempt = key, f"{key[0].replace('/', '_')}.part{key[1]:05d}.{layout}.parquet", f"{root}/attempts/{attempt_name()}"
                self.sink = store.open_output_stream(self.attempt)
                self.writer, self.held, self.size = pq.ParquetWriter(self.sink, schema, compression="zstd"), [], 0
                self.ids, self.n, self.new, self.a, self.b = hashlib.sha256(), 0, 0, 0, 0

            def add(self, b):
                ids = b.column(id_place).to_pylist()
                self.ids.update((("," if self.n else "") + ",".join("null" if i is None else str(i) for i in ids)).encode())
                self.n += b.num_rows
                self.new += int(b.column(n_columns + 2).to_numpy(zero_copy_only=False).sum())
                for k in (3, 4):
                    x = b.column(n_columns + k).to_numpy()
                    total = (int((x >> 32).sum()) << 32) + int((x & 0xFFFFFFFF).sum())
                    self.a, self.b = (self.a + total, self.b) if k == 3 else (self.a, self.b + total)
                kept = b.select(range(n_columns))
                self.held.append(kept)
                self.size += kept.nbytes
                if self.size >= held_bytes:
                    self.flush()

            def flush(self):
                if self.held:
                    self.writer.write_table(pa.Table.from_batches(self.held))
                self.held, self.size = [], 0

            def done(self):
                self.flush()
                self.writer.close()
                self.sink.close()
                publish(store, self.attempt, f"{root}/data/{self.name}")
                return (*self.key, f"{out}/data/{self.name}", self.n, self.new, self.ids.hexdigest(), self.a, self.b)

        def manifest(rows):
            from decimal import Decimal

            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.decimal128(38, 0), pa.decimal128(38, 0))
            rows = [(*r[:6], Decimal(r[6]), Decimal(r[7])) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for b in batches:
            leaf, part = b.column(n_columns), b.column(n_columns + 1).to_numpy()
            ends = np.flatnonzero((part[1:] != part[:-1]) | np.array(pa.compute.not_equal(leaf.slice(1), leaf.slice(0, max(0, len(leaf) - 1))), dtype=bool)) + 1
            for a, z in zip([0, *ends], [*ends, b.num_rows], strict=True):
                if a == z:
                    continue
                key, piece = (leaf[int(a)].as_py(), int(part[a])), b.slice(int(a), int(z - a))
                if now is None or now.key != key:
                    if now is not None:
                        yield manifest([now.done()])
                    now = File(key, piece.select(range(n_columns)).schema)
                now.add(piece)
        if now is not None:
            yield manifest([now.done()])

    return run


def _write_files(placed: Sorted, dealt: DataFrame, is_new: Column, id_col: str, out: str, layout: str) -> DataFrame:
    """One file for each (leaf, part) of the dealt rows, each written by one task as a stream; returns the manifest."""
    bounded_batches(dealt.sparkSession)
    file, names = F.col(placed.file), free_names(dealt.columns, "leaf", "part", "is_new", "a", "b", "first")
    extra = [file["leaf"], file["part"], F.coalesce(is_new, F.lit(True)), *_hashes(placed.hashed), file["start"]]
    rows = dealt.select(*(F.col(f"`{c}`") for c in placed.columns), *(x.alias(n) for x, n in zip(extra, names, strict=True)), F.col(placed.rank))
    rows = rows.repartition(names[-1]).sortWithinPartitions(names[-1], placed.rank).drop(names[-1], placed.rank)
    return rows.mapInArrow(_writer(out, layout, len(placed.columns), placed.columns.index(id_col)), MANIFEST)


def write(rows: DataFrame, moment: Column, order: list[str], limit: int, out: str, *, id_col: str, is_new: Column | None = None) -> DataFrame:
    """Writes rows into the new folder out (files under out/data) and returns the manifest, a row for each file.

    is_new marks rows to count in n_new; without it none is counted.
    """
    layout = uuid.uuid4().hex[:8]
    placed = Sorted(rows, moment, order, f"{out}/work-{layout}")
    dealt = placed.dealt(files_of(leaves(placed.rows, moment, limit), limit), limit, "files")
    return saved(_write_files(placed, dealt, F.lit(False) if is_new is None else is_new, id_col, out, layout), f"{out}/manifest-{layout}")


def rewrite(rows: DataFrame, moment: Column, order: list[str], limit: int, out: str, before: DataFrame, *, id_col: str, is_new: Column) -> DataFrame:
    """Lays out rows anew in out, whose files ``before`` lists: files that recur stay, the others are removed.

    Returns the manifest of the files there now, with ``rewritten``. Files are removed only after all new ones are in place.
    """
    layout = uuid.uuid4().hex[:8]
    work = f"{out}/work-{layout}"
    placed = Sorted(rows, moment, order, work)
    files = saved(files_of(leaves(placed.rows, moment, limit), limit), f"{work}/parts")
    dealt, (a, b) = placed.dealt(files, limit, "files"), _hashes(placed.hashed)
    digest = dealt.select(F.col(placed.file)["start"].alias("start"), a.cast("decimal(20,0)").alias("a"), b.cast("decimal(20,0)").alias("b")).groupBy("start").agg(F.count("*").alias("n_rows"), F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"))
    same = files.join(digest, "start").join(before, ["leaf", "part", "n_rows", "a", "b"]).select("leaf", "part", "path", "n_rows", F.lit(0).cast("long").alias("n_new"), "ids_sha256", "a", "b")
    same = saved(same, f"{work}/same")
    flagged = files.join(same.select("leaf", "part", F.lit(True).alias("stays")), ["leaf", "part"], "left")
    again = placed.dealt(flagged, limit, "flagged").where(F.col(placed.file)["stays"].isNull())
    new = saved(_write_files(placed, again, is_new, id_col, out, layout), f"{work}/new")
    stale = before.join(same.select("path"), "path", "left_anti").select("path")
    stale.mapInArrow(_remover(out), "n long").agg(F.sum("n")).first()
    return saved(same.withColumn("rewritten", F.lit(False)).unionByName(new.withColumn("rewritten", F.lit(True))), f"{out}/manifest-{layout}")


def _remover(out: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, root = located(out)
        for b in batches:
            for path in b.column(0).to_pylist():
                remove(store, f"{root}/data/{path.rpartition('/')[2]}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return run


def op11_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    limit = 1 + clicks.count() // 800
    k = F.crc32(F.col("click_id").cast("string")) % 128
    back = reduce(lambda x, _: x * (k + 6), range(2), k + 6).cast("int")
    monday = F.date_sub(F.to_date("ts"), F.weekday("ts")).cast("timestamp_ntz")
    moment = F.when(k < 16, F.col("ts") - F.make_dt_interval(back)).when(k > 111, monday).otherwise(F.col("ts"))
    late = F.coalesce(F.col("arrived_at") >= F.lit("2024-04-01 00:00:00").cast("timestamp_ntz"), F.lit(True))
    out, how = f"{shared_dir(spark).rstrip('/')}/time-partitions-{uuid.uuid4().hex}", {"id_col": "click_id", "is_new": late}
    before = write(clicks.where(~late), moment, ["arrived_at", "click_id"], limit, out, **how)
    after = rewrite(clicks, moment, ["arrived_at", "click_id"], limit, out, before, **how)
    return after.select("leaf", "part", F.lit(",".join(clicks.columns)).alias("columns"), "ids_sha256", "path", "n_rows", "n_new", "rewritten")
