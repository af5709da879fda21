"""What the operators share: tables, durable cuts of the lineage, and distributed connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words in every contract of this package (ASCII only).
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows, so that texts of any length take bounded memory in both processes.

    A setting of the session; one that the user has made smaller stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(BATCH_BYTES)).removesuffix("b")) >= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def released(batches: Iterable, rows: int | None = None) -> Iterator:
    """The batches, at most ``rows`` rows at a time; before each, Arrow gives back to the system what earlier ones took.

    Its pool keeps freed memory otherwise, in workers that wait for other tasks too.
    """
    import pyarrow as pa

    pool = pa.default_memory_pool()
    try:
        for b in batches:
            for k in range(0, b.num_rows, rows or max(1, b.num_rows)):
                yield b.slice(k, rows) if rows else b
                pool.release_unused()
    finally:
        pool.release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where none is set, a temporary folder serves a local session; elsewhere executors could not read it, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("millrace.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="millrace-checkpoint-")
        spark.conf.set("millrace.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def least_tasks(df: DataFrame, task_bytes: int) -> int:
    """Tasks over which df's inputs are spread: files by ``task_bytes`` (the optimizer's figures), earlier cuts by their own tasks."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total, tasks = 0, 1
    for leaf in (leaves.apply(k) for k in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            tasks = max(tasks, leaf.rdd().getNumPartitions())
        elif (size := int(str(leaf.stats().sizeInBytes()))) < 1 << 60:  # beyond: unknown
            total += size
    return min(1 << 20, max(tasks, total // task_bytes))


def is_plain_scan(df: DataFrame) -> bool:
    """Whether df is files with filters and projections only, whose rows come in the same order at every evaluation."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "LogicalRelation"


def cut(df: DataFrame, files: int = 8, task_bytes: int = 128 << 20) -> DataFrame:
    """The rows of df, kept in the shared folder, so that a lost executor costs no earlier work.

    Small partitions are put together, down to ``files`` tasks for each core, or to more where a task would then read
    over ``task_bytes`` of the input: large inputs are worked on as finely as they are scanned. Row numbers made by
    monotonically_increasing_id() are fixed from here on. Spark removes the folders of checkpoints that nothing refers to
    any more where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    shared_dir(spark)
    return df.coalesce(max(8, files * spark.sparkContext.defaultParallelism, least_tasks(df, task_bytes))).checkpoint(eager=True)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as no name in use has."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def any_order(docs: DataFrame) -> Column:
    """A hash of a row's columns (but for maps, which have none)."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind))


def keep_rows(docs: DataFrame, firsts: DataFrame, digest: Column, id_col: str) -> DataFrame:
    """One row of docs, with all its columns, for each (digest, id) of firsts.

    Rows that repeat both are reduced to one before they are exchanged, so a hot repeat is a row of each task.
    """
    own = free_names(docs.columns, "digest", "none", "id", "n")
    keys = lambda digest, i: (digest.alias(own[0]), i.isNull().alias(own[1]), F.coalesce(i.cast("string"), F.lit("")).alias(own[2]))
    w = Window.partitionBy(*own[:3]).orderBy(any_order(docs))
    keyed = docs.select("*", *keys(digest, F.col(f"`{id_col}`"))).withColumn(own[3], F.row_number().over(w)).where(F.col(own[3]) == 1)
    kept = firsts.select(*keys(F.col("digest"), F.col("id")))
    return keyed.join(kept, own[:3], "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def _contracted(batches: Iterator) -> Iterator:
    """Rows (node, root) of the edges of one partition: roots are hooked to smaller roots and paths halved until all is still."""
    import numpy as np
    import pyarrow as pa

    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    a, b = (np.concatenate([p[k] for p in parts] or [np.zeros(0, "int64")]) for k in (0, 1))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame, most_rounds: int = 100, one_task: int = 1 << 20) -> DataFrame:
    """Rows (node, root) for every node of the undirected edges (a, b) of longs; root is the smallest node that it reaches.

    At most ``one_task`` distinct edges (counted; 16 bytes each) are contracted in one task on an executor. More take
    large-star and small-star rounds (Kiveris et al. 2014) until nothing moves; each half round is one pre-aggregated
    minimum for each node and one equi-join, in which adaptive execution splits hot nodes, so no group of links meets in
    one task. Both ways give the same rows. Self-links and null ends are left out; an empty table gives an empty table.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = cut(e), None
    if e.count() <= one_task:
        return e.coalesce(1).mapInArrow(_contracted, "node long, root long")
    for _ in range(most_rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("x"), F.col("m"), "a")
        links = F.array(F.struct(F.col("x").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        e = cut(small.select(F.explode(links).alias("p")).select("p.a", "p.b").where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components moved for {most_rounds} rounds")
    stars = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return stars.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
