"""Digests of files of any size: whole ones, and trees of digests that tell which part of a file has changed.

Tasks get paths and read the files as streams through Arrow's file systems, so no file is ever one value. A file's tree has a
leaf for each ``CHUNK`` bytes; ``span`` bytes are one task's work, so a large file is read by many tasks.

Defined cases: files without bytes are left out, as Spark's file source does; no files give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK, SPAN = 64 << 10, 64 << 20


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, length) of the files below a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _opened(path: str):
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.open_input_file(place)


def _whole(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    for b in batches:
        paths, digests = b.column(0).to_pylist(), []
        for path in paths:
            digest = hashlib.sha256()
            with _opened(path) as f:
                while data := f.read(1 << 20):
                    digest.update(data)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string())], names=["path", "sha256"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, sha256) of the files below a path."""
    return listed(spark, path).select("path").mapInArrow(_whole, "path string, sha256 string")


def _leaves(span: int):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                digests = []
                with _opened(path) as f:
                    f.seek(start)
                    while len(digests) < span // CHUNK and (data := f.read(CHUNK)):
                        digests.append(hashlib.sha256(data).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(digests), pa.string()), pa.array(range(start // CHUNK, start // CHUNK + len(digests)), pa.int64()), pa.array(digests, pa.string())], names=["path", "place", "sha256"])

    return run


def tree(spark: SparkSession, path: str, fan_out: int = 1024, span: int = SPAN) -> DataFrame:
    """Rows (path, level, place, sha256) of each file's tree: leaves at level 0, a node for each ``fan_out`` below it, up to one root.

    A node's digest is that of its children's hexadecimal digests, joined.
    """
    spans = listed(spark, path).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(span).cast("long"))).alias("start"))
    level = spans.repartition("path", "start").mapInArrow(_leaves(span), "path string, place long, sha256 string").withColumn("level", F.lit(0))
    out = level
    longest = listed(spark, path).agg(F.max("length")).first()[0] or 0
    nodes, k = -(-longest // CHUNK), 0
    while nodes > 1:
        nodes, k = -(-nodes // fan_out), k + 1
        level = level.groupBy("path", F.floor(F.col("place") / fan_out).alias("up")).agg(F.array_sort(F.collect_list(F.struct("place", "sha256"))).alias("below"))
        level = level.select("path", F.col("up").alias("place"), F.sha2(F.array_join("below.sha256", ""), 256).alias("sha256"), F.lit(k).alias("level"))
        out = out.unionByName(level)
    return out.select("path", "level", "place", "sha256")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (path, first_byte, change) of the chunks that differ between two trees: changed, added or removed.

    Files whose roots agree aren't looked at further.
    """
    top = lambda t: t.groupBy("path").agg(F.max(F.struct("level", "place", "sha256")).alias("root"))
    same = top(before).join(top(after), ["path", "root"]).select("path")
    leaves = lambda t, name: t.where("level = 0").join(same, "path", "left_anti").select("path", "place", F.col("sha256").alias(name))
    both = leaves(before, "old").join(leaves(after, "new"), ["path", "place"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("path", (F.col("place") * CHUNK).alias("first_byte"), F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))
