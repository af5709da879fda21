"""Resumable appends of examples: a run that is repeated, or broke off, adds each row once, under identifiers that go on.

A folder holds ``data`` (JSON lines), ``keys`` (key and identifier of each row) and ``manifest``, in which a run's entry is
written last: number of the run, its first identifier and its rows. Runs without an entry don't count; the next run takes
their number and writes over what they left. The manifest's last entry has the high-water mark, from which identifiers go on.

Defined cases: keys that the folder has, or that repeat within a run, are added once; rows with null keys are refused; a run
that adds nothing leaves no entry.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.jsonl import prefix_sums, write
from millrace.sources.shared import cut


def manifest(spark: SparkSession, folder: str) -> list[dict]:
    """Entries of the whole runs, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted((json.loads(r["value"]) for r in spark.read.option("recursiveFileLookup", "true").text(f"{folder}/manifest").collect()), key=lambda e: e["run"])


def _of(folder: str, table: str, runs: list[dict]) -> list[str]:
    return [f"{folder}/{table}/{e['run']:05d}" for e in runs]


def append(df: DataFrame, folder: str, key: str, form: str = "gen-%05d", id_col: str = "id") -> int:
    """Adds the rows whose key the folder doesn't have, in the order of the key; returns how many."""
    spark = df.sparkSession
    if df.where(F.col(key).isNull()).take(1):
        raise ValueError(f"rows without {key}")
    runs = manifest(spark, folder)
    new = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*(c for c, kind in df.dtypes if kind != "variant" and "map<" not in kind))))).where("__n = 1").drop("__n")
    if runs:
        new = new.join(spark.read.parquet(*_of(folder, "keys", runs)).select(F.col("key").alias(key)), key, "left_anti")
    first = runs[-1]["first"] + runs[-1]["rows"] if runs else 0
    placed = cut(prefix_sums(new.withColumn("__one", F.lit(1).cast("long")), key, {"__place": "__one"}).drop("__one"))
    n = placed.count()
    if not n:
        return 0
    run = runs[-1]["run"] + 1 if runs else 0
    named = placed.withColumn(id_col, F.format_string(form, F.col("__place") + first)).drop("__place")
    named.select(F.col(key).alias("key"), F.col(id_col).alias("id")).write.mode("overwrite").parquet(f"{folder}/keys/{run:05d}")
    write(named, f"{folder}/data/{run:05d}")
    entry = json.dumps({"run": run, "first": first, "rows": n})
    spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest/{run:05d}")
    return n


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Lines (value) of the whole runs."""
    runs = manifest(spark, folder)
    return spark.read.text(_of(folder, "data", runs)) if runs else spark.createDataFrame([], "value string")
