"""JSON lines and documents: counting, dropping and strict scans, routed and summary sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import pyjson
from millrace.functions import text as X
from millrace.functions.recover import kind
from millrace.operators.conversation import payload_text
from millrace.sources.shared import cut


def scan(spark: SparkSession, path: str, malformed: str = "count") -> DataFrame:
    """Rows (line, value VARIANT, problem) of the lines that aren't blank.

    malformed: "count" keeps bad lines with a problem, "drop" leaves them out, "fail" raises. Lines that are JSON but
    no object are bad, too.
    """
    rows = spark.read.text(path).where(X.strip("value") != "").select(F.col("value").alias("line"), pyjson.parse("value").alias("value"))
    return judge(rows, malformed)


def judge(rows: DataFrame, malformed: str = "count") -> DataFrame:
    problem = F.when(F.col("value").isNull(), "malformed JSON").when(kind(F.col("value")) != "OBJECT", "not an object")
    rows = rows.withColumn("problem", problem)
    if malformed == "drop":
        return rows.where("problem is null")
    if malformed == "fail":
        return rows.withColumn("line", F.when(F.col("problem").isNull(), F.col("line")).otherwise(F.raise_error(F.concat("problem", F.lit(": "), "line"))))
    return rows


def examples(rows: DataFrame) -> DataFrame:
    """The envelope of raw examples; ``with_ids`` fills missing identifiers.

    ground_truth_text is the payload's own JSON, compact, which training targets are made of.
    """
    v = F.col("value")
    text = lambda f: F.try_variant_get(v, f"$.{f}", "string").alias(f)
    number = lambda f: F.try_variant_get(v, f"$.{f}", "bigint").alias(f)
    return rows.select(*map(text, ("id", "scenario_id", "difficulty", "document_text")), F.try_variant_get(v, "$.ground_truth_json", "variant").alias("ground_truth_json"), payload_text(F.col("line")).alias("ground_truth_text"), F.try_variant_get(v, "$.schema_valid_at_generation", "boolean").alias("schema_valid_at_generation"), *map(text, ("model", "generated_at")), *map(number, ("generation_ms", "input_tokens")))


def prefix_sums(df: DataFrame, order: str, of: dict[str, str]) -> DataFrame:
    """df with a column for each name of ``of``: the sum of another column over all rows before, in the order of a column.

    Sums over ranges of the order, one row for each partition, then sums within a range. The rows are kept, as ranges are
    sampled and read twice. Rows that tie in the order come in any order.
    """
    ranged = cut(df.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    ranges = ranged.groupBy("__p").agg(*(F.sum(c).alias(f"__{name}") for name, c in of.items()))
    ranges = ranges.select("__p", *(earlier(f"__{name}", Window.orderBy("__p")).alias(f"__{name}") for name in of))
    inside = Window.partitionBy("__p").orderBy(order)
    summed = ranged.select("*", *(earlier(c, inside).alias(name) for name, c in of.items()))
    return summed.join(ranges, "__p").select(*df.columns, *((F.col(name) + F.col(f"__{name}")).alias(name) for name in of))


def with_ids(df: DataFrame, order: str, id_col: str = "id", form: str = "%d") -> DataFrame:
    """Missing identifiers become the row's place in the order of a column, formatted."""
    placed = prefix_sums(df.withColumn("__one", F.lit(1).cast("long")), order, {"__place": "__one"})
    return placed.withColumn(id_col, F.coalesce(F.col(id_col), F.format_string(form, "__place"))).drop("__one", "__place")


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object for each line, nulls kept; mode "append" adds files."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_routed(df: DataFrame, passed: str, failed: str, problem: str) -> None:
    """Two sinks from rows that are computed once."""
    df = df.persist()
    try:
        write(df.where(F.col(problem).isNull()).drop(problem), passed)
        write(df.where(F.col(problem).isNotNull()), failed)
    finally:
        df.unpersist()


def read_document(spark: SparkSession, path: str) -> dict | None:
    """A result document, or None if there is none."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return json.loads(rows[0]["value"]) if rows else None


def write_document(spark: SparkSession, doc: dict, path: str) -> None:
    """A small summary as one indented JSON document."""
    spark.createDataFrame([(json.dumps(doc, indent=2, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (document_text)."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "document_text")
