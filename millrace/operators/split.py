"""Stratified evaluation, validation and training sets, and the lock of the evaluation set.

Quotas come from prefix sums over the table of strata, of which there may be any number; membership is the order of a
seeded hash, so it is the same for any partitioning. A stratum's rows are never gathered: the smallest hashes are cut off
at a threshold that a histogram of hash prefixes narrows down, and only the bucket of the threshold is ranked. Rows meet
their stratum's threshold by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.files import file_digests
from millrace.sources.jsonl import prefix_sums
from millrace.sources.shared import cut


def quotas(sizes: list[tuple[str, int]], n: int) -> dict[str, int]:
    """Rows to take from each stratum: half-even shares, then filled up or taken back from the last strata."""
    total = sum(s for _, s in sizes)
    n = min(n, total)
    out = {k: min(s, round(s / total * n)) for k, s in sizes} if total else {}
    short = n - sum(out.values())
    for k, s in sizes if short > 0 else []:
        more = min(short, s - out[k])
        out[k] += more
        short -= more
    for k, _ in reversed(sizes):
        less = min(-short, out[k]) if short < 0 else 0
        out[k] -= less
        short += less
    return out


def sizes_of_sets(n: int, eval_fraction: float = 0.12, eval_min: int = 50, val_fraction: float = 0.10) -> tuple[int, int]:
    """Rows of the evaluation and the validation set; fewer than eval_min rows are an error."""
    if n < eval_min:
        raise ValueError(f"{n} rows; at least {eval_min} are needed")
    n_eval = min(max(eval_min, round(eval_fraction * n)), n - eval_min)
    return n_eval, max(1, round(val_fraction * (n - n_eval)))


def order_key(seed: int, id_col: str, salt: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|{salt}|"), F.col(id_col).cast("string")))


def quota_table(strata: DataFrame, n: int) -> DataFrame:
    """``quotas`` for any number of strata: rows (s, want) from rows (s, n, f), in the order of f."""
    total = strata.agg(F.sum("n")).first()[0] or 0
    n = min(n, total)
    base = F.least(F.col("n"), F.rint(F.col("n") / F.lit(float(max(1, total))) * F.lit(float(n))).cast("long"))
    rows = prefix_sums(strata.withColumn("base", base).withColumn("room", F.col("n") - F.col("base")), "f", {"rooms": "room", "bases": "base"})
    taken = rows.agg(F.sum("base")).first()[0] or 0
    short = n - taken
    more = F.greatest(F.lit(0), F.least(F.lit(short) - F.col("rooms"), F.col("room")))
    after = F.lit(taken) - F.col("bases") - F.col("base")
    less = F.greatest(F.lit(0), F.least(F.lit(-short) - after, F.col("base")))
    return rows.select("s", (F.col("base") + (more if short > 0 else -less)).cast("long").alias("want"))


def limits(df: DataFrame, wanted: DataFrame, stratum: str, key: Column, id_col: str) -> DataFrame:
    """Rows (s, k, i): the last of the ``want`` smallest (key, id) of each stratum of wanted (s, want); none where want is 0."""
    prefix = F.substring(key, 1, 4)
    # at most 65536 rows for each stratum, whatever the table's size
    counts = df.select(F.col(stratum).alias("s"), prefix.alias("p")).groupBy("s", "p").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("s").orderBy("p"))
    edge = counts.withColumn("upto", running).join(wanted, "s").where("upto >= want and upto - n < want").select("s", "p", (F.col("want") - F.col("upto") + F.col("n")).alias("rest"))
    own = df.select(F.col(stratum).alias("s"), prefix.alias("p"), key.alias("k"), F.col(id_col).alias("i")).join(edge, ["s", "p"])
    return own.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("k", "i"))).where("n = rest").select("s", "k", "i")


def taken(df: DataFrame, wanted: DataFrame, stratum: str, key: Column, id_col: str, name: str) -> DataFrame:
    """df with a boolean column: whether the row is one of the ``want`` first of its stratum."""
    last = limits(df, wanted, stratum, key, id_col).select(F.col("s").alias(stratum), F.col("k").alias("__k"), F.col("i").alias("__i"))
    hit = (key < F.col("__k")) | ((key == F.col("__k")) & (F.col(id_col) <= F.col("__i")))
    return df.join(last, stratum, "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop("__k", "__i")


def assign(df: DataFrame, id_col: str = "id", stratum_col: str = "difficulty", *, eval_fraction: float = 0.12, eval_min: int = 50, val_fraction: float = 0.10, seed: int = 2024) -> DataFrame:
    """The rows with a column split: eval, val or train. Strata, of any number, come in order of their first identifier."""
    columns = df.columns
    df = df.withColumn("__s", F.coalesce(F.col(stratum_col).cast("string"), F.lit("unknown")))
    strata = cut(df.groupBy(F.col("__s").alias("s")).agg(F.count("*").alias("n"), F.min(id_col).alias("f")))
    n_eval, n_val = sizes_of_sets(strata.agg(F.sum("n")).first()[0] or 0, eval_fraction, eval_min, val_fraction)
    first = cut(quota_table(strata, n_eval))
    left = strata.join(first, "s").select("s", (F.col("n") - F.col("want")).alias("n"), "f").where("n > 0")
    second = quota_table(left, n_val)
    marked = taken(df, first, "__s", order_key(seed, id_col, "eval"), id_col, "__eval")
    val = limits(marked.where("not __eval"), second, "__s", order_key(seed, id_col, "val"), id_col).select(F.col("s").alias("__s"), F.col("k").alias("__k"), F.col("i").alias("__i"))
    key = order_key(seed, id_col, "val")
    in_val = (key < F.col("__k")) | ((key == F.col("__k")) & (F.col(id_col) <= F.col("__i")))
    return marked.join(val, "__s", "left").select(*columns, F.when(F.col("__eval"), "eval").when(in_val, "val").otherwise("train").alias("split"))


def stats(split: DataFrame, stratum_col: str = "difficulty") -> DataFrame:
    return split.groupBy("split", F.coalesce(F.col(stratum_col).cast("string"), F.lit("unknown")).alias("stratum")).agg(F.count("*").alias("n"))


def lock(spark: SparkSession, path: str) -> str:
    """SHA-256 over the files of a set, in name order, kept beside it as <path>.sha256; returns the digest."""
    digest = digest_of(spark, path)
    spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.sha256")
    return digest


def digest_of(spark: SparkSession, path: str) -> str:
    files = file_digests(spark, path).select(F.substring_index("path", "/", -1).alias("name"), "sha256")
    rows = files.where(~F.col("name").rlike(r"^[._]")).orderBy("name").collect()
    if len(rows) == 1:
        return rows[0]["sha256"]
    import hashlib

    return hashlib.sha256("".join(r["sha256"] for r in rows).encode()).hexdigest()


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the set is as it was locked; no lock is an error."""
    found = spark.read.text(f"{path}.sha256").collect()
    return bool(found) and found[0]["value"].split()[0] == digest_of(spark, path)
