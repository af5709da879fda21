"""Exact length histogram: documents by encoded length, with suffix sums that answer every context limit.

Tasks send one row for each length that they meet, so the shuffle and the histogram grow with the longest document, not
with the number of documents. Suffix sums are taken in two levels (blocks of lengths, then within a block).

Defined cases: a null text counts as empty and has length 0; repeated rows count each time; an empty table gives an
empty histogram, whose totals are 0 and whose quantiles are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, cut, table
from millrace.llm.tokens import VOCABULARY, encoder


def _lengths(vocabulary: str):
    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        seen: Counter = Counter()
        for b in batches:
            texts = b.column(0)
            for at in range(0, len(texts), 1000):
                _, offsets = encoder(vocabulary).encode_many(texts.slice(at, 1000))
                for n, c in zip(*np.unique(np.diff(offsets), return_counts=True), strict=True):
                    seen[int(n)] += int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["length", "n_docs"])

    return run


def histogram(docs: DataFrame, text_col: str = "text", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (length, n_docs), one for each encoded length that occurs; kept, as sums over them need them more than once."""
    bounded_batches(docs.sparkSession)
    return cut(docs.select(F.col(text_col)).mapInArrow(_lengths(vocabulary), "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs")))


def suffix_sums(hist: DataFrame, block: int = 1024) -> DataFrame:
    """For each length as a context limit: documents and tokens at it, longer than it, and what truncation to it leaves.

    docs_longer and tokens_longer are the suffix sums; docs_at_most / n_all is the quantile rank of the length.
    """
    h = hist.withColumn("block", F.floor(F.col("length") / block)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # one row for each `block` lengths: as many as the longest document has thousands of tokens
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"), F.sum("d").over(Window.partitionBy()).alias("n_all"), F.sum("t").over(Window.partitionBy()).alias("tokens_all"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    s = h.join(blocks, "block").select("length", "n_docs", "n_all", "tokens_all", (F.col("d_later") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_longer"), (F.col("t_later") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("tokens_longer"))
    return s.select("length", "n_docs", (F.col("n_all") - F.col("docs_longer")).alias("docs_at_most"), "docs_longer", "tokens_longer", (F.col("tokens_all") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_total"), "n_all", "tokens_all")


def limits(sums: DataFrame, of: list[int]) -> DataFrame:
    """For any context limits: docs_longer and truncated_total, also where no document has exactly that length."""
    spark = sums.sparkSession
    low = F.struct("length", "docs_longer", "tokens_all", "tokens_longer")
    out = spark.createDataFrame([(n,) for n in of], "limit long")
    n_all = F.max("n_all")
    whole = sums.agg(n_all.alias("n"), F.max("tokens_all").alias("t"), *(F.max(F.when(F.col("length") <= n, low)).alias(f"l{n}") for n in of))
    rows = F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("limit"), F.col(f"l{n}").alias("at")) for n in of)))
    got = whole.select("n", "t", rows.alias("r")).select("r.limit", F.coalesce("r.at.docs_longer", "n").alias("docs_longer"), (F.coalesce(F.col("r.at.tokens_all") - F.col("r.at.tokens_longer"), F.lit(0)) + F.col("r.limit") * F.coalesce("r.at.docs_longer", "n")).alias("truncated_total"))
    return out.join(got, "limit", "left").na.fill(0)


def quantiles(sums: DataFrame, of: list[float]) -> DataFrame:
    """The smallest length that at least the share q of the documents do not exceed (null for an empty table)."""
    least = sums.agg(*(F.min(F.when(F.col("docs_at_most") >= F.lit(q) * F.col("n_all"), F.col("length"))).alias(f"q{k}") for k, q in enumerate(of)))
    return least.select(F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), F.col(f"q{k}").alias("length")) for k, q in enumerate(of)))).alias("r")).select("r.*")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(table(spark, sf_dir, "documents")))
