"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share all words; a target stops at
``most_repeats`` times its source, and the excess goes to the others by weight. A source's documents form one stream in
a hashed order (each pass repeats it); the stream is cut into blocks at document starts, so a source has an exact block
quota. A binary tree over the output shards splits the vector of quotas: at each node the left half draws its blocks from
the pool without replacement (multivariate hypergeometric, seeded by the node), so every shard follows from its own path
alone and leaves are made in parallel. A shard takes the next blocks of each source, which are disjoint by construction
and already permuted, and shuffles their documents locally.

Running word sums are taken in two levels (hash ranges of a source, then rows of one range), so a source with a third of
all rows is spread like any other. Up to ``most_lots`` sources are planned by the driver. More (a source for each host,
say) are planned as a table, by the same rule: the tree then splits lots, one for each source that takes a share of
1 / most_lots or more (at most most_lots of them, broadcast) and most_lots lots in which the small ones are pooled by a
hash. Blocks of a pooled lot are permuted before shards take them, which is the same draw as one of the sources alone.

Defined cases: a null or blank text has size 0 and gives no words; a null source is a source of its own, last; repeated
rows are separate documents; the last document of a source's quota is cut at a word; an empty table gives an empty mix;
columns other than those named are kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, table

WEIGHTS = (1, 2, 3)


def words(text: Column) -> Column:
    """The number of words: what is left of every word is its first letter's place."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], most_repeats: int = 3) -> list[Fraction]:
    """Shares of sum(sizes) by weight, none above most_repeats times its size."""
    left, open_ = Fraction(sum(sizes)), set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] > most_repeats * sizes[k] * total}
        if not full:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in full:
            out[k] = Fraction(most_repeats * sizes[k])
        left -= sum(out[k] for k in full)
        open_ -= full
    return out


def _leaves(quotas: list[int], shards: int, seed: int):
    """Quotas of each shard, found along its path from the root of the splitting tree."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def left_part(low: int, high: int, pool):
            middle = (low + high) // 2
            take = int(pool.sum()) * (middle - low) // (high - low)
            rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, low, high])))
            return middle, rng.multivariate_hypergeometric(pool, take, method="marginals")

        for b in batches:
            shard, source, count = [], [], []
            for leaf in b.column(0).to_pylist():
                low, high, pool = 0, shards, np.array(quotas, dtype="int64")
                while high - low > 1:
                    middle, part = left_part(low, high, pool)
                    low, high, pool = (low, middle, part) if leaf < middle else (middle, high, pool - part)
                own = np.nonzero(pool)[0]
                shard += [leaf] * len(own)
                source += own.tolist()
                count += pool[own].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (shard, source, count)], names=["shard", "source", "count"])

    return run


def plan(found: list, weights: tuple[int, ...], most_repeats: int) -> list[dict]:
    """One row for each source in order: name, size, target and quota in words."""
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    share = targets([r["size"] for r in found], [weights[k % len(weights)] for k in range(len(found))], most_repeats)
    return [{"place": k, "source": r["source"], "size": r["size"], "n": r["n"], "target": float(t), "quota": round(t)} for k, (r, t) in enumerate(zip(found, share, strict=True))]


def wide_plan(sources: DataFrame, weights: tuple[int, ...], most_repeats: int) -> DataFrame:
    """The rows of ``plan`` as a table, for any number of sources (source, size, n)."""
    spark, order = sources.sparkSession, (F.col("source").isNull(), F.col("source"))
    # places in code-point order: the number of rows in earlier ranges, and the place within the range
    ordered = cut(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before, bases = 0, []
    for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("c")).orderBy("part").collect():  # a row a partition
        bases.append((r["part"], before))
        before += r["c"]
    bases = F.broadcast(spark.createDataFrame(bases, "part long, base long"))
    place = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    placed = cut(ordered.join(bases, part == F.col("part")).withColumn("place", place).withColumn("weight", weight).select("place", "source", "size", "n", "weight"))
    # words for each unit of weight: rises while sources become full, and stands still when no more do
    total, all_weights = placed.agg(F.sum("size"), F.sum("weight")).first()
    rate = Fraction(total, all_weights)
    most = F.col("size") * most_repeats
    while True:
        number = lambda x, digits: F.lit(x).cast(f"decimal({digits},0)")
        full = F.col("weight").cast("decimal(9,0)") * number(str(rate.numerator), 28) > F.col("size").cast("decimal(19,0)") * number(str(most_repeats * rate.denominator), 18)
        capped, open_ = placed.agg(F.sum(F.when(full, most).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        now = Fraction(total - capped, open_) if open_ else rate
        if now == rate:
            break
        rate = now
    kinds = sorted(set(weights))
    of_weight = lambda f: F.coalesce(*(F.when(F.col("weight") == w, F.lit(f(rate * w))) for w in kinds))
    return placed.select("place", "source", "size", "n", F.when(full, most.cast("double")).otherwise(of_weight(float)).alias("target"), F.when(full, most).otherwise(of_weight(round).cast("long")).alias("quota"))


def _pooled(plan: DataFrame, block_words: int, most_lots: int, seed: int) -> tuple[DataFrame, list[int], DataFrame]:
    """The plan with each source's lot (own for large ones), block quotas of the lots, and every block's slot in its lot."""
    spark = plan.sparkSession
    least = max(1, -(-plan.agg(F.sum("quota")).first()[0] // most_lots))
    plan = plan.withColumn("blocks", F.expr(f"(quota + {block_words - 1}) div {block_words}"))
    large = plan.where(F.col("quota") >= least).select("place", "blocks").orderBy("place").collect()  # at most most_lots
    own = F.broadcast(spark.createDataFrame([(r["place"], k) for k, r in enumerate(large)], "place long, own long"))
    pool = F.lit(len(large)) + F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(most_lots))
    plan = cut(plan.join(own, "place", "left").withColumn("lot", F.coalesce("own", pool)).withColumn("own", F.col("own").isNotNull()))
    lots = [r["blocks"] for r in large] + [0] * most_lots
    for r in plan.where("not own").groupBy("lot").agg(F.sum("blocks").alias("blocks")).collect():
        lots[r["lot"]] = r["blocks"]
    blocks = plan.where("blocks > 0").select("own", "lot", "place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    turn = Window.partitionBy("lot").orderBy(F.xxhash64(F.lit(seed), "place", "block"), "place", "block")
    slots = blocks.where("own").withColumn("slot", F.col("block"))
    slots = slots.unionAll(blocks.where("not own").withColumn("slot", F.row_number().over(turn).cast("long") - 1))
    return plan, lots, slots.select("lot", "slot", "place", "block")


def pieces(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", *, size: Column, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3, block_words: int = 1 << 14, shard_words: int = 1 << 22, range_rows: int = 1 << 12, seed: int = 7, most_lots: int = 1 << 14) -> DataFrame:
    """A row for each piece that the mix takes, and one with words 0 for each document that it leaves.

    Columns: doc (the document's own columns), row, size, source_size, target, words (from the document's start), pass,
    block, shard.
    """
    spark = docs.sparkSession
    # the document rides as one struct, so no column of it can clash with those added here
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"), F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = sources.limit(most_lots + 1).collect()
    if len(found) <= most_lots:
        rows, slots = plan(found, weights, most_repeats), None
        lots, words_in_all = [-(-r["quota"] // block_words) for r in rows], sum(r["quota"] for r in rows)
        recipe = [(r["place"], r["source"], r["size"], r["target"], r["quota"], max(1, -(-r["n"] // range_rows))) for r in rows]
        recipe = F.broadcast(spark.createDataFrame(recipe, "place long, name string, source_size long, target double, quota long, ranges long"))
        keyed = sized.join(recipe, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    else:
        planned, lots, slots = _pooled(wide_plan(sources, weights, most_repeats), block_words, most_lots, seed)
        words_in_all = planned.agg(F.sum("quota")).first()[0]
        ranges = F.expr(f"greatest(1, (n + {range_rows - 1}) div {range_rows})").cast("long")
        recipe = planned.select("own", "place", F.col("source").alias("name"), F.col("size").alias("source_size"), "target", "quota", ranges.alias("ranges"))
        # large sources never go through an exchange by source
        large, same = F.broadcast(recipe.where("own")), F.col("source").eqNullSafe(F.col("name"))
        of_large = sized.join(large, same)
        of_small = sized.join(large.select("name"), same, "left_anti").join(recipe.where("not own"), same)
        keyed = of_large.unionAll(of_small.select(of_large.columns)).drop("name", "source", "own")
    # places in the permuted stream: hash ranges of a source, then rows within a range
    keyed = keyed.withColumn("hash", F.xxhash64(F.lit(seed), F.col("id"))).withColumn("range", F.pmod("hash", F.col("ranges")))
    sums = keyed.groupBy("place", "range").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("place", "range").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["place", "range"])
    at = F.col("base") + F.col("within")
    start = lambda p: p * F.col("source_size") + at
    last = F.floor((F.col("quota") - at - 1) / F.col("source_size")).cast("long")
    passes = F.when((F.col("size") > 0) & (F.col("quota") > at), F.sequence(F.lit(0).cast("long"), last))
    keyed = keyed.withColumn("pass", F.explode_outer(passes))
    keyed = keyed.withColumn("words", F.when(F.col("pass").isNull(), 0).otherwise(F.least(F.col("size"), F.col("quota") - start(F.col("pass")))))
    keyed = keyed.withColumn("block", F.floor(start(F.col("pass")) / block_words).cast("long"))
    # block quotas of the shards, and from them the shard of every block
    quotas = lots or [0]
    shards = max(1, -(-words_in_all // shard_words))
    leaves = spark.range(shards).mapInArrow(_leaves(quotas, shards, seed), "shard long, place long, count long")
    end = F.sum("count").over(Window.partitionBy("place").orderBy("shard"))
    own_blocks = F.explode(F.sequence(F.col("end") - F.col("count"), F.col("end") - 1)).alias("block")
    blocks = leaves.withColumn("end", end).repartition("shard").select("place", "shard", own_blocks)
    if slots is not None:
        blocks = blocks.select(F.col("place").alias("lot"), F.col("block").alias("slot"), "shard").join(slots, ["lot", "slot"]).select("place", "shard", "block")
    return keyed.join(blocks, ["place", "block"], "left").select("doc", "row", "size", "source_size", "target", "words", "pass", "block", "shard")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 7, **how) -> DataFrame:
    """The mixed documents with all their columns, repeats as rows of their own, one output shard after another.

    A document that is cut keeps its first words as they stand; a column n_chars follows the text.
    """
    taken = pieces(docs, id_col, source_col, size=words(F.col(f"`{text_col}`")), seed=seed, **how).where("words > 0")
    taken = taken.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 1), "shard", F.col(f"doc.`{id_col}`"), "pass"))
    text, whole = F.col(f"doc.`{text_col}`"), F.col("words") >= F.col("size")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)")), 1, F.col("words").cast("int")), "")
    cut_text = F.when(whole, text).otherwise(part)

    def column(c: str) -> Column:
        if c == text_col:
            return cut_text.alias(c)
        if c == "n_chars":
            return F.when(whole, F.col("doc.n_chars")).otherwise(F.length(part).cast(dict(docs.dtypes)["n_chars"])).alias(c)
        return F.col(f"doc.`{c}`")

    return taken.select(*map(column, docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = cut(table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size")))
    taken = pieces(slim, size=F.col("size")).groupBy("row", F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")
