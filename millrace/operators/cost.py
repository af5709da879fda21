"""Unit cost, cost per success and payback as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The price list (US dollars per million tokens) and the average tokens of a document.
PRICES = {"deepseek/deepseek-v4-flash": (0.07, 0.28)}
INPUT_TOKENS, OUTPUT_TOKENS = 600, 350


def with_prices(df: DataFrame, model: str = "model", prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds input_per_1m and output_per_1m; a model without a price is an error when its row is read."""
    prices = PRICES if prices is None else prices
    table = F.create_map(*(x for m, (i, o) in prices.items() for x in (F.lit(m), F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")))))
    found = F.try_element_at(table, F.col(model))
    known = F.when(found.isNull(), F.raise_error(F.concat(F.lit("no price for model "), F.coalesce(F.col(model), F.lit("null")))).cast("double"))
    return df.withColumn("input_per_1m", F.coalesce(known, found["i"])).withColumn("output_per_1m", F.coalesce(known, found["o"]))


def per_1000_documents(input_per_1m: Column, output_per_1m: Column, input_tokens: Column | None = None, output_tokens: Column | None = None) -> Column:
    i = F.lit(INPUT_TOKENS) if input_tokens is None else input_tokens
    o = F.lit(OUTPUT_TOKENS) if output_tokens is None else output_tokens
    return (i / F.lit(1e6)) * input_per_1m * 1000 + (o / F.lit(1e6)) * output_per_1m * 1000


def per_success(cost_per_1000: Column, accuracy: Column) -> Column:
    return F.when(accuracy > 0, cost_per_1000 / (accuracy * 1000))


def reported_accuracy(accuracy: Column) -> Column:
    """The accuracy that a report can give back: rounded to a percent with one decimal."""
    return F.regexp_replace(F.format_string("%.1f%%", accuracy * 100), "%", "").cast("double") / 100


def payback_documents(build_cost: Column, teacher_per_1000: Column, tuned_per_1000: Column) -> Column:
    saved = teacher_per_1000 - tuned_per_1000
    return F.when(saved > 0, build_cost / saved * 1000)
