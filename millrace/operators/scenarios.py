"""The scenario dimension and weighted sampling from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Identifier, difficulty, currency.
SCENARIOS = (
    ("saas_easy", "easy", "USD"), ("retail_easy", "easy", "USD"), ("consulting_easy", "easy", "USD"), ("construction_easy", "easy", "USD"), ("restaurant_easy", "easy", "USD"), ("uk_vat_easy", "easy", "GBP"),
    ("saas_annual_medium", "medium", "USD"), ("consulting_milestone_medium", "medium", "USD"), ("eur_german_medium", "medium", "EUR"), ("canadian_gst_medium", "medium", "CAD"), ("utilities_medium", "medium", "USD"), ("healthcare_medium", "medium", "USD"), ("freight_medium", "medium", "USD"),
    ("legal_services_hard", "hard", "USD"), ("retail_discount_hard", "hard", "USD"), ("partial_payment_hard", "hard", "USD"), ("tax_exempt_hard", "hard", "USD"), ("international_aud_hard", "hard", "AUD"), ("messy_restaurant_hard", "hard", "USD"), ("missing_fields_hard", "hard", "USD"),
)
#: Weight of every scenario by its difficulty (of scenarios, not of difficulties), in tenths.
WEIGHTS = {"easy": 3, "medium": 4, "hard": 3}


def table(spark: SparkSession, texts: dict[str, tuple[str, list[str], str]] | None = None) -> DataFrame:
    """Rows (scenario_id, name, difficulty, currency, edge_cases, style_notes); ``texts`` gives name, edge cases and style."""
    rows = []
    for i, d, c in SCENARIOS:
        name, cases, style = (texts or {}).get(i, (i.rpartition("_")[0].replace("_", " "), [], ""))
        rows.append((i, name, d, c, cases, style))
    return spark.createDataFrame(rows, "scenario_id string, name string, difficulty string, currency string, edge_cases array<string>, style_notes string")


def sample(key: Column, weights: dict[str, int] | None = None, seed: int = 42) -> Column:
    """The scenario identifier drawn with replacement for a row, from a hash of its key: 7 hex digits modulo the sum of weights."""
    w = WEIGHTS if weights is None else weights
    names = [i for i, d, _ in SCENARIOS for _ in range(w[d])]
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 7), 16, 10).cast("long") % len(names)
    return F.element_at(F.array(*map(F.lit, names)), (draw + 1).cast("int"))


def alias_table(weights: list[float]) -> list[tuple[float, int]]:
    """For each place the share that it keeps of its slot, and the place that gets the rest (Walker's method).

    Every slot is as likely as any other; a place's share of all slots is its share of the weights.
    """
    if not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must not be negative, and not all zero")
    scaled = [w * len(weights) / sum(weights) for w in weights]
    out = [(1.0, k) for k in range(len(weights))]
    low = [k for k, x in enumerate(scaled) if x < 1]
    high = [k for k, x in enumerate(scaled) if x >= 1]
    while low and high:
        k, rich = low.pop(), high[-1]
        out[k] = (scaled[k], rich)
        scaled[rich] -= 1 - scaled[k]
        if scaled[rich] < 1:
            low.append(high.pop())
    return out


def weighted(key: Column, weights: dict[str, float], seed: int = 42) -> Column:
    """A name drawn with replacement for a row in proportion to any weights: two draws from a hash of its key, and one look at the table."""
    names, table_ = list(weights), alias_table(list(weights.values()))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    part = lambda at: F.conv(F.substring(digest, at, 7), 16, 10).cast("long")
    slot = (part(1) % len(names) + 1).cast("int")
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), slot)
    return F.when(part(8) / float(1 << 28) < of([k for k, _ in table_]), of(names)).otherwise(of([names[j] for _, j in table_]))
