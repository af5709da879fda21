"""Invoice records, damaged records and model outputs made from the star schema, by rules on the order key.

One record for each order: the vendor is the supplier of its lowest line, items follow the line numbers. Damage picks a
JSON literal for a field by the key's remainder, so that any engine can tell the expected outcome.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import table

DIFFICULTIES, CURRENCIES = ("easy", "medium", "hard"), ("USD", "EUR", "GBP", "CAD")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (o_orderkey, scenario_id, difficulty, record): the record as a struct in the contract's order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    item = F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("total"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
    )
    # an order has a handful of lines
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    orders = table(spark, folder, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    orders = orders.withColumn("suppkey", F.col("items")[0]["s"])
    x = orders.join(table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("suppkey") == F.col("s_suppkey"))
    x = x.join(table(spark, folder, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    parts = {
        "vendor_name": F.col("s_name"), "vendor_address": F.when(k % 5 != 0, F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))), "invoice_number": F.concat(F.lit("INV-"), k.cast("string")),
        "invoice_date": day.cast("string"), "due_date": F.when(k % 4 != 0, F.date_add(day, 30).cast("string")), "bill_to": F.col("c_name"),
        "line_items": F.transform("items", lambda i, n: F.struct(F.repeat(F.char(n % 26 + 97), F.lit(6)).alias("description"), *(i[f].alias(f) for f in ("quantity", "unit_price", "total")))),
        "subtotal": F.col("o_totalprice"), "tax_amount": F.col("o_totalprice") * 0.08, "tax_rate": F.lit(0.08), "total_amount": F.col("o_totalprice"),
        "currency": F.element_at(F.array(*map(F.lit, CURRENCIES)), (F.col("s_nationkey") % 4 + 1).cast("int")), "payment_terms": F.lit("Net 30"), "notes": F.when(k % 3 != 0, F.col("o_orderpriority")),
    }
    difficulty = F.element_at(F.array(*map(F.lit, DIFFICULTIES)), (k % 3 + 1).cast("int"))
    return x.select("o_orderkey", F.concat(F.lit("scenario_"), (k % 7).cast("string")).alias("scenario_id"), difficulty.alias("difficulty"), F.struct(*(c.alias(n) for n, c in parts.items())).alias("record"))


def literal(c: Column) -> Column:
    """A JSON literal of a text, number or array of items."""
    return F.substring(fields(F.struct(c.alias("x"))), F.lit(5), F.lit(1 << 30))


def fields(record: Column) -> Column:
    """The fields of a struct (texts, numbers, arrays) as JSON text, without the braces around them."""
    return F.rtrim(F.substring(F.to_json(record, {"ignoreNullFields": "false"}), F.lit(2), F.lit(1 << 30)), F.lit("}"))


NAMES = ("vendor_name", "vendor_address", "invoice_number", "invoice_date", "due_date", "bill_to", "line_items", "subtotal", "tax_amount", "tax_rate", "total_amount", "currency", "payment_terms", "notes")


def spelled(record: Column, instead: dict[str, Column], without: tuple[str, Column] | None = None) -> Column:
    """The record as JSON text with some fields' literals replaced; ``without`` names a field to leave out, and where.

    Neighbours that stay as they are, or are replaced by the same column, are spelled in one go.
    """
    left_out = None if without is None else without[0]
    parts: list[Column] = []
    for (_, place), names in groupby(NAMES, lambda n: (n == left_out, id(instead[n]) if n in instead else None)):
        names = list(names)
        part = fields(F.struct(*(record[n].alias(n) for n in names)))
        if place is not None:
            other = instead[names[0]]
            part = F.when(other.isNull(), part).otherwise(F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), other) for n in names)))
        parts.append(F.when(~F.coalesce(without[1], F.lit(False)), part) if names == [left_out] else part)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (id, scenario_id, difficulty, ground_truth_json as text), valid or not by the key's remainder of 20."""
    k = F.col("o_orderkey") % 20
    r = F.col("record")
    one = lambda *cases: F.coalesce(*(F.when(k == n, F.lit(v)) for n, v in cases))
    negative = F.transform(r["line_items"], lambda i: i.withField("total", -F.abs(i["total"]) - 1))
    items = F.coalesce(one((9, "[]"), (10, "{}"), (15, '[{"description":"","total":1}]')), F.when(k == 13, literal(negative)))
    instead = {"vendor_name": one((11, "5"), (14, "null")), "invoice_date": one((4, '"2024/01/02"'), (14, '"soon"'), (16, '" 2024-13-45 "')), "line_items": items, "subtotal": one((14, "[]"), (17, '" 1_000.5 "')), "tax_rate": one((8, "8.0"), (14, '"x"')), "total_amount": one((1, "null"), (2, '"abc"'), (3, "-5.0"), (18, "true")), "currency": one((5, '"usd"'), (6, '"US"'), (7, "123"), (14, "null"))}
    return spark_rows(records(spark, folder), spelled(r, instead, ("vendor_name", k == 12)))


def spark_rows(df: DataFrame, payload: Column) -> DataFrame:
    return df.select(F.col("o_orderkey").alias("id"), "scenario_id", "difficulty", payload.alias("ground_truth_json"))


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (id, scenario_id, difficulty, ground_truth_json, raw_output): the truth and a model's output by the remainder of 12."""
    k, r = F.col("o_orderkey") % 12, F.col("record")
    items = r["line_items"]
    fewer = F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(1)))
    other = F.transform(items, lambda i, n: i.withField("quantity", F.when(n == 0, i["quantity"] + 1).otherwise(i["quantity"])))
    instead = {
        "vendor_name": F.when(k == 1, literal(F.concat(F.lit(" "), F.upper(r["vendor_name"]), F.lit("\t")))), "bill_to": F.when(k == 2, F.lit("null")), "line_items": F.when((k == 9) & (F.size(items) > 1), literal(fewer)).when(k == 10, literal(other)),
        "total_amount": F.when(k == 3, literal(r["total_amount"] + 0.004)).when(k == 7, F.lit("-1.0")), "currency": F.when(k == 8, literal(F.lower(r["currency"]))), "notes": F.when(k == 11, F.lit('"something else"')),
    }
    text = spelled(r, instead)
    raw = F.when(k == 4, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(k == 5, F.concat(F.lit("Here it is: "), text, F.lit(" Done."))).when(k == 6, F.substring(text, F.lit(1), F.length(text) - 20)).otherwise(text)
    return records(spark, folder).select(F.col("o_orderkey").alias("id"), "scenario_id", "difficulty", spelled(r, {}).alias("ground_truth_json"), raw.alias("raw_output"))
