"""Quality rules look at each value once, and neighbours replaced alike are spelled together."""

from pyspark.sql import functions as F

from millrace.operators import quality
from millrace.sources import invoices


def test_amount_is_coerced_once(spark):
    df = spark.createDataFrame([("{}",)], "t string").select(F.parse_json("t").alias("v"))
    plan = df.select(quality.total_amount(F.col("v")), quality.line_items(F.col("v")))._jdf.queryExecution().analyzed().toString()
    assert 1 <= plan.count("schema_of_variant(") <= 12


def test_reasons_of_odd_values(spark):
    amounts = {"null": "total_amount_missing", '"x"': "total_amount_not_numeric", "[]": "total_amount_not_numeric", '" -1_0.50 "': "total_amount_zero_or_negative (-10.5)", "-1e-5": "total_amount_zero_or_negative (-1e-05)", "-1e22": "total_amount_zero_or_negative (-1e+22)", "false": "total_amount_zero_or_negative (0.0)", '"-inf"': "total_amount_zero_or_negative (-inf)", '"nan"': None, "1": None}
    items = {"null": False, "[]": False, "{}": False, '{"a":1}': False, '"[1]"': False, "5": False, "[null]": True, '[1,"a"]': True}
    rows = [f'{{"total_amount":{a},"line_items":[1]}}' for a in amounts] + [f'{{"total_amount":1,"line_items":{i}}}' for i in items] + ["{}"]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, t string").withColumn("v", F.parse_json("t"))
    got = df.orderBy("k").select(quality.total_amount(F.col("v")), quality.line_items(F.col("v")).isNull()).collect()
    assert [r[0] for r in got] == [*amounts.values(), *[None] * len(items), "total_amount_missing"]
    assert [r[1] for r in got] == [*[True] * len(amounts), *items.values(), False]


def test_neighbours_replaced_alike_are_spelled_together(spark):
    record = F.expr("named_struct('vendor_name', 'A', 'vendor_address', cast(null as string), 'invoice_number', 'I', 'invoice_date', '2024-01-01', 'due_date', 'd', 'bill_to', 'é}', 'line_items', array(named_struct('description', 'x', 'quantity', 1.0D, 'unit_price', cast(null as double), 'total', 2.5D)), 'subtotal', 1.0D, 'tax_amount', 2.0D, 'tax_rate', 0.08D, 'total_amount', 7.0D, 'currency', 'USD', 'payment_terms', 'Net', 'notes', cast(null as string))")
    null = F.when(F.col("id") == 1, F.lit("null"))
    of = lambda same: invoices.spelled(F.col("r"), {n: null if same else F.when(F.col("id") == 1, F.lit("null")) for n in ("invoice_number", "invoice_date", "bill_to", "notes")}, ("invoice_date", F.col("id") == 2))
    df = spark.range(3).select("id", record.alias("r")).select("id", of(True).alias("one"), of(False).alias("each"))
    rows = df.orderBy("id").collect()
    assert all(r["one"] == r["each"] for r in rows) and '"bill_to":null' in rows[1]["one"] and '"bill_to":"é}"' in rows[2]["one"] and "invoice_date" not in rows[2]["one"]
    both = spark.range(1).select("id", record.alias("r"))
    text = both.select(invoices.spelled(F.col("r"), {"payment_terms": null, "notes": null}).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert text.count("to_json(") == 2
