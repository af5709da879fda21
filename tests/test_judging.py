"""Judging payloads and reading JSON with little work a row: the same results, and less that is computed."""

import json

from pyspark.sql import functions as F

from millrace.functions import pyjson
from millrace.functions import text as X
from millrace.operators import contract

ITEM = {"description": "d", "quantity": 1, "unit_price": None, "total": 1.5}
FULL = {"vendor_name": "V", "invoice_date": " 2024-01-02 ", "line_items": [ITEM, ITEM], "tax_rate": 0.5, "total_amount": 2, "currency": " usd ", "notes": "n"}
CASES = [FULL] + [FULL | {f: x} for f in FULL for x in (None, "x", " 1_0 ", 5, -1, 7.5, True, [], {}, [ITEM, 1], [ITEM, {"description": "", "total": -1}], [{"description": "d", "total": "nan"}], [{"description": "d", "total": -2}])]


def test_texts_are_judged_like_values(spark):
    df = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(CASES)], "k int, t string")
    by_value = df.select("k", X.once(contract.judged(F.try_parse_json("t"))).alias("j"))
    want = {r["k"]: r["j"] for r in by_value.collect()}
    x = contract.with_judged(df.withColumn("two", pyjson.enclosed("t")), F.lit(None).cast("variant"), "j", F.col("t"), F.col("two"))
    for r in x.collect():
        assert r["two"] is not None and r["j"]["errors"] == want[r["k"]]["errors"], CASES[r["k"]]
        assert r["j"]["errors"] or r["j"]["record"] == want[r["k"]]["record"], CASES[r["k"]]


def test_a_value_is_told_by_its_type_once(spark):
    """Each of the 13 fields and the four values of an item is looked at once, and again for errors of items alone."""
    plan = spark.range(1).select(F.parse_json(F.lit("{}")).alias("v")).select(contract.errors(F.col("v")).alias("e"))
    assert plan._jdf.queryExecution().analyzed().toString().count("schema_of_variant") <= 13 + 2 * 4


def test_only_whole_objects_are_enclosed(spark):
    yes = ['{"a":1}', '{"a":{"b":[1,"x"]}} \n', "{}"]
    no = ['{"a":1} x', '{"a":1}}', '{"a":1},{"b":2}', '{"a":1}] [{"b":2}', '{"a":1,"a":2}', '{"a":NaN}', '{"a":"\\u0041"}', " {}", "[1]", "1", "", "{", '{"a":1},"', '{"a":1},"end of text ␄"] [{}', '{"a":"x\ty"}', None]
    got = {r["t"]: r["v"] for r in spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", pyjson.first(pyjson.enclosed("t")).alias("v")).collect()}
    assert {t for t, v in got.items() if v is not None} == set(yes) and all(got[t].toPython() == json.loads(t) for t in yes)
    parsed = pyjson.with_parsed(spark.createDataFrame([(t,) for t in yes + no], "t string"), F.col("t"), "v").select("t", F.col("v").isNotNull().alias("ok"), pyjson.parse("t").isNotNull().alias("want"))
    assert all(r["ok"] == r["want"] for r in parsed.collect())
