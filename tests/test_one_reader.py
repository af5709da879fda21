"""Several readings of JSON in a query share one Python worker of each task."""

import json

from pyspark.sql import functions as F

from millrace.functions import pyjson
from millrace.functions.recover import VARIANTS, recover


def test_all_variants_take_one_python_step(spark):
    df = spark.createDataFrame([(1, '{"a":1}')], "k int, t string").select("k", *(recover("t", v)["value"].isNotNull().alias(v) for v in VARIANTS))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_repeated_and_long_texts_are_read_alike(spark):
    long = json.dumps({"a": "x" * (2 * pyjson.LONGEST_KEPT), "b": 1})
    texts = ['{"a":1,"a":2}', long, None, "none", '{"a":1}', '{"a":1,"a":2}', long, "} {", None, f"see {long}", '{"a":NaN}', '{"a":NaN}']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    read = pyjson.read("t")
    one = F.coalesce(read["whole"], read["part"])
    other = pyjson.read(F.concat(F.lit(" "), "t"))
    got = df.select("k", F.to_json(one).alias("x"), F.to_json(F.coalesce(other["whole"], other["part"])).alias("y"), read["braces"].alias("braces")).orderBy("k").collect()
    plain = ['{"a":2}', long.replace(": ", ":").replace(", ", ","), None, None, '{"a":1}']
    want = [*plain, *plain[:2], None, None, plain[1]]
    assert [r["x"] for r in got[:10]] == [r["y"] for r in got[:10]] == want
    assert [r["braces"] for r in got] == [t is not None and "{" in t and "}" in t for t in texts] and got[10]["x"] == got[11]["x"] is not None
