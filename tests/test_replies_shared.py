"""Replies of several variants: what is read alike is read once, and the pattern of plain records lets nothing else through."""

import json
import time

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import contract, serving

ITEM = {"description": "d", "quantity": 1, "unit_price": None, "total": 1.5}
FULL = {"vendor_name": "Ä V", "invoice_date": " 2024-01-02 ", "line_items": [ITEM, ITEM], "tax_rate": 0.5, "total_amount": 2, "currency": " usd ", "notes": "n"}
GOOD = json.dumps(FULL, ensure_ascii=False)


def test_variants_together_reply_as_alone(spark):
    odd = [{f: x} for f in FULL for x in (None, "x", 5, -1, 7.5, True, [], {}, [ITEM, 1], [{"description": "", "total": 1}], [{"description": "d", "total": -2}])]
    raws = [GOOD, f"so: {GOOD}", f"```json\n{GOOD}\n```", f"```\n{GOOD}", f"{GOOD}```", f"[{GOOD}]", "none", GOOD + "}", "", None, "} {", " " + GOOD + "\x1f", *(json.dumps(FULL | x) for x in odd)]
    df = spark.createDataFrame([(t,) for t in raws], "t string")
    both = serving.with_replies(df, "t", {"a": "api", "c": "cli"})
    x = both.select("t", "a", "c", X.once(serving.reply("t", "api")).alias("one"), X.once(serving.reply("t", "cli")).alias("two"))
    form = lambda r: (r["value"] and str(r["value"].toPython()), r["error"], r["raw"], r["schema_valid"], r["record"])
    for r in x.collect():
        assert (form(r["a"]), form(r["c"])) == (form(r["one"]), form(r["two"])), r["t"]


def test_only_strict_records_in_order_are_plain(spark):
    item = json.dumps(ITEM)
    yes = [GOOD, GOOD.replace(" ", ""), GOOD.replace(", ", ",\n\t"), GOOD.replace('"n"', "null"), GOOD.replace("0.5", "5e-1"), json.dumps(FULL | {"line_items": [ITEM] * 20000}, ensure_ascii=False)]
    no = [
        GOOD + "x", GOOD[:-1], GOOD.replace("}", ",}", 1), GOOD.replace('"n"}', '"n",}'), GOOD.replace('"n"', '"n", "notes": "m"'), GOOD.replace(item, item[:-1] + ', "total": 2}', 1), GOOD.replace('"n"', "5"), GOOD.replace("0.5", "05"),
        GOOD.replace("0.5", "NaN"), GOOD.replace("0.5", ".5"), GOOD.replace("0.5", '"0.5"'), GOOD.replace('"n"', '"\\n"'), GOOD.replace('"n"', '"a\nb"'), GOOD.replace('"n"', "n"), GOOD.replace('"notes"', '"other"'), "[" + GOOD + "]",
        json.dumps(dict(reversed(FULL.items()))), json.dumps({k: v for k, v in FULL.items() if k != "currency"}), GOOD.replace("0.5", "1.5"), GOOD.replace("usd", "us"), GOOD.replace(": 2,", ": -2,"), GOOD.replace("01-02", "1-2"), "", None,
    ]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    got = {r["t"]: r["r"] for r in contract.with_plain(df, F.col("t"), "r").collect()}
    assert {t for t, r in got.items() if r is not None} == set(yes)
    want = {r["t"]: r["j"] for r in df.select("t", X.once(contract.judged(F.try_parse_json("t"))).alias("j")).collect()}
    assert all(not want[t]["errors"] and want[t]["record"] == got[t] for t in yes)


def test_stripping_takes_linear_time(spark):
    spaces = "".join(c for c in map(chr, range(0x3100)) if c.isspace())
    texts = [spaces + "x" + spaces, spaces, "", "x" + " " * 300_000 + "x", "​x᠎"]
    began = time.time()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.strip("t").alias("s")).collect()
    assert [r["s"] for r in got] == [t.strip() for t in texts]
    assert time.time() - began < 20
