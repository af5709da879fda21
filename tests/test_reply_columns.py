"""Replies as columns of a table equal those of one expression."""

import json

from millrace.functions import text as X
from millrace.operators import serving

ITEM = {"description": "d", "quantity": 1, "unit_price": None, "total": 1.5}
FULL = {"vendor_name": "V", "invoice_date": " 2024-01-02 ", "line_items": [ITEM, ITEM], "tax_rate": 0.5, "total_amount": 2, "currency": " usd ", "notes": "n"}


def test_replies_as_columns(spark):
    good = json.dumps(FULL)
    raws = [good, json.dumps(FULL | {"total_amount": -1}), f"so: {good}", f"```json\n{good}\n```", f"[{good}]", "5", "none", good + "}", "", None, '{"a":NaN}', "} {"]
    df = spark.createDataFrame([(t,) for t in raws], "t string")
    for v in ("api", "cli"):
        x = serving.with_reply(df, "t", v, "quick").select("t", "quick", X.once(serving.reply("t", v)).alias("one"))
        form = lambda r: (r["value"] and str(r["value"].toPython()), r["error"], r["raw"], r["schema_valid"], r["record"])
        assert all(form(r["quick"]) == form(r["one"]) for r in x.collect())
