"""The notebook scorer: 14 fields on unvalidated JSON, line items matched by any equal item, means by difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import pyjson
from millrace.functions import text as X
from millrace.functions.recover import kind, recover
from millrace.operators.contract import RECORD, get, plain_schema
from millrace.operators.score import NUMERIC, SCORED, normalize_str

FIELDS = (*SCORED, "line_items")


def normalize(v: Column) -> Column:
    """A value as (type, text): text stripped and lower-case, numbers rounded to four places so that 5 equals 5.0."""
    k = kind(v)
    number = F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(F.bround(F.try_variant_get(v, "$", "double"), 4))
    return F.when(k == "STRING", F.struct(F.lit("s").alias("k"), F.lower(X.strip(F.try_variant_get(v, "$", "string"))).alias("v"))).when(
        k.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), F.struct(F.lit("n").alias("k"), number.cast("string").alias("v"))
    ).when(k.isin("ARRAY", "OBJECT"), F.struct(F.lit("j").alias("k"), F.to_json(v).alias("v")))


def same(a: Column, b: Column) -> Column:
    return X.bind(a, normalize).eqNullSafe(X.bind(b, normalize))


def line_items(predicted: Column, truth: Column) -> Column:
    """Share of truth items that some predicted item equals in description and total; not one-to-one."""
    none = F.array().cast("array<struct<d:struct<k:string,v:string>,t:struct<k:string,v:string>>>")
    keys = lambda v: F.coalesce(F.transform(F.try_variant_get(v, "$.line_items", "array<variant>"), lambda x: F.struct(normalize(get(x, "description")).alias("d"), normalize(get(x, "total")).alias("t"))), none)
    p, t = keys(predicted), keys(truth)
    hit = F.filter(t, lambda x: F.exists(p, lambda y: x["d"].eqNullSafe(y["d"]) & x["t"].eqNullSafe(y["t"])))
    return F.when(F.size(t) == 0, 1.0).when(F.size(p) == 0, 0.0).otherwise(F.size(hit) / F.size(t))


def typed(v: Column) -> Column:
    """The record of a payload whose fields are all of their own types, null of any other: there a field's type needn't be asked for."""
    return F.when(F.schema_of_variant(v).rlike(plain_schema()), F.try_variant_get(v, "$", RECORD))


def _typed_same(f: str, a: Column, b: Column) -> Column:
    form = (lambda x: F.bround(x, 4).cast("string")) if f in NUMERIC else normalize_str
    # most values are equal as they stand
    return a.eqNullSafe(b) | form(a).eqNullSafe(form(b))


def _typed_items(p: Column, t: Column) -> Column:
    keys = lambda items: F.transform(items, lambda x: F.struct(normalize_str(x["description"]).alias("d"), F.bround(x["total"], 4).cast("string").alias("t")))

    def share(x: Column) -> Column:
        hit = F.filter(x["t"], lambda i: F.exists(x["p"], lambda j: i["d"].eqNullSafe(j["d"]) & i["t"].eqNullSafe(j["t"])))
        return F.size(hit) / F.size(x["t"])

    other = X.bind(F.struct(keys(p).alias("p"), keys(t).alias("t")), share)
    return F.when(p.isNull(), 0.0).when(p.eqNullSafe(t), 1.0).otherwise(other)


def rows(df: DataFrame, raw: str = "raw_output", truth: str = "ground_truth_json", example_id: str = "id") -> DataFrame:
    """Rows (example_id, other columns, parsed_ok, scores map<field, double>).

    Payloads of the contract's types, nearly all of them, are compared as typed records; any other value by value.
    """
    kept = [c for c in df.columns if c not in (raw, truth, example_id)]
    t = F.col(truth) if dict(df.dtypes)[truth] == "variant" else pyjson.parse(F.col(truth))
    x = df.select(F.col(example_id).alias("example_id"), *kept, X.once(recover(F.col(raw), "notebook")["value"]).alias("__p"), X.once(t).alias("__t"))
    x = x.withColumn("__pr", X.once(typed(F.col("__p")))).withColumn("__tr", X.once(typed(F.col("__t"))))
    p, t, pr, tr = (F.col(c) for c in ("__p", "__t", "__pr", "__tr"))
    scores = F.create_map(*(v for f in SCORED for v in (F.lit(f), same(get(p, f), get(t, f)).cast("double"))), F.lit("line_items"), line_items(p, t))
    quick = F.create_map(*(v for f in SCORED for v in (F.lit(f), _typed_same(f, pr[f], tr[f]).cast("double"))), F.lit("line_items"), _typed_items(pr["line_items"], tr["line_items"]))
    known = tr.isNotNull() & (pr.isNotNull() | p.isNull())
    return x.select("example_id", *kept, p.isNotNull().alias("parsed_ok"), X.once(F.when(known, quick).otherwise(scores)).alias("scores"))


def aggregate(scores: DataFrame, difficulty: str = "difficulty", known: tuple[str, ...] = ("easy", "medium", "hard")) -> DataFrame:
    """One row: parse_rate, field_scores, overall (mean of all fields of all rows), by_difficulty (0 where there is none)."""
    at = lambda f: F.element_at("scores", F.lit(f))
    mean = sum((at(f) for f in FIELDS), F.lit(0.0)) / len(FIELDS)
    by = F.create_map(*(x for d in known for x in (F.lit(d), F.coalesce(F.avg(F.when(F.col(difficulty) == d, mean)), F.lit(0.0)))))
    return scores.agg(F.avg(F.col("parsed_ok").cast("double")).alias("parse_rate"), F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.avg(at(f))))).alias("field_scores"), F.avg(mean).alias("overall"), by.alias("by_difficulty"))
