"""What the serving variants reply: recovery, then validation; a valid record comes back normalised on the command line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import pyjson
from millrace.functions import text as X
from millrace.functions.recover import SAID, is_object, unfenced
from millrace.operators import contract
from millrace.operators.contract import RECORD, judged


def reply(raw: Column | str, variant: str) -> Column:
    """Struct of value (VARIANT), error, raw (the beginning of what couldn't be read), schema_valid and record.

    "api": a text whose whole is a valid record gives it; any other is cut to its braces, and what is cut out counts as not
    valid even if it is. "cli": the whole text, valid or not; of a valid one ``record`` has the normalised fields.
    """
    if variant not in ("api", "cli"):
        raise ValueError(f"variant {variant!r} doesn't validate")
    raw = F.coalesce(X.col(raw), F.lit(""))
    no_braces, no_json, few, many = SAID[variant]
    t = unfenced(raw, variant)
    text = raw if variant == "cli" else t

    def of(x: Column) -> Column:
        valid = lambda j: F.when(x["whole"].isNotNull() & (F.size(j["errors"]) == 0), j["record"])
        return F.struct(x["whole"].alias("whole"), x["part"].alias("part"), x["braces"].alias("braces"), X.bind(judged(x["whole"]), valid).alias("record"))

    def told(x: Column) -> Column:
        # what is cut from an object is the object itself
        cut = F.coalesce(F.when(is_object(x["whole"]), x["whole"]), x["part"])
        value = x["whole"] if variant == "cli" else F.when(x["record"].isNotNull(), x["whole"]).otherwise(cut)
        error = F.when(value.isNull(), F.when(x["braces"], no_json).otherwise(no_braces))
        shown = F.when(value.isNull(), F.when(x["braces"], F.substring(text, 1, many)).otherwise(F.substring(text, 1, few)))
        normal = x["record"] if variant == "cli" else F.lit(None).cast(RECORD)
        return F.struct(value.alias("value"), error.alias("error"), shown.alias("raw"), x["record"].isNotNull().alias("schema_valid"), normal.alias("record"))

    return X.bind(X.bind(pyjson.read(t), of), told)


def with_reply(df: DataFrame, raw: str, variant: str, name: str) -> DataFrame:
    """df with ``reply`` as a column."""
    return with_replies(df, raw, {name: variant})


def with_replies(df: DataFrame, raw: str, variants: dict[str, str]) -> DataFrame:
    """df with a column of ``reply`` for each (name, variant); steps run as columns.

    A valid record in the contract's spelling is told by one pattern and read once, with its types. Another object that the engine
    alone can read doesn't go to Python. A text that two variants read alike is read and judged for the first of them only.
    """
    if wrong := [v for v in variants.values() if v not in ("api", "cli")]:
        raise ValueError(f"variant {wrong[0]!r} doesn't validate")
    parts, first = ("plain", "two", "rest", "judged"), next(iter(variants), None)
    at = lambda name, part: F.col(f"__{name}_{part}")
    for name, variant in variants.items():
        df = df.withColumn(f"__{name}_text", X.once(unfenced(raw, variant)))
        own = F.when(at(name, "text") != at(first, "text"), at(name, "text")) if name != first else at(name, "text")
        df = df.withColumn(f"__{name}_own", X.once(own))
        own, plain, two = (at(name, x) for x in ("own", "plain", "two"))
        df = contract.with_plain(df, own, f"__{name}_plain").withColumn(f"__{name}_two", X.once(pyjson.enclosed(F.when(plain.isNull(), own))))
        df = df.withColumn(f"__{name}_rest", X.once(pyjson.read(F.when(plain.isNull() & two.isNull(), own))))
        whole = at(name, "rest")["whole"]
        df = contract.with_judged(df, whole, f"__{name}_judged", own, two, two.isNotNull() | whole.isNotNull())
    for name, variant in variants.items():
        df = df.withColumn(name, _told(raw, variant, at(name, "text"), *(F.when(at(name, "own").isNull(), at(first, x)).otherwise(at(name, x)) for x in parts)))
    return df.drop(*(f"__{name}_{x}" for name in variants for x in ("text", "own", *parts)))


def _told(raw: str, variant: str, t: Column, plain: Column, two: Column, rest: Column, j: Column) -> Column:
    no_braces, no_json, few, many = SAID[variant]
    valid = plain.isNotNull() | F.coalesce(F.size(j["errors"]) == 0, F.lit(False))
    cut = F.coalesce(F.when(is_object(rest["whole"]), rest["whole"]), rest["part"])
    other = rest["whole"] if variant == "cli" else F.when(valid, rest["whole"]).otherwise(cut)
    failed, text = plain.isNull() & two.isNull() & other.isNull(), F.coalesce(F.col(raw), F.lit("")) if variant == "cli" else t
    error = F.when(failed, F.when(rest["braces"], no_json).otherwise(no_braces))
    shown = F.when(failed, F.when(rest["braces"], F.substring(text, 1, many)).otherwise(F.substring(text, 1, few)))
    normal = F.when(valid, F.coalesce(plain, j["record"])) if variant == "cli" else F.lit(None).cast(RECORD)
    value = F.coalesce(F.try_parse_json(F.when(plain.isNotNull(), t)), pyjson.first(two), other)
    return F.struct(value.alias("value"), error.alias("error"), shown.alias("raw"), valid.alias("schema_valid"), normal.alias("record"))
