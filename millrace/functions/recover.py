"""Recovery of a JSON object from a model's raw text. Six variants, which disagree; choose one by name.

Each gives a struct: ``value`` (VARIANT or null), ``error`` (null if recovered) and ``direct`` (parsed without cutting
out a block in braces). JSON is what Python's parser takes: of repeated keys the last counts, NaN and Infinity are numbers, and
nothing may follow the value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import pyjson
from millrace.functions import text as X

VARIANTS = ("generator", "scorer", "notebook", "api", "infer", "cli")


def kind(v: Column) -> Column:
    """The JSON type of a variant: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID; null if absent."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def is_object(v: Column) -> Column:
    # the schema of a whole object costs more than its fields' references
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def _result(value: Column, error: Column, direct: Column) -> Column:
    return F.struct(value.alias("value"), error.alias("error"), direct.alias("direct"))


def unfenced(raw: Column | str, variant: str) -> Column:
    """What a variant reads of a raw text."""
    raw = F.coalesce(X.col(raw), F.lit(""))
    if variant in ("generator", "scorer", "cli"):
        return X.strip_fences_by_line(raw)
    if variant in ("notebook", "api", "infer"):
        return X.strip_fences_anywhere(raw, trailing=variant == "api")
    raise ValueError(f"unknown variant {variant!r}")


def recover(raw: Column | str, variant: str = "scorer") -> Column:
    return recovered(unfenced(raw, variant), variant)


def recovered(t: Column, variant: str) -> Column:
    """The same of an unfenced text."""
    return X.bind(pyjson.read(t), lambda x: _choose(x, variant))


def _choose(x: Column, variant: str) -> Column:
    whole, part = x["whole"], x["part"]
    no_block = F.when(x["braces"], "JSON parse failed").otherwise("No JSON object found")
    if variant == "scorer":  # anything but an object is retried
        value, error = F.when(is_object(whole), whole).when(is_object(part), part), no_block
    elif variant == "cli":  # no retry
        value, error = F.when(is_object(whole), whole), F.lit("JSON parse failed")
    elif variant == "generator":  # an object of a text and an object; other JSON isn't retried
        found = F.coalesce(whole, part)
        ok = is_object(found) & (kind(F.try_variant_get(found, "$.document_text", "variant")) == "STRING") & (kind(F.try_variant_get(found, "$.ground_truth_json", "variant")) == "OBJECT")
        value, error = F.when(F.coalesce(ok, F.lit(False)), found), F.lit("no generated pair")
    else:
        value, error = F.coalesce(whole, part), F.when(x["braces"], "Could not parse output").otherwise("No JSON found")
        if variant == "notebook":  # an empty object counts as a failure
            value = F.when(F.size(F.try_variant_get(value, "$", "map<string,variant>")) > 0, value)
    return _result(F.coalesce(value, F.lit(None).cast("variant")), F.when(value.isNull(), error), whole.isNotNull())


#: Fixed values of the three serving variants: what is said without braces, what without JSON, and how much raw text is shown of each.
SAID = {"api": ("No JSON found", "Could not parse output", 200, 500), "infer": ("No JSON found in output", "Could not parse output", 500, 500), "cli": ("Could not parse model output",) * 2 + (500, 500)}


def answer(raw: Column | str, variant: str) -> Column:
    """What a serving variant answers: value (VARIANT), or error and the beginning of the raw text."""
    raw = F.coalesce(X.col(raw), F.lit(""))
    no_braces, no_json, few, many = SAID[variant]
    text = raw if variant == "cli" else X.strip_fences_anywhere(raw, trailing=variant == "api")

    found = pyjson.read(X.strip_fences_by_line(raw) if variant == "cli" else text)

    def of(x: Column) -> Column:
        value = x["whole"] if variant == "cli" else F.coalesce(x["whole"], x["part"])
        return F.struct(value.alias("value"), F.when(value.isNull(), F.when(x["braces"], no_json).otherwise(no_braces)).alias("error"), F.when(value.isNull(), F.when(x["braces"], F.substring(text, 1, many)).otherwise(F.substring(text, 1, few))).alias("raw"))

    return X.bind(found, of)
