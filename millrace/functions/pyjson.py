"""JSON as Python's parser reads it, as a VARIANT.

The engine's own parser stops after the first value and rejects repeated keys (Python keeps the last), NaN, Infinity and
-Infinity. So Python decides, in Arrow batches, in one linear pass: a text that holds none of these comes back as it is and
is parsed by the engine; the few others come back as a VARIANT. Lone surrogates become question marks on both ways, as
no UTF-8 text holds them. Texts nested deeper than about 900 levels aren't read.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X

_FIELDS = {"whole": T.StringType(), "whole_odd": T.VariantType(), "part": T.StringType(), "part_odd": T.VariantType(), "braces": T.BooleanType()}


def scanner():
    """A function from a text to (whether Python reads it, whether it is an object, strict text or None, VARIANT or None)."""
    from json import JSONDecoder

    from pyspark.errors import PySparkValueError
    from pyspark.sql.types import VariantVal
    from pyspark.sql.variant_utils import VariantBuilder

    odd: list[bool] = []

    def pairs(found):
        out = dict(found)
        if len(out) != len(found):
            odd.append(True)
        return out

    def constant(name):
        odd.append(True)
        return float(name)

    class Builder(VariantBuilder):
        def _append_string(self, s):
            super()._append_string(s.encode("utf-8", "replace").decode())

        def _add_key(self, key):
            return super()._add_key(key.encode("utf-8", "replace").decode())

    decode = JSONDecoder(object_pairs_hook=pairs, parse_constant=constant).decode

    def scan(text):
        odd.clear()
        try:
            value = decode(text)
            return True, isinstance(value, dict), *((None, VariantVal(*Builder().build(text))) if odd else (text, None))
        except (ValueError, RecursionError, PySparkValueError):
            return False, False, None, None

    return scan


#: Characters of the longest text whose reading is kept while its batch and the next one are read.
LONGEST_KEPT = 4096


@functools.cache
def _scanner():
    """One for each worker, and the readings of the last batch: the next one is often the same rows, unfenced another way."""
    return scanner(), {}


# no iterator of batches: each such function would take a worker of its own in every task, and queries read several texts
@F.pandas_udf(T.StructType([T.StructField(n, k) for n, k in _FIELDS.items()]))
def _read(t: pd.Series) -> pd.DataFrame:
    if t.isna().all():
        return pd.DataFrame({n: [False if n == "braces" else None] * len(t) for n in _FIELDS}, dtype="object")
    scan, last = _scanner()
    kept = {None: (None, None, None, None, False)}

    def one(text):
        if (found := kept.get(text)) is None:
            found = last.get(text) or read(text)
            if len(text) <= LONGEST_KEPT:
                kept[text] = found
        return found

    def read(text):
        _, is_object, whole, odd = scan(text)
        a, z = text.find("{"), text.rfind("}")
        braces = a >= 0 and z >= 0
        cut = scan(text[a : z + 1])[2:] if braces and not is_object else (None, None)
        return whole, odd, *cut, braces

    out = pd.DataFrame([one(x) for x in t], columns=list(_FIELDS), dtype="object")
    last.clear()
    last.update(kept)
    return out


#: Stands behind a text, to show that the engine has read all of it.
_END = "end of text \u2404"


def enclosed(t: Column | str) -> Column:
    """A list of the object that the whole text is and a word, where the engine alone can tell; null of any other text.

    The engine stops after the first value. So the text is read as the first of a list of two: the other is a word that isn't
    in the text (nor spelled there by escapes, as texts with a backslash are left to Python), and it comes second only if
    the text before it is one value. Repeated keys, NaN and the like fail here, and Python has to decide.
    """
    t = X.col(t)
    ours = F.startswith(t, F.lit("{")) & ~F.contains(t, F.lit("\\")) & ~F.contains(t, F.lit(_END))
    two = F.when(ours, F.try_parse_json(F.concat(F.lit("["), t, F.lit(f',"{_END}"]'))))
    return X.bind(two, lambda x: F.when(F.try_variant_get(x, "$[1]", "string") == _END, x))


def first(two: Column) -> Column:
    """The object of what ``enclosed`` gives."""
    return F.try_variant_get(two, "$[0]", "variant")


def with_parsed(df: DataFrame, t: Column, name: str) -> DataFrame:
    """df with ``parse`` of a text as a column; Python gets only what ``enclosed`` leaves."""
    df = df.withColumn("__text", X.once(t)).withColumn("__two", X.once(enclosed("__text")))
    rest = parse(F.when(F.col("__two").isNull(), F.col("__text")))
    return df.withColumn(name, X.once(F.coalesce(first(F.col("__two")), rest))).drop("__text", "__two")


def read(t: Column | str) -> Column:
    """Struct of whole and part (VARIANT or null) and braces, of a text.

    part is what lies between the first { and the last }, of a text that isn't an object as a whole; braces says whether
    there are both. Not for lambdas.
    """
    value = lambda x, f: F.coalesce(F.try_parse_json(x[f]), x[f"{f}_odd"]).alias(f)
    return X.bind(_read(X.col(t)), lambda x: F.struct(value(x, "whole"), value(x, "part"), x["braces"].alias("braces")))


def parse(t: Column | str) -> Column:
    """The value that Python's json.loads gives, or null where it raises; a JSON null is a VARIANT null. Not for lambdas."""
    return X.bind(_read(X.col(t)), lambda x: F.coalesce(F.try_parse_json(x["whole"]), x["whole_odd"]))
