"""The invoice record: lax coercions, constraints, error summaries and pass/fail routing.

The payload is a VARIANT, so a value's JSON type is seen before it is coerced: numbers are no strings, numeric strings
and booleans are numbers. Every check is a column; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import pyjson
from millrace.functions import text as X
from millrace.functions.recover import is_object, kind

# Fixed values of the contract, in order of declaration.
OPTIONAL_TEXT = ("vendor_address", "invoice_number", "bill_to", "payment_terms", "notes")
DATES = ("invoice_date", "due_date")
FIELDS = ("vendor_name", "vendor_address", "invoice_number", "invoice_date", "due_date", "bill_to", "line_items", "subtotal", "tax_amount", "tax_rate", "total_amount", "currency", "payment_terms", "notes")
OPTIONAL = ("vendor_address", "invoice_number", "invoice_date", "due_date", "bill_to", "subtotal", "tax_amount", "tax_rate", "payment_terms", "notes")
ITEM = "struct<description:string,quantity:double,unit_price:double,total:double>"
RECORD = "struct<vendor_name:string,vendor_address:string,invoice_number:string,invoice_date:string,due_date:string,bill_to:string,line_items:array<" + ITEM + ">,subtotal:double,tax_amount:double,tax_rate:double,total_amount:double,currency:string,payment_terms:string,notes:string>"

MISSING, NOT_TEXT, NOT_NUMBER, NOT_PARSED = "Field required", "Input should be a valid string", "Input should be a valid number", "Input should be a valid number, unable to parse string as a number"
NOT_LIST, NO_ITEMS, NOT_OBJECT, NO_TEXT, NOT_FINITE = "Input should be a valid list", "List should have at least 1 item after validation, not 0", "Input should be a valid object", "String should have at least 1 character", "Input should be a finite number"
BAD_DATE, BAD_RATE, NEGATIVE, BAD_CURRENCY, NEGATIVE_ITEM = "Value error, date must be YYYY-MM-DD", "Value error, tax_rate must lie between 0 and 1", "Value error, total_amount must not be negative", "String should have exactly 3 characters", "Value error, line item totals must not be negative"

NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN")
NUMBER_TEXT = r"^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def type_of(field: str) -> str:
    """The JSON type of a field."""
    if field == "line_items":
        return "array"
    return "number" if field in ("subtotal", "tax_amount", "tax_rate", "total_amount") else "string"


def schema(spark: SparkSession) -> DataFrame:
    """The record's fields in order: place, field, type, required."""
    rows = [(k, f, type_of(f), f not in OPTIONAL) for k, f in enumerate(FIELDS)]
    return spark.createDataFrame(rows, "place int, field string, type string, required boolean")


def get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_number(v: Column) -> Column:
    """A number, boolean or numeric text as a double, by Python's rules; null if it is none."""
    return _number(kind(v), v)


def _number(k: Column, v: Column) -> Column:
    """The same where the value's schema is known."""

    def parsed(t: Column) -> Column:
        word = F.lower(t)
        out = F.when(t.rlike(NUMBER_TEXT), F.regexp_replace(t, "_", "").try_cast("double"))
        for names, value in ((("inf", "+inf", "infinity", "+infinity"), "Infinity"), (("-inf", "-infinity"), "-Infinity"), (("nan", "+nan", "-nan"), "NaN")):
            out = F.when(word.isin(*names), F.lit(float(value))).otherwise(out)
        return out

    return F.when(_is_number(k), F.try_variant_get(v, "$", "double")).when(k == "STRING", X.bind(X.strip(as_text(v)), parsed))


def absent(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


_NUMBER = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+, ?\d+\))"


def plain_schema() -> str:
    """What the schema of a payload looks like whose fields are all of their own types; keys come in alphabetical order."""
    item = rf"OBJECT<description: STRING(, quantity: ({_NUMBER}|VOID))?, total: {_NUMBER}(, unit_price: ({_NUMBER}|VOID))?>"
    kinds = {"string": "STRING", "number": _NUMBER, "array": f"ARRAY<{item}>"}
    parts = []
    for f in sorted(FIELDS):
        k = kinds[type_of(f)]
        parts.append(rf"({f}: ({k}|VOID)(, |>))?" if f in OPTIONAL else rf"{f}: {k}(, |>)")
    return "^OBJECT<" + "".join(parts) + "$"


def _tidy(r: Column) -> Column:
    own = {f: X.strip(r[f]) for f in DATES} | {"currency": F.upper(X.strip(r["currency"]))}
    return F.when(r.isNotNull(), F.struct(*(own.get(f, r[f]).alias(f) for f in FIELDS)))


def _sound(r: Column) -> Column:
    wrong_item = lambda x: x["description"].isNull() | (F.length(x["description"]) == 0) | ~F.coalesce((x["total"] >= 0) & (x["total"] < float("inf")), F.lit(False))
    day = lambda f: r[f].isNull() | r[f].rlike(r"^\d{4}-\d{2}-\d{2}$")
    rate = r["tax_rate"].isNull() | r["tax_rate"].between(0.0, 1.0)
    ok = (r["total_amount"] >= 0) & rate & (F.length(r["currency"]) == 3) & day("invoice_date") & day("due_date") & (F.size(r["line_items"]) > 0) & ~F.exists(r["line_items"], wrong_item)
    return F.when(ok, r)


def plain(v: Column) -> Column:
    """The record of a payload that is valid as it stands, null of any other.

    Nearly all payloads are of this kind: one look at the schema and one typed extraction tell, and only the others need
    ``errors`` and ``record``, which look at each value's JSON type.
    """
    typed = F.when(F.schema_of_variant(v).rlike(plain_schema()), F.try_variant_get(v, "$", RECORD))

    return X.bind(X.bind(typed, _tidy), _sound).cast(RECORD)


def plain_text() -> str:
    """What a text looks like that is one strict object with the contract's fields, in order, each of its own type.

    Every part is possessive, so the text is read once. Escapes and numbers of more digits are left to the parsers.
    """
    w = r"[ \t\n\r]*+"
    kinds = {"string": r'"[^"\\\x00-\x1F]*+"', "number": r"-?+(?:0|[1-9]\d{0,14}+)(?:\.\d{1,17}+)?+(?:[eE][+-]?+\d{1,2}+)?+"}

    def members(fields: list[tuple[str, str, bool]]) -> str:
        out = ""
        for place, (f, of, optional) in enumerate(fields):
            one = f'{"," if place else ""}{w}"{f}"{w}:{w}(?:{of}{"|null" if optional else ""}){w}'
            out += f"(?:{one})?+" if optional else one
        return r"\{" + out + r"\}"

    item = members([("description", kinds["string"], False), ("quantity", kinds["number"], True), ("unit_price", kinds["number"], True), ("total", kinds["number"], False)])
    kinds["array"] = rf"\[{w}{item}{w}(?:,{w}{item}{w})*+\]"
    return r"\A" + members([(f, kinds[type_of(f)], f in OPTIONAL) for f in FIELDS]) + r"\z"


def with_plain(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with the record of a text that ``plain_text`` proves and that is valid as it stands; null of any other."""
    for step in (F.when(text.rlike(plain_text()), F.from_json(text, RECORD)), _tidy(F.col(name)), _sound(F.col(name))):
        df = df.withColumn(name, X.once(step))
    return df


#: A payload with the values of its fields side by side: one extraction gives them all.
VALUES = "struct<" + ",".join("line_items:array<struct<description:variant,quantity:variant,unit_price:variant,total:variant>>" if f == "line_items" else f"{f}:variant" for f in FIELDS) + ">"
SCALARS = tuple(f for f in FIELDS if f != "line_items")
ITEM_NUMBERS = ("quantity", "unit_price", "total")


def _values(v: Column, root: str = "$") -> Column:
    def of(x: Column) -> Column:
        # most have items, which tell that the field is given
        given = x["line_items"].isNotNull() | F.try_variant_get(v, f"{root}.line_items", "variant").isNotNull()
        return F.struct(x.alias("v"), F.coalesce(given, F.lit(False)).alias("given"))

    return X.bind(F.try_variant_get(v, root, VALUES), of)


def _is_number(k: Column) -> Column:
    return k.isin(*NUMBERS) | F.startswith(k, F.lit("DECIMAL"))


def _field(f: str, k: Column, v: Column) -> Column:
    """The coerced value of a field but the items, of its schema and its value."""
    if f in DATES:
        return F.when(k != "VOID", X.strip(as_text(v)))
    if f == "currency":
        return F.when(k == "VOID", "NONE").when(k == "BOOLEAN", F.upper(as_text(v))).otherwise(F.upper(X.strip(as_text(v))))
    return _number(k, v) if type_of(f) == "number" else F.when(k != "VOID", as_text(v))


def _item(x: Column) -> Column:
    """An item's kinds and coerced values; all null but ``object`` if it is no object."""
    kinds = F.struct(*(F.schema_of_variant(x[f]).alias(f) for f in ("description", *ITEM_NUMBERS)))
    parts = lambda k: F.struct(x.isNotNull().alias("object"), k.alias("kinds"), as_text(x["description"]).alias("description"), *(_number(k[f], x[f]).alias(f) for f in ITEM_NUMBERS))
    return X.bind(kinds, parts)


def _items(s: Column) -> Column:
    return F.transform(s["v"]["line_items"], _item)


def _own_number(k: Column) -> Column:
    return k.isNull() | (k == "VOID") | (_is_number(k) & (k != "BOOLEAN"))


def _own_item(x: Column) -> Column:
    """Whether an item is an object whose values are all of their own types."""
    number = lambda f: X.bind(F.schema_of_variant(x[f]), _own_number)
    return F.coalesce((F.schema_of_variant(x["description"]) == "STRING") & number("total") & number("quantity") & number("unit_price"), F.lit(False))


def _short(f: str, k: Column, r: Column, v: Column) -> Column:
    """``_field`` where the typed reading of the text is known; of a text of another type it says nothing."""
    if type_of(f) == "number":
        return r[f]
    text = X.strip(r[f]) if f in DATES else F.upper(X.strip(r[f])) if f == "currency" else r[f]
    return F.when(k == "STRING", text).when(k.isNotNull(), _field(f, k, v))


def _wrong_text(k: Column, required: bool) -> Column:
    wrong = F.when(k != "STRING", NOT_TEXT)
    return F.when(k.isNull(), MISSING).otherwise(wrong) if required else F.when(k != "VOID", wrong)


def _wrong_number(k: Column, n: Column, required: bool) -> Column:
    wrong = F.when(n.isNull(), F.when(k == "STRING", NOT_PARSED).otherwise(NOT_NUMBER))
    return F.when(k.isNull(), MISSING).otherwise(wrong) if required else F.when(k != "VOID", wrong)


def _wrong(f: str, k: Column, x: Column) -> Column:
    """What is wrong with a field but the items, by its kind and its coerced value; null if nothing is."""
    if f == "vendor_name":
        return _wrong_text(k, True)
    if f in OPTIONAL_TEXT:
        return _wrong_text(k, False)
    if f in DATES:
        return F.when((k != "VOID") & ~F.coalesce(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), BAD_DATE)
    if f == "tax_rate":
        return F.coalesce(_wrong_number(k, x, False), F.when(F.isnan(x) | ~x.between(0.0, 1.0), BAD_RATE))
    if f == "total_amount":
        return F.coalesce(_wrong_number(k, x, True), F.when(~F.isnan(x) & (x < 0), NEGATIVE))
    if f == "currency":
        return F.when(k.isNull(), MISSING).when(F.coalesce(F.length(x), F.lit(0)) != 3, BAD_CURRENCY)
    return _wrong_number(k, x, False)


def _at(place: str | Column, error: Column) -> Column:
    place = F.lit(place) if isinstance(place, str) else place
    return F.when(error.isNotNull(), F.concat(place, F.lit(": "), error))


def _sound_item(x: Column) -> Column:
    given = lambda f: x[f].isNotNull() | F.coalesce(x["kinds"][f] == "VOID", F.lit(True))
    text = F.coalesce((x["kinds"]["description"] == "STRING") & (F.length(x["description"]) > 0), F.lit(False))
    return x["object"] & text & given("quantity") & given("unit_price") & F.coalesce(F.abs(x["total"]) < float("inf"), F.lit(False))


def _item_errors(x: Column, i: Column) -> Column:
    place = lambda f: F.concat(F.lit("line_items."), i.cast("string"), F.lit(f".{f}"))
    k, n = x["kinds"], x["total"]
    own = F.array(
        _at(place("description"), F.coalesce(_wrong_text(k["description"], True), F.when(F.length(x["description"]) == 0, NO_TEXT))),
        _at(place("quantity"), _wrong_number(k["quantity"], x["quantity"], False)),
        _at(place("unit_price"), _wrong_number(k["unit_price"], x["unit_price"], False)),
        _at(place("total"), F.coalesce(_wrong_number(k["total"], n, True), F.when(F.isnan(n) | (F.abs(n) == float("inf")), NOT_FINITE))),
    )
    return F.when(x["object"], own).otherwise(F.array(F.concat(F.lit("line_items."), i.cast("string"), F.lit(f": {NOT_OBJECT}"))))


def _kinds(s: Column) -> Column:
    return F.struct(*(F.schema_of_variant(s["v"][f]).alias(f) for f in SCALARS))


def _coerced(s: Column, k: Column) -> Column:
    return F.struct(*(_field(f, k[f], s["v"][f]).alias(f) for f in SCALARS))


def _judgement(s: Column, k: Column, c: Column, items: Column, typed: Column | None = None) -> Column:
    """Errors and record; ``typed`` has the items where all their values are of their own types."""
    typed = F.lit(None).cast(f"array<{ITEM}>") if typed is None else typed
    sound = lambda x: (F.length(x["description"]) > 0) & (x["total"].isNotNull()) & (F.abs(x["total"]) < float("inf"))
    own = lambda names: F.array_compact(F.array(*(_at(f, _wrong(f, k[f], c[f])) for f in names)))
    given = s["v"]["line_items"]
    whole = F.when(~s["given"], MISSING).when(given.isNull(), NOT_LIST).when(F.size(given) == 0, NO_ITEMS)
    of_items = F.when(whole.isNotNull(), F.array(_at("line_items", whole))).when(F.forall(typed, sound) | F.forall(items, _sound_item), no_errors()).otherwise(F.array_compact(F.flatten(F.transform(F.coalesce(items, _items(s)), _item_errors))))
    place = FIELDS.index("line_items")
    found = F.concat(own(FIELDS[:place]), of_items, own(FIELDS[place + 1 :]))
    # the check of the whole record has no place, and runs only when every field is valid
    negative = F.coalesce(F.exists(F.coalesce(typed, _records(items)), lambda x: x["total"] < 0), F.lit(False))
    record_errors = lambda e: F.when(F.size(e) > 0, e).when(negative, F.array(F.lit(f": {NEGATIVE_ITEM}"))).otherwise(e)
    parts = {f: c[f] for f in SCALARS} | {"line_items": F.coalesce(typed, _records(items))}
    return F.struct(X.bind(found, record_errors).alias("errors"), F.struct(*(parts[f].alias(f) for f in FIELDS)).alias("record"))


def _records(items: Column) -> Column:
    return F.transform(items, lambda x: F.struct(*(x[f].alias(f) for f in ("description", *ITEM_NUMBERS))))


def judged(v: Column) -> Column:
    """Struct of errors (all, as "place: message" in order of declaration; empty if valid) and the coerced record.

    Each value is extracted, told by its JSON type and coerced once; the record is meaningful where there are no errors.
    """
    of = lambda s, k, c: X.bind(_items(s), lambda i: _judgement(s, k, c, i))
    return X.bind(_values(v), lambda s: X.bind(_kinds(s), lambda k: X.bind(_coerced(s, k), lambda c: of(s, k, c))))


def with_judged(df: DataFrame, v: Column, name: str, text: Column | None = None, two: Column | None = None, where: Column | None = None) -> DataFrame:
    """df with ``judged`` as a column. Its steps are columns too, so they run as compiled code; inside a lambda they don't.

    ``two`` (from ``pyjson.enclosed``) and its text stand for the payload where there are any, and v elsewhere. Rows that
    ``where`` leaves out aren't judged and get null.
    """
    s, k, c, i, r = (F.col(f"__{name}_{x}") for x in ("s", "k", "c", "i", "r"))
    values = _values(v) if two is None else F.when(two.isNotNull(), _values(two, "$[0]")).otherwise(_values(v))
    df = df.withColumn(f"__{name}_s", X.once(values)).withColumn(f"__{name}_k", X.once(_kinds(s)))
    typed = F.lit(None).cast(RECORD)
    if two is not None:
        # the typed reading of a text costs much less than values taken one by one, but tells nothing of numbers of other types
        own = F.forall(s["v"]["line_items"], _own_item)
        for f in SCALARS:
            own = own & _own_number(k[f]) if type_of(f) == "number" else own
        typed = F.when(two.isNotNull() & own, F.from_json(text, RECORD))
    df = df.withColumn(f"__{name}_r", X.once(typed))
    short = F.struct(*(_short(f, k[f], r, s["v"][f]).alias(f) for f in SCALARS))
    df = df.withColumns({f"__{name}_c": X.once(F.when(r.isNotNull(), short).otherwise(_coerced(s, k))), f"__{name}_i": X.once(F.when(r.isNull(), _items(s)))})
    out = _judgement(s, k, c, i, r["line_items"])
    return df.withColumn(name, X.once(out if where is None else F.when(where, out))).drop(*(f"__{name}_{x}" for x in ("s", "k", "c", "i", "r")))


def errors(v: Column) -> Column:
    """All errors of a payload as "place: message", in order of declaration; empty if it is valid."""
    return judged(v)["errors"]


def record(v: Column) -> Column:
    """The coerced record; meaningful where ``errors`` is empty."""
    return judged(v)["record"]


def no_errors() -> Column:
    return F.array().cast("array<string>")


def summary(found: Column, shown: int = 3) -> Column:
    """The first errors joined, and how many more there are; null if there is none."""
    more = F.when(F.size(found) > shown, F.concat(F.lit(" (+ "), (F.size(found) - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.size(found) > 0, F.concat(F.array_join(F.slice(found, 1, shown), "; "), more))


def reason_key(error: Column) -> Column:
    return F.substring_index(error, ":", 1)


def validate(df: DataFrame, payload: str = "ground_truth_json") -> DataFrame:
    """With validation_error (null if valid) and record (null unless valid). The payload is VARIANT or JSON text."""
    p, two, v = F.col(payload), F.col("__two"), F.col("__v")
    if dict(df.dtypes)[payload] == "variant":
        df, text = df.withColumn("__v", p).withColumn("__two", F.lit(None).cast("variant")), F.lit(None).cast("string")
    else:
        df, text = df.withColumn("__two", X.once(pyjson.enclosed(p))), p
        df = df.withColumn("__v", X.once(pyjson.parse(F.when(two.isNull(), p))))
    wrong = F.when(two.isNotNull() | is_object(v), None).when(v.isNull() | (kind(v) == "VOID"), f"Missing '{payload}' key").otherwise(F.concat(F.lit(f"{payload} is not a dict, got "), F.lower(kind(v))))
    df = with_judged(df.withColumn("__wrong", X.once(wrong)), v, "__judged", text, two).drop("__v", "__two")
    df = df.withColumn("validation_error", X.once(F.coalesce("__wrong", summary(F.col("__judged.errors")))))
    return df.withColumn("record", F.when(F.col("validation_error").isNull(), F.col("__judged.record"))).drop("__judged", "__wrong")


def route(df: DataFrame, error: str = "validation_error") -> tuple[DataFrame, DataFrame]:
    """(passed, failed) by a column that is null for the rows that pass."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def stats(df: DataFrame, difficulties: tuple[str, ...] = ("easy", "medium", "hard")) -> DataFrame:
    """One row: n_total, n_valid, n_failed, by_scenario, by_difficulty (valid rows only, fixed difficulties)."""
    ok = F.col("validation_error").isNull()
    of = lambda d: F.count_if(ok & (F.col("difficulty") == d)).alias(f"n_{d}")
    rows = df.groupBy(F.coalesce("scenario_id", F.lit("unknown")).alias("scenario")).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), *map(of, difficulties))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    valid = F.collect_list(F.when(F.col("ok") > 0, F.struct("scenario", "ok")))
    by = F.create_map(*(x for d in difficulties for x in (F.lit(d), total(f"n_{d}"))))
    return rows.agg(total("n").alias("n_total"), total("ok").alias("n_valid"), (total("n") - total("ok")).alias("n_failed"), F.map_from_entries(F.array_sort(valid)).alias("by_scenario"), by.alias("by_difficulty"))


def top_reasons(df: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent failure reasons: the place of the first error, empty for a failure of the whole record."""
    return df.where("validation_error is not null").groupBy(reason_key(F.col("validation_error")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def stats_long(df: DataFrame) -> DataFrame:
    """Rows (kind, key, n_total, n_valid): totals, and counts by scenario and by difficulty, of any number, in one pass."""
    ok = F.count_if(F.col("validation_error").isNull()).alias("n_valid")
    keys = df.select(F.coalesce("scenario_id", F.lit("unknown")).alias("scenario"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"), "validation_error")
    sets = keys.groupingSets([["scenario"], ["difficulty"], []], "scenario", "difficulty").agg(F.count("*").alias("n_total"), ok, F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "scenario").otherwise("difficulty")
    return sets.select(kind.alias("kind"), F.coalesce("scenario", "difficulty", F.lit("")).alias("key"), "n_total", "n_valid")


#: Constraints of fields beyond their type, in the words of JSON schemas.
CONSTRAINTS = {"vendor_name": {}, "invoice_date": {"pattern": r"^\d{4}-\d{2}-\d{2}$"}, "due_date": {"pattern": r"^\d{4}-\d{2}-\d{2}$"}, "line_items": {"minItems": 1}, "tax_rate": {"minimum": 0, "maximum": 1}, "total_amount": {"minimum": 0}, "currency": {"minLength": 3, "maxLength": 3}, "description": {"minLength": 1}, "total": {"minimum": 0}}


def json_schema(kind: T.DataType | None = None, required: tuple[str, ...] = ("vendor_name", "line_items", "total_amount", "currency", "description", "total"), name: str = "") -> dict:
    """A JSON schema of the record, or of any type, by a walk down its fields."""
    kind = T.StructType.fromDDL(RECORD.removeprefix("struct<").removesuffix(">")) if kind is None else kind
    own = CONSTRAINTS.get(name, {})
    if isinstance(kind, T.StructType):
        fields = {}
        for f in kind.fields:
            inner = json_schema(f.dataType, required, f.name)
            fields[f.name] = inner if f.name in required else inner | {"type": [inner["type"], "null"]}
        return {"type": "object", "properties": fields, "required": [f.name for f in kind.fields if f.name in required]} | own
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType, required)} | own
    return {"type": "string" if isinstance(kind, T.StringType) else "number"} | own


JSON_TYPES = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "OBJECT": "object", "ARRAY": "array"}


def departures(df: DataFrame, payload: str, schema: dict | None = None) -> DataFrame:
    """Rows (field, found, n): for each field of the schema the JSON types, or ``absent``, that it doesn't allow, with how often."""
    schema = json_schema() if schema is None else schema

    def allowed(f: str) -> list[str]:
        of = schema["properties"][f]["type"]
        return [of] if isinstance(of, str) else of

    v = F.col(payload)
    word = lambda x: F.when(x.isNull(), "absent").otherwise(F.coalesce(F.element_at(F.create_map(*(F.lit(y) for pair in JSON_TYPES.items() for y in pair)), kind(x)), F.lit("number")))
    rows = []
    for f in schema["properties"]:
        may = [*allowed(f), *(() if f in schema["required"] else ("absent",))]
        rows.append(F.struct(F.lit(f).alias("field"), X.bind(get(v, f), word).alias("found"), F.array(*map(F.lit, may)).alias("may")))
    seen = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where(~F.array_contains("may", F.col("found")))
    return seen.groupBy("field", "found").agg(F.count("*").alias("n"))


def table_schema(df: DataFrame, payload: str) -> str:
    """The schema that covers all payloads of a table, as one string: what the table has, to hold against the contract."""
    return df.agg(F.schema_of_variant_agg(payload)).first()[0]
