"""Queries over rules on records, prompts, formats, recovery answers, reports and sources, with the same in DuckDB SQL.

They are registered beside those of ``queries`` when this module is imported.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import pyjson, similarity
from millrace.functions import text as X
from millrace.functions.recover import VARIANTS, answer, recover
from millrace.operators import contract, conversation, dedup_index, metrics, quality, scenarios, serving, split
from millrace.plans import evaluation
from millrace.plans.queries import FLAGS, ITEMS, SPACE, SPLIT, _raw, docs, query
from millrace.sources import append, invoices, jsonl
from millrace.sources.shared import shared_dir
from millrace.sources.tables import table
from millrace.streaming import sinks

STRIPPED = f"regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')"
OPTIONAL_NULLS = "(o_orderkey % 4 = 0)::INT + (o_orderkey % 5 = 0)::INT + (o_orderkey % 3 = 0)::INT"


def _judged(spark, d):
    """Records with text that break one rule each, by the key's remainder of 9."""
    k, r = F.col("o_orderkey") % 9, F.col("record")
    null = F.when(k == 5, F.lit("null"))
    instead = dict.fromkeys(contract.OPTIONAL, null) | {
        "total_amount": F.when(k == 0, F.lit("null")).when(k == 1, F.lit('"abc"')).when(k == 2, F.lit("0")).when(k == 3, F.lit("-1e2")).when(k == 8, F.lit('"-12345678.5"')),
        "line_items": F.when(k == 4, F.lit("[]")),
    }
    text = F.when(k == 6, "short 1").otherwise(" ".join(["Invoice 1", *(str(i * i) for i in range(1, 61))]))
    payload = F.parse_json(invoices.spelled(r, instead))
    return invoices.records(spark, d).select(F.col("o_orderkey").alias("id"), "scenario_id", "difficulty", text.alias("document_text"), payload.alias("ground_truth_json"))


@query(f"""WITH {ITEMS} SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'total_amount_missing' WHEN 1 THEN 'total_amount_not_numeric' WHEN 2 THEN 'total_amount_zero_or_negative (0.0)'
 WHEN 3 THEN 'total_amount_zero_or_negative (-100.0)' WHEN 4 THEN 'line_items_empty_or_missing' WHEN 5 THEN 'too_few_non_null_fields (0 < 3, scenario=scenario_' || (o_orderkey % 7) || ')' WHEN 6 THEN 'doc_too_short (7 < 100 chars)'
 WHEN 8 THEN 'total_amount_zero_or_negative (-12345678.5)' END AS reason FROM r""")
def quality_reason_full(spark, d):
    return _judged(spark, d).select("id", quality.reason().alias("reason"))


@query(f"WITH {ITEMS} SELECT o_orderkey AS id, 10 - ({OPTIONAL_NULLS}) AS n_filled FROM r")
def filled_fields(spark, d):
    x = invoices.records(spark, d)
    return x.select(F.col("o_orderkey").alias("id"), quality.filled(F.parse_json(invoices.spelled(F.col("record"), {}))).cast("long").alias("n_filled"))


@query(f"SELECT doc_id AS id, '{{\"z\":150.0,\"lang\":\"' || lang || '\",\"a\":[1,2500.0],\"n\":' || n_chars || '}}' AS gpt FROM documents WHERE {STRIPPED} <> ''")
def chat_format_json(spark, d):
    """Payloads as JSON text: keys keep their order and numbers their form."""
    payload = F.concat(F.lit('{ "z" : 150.0, "lang":"'), "lang", F.lit('" , "a": [1, 2.50e3], "n" : '), "n_chars", F.lit(" }"))
    x = docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document_text"), payload.alias("ground_truth_json"), F.lit("").alias("difficulty"), F.lit("").alias("scenario_id"))
    return conversation.render(x).select(F.col("id").cast("long").alias("id"), F.col("conversations")[2]["value"].alias("gpt"))


@query(f"SELECT count(*) AS input, count(*) FILTER ({STRIPPED} <> '') AS output, count(*) FILTER (coalesce({STRIPPED}, '') = '') AS skipped FROM documents")
def format_stats(spark, d):
    x = docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document_text"), F.struct("lang").alias("ground_truth_json"), F.lit("").alias("difficulty"), F.lit("").alias("scenario_id"))
    return conversation.stats(x, conversation.render(x))


@query("SELECT doc_id, 'Extract:' || chr(10) || coalesce(text, '') AS prompt FROM documents")
def extraction_prompts(spark, d):
    return docs(spark, d).select("doc_id", conversation.extraction_prompt(F.coalesce("text", F.lit("")), "Extract:\n").alias("prompt"))


@query("""SELECT doc_id, 'Write one synthetic document: ' || source || '.' || chr(10) || chr(10) || 'Difficulty: EASY' || chr(10) || 'Currency: USD' || chr(10) || chr(10) || 'Style:' || chr(10) || lang
 || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Edge cases that the document must show:' || chr(10) || '  • no total' || chr(10) || '  • ' || lang ELSE '' END
 || chr(10) || chr(10) || 'The record must conform to:' || chr(10) || 'RECORD' || chr(10) || chr(10) || 'Answer with a JSON object with the keys document_text and ground_truth_json only.' AS prompt FROM documents""")
def generation_prompts(spark, d):
    cases = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("no total"), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    scenario = {"name": F.col("source"), "difficulty": F.lit("easy"), "currency": F.lit("USD"), "style_notes": F.col("lang"), "edge_cases": cases}
    return docs(spark, d).select("doc_id", conversation.generation_prompt(scenario, "RECORD").alias("prompt"))


_RAW = "CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN 'Sure: ' || props || ' ok' WHEN 3 THEN '[' || props || ']' WHEN 4 THEN left(props, len(props) - 1) WHEN 5 THEN 'none' WHEN 6 THEN '{}' ELSE '} {' END"


@query(f"""SELECT event_id, CASE WHEN k IN (4, 5) THEN 'No JSON found' WHEN k = 7 THEN 'Could not parse output' END AS api_error, CASE WHEN k IN (4, 5) THEN left(raw, 200) WHEN k = 7 THEN left(raw, 500) END AS api_raw,
 CASE WHEN k IN (4, 5) THEN 'No JSON found in output' WHEN k = 7 THEN 'Could not parse output' END AS infer_error, CASE WHEN k IN (4, 5, 7) THEN left(raw, 500) END AS infer_raw,
 CASE WHEN k IN (2, 4, 5, 7) THEN 'Could not parse model output' END AS cli_error, CASE WHEN k IN (2, 4, 5, 7) THEN left(raw, 500) END AS cli_raw FROM (SELECT event_id, event_id % 8 AS k, {_RAW} AS raw FROM events)""")
def recovery_answers(spark, d):
    x = _raw(spark, d).select("event_id", *(answer("raw", v).alias(v) for v in ("api", "infer", "cli")))
    return x.select("event_id", *(F.col(f"{v}.{f}").alias(f"{v}_{f}") for v in ("api", "infer", "cli") for f in ("error", "raw")))


@query("SELECT CASE event_id % 8 WHEN 3 THEN 'not an object' WHEN 0 THEN 'good' WHEN 6 THEN 'good' ELSE 'malformed JSON' END AS problem, count(*) AS n FROM events GROUP BY 1")
def line_problems(spark, d):
    """JSON lines by what is wrong with them."""
    x = _raw(spark, d).select(F.col("raw").alias("line"), pyjson.parse("raw").alias("value"))
    return jsonl.judge(x).groupBy(F.coalesce("problem", F.lit("good")).alias("problem")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN printf('gen-%05d', row_number() OVER (ORDER BY doc_id) - 1) ELSE 'd' || doc_id END AS id FROM documents")
def example_ids(spark, d):
    x = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("d"), "doc_id")).alias("id"))
    return jsonl.with_ids(x, "doc_id", form="gen-%05d").select("doc_id", "id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'out ' || lang END AS raw_output FROM documents")
def prediction_join(spark, d):
    x = docs(spark, d).select(F.col("doc_id").alias("id"), "lang")
    got = evaluation.joined(x.where(F.col("id") % 3 != 0).select("id", F.concat(F.lit("out "), "lang").alias("raw_output")), x)
    return got.select("id", "raw_output")


_RATES = "SELECT event_type, avg((user_id % 2)::INT)::DOUBLE AS a, avg((user_id % 5 = 0)::INT)::DOUBLE AS b FROM events GROUP BY event_type"


@query(f"SELECT event_type, CASE WHEN b - a >= 0 THEN '+' ELSE '' END || printf('%.1fpp', (b - a) * 100) AS delta, repeat('█', floor(a * 20)::INT) AS bar FROM ({_RATES})")
def metric_deltas(spark, d):
    rates = table(spark, d, "events").groupBy("event_type").agg(F.avg(F.col("user_id") % 2).alias("a"), F.avg((F.col("user_id") % 5 == 0).cast("int")).alias("b"))
    return rates.select("event_type", metrics.delta(F.col("a"), F.col("b")).alias("delta"), metrics.bar(F.col("a")).alias("bar"))


_OUTPUT = f"WITH {ITEMS}, o AS (SELECT *, o_orderkey % 12 AS k, ['USD', 'EUR', 'GBP', 'CAD'][s_nationkey % 4 + 1] AS currency FROM r)"


@query(f"""{_OUTPUT} SELECT o_orderkey AS id, k NOT IN (5, 6, 7) AS api_valid, CASE WHEN k = 6 THEN 'Could not parse output' END AS api_error, k NOT IN (5, 6, 7) AS cli_valid, CASE WHEN k IN (5, 6) THEN 'Could not parse model output' END AS cli_error,
 CASE WHEN k NOT IN (5, 6, 7) THEN currency END AS cli_currency, CASE WHEN k NOT IN (5, 6, 7) THEN o_totalprice + CASE WHEN k = 3 THEN 0.004::DOUBLE ELSE 0::DOUBLE END END AS cli_total FROM o""")
def serving_replies(spark, d):
    """Replies to model outputs: validity on both surfaces, and the normalised record of the command line."""
    x = serving.with_replies(invoices.outputs(spark, d).select("id", "raw_output"), "raw_output", {v: v for v in ("api", "cli")})
    both = (F.col(f"{v}.{f}").alias(f"{v}_{n}") for v in ("api", "cli") for f, n in (("schema_valid", "valid"), ("error", "error")))
    return x.select("id", *both, F.col("cli.record.currency").alias("cli_currency"), F.col("cli.record.total_amount").alias("cli_total"))


#: Texts that only Python's parser reads (or refuses), by the key's remainder of 10.
ODD_JSON = (
    lambda p: F.concat(F.lit('{"k":-1,"a":0,"k":-2,'), F.substring(p, F.lit(2), F.length(p))), lambda p: F.concat(F.lit('{"a":NaN,'), F.substring(p, F.lit(2), F.length(p))), lambda p: F.lit("[-Infinity, 1]"),
    lambda p: F.concat(p, F.lit(" x")), lambda p: F.concat(p, F.lit("}")), lambda p: F.lit('{"a":Infinity} {"b":2}'), lambda p: F.lit("NaN"), lambda p: F.lit('{"a":{"b":1,"b":[1,{"c":0,"c":NaN}]}}'),
    lambda p: F.lit('```json\n{"document_text":1,"document_text":"y","ground_truth_json":{"a":1,"a":NaN}}\n```'), lambda p: p,
)
_READS = {"generator": "8", "scorer": "0, 1, 3, 7, 8, 9", "notebook": "0, 1, 3, 7, 8, 9", "api": "0, 1, 2, 3, 6, 7, 8, 9", "infer": "0, 1, 2, 3, 6, 7, 8, 9", "cli": "0, 1, 7, 8, 9"}


@query("SELECT event_id, " + ", ".join(f"event_id % 10 IN ({r}) AS {v}" for v, r in _READS.items()) + ", CASE WHEN event_id % 10 IN (0, 1, 3, 9) THEN json_extract_string(props, '$.k')::BIGINT END AS k, CASE event_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 'NaN'::DOUBLE END AS a, CASE WHEN event_id % 10 = 7 THEN 'NaN'::DOUBLE END AS deep FROM events")
def recover_lenient(spark, d):
    """Repeated keys, bare NaN and Infinity, and what follows a value, in all six variants."""
    p = F.col("props")
    raw = F.element_at(F.array(*(f(p) for f in ODD_JSON)), (F.col("event_id") % 10 + 1).cast("int"))
    x = table(spark, d, "events").select("event_id", raw.alias("raw")).select("event_id", *(recover("raw", v)["value"].alias(v) for v in VARIANTS))
    at = lambda path, kind: F.try_variant_get("scorer", path, kind)
    return x.select("event_id", *(F.col(v).isNotNull().alias(v) for v in VARIANTS), at("$.k", "bigint").alias("k"), at("$.a", "double").alias("a"), at("$.a.b[1].c", "double").alias("deep"))


# recursive: the longest common block of a pair of stretches, the earliest of equals, then the stretches on both sides
_BLOCKS = """WITH RECURSIVE t AS (SELECT p_partkey AS k, ' ' || upper(p_name) || ' ' || p_brand || ' ' || p_type || chr(9) AS raw, p_size FROM part),
p AS (SELECT a.k, lower(trim(CASE WHEN a.p_size % 10 <> 0 THEN a.raw END, ' ' || chr(9))) AS a, lower(trim(CASE WHEN b.p_size % 15 <> 0 THEN b.raw END, ' ' || chr(9))) AS b FROM t a JOIN t b ON b.k = a.k + 1),
r AS (SELECT k, a, b, 0::BIGINT AS size FROM p WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL
  SELECT k, unnest([substr(a, 1, i - 1), substr(a, i + l)]), unnest([substr(b, 1, j - 1), substr(b, j + l)]), unnest([l, 0]) FROM (
    SELECT k, a, b, best.l AS l, -best.i AS i, instr(b, substr(a, -best.i, best.l)) AS j FROM (
      SELECT k, a, b, list_max(flatten([[{'l': l, 'i': -i} FOR l IN range(1, len(a) - i + 2) IF contains(b, substr(a, i, l))] FOR i IN range(1, len(a) + 1)])) AS best FROM r WHERE a <> '' AND b <> '') WHERE best IS NOT NULL)),
m AS (SELECT k, sum(size) AS m FROM r GROUP BY k)"""


@query(f"{_BLOCKS} SELECT k AS p_partkey, CASE WHEN a IS NULL AND b IS NULL THEN 1 WHEN a IS NULL OR b IS NULL THEN 0 WHEN a = b THEN 1 ELSE 2.0::DOUBLE * m / (len(a) + len(b)) END::DOUBLE AS similarity FROM p LEFT JOIN m USING (k)")
def item_similarity(spark, d):
    """Similarity of each part's description to the next part's."""
    raw = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "), "p_brand", F.lit(" "), "p_type", F.lit("\t"))
    x = table(spark, d, "part").select("p_partkey", "p_size", raw.alias("raw"))
    a = x.select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.col("raw")).alias("a"))
    b = x.select((F.col("p_partkey") - 1).alias("p_partkey"), F.when(F.col("p_size") % 15 != 0, F.col("raw")).alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", similarity.similarity("a", "b").alias("similarity"))


@query()
def dedup_incremental(spark, d):
    """Three batches by identifier, each against the stored index of what was kept before; together what one run removes."""
    all_docs = docs(spark, d)
    folder = f"{shared_dir(spark).rstrip('/')}/dedup-index-{uuid.uuid4().hex}"
    ends = all_docs.select(F.percentile_approx("doc_id", [0.4, 0.8]).alias("e")).first()["e"] or [0, 0]
    parts = (F.col("doc_id") < ends[0], F.col("doc_id").between(ends[0], ends[1] - 1), F.col("doc_id") >= ends[1])
    removed = [dedup_index.add(all_docs.where(part), folder, f"{n:05d}")[1].select("doc_id", "duplicate_of") for n, part in enumerate(parts)]
    return removed[0].unionAll(removed[1]).unionAll(removed[2])


_SPLIT_MANY = (
    SPLIT.replace("SELECT doc_id, coalesce(lang, 'unknown') AS lang FROM documents", "SELECT o_orderkey AS doc_id, o_custkey::VARCHAR AS lang FROM orders")
)  # the same rule over other rows


@query(f"{_SPLIT_MANY} SELECT doc_id AS o_orderkey, split FROM split")
def split_many(spark, d):
    """Orders split within each customer: thousands of strata."""
    return split.assign(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey").select("o_orderkey", "split")


_FRACTIONS = {"click": 0.5, "view": 2.25, "error": 0.05, "purchase": 1.0, "none": 0.0, "rare": 1e-3}
_ALIAS = scenarios.alias_table(list(_FRACTIONS.values()))
_DRAW = "(('0x' || substr(md5('42|' || event_id), {}, 7))::BIGINT)"


@query(f"SELECT s AS name, count(*) AS n FROM (SELECT CASE WHEN {_DRAW.format(8)} / 268435456.0::DOUBLE < {[k for k, _ in _ALIAS]}[i]::DOUBLE THEN {list(_FRACTIONS)}[i] ELSE {[list(_FRACTIONS)[j] for _, j in _ALIAS]}[i] END AS s FROM (SELECT event_id, {_DRAW.format(1)} % {len(_ALIAS)} + 1 AS i FROM events)) GROUP BY s")
def scenario_weighted(spark, d):
    """Draws by fractional weights."""
    return table(spark, d, "events").select(scenarios.weighted(F.col("event_id"), _FRACTIONS).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query(f"{FLAGS} SELECT 'all' AS kind, '' AS key, count(*) AS n_total, count(*) FILTER (validation_error IS NULL) AS n_valid FROM f UNION ALL SELECT 'scenario', scenario_id, count(*), count(*) FILTER (validation_error IS NULL) FROM f GROUP BY scenario_id UNION ALL SELECT 'difficulty', difficulty, count(*), count(*) FILTER (validation_error IS NULL) FROM f GROUP BY difficulty")
def validation_long(spark, d):
    return contract.stats_long(contract.validate(invoices.damaged(spark, d)))


@query("SELECT kind, key, count(*) AS n_requested, count(*) FILTER (ok) AS n_generated, count(*) FILTER (NOT ok) AS n_parse_failures, count(*) FILTER (ok AND user_id % 5 = 0) AS n_schema_invalid_at_generation, coalesce(sum(user_id) FILTER (ok), 0)::BIGINT AS total_input_tokens FROM (SELECT *, event_type <> 'error' AS ok, unnest(['all', 'scenario', 'difficulty']) AS kind, unnest(['', 'user ' || user_id, ['easy', 'medium', 'hard'][event_id % 3 + 1]]) AS key FROM events) GROUP BY kind, key")
def generation_long(spark, d):
    """Run statistics in long form, by a scenario for each user."""
    e = table(spark, d, "events")
    level = F.element_at(F.array(*map(F.lit, invoices.DIFFICULTIES)), (F.col("event_id") % 3 + 1).cast("int"))
    return metrics.generation_long(e, F.col("event_type") != "error", F.col("user_id") % 5 != 0, F.col("user_id"), F.concat(F.lit("user "), "user_id"), level)


_FOUND = (("total_amount", "null", "1"), ("total_amount", "string", "2"), ("total_amount", "boolean", "18"), ("line_items", "object", "10"), ("vendor_name", "number", "11"), ("vendor_name", "absent", "12"), ("vendor_name", "null", "14"), ("subtotal", "array", "14"), ("subtotal", "string", "17"), ("tax_rate", "string", "14"), ("currency", "number", "7"), ("currency", "null", "14"))


@query(f"WITH {ITEMS} SELECT field, found, n FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, '{t}' AS found, count(*) AS n FROM r WHERE o_orderkey % 20 IN ({k})" for f, t, k in _FOUND) + ") WHERE n > 0")
def schema_conformity(spark, d):
    """Where payloads depart from the types of the record's JSON schema."""
    x = pyjson.with_parsed(invoices.damaged(spark, d), F.col("ground_truth_json"), "v").select("v")
    return contract.departures(x, "v")


# DuckDB spells doubles as Python does, but for the blank-free exponents below 10 and integers beyond 1e15
@query("SELECT o_orderkey, spelled FROM (SELECT o_orderkey, CASE WHEN abs(v) >= 1e-4 AND abs(v) < 1e15 OR v = 0 THEN CASE WHEN contains(v::VARCHAR, '.') THEN v::VARCHAR ELSE v::VARCHAR || '.0' END END AS spelled FROM (SELECT o_orderkey, (o_totalprice - 1000) / 7 * [1.0, -1.0, 1e-3, 1e4, 1e-6, 1e8, 1e-9, 1e12][o_orderkey % 8 + 1]::DOUBLE AS v FROM orders))")
def float_spelling(spark, d):
    """Doubles of many sizes as Python spells them, where they have no exponent."""
    scale = F.element_at(F.array(*(F.lit(x) for x in (1.0, -1.0, 1e-3, 1e4, 1e-6, 1e8, 1e-9, 1e12))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    x = table(spark, d, "orders").select("o_orderkey", ((F.col("o_totalprice") - 1000) / 7 * scale).alias("v"))
    plain = ((F.abs("v") >= 1e-4) & (F.abs("v") < 1e15)) | (F.col("v") == 0)
    return x.select("o_orderkey", F.when(plain, X.python_float("v")).alias("spelled"))


# queries that write files have no SQL; the tests hold them against plain Python


def _new_folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query()
def resumed_append(spark, d):
    """Documents appended in runs that overlap: every one once, under identifiers that go on."""
    x, folder = docs(spark, d).select(F.format_string("%012d", "doc_id").alias("key"), "lang"), _new_folder(spark, "append")
    for part in (F.col("key") < "000000000400", F.col("key") < "000000000700", F.lit(True), F.lit(True)):
        append.append(x.where(part), folder, "key")
    line = F.from_json("value", "key string, lang string, id string")
    return append.read(spark, folder).select(line.alias("x")).select(F.col("x.key").cast("long").alias("doc_id"), "x.id", "x.lang")


@query()
def routed_stream(spark, d):
    """Documents as a stream, judged by the quality rules and routed; read back from both folders."""
    folder = _new_folder(spark, "routed")
    # as a pattern, so that the table may be a folder or one file
    live = spark.readStream.schema(docs(spark, d).schema).parquet(f"{d}/documents.parque[t]")
    judged = live.select("doc_id", quality.text_reason(F.col("text")).alias("reason"))
    sinks.routed(judged, f"{folder}/good", f"{folder}/bad", "reason", f"{folder}/checkpoint").awaitTermination()
    lines = lambda name: spark.read.option("recursiveFileLookup", "true").text(f"{folder}/{name}").select(F.from_json("value", "doc_id long, reason string").alias("x"), F.lit(name).alias("route"))
    return lines("good").unionAll(lines("bad")).select("x.*", "route")
