"""Every query over the driver's tables by name, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import rounding
from millrace.functions import text as X
from millrace.functions.recover import VARIANTS, is_object, recover
from millrace.operators import contract, conversation, cost, dedup, metrics, quality, scenarios, score, score_notebook, split
from millrace.sources import invoices
from millrace.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


NORMAL = "trim(regexp_replace(regexp_replace(lower(text), '\\p{Nd}+', '', 'g'), '[^a-z]+', ' ', 'g'))"
SETS = f"t AS (SELECT doc_id, {NORMAL} AS t FROM documents), s AS (SELECT doc_id, CASE WHEN length(t) < 5 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) END AS s FROM t)"
# a token of one document only joins nothing; sizes are those of whole sets
PAIRS = f"{SETS}, x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), hits AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 25 * a.n >= 18 * b.n AND 25 * b.n >= 18 * a.n GROUP BY a.doc_id, b.doc_id), p AS MATERIALIZED (SELECT a, b, c / (na + nb - c) AS jaccard FROM hits WHERE 25 * c >= 18 * (na + nb - c))"
GREEDY = f"""{PAIRS}, o AS MATERIALIZED (SELECT b AS id, list(a ORDER BY a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM p GROUP BY b),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone, NULL::BIGINT AS id, NULL::BIGINT AS duplicate_of UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(o.earlier, lambda e: NOT list_contains(walk.gone, e))) > 0 THEN list_append(walk.gone, o.id) ELSE walk.gone END, o.id, list_min(list_filter(o.earlier, lambda e: NOT list_contains(walk.gone, e)))
  FROM walk JOIN o ON o.i = walk.i + 1),
gone AS (SELECT id, duplicate_of FROM walk WHERE duplicate_of IS NOT NULL)"""
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0]"


@query(f"SELECT doc_id, {NORMAL} AS normalized FROM documents")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", X.normalize_text("text").alias("normalized"))


@query(f"WITH {SETS} SELECT doc_id, len(s) AS n_shingles FROM s")
def shingle_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.shingles(X.normalize_text("text"))).cast("long").alias("n_shingles"))


@query(f"WITH {PAIRS}, k AS (SELECT DISTINCT min(doc_id) OVER (PARTITION BY list_sort(s)) AS class FROM s) SELECT a, b, jaccard FROM p WHERE a IN (SELECT class FROM k) AND b IN (SELECT class FROM k)")
def near_dup_pairs(spark, d):
    """Pairs between the first documents of equal shingle sets; ``shingle_classes`` has the membership."""
    return dedup.similar_pairs(docs(spark, d))[0]


@query(f"WITH {SETS}, k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class FROM s) SELECT doc_id, class FROM k")
def shingle_classes(spark, d):
    """The class of every document: the first with the same shingle set."""
    return dedup.classes(docs(spark, d))[0].select(F.col("id").alias("doc_id"), F.col("first").alias("class"))


@query(f"WITH RECURSIVE {GREEDY} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM gone)")
def dedup_kept(spark, d):
    return dedup.run(docs(spark, d))[0].select("doc_id")


@query(f"WITH RECURSIVE {GREEDY} SELECT id AS doc_id, duplicate_of, 0.72::DOUBLE AS jaccard_threshold FROM gone")
def dedup_removed(spark, d):
    return dedup.run(docs(spark, d))[1].select("doc_id", "duplicate_of", "jaccard_threshold")


@query(f"WITH RECURSIVE {GREEDY} SELECT (SELECT count(*) FROM documents) AS input, (SELECT count(*) FROM documents) - (SELECT count(*) FROM gone) AS kept, (SELECT count(*) FROM gone) AS removed, (SELECT count(*) FROM gone) / (SELECT count(*) FROM documents) AS removal_rate, 0.72::DOUBLE AS threshold")
def dedup_stats(spark, d):
    kept, removed = dedup.run(docs(spark, d))
    n = kept.agg(F.count("*").alias("kept")).select(F.lit(1).alias("one"), "kept").join(removed.agg(F.count("*").alias("removed")).select(F.lit(1).alias("one"), "removed"), "one")
    return n.select((F.col("kept") + F.col("removed")).alias("input"), "kept", "removed", (F.col("removed") / (F.col("kept") + F.col("removed"))).alias("removal_rate"), F.lit(0.72).alias("threshold"))



RATIO = "SELECT doc_id, text, CASE WHEN length(text) > 200 THEN (SELECT max(c) FROM (SELECT count(*) AS c FROM unnest(list_transform(range(0, length(text) - 20, 20), lambda i: substr(text, i + 1, 20))) AS u(x) GROUP BY x)) / len(range(0, length(text) - 20, 20)) ELSE 0 END::DOUBLE AS ratio FROM documents"
REASON = f"SELECT doc_id, CASE WHEN length(text) < 100 THEN 'doc_too_short (' || length(text) || ' < 100 chars)' WHEN length(text) > 8000 THEN 'doc_too_long (' || length(text) || ' > 8000 chars)' WHEN NOT regexp_matches(text, '[\\p{{Nd}}{X.OTHER_DIGITS}]') THEN 'doc_contains_no_digits' WHEN ratio > 0.3 THEN 'doc_repetitive_content' END AS reason FROM ({RATIO})"


@query(f"SELECT doc_id, ratio FROM ({RATIO})")
def repetition_ratio(spark, d):
    return docs(spark, d).select("doc_id", X.repetition_ratio("text").alias("ratio"))


@query(REASON)
def quality_reason(spark, d):
    return docs(spark, d).select("doc_id", quality.text_reason(F.col("text")).alias("reason"))


@query(f"SELECT array_to_string(string_split(reason, '_')[1:2], '_') AS bucket, count(*) AS n FROM ({REASON}) WHERE reason IS NOT NULL GROUP BY 1")
def quality_buckets(spark, d):
    return quality.buckets(quality_reason(spark, d), "reason")


@query(f"SELECT count(*) AS input, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS removed FROM ({REASON})")
def quality_stats(spark, d):
    return quality.stats(quality_reason(spark, d), "reason")


@query(f"WITH RECURSIVE {GREEDY}, r AS ({REASON}), k AS (SELECT * FROM r WHERE doc_id NOT IN (SELECT id FROM gone)) SELECT 0 AS step, 'read' AS name, count(*) AS n FROM documents UNION ALL SELECT 1, 'deduplicated', count(*) FROM k UNION ALL SELECT 2, 'filtered', count(*) FROM k WHERE reason IS NULL")
def curation_funnel(spark, d):
    all_docs = docs(spark, d)
    kept = dedup.run(all_docs)[0]
    return metrics.funnel([("read", all_docs), ("deduplicated", kept), ("filtered", kept.where(quality.text_reason(F.col("text")).isNull()))])


def _take(name: str, source: str, n: str) -> str:
    """Quotas and members of one stratified set in SQL."""
    return f"""{name}_s AS (SELECT lang, count(*) AS size, min(f) AS f, (SELECT count(*) FROM {source}) AS total, {n} AS want FROM {source} JOIN firsts USING (lang) GROUP BY lang),
{name}_b AS (SELECT *, least(size, round_even(size / total * want, 0)::BIGINT) AS base FROM {name}_s),
{name}_d AS (SELECT *, want - sum(base) OVER () AS short, coalesce(sum(size - base) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room, coalesce(sum(base) OVER (ORDER BY f DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tail FROM {name}_b),
{name}_q AS (SELECT lang, base + CASE WHEN short > 0 THEN greatest(0, least(short - room, size - base)) ELSE -greatest(0, least(-short - tail, base)) END AS quota FROM {name}_d),
{name} AS (SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('2024|{name}|' || doc_id), doc_id) AS n FROM {source}) JOIN {name}_q USING (lang) WHERE n <= quota)"""


SPLIT = f"""WITH base AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang FROM documents), firsts AS (SELECT lang, min(doc_id) AS f FROM base GROUP BY lang),
{_take("eval", "base", "(SELECT least(greatest(50, round_even(0.12 * count(*), 0)), count(*) - 50) FROM base)")},
rest AS (SELECT * FROM base WHERE doc_id NOT IN (SELECT doc_id FROM eval)),
{_take("val", "rest", "(SELECT greatest(1, round_even(0.10 * count(*), 0)) FROM rest)")},
split AS (SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM eval) THEN 'eval' WHEN doc_id IN (SELECT doc_id FROM val) THEN 'val' ELSE 'train' END AS split FROM base)"""


@query(f"{SPLIT} SELECT doc_id, lang, split FROM split")
def split_assign(spark, d):
    return split.assign(docs(spark, d).select("doc_id", "lang"), "doc_id", "lang")


@query(f"{SPLIT} SELECT split, lang AS stratum, count(*) AS n FROM split GROUP BY ALL")
def split_counts(spark, d):
    return split.stats(split_assign(spark, d), "lang")


@query(f"SELECT doc_id AS id, '{conversation.PREFIX}' || chr(10) || chr(10) || regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS human, '{{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}}' AS gpt FROM documents WHERE regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') <> ''")
def chat_format(spark, d):
    x = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("document_text"), F.struct("lang", "n_chars").alias("ground_truth_json"), F.lit(None).cast("string").alias("difficulty"), F.lit(None).cast("string").alias("scenario_id"))
    out = conversation.render(x.withColumn("id", F.col("id").cast("string")))
    return out.select(F.col("id").cast("long").alias("id"), F.col("conversations")[1]["value"].alias("human"), F.col("conversations")[2]["value"].alias("gpt"))


@query("SELECT conv_id, len(list(turn)) AS n_turns, string_agg(CASE role WHEN 'assistant' THEN 'gpt' WHEN 'user' THEN 'human' ELSE role END, ',' ORDER BY turn, CASE role WHEN 'assistant' THEN 'gpt' WHEN 'user' THEN 'human' ELSE role END, text) AS roles, md5(string_agg(text, chr(10) ORDER BY turn, CASE role WHEN 'assistant' THEN 'gpt' WHEN 'user' THEN 'human' ELSE role END, text)) AS text_md5 FROM conversations GROUP BY conv_id")
def chat_turns(spark, d):
    x = conversation.from_turns(table(spark, d, "conversations"))
    part = lambda f: F.transform("conversations", lambda t: t[f])
    return x.select("conv_id", F.size("conversations").cast("long").alias("n_turns"), F.array_join(part("from"), ",").alias("roles"), F.md5(F.array_join(part("value"), "\n")).alias("text_md5"))


ITEMS = "items AS (SELECT l_orderkey, count(*) AS n, list({'n': l_linenumber, 's': l_suppkey, 'q': l_quantity, 't': l_extendedprice} ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS items FROM lineitem GROUP BY l_orderkey), r AS (SELECT o_orderkey, items, n, o_totalprice, o_orderpriority, c_name, s_name, s_nationkey, o_orderdate::DATE AS day, ['easy', 'medium', 'hard'][o_orderkey % 3 + 1] AS difficulty FROM orders JOIN items ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = items[1].s JOIN customer ON c_custkey = o_custkey)"


@query(f"WITH {ITEMS} SELECT o_orderkey, s_name AS vendor_name, CASE WHEN o_orderkey % 5 <> 0 THEN 'Nation ' || s_nationkey END AS vendor_address, 'INV-' || o_orderkey AS invoice_number, strftime(day, '%Y-%m-%d') AS invoice_date, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(day + INTERVAL 30 DAY, '%Y-%m-%d') END AS due_date, c_name AS bill_to, n AS n_items, items[1].t AS first_total, items[1].t / items[1].q AS first_price, o_totalprice * 0.08::DOUBLE AS tax_amount, ['USD', 'EUR', 'GBP', 'CAD'][s_nationkey % 4 + 1] AS currency, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS notes FROM r")
def invoice_records(spark, d):
    """The records after a round through JSON text and the contract's coercions."""
    x = invoices.records(spark, d).select("o_orderkey", F.try_parse_json(invoices.spelled(F.col("record"), {})).alias("v")).select("o_orderkey", F.coalesce(contract.plain(F.col("v")), contract.record(F.col("v"))).alias("r"))
    i = F.col("r.line_items")
    return x.select("o_orderkey", *(F.col(f"r.{f}") for f in ("vendor_name", "vendor_address", "invoice_number", "invoice_date", "due_date", "bill_to")), F.size(i).cast("long").alias("n_items"), i[0]["total"].alias("first_total"), i[0]["unit_price"].alias("first_price"), F.col("r.tax_amount"), F.col("r.currency"), F.col("r.notes"))


C = contract
FLAGS = f"""WITH {ITEMS}, f AS (SELECT o_orderkey, difficulty, 'scenario_' || (o_orderkey % 7) AS scenario_id, CASE o_orderkey % 20
 WHEN 1 THEN 'total_amount: {C.NOT_NUMBER}' WHEN 2 THEN 'total_amount: {C.NOT_PARSED}' WHEN 3 THEN 'total_amount: {C.NEGATIVE}' WHEN 4 THEN 'invoice_date: {C.BAD_DATE}' WHEN 6 THEN 'currency: {C.BAD_CURRENCY}'
 WHEN 8 THEN 'tax_rate: {C.BAD_RATE}' WHEN 9 THEN 'line_items: {C.NO_ITEMS}' WHEN 10 THEN 'line_items: {C.NOT_LIST}' WHEN 11 THEN 'vendor_name: {C.NOT_TEXT}' WHEN 12 THEN 'vendor_name: {C.MISSING}' WHEN 13 THEN ': {C.NEGATIVE_ITEM}'
 WHEN 14 THEN 'vendor_name: {C.NOT_TEXT}; invoice_date: {C.BAD_DATE}; subtotal: {C.NOT_NUMBER} (+ 2 more)' WHEN 15 THEN 'line_items.0.description: {C.NO_TEXT}' END AS validation_error FROM r)"""


def _validated(spark, d):
    return contract.validate(invoices.damaged(spark, d))


@query(f"{FLAGS} SELECT o_orderkey AS id, validation_error FROM f")
def validate_flags(spark, d):
    return _validated(spark, d).select("id", "validation_error")


@query(f"{FLAGS} SELECT count(*) AS n_total, count(*) FILTER (validation_error IS NULL) AS n_valid, count(*) FILTER (validation_error IS NOT NULL) AS n_failed, count(*) FILTER (validation_error IS NULL AND difficulty = 'easy') AS easy, count(*) FILTER (validation_error IS NULL AND difficulty = 'medium') AS medium, count(*) FILTER (validation_error IS NULL AND difficulty = 'hard') AS hard, {', '.join(f"count(*) FILTER (validation_error IS NULL AND scenario_id = 'scenario_{k}') AS scenario_{k}" for k in range(7))} FROM f")
def validation_stats(spark, d):
    s = contract.stats(_validated(spark, d))
    return s.select("n_total", "n_valid", "n_failed", *(F.col("by_difficulty")[x].alias(x) for x in ("easy", "medium", "hard")), *(F.col("by_scenario")[f"scenario_{k}"].alias(f"scenario_{k}") for k in range(7)))


@query(f"{FLAGS} SELECT string_split(validation_error, ':')[1] AS reason, count(*) AS n FROM f WHERE validation_error IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")
def validation_reasons(spark, d):
    return contract.top_reasons(_validated(spark, d))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, " + rounding.sql_hundredths("(l_extendedprice * l_discount / 7)") + " / 100 AS rounded FROM lineitem")
def round_half_even(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", rounding.round2(F.col("l_extendedprice") * F.col("l_discount") / 7).alias("rounded"))


TOTAL_SAME = f"({rounding.sql_hundredths('(o_totalprice + 0.004::DOUBLE)')} = {rounding.sql_hundredths('o_totalprice')})"
SCORES = f"""WITH {ITEMS}, e AS (SELECT o_orderkey AS id, difficulty, o_orderkey % 12 AS k, n, o_orderkey % 12 NOT IN (6, 7) AS schema_valid, o_orderkey % 12 <> 6 AS has_fields, {TOTAL_SAME} AS total_same FROM r),
x AS (SELECT *, schema_valid AND k <> 2 AS bill_to, schema_valid AND (k <> 3 OR total_same) AS total_amount, schema_valid AND k <> 11 AS notes, CASE WHEN NOT schema_valid THEN 0 WHEN k = 9 AND n > 1 THEN (n - 1) / n ELSE 1 END::DOUBLE AS description, CASE WHEN NOT schema_valid THEN 0 WHEN k = 9 AND n > 1 THEN (n - 1) / n WHEN k = 10 THEN (n - 1) / n ELSE 1 END::DOUBLE AS quantity FROM e),
s AS (SELECT *, bill_to AND total_amount AND notes AND description >= 1 AND quantity >= 1 AS exact FROM x)"""


def _scores(spark, d):
    return score.rows(invoices.outputs(spark, d))


_HIT = {"bill_to": "bill_to", "total_amount": "total_amount", "notes": "notes"}


@query(f"{SCORES} SELECT id, schema_valid, {', '.join(f'CASE WHEN has_fields THEN {_HIT.get(f, "schema_valid")} END AS {f}' for f in score.SCORED)}, exact, NOT schema_valid AS has_error FROM s")
def field_matches(spark, d):
    at = lambda f: F.try_element_at("field_matches", F.lit(f)).alias(f)
    return _scores(spark, d).select(F.col("example_id").alias("id"), "schema_valid", *map(at, score.SCORED), F.col("full_record_exact_match").alias("exact"), (F.col("parse_error") != "").alias("has_error"))


@query(f"{SCORES} SELECT id, CASE WHEN has_fields THEN description END AS description, CASE WHEN has_fields THEN quantity END AS quantity, CASE WHEN has_fields THEN description END AS unit_price, CASE WHEN has_fields THEN description END AS total FROM s")
def line_item_match(spark, d):
    at = lambda f: F.try_element_at("line_item_field_accuracy", F.lit(f)).alias(f)
    return _scores(spark, d).select(F.col("example_id").alias("id"), *map(at, ("description", "quantity", "unit_price", "total")))


@query(f"{SCORES} SELECT field, avg(CASE WHEN hit THEN 1 ELSE 0 END)::DOUBLE AS accuracy FROM (SELECT unnest([{', '.join(repr(f) for f in score.SCORED)}]) AS field, unnest([{', '.join(f if f in ('bill_to', 'total_amount', 'notes') else 'schema_valid' for f in score.SCORED)}]) AS hit FROM s) GROUP BY field")
def field_accuracy(spark, d):
    return score.long_form(_scores(spark, d))


@query(f"{SCORES} SELECT count(*) AS n_examples, avg(CASE WHEN schema_valid THEN 1 ELSE 0 END)::DOUBLE AS schema_validity_rate, avg(CASE WHEN exact THEN 1 ELSE 0 END)::DOUBLE AS full_record_exact_match_rate, round((10 * avg(schema_valid::INT) + avg(bill_to::INT) + avg(total_amount::INT) + avg(notes::INT)) / 13, 9) AS overall_field_accuracy, round(avg(quantity), 9) AS quantity_accuracy, count(*) FILTER (NOT schema_valid) AS parse_failures FROM s")
def overall_accuracy(spark, d):
    a = score.aggregate(_scores(spark, d))
    return a.select("n_examples", "schema_validity_rate", "full_record_exact_match_rate", F.round("overall_field_accuracy", 9).alias("overall_field_accuracy"), F.round(F.col("line_item_field_accuracy_by_field")["quantity"], 9).alias("quantity_accuracy"), "parse_failures")


@query(f"{SCORES} SELECT difficulty, count(*) AS n_examples, avg(CASE WHEN exact THEN 1 ELSE 0 END)::DOUBLE AS exact_match_rate, round((10 * avg(schema_valid::INT) + avg(bill_to::INT) + avg(total_amount::INT) + avg(notes::INT)) / 13, 9) AS overall_field_accuracy FROM s GROUP BY difficulty")
def accuracy_by_difficulty(spark, d):
    a = score.aggregate(_scores(spark, d), ("difficulty",))
    return a.select("difficulty", "n_examples", F.col("full_record_exact_match_rate").alias("exact_match_rate"), F.round("overall_field_accuracy", 9).alias("overall_field_accuracy"))


# unvalidated: an invalid total counts for its own field only; an unreadable output gives null for every field, which
# equals a null in the truth
NOTEBOOK = f"""WITH {ITEMS}, x AS (SELECT o_orderkey AS id, difficulty, o_orderkey % 12 AS k, n, o_orderkey AS o, o_orderkey % 12 <> 6 AS ok FROM r),
s AS (SELECT *, (CASE WHEN NOT ok THEN 0 WHEN k = 9 AND n > 1 THEN (n - 1) / n ELSE 1 END)::DOUBLE AS line_items, (ok AND k NOT IN (3, 7))::INT::DOUBLE AS total_amount, (CASE WHEN ok THEN k <> 11 ELSE o % 3 = 0 END)::INT::DOUBLE AS notes, (CASE WHEN ok THEN true ELSE o % 4 = 0 END)::INT::DOUBLE AS due_date, (CASE WHEN ok THEN true ELSE o % 5 = 0 END)::INT::DOUBLE AS vendor_address, (ok AND k <> 2)::INT::DOUBLE AS bill_to, ok::INT::DOUBLE AS other FROM x),
m AS (SELECT *, (8 * other + line_items + total_amount + notes + due_date + vendor_address + bill_to) / 14 AS mean FROM s)"""


OWN_SCORES = ("line_items", "total_amount", "notes", "due_date", "vendor_address", "bill_to")


@query(f"{NOTEBOOK} SELECT id, ok AS parsed_ok, {', '.join(f if f in OWN_SCORES else f'other AS {f}' for f in contract.FIELDS)} FROM m")
def notebook_scores(spark, d):
    x = score_notebook.rows(invoices.outputs(spark, d))
    return x.select(F.col("example_id").alias("id"), "parsed_ok", *(F.col("scores")[f].alias(f) for f in contract.FIELDS))


@query(f"{NOTEBOOK} SELECT avg(ok::INT)::DOUBLE AS parse_rate, round(avg(mean), 9) AS overall, round(avg(mean) FILTER (difficulty = 'easy'), 9) AS easy, round(avg(mean) FILTER (difficulty = 'medium'), 9) AS medium, round(avg(mean) FILTER (difficulty = 'hard'), 9) AS hard, round(avg(line_items), 9) AS line_items FROM m")
def notebook_aggregate(spark, d):
    a = score_notebook.aggregate(score_notebook.rows(invoices.outputs(spark, d)))
    return a.select("parse_rate", F.round("overall", 9).alias("overall"), *(F.round(F.col("by_difficulty")[x], 9).alias(x) for x in ("easy", "medium", "hard")), F.round(F.col("field_scores")["line_items"], 9).alias("line_items"))


# raw texts by the key's remainder of 8: plain, fenced, in prose, in an array, cut off, no braces, empty object, } {
def _raw(spark, d):
    k, p = F.col("event_id") % 8, F.col("props")
    raw = F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure: "), p, F.lit(" ok"))).when(k == 3, F.concat(F.lit("["), p, F.lit("]"))).when(k == 4, F.substring(p, F.lit(1), F.length(p) - 1)).when(k == 5, F.lit("none")).when(k == 6, F.lit("{}")).otherwise("} {")
    return table(spark, d, "events").select("event_id", raw.alias("raw"))


RECOVERED = {"generator": "false", "scorer": "event_id % 8 IN (0, 1, 2, 3, 6)", "notebook": "event_id % 8 IN (0, 1, 2)", "api": "event_id % 8 IN (0, 1, 2, 3, 6)", "infer": "event_id % 8 IN (0, 1, 2, 3, 6)", "cli": "event_id % 8 IN (0, 1, 6)"}
OBJECTS = {"api": "event_id % 8 IN (0, 1, 2, 6)", "infer": "event_id % 8 IN (0, 1, 2, 6)"}


@query("SELECT event_id, " + ", ".join(f"{RECOVERED[v]} AS {v}, {OBJECTS.get(v, RECOVERED[v])} AS {v}_object" for v in VARIANTS) + ", CASE WHEN event_id % 8 IN (0, 1, 2, 3) THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events")
def recover_json(spark, d):
    x = _raw(spark, d).select("event_id", *(recover("raw", v)["value"].alias(v) for v in VARIANTS))
    return x.select("event_id", *(F.col(v).isNotNull().alias(v) for v in VARIANTS), *(is_object(F.col(v)).alias(f"{v}_object") for v in VARIANTS), F.try_variant_get("scorer", "$.k", "bigint").alias("k"))


@query("SELECT event_type, count(value) AS n, list_sort(list(value))[count(value) // 2 + 1] AS p50, list_sort(list(value))[least(count(value) * 19 // 20, count(value) - 1) + 1] AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return metrics.percentiles(table(spark, d, "events"), "value", "event_type")


@query("SELECT count(*) AS n_requested, count(*) FILTER (event_type <> 'error') AS n_generated, count(*) FILTER (event_type = 'error') AS n_parse_failures, count(*) FILTER (event_type <> 'error' AND user_id % 5 = 0) AS n_schema_invalid_at_generation, sum(user_id) FILTER (event_type <> 'error')::BIGINT AS total_input_tokens, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type <> 'error' AND event_id % 3 = 1) AS medium, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate FROM events")
def generation_stats(spark, d):
    e = table(spark, d, "events")
    level = F.element_at(F.array(*map(F.lit, invoices.DIFFICULTIES)), (F.col("event_id") % 3 + 1).cast("int"))
    s = metrics.generation(e, F.col("event_type") != "error", F.col("user_id") % 5 != 0, F.col("user_id"), F.col("event_type"), level)
    return s.select("n_requested", "n_generated", "n_parse_failures", "n_schema_invalid_at_generation", "total_input_tokens", F.col("by_scenario")["click"].alias("click"), F.col("by_difficulty")["medium"].alias("medium"), "success_rate")


DRAW = "list_concat(" + ", ".join(f"[{', '.join(repr(i) for i, x, _ in scenarios.SCENARIOS for _ in range(scenarios.WEIGHTS[x]))}]" for _ in (0,)) + ", [])"


@query(f"SELECT s AS scenario_id, count(*) AS n FROM (SELECT {DRAW}[('0x' || substr(md5('42|' || event_id), 1, 7))::BIGINT % {sum(scenarios.WEIGHTS[x] for _, x, _ in scenarios.SCENARIOS)} + 1] AS s FROM events) GROUP BY s")
def scenario_sample(spark, d):
    return table(spark, d, "events").select(scenarios.sample(F.col("event_id")).alias("scenario_id")).groupBy("scenario_id").agg(F.count("*").alias("n"))


@query("SELECT event_type, round((user_tokens / 1e6) * 0.07 * 1000 + (350 / 1e6) * 0.28 * 1000, 9) AS cost_per_1000, round(((user_tokens / 1e6) * 0.07 * 1000 + (350 / 1e6) * 0.28 * 1000) / (1000 * acc), 12) AS cost_per_success, round(0.4 / ((user_tokens / 1e6) * 0.07 * 1000 + (350 / 1e6) * 0.28 * 1000) * 1000, 6) AS payback FROM (SELECT event_type, avg(user_id)::DOUBLE AS user_tokens, (count(*) FILTER (user_id % 5 <> 0) / count(*))::DOUBLE AS acc FROM events GROUP BY event_type)")
def cost_report(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.avg("user_id").alias("tokens"), (F.count_if(F.col("user_id") % 5 != 0) / F.count("*")).alias("acc"))
    e = cost.with_prices(e.withColumn("model", F.lit("deepseek/deepseek-v4-flash")))
    c = cost.per_1000_documents(F.col("input_per_1m"), F.col("output_per_1m"), F.col("tokens"))
    return e.select("event_type", F.round(c, 9).alias("cost_per_1000"), F.round(cost.per_success(c, F.col("acc")), 12).alias("cost_per_success"), F.round(cost.payback_documents(F.lit(0.4), c, F.lit(0.0)), 6).alias("payback"))


@query("SELECT m AS metric, " + ", ".join(f"coalesce(max(printf('%.1f%%', v * 100)) FILTER (l = '{x}'), 'not available') AS {x}" for x in ("base", "finetuned", "teacher")) + " FROM (SELECT l, unnest(['click_rate', 'error_rate']) AS m, unnest([c, e]) AS v FROM (SELECT CASE user_id % 2 WHEN 0 THEN 'base' ELSE 'finetuned' END AS l, avg((event_type = 'click')::INT)::DOUBLE AS c, avg((event_type = 'error')::INT)::DOUBLE AS e FROM events GROUP BY 1)) GROUP BY m")
def model_pivot(spark, d):
    e = table(spark, d, "events").groupBy(F.when(F.col("user_id") % 2 == 0, "base").otherwise("finetuned").alias("label")).agg(F.avg((F.col("event_type") == "click").cast("int")).alias("click_rate"), F.avg((F.col("event_type") == "error").cast("int")).alias("error_rate"))
    return metrics.side_by_side(e, ("base", "finetuned", "teacher"), ("click_rate", "error_rate"))


@query("SELECT lang, count(*) AS n, count(quality) AS labelled, count(quality) / count(*) AS coverage FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY lang")
def label_coverage(spark, d):
    one = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return docs(spark, d).join(one, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), (F.count("quality") / F.count("*")).alias("coverage"))


@query(f"SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def text_digests(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
