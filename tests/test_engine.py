"""The reference's cases as table rows, brute force on small inputs, and the queries against DuckDB."""

import json
import math
import os
import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import rounding
from millrace.functions import text as X
from millrace.functions.recover import is_object, recover
from millrace.operators import contract, conversation, cost, dedup, metrics, quality, score, split
from millrace.plans import curation
from millrace.plans import queries as plans
from millrace.sources import jsonl
from millrace.streaming import curation as stream

BASE = {"vendor_name": "Acme", "vendor_address": "1 Way", "invoice_number": "I-1", "invoice_date": "2024-01-02", "due_date": None, "bill_to": "Bob", "line_items": [{"description": "Widget", "quantity": 10, "unit_price": 5.0, "total": 50.0}, {"description": "Sofa", "quantity": 5, "unit_price": 20.0, "total": 100.0}], "subtotal": 150.0, "tax_amount": 12.0, "tax_rate": 0.08, "total_amount": 162.0, "currency": "USD", "payment_terms": "Net 30", "notes": None}
INVALID = [
    ({"total_amount": -1}, "total_amount"), ({"total_amount": None}, "total_amount"), ({"line_items": []}, "line_items"), ({"line_items": {}}, "line_items"), ({"currency": "US"}, "currency"), ({"currency": "USDC"}, "currency"),
    ({"currency": None}, "currency"), ({"invoice_date": "January 2, 2024"}, "invoice_date"), ({"due_date": "02/01/2024"}, "due_date"), ({"tax_rate": 8.0}, "tax_rate"), ({"tax_rate": [1]}, "tax_rate"), ({"vendor_name": 5}, "vendor_name"),
    ({"line_items": [{"description": "x", "total": -1}]}, ""), ({"line_items": [{"description": "", "total": 1}]}, "line_items.0.description"), ({"subtotal": "1.5d"}, "subtotal"),
]
VALID = [{}, {"currency": " usd "}, {"currency": 123}, {"tax_amount": 0.0}, {"tax_rate": None}, {"tax_rate": 0}, {"total_amount": "1_000"}, {"total_amount": True}, {"subtotal": " 5.5 "}, {"invoice_date": " 2024-13-45 "}, {"extra": 1}, {"total_amount": "inf"}]


def rows_of(spark, docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, ground_truth_json string")


def test_contract_cases(spark):
    cases = [BASE | m for m, _ in INVALID] + [BASE | m for m in VALID] + [{k: v for k, v in BASE.items() if k != drop} for drop in ("vendor_name", "total_amount", "currency", "line_items", "notes")]
    got = {r["id"]: r for r in contract.validate(rows_of(spark, cases)).collect()}
    for i, (_, place) in enumerate(INVALID):
        assert got[i]["validation_error"] is not None and got[i]["validation_error"].split(":")[0] == place and got[i]["record"] is None, cases[i]
    n = len(INVALID)
    for i in range(n, n + len(VALID)):
        assert got[i]["validation_error"] is None, (cases[i], got[i])
    assert got[n + 1]["record"]["currency"] == "USD" and got[n + 6]["record"]["total_amount"] == 1000.0 and got[n + 9]["record"]["invoice_date"] == "2024-13-45"
    m = n + len(VALID)
    assert [got[m + k]["validation_error"] is None for k in range(5)] == [False, False, False, False, True]
    many = contract.validate(rows_of(spark, [{"line_items": 3, "currency": 1.25, "invoice_date": 7}, [1], None])).collect()
    assert many[0]["validation_error"].endswith(" (+ 2 more)") and many[1]["validation_error"] and many[2]["validation_error"]


def scored(spark, pairs):
    df = spark.createDataFrame([(str(i), o, json.dumps(t)) for i, (o, t) in enumerate(pairs)], "id string, raw_output string, ground_truth_json string")
    return sorted(score.rows(df).collect(), key=lambda r: int(r["example_id"]))


def test_scorer_cases(spark):
    j = json.dumps
    other = BASE | {"line_items": [{"description": "zzzz", "quantity": 10, "unit_price": 5.0, "total": 50.0}, BASE["line_items"][1]]}
    extra = BASE | {"line_items": [*BASE["line_items"], {"description": "Third", "total": 1.0}]}
    half = BASE | {"line_items": BASE["line_items"][:1]}
    pairs = [
        (j(BASE), BASE), ("not json", BASE), (j(BASE | {"vendor_name": "Other"}), BASE), (j(BASE | {"total_amount": 200}), BASE), (j(BASE | {"notes": "x"}), BASE), ("```json\n" + j(BASE) + "\n```", BASE), (j(BASE | {"currency": "usd"}), BASE),
        (j(BASE | {"total_amount": 162.001}), BASE), (j(BASE | {"total_amount": -1}), BASE), (j(BASE), BASE | {"currency": "US"}), (j(other), BASE), (j(extra), BASE), (j(half), BASE), ("[" + j(BASE) + "]", BASE), ("} {", BASE), ("", BASE),
    ]
    r = scored(spark, pairs)
    assert [x["full_record_exact_match"] for x in r] == [k in (0, 5, 6, 7, 11, 13) for k in range(16)]
    assert [x["schema_valid"] for x in r] == [k not in (1, 8, 14, 15) for k in range(16)]
    assert r[1]["field_matches"] == {} and r[1]["parse_error"].startswith("No JSON") and r[14]["parse_error"].startswith("JSON parse failed")
    assert not any(r[8]["field_matches"].values()) and len(r[8]["field_matches"]) == 13 and r[8]["parse_error"].startswith("Schema validation failed")
    assert r[9]["field_matches"] == {} and r[9]["parse_error"].startswith("GROUND TRUTH ERROR")
    assert r[2]["field_matches"]["vendor_name"] is False and r[2]["field_matches"]["total_amount"] is True and r[4]["field_matches"]["notes"] is False
    assert r[10]["line_item_field_accuracy"]["total"] == 0.5 and r[12]["line_item_field_accuracy"]["description"] == 0.5
    total = score.aggregate(score.rows(spark.createDataFrame([(j(BASE), j(BASE), "1"), ("x", j(BASE), "2")], "raw_output string, ground_truth_json string, id string"))).first()
    assert (total["n_examples"], total["schema_validity_rate"], total["parse_failures"], total["overall_field_accuracy"]) == (2, 0.5, 1, 0.5)
    none = score.aggregate(score.rows(spark.createDataFrame([], "raw_output string, ground_truth_json string, id string"))).first()
    assert none["n_examples"] == 0 and none["field_accuracy_by_field"] == {} and none["schema_validity_rate"] == 0.0


def test_rounding_is_half_even_on_the_binary_value(spark):
    rng = random.Random(0)
    values = [0.125, 0.375, 2.675, 1.005, -0.125, -2.675, 0.0, -0.0] + [k / 1000 for k in range(-3000, 3000)] + [rng.uniform(-1e6, 1e6) for _ in range(2000)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", rounding.round2(F.col("v")).alias("r")).orderBy("i").collect()
    assert all(r["r"] == round(v, 2) for r, v in zip(got, values, strict=True))
    one = spark.sql("select double('NaN') a, 1.0d b").select(rounding.same_hundredths(F.col("a"), F.col("a")).alias("x"), rounding.same_hundredths(F.lit(None), F.lit(None)).alias("y"), rounding.same_hundredths(F.col("b"), F.lit(None)).alias("z")).first()
    assert tuple(one) == (False, True, False)


def test_recovery_variants_disagree_as_they_should(spark):
    raws = ['{"a":1}', '```json\n{"a":1}\n```', 'x {"a":1} y', '[{"a":1}]', "{}", "} {", "none", '{"document_text":"t","ground_truth_json":{}}', '```{"a":1}```', None]
    df = spark.createDataFrame(list(enumerate(raws)), "i long, raw string")
    out = {v: [r["ok"] for r in df.select("i", is_object(recover("raw", v)["value"]).alias("ok")).orderBy("i").collect()] for v in ("generator", "scorer", "notebook", "api", "infer", "cli")}
    assert out["scorer"] == [True, True, True, True, True, False, False, True, False, False]
    assert out["generator"] == [False] * 7 + [True, False, False]
    assert out["notebook"] == [True, True, True, False, False, False, False, True, True, False]
    assert out["api"] == out["infer"] == [True, True, True, False, True, False, False, True, True, False]
    assert out["cli"] == [True, True, False, False, True, False, False, True, False, False]


def normal(t):
    return re.sub("[^a-z]+", " ", re.sub(r"\d+", "", t.lower())).strip()


def grams(t):
    t = normal(t)
    return {t} if len(t) < 5 else {t[i : i + 5] for i in range(len(t) - 4)}


def test_dedup_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde ") for _ in range(60)) for _ in range(12)]
    rows = []
    for i in range(160):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(60)] = rng.choice("xyz")
        rows.append((i, "".join(t)))
    rows += [(200, ""), (201, None), (202, "12 34"), (203, "abc"), (204, "ABC!"), (205, "abcdefghij klmnop"), (206, "abcdefghij klmnop")]
    sets = [(i, grams(t or "")) for i, t in rows]
    kept, gone = [], {}
    for i, s in sets:
        hit = [k for k, o in kept if 25 * len(s & o) >= 18 * len(s | o)]
        if hit:
            gone[i] = hit[0]
        else:
            kept.append((i, s))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    k, r = dedup.run(df)
    assert sorted(x["doc_id"] for x in k.collect()) == [i for i, _ in kept]
    assert {x["doc_id"]: x["duplicate_of"] for x in r.collect()} == gone
    p, m = dedup.similar_pairs(df)
    want = {(i, j) for a, (i, s) in enumerate(sets) for j, o in sets[a + 1 :] if s != o and 25 * len(s & o) >= 18 * len(s | o)}
    firsts = {}
    for i, s in sets:
        firsts.setdefault(frozenset(s), i)
    reps = set(firsts.values())
    assert {(x["a"], x["b"]) for x in p.collect()} == {(a, b) for a, b in want if a in reps and b in reps}
    assert {x["id"]: x["first"] for x in m.collect()} == {i: firsts[frozenset(s)] for i, s in sets}
    assert dedup.run(df.limit(0))[0].count() == 0


def test_quality_rules_and_order(spark):
    ok = "Invoice 1 " + "".join(chr(97 + i % 26) + chr(97 + (i * 7) % 26) for i in range(100))
    texts = {"a" * 98 + "1": "doc_too_short (99 < 100 chars)", ok[:100]: None, "1" + "ab c" * 2000: "doc_too_long (8001 > 8000 chars)", "no digits " * 11: "doc_contains_no_digits", "abcdefghij123456789 " * 12: "doc_repetitive_content", "٣" + "word " * 25 + "x" * 9: None, "²" + ok[10:140]: None, "😀" * 99 + "1": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality.text_reason(F.col("t")).alias("r"))
    assert {r["t"]: r["r"] for r in df.collect()} == texts
    full = lambda **m: json.dumps(BASE | m)
    rows = [("a", full(total_amount=None), "s", "total_amount_missing"), ("b", full(total_amount="x"), "s", "total_amount_not_numeric"), ("c", full(total_amount=0), "s", "total_amount_zero_or_negative (0.0)"), ("d", full(line_items=[]), "s", "line_items_empty_or_missing"), ("e", json.dumps({"total_amount": 1, "line_items": [1], "notes": "x"}), "s", "too_few_non_null_fields (1 < 3, scenario=s)"), ("f", json.dumps({"total_amount": 1, "line_items": [1]}), "missing_fields_hard", None), ("g", full(), "s", None)]
    df = spark.createDataFrame([(i, p, s, ok) for i, p, s, _ in rows], "id string, p string, scenario_id string, document_text string").withColumn("ground_truth_json", F.try_parse_json("p"))
    got = df.select("id", quality.reason().alias("quality_filter_reason"))
    assert {r["id"]: r["quality_filter_reason"] for r in got.collect()} == {i: e for i, _, _, e in rows}
    assert {r["bucket"]: r["n"] for r in quality.buckets(got, seeded=True).collect()}["total_amount"] == 3
    for t in ("x" * 200, "abcdefghij123456789 " * 12, ok * 3, "y" * 201):
        n = range(0, len(t) - 20, 20)
        chunks = [t[i : i + 20] for i in n]
        want = max(map(chunks.count, chunks)) / len(chunks) if len(t) > 200 else 0.0
        assert spark.createDataFrame([(t,)], "t string").select(X.repetition_ratio("t")).first()[0] == want


@pytest.mark.parametrize(("n", "want"), [(50, (0, 5, 45)), (99, (49, 5, 45)), (100, (50, 5, 45)), (758, (91, 67, 600))])
def test_split_sizes(spark, n, want):
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 7 == 0, None).when(F.col("id") == 1, "lone").otherwise(F.concat(F.lit("d"), F.col("id") % 3)).alias("difficulty"))
    out = split.assign(df.repartition(3))
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert tuple(counts.get(k, 0) for k in ("eval", "val", "train")) == want
    assert out.where("split = 'eval'").collect() is not None and sorted(map(str, out.collect())) == sorted(map(str, split.assign(df).collect()))


def test_split_refuses_small_inputs_and_quotas_add_up():
    with pytest.raises(ValueError):
        split.sizes_of_sets(49)
    assert sum(split.quotas([("a", 5), ("b", 5), ("c", 5)], 7).values()) == 7 and split.quotas([("a", 1)], 5) == {"a": 1} and split.quotas([], 3) == {}


def test_sources_lock_and_chain(spark, tmp_path):
    rng = random.Random(1)
    lines = [json.dumps({"id": f"e{i:02d}", "scenario_id": "s", "difficulty": "easy", "document_text": f"Invoice {i} " + "".join(rng.choice("abcdefghijklmnop ") for _ in range(300)), "ground_truth_json": BASE}) for i in range(60)]
    (tmp_path / "raw.jsonl").write_text("\n".join([*lines, "", "  ", "{bad", "[1]", json.dumps({"id": "x", "document_text": "t", "ground_truth_json": {}})]))
    rows = jsonl.scan(spark, f"{tmp_path}/raw.jsonl")
    assert rows.count() == 63 and rows.where("problem is not null").count() == 2 and jsonl.scan(spark, f"{tmp_path}/raw.jsonl", "drop").count() == 61
    with pytest.raises(Exception, match="malformed JSON"):
        jsonl.scan(spark, f"{tmp_path}/raw.jsonl", "fail").collect()
    ex = jsonl.examples(rows.where("problem is null"))
    out = curation.curate(ex, threshold=Fraction(99, 100))
    assert out["failed"].count() == 1 and {r["name"]: r["n"] for r in out["funnel"].collect()}["valid"] == 60
    talk = out["conversations"].first()["conversations"]
    assert [t["from"] for t in talk] == ["system", "human", "gpt"] and talk[1]["value"].startswith(conversation.PREFIX + "\n\nInvoice")
    jsonl.write(out["split"].select("id", "split").coalesce(1), f"{tmp_path}/eval")
    split.lock(spark, f"{tmp_path}/eval")
    assert split.verify(spark, f"{tmp_path}/eval")
    jsonl.write(out["split"].select("id").coalesce(1), f"{tmp_path}/eval")
    assert not split.verify(spark, f"{tmp_path}/eval")
    named = jsonl.with_ids(spark.createDataFrame([(None, 5), ("a", 1), (None, 9)], "id string, o int"), "o", form="gen-%05d")
    assert sorted(r["id"] for r in named.collect()) == ["a", "gen-00001", "gen-00002"]
    assert jsonl.read_document(spark, f"{tmp_path}/nothing.json") is None


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    df = spark.createDataFrame([(str(i), "s", "easy", "text 1 " * 20, json.dumps(BASE | ({"currency": "US"} if i % 2 else {}))) for i in range(6)], "id string, scenario_id string, difficulty string, document_text string, ground_truth_json string")
    df.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in").withColumn("ground_truth_json", F.try_parse_json("ground_truth_json"))
    q = stream.judged(live).select("id", "validation_error", "quality_filter_reason").writeStream.format("memory").queryName("judged").start()
    q.processAllAvailable()
    q.stop()
    want = stream.judged(df.withColumn("ground_truth_json", F.try_parse_json("ground_truth_json"))).select("id", "validation_error", "quality_filter_reason")
    assert sorted(map(str, spark.table("judged").collect())) == sorted(map(str, want.collect()))


def test_cost_and_unknown_price(spark):
    df = cost.with_prices(spark.createDataFrame([("deepseek/deepseek-v4-flash", 0.9)], "model string, acc double"))
    c = cost.per_1000_documents(F.col("input_per_1m"), F.col("output_per_1m"))
    r = df.select(c.alias("c"), cost.per_success(c, F.col("acc")).alias("s"), cost.per_success(c, F.lit(0.0)).alias("none"), cost.payback_documents(F.lit(0.4), c, F.lit(0.0)).alias("p")).first()
    assert math.isclose(r["c"], 0.14) and math.isclose(r["s"], 0.14 / 900) and r["none"] is None and math.isclose(r["p"], 0.4 / 0.14 * 1000)
    with pytest.raises(Exception, match="no price"):
        cost.with_prices(spark.createDataFrame([("x",)], "model string")).collect()


def test_pairs_of_dealt_lists_and_many_sizes(spark, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    rows = []
    for size in (3, 10, 11, 14, 40, 41, 56, 120, 165):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(9):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + size // 9)):
                t[rng.randrange(size)] = rng.choice(words)
            rows.append((len(rows), " ".join(t[: size - rng.randrange(0, 1 + size // 5)])))
    sets = [(i, grams(t)) for i, t in rows]
    firsts = {}
    for i, s in sets:
        firsts.setdefault(frozenset(s), i)
    reps = [(i, set(s)) for s, i in firsts.items()]
    near = [(len(s & o) / len(s | o), i, j) for n, (i, s) in enumerate(reps) for j, o in reps[n + 1 :]]
    want = {(i, j) for x, i, j in near if 25 * x >= 18 - 1e-9}
    assert len(want) > 50 and sum(0.6 < x < 0.72 for x, _, _ in near) > 20 and max(len(s) for _, s in reps) > 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for list_rows, slots in ((4096, 1 << 20), (8, 1 << 20), (3, 1 << 6)):
        monkeypatch.setattr(dedup, "LIST_ROWS", list_rows)
        monkeypatch.setattr(dedup, "ORDER_SLOTS", slots)
        assert {(x["a"], x["b"]) for x in dedup.similar_pairs(df)[0].collect()} == want


def test_frequent_shingles_make_no_candidates(spark, monkeypatch):
    rng = random.Random(12)
    parts = ["".join(rng.choice("etaoin") for _ in range(3)) for _ in range(40)]
    texts = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(150)]
    texts += [t[:-2] for t in texts[:20]]
    every = [grams(t) for t in texts]
    assert sum(bool(s & o) for n, s in enumerate(every) for o in every[n + 1 :]) > 10_000  # nearly all pairs meet at some shingle
    similar = {(i, j) for i, s in enumerate(every) for j in range(i + 1, len(every)) if 25 * len(s & every[j]) >= 18 * len(s | every[j])}
    sets = dedup.sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").select("id", "hashes")
    monkeypatch.setattr(dedup, "LIST_ROWS", 7)
    rows = dedup.sketches(sets, dedup.Fraction(18, 25))
    found = [(min(x), max(x)) for x in dedup.candidates(rows, dedup.Fraction(18, 25)).collect()]
    assert similar <= set(found) and len(found) == len(set(found)) <= 3 * len(similar)
    old, new = rows.where("id < 75"), rows.where("id >= 75")
    assert {tuple(x) for x in dedup.candidates(new, dedup.Fraction(18, 25), old).collect()} == {(a, b) for a, b in found if a < 75 <= b}


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["near_dup_pairs", "dedup_removed", "dedup_stats", "curation_funnel", "quality_reason", "split_assign", "latency_percentiles", "model_pivot", "shingle_classes"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = plans.QUERIES[name](spark, DATA)
    cur = con.execute(plans.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == want


def test_percentiles_over_many_ranges(spark):
    rng = random.Random(8)
    rows = [("hot", float(rng.randrange(5000))) for _ in range(6000)] + [("few", 2.0), ("few", 1.0), ("none", None), (None, 7.0), (None, None)]
    rows += [("tied", 3.0)] * 50 + [("edge", float(k)) for k in range(21)]
    got = {r["g"]: r for r in metrics.percentiles(spark.createDataFrame(rows, "g string, x double").repartition(7), "x", "g").collect()}
    for name in {g for g, _ in rows}:
        values = sorted(x for g, x in rows if g == name and x is not None)
        n = len(values)
        want = (values[min(n // 2, n - 1)], values[min(19 * n // 20, n - 1)]) if n else (0.0, 0.0)
        assert (got[name]["n"], got[name]["p50"], got[name]["p95"]) == (n, *want)
