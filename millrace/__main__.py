"""Commands over JSON lines: validate, dedup, filter, split, format, eval, compare, cost, schema, curate.

python -m millrace COMMAND --help. Inputs are files or folders of JSON lines that Spark can read; outputs are folders of
JSON lines, and a summary is printed and, with --summary, written as one JSON document.
"""

from __future__ import annotations

import argparse
import json
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import contract, conversation, cost, dedup, metrics, quality, split
from millrace.plans import curation, evaluation
from millrace.sources import jsonl
from millrace.sources.shared import cut


def examples(spark: SparkSession, path: str) -> DataFrame:
    """The readable examples; missing identifiers become places."""
    rows = jsonl.examples(jsonl.scan(spark, path, "drop")).withColumn("source_order", F.monotonically_increasing_id())
    return jsonl.with_ids(cut(rows), "source_order", form="line-%05d").drop("source_order")


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes an example table, payloads as the text they came with."""
    payload = F.coalesce(F.col("ground_truth_text"), F.to_json("ground_truth_json")) if "ground_truth_text" in df.columns else F.to_json("ground_truth_json")
    text = [F.to_json(F.struct(F.col(f"`{c}`")), {"ignoreNullFields": "false"}) for c in df.columns if c not in ("ground_truth_json", "ground_truth_text")]
    parts = [F.substring(t, F.lit(2), F.length(t) - 2) for t in text]
    line = F.concat(F.lit("{"), F.concat_ws(",", *parts, F.concat(F.lit('"ground_truth_json":'), F.coalesce(payload, F.lit("null")))), F.lit("}"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return df


def validate(spark, a) -> dict:
    checked = cut(contract.validate(examples(spark, a.input)).drop("record"))
    passed, failed = contract.route(checked)
    written(passed, a.output)
    written(failed, a.rejected)
    out = contract.stats(checked).first().asDict(recursive=True)
    return out | {"top_reasons": {r["reason"]: r["n"] for r in contract.top_reasons(checked).collect()}}


def deduplicate(spark, a) -> dict:
    rows = examples(spark, a.input)
    kept, removed = dedup.run(rows, "id", "document_text", Fraction(a.threshold))
    kept, removed = written(cut(kept), a.output), written(cut(removed), a.rejected)
    n = removed.count()
    return dedup.stats(kept.count() + n, n, float(Fraction(a.threshold)))


def select(spark, a) -> dict:
    judged = cut(examples(spark, a.input).withColumn("quality_filter_reason", quality.reason()))
    good, rejected = contract.route(judged, "quality_filter_reason")
    written(good, a.output)
    written(rejected, a.rejected)
    out = quality.stats(judged).first().asDict()
    return out | {"reasons": {r["bucket"]: r["n"] for r in quality.buckets(judged, seeded=True).collect()}}


def divide(spark, a) -> dict:
    parts = cut(split.assign(examples(spark, a.input), "id", seed=a.seed))
    for name in ("eval", "val", "train"):
        written(parts.where(F.col("split") == name).drop("split"), f"{a.output}/{name}")
    digest = split.lock(spark, f"{a.output}/eval")
    counts: dict[str, dict[str, int]] = {}
    for r in split.stats(parts).collect():  # three splits by the few strata
        counts.setdefault(r["split"], {})[r["stratum"]] = r["n"]
    return {"sizes": {k: sum(v.values()) for k, v in counts.items()}, "by_difficulty": counts, "eval_sha256": digest, "seed": a.seed}


def chat(spark, a) -> dict:
    rows = examples(spark, a.input)
    out = cut(conversation.render(rows))
    jsonl.write(out, a.output)
    return conversation.stats(rows, out).first().asDict()


def judge(spark, a) -> dict:
    truths = examples(spark, a.input).select("id", "scenario_id", "difficulty", "ground_truth_json")
    raw = jsonl.scan(spark, a.predictions, "drop").select(*(F.try_variant_get("value", f"$.{f}", k).alias(f) for f, k in (("id", "string"), ("raw_output", "string"), ("latency", "double"))))
    scores, total = evaluation.evaluate(raw, truths, a.label, a.input if a.locked else None)
    return evaluation.document(a.label, "predictions", cut(scores), total, a.input, a.output)


def compare(spark, a) -> dict:
    """Quality side by side, differences to the first model, and the teacher's costs."""
    found = {label: doc for label in a.labels for doc in [jsonl.read_document(spark, f"{a.input}/{label}/result")] if doc}
    names = ("schema_validity_rate", "overall_field_accuracy", "full_record_exact_match_rate")
    rows = [(label, *(float(doc["aggregate"].get(n) or 0.0) for n in names)) for label, doc in found.items()]
    table = spark.createDataFrame(rows, "label string, " + ", ".join(f"{n} double" for n in names))
    quality_rows, costs = evaluation.compare(table, tuple(a.labels), a.build_cost)
    out = {"quality": {r["metric"]: r.asDict() for r in quality_rows.collect()}, "cost": [r.asDict() for r in costs.collect()]}
    first = a.labels[0]
    pairs = table.alias("a").join(table.alias("b"), (F.col("a.label") == first) & (F.col("b.label") != first))
    deltas = pairs.select(F.col("b.label").alias("label"), *(metrics.delta(F.col(f"a.{n}"), F.col(f"b.{n}")).alias(n) for n in names))
    return out | {"deltas": {r["label"]: r.asDict() for r in deltas.collect()}}


def price(spark, a) -> dict:
    one = cost.with_prices(spark.createDataFrame([(a.model,)], "model string"))
    c = cost.per_1000_documents(F.col("input_per_1m"), F.col("output_per_1m"), F.lit(a.input_tokens), F.lit(a.output_tokens))
    return one.select("model", c.alias("cost_per_1000"), cost.payback_documents(F.lit(a.build_cost).cast("double"), c, F.lit(0.0)).alias("payback_documents")).first().asDict()


def schema(spark, a) -> dict:
    return {"fields": [r.asDict() for r in contract.schema(spark).orderBy("place").collect()], "json_schema": contract.json_schema()}


def curate(spark, a) -> dict:
    out = curation.curate(examples(spark, a.input), threshold=Fraction(a.threshold), seed=a.seed)
    for name in ("failed", "duplicates", "rejected", "split"):
        written(out[name], f"{a.output}/{name}")
    jsonl.write(out["conversations"], f"{a.output}/conversations")
    return {r["name"]: r["n"] for r in out["funnel"].collect()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *flags, **more):
        c = sub.add_parser(name, help=(run.__doc__ or name).splitlines()[0])
        c.set_defaults(run=run)
        c.add_argument("--summary", help="write the summary here, too")
        for flag in flags:
            c.add_argument(f"--{flag}", required=True)
        for flag, default in more.items():
            kind = type(default) if isinstance(default, (int, float)) and not isinstance(default, bool) else str
            if default is False:
                c.add_argument(f"--{flag}", action="store_true")
            elif isinstance(default, list):
                c.add_argument(f"--{flag}", nargs="+", default=default)
            else:
                c.add_argument(f"--{flag.replace('_', '-')}", type=kind, default=default)

    add("validate", validate, "input", "output", "rejected")
    add("dedup", deduplicate, "input", "output", "rejected", threshold="18/25")
    add("filter", select, "input", "output", "rejected")
    add("split", divide, "input", "output", seed=2024)
    add("format", chat, "input", "output")
    add("eval", judge, "input", "predictions", "output", label="finetuned", locked=False)
    add("compare", compare, "input", labels=["base", "finetuned", "teacher"], build_cost=0.4)
    add("cost", price, model="deepseek/deepseek-v4-flash", input_tokens=600.0, output_tokens=350.0, build_cost=0.4)
    add("schema", schema)
    add("curate", curate, "input", "output", threshold="18/25", seed=2024)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"millrace {a.command}").getOrCreate()
    out = a.run(spark, a)
    if a.summary:
        jsonl.write_document(spark, out, a.summary)
    print(json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
