"""Evaluation of a predictions table against a locked set, and the comparison of models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import cost, metrics, score, split
from millrace.sources import jsonl


def predict(eval_set: DataFrame, extract: Callable[[str], tuple[str, float]], text: str = "document_text") -> DataFrame:
    """The seam for a model: extract(text) -> (raw output, seconds), called on executors; an error gives an empty output."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = []
            for t in pdf[text]:
                try:
                    out.append(extract(t))
                except Exception:
                    out.append(("", None))
            pdf = pdf.assign(raw_output=[x[0] for x in out], latency=[x[1] for x in out])
            yield pdf[["id", "raw_output", "latency"]]

    return eval_set.select("id", text).mapInPandas(run, "id string, raw_output string, latency double")


def joined(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """Every truth with its prediction; one without has an empty output.

    Of several predictions of one identifier the one with the smallest text counts, so an example is scored once.
    """
    rest = [c for c in predictions.columns if c not in ("id", "raw_output")]
    predictions = predictions.groupBy("id").agg(F.min(F.struct(F.col("raw_output").isNull().alias("none"), "raw_output", *rest)).alias("p")).select("id", "p.raw_output", *(F.col(f"p.{c}") for c in rest))
    return truths.join(predictions, "id", "left").withColumn("raw_output", F.coalesce("raw_output", F.lit("")))


def evaluate(predictions: DataFrame, truths: DataFrame, label: str, locked: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, one aggregate row with label and latencies). A locked path whose digest differs is an error."""
    if locked is not None and not split.verify(truths.sparkSession, locked):
        raise ValueError(f"{locked} is not as it was locked")
    scores = score.rows(joined(predictions, truths))
    total = score.aggregate(scores.withColumn("label", F.lit(label)), ("label",))
    latency = metrics.percentiles(scores.select(F.lit(label).alias("label"), "latency"), "latency", "label").withColumnRenamed("n", "n_timed")
    return scores, total.join(latency, "label")


def compare(aggregates: DataFrame, models: tuple[str, ...] = ("base", "finetuned", "teacher"), build_cost: float | None = None, model: str = "deepseek/deepseek-v4-flash") -> tuple[DataFrame, DataFrame]:
    """(quality side by side, one row of costs for the teacher)."""
    quality = metrics.side_by_side(aggregates, models, ("schema_validity_rate", "overall_field_accuracy", "full_record_exact_match_rate"))
    teacher = cost.with_prices(aggregates.where(F.col("label") == "teacher").select(F.lit(model).alias("model"), "overall_field_accuracy"))
    per_1000 = cost.per_1000_documents(F.col("input_per_1m"), F.col("output_per_1m"))
    out = teacher.select("model", per_1000.alias("cost_per_1000"), cost.reported_accuracy(F.col("overall_field_accuracy")).alias("accuracy"))
    out = out.withColumn("cost_per_success", cost.per_success(F.col("cost_per_1000"), F.col("accuracy")))
    return quality, out.withColumn("payback_documents", cost.payback_documents(F.lit(build_cost).cast("double"), F.col("cost_per_1000"), F.lit(0.0)))


def document(label: str, model_class: str, scores: DataFrame, total: DataFrame, path: str, folder: str) -> dict:
    """The result document of an evaluation; rows of single examples are written below the folder, as many as there are.

    The document has the head only and names that folder, so it stays small however many examples there are.
    """
    scores.write.mode("overwrite").json(f"{folder}/per_example")
    row = total.first().asDict(recursive=True)
    latency = {f"latency_{k}_seconds": round(row.pop(k) or 0.0, 3) for k in ("p50", "p95")}
    head = {"model_label": label, "model_class": model_class, "n_examples": row["n_examples"], "aggregate": {k: v for k, v in row.items() if k not in ("label", "n_timed")}}
    doc = head | latency | {"per_example": f"{folder}/per_example", "eval_path": path}
    jsonl.write_document(scores.sparkSession, doc, f"{folder}/result")
    return doc
