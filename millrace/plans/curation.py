"""The curation chain as one lazy plan: validate, drop near-duplicates, filter, split, format."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import contract, conversation, dedup, metrics, quality, split
from millrace.sources.shared import cut


def curate(examples: DataFrame, order: str = "id", threshold: Fraction = Fraction(18, 25), **how) -> dict[str, DataFrame]:
    """Tables by name: failed, duplicates, rejected, split, conversations and the funnel. Examples have a VARIANT payload."""
    checked = contract.validate(examples)
    valid, failed = contract.route(checked)
    valid = cut(valid.drop("record"))
    kept, duplicates = dedup.run(valid, order, "document_text", threshold)
    judged = cut(kept.withColumn("quality_filter_reason", quality.reason()))
    good, rejected = contract.route(judged, "quality_filter_reason")
    parts = split.assign(good, order, **how)
    steps = [("generated", examples), ("valid", valid), ("deduplicated", kept), ("filtered", good)]
    return {"failed": failed, "duplicates": duplicates, "rejected": rejected, "split": parts, "conversations": conversation.render(good), "funnel": metrics.funnel(steps)}
