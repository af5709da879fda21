"""Every operator that passes columns through keeps columns that are named like its own, with their values."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import classifier, exact_dedup, line_dedup, mixing, near, simhash, warc

from .helpers import odd_docs

NAMES = (
    "__n __id __digest __none __key __gone __stay __n_lines __n_dropped __row __size __hash __pass __shard __words __block __source __upper __log_chars __label "
    "_n _id digest none n row size hash pass shard words block key lines leaf line again refers value root head fp run first kept doc quota place range target"
).split()
OPERATORS = {
    "exact_dedup": exact_dedup.deduplicate, "simhash": simhash.deduplicate, "near": near.deduplicate, "mixing": mixing.mix, "line_dedup": line_dedup.clean,
    "accepted": lambda d: classifier.accepted(d, classifier.Rules([[(3, True, -1.0)]], [1.0], 0.0)),
    "score": lambda d: classifier.score(d, classifier.Rules([[(3, True, -1.0)]], [1.0], 0.0)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_with_clashing_names_keep_their_values(spark, name):
    docs = odd_docs(spark).select("doc_id", "text", "source", "lang")
    wide = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in NAMES))
    plain, got = OPERATORS[name](docs), OPERATORS[name](wide)
    for r in got.select("doc_id", *(F.col(f"`{c}`") for c in NAMES)).collect():
        assert [r[c] for c in NAMES] == [f"{c}:{'null' if r['doc_id'] is None else r['doc_id']}" for c in NAMES]
    ids = lambda df: sorted(r[0] or -1 for r in df.select("doc_id").collect())
    assert ids(got) == ids(plain)


def test_archives_ignore_columns_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "u", "x", "a", "b"), (2, "u", "x", "a", "b"), (3, None, None, "a", "b")], "page_id long, url string, html string, again string, refers string")
    wide = pages.select("*", *(F.lit("clash").alias(c) for c in NAMES if c not in ("again", "refers")))
    got = sorted(r["value"] for r in warc.records(wide).collect())
    assert got == sorted(r["value"] for r in warc.records(pages.drop("again", "refers")).collect())
