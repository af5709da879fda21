import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from millrace.llm import classifier, exact_dedup, simhash  # noqa: E402

from .helpers import odd_docs, write_tables  # noqa: E402
from .test_corpus import size  # noqa: E402


def tables(spark, path):
    good = lambda i: f"Plain words of document number {i}, which nobody would ever reject. " * (3 + i % 4)
    rows = [(i, good(i), "en", "ab"[i % 2]) for i in range(60)]
    rows += [(100 + i, "*** %%% $$$ " * (10 + i), "en", "a") for i in range(30)]
    rows += [(200, good(1), "en", "b"), (201, good(2).replace(" ", "  "), "en", "a"), (300, None, None, None), (301, "", "en", "a")]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(30)]
    return write_tables(spark, path, odd_docs(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_each_stage_takes_effect(spark, tmp_path):
    path = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        ids.append(sorted((r["doc_id"] for r in docs.collect()), key=str))
    assert not {100 + i for i in range(30)} & set(ids[0]) and set(range(60)) <= set(ids[0])
    assert not {200, 201} & set(ids[1]) and set(range(60)) <= set(ids[1])
    assert set(ids[2]) <= set(ids[1]) and len(ids[2]) == len(set(ids[2]))
    assert set(ids[3]) <= set(ids[2]) and set(ids[4]) == set(ids[3])


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    path = tables(spark, tmp_path)
    out = corpus_pipeline.run(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    scored = {r["doc_id"] for r in classifier.op4_quality(spark, path).collect() if r["predicted"] == 1}
    rest = docs.where(docs["doc_id"].isin(list(scored)))
    exact = exact_dedup.deduplicate(rest)
    firsts = {r["id"] for r in simhash.classes(exact).where("first").collect()}
    want = sum(size(r["text"]) for r in exact.collect() if r["doc_id"] in firsts)
    mixed = spark.createDataFrame(out.groupBy("sequence_id").sum("length").collect())
    assert mixed.count() and {r["doc_id"] for r in out.collect()} <= firsts
    words = sum(size(r["text"]) for r in corpus_pipeline.mixed(spark, exact.where(exact["doc_id"].isin(list(firsts))), path).collect())
    assert abs(words - want) <= 2
