"""Compression bands: counts against brute force, ratios against the compressor, verdicts on clean and broken text, labels."""

import base64
import os
import random
import re
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from millrace.llm import compression

from .helpers import odd_docs, write_tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


@pytest.fixture(scope="module")
def prose(spark):
    """Words of clean English documents of the tables, one after another."""
    folder = "/root/testdata/sf0.01"
    clean = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("lang = 'en'").dropDuplicates(["text"]).join(clean, "doc_id")
    return " ".join(r["text"] for r in docs.orderBy("doc_id").collect()).split()


def test_counts_and_verdicts_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "é", "😀", "#x|", "\n", "\n\n", "a\t\na", "\x1c", "\x85"]) for _ in range(rng.randrange(160))) for _ in range(200)]
    texts += ["a b c " * 20, "x\n \nx\n \nx\n", "\n\n", "a b", "a b c", "a a a a", "same line here\n" * 30]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(None, None, None, None), (3, texts[3], "en", "a")]
    got = compression.op13_compression(spark, write_tables(spark, tmp_path, odd_docs(spark, rows))).collect()
    assert len(got) == len(rows)
    want = {(i, t): brute(t) for i, t, *_ in rows}
    assert sorted(str((r["doc_id"], *(r[c] for c in compression.COUNTS))) for r in got) == sorted(str((i, *brute(t))) for i, t, *_ in rows)
    bands, z = compression.Bands(), zstandard.ZstdCompressor(level=3)
    for r in got:
        n, *_, repeat = (r[c] for c in compression.COUNTS)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (r["base_failed"] and r["kept"])
        b = next(t for i, t in want if i == r["doc_id"]) or ""
        size = len(b.encode())
        assert r["ratio"] == (size / len(z.compress(b.encode())) if b else 0) and r["n_chunks"] == size // bands.chunk_bytes


@pytest.mark.parametrize("n", [60, 300, 3000, 40000])
def test_prose_stays_and_broken_text_goes(spark, prose, n):
    rng = random.Random(n)
    noise = " ".join(base64.b64encode(os.urandom(rng.randrange(30, 60))).decode() for _ in range(n))
    stamp = " ".join(f"{w}###{w} |" for w in ["one", "two", "three", "four", "five"] * (n // 5))
    docs = spark.createDataFrame([(0, " ".join(prose[:n])), (1, noise), (2, stamp)], "doc_id long, text string")
    got = {r["id"]: r["in_band"] for r in compression.measure(docs).collect()}
    assert got == {0: True, 1: n < 300 and got[1], 2: False}


def test_a_long_text_with_a_repetitive_half(spark, prose):
    clean = " ".join(prose[:6000])
    half = clean + " " + "buy now and save more " * (len(clean) // 20)
    got = {r["id"]: r for r in compression.measure(spark.createDataFrame([(0, clean), (1, half)], "doc_id long, text string")).collect()}
    assert got[0]["in_band"] and not got[1]["in_band"] and got[1]["n_outside"] > 0.4 * got[1]["n_chunks"]


def test_bands_fitted_to_clean_rows(spark):
    folder = "/root/testdata/sf0.01"
    clean = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    bands = compression.fitted(spark.read.parquet(f"{folder}/documents.parquet").join(clean, "doc_id"))
    xs = [k[0] for k in bands.whole]
    assert xs == sorted(set(xs)) and all(low < high for _, low, high in bands.whole)
    default = {x: (low, high) for x, low, high in compression.Bands().whole}
    assert all(abs(high - default[x][1]) < 0.2 for x, _, high in bands.whole if x in default and 9 <= x <= 13)
    assert compression.fitted(spark.createDataFrame([], "doc_id long, text string")) == compression.Bands()


def test_odd_tables(spark):
    docs = odd_docs(spark)
    got = compression.measure(docs).collect()
    assert sorted(r["id"] or -1 for r in got) == sorted(r["doc_id"] or -1 for r in docs.collect())
    assert {(r["ratio"], r["in_band"]) for r in got if r["n_words"] == 0 and r["id"] in (3, 4)} == {(0.0, False)}
    assert compression.measure(docs.limit(0)).collect() == []
    wide = docs.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("ratio", "n_words", "in_band")))
    assert compression.measure(wide).count() == len(got)


def test_held_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = compression.op13_compression(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null"), "doc_id").where("n_words >= 50")
    r = {x["quality"]: x for x in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert r[1]["kept"] > 0.99 and r[0]["kept"] < 0.35
