"""Periodic runs against brute force over all starts and periods."""

import binascii
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import repeats

from .helpers import odd_docs, write_tables


def brute(words, least_length=6, least_exponent=4):
    n, out = len(words), []
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least_length, least_exponent * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = binascii.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def row(doc_id, words):
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (3, 3)])
def test_runs_of_random_texts(least):
    rng = random.Random(least[0])
    texts = []
    for _ in range(400):
        letters = rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 5))]
            words += (unit * 9)[: rng.randrange(30)]
        texts.append(words)
    got = repeats.find_runs([np.array(t, dtype="int64") for t in texts], np, *least)
    want = [(k, *r) for k, t in enumerate(texts) for r in brute(t, *least)]
    assert [tuple(r) for r in got.tolist()] == want


def test_stretches_in_several_chunks(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 50)
    texts = [np.array(([1, 2, 3] * 8 + [9] + [4] * 7 + list(range(10, 20))) * 3, dtype="int64")] * 5 + [np.array([5] * 200)]
    got = [tuple(r) for r in repeats.find_runs(texts, np).tolist()]
    assert got == [(k, *r) for k, t in enumerate(texts) for r in brute(t.tolist())]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " \t".join(rng.choice("abcdefgh" if i % 3 else "ab") for _ in range(rng.randrange(90))), "en", "a") for i in range(150)]
    rows += [(None, "x " * 9, "en", "a"), (151, None, None, None), (151, "", "en", "b"), (151, "  " * 8 + "\x1c y", "en", "b"), rows[3], (152, "Éa 😀 " * 12, "fr", "c")]
    where = write_tables(spark, tmp_path, odd_docs(spark, rows))
    got = [tuple(r) for r in repeats.op12_repeats(spark, where).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    words = lambda t: [w.decode() for w in (t or "").encode().split()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted((row(i, planted(i, words(t))) for i, t, *_ in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 20


def test_odd_tables(spark):
    docs = odd_docs(spark)
    got = repeats.repeats(docs).collect()
    assert sorted(r["id"] or -1 for r in got) == sorted(r["doc_id"] or -1 for r in docs.collect())
    assert {(r["n_words"], r["collapsed"], tuple(r["runs"][0])) for r in got if r["id"] == 7} == {(5000, "word", (0, 5000, 1))}
    assert repeats.repeats(docs.limit(0)).collect() == []
    wide = docs.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("runs", "n_words", "collapsed", "words")))
    assert repeats.repeats(wide).count() == len(got)


def test_very_long_texts_take_little_more_than_linear_time():
    took = []
    for n in (40_000, 320_000):
        unit = [k % 977 for k in range(1000)]
        text = np.array((unit * (n // 2000) + [1, 2] * (n // 8) + [3] * (n // 4)), dtype="int64")
        began = time.time()
        assert len(repeats.find_runs([text], np)) >= 3
        took.append(time.time() - began)
    assert took[1] < 25 * max(took[0], 0.2)
