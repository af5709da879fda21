"""The classifier's parts and the pipeline's first stages against plain Python."""

import random
import re

import numpy as np
import pytest

from millrace.llm import classifier

from .helpers import odd_docs, write_tables

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    raw = (text or "").encode()
    words, lines = [w.encode() for w in WORD.findall(text or "")], raw.split(b"\n")
    n, w = max(1, len(raw)), max(1, len(words))
    count = lambda low, high: sum(low <= c <= high for c in raw)
    upper, lower, digit, beyond = count(65, 90), count(97, 122), count(48, 57), count(128, 255)
    blank = sum(c in b" \t\n\v\f\r" for c in raw)
    plain = lambda c: c >= 128 or bytes([c]).isalnum()
    ends = len(re.findall(rb"\. |\.\n|! |\? ", raw)) + raw.endswith((b".", b"!", b"?"))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), upper / max(1, upper + lower), digit / n, (len(raw) - upper - lower - digit - blank - beyond) / n, blank / n, beyond / n, ends / w, (len(raw) - blank) / w,
        sum(len(x) > 12 for x in words) / w, len(set(words)) / w, max((words.count(x) for x in set(words)), default=0) / w, sum(not plain(x[0]) or not plain(x[-1]) for x in words) / w, sum(len(x) < 30 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines),
    ]


def test_statistics_of_texts(spark):
    rng = random.Random(4)
    texts = ["", " \n\n ", "a", "A. B! C?", "x" * 40_000, "word. " * 20_000, "Éa ñ 😀 (z)"] + ["".join(rng.choice("abcXYZ019 .,!?#\n\tñ😀\x1c") for _ in range(rng.randrange(300))) for _ in range(80)]
    docs = odd_docs(spark, [(i, t, "en", "a") for i, t in enumerate([*texts, None])])
    got = {r["doc_id"]: [r[f"__{s}"] for s in classifier.STATISTICS] for r in classifier.statistics(docs, "text", ["doc_id"]).collect()}
    for i, t in enumerate([*texts, None]):
        assert got[i] == pytest.approx(brute_statistics(t), abs=1e-12), t


def test_paths_split_where_a_search_over_all_thresholds_splits():
    rng = np.random.default_rng(7)
    x, residual = rng.random((200, 3)), rng.normal(size=200)
    residual[(x[:, 1] > 0.4) & (x[:, 2] <= 0.7)] += 2
    bins, least = [np.quantile(x[:, k], np.linspace(0, 1, 17)[1:-1]) for k in range(3)], 10
    paths, leaves = classifier._paths(x, residual, bins, 2, least)

    def best(rows):
        found = []
        for k in range(3):
            for edge in bins[k]:
                low = rows[x[rows, k] <= edge]
                high = rows[x[rows, k] > edge]
                if min(len(low), len(high)) >= least:
                    found.append((sum(((residual[part] - residual[part].mean()) ** 2).sum() for part in (low, high)), k, edge))
        return min(found)[1:]

    rows = np.arange(200)
    k, edge = best(rows)
    assert paths[0] == [(k, False, edge)] and [(k, True, edge)] in paths
    inner = {tuple(p[0]): p[1][::2] for p in paths if len(p) == 2}
    for side in (False, True):
        part = rows[(x[:, k] > edge) == side]
        assert inner[k, side, edge] == best(part)
    hold = classifier.Rules(leaves, [], 0.0).matrix(x)
    assert (hold.sum(axis=1) == 1).all()  # leaves deal all rows


def test_weights_meet_the_lasso_conditions():
    rng = np.random.default_rng(3)
    x = rng.random((600, len(classifier.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.6) | (rng.random(600) < 0.1)).astype(float)
    penalty = 5e-3
    model = classifier.fit_rules(x, y, trees=15, penalty=penalty, steps=6000)
    m = model.matrix(x)
    w, size = np.array(model.weights), np.maximum(m.std(axis=0), 0.05)
    p = 1 / (1 + np.exp(-(m @ w + model.intercept)))
    gradient = ((m - m.mean(axis=0)) / size).T @ (p - y) / len(y)
    assert 0 < len(w) and abs((p - y).mean()) < 1e-3
    assert np.abs(gradient + penalty * np.sign(w)).max() < 1e-3


def test_first_stages_against_plain_python(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40, 160)))
    texts = [text() for _ in range(30)]
    for k in range(30):
        words = texts[k].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words) if k % 3 else texts[k].replace(" ", "  ", 5))
    rows = [(i * 7 % 61, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)] + [(70, "one two", "en", "a"), (71, "one two", "en", "b"), (72, "", "de", "b"), (73, None, None, None)]
    where = write_tables(spark, tmp_path, odd_docs(spark, rows), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    docs = spark.read.parquet(f"{where}/documents.parquet")
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, where).write.parquet(f"{tmp_path}/s{k}")
        docs = spark.read.parquet(f"{tmp_path}/s{k}")
        ids.append(sorted(r["doc_id"] for r in docs.collect()))
    assert ids[0] == sorted(i for i, *_ in rows)  # no labels: nothing is rejected
    first = {}
    for i, t, *_ in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert ids[1] == sorted(first.values())

    def shingles(t):
        words = WORD.findall((t or "").lower())
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets = {i: shingles(t) for i, t, *_ in rows if i in ids[1]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert ids[2] == sorted(i for i in sets if find(i) == i) and len(ids[2]) < len(ids[1])


def test_an_empty_table_goes_through_all_stages(spark, tmp_path):
    where = write_tables(spark, tmp_path, odd_docs(spark, []), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, where).collect() == []
