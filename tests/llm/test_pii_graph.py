"""The bootstrapping against a scorer in plain Python, long texts, and odd tables."""

import math
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import pii

from .helpers import odd_docs


def brute_bootstrap(texts, rounds=3, least_support=3, least_confidence=0.8, accept=0.9):
    edges, seeds = defaultdict(set), set()
    for t in texts:
        for instance, kind, _, _, _, patterns in pii.mentions(t or "", pii.base_spans(t or "")):
            for p in patterns:
                edges[p].add(instance)
                if kind >= 0:
                    seeds.add((p, instance, kind))
    top = {}
    for p, i, k in seeds:
        top[p, i] = max(k, top.get((p, i), -1))
    start = {(i, k): 1.0 for (p, i), k in top.items()}
    known = {i for i, _ in start}
    scored, new = dict(start), {}
    for _ in range(rounds):
        sure = {}
        for p, members in edges.items():
            for k in range(4):
                own = [scored[i, k] for i in members if (i, k) in scored]
                if len(own) >= least_support and sum(own) / len(members) >= least_confidence:
                    sure[p, k] = sum(own) / len(members)
        new = defaultdict(float)
        for (p, k), c in sure.items():
            for i in edges[p]:
                if i not in known:
                    new[i, k] += math.log(max(1 - c, 0.05))
        new = {x: 1 - math.exp(v) for x, v in new.items()}
        scored = {**start, **new}
    return {x: v for x, v in new.items() if v >= accept}


def planted(seed):
    """Texts with known addresses and numbers, and some unknown ones (no dot, no plus) in the same and in other contexts."""
    rng = random.Random(seed)
    texts = []
    for k in range(60):
        texts.append(f"please write to us at user{k}@host{k}.example for more news {k}")
        texts.append(f"order number {rng.randrange(10**6, 10**7)} was sent on day {k}")
        texts.append(f"call me on +49 30 {rng.randrange(10**6, 10**7)} tomorrow at noon")
        if k % 8 == 0:
            texts.append(f"please write to us at local{k}@intranet for more news {k}")
            texts.append(f"call me on 030 {rng.randrange(10**6, 10**7)} tomorrow at noon")
            texts.append(f"she said local{k}@intranet is down")
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_bootstrapping_agrees_with_brute_force(spark, seed):
    texts = [*planted(seed), None, ""]
    docs = odd_docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {(r["instance"], r["kind"]): r["score"] for r in pii.bootstrap(pii.extract(docs)).collect()}
    want = brute_bootstrap(texts)
    assert len(want) > 12 and got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_added_spans_find_unknown_identifiers_and_nothing_else(spark):
    texts = planted(3)
    docs = odd_docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    added = {(r["id"], s["kind"]) for r in pii.find(docs).collect() for s in set(r["spans"]) - set(r["base"])}
    hidden = {(i, 0) for i, t in enumerate(texts) if "@intranet" in t} | {(i, 3) for i, t in enumerate(texts) if "on 030" in t}
    recall, precision = len(added & hidden) / len(hidden), len(added & hidden) / max(1, len(added))
    assert recall == 1 and precision == 1


@pytest.mark.parametrize("text", ["a" * 10**6 + " 1", "1" * 10**6, "@" * 10**6, "漢" * 10**6 + "7", ("7" + "a" * 50) * 20_000, "1 " * 500_000, "a@b " * 250_000, "- " * 500_000 + "user1234567", "10.1.2.3," * 111_000, "a1@b.co," * 125_000, "a1@b.co,--" * 100_000, "+1 23456789;" * 80_000, "x1=" * 330_000, "1, " * 330_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    pii.mentions(text, pii.base_spans(text))
    assert time.time() - began < 20


def test_rows_of_numbers_are_cut_and_long_words_kept():
    text = "codes " + " ".join("123456" for _ in range(40)) + " end"
    spans = [(a, b) for _, k, a, b, _, _ in pii.mentions(text, []) if k < 0]
    assert "".join(text[a:b] for a, b in spans).replace(" ", "") == "123456" * 40
    long = "x" * 300 + "@" + "y" * 300
    (found,) = pii.mentions(f"write to {long} or not", [])
    assert found[2:4] == (9, 9 + len(long)) and found[0].startswith("#") and found[4] & 1


def test_contexts_end_at_neighbouring_mentions():
    text = "see a1@b.co,c2@d.eu; then"
    got = {text[a:b]: p for _, k, a, b, _, p in pii.mentions(text, pii.base_spans(text)) if k == 0}
    assert got == {"a1@b.co": ["_ c0@d.eu then", "see _ c0@d.eu"], "c2@d.eu": ["see a0@b.co _", "a0@b.co _ then"]}


def test_identifiers_of_few_digits_are_found(spark):
    texts = [f"node {k} listens at 10.0.{k}.7 all day long" for k in range(40)] + ["node 41 listens at 1:2:3:4 all day long", "node 42 listens at noon all day long", "at 5 all day"]
    got = pii.find(odd_docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).where("id >= 40").collect()
    assert {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got} == {40: [(1, 19, 26)], 41: [], 42: []}


def test_odd_rows(spark):
    text = "please write to us at user1@host1.example for more news"
    rows = [(None, text, "en", "a"), (3, text, "en", "a"), (3, text, "en", "a"), (4, None, "en", None), (5, "x" * 300_000 + " 1", "en", "a")]
    got = sorted((r["id"] or 0, len(r["base"])) for r in pii.find(odd_docs(spark, rows)).collect())
    assert got == [(0, 1), (3, 1), (3, 1), (4, 0), (5, 0)]
    assert pii.find(odd_docs(spark, rows).where(F.lit(False))).count() == 0
