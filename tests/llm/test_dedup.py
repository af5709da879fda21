import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, line_dedup, simhash
from millrace.llm.common import components

from .helpers import odd_docs, write_tables


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups_and_survivors(spark, tmp_path):
    docs = odd_docs(spark)
    rows = docs.collect()
    got = exact_dedup.op6_exact_dedup(spark, write_tables(spark, tmp_path, docs)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(norm(r["text"]), []).append(r["doc_id"])
    for text, ids in by.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [g for g in got if g["text_sha256"] == sha]
        assert sorted(map(str, ids)) == sorted(str(g["doc_id"]) for g in own)
        least = min(i for i in ids if i is not None)
        assert {g["keep_id"] for g in own} == {least} and {g["group_size"] for g in own} == {len(ids)}
        assert sum(g["kept"] for g in own) == 1 and all(g["doc_id"] == least for g in own if g["kept"])
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 7, 8, 9, 10]
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0
    assert exact_dedup.groups(docs.limit(0)).count() == 0


def test_merge_in_many_runs(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("text")).repartition(40)
    got = exact_dedup.merge_runs(exact_dedup.digests(docs), fan_in=3).collect()
    assert sum(r["size"] for r in got) == 3000
    assert len(got) == 1 + len({i % 500 for i in range(3000) if i % 3})
    assert max(r["size"] for r in got) == 1000


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    s = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    values = sorted(set(prints))
    near = {v: [w for w in values if (v ^ w).bit_count() <= radius] for v in values}
    root, out = {}, {}
    for v in values:
        if v in root:
            continue
        todo, root[v] = [v], v
        while todo:
            for w in near[todo.pop()]:
                if w not in root:
                    root[w] = v
                    todo.append(w)
    for v in values:
        out.setdefault(root[v], []).append(v)
    return root


def test_simhash_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))), "en", "a") for i in range(400)]
    long = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "x", "y"]) for _ in range(900)]
    for i in range(400, 480):
        w = list(long)
        w[rng.randrange(len(w))] = "other"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(500, None, "en", "a"), (501, "", "en", "a"), (None, "ABC abc Ä", "en", "a"), (502, "abc ABC ä", None, None), (503, "q", "en", "a"), (503, "q", "en", "a")]
    got = simhash.op7_simhash(spark, write_tables(spark, tmp_path, odd_docs(spark, rows))).collect()
    assert len(got) == len(rows)
    prints = [brute_fingerprint(r[1]) for r in rows]
    root, least = brute_components(prints), {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    want = sorted((str(r[0]), f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints, strict=True))
    assert sorted((str(g["doc_id"]), g["fingerprint"], g["component_id"]) for g in got) == want
    kept = simhash.deduplicate(odd_docs(spark, rows))
    assert kept.count() == len({x for _, _, x in want})
    assert simhash.classes(odd_docs(spark, [])).count() == 0


@pytest.mark.parametrize("shard", [64, 6])
def test_hot_shards_lose_no_link(spark, shard):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 700:
        values.add(rng.choice(sorted(values)[:50]) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values |= {rng.getrandbits(64) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = components(simhash.links(prints, 2, shard=shard)).collect()
    want = brute_components(list(values))
    size = {}
    for v in want.values():
        size[v] = size.get(v, 0) + 1
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"] % (1 << 64))
    expected = {}
    for v, r in want.items():
        if size[r] > 1:
            expected.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_masks_lose_a_band_each():
    full = (1 << 64) - 1
    for mask in (full, 0b1011, sum(1 << k for k in range(0, 64, 3))):
        rests = simhash.cut_bits(mask, 3)
        bands = [mask & ~r for r in rests]
        assert all(bands) and bands[0] | bands[1] | bands[2] == mask and sum(bands) == mask


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (300, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(50)) and got[300] == got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_and_templates(spark):
    noise = [f"unique words number q{chr(97 + i)} and r{chr(97 + i)} with s{chr(97 + i)} more t{chr(97 + i)}" for i in range(20)]
    rows = [(i, f"user {i} logged in from host 10.0.0.{i} today\n{noise[i]}\nshort line", "en", "a") for i in range(10)]
    rows += [(50, None, "en", "a"), (51, "", "en", "a"), (52, "solo line that nobody else ever wrote", "en", "a")]
    out = line_dedup.clean(odd_docs(spark, rows))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [*odd_docs(spark, []).columns, "__n_lines", "__n_dropped"]
    for i in range(10):
        assert got[i]["text"] == f"{noise[i]}\nshort line" and got[i]["__n_dropped"] == 1 and got[i]["__n_lines"] == 3
    assert got[50]["text"] is None and got[51]["text"] == "" and got[52]["__n_dropped"] == 0
    # a template with a variable field that holds no digit, generalised within its leaf
    rows = [(i, f"the quick brown fox jumps over {w} dog in the morning", "en", "a") for i, w in enumerate(["lazy", "small", "big", "old"])]
    assert all(r["text"] == "" for r in line_dedup.clean(odd_docs(spark, rows), words_together=33).collect())
    assert line_dedup.clean(odd_docs(spark, [])).count() == 0
