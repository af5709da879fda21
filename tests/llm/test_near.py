import random

import corpus_pipeline
from millrace.llm import near
from millrace.llm.common import components

from .helpers import odd_docs


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}


def brute_kept(rows, similarity=0.8):
    """Identifiers of the smallest document of each component of the links."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) / len(x | y) >= similarity:
                root[top(i)] = top(j)
    heads = {}
    for i, r in enumerate(rows):
        heads.setdefault(top(i), []).append(r[0])
    return sorted(min(v) for v in heads.values())


def corpus(rng, families, copies):
    """Texts and copies with one to a few words replaced, at similarities on both sides of 0.8."""
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 400))]
        rows.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(1 + rng.randrange(1 + len(w) // 35)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return [(i, t, "en", "a") for i, t in enumerate(rows)]


def test_stage_finds_copies_from_similarity_0_8_and_leaves_the_rest(spark, tmp_path):
    rows = corpus(random.Random(3), 60, 4)
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "a b", "en", "a"), (1003, "A  b", "en", "a"), (1004, "a c", "en", "a")]
    kept = corpus_pipeline.near(spark, odd_docs(spark, rows), str(tmp_path))
    assert kept.columns == odd_docs(spark, []).columns
    want = brute_kept(rows)
    assert 60 < len(want) < 200
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert corpus_pipeline.near(spark, odd_docs(spark, []), str(tmp_path)).count() == 0


def test_rounds_change_no_result(spark):
    rows = corpus(random.Random(5), 2, 60)
    want = brute_kept(rows)
    for most_rounds, shard in ((1, 8), (1, 512), (4, 16)):
        kept = near.deduplicate(odd_docs(spark, rows), most_rounds=most_rounds, shard=shard)
        assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_near_stage_keeps_distinct_texts_that_share_an_identifier(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey")
    rows = [(None, a, "en", "a"), (None, b, "en", "a"), (None, c, "en", "a"), (5, a + " x", "en", "a"), (5, "it is another text altogether here", "en", "a"), (5, "it is another text altogether here", "en", "a")]
    got = sorted(r["text"] for r in near.deduplicate(odd_docs(spark, rows)).collect())
    assert got == sorted([a, b, c, a + " x", "it is another text altogether here"])


def test_a_shard_of_a_star_family_is_searched_whole(spark):
    """Copies that are similar to one text only, not to each other, and no pivot: the search of the trees finds their links."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(40):
        w, at = list(base), rng.randrange(260)
        w[at : at + 25] = [rng.choice(words) for _ in range(25)]
        texts.append(" ".join(w))
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    kept = near.deduplicate(odd_docs(spark, rows), most_rounds=1, shard=8)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(rows)


def test_components_agree_in_one_task_and_in_rounds(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)]
    df = spark.createDataFrame([*edges, (None, 3), (9, None)], "a long, b long")
    got = [sorted(map(tuple, components(df, one_task=n).collect())) for n in (0, 1 << 20)]
    assert got[0] == got[1] and len(got[0]) > 100
    assert components(df.limit(0)).count() == 0
