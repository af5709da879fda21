import math
import random

from pyspark.sql import functions as F

from millrace.llm import nearest


def test_recall_and_exact_scores(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)], 0) for i in range(600)]
    rows += [(700 + i, rows[5][1], 0) for i in range(60)]  # a hot vector
    rows += [(900, None, 0), (920, [], 0), (940, [0.0] * 24, 0), (960, [float("nan")] + [1.0] * 23, 0), (980, [None] + [1.0] * 23, 0), (None, [1.0] * 24, 0), (1000, [1.0, 2.0], 0), (1, rows[1][1], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = nearest.op8_nearest(spark, str(tmp_path)).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect() if r["vec_id"] is not None and r["embedding"] and len(r["embedding"]) == 24 and None not in r["embedding"] and all(map(math.isfinite, r["embedding"])) and any(r["embedding"])}
    hits = total = 0
    for q in [i for i in vectors if i % 20 == 0]:
        score = {}
        for i, v in vectors.items():
            s = 0.0
            for a, b in zip(vectors[q], v, strict=True):
                s += a * b
            score[i] = s
        want = sorted((-s, i) for i, s in score.items() if i != q)[:20]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(s == score[i] for _, i, s in own)
        assert own == [(k + 1, i, s) for k, (s, i) in enumerate((s, i) for _, i, s in own)]
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len({i for _, i in want} & {i for _, i, _ in own})
        total += 20
    assert hits / total >= 0.95
    assert not [r for r in got if r["query_id"] >= 900]
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_codes_estimate_without_bias():
    import numpy as np

    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(4000, 48)), rng.normal(size=48)
    turn = nearest.rotation(48, 1)
    codes, norms, correction = nearest.encode(v, turn)
    signs = np.unpackbits(codes, axis=1, count=48) * 2.0 - 1
    estimate = (signs @ (q @ turn)) * norms / correction / np.sqrt(48)
    spread = norms * np.linalg.norm(q) * np.sqrt(1 / correction**2 - 1) / np.sqrt(47)
    z = (estimate - v @ q) / spread
    assert abs(z.mean()) < 0.1 and 0.8 < z.std() < 1.2


def brute(vectors, k):
    import numpy as np

    out = {}
    for dim in {len(v) for v in vectors.values()}:
        ids = np.array([i for i, v in vectors.items() if len(v) == dim])
        x = np.array([vectors[i] for i in ids], dtype="float32").astype("float64")
        for at in np.nonzero(ids % 20 == 0)[0]:
            s = x @ x[at]
            s[at] = -np.inf
            out[int(ids[at])] = set(ids[np.lexsort((ids, -s))[: min(k, len(ids) - 1)]].tolist())
    return out


def test_recall_over_blocks_cells_and_dimensions(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 32)) * 2
    rows = {i: (centres[i % 12] + rng.normal(size=32)).tolist() for i in range(3000)}
    rows |= {i: rng.normal(size=70).tolist() for i in range(5000, 5900)}
    rows |= {i: rng.normal(size=3).tolist() for i in range(6000, 6050)}
    df = spark.createDataFrame([(i, v) for i, v in rows.items()], "vec_id long, embedding array<float>").repartition(5)
    for how in (dict(vector_block=64, query_block=8), dict(sample_rows=1000)):
        got = {}
        for r in nearest.search(df, F.col("vec_id") % 20 == 0, **how).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        want = brute(rows, 20)
        assert got.keys() == want.keys()
        recall = sum(len(got[q] & want[q]) for q in want) / sum(map(len, want.values()))
        assert recall >= 0.9, (how, recall)


def test_clusters_spare_cells():
    import numpy as np

    rng = np.random.default_rng(1)
    clustered = rng.normal(size=(16, 24))[rng.integers(0, 16, 4096)] * 3 + rng.normal(size=(4096, 24)) * 0.3
    centres = nearest.directions(clustered, 16, 0)
    assert nearest.visits(clustered, centres, 20, 0.97) <= 4
