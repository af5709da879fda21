"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is rotated by one random orthogonal matrix and kept as the signs of its components (packed bits) with two
correction scalars, its norm and the inner product of the unit vector with its own code (Gao and Long 2024). Each vector
is encoded once, before any exchange. A query's rotated components are rounded to ``LEVELS`` levels, so an estimate is a
sum of bit counts of the code under each bit of the query; ``bound`` standard errors around it decide which vectors are
reranked: first the best estimates set an exact threshold, then all whose upper bound reaches it are scored on the
original vectors. The k best of all cells are kept.

A coarse level above the codes spares work where the vectors are clustered: directions from a bounded sample
(``sample_rows`` rows by the smallest hash) deal every vector into one cell, and a query visits the cells whose direction
is nearest to it, as many as give ``coarse_recall`` of the neighbours within the sample (measured there; all cells where
vectors have no clusters). Every row is indexed. Cells are cut into blocks of ``vector_block`` vectors and
``query_block`` queries, so a task is bounded; a vector goes to the query blocks of its own cell only, and only the
sample's directions are broadcast. Equal vectors are folded before that: of one vector only the k + 1 smallest
identifiers can be among k nearest, so a hot vector fills no block.

Defined cases: vectors that are null, of no length, zero or hold null or non-finite components, and rows with a null
identifier, take no part; vectors of another length are never compared; rows that repeat identifier and vector count
once; the candidates of a query are all rows with another identifier; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, table

LEVELS = 64
#: Rows of the sample for each direction at least: 2,048 cells from the default sample, more from a larger one.
DIRECTION_ROWS = 16
RESULT = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int):
    import numpy as np

    return np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))[0]


def encode(vectors, turn):
    """Packed codes (n, ceil(dim / 8)), norms and correction scalars of the rows of a matrix."""
    import numpy as np

    norms = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norms[:, None]) @ turn
    correction = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])  # <code, vector>, as the code has its signs
    return np.packbits(turned > 0, axis=1), norms, correction


def exact(a, b):
    """Inner products of paired rows in double precision, summed from the first component to the last."""
    import numpy as np

    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k].astype("float64") * b[:, k].astype("float64")
    return out


def directions(sample, cells: int, seed: int, steps: int = 8):
    """Unit vectors that the sample's directions gather around (spherical k-means)."""
    import numpy as np

    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    out = unit[np.random.default_rng(seed).permutation(len(unit))[:cells]]
    for _ in range(steps):
        own = (unit @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1)
        out = np.where((size > 0)[:, None], sums / np.maximum(size, 1e-12)[:, None], out)
    return out


def visits(sample, centres, k: int, recall: float, most_queries: int = 256) -> int:
    """How many cells a query has to visit for the recall among the sample's own neighbours."""
    import numpy as np

    own = (sample @ centres.T / np.linalg.norm(sample, axis=1)[:, None]).argmax(axis=1)
    asks = sample[:most_queries]
    scores = asks @ sample.T
    scores[np.arange(len(asks)), np.arange(len(asks))] = -np.inf
    k = min(k, len(sample) - 1)
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(asks @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def _place(centres: dict, visit: dict, seed: int):
    """Rows with the vector's cell, code and scalars; queries once more for each cell that they visit."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            t = pa.Table.from_batches([b])
            lengths = np.diff(b.column(1).offsets.to_numpy())
            for dim in np.unique(lengths).tolist():
                rows = np.nonzero(lengths == dim)[0]
                own = t.take(pa.array(rows))
                x = own["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim).astype("float64")
                asks = own["ask"].to_numpy()
                codes, norms, correction = encode(x, rotation(dim, seed))
                if dim in centres:
                    near = x @ centres[dim].T
                    cells, many = near.argmax(axis=1), np.argsort(-near, axis=1, kind="stable")[:, : visit[dim]]
                else:
                    cells, many = np.zeros(len(x), dtype="int64"), np.zeros((len(x), 1), dtype="int64")
                # a candidate is one row in its cell, a query one in each cell that it visits
                which = np.concatenate([np.nonzero(~asks)[0], np.repeat(np.nonzero(asks)[0], many.shape[1])])
                cell = np.concatenate([cells[~asks], many[asks].ravel()])
                out = own.take(pa.array(which))
                code = pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(which))
                yield from pa.table({"id": out["id"], "vector": out["vector"], "ask": out["ask"], "dim": pa.array(np.full(len(which), dim), pa.int32()), "cell": pa.array(cell, pa.int32()), "code": code, "norm": pa.array(norms[which]), "correction": pa.array(correction[which])}).to_batches()

    return run


def _cell(k: int, bound: float, seed: int):
    def words(codes, dim):
        """The packed codes as 64-bit words."""
        import numpy as np

        wide = np.zeros((len(codes), -(-dim // 64) * 8), dtype="uint8")
        wide[:, : codes.shape[1]] = codes
        return wide.view("uint64")

    def search(ids, vectors, codes, norms, correction, q_ids, queries):
        """The k best of one block for each query: (query position, vector position, score)."""
        import numpy as np

        dim = vectors.shape[1]
        turn = rotation(dim, seed)
        bits = words(codes, dim)
        set_bits = np.bitwise_count(bits).sum(axis=1, dtype="int64")
        scale = norms / correction / np.sqrt(dim)
        spread = bound * norms * np.sqrt(np.maximum(0, 1 / correction**2 - 1)) / np.sqrt(max(1, dim - 1))
        single, places = vectors.astype("float32"), np.argsort(ids, kind="stable")
        ordered = ids[places]
        top, found = min(len(ids), 2 * k), []
        turned = queries.astype("float64") @ turn
        size = np.linalg.norm(queries.astype("float64"), axis=1)
        for n, q in enumerate(queries):
            low, high = float(turned[n].min()), float(turned[n].max())
            step = max((high - low) / (LEVELS - 1), 1e-300)
            level = np.rint((turned[n] - low) / step).astype("uint8")
            total = low * dim + step * int(level.sum())
            held = low * set_bits
            for j in range(6):
                plane = words(np.packbits((level >> j) & 1)[None, :], dim)
                held = held + step * (1 << j) * np.bitwise_count(bits & plane).sum(axis=1, dtype="int64")
            est = (2 * held - total) * scale
            own = places[np.searchsorted(ordered, q_ids[n], "left") : np.searchsorted(ordered, q_ids[n], "right")]
            est[own] = -np.inf
            best = np.argpartition(est, len(est) - top)[-top:]
            sure = np.sort(exact(np.broadcast_to(q, (len(best), dim)), vectors[best])[~np.isin(best, own)])
            least = sure[-k] if len(sure) >= k else -np.inf
            # rounding moves the sum by about step * sqrt(dim / 12)
            slack = 1e-5 * size[n] * (norms.max() if len(norms) else 0) + bound * step * np.sqrt(dim / 12) * scale
            near = np.nonzero((est + spread * size[n] + slack >= least) & (est > -np.inf))[0]
            if len(near) > 4 * k:  # a float32 pass over the reranked, then double precision over what may be best
                rough = single[near] @ q.astype("float32")
                near = near[rough >= np.partition(rough, len(rough) - k)[-k] - 1e-5 * size[n] * norms.max()]
            score = exact(np.broadcast_to(q, (len(near), dim)), vectors[near])
            order = np.lexsort((ids[near], -score))[:k]
            found.append((np.full(len(order), n), near[order], score[order]))
        return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, "int64")] * 2 + [np.empty(0)]

    def run(t):
        import numpy as np
        import pyarrow as pa

        t = t.combine_chunks()
        asks, ids = t["ask"].to_numpy(), t["id"].to_numpy()
        vectors = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        held = np.nonzero(~asks)[0]
        codes = np.frombuffer(b"".join(t["code"].take(pa.array(held)).to_pylist()), dtype="uint8").reshape(len(held), -1) if len(held) else np.zeros((0, 1), "uint8")
        if not len(held) or not asks.any():
            q, v, s = [np.empty(0, "int64")] * 2 + [np.empty(0)]
        else:
            q, v, s = search(ids[held], vectors[held], codes, t["norm"].to_numpy()[held], t["correction"].to_numpy()[held], ids[asks], vectors[asks])
        return pa.table({"query_id": pa.array(ids[asks][q], pa.int64()), "vec_id": pa.array(ids[held][v], pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 20, bound: float = 1.9, seed: int = 11, vector_block: int = 8192, query_block: int = 2048, sample_rows: int = 1 << 15, coarse_recall: float = 0.97) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found for every row where ``queries`` holds."""
    import numpy as np

    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(queries, F.lit(False)).alias("ask")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    same = Window.partitionBy("vector").orderBy("id")
    distinct = rows.select("id", "vector", "ask").distinct()
    candidates = distinct.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("id", "vector", F.lit(False).alias("ask"))
    sampled = rows.select("id", "vector").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).select("vector").collect()
    sampled = [np.array(v, dtype="float64") for v in sorted({tuple(r["vector"]) for r in sampled})]
    n_rows = rows.count()
    centres, visit = {}, {}
    for dim in {len(x) for x in sampled}:
        own = np.array([x for x in sampled if len(x) == dim])
        own = own[np.random.default_rng(seed).permutation(len(own))]
        # a cell holds about a block, and the sample has some rows for each direction
        cells = min(len(own) // DIRECTION_ROWS, -(-n_rows * len(own) // (len(sampled) * vector_block)))
        if cells > 1:
            centres[dim] = directions(own, cells, seed)
            visit[dim] = visits(own, centres[dim], k, coarse_recall)
    asked = distinct.where("ask")
    kind = rows.schema["vector"].dataType.simpleString()
    placed = candidates.unionAll(asked).mapInArrow(_place(centres, visit, seed), f"id long, vector {kind}, ask boolean, dim int, cell int, code binary, norm double, correction double")
    placed = cut(placed)
    sizes = placed.groupBy("dim", "cell").agg(F.count_if(~F.col("ask")).alias("n"), F.count_if("ask").alias("q")).where("n > 0 and q > 0")
    blocks = sizes.select("dim", "cell", F.ceil(F.col("n") / vector_block).cast("int").alias("v_blocks"), F.ceil(F.col("q") / query_block).cast("int").alias("q_blocks"))
    own = lambda salt, many: F.array(F.pmod(F.xxhash64("id", F.lit(salt)), F.col(many)).cast("int"))
    each = lambda many: F.sequence(F.lit(0), F.col(many) - 1)
    dealt = placed.join(blocks, ["dim", "cell"])
    dealt = dealt.withColumn("vb", F.explode(F.when(F.col("ask"), each("v_blocks")).otherwise(own(1, "v_blocks"))))
    dealt = dealt.withColumn("qb", F.explode(F.when(F.col("ask"), own(2, "q_blocks")).otherwise(each("q_blocks"))))
    found = dealt.select("id", "vector", "ask", "code", "norm", "correction", "dim", "cell", "vb", "qb").groupBy("dim", "cell", "vb", "qb").applyInArrow(_cell(k, bound, seed), RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
