"""Near-duplicates by the Jaccard similarity of their sets of word shingles, on operator 7's fingerprints and BK-trees.

Documents whose sets of ``shingle``-word shingles (lower-cased, as in ``simhash``) have a similarity of ``similarity`` or
more are linked; components of the links are near copies. Narrow fingerprints can't decide this: copies at 0.8 differ by
about 10 of 64 bits, with much spread, and bands of so wide a radius hold nearly all documents. So the shards are made
another way and the fingerprints are wider:

1. Shards: ``bands`` keys of ``width`` minima each, so a pair of similarity s shares no shard with probability
   (1 - s**width)**bands, 1.2e-7 at 0.8 and less above. Most documents share no shard with any other and are done.
2. Folding: in each round, up to three pairs for each document (against those members of its shards that come first: in
   the first round the members that share most shards, then by a hash) are checked on the whole sets. A round that leaves
   more than half of the pairs of different components is the last; rounds change the cost only, never the result.
3. Search: in shards that still hold several components, a BK-tree over SimHash fingerprints of ``WIDE`` bits finds all
   pairs of different components within a radius that a pair at the similarity exceeds with probability below 1e-6, each
   pair in the first shard that it shares; every pair found is checked on the whole sets, so no link is false. A shard's largest component asks nothing, and a hot shard
   is dealt into part trees and blocks of questions.

Defined cases: null and blank texts have one shingle, the empty one, and are linked to each other; a text of fewer words
is one shingle; a null identifier is larger than any other; of rows that repeat identifier and text one stays; an empty
table gives an empty table; ``deduplicate`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, components, cut, keep_rows, released
from millrace.llm.simhash import BKTree, spans, text_digest

#: Bits of the wide fingerprints. Pairs at 0.8 differ in 15 % of them or less (19 % for sets of 5), and a standard
#: deviation is 0.6 %; the radius lies five and a half above.
WIDE = 4096


def radius(n_shingles: int, similarity: float) -> float:
    """Bits in which a pair at the similarity differs, and five and a half standard deviations."""
    from math import acos, pi, sqrt

    share = acos(2 * similarity / (1 + similarity)) / pi
    if n_shingles < 8:  # few votes a bit: ties make more of them differ
        share *= 1.25
    return WIDE * share + 5.5 * sqrt(WIDE * share * (1 - share))


def _shingles(text: bytes, shingle: int, seed: int, np, digest):
    """The distinct 64-bit hashes of a text's shingles."""
    return np.unique(np.array([digest(s, seed) for s in spans(text, shingle, np) or [b""]], dtype="uint64"))


def _bands(shingle: int, bands: int, width: int, seed: int):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        rng = np.random.default_rng(seed)
        flip = rng.integers(0, 1 << 32, bands * width, dtype="uint32")
        factor = rng.integers(0, 1 << 32, bands * width, dtype="uint32") | np.uint32(1)
        for b in released(batches, 1000):
            digests, sizes, keys = [], [], []
            for t in b.column(1):
                text = t.as_py() or b""
                h = _shingles(text, shingle, seed, np, xxh64_intdigest)
                digests.append(hashlib.md5(text).digest())
                sizes.append(len(h))
                low, half = None, (h >> np.uint64(32)).astype("uint32")
                for k in range(0, len(half), 256):
                    part = ((half[k : k + 256, None] ^ flip) * factor).min(axis=0)
                    low = part if low is None else np.minimum(low, part)
                raw = low.tobytes()
                keys += [xxh64_intdigest(raw[4 * width * k : 4 * width * (k + 1)], k) for k in range(bands)]
            values = pa.array(np.array(keys, dtype="uint64").view("int64"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, bands, dtype="int32")), values)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), lists], names=["id", "digest", "n", "keys"])

    return run


def _wide(h, factors, np) -> bytes:
    """The majority bits of WIDE random bits for each shingle."""
    ones = np.zeros(WIDE, dtype="int64")
    for k in range(0, len(h), 512):
        x = (h[k : k + 512, None] ^ (h[k : k + 512, None] >> np.uint64(29))) * factors
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view("uint8"), axis=1).sum(axis=0, dtype="int64")
    return np.packbits(2 * ones > len(h)).tobytes()


def _sets(shingle: int, seed: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        factors = np.random.default_rng(seed + 1).integers(0, 1 << 63, WIDE // 64, dtype="uint64") * np.uint64(2) + np.uint64(1)
        for b in released(batches, 1000):
            found = [_shingles(t.as_py() or b"", shingle, seed, np, xxh64_intdigest) for t in b.column(1)]
            ends = np.cumsum([0, *map(len, found)]).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "uint64"), *found]).view("int64")))
            wide = pa.array([_wide(h, factors, np) for h in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), lists, wide], names=["digest", "hashes", "wide"])

    return run


def _search(similarity: float):
    """Pairs (a, b) of different components within the radius, of the shards of one cell."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("key")
        keys = table["key"].to_numpy()
        rows, n, root = (table[c].to_pylist() for c in ("row", "n", "root"))
        asks, other = table["ask"].to_pylist(), table["other"].to_pylist()
        wide = [int.from_bytes(x, "big") for x in table["wide"].to_pylist()]
        all_keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        ends = [*(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]

        def met_before(j: int, k: int) -> bool:
            """Whether a shard of an earlier band has both rows too, and so their pair."""
            return all_keys[j][(all_keys[j] == all_keys[k]).argmax()] != keys[k]

        pairs, start = set(), 0
        for end in ends:
            own: dict[int, list[int]] = {}
            for k in range(start, end):
                if not asks[k]:
                    own.setdefault(wide[k], []).append(k)
            tree = BKTree()
            for value in own:
                tree.add(value)
            for k in range(start, end):
                if asks[k]:
                    for at in tree.within(wide[k], int(radius(n[k], similarity))):
                        for j in own[tree.values[at]]:
                            if other[j] and rows[j] > rows[k]:
                                continue  # asks for itself, and finds this one
                            if root[j] != root[k] and min(n[j], n[k]) >= similarity * max(n[j], n[k]) and not met_before(j, k):
                                pairs.add((min(rows[j], rows[k]), max(rows[j], rows[k])))
            start = end
        a, b = zip(*sorted(pairs), strict=True) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float = 0.8, bands: int = 40, width: int = 5, seed: int = 42, most_rounds: int = 8, shard: int = 512) -> DataFrame:
    """A row for each document: id, digest of its text, row, head (id, digest and row of its component's first)."""
    bounded_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("binary")
    kind = docs.select(F.col(f"`{id_col}`").alias("id")).schema["id"].dataType.simpleString()
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    nodes = slim.mapInArrow(_bands(shingle, bands, width, seed), f"id {kind}, digest binary, n int, keys array<long>")
    nodes = cut(nodes.withColumn("row", F.monotonically_increasing_id()))
    keyed = nodes.select("row", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    buckets = cut(keyed.join(shared, "key"))
    busy = cut(buckets.groupBy("row").agg(F.sum("rows").alias("degree")))
    of = nodes.join(busy, "row", "left_semi").select("row", "digest")
    texts = slim.select(text_digest(F.col("text")).alias("digest"), "text").join(of.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    sets = cut(of.join(texts.mapInArrow(_sets(shingle, seed), "digest binary, hashes array<long>, wide binary"), "digest").select("row", "hashes", "wide"))

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of rows whose sets are similar enough."""
        left = sets.select(F.col("row").alias("a"), F.col("hashes").alias("x"))
        right = sets.select(F.col("row").alias("b"), F.col("hashes").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        both = pairs.join(left, "a").join(right, "b")
        return both.where(common / (F.size("x") + F.size("y") - common) >= similarity).select("a", "b")

    def alike(x: str, y: str) -> Column:
        return F.least(x, y) / F.greatest(x, y) >= similarity

    held = buckets.join(busy, "row").select("key", "row", "n", F.col("row").alias("root"), (-F.col("degree")).alias("first"))
    links, before = None, None
    for k in range(most_rounds):
        order = F.struct("first", F.xxhash64("row", F.lit(k)).alias("then"))
        pivot = F.struct(order.alias("o"), F.col("row").alias("b"), F.col("n").alias("m"), F.col("root").alias("to"))
        pivots = held.groupBy("key").agg(F.min(pivot).alias("p"))
        asked = held.join(pivots, "key").where((F.col("root") != F.col("p.to")) & alike("n", "p.m"))
        asked = asked.groupBy(F.col("row").alias("a")).agg(F.slice(F.array_sort(F.collect_set(F.struct("p.o", "p.b"))), 1, 3).alias("p")).select("a", F.explode("p.b").alias("b"))
        found = similar(asked)
        links = cut(found if links is None else links.unionAll(found))
        roots = components(links).withColumnRenamed("node", "row")
        led = buckets.select("key", "row", "n").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
        # shards that still hold more than one component, with their size and their largest component
        parts = led.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key")
        parts = parts.agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots"))
        held = cut(led.join(parts.where("roots > 1"), "key").withColumn("first", F.lit(0).cast("long")))
        pairs = held.agg(F.sum((F.col("s") - F.col("q") / F.col("s")) / 2)).first()[0] or 0
        if before is not None and pairs > before / 2:
            break
        before = pairs
    # trees hold all members of a shard; all but the members of its largest component ask
    trees, blocks = F.ceil(F.col("s") / shard).cast("int"), F.ceil((F.col("s") - F.col("top.c")) / shard).cast("int")
    cells = held.join(sets.select("row", "wide").join(nodes.select("row", "keys"), "row"), "row").withColumn("trees", trees).withColumn("blocks", blocks)
    own = lambda salt, of: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(of)).cast("int")
    upto = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    member = F.transform(upto("blocks"), lambda b: F.struct(own(1, "trees").alias("tree"), b.alias("block"), F.lit(False).alias("ask")))
    ask = F.transform(upto("trees"), lambda t: F.struct(t.alias("tree"), own(2, "blocks").alias("block"), F.lit(True).alias("ask")))
    roles = F.when(F.col("root") == F.col("top.root"), member).otherwise(F.concat(member, ask))
    n_cells = max(1, held.count() // (4 * shard))
    place = F.when(F.col("trees") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(n_cells)))
    cells = cells.select(place.alias("place"), "key", "row", "n", "root", "wide", "keys", (F.col("root") != F.col("top.root")).alias("other"), F.explode(roles).alias("r"))
    cells = cells.select("place", "key", "row", "n", "root", "wide", "keys", "other", "r.*")
    asked = cells.groupBy("place", "tree", "block").applyInArrow(_search(similarity), "a long, b long").distinct()
    roots = components(cut(links.unionAll(similar(asked)))).withColumnRenamed("node", "row")
    led = nodes.select("id", "digest", "row").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    heads = led.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "row")).alias("head"))
    return led.join(heads, "root").select("id", "digest", "row", "head")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that stay (one of each component, that with the smallest identifier), with all their columns."""
    firsts = classes(docs, id_col, text_col, **how).where("row = head.row")
    return keep_rows(docs, firsts.select("digest", "id"), text_digest(F.col(f"`{text_col}`")), id_col)
