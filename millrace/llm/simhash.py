"""SimHash near-duplicates through BK-trees.

Fingerprints of word shingles that differ in at most ``radius`` bits are linked. Equal fingerprints are first folded into
one. The 64 bits are cut into radius + 1 bands: two linked fingerprints agree in one band at least, so fingerprints are
sharded by band and band value and every link lies within a shard. Members of a shard differ only in the bits that are
left, so a shard larger than ``shard`` is cut again by radius + 1 bands of those, and so on until it is small: a third of
the bits goes each time (radius 2), so a fingerprint is copied a bounded number of times (at most 3 ** 6, as 9 bits
tell 512 apart), however many share a band. Shards are dealt into cells; the members of a cell form a BK-tree (children
keyed by their Hamming distance to the parent) in which a query follows only the edges whose key lies within the radius
of its own distance. A cell returns a spanning forest of its links, never all pairs; components of the links are found
by iterative star contraction.

Defined cases: null and blank texts have fingerprint zero, linked like any other; a null identifier is larger than any
other and is the component's identifier only where its whole component has none; repeated rows are separate documents;
an empty table gives an empty table; ``deduplicate`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, components, cut, keep_rows, table


def spans(text: bytes, shingle: int, np) -> list[bytes]:
    """The text's shingles in order, with repeats; a text of fewer words is one."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), dtype="int64", count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return [joined[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def _fingerprints(shingle: int, seed: int):
    def fingerprint(text: bytes, np, digest, bits) -> int:
        found = spans(text, shingle, np)
        if not found:
            return 0
        h = np.array([digest(s, seed) for s in found], dtype="<u8").view("uint8").reshape(-1, 8)
        if len(h) < 64:
            ones = np.unpackbits(h, axis=1, bitorder="little").sum(axis=0)
        else:
            ones = np.concatenate([np.bincount(h[:, k], minlength=256) @ bits for k in range(8)])
        return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        bits = np.unpackbits(np.arange(256, dtype="uint8")[:, None], axis=1, bitorder="little").astype("int64")
        for b in batches:
            prints = [fingerprint(t.as_py() or b"", np, xxh64_intdigest, bits) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(prints, dtype="uint64").view("int64")), *b.columns[2:]], names=["id", "fp", *b.schema.names[2:]])

    return run


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, seed: int = 42, digest: bool = False) -> DataFrame:
    """Rows (id, fp), with the text's digest if asked: the majority bits of XXH64 over lower-cased word shingles, as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)
    more = [text_digest(F.col(text_col)).alias("digest")] if digest else []
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *more)
    return slim.mapInArrow(_fingerprints(shingle, seed), "id long, fp long" + ", digest binary" * digest)


class BKTree:
    """Insert-only tree of distinct 64-bit numbers."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        while self.values:
            step = self.children[at].get(d := (self.values[at] ^ value).bit_count())
            if step is None:
                self.children[at][d] = len(self.values)
                break
            at = step
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most radius away."""
        if not self.values:
            return []
        found, todo, values, children = [], [0], self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = children[at]
            if len(kids) <= 2 * radius + 1:
                todo.extend([k for e, k in kids.items() if -radius <= e - d <= radius])
            else:
                for e in range(d - radius, d + radius + 1):
                    if e in kids:
                        todo.append(kids[e])
        return found


def _forest(values: list[int], radius: int):
    """Spanning forest of the links among 64-bit numbers, as rows (number, root) of signed numbers."""
    import numpy as np

    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in values:
        parent[x] = x
        for at in tree.within(x, radius):
            a, b = root(x), root(tree.values[at])
            parent[max(a, b)] = min(a, b)
        tree.add(x)
    links = [(x, root(x)) for x in parent if root(x) != x]
    return np.array(links, dtype="uint64").reshape(-1, 2).view("int64")


def cut_bits(mask: int, parts: int) -> list[int]:
    """What is left of the mask's bits when one of its parts (runs of its bits, in order) is taken away, for each part."""
    bits = [k for k in range(64) if mask >> k & 1]
    ends = [len(bits) * p // parts for p in range(parts + 1)]
    return [mask & ~sum(1 << k for k in bits[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = 2, shard: int = 512) -> DataFrame:
    """Rows (a, b) of distinct fingerprints whose components are those of all links within the radius."""
    spark, full = prints.sparkSession, (1 << 64) - 1
    open_, masks, shards, rows = prints.select("fp", F.lit(-1).cast("long").alias("mask")), [full], None, 0
    while masks:
        first = masks == [full]
        cuts = [(_signed(m), _signed(rest)) for m in masks for rest in cut_bits(m, radius + 1)]
        value = F.col("fp").bitwiseAND(F.bitwise_not("rest")).alias("value")
        if first:
            dealt = open_.select("fp", F.explode(F.array(*(F.lit(rest) for _, rest in cuts))).alias("rest"))
        else:
            dealt = open_.join(F.broadcast(spark.createDataFrame(cuts, "mask long, rest long")), "mask")
        keyed = dealt.select("fp", F.col("rest").alias("mask"), value)
        if not first:
            keyed = keyed.distinct()  # two ways of cutting may leave the same bits
        sizes = keyed.groupBy("mask", "value").count()
        # the members of a shard differ in bits of its mask only: no more of them than radius, and all are linked anyway
        hot = cut(sizes.where((F.col("count") > shard) & (F.bit_count("mask") > radius)))
        n_hot, masks = hot.agg(F.sum("count"), F.collect_set("mask")).first()
        masks = sorted(m % (1 << 64) for m in masks)
        rows += (radius + 1) * open_.count() - (n_hot or 0)
        done = (keyed.join(hot, ["mask", "value"], "left_anti") if masks else keyed).select("fp", "mask", "value")
        shards = done if shards is None else shards.unionAll(done)
        if masks:
            open_ = cut(keyed.join(hot, ["mask", "value"], "left_semi").select("fp", "mask"))
    cells = max(1, rows // (shard // 2))

    def run(pdf):
        import pandas as pd

        found = _forest([x % (1 << 64) for x in pdf["fp"].unique().tolist()], radius)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    cell = F.pmod(F.xxhash64("mask", "value"), F.lit(cells)).alias("cell")
    return shards.select("fp", cell).groupBy("cell").applyInPandas(run, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, seed: int = 42, radius: int = 2, digest: bool = False) -> DataFrame:
    """A row for each document: id, row, fp, component (smallest identifier that its fingerprint reaches), first (bool), and its text's digest if asked."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle=shingle, seed=seed, digest=digest).withColumn("row", F.monotonically_increasing_id()))
    by_print = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("low"))
    by_print = cut(by_print)
    roots = components(links(by_print.select("fp"), radius))
    # only fingerprints with a partner move; the others are their own component
    led = by_print.join(roots, by_print["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    heads = led.groupBy("root").agg(F.min("low").alias("head"))
    led = led.join(heads, "root").select("fp", "head")
    return prints.join(led, "fp").select("id", "row", "fp", F.col("head.id").alias("component"), (F.col("row") == F.col("head.row")).alias("first"), *["digest"] * digest)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """The documents that stay (one of each component, that with the smallest identifier), with all their columns."""
    found = classes(docs, id_col, text_col, shingle=shingle, seed=seed, radius=radius, digest=True)
    return keep_rows(docs, found.where("first").select("digest", "id"), text_digest(F.col(f"`{text_col}`")), id_col)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
