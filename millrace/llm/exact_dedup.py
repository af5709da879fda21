"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition sorts its records (digest, length, check; smallest identifier, its row, number of rows) into runs with one
record for each digest. In rounds, the runs of a block of neighbouring partitions exchange segments: each run is cut at
the borders of the block's digest ranges, and the owner of a range merges the sorted segments that it gets, retaining the
smallest identifier of equal records. After round r a run holds 1 / fan_in**r of the digests of fan_in**r partitions, so
runs keep their size, and a digest that a third of all rows carry is one record of each run. Records are one group only
where SHA-256, the length in bytes and an independent 64-bit hash agree. Documents find their group by an equi-join.

Defined cases: a null text counts as empty; a null identifier is larger than any other and stays only where its whole
group has none; of rows that repeat an identifier exactly one stays; an empty table gives an empty table; columns of
the input other than the identifier and the text pass through untouched in ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import WHITE, cut, keep_rows, table

KEY = ("digest", "n_bytes", "check")
#: SHA-256, length and a 64-bit hash.
KEY_BYTES = 48
SEGMENT = ["owner", "keys", "ids", "rows", "sizes"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A slim row for each document, kept in the shared folder: key columns, identifier and a row number."""
    t = normalised(F.col(text_col))
    slim = docs.select(F.col(id_col).alias("id"), t.alias("t")).select("id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"), F.xxhash64("t").alias("check"))
    return cut(slim.withColumn("row", F.monotonically_increasing_id()))


def _verified(keys, none, ids, rows, sizes):
    """Sorted runs put one after another, as one run with one record for each key: its smallest (none, id, row) and all its rows.

    The stable sort takes the sorted stretches that it finds and merges them.
    """
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.nonzero(new)[0]
    counts = np.diff([*starts, len(keys)])
    best = order[starts]
    for g in np.nonzero(counts > 1)[0]:
        best[g] = min(order[starts[g] : starts[g] + counts[g]], key=lambda k: (none[k], ids[k], rows[k]))
    return keys[starts], none[best], [ids[k] for k in best], rows[best], np.add.reduceat(sizes[order], starts) if len(starts) else sizes[:0]


def _segments(run, block: int, span: int, id_type):
    """A sorted run cut at the borders of ``span`` ranges of digests; the part of range r goes to run block + r."""
    import numpy as np
    import pyarrow as pa

    keys, none, ids, rows, sizes = run
    first = keys.view("uint8").reshape(-1, KEY_BYTES)[:, :4].copy().view(">u4").ravel().astype("uint64")
    ends = np.searchsorted((first * np.uint64(span)) >> np.uint64(32), np.arange(span + 1))
    parts = [(block + r, a, z) for r, (a, z) in enumerate(zip(ends, ends[1:], strict=False)) if a < z]
    lists = lambda values, kind: pa.array([values[a:z] for _, a, z in parts], pa.list_(kind))
    ids = [None if x else i for x, i in zip(none, ids, strict=True)]
    return [pa.array([r for r, _, _ in parts], pa.int64()), pa.array([keys[a:z].tobytes() for _, a, z in parts], pa.binary()), lists(ids, id_type), lists(rows, pa.int64()), lists(sizes, pa.int64())]


def _opened(table):
    """(keys, none, ids, rows, sizes) of the segments in a table, one after another."""
    import numpy as np

    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), dtype=f"V{KEY_BYTES}")
    ids = [i for part in table["ids"].to_pylist() for i in part]
    none = np.array([i is None for i in ids], dtype=bool)
    zero = "" if any(isinstance(i, str) for i in ids) else 0
    numbers = [np.concatenate([np.zeros(0, "int64"), *(np.array(x, dtype="int64") for x in table[c].to_pylist())]) for c in ("rows", "sizes")]
    return keys, none, [zero if i is None else i for i in ids], *numbers


def _leaf(span: int, run_rows: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        held: list = []

        def sorted_run():
            t = pa.Table.from_batches(held)
            raw = [np.frombuffer(b"".join(t["digest"].to_pylist()), dtype="uint8").reshape(-1, 32)]
            raw += [t[c].to_numpy().astype(">i8").view("uint8").reshape(-1, 8) for c in ("n_bytes", "check")]
            keys = np.ascontiguousarray(np.concatenate(raw, axis=1)).view(f"V{KEY_BYTES}").ravel()
            none = np.array(t["id"].is_null().to_numpy(), dtype=bool)
            ids = t["id"].to_pylist()
            zero = "" if pa.types.is_string(t["id"].type) else 0
            merged = _verified(keys, none, [zero if i is None else i for i in ids], t["row"].to_numpy(), np.ones(len(keys), dtype="int64"))
            held.clear()
            return pa.RecordBatch.from_arrays(_segments(merged, own // span * span, span, t["id"].type), names=SEGMENT)

        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= run_rows:
                yield sorted_run()
                n = 0
        if n:
            yield sorted_run()

    return run


def _round(span: int, last: bool):
    def run(key, table):
        import pyarrow as pa

        owner = key[0].as_py()
        kind = table["ids"].type.value_type
        merged = _verified(*_opened(table))
        if not last:
            return pa.Table.from_arrays(_segments(merged, owner // span * span, span, kind), names=SEGMENT)
        keys, none, ids, rows, sizes = merged
        raw = keys.view("uint8").reshape(-1, KEY_BYTES)
        number = lambda at: pa.array(raw[:, at : at + 8].copy().view(">i8").ravel().astype("int64"))
        firsts = pa.array([None if x else i for x, i in zip(none, ids, strict=True)], kind)
        return pa.Table.from_arrays([pa.array([x.tobytes() for x in raw[:, :32]], pa.binary()), number(32), number(40), firsts, pa.array(rows), pa.array(sizes)], names=[*KEY, "first_id", "first_row", "size"])

    return run


def merge_runs(slim: DataFrame, fan_in: int = 16, run_rows: int = 1 << 18) -> DataFrame:
    """A row for each digest: key columns, first_id and first_row (smallest identifier and its row), size.

    Each partition sorts its records into runs of ``run_rows`` rows at most. In round r the runs of a block of
    ``fan_in`` ** r partitions send the parts of their digest ranges to the range's owner in the block, as whole sorted
    segments, and the owner merges them. So a task holds about one run in each round, and nothing gathers in one root.
    """
    kind = slim.schema["id"].dataType.simpleString()
    segment = f"owner long, keys binary, ids array<{kind}>, rows array<long>, sizes array<long>"
    spans = [fan_in]
    while spans[-1] < slim.rdd.getNumPartitions():
        spans.append(spans[-1] * fan_in)
    runs = slim.select("id", *KEY, "row").mapInArrow(_leaf(spans[0], run_rows), segment)
    merged = f"digest binary, n_bytes long, check long, first_id {kind}, first_row long, size long"
    for k in range(len(spans)):
        last = k + 1 == len(spans)
        runs = runs.groupBy("owner").applyInArrow(_round(spans[min(k + 1, len(spans) - 1)], last), merged if last else segment)
    return runs


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, keep_id, group_size, kept, digest."""
    slim = digests(docs, id_col, text_col)
    merged = merge_runs(slim)
    return slim.join(merged, list(KEY)).select("id", F.col("first_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("first_row")).alias("kept"), "digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    The keys that stay are joined back; of rows that repeat both identifier and text one stays.
    """
    kept = groups(docs, id_col, text_col).where("kept").select("digest", "id")
    return keep_rows(docs, kept, F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)), id_col)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
