"""Packing of documents into fixed windows by best-fit decreasing.

A document is its token ids and one end mark. Overlong documents are first cut into full windows. What is left of each
document waits in a bounded buffer; a full buffer (and the end of a partition) is packed: rests by decreasing length,
each into the tightest open window, which a segment tree over the remaining capacities finds. Last, the emptiest windows
of a buffer are cut up to close the gaps of the fullest ones, and the tokens of the one window that stays open are
spelled out in windows of a power of two, which need no padding. Nothing is shuffled: a buffer lies within one
partition, holds at most ``buffer_tokens`` and is reproduced exactly when its task runs again.

Defined cases: a null text counts as empty (its only id is the end mark); a null identifier is kept; repeated rows are
packed as separate documents; columns other than identifier and text are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, released, table
from millrace.llm.tokens import VOCABULARY, encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Segment tree over remaining capacities 0 to size: how many open windows have each, and the least one that fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) with the smallest capacity that is not below least."""
        i, count = self.leaves + least, self.count
        if not count[i]:
            while not (i & 1 == 0 and count[i + 1]):
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Windows as lists of positions in lengths (each at most size); ties keep their order."""
    tree, windows = CapacityTree(size), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[k])
        if found is None:
            found = size, len(windows)
            windows.append([])
        windows[found[1]].append(k)
        if found[0] > lengths[k]:
            tree.add(found[0] - lengths[k], found[1])
    return windows


def close_gaps(windows: list[list[list[int]]], size: int) -> list[list[list[int]]]:
    """Pieces [document, start, length]: the emptiest windows are cut up until at most one window has a gap."""
    used = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda k: -used[k])
    i, j = 0, len(order) - 1
    while i < j:
        a, b = order[i], order[j]
        if used[a] == size:
            i += 1
        elif not windows[b]:
            j -= 1
        else:
            doc, start, length = windows[b][-1]
            n = min(length, size - used[a])
            windows[a].append([doc, start, n])
            used[a] += n
            used[b] -= n
            windows[b].pop()
            if n < length:
                windows[b].append([doc, start + n, length - n])
    out = []
    for w in windows:
        total = sum(p[2] for p in w)
        if not total:
            continue
        if total == size:
            out.append(w)
            continue
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            part, need = [], 1 << bit
            while need:
                doc, start, length = w.pop()
                n = min(length, need)
                part.append([doc, start, n])
                if n < length:
                    w.append([doc, start + n, length - n])
                need -= n
            out.append(part)
    return out


def _pack(size: int, end: int, vocabulary: str, buffer_tokens: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        encode = encoder(vocabulary).encode_many
        waiting, held = [], 0  # [identifier, start, ids, tokens of the document]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def packed():
            nonlocal sequence, waiting, held
            lengths = [len(w[2]) for w in waiting]
            windows = [[[k, 0, lengths[k]] for k in w] for w in best_fit_decreasing(lengths, size)]
            rows = []
            for w in close_gaps(windows, size):
                offset = 0
                for k, start, length in w:
                    doc, base, ids, total = waiting[k]
                    rows.append((doc, base + start, length, ids[start : start + length].tobytes(), total, sequence, offset))
                    offset += length
                sequence += 1
            waiting, held = [], 0
            for i in range(0, len(rows), 4096):
                yield batch(rows[i : i + 4096])

        for b in released(batches):
            docs, texts = b.column(0).to_pylist(), b.column(1)
            at = 0
            while at < len(docs):
                n, chars = 0, 0
                while at + n < len(docs) and (not n or chars < 1_000_000):  # a step holds about 1 MB of text
                    chars += len(texts[at + n].as_buffer() or b"") if texts[at + n].is_valid else 0
                    n += 1
                ids, offsets = encode(texts.slice(at, n))
                rows = []
                for k in range(n):
                    own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end)).astype("<u4")
                    full = len(own) // size * size
                    for start in range(0, full, size):
                        rows.append((docs[at + k], start, size, own[start : start + size].tobytes(), len(own), sequence, 0))
                        sequence += 1
                    if full < len(own):
                        waiting.append((docs[at + k], full, own[full:].copy(), len(own)))
                        held += len(own) - full
                if rows:
                    yield batch(rows)
                if held >= buffer_tokens:
                    yield from packed()
                at += n
        if waiting:
            yield from packed()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 2048, end: int = 1, vocabulary: str = VOCABULARY, buffer_tokens: int = 2_000_000) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids are packed little-endian unsigned 32-bit."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pack(size, end, vocabulary, buffer_tokens), SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(pack(table(spark, sf_dir, "documents")))


def digest_columns(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
