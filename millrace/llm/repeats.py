"""Periodic runs of words: all maximal repetitions of a text, by the runs theorem (Bannai et al. 2017).

A run is a stretch of words with a smallest period q, at least ``least_exponent`` times as long, that no neighbouring
word extends. The theorem: under one of the two orders of the words (the usual and the inverted one), every place of a
run where its Lyndon root starts has that root as the longest Lyndon word that starts there. The longest Lyndon word at a
place ends at the next smaller value of the inverse suffix array, so two passes over such arrays give all roots. Each is
extended to the right by the longest common prefix of two suffixes, and to the left by that of two reversed prefixes; both
are minima of ranges of an LCP array, looked up in a sparse table. What is long enough and distinct is a run.

Words that a text has fewer than ``least_exponent`` times lie in no run, nor extend one. So they cut a text into stretches,
and the same rule cuts these again; the method works on what is left, many stretches of many texts at once (with symbols
of their own and ends that are smaller than any word). Each text is worked on whole, in one task: time is
n log n in a stretch of n words, memory about 8 n log2 n bytes (160 MB for a stretch of a million words).

Defined cases: a null text has no words; a null identifier is kept; empty texts and repeated rows are rows like others;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, table

RUN = "struct<start:long,length:long,period:long>"
#: Words of the stretches that are worked on at once; a longer stretch is worked on alone.
CHUNK = 1 << 18


def suffix_order(symbols, np):
    """(sa, isa, levels): the suffix array, its inverse, and the ranks by the first 1, 2, 4, ... symbols."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype("int64")
    levels, step = [rank.astype("int32")], 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        rank = np.empty(n, dtype="int64")
        rank[sa] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[sa[-1]] == n - 1:
            return sa, rank, levels
        levels.append(rank.astype("int32"))
        step *= 2


class CommonPrefix:
    """Longest common prefixes of suffixes: the LCP array of neighbours in the suffix array, with a sparse table of range minima."""

    def __init__(self, symbols, np):
        self.np = np
        sa, self.isa, levels = suffix_order(symbols, np)
        n = len(sa)
        a, b = sa[:-1].copy(), sa[1:].copy()
        lcp = np.zeros(n, dtype="int32")
        for k in range(len(levels) - 1, -1, -1):
            both = np.flatnonzero((a < n) & (b < n))
            same = both[levels[k][a[both]] == levels[k][b[both]]]
            a[same] += 1 << k
            b[same] += 1 << k
            lcp[same + 1] += 1 << k
        self.rows = [lcp]
        while 2 << (len(self.rows) - 1) <= n:
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, i, j):
        """For arrays of places i != j."""
        np = self.np
        x, y = self.isa[i], self.isa[j]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        out = np.zeros(len(low), dtype="int64")
        width = np.frexp((high - low).astype("float64"))[1] - 1
        for k in np.unique(width):
            at = np.flatnonzero(width == k)
            row = self.rows[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


def next_smaller(values: list[int]) -> list[int]:
    """For each place the next one with a smaller value, or the length."""
    out, open_places = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while open_places and values[open_places[-1]] > v:
            out[open_places.pop()] = i
        open_places.append(i)
    return out


def runs_of(stretches, codes, np, least_length: int, least_exponent: int):
    """(start, length, period) of all runs in words that are given by their stretch (ascending) and code within it."""
    n, n_stretches = len(codes), int(stretches[-1]) + 1
    most = np.zeros(n_stretches, dtype="int64")
    np.maximum.at(most, stretches, codes)
    base = np.concatenate([[0], np.cumsum(most + 2)])
    # an end, smaller than the words of its stretch, follows each stretch
    place = np.arange(n) + stretches
    total = n + n_stretches
    first = np.empty(total, dtype="int64")
    ends = np.ones(total, dtype=bool)
    ends[place] = False
    first[ends] = base[:-1]
    other = first.copy()
    first[place] = base[stretches] + 1 + codes
    other[place] = base[stretches] + 1 + most[stretches] - codes
    forward, backward = CommonPrefix(first, np), CommonPrefix(first[::-1], np)
    found = []
    for isa in (forward.isa, suffix_order(other, np)[1]):
        after = np.array(next_smaller(isa.tolist()), dtype="int64")
        i = place
        j = after[i]
        p = j - i
        right, left = np.zeros(n, dtype="int64"), np.zeros(n, dtype="int64")
        inner = np.flatnonzero(j < total)
        right[inner] = forward.of(i[inner], j[inner])
        inner = np.flatnonzero(i > 0)
        left[inner] = backward.of(total - i[inner], total - j[inner])
        long_enough = left + p + right >= np.maximum(least_length, least_exponent * p)
        found.append(np.stack([(i - left)[long_enough], (left + p + right)[long_enough], p[long_enough]], axis=1))
    out = np.unique(np.concatenate(found), axis=0)
    # back to places without ends
    out[:, 0] -= np.cumsum(ends)[out[:, 0]]
    return out


def find_runs(texts, np, least_length: int = 6, least_exponent: int = 4):
    """(text, start, length, period) of all runs in texts, each an array of codes of words; sorted."""
    none = np.zeros((0, 4), dtype="int64")
    kept = []
    for t, codes in enumerate(texts):
        if len(codes) >= least_length:
            at = np.flatnonzero(np.bincount(codes)[codes] >= least_exponent)
            if len(at) >= least_length:
                kept.append((np.full(len(at), t), at, codes[at]))
    if not kept:
        return none
    text, at, code = (np.concatenate(x).astype("int64") for x in zip(*kept, strict=True))
    while True:
        new = np.ones(len(at), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
        stretch = np.cumsum(new) - 1
        pair, code, counts = np.unique(stretch * (code.max(initial=0) + 1) + code, return_inverse=True, return_counts=True)
        stays = (counts[code] >= least_exponent) & (np.bincount(stretch)[stretch] >= least_length)
        if stays.all():
            break
        text, at, code = text[stays], at[stays], code[stays]
        if not len(at):
            return none
    starts = np.flatnonzero(new)
    # codes count from 0 in each stretch, as pairs are sorted by stretch
    code = code - np.minimum.reduceat(code, starts)[stretch]
    out, a = [], 0
    while a < len(starts):
        z = max(a + 1, int(np.searchsorted(starts, starts[a] + CHUNK)))
        low, high = starts[a], starts[z] if z < len(starts) else len(at)
        r = runs_of(stretch[low:high] - a, code[low:high], np, least_length, least_exponent)
        where = r[:, 0] + low
        out.append(np.stack([text[where], at[where], r[:, 1], r[:, 2]], axis=1))
        a = z
    out = np.concatenate(out)
    return out[np.lexsort(out[:, [3, 1, 0]].T[[0, 1, 2]])]


def _repeats(least_length: int, least_exponent: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            words, codes = [], []
            for t in b.column(1):
                w = t.as_buffer().to_pybytes().split() if t.is_valid else []
                known: dict[bytes, int] = {}
                words.append(w)
                codes.append(np.fromiter((known.setdefault(x, len(known)) for x in w), dtype="int64", count=len(w)))
            found = find_runs(codes, np, least_length, least_exponent)
            ends = np.searchsorted(found[:, 0], np.arange(len(words) + 1))
            kept = []
            for k, w in enumerate(words):
                mine = found[ends[k] : ends[k + 1]]
                if len(mine):
                    depth = np.zeros(len(w) + 1, dtype="int64")
                    np.add.at(depth, mine[:, 1] + mine[:, 3], 1)
                    np.add.at(depth, mine[:, 1] + mine[:, 2], -1)
                    w = [w[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
                kept.append(b" ".join(w))
            runs = pa.StructArray.from_arrays([pa.array(found[:, c].copy()) for c in (1, 2, 3)], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)
            sizes = pa.array([len(w) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, lists.cast(kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """A row for each document: id, n_words, runs (start, length, period by start, then period) and collapsed.

    collapsed has the words, joined by single blanks, without those that a run contains after its first period.
    """
    if least_exponent < 2:
        raise ValueError("a run is at least two periods long")
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(_repeats(least_length, least_exponent), f"id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact ratio of length to period; of equals the first."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, x: F.when(better(best, x), x).otherwise(best))


def spelled(runs: Column) -> Column:
    """start,length,period and a line feed, for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_planted_period(text: Column, identifier: Column) -> Column:
    """The query's texts: of identifiers whose hash is divisible by ten, the words from a certain one on repeat periodically."""
    h = F.crc32(identifier.cast("string"))
    g = F.floor(h / 10)  # below 2 ** 32, so exact

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " ")

    # the array of one binds the words, which would be found again for each word else
    words = F.array(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    return F.when(h % 10 == 0, F.get(F.transform(words, planted), F.lit(0))).otherwise(text)


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    out = repeats(docs).select("id", "runs", "collapsed", strongest(F.col("runs")).alias("best"))
    best = F.col("best")
    return out.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(spelled(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
