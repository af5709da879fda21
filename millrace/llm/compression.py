"""Quality rules: compression bands over whole documents and fixed chunks, beside counts of words, signs and repeats.

A text's ratio is its bytes over those of its zstandard frame. Repetitive text compresses far better than prose of its
length, text without structure (keys, encoded data, random letters) far worse. Ratios of prose grow with the length, so
the band of a whole document is interpolated between knots of log2(bytes). Chunks of ``chunk_bytes`` bytes all have one
length, hence one band: text that is repetitive or random within itself shows in each of them, however long the
document is. A document is rejected if its ratio is outside the band of its length, or if at least ``most_outside`` of its
whole chunks are outside theirs. A verdict depends on the text alone.

The default bands lie a little beyond the ratios of clean prose in the Latin alphabet (in UTF-8). Legal boilerplate and
tables repeat themselves more, and scripts of two or three bytes a letter have other ratios; ``fitted`` gives their bands.

Defined cases: a null text counts as empty; an empty text has ratio 0 and is outside every band; texts shorter than the
first knot or longer than the last have that knot's band; texts without a whole chunk are judged as a whole only; null
identifiers are kept; repeated rows are rows like others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """(log2 of bytes, least ratio, most ratio) of whole documents, ascending; the same of chunks; zstandard's level."""

    whole: tuple[tuple[float, float, float], ...] = ((8, 1.15, 1.75), (9, 1.25, 1.92), (10, 1.35, 2.08), (11, 1.45, 2.21), (12, 1.55, 2.33), (13, 1.60, 2.43), (14, 1.65, 2.52), (15, 1.70, 2.61), (17, 1.75, 2.80), (20, 1.80, 3.20))
    chunk: tuple[float, float] = (1.2, 2.0)
    chunk_bytes: int = 1024
    most_outside: float = 0.5
    level: int = 3


def counts(text: bytes, np) -> tuple[int, int, int, int, int]:
    """COUNTS of a text in UTF-8; words are runs of bytes other than ASCII white space."""
    words = text.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(text, dtype="uint8"), minlength=256) if text else np.zeros(256, dtype="int64")
    code_points = len(text) - int(hist[128:192].sum())
    white = int(hist[9:14].sum() + hist[32])
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        known: dict[bytes, int] = {}
        codes = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype="int64", count=n)
        pairs = np.unique(codes[:-1] * n + codes[1:], return_inverse=True)[1]
        _, window, times = np.unique(pairs[:-1] * n + codes[2:], return_inverse=True, return_counts=True)
        again = times[window] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeated = int(covered.sum())
    return n, code_points - white, sum(int(hist[c]) for c in SYMBOLS), len(lines) - len(set(lines)), repeated


def ratios(text: bytes, compress, bands: Bands) -> tuple[float, int, int]:
    """(ratio of the whole text, number of whole chunks, those outside their band)."""
    if not text:
        return 0.0, 0, 0
    size, view = bands.chunk_bytes, memoryview(text)
    low, high = size / bands.chunk[1], size / bands.chunk[0]
    n = len(text) // size
    outside = sum(not low <= len(compress(view[k * size : (k + 1) * size])) <= high for k in range(n))
    return len(text) / len(compress(text)), n, outside


def _measured(bands: Bands):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        knots = np.array(bands.whole, dtype="float64")
        for b in batches:
            rows, sizes = [], []
            for t in b.column(1):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                rows.append((*counts(text, np), *ratios(text, compress, bands)))
                sizes.append(len(text))
            x = np.log2(np.maximum(1, np.array(sizes, dtype="float64")))
            limits = [np.interp(x, knots[:, 0], knots[:, k]) for k in (1, 2)]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *(pa.array(y) for y in (*limits, x))], names=["id", *COUNTS, "ratio", "n_chunks", "n_outside", "least_ratio", "most_ratio", "log2_bytes"])

    return run


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bands: Bands = Bands()) -> DataFrame:  # noqa: B008
    """A row for each document: id, COUNTS, ratio, its band (least_ratio, most_ratio), log2_bytes, n_chunks, n_outside, and in_band, the verdict."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", ratio double, n_chunks long, n_outside long, least_ratio double, most_ratio double, log2_bytes double"
    whole = F.col("ratio").between(F.col("least_ratio"), F.col("most_ratio"))
    chunks = (F.col("n_chunks") == 0) | (F.col("n_outside") < bands.most_outside * F.col("n_chunks"))
    return slim.mapInArrow(_measured(bands), schema).withColumn("in_band", whole & chunks)


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, share: float = 0.001, margin: float = 0.05, bands: Bands = Bands()) -> Bands:  # noqa: B008
    """Bands of another kind of text, from clean rows of it: a knot for each octave of lengths that occurs.

    A knot's limits are the quantiles share and 1 - share of the ratios in the octave that it opens, moved out by
    ``margin`` of themselves. One row for each octave comes to the driver. Without rows, the given bands.
    """
    m = measure(docs, id_col, text_col, bands=bands).where("ratio > 0").select("ratio", F.floor("log2_bytes").alias("octave"))
    at = F.percentile_approx("ratio", [share, 1 - share], 10_000)
    rows = m.groupBy("octave").agg(at.alias("q")).orderBy("octave").collect()
    knots = tuple((float(r["octave"]), r["q"][0] * (1 - margin), r["q"][1] * (1 + margin)) for r in rows)
    return replace(bands, whole=knots) if knots else bands


def op13_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measure(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.select(F.col("id").alias("doc_id"), *COUNTS, failed.alias("base_failed"), (~failed & F.col("in_band")).alias("kept"), "ratio", "n_chunks", "n_outside")
