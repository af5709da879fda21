"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees over the statistics of a bounded sample of labelled documents are fitted on the driver; every path
from a root to a node is a rule (a conjunction of thresholds). A logistic model with a lasso penalty weighs the rules
and most weights vanish. What is left is compiled into one Spark column expression over the statistics' columns, so
scoring is a projection without joins.

Only labelled rows of the learning part (a condition on the row) enter the sample, by the smallest hash of their
identifier up to ``most_samples``; labels, language, source and identifier are never statistics.

Defined cases: a null text counts as empty, and empty texts are scored like any other; a document with several labels
takes the smallest; null labels are ignored; with no labelled rows every score is 0.5, with one label only it is near
that label; repeated rows are scored alike; an empty table gives an empty table; columns of the input pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bounded_batches, released, table

#: Statistics of whole texts, in this order; shares are of characters (in UTF-8 bytes) or of words.
STATISTICS = ("log_chars", "log_words", "log_lines", "upper", "digit", "sign", "blank", "beyond_ascii", "sentence_ends", "word_length", "long_words", "distinct_words", "top_word", "words_with_sign", "short_lines", "repeated_lines")


def _statistics(text: bytes, np) -> list[float]:
    hist = np.bincount(np.frombuffer(text, dtype="uint8"), minlength=256) if text else np.zeros(256, dtype="int64")
    words, lines = text.split(), text.split(b"\n")
    n, w = max(1, len(text)), max(1, len(words))
    upper, lower, digit = int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[48:58].sum())
    blank, beyond = int(hist[9:14].sum() + hist[32]), int(hist[128:].sum())
    counts: dict[bytes, int] = {}
    long_words = 0
    for x in words:
        counts[x] = counts.get(x, 0) + 1
        long_words += len(x) > 12
    ends = text.count(b". ") + text.count(b".\n") + text.count(b"! ") + text.count(b"? ") + text.endswith((b".", b"!", b"?"))
    signed = sum(c for x, c in counts.items() if not x[-1:].isalnum() and x[-1] < 128 or not x[:1].isalnum() and x[0] < 128)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), upper / max(1, upper + lower), digit / n, (len(text) - upper - lower - digit - blank - beyond) / n,
        blank / n, beyond / n, ends / w, (len(text) - blank) / w, long_words / w, len(counts) / w, max(counts.values(), default=0) / w, signed / w,
        sum(len(x) < 30 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines),
    ]


def _with_statistics(place: int, kept: int, prefix: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in released(batches):
            texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(place))
            rows = np.array([_statistics(t, np) for t in texts], dtype="float64").reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *(pa.array(rows[:, k].copy()) for k in range(len(STATISTICS)))], names=[*b.schema.names[:kept], *(f"{prefix}{s}" for s in STATISTICS)])

    return run


def free_prefix(names: list[str]) -> str:
    """Underscores that no name starts with, two at least."""
    prefix = "__"
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix


def statistics(docs: DataFrame, text_col: str, keep: list[str], prefix: str = "__") -> DataFrame:
    """The columns to keep and one column <prefix><statistic> each."""
    bounded_batches(docs.sparkSession)
    fields = {f.name: f for f in docs.schema}
    columns = [*keep, *([] if text_col in keep else [text_col])]
    text = F.col(f"`{text_col}`").cast("string").alias(text_col)
    kinds = [T.StructField(c, T.StringType() if c == text_col else fields[c].dataType) for c in keep]
    schema = T.StructType([*kinds, *(T.StructField(f"{prefix}{s}", T.DoubleType()) for s in STATISTICS)])
    return docs.select(*(text if c == text_col else F.col(f"`{c}`") for c in columns)).mapInArrow(_with_statistics(columns.index(text_col), len(keep), prefix), schema)


class Rules:
    """Rules as lists of (statistic, is_above, threshold), their weights, and the intercept."""

    def __init__(self, rules: list[list[tuple[int, bool, float]]], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def column(self, prefix: str = "__") -> Column:
        """The score as an expression over the statistics' columns."""
        stat = lambda k: F.col(f"{prefix}{STATISTICS[k]}")
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for k, above, threshold in rule:
                part = stat(k) > F.lit(threshold) if above else stat(k) <= F.lit(threshold)
                holds = part if holds is None else holds & part
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def matrix(self, x):
        import numpy as np

        out = np.ones((len(x), len(self.rules)), dtype="float64")
        for j, rule in enumerate(self.rules):
            for k, above, threshold in rule:
                out[:, j] *= (x[:, k] > threshold) if above else (x[:, k] <= threshold)
        return out


def _paths(x, residual, bins, depth: int, least: int) -> tuple[list, list]:
    """All paths of one least-squares tree over binned statistics, and those among them that end in a leaf."""
    import numpy as np

    paths, leaves = [], []

    def grow(rows, path):
        if path:
            paths.append(path)
        best = (1e-9, None, None)
        if len(path) < depth and len(rows) >= 2 * least:
            total, r = residual[rows].sum(), residual[rows]
            base = total * total / len(rows)
            for k, edges in enumerate(bins):
                at = np.searchsorted(edges, x[rows, k], "left")
                n = np.bincount(at, minlength=len(edges) + 1).cumsum()[:-1]
                s = np.bincount(at, weights=r, minlength=len(edges) + 1).cumsum()[:-1]
                ok = (n >= least) & (len(rows) - n >= least)
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1) - base, -1)
                if len(gain) and gain.max() > best[0]:
                    best = gain.max(), k, float(edges[gain.argmax()])
        if best[1] is None:
            leaves.append(path)
            return
        _, k, edge = best
        low = x[rows, k] <= edge
        grow(rows[low], [*path, (k, False, edge)])
        grow(rows[~low], [*path, (k, True, edge)])

    grow(np.arange(len(x)), [])
    return paths, leaves


def fit_rules(x, y, *, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 2e-3, steps: int = 400, seed: int = 5) -> Rules:
    """Boosted trees for rules, then lasso logistic weights by accelerated proximal gradient steps."""
    import numpy as np

    if not len(y):
        return Rules([], [], 0.0)
    share = min(max(float(y.mean()), 1 / (len(y) + 2)), 1 - 1 / (len(y) + 2))
    start = float(np.log(share / (1 - share)))
    if share in (1 / (len(y) + 2), 1 - 1 / (len(y) + 2)) or len(y) < 20:
        return Rules([], [], start)
    bins = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1])) for k in range(x.shape[1])]
    rng, f, rules = np.random.default_rng(seed), np.full(len(y), start), {}
    for _ in range(trees):
        rows = np.sort(rng.permutation(len(y))[: max(20, len(y) // 2)])
        residual = y - 1 / (1 + np.exp(-f))
        paths, leaves = _paths(x[rows], residual[rows], bins, depth, max(5, len(rows) // 400))
        hold = Rules(leaves, [], 0.0).matrix(x)
        for j in range(hold.shape[1]):
            own = hold[:, j] > 0
            p = 1 / (1 + np.exp(-f[own]))
            f[own] += rate * float(np.clip((y[own] - p).sum() / ((p * (1 - p)).sum() + 1), -4, 4))
        rules |= dict.fromkeys(tuple(sorted(p)) for p in paths)
    kept = [list(r) for r in rules]
    m = Rules(kept, [], 0.0).matrix(x)
    weights, b = np.zeros(len(kept)), start
    mean, size = m.mean(axis=0), np.maximum(m.std(axis=0), 0.05)
    z = (m - mean) / size
    step = 4 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    look, look_b, t = weights.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ look + look_b)))
        new = look - step * (z.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = look_b - step * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / t2 * (new - weights), new_b + (t - 1) / t2 * (new_b - b)
        weights, b, t = new, new_b, t2
    w = weights / size
    alive = np.nonzero(w)[0]
    return Rules([kept[j] for j in alive], [float(w[j]) for j in alive], float(b - (w * mean).sum()))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, most_samples: int = 20_000, **how) -> Rules:
    """Rules learned from labelled documents for which ``learn`` (over the identifier, named ``__id``) holds."""
    import numpy as np

    sample = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).where(F.col("__label").isNotNull() & F.col("__id").isNotNull()).where(learn)
    sample = sample.groupBy("__id").agg(F.min("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(most_samples)
    # bounded by most_samples: read by the driver first so that the join below broadcasts a checked size
    rows = [(r["__id"], int(r["__label"] > 0)) for r in sample.collect()]
    if not rows:
        return Rules([], [], 0.0)
    known = docs.sparkSession.createDataFrame(rows, f"__id {dict(labels.dtypes)[id_col]}, __label int")
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__t")).join(F.broadcast(known), F.col("__doc") == F.col("__id"))
    texts = texts.withColumn("__hash", F.xxhash64("__t"))
    # a repeated identifier counts once, with the statistics of the text of the smallest hash
    whole = F.min(F.struct("__hash", *(F.col(f"s_{s}").alias(s) for s in STATISTICS))).alias("row")
    got = statistics(texts, "__t", ["__id", "__label", "__hash"], "s_").groupBy("__id", "__label").agg(whole).orderBy("__id").select("__id", "__label", "row.*").toPandas()
    return fit_rules(np.ascontiguousarray(got[list(STATISTICS)].to_numpy(dtype="float64")), got["__label"].to_numpy(dtype="float64"), **how)


def score(docs: DataFrame, model: Rules, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all by default) with score and predicted, which replace columns of these names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    prefix = free_prefix([*keep, "score", "predicted"])
    scored = statistics(docs, text_col, keep, prefix).select(*(F.col(f"`{c}`") for c in keep), model.column(prefix).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Rules, text_col: str = "text") -> DataFrame:
    """The documents that the model doesn't reject, with all their columns."""
    prefix = free_prefix(docs.columns)
    return statistics(docs, text_col, docs.columns, prefix).where(model.column(prefix) >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def held_out(identifier: Column) -> Column:
    """Identifiers whose CRC-32 as text leaves 1 when divided by 3 are never learned from."""
    return F.coalesce(F.crc32(identifier.cast("string")) % 3 == 1, F.lit(False))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("__id")))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
