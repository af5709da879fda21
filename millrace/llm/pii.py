"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that no base pattern knows.

Base spans (email, ip, card, phone) are found in whole texts, leftmost and non-overlapping for each kind, in linear
time. They seed a graph: words with a digit or an @ (and numeric words right after them) are instances, and the words around
a mention are lexical patterns (two before, two after, one on each side; words of any length, however far away; a word is
cut where another mention begins or ends within it). Spark
scores the graph in rounds: a pattern's confidence for a kind is the mean score of all identifier-like instances in it,
given enough distinct ones of that kind; an instance's score is the chance that one of its confident patterns is right.
Instances that end above ``accept`` and have the loose shape of the kind give further spans, wherever they occur. Base
spans always stay. Mentions have no greatest length; a row of numeric words is cut into windows of ``MOST_DIGITS`` digits,
and strings over 64 characters stand in the graph as digests.

A pattern's or an instance's rows are pre-aggregated, joins are equi-joins that adaptive execution splits, and only a
document's own spans are gathered.

Defined cases: a null text counts as empty; a null identifier is kept; repeated rows are separate documents but one
instance of evidence; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, cut, table

KINDS = ("email", "ip", "card", "phone")

# Fixed values of the contract; written so that each is linear: a run that can't match is left as a whole, which changes
# no match, as a match from within such a run would need the same rest.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Identifier-like: a word with a digit or @, and purely numeric words right after it. Starts at words only, so a long
# word is read once.
MENTION = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[0-9()+.-]++(?![^\x20\x09-\x0D]))*+")
WORD = re.compile(r"\S++")
EDGES = ".,;:!?()[]{}<>\"'|*#&%$="
#: Digits of the longest identifier (a card's); a longer row of numeric words is cut at blanks into windows of that many.
MOST_DIGITS = 19
#: Loose shapes that an accepted instance must have, by kind.
SHAPES = {k: re.compile(v) for k, v in {"email": r"[^@\s]+@[^@\s]+", "ip": r"[0-9]+([.:][0-9]+){3,}", "card": r"([0-9][ -]?){12,19}", "phone": r"[+(]?[0-9]([ ().-]*[0-9]){6,14}"}.items()}

SCHEMA = "id long, base array<struct<kind:int,start:int,end:int>>, mentions array<struct<instance:string,kind:int,start:int,end:int,shapes:int,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in EMAIL.finditer(text) if m[1]]
    if DIGIT.search(text):
        # digits before a part's last 3 can only be zeros, and int() refuses very long ones
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))]
        for kind, pattern, least, most in ((2, CARD, 13, 19), (3, PHONE, 9, 15)):
            for m in pattern.finditer(text):
                digits = "".join(c for c in m[0] if "0" <= c <= "9")
                if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                    out.append((kind, *m.span()))
    return out


def _short(x: str) -> str:
    """The string itself, or a digest of a long one, so that the graph's rows stay small."""
    return x if len(x) <= 64 else "#" + hashlib.sha256(x.encode()).hexdigest()


def _word(x: str) -> str:
    return _short(DIGIT.sub("0", x.lower().strip(EDGES)))


def windows(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The mention text[start:end], or its stretches of words with up to MOST_DIGITS digits each (one word may have more)."""
    parts: list[list[int]] = []
    digits = 0
    for m in re.finditer(r"[^\x20]++", text[start:end]):
        n = len(DIGIT.findall(m[0]))
        if parts and digits + n <= MOST_DIGITS:
            parts[-1][1], digits = start + m.end(), digits + n
        else:
            parts.append([start + m.start(), start + m.end()])
            digits = n
    return [(a, b) for a, b in parts]


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, int, list[str]]]:
    """(instance, kind or -1, start, end, shapes, patterns): the base spans and the other identifier-like mentions.

    shapes has bit k where the mention has the loose shape of kind k.
    """
    found = list(base)
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    at = 0
    if "@" in text or DIGIT.search(text):
        for m in MENTION.finditer(text):
            for a, b in windows(text, *m.span()):
                core = text[a:b].strip(EDGES)
                start = a + text[a:b].find(core)
                end = start + len(core)
                if not core:
                    continue
                while at < len(taken) and taken[at][1] <= start:
                    at += 1
                if at < len(taken) and taken[at][0] < end:
                    continue
                found.append((-1, start, end))
    if not found:
        return []
    # words are cut at the borders of all spans, so no piece belongs to two spans' contexts in part, and each is read once
    borders = sorted({x for _, a, b in found for x in (a, b)})
    starts, ends, at = [], [], 0
    for m in WORD.finditer(text):
        start, end = m.span()
        while at < len(borders) and borders[at] <= start:
            at += 1
        while at < len(borders) and borders[at] < end:
            starts.append(start)
            ends.append(start := borders[at])
            at += 1
        starts.append(start)
        ends.append(end)
    known: dict[int, str] = {}

    def near(places) -> list[str]:
        """The first two words of the places that aren't mere signs."""
        out: list[str] = []
        for k in places:
            if k not in known:
                known[k] = _word(text[starts[k] : ends[k]])
            if known[k]:
                out.append(known[k])
                if len(out) == 2:
                    break
        return out

    out = []
    for kind, a, b in found:
        left = near(range(bisect_left(starts, a) - 1, -1, -1))
        right = near(range(bisect_left(starts, b), len(starts)))
        patterns = []
        if len(left) == 2:
            patterns.append(f"{left[1]} {left[0]} _")
        if len(right) == 2:
            patterns.append(f"_ {right[0]} {right[1]}")
        if left and right:
            patterns.append(f"{left[0]} _ {right[0]}")
        instance = text[a:b].lower()
        shapes = sum(1 << k for k, name in enumerate(KINDS) if SHAPES[name].fullmatch(instance))
        out.append((_short(instance), kind, a, b, shapes, patterns))
    return out


def _extract(batches: Iterator) -> Iterator:
    import pyarrow as pa

    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    names = ("instance", "kind", "start", "end", "shapes", "patterns")
    mention = pa.list_(pa.struct(list(zip(names, (pa.string(), *[pa.int32()] * 4, pa.list_(pa.string())), strict=True))))
    for b in batches:
        bases, all_mentions = [], []
        for t in b.column(1):
            text = t.as_py() or ""
            base = base_spans(text)
            bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            all_mentions.append([dict(zip(names, m, strict=True)) for m in mentions(text, base)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bases, span), pa.array(all_mentions, mention)], names=["id", "base", "mentions"])


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, row, base spans and mentions; kept in the shared folder, without the text."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut(slim.mapInArrow(_extract, SCHEMA).withColumn("row", F.monotonically_increasing_id()))


def bootstrap(rows: DataFrame, rounds: int = 3, least_support: int = 3, least_confidence: float = 0.8, accept: float = 0.9) -> DataFrame:
    """Accepted instances (instance, kind, score) that no base pattern found."""
    m = rows.where(F.size("mentions") > 0).select(F.explode("mentions").alias("m")).select("m.instance", "m.kind", F.explode("m.patterns").alias("pattern"))
    edges = cut(m.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    seeds = edges.where("seed >= 0").groupBy("instance", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    graph = edges.select("pattern", "instance")
    # only patterns that a seed induces can ever score
    scored, new = seeds, None
    for _ in range(rounds):
        sums = graph.join(scored, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("support")).where(F.col("support") >= least_support)
        sure = sums.join(sizes, "pattern").select("pattern", "kind", (F.col("s") / F.col("n")).alias("confidence")).where(F.col("confidence") >= least_confidence)
        new = graph.join(sure, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(0.05)))))).alias("score"))
        new = cut(new.join(seeds.select("instance"), "instance", "left_anti"))
        scored = seeds.unionAll(new)
    return new.where(F.col("score") >= accept)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row for each document: id, base and spans, both array<(kind, start, end)> by kind and start."""
    rows = extract(docs, id_col, text_col)
    accepted = bootstrap(rows, **how).select("instance", F.col("kind").alias("as"))
    more = rows.where(F.size("mentions") > 0).select("row", F.explode(F.filter("mentions", lambda m: (m["kind"] < 0) & (m["shapes"] > 0))).alias("m"))
    more = more.select("row", "m.instance", "m.start", "m.end", "m.shapes").join(accepted, "instance").where(F.expr("(shapes >> as) & 1 = 1"))
    more = more.groupBy("row").agg(F.collect_set(F.struct(F.col("as").alias("kind"), "start", "end")).alias("more"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    joined = rows.drop("mentions").join(more, "row", "left")
    return joined.select("id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
