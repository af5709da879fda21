"""Line deduplication by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line's number of words, then its first ``depth`` words (after He et al. 2017). Words that
hold a digit are variable fields and stand as <*> from the start. A leaf holds several templates: each word of a line
beyond the depth has a support, the number of the leaf's distinct lines with that word at that place; a line's family is
as large as the support that the share ``similarity`` of its words reaches, and words with less than ``least_share`` of
that are variable fields, <*> in the line's template. A line without a family is a template of its own.

Templates that recur in enough documents are dropped, line by line: in as many as give ``words_together`` words together,
and in two at least. So one word (a button) has to recur in 50 documents, five words in 10, 25 or more in 2. Documents with
equal texts count once; blank lines always stay.

Only hashes of lines are gathered at first (one pass over the texts); words follow for one place of each distinct line of
the leaves that lie in enough documents and hold more than one line. Counts are pre-aggregated, so a line that a third of
all documents share is one row of each task; the join that marks places is an equi-join that adaptive execution splits.
Documents are known by 128 bits of hashes of their texts, lines by 64 bits within the 64 bits of their leaf.

Defined cases: a null text has no lines and stays null; an empty text has one empty line, which stays; repeated rows
are treated alike; null identifiers are allowed (identifiers aren't read); the lines that stay keep their text and order;
columns of the input pass through, and two are added, named as ``added`` says; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import WHITE, cut, free_names, table


def masked(line: Column) -> Column:
    """The line with single blanks between words and <*> for words that hold a digit."""
    # byte searches spare most lines the regular expressions
    odd = F.contains(line, F.lit("  "))
    for white in "\t\v\f\r\n":
        odd = odd | F.contains(line, F.lit(white))
    plain = F.trim(F.when(odd, F.regexp_replace(line, WHITE, " ")).otherwise(line))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(plain)


def n_words(t: Column) -> Column:
    return F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1


def document_key(text: Column) -> list[Column]:
    """Two independent hashes, a and b, of a text."""
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")]


def least_needed(n: Column, words_together: int) -> Column:
    """Documents in which a template of n words has to lie."""
    return F.greatest(F.lit(2), F.ceil(F.lit(words_together) / n)).cast("long")


def maybe(rows: DataFrame, keys: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """The rows (a, ...) whose a may be among the keys: a filter that spares the exchange of most rows.

    A bitmap of ``bits`` bits in parts of 4 KB, so at most 4 MB are broadcast for any input. With very many keys it passes
    more rows than it need, never fewer.
    """
    a = F.col("a").bitwiseAND(bits - 1)
    part, at = F.shiftright(a, 15).alias("part"), a.bitwiseAND((1 << 15) - 1)
    maps = keys.select(part, at.alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("map"))
    byte = F.conv(F.hex(F.substring("map", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.select("*", part, at.alias("at")).join(F.broadcast(maps), "part")
    return held.where(F.call_function("getbit", byte, (F.col("at") % 8).cast("int")) == 1).select(*rows.columns)


def templates(wide: DataFrame, docs: DataFrame, text_col: str, depth: int, similarity: float, least_share: float) -> DataFrame:
    """The lines of the wide leaves with the hash of their template; wide has one place (a, b, pos) of each line."""
    text = F.col(f"`{text_col}`")
    asked = cut(wide.groupBy("a", "b").agg(F.collect_list(F.struct("pos", "leaf", "line", "n", "n_lines", "d")).alias("asked")))
    # split before the exchange, so that the list's items are found by their place
    split = maybe(docs.where(text.isNotNull()).select(*document_key(text), text.alias("text")), asked.select("a")).select("a", "b", F.split("text", "\n").alias("lines"))
    found = F.transform("asked", lambda x: F.struct(x["leaf"].alias("leaf"), x["line"].alias("line"), x["n"].alias("n"), x["n_lines"].alias("n_lines"), x["d"].alias("d"), F.get("lines", x["pos"]).alias("raw")))
    found = split.join(asked, ["a", "b"]).select(F.explode(found).alias("x")).select("x.leaf", "x.line", "x.n", "x.n_lines", "x.d", masked(F.col("x.raw")).alias("t"))
    found = found.groupBy("leaf", "line", "n", "n_lines", "d", "t").agg(F.lit(1).alias("one"))
    hashes = F.transform(F.slice(F.split("t", " "), depth + 1, 1 << 30), lambda w: F.xxhash64(w))
    words = cut(found.select("leaf", "line", "n", "n_lines", "d", hashes.alias("words")))
    words = words.select("leaf", "line", "n", "n_lines", "d", F.posexplode("words").alias("at", "word"))
    support = words.groupBy("leaf", "at", "word").agg(F.count("*").alias("c"))
    lines = words.join(support, ["leaf", "at", "word"]).groupBy("leaf", "line", "n", "n_lines", "d").agg(F.array_sort(F.collect_list(F.struct("at", "word", "c"))).alias("words"))
    # the support that enough words reach: all words up to the depth have the whole leaf's
    rank = F.ceil(F.round(similarity * F.col("n"), 6)).cast("int") - depth
    family = F.when(rank <= 0, F.col("n_lines")).otherwise(F.get(F.sort_array("words.c", False), rank - 1))
    # the array of one binds the value, which would be made again for each word else
    kept = lambda f: F.transform("words", lambda w: F.when(w["c"] >= least_share * f, w["word"]).otherwise(F.xxhash64(F.lit("<*>"))))
    return lines.select("leaf", "line", "n", "d", F.xxhash64(F.get(F.transform(F.array(family), kept), F.lit(0))).alias("template"))


def recurring(docs: DataFrame, text_col: str = "text", *, depth: int = 4, words_together: int = 50, similarity: float = 0.7, least_share: float = 0.5) -> DataFrame:
    """Rows (a, b, places): for each text that loses lines, its key and the places of the lines to drop."""
    text = F.col(f"`{text_col}`")
    need = least_needed(F.col("n"), words_together)
    lines = docs.where(text.isNotNull()).select(*document_key(text), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    lines = lines.select("a", "b", "pos", masked(F.col("raw")).alias("t"))
    n = F.when(F.octet_length("t") == 0, 0).otherwise(n_words(F.col("t")))
    # filters follow the cut: before it they would make Spark mask every line twice
    slim = cut(lines.select("a", "b", "pos", n.alias("n"), F.xxhash64(n, F.substring_index("t", " ", depth)).alias("leaf"), F.xxhash64("t").alias("line"))).where("n > 0")
    once = slim.groupBy("leaf", "line", "n", "a", "b").agg(F.min("pos").alias("pos"))
    one = lambda c: F.first(c).alias(c)
    per_line = once.groupBy("leaf", "line", "n").agg(F.count("*").alias("d"), one("a"), one("b"), one("pos"))
    leaves = per_line.groupBy("leaf", "n").agg(F.sum("d").alias("total"), F.count("*").alias("n_lines")).where(F.col("total") >= need).select("leaf", "n_lines")
    held = cut(per_line.join(leaves, "leaf"))
    alone = (F.col("n_lines") == 1) | (F.col("n") <= depth)
    sure = held.where(alone & (F.col("d") >= need)).select("leaf", "line")
    # lines of one template: in enough documents if one of them is, or if together they are
    led = cut(templates(held.where(~alone), docs, text_col, depth, similarity, least_share))
    shown = led.groupBy("leaf", "template", "n").agg(F.max("d").alias("most"), F.sum("d").alias("total")).where(F.col("total") >= need)
    open_lines = led.join(shown.where(F.col("most") < need).select("leaf", "template"), ["leaf", "template"]).select("leaf", "line", "n", "template")
    together = slim.select("leaf", "line", "a", "b").join(open_lines, ["leaf", "line"]).groupBy("leaf", "template", "n", "a", "b").agg(F.lit(1).alias("one"))
    together = together.groupBy("leaf", "template", "n").agg(F.count("*").alias("d")).where(F.col("d") >= need)
    often = shown.where(F.col("most") >= need).select("leaf", "template").unionAll(together.select("leaf", "template"))
    gone = sure.unionAll(led.join(often, ["leaf", "template"], "left_semi").select("leaf", "line"))
    return slim.select("leaf", "line", "a", "b", "pos").join(gone, ["leaf", "line"], "left_semi").groupBy("a", "b").agg(F.collect_set("pos").alias("places"))


def added(docs: DataFrame) -> list[str]:
    """Names of the columns that ``clean`` adds: lines of the text and lines dropped."""
    return free_names(docs.columns, "__n_lines", "__n_dropped")


def clean(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents without their recurring lines, with all columns and the two of ``added``."""
    text = F.col(f"`{text_col}`")
    a, b, lines, gone = free_names([*docs.columns, *added(docs)], "a", "b", "lines", "places")
    key = [c.alias(x) for c, x in zip(document_key(text), (a, b), strict=True)]
    split = docs.select(*(F.split(text, "\n").alias(lines) if c == text_col else F.col(f"`{c}`") for c in docs.columns), *key)
    found = recurring(docs, text_col, **how).select(F.col("a").alias(a), F.col("b").alias(b), F.col("places").alias(gone))
    out = split.join(found, [a, b], "left")
    # a set difference of places and a list by place: linear in the lines, however many are dropped
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n"))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    counts = [size(c).alias(name) for c, name in zip((lines, gone), added(docs), strict=True)]
    return out.select(*(kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), *counts)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
texts AS (SELECT text, row_number() OVER () AS k FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
raw AS (SELECT k, u.pos, u.line FROM texts, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
plain AS (SELECT k, pos, line, regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS t FROM raw),
slim AS (SELECT DISTINCT k, t, len(string_split(t, ' ')) AS n, array_to_string(string_split(t, ' ')[1:4], ' ') AS head,
  greatest(2, ceil(50 / len(string_split(t, ' ')))) AS need FROM plain WHERE t <> ''),
per_line AS (SELECT n, head, t, need, count(*) AS d FROM slim GROUP BY ALL),
leaves AS (SELECT n, head, count(*) AS n_lines FROM per_line GROUP BY ALL HAVING sum(d) >= any_value(need)),
words AS (SELECT n, head, t, n_lines, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) AS place FROM per_line JOIN leaves USING (n, head) WHERE n > 4),
support AS (SELECT n, head, place, word, count(*) AS c FROM words WHERE place > 4 GROUP BY ALL),
family AS (SELECT n, head, t, CASE WHEN ceil(0.7 * n) <= 4 THEN any_value(n_lines) ELSE list(c ORDER BY c DESC)[CAST(ceil(0.7 * n) AS INTEGER) - 4] END AS family
  FROM words JOIN support USING (n, head, place, word) GROUP BY n, head, t),
led AS (SELECT n, head, t, string_agg(CASE WHEN c >= 0.5 * family THEN word ELSE '<*>' END, ' ' ORDER BY place) AS template
  FROM words JOIN support USING (n, head, place, word) JOIN family USING (n, head, t) GROUP BY n, head, t
  UNION ALL SELECT n, head, t, '' FROM per_line WHERE n <= 4),
often AS (SELECT n, head, template FROM slim JOIN led USING (n, head, t) GROUP BY ALL HAVING count(DISTINCT k) >= any_value(need)),
gone AS (SELECT t FROM led JOIN often USING (n, head, template)),
marked AS (SELECT k, pos, line, t IN (SELECT t FROM gone) AS dropped FROM plain),
cleaned AS (SELECT k, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text FROM marked GROUP BY k)
SELECT docs.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(cleaned.text, '')) AS text_sha256
FROM docs LEFT JOIN texts ON docs.text = texts.text LEFT JOIN cleaned USING (k)
"""
