"""Text columns: Python-like stripping, normalisation for deduplication, shingles, repetition, code fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that str.strip() removes (Spark's trim removes only blanks).
PY_SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: What str.isdigit() accepts beyond decimal digits: superscripts, subscripts, circled and similar digits.
OTHER_DIGITS = r"²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
FENCE = "```"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(c: Column | str, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(col(c)), f)[0]


def once(c: Column) -> Column:
    """The same value as a column of its own that the optimizer neither repeats nor moves.

    For large expressions: a filter on one would otherwise compute it a second time below, and its rewriting by the
    optimizer takes longer than the query.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def strip(c: Column | str) -> Column:
    """Without white space at both ends, as Python sees it."""
    # a pattern would look at every blank of the text for the end
    return F.btrim(col(c), F.lit(_SPACES))


def normalize_text(c: Column | str) -> Column:
    """Lower case, digits deleted, all but a to z as single blanks, stripped. Null stays null."""
    t = F.regexp_replace(F.lower(col(c)), r"\p{Nd}+", "")
    return F.trim(F.regexp_replace(t, "[^a-z]+", " "))


def shingles(c: Column | str, k: int = 5) -> Column:
    """Distinct character k-grams; a shorter text is its only shingle."""
    # a look-ahead matches at every place, so all overlapping grams come from one scan of the text
    grams = lambda t: F.when(F.length(t) < k, F.array(t)).otherwise(F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)))
    return bind(c, grams)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two sets as arrays; two empty sets are equal."""
    common, both = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when(both == 0, 1.0).otherwise(common / both)


def repetition_ratio(c: Column | str, chunk: int = 20, least: int = 200) -> Column:
    """Share of the most frequent of the text's consecutive chunks; 0 for texts of at most ``least`` characters.

    Chunks start at 0, chunk, 2 chunk, ... below length - chunk. A sorted array shows equal chunks side by side, so the
    longest run is found in one pass instead of comparing all pairs.
    """
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when((acc["run"] > 0) & (acc["last"] == x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    def ratio(t: Column) -> Column:
        n = F.ceil((F.length(t) - chunk) / chunk).cast("int")
        chunks = F.array_sort(F.slice(F.regexp_extract_all(t, F.lit(f"(?s).{{{chunk}}}"), 0), F.lit(1), F.greatest(n, F.lit(0))))
        return F.aggregate(chunks, zero, step, lambda acc: acc["best"]) / n

    return F.when(F.length(col(c)) > least, bind(c, ratio)).otherwise(0.0)


def has_digit(c: Column | str) -> Column:
    return col(c).rlike(rf"[\p{{Nd}}{OTHER_DIGITS}]")


def strip_fences_by_line(c: Column | str) -> Column:
    """A text that starts with a fence loses its first line, and its last if that is only a fence."""

    def inner(lines: Column) -> Column:
        last = strip(F.element_at(lines, -1)) == FENCE
        return strip(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - F.when(last, 2).otherwise(1), F.lit(0))), "\n"))

    return bind(strip(c), lambda t: F.when(t.startswith(FENCE), bind(F.split(t, "\n"), inner)).otherwise(t))


def strip_fences_anywhere(c: Column | str, trailing: bool = False) -> Column:
    """Without any fence marker; with ``trailing`` also without backticks at the end."""
    t = strip(F.regexp_replace(col(c), "```(?:json)?", ""))
    return strip(F.rtrim(t, F.lit("`"))) if trailing else t


def brace_block(c: Column | str) -> Column:
    """From the first { to the last }; empty if both exist in the other order, null if one is missing."""
    t = col(c)
    first, last = F.locate("{", t), F.length(t) - F.locate("}", F.reverse(t)) + 1
    block = F.when(last >= first, F.substring(t, first, last - first + 1)).otherwise("")
    return F.when(F.contains(t, F.lit("{")) & F.contains(t, F.lit("}")), block)


def python_float(c: Column | str) -> Column:
    """A double as Python spells it: 0.0, -100.0, 1e+16, 1e-05."""

    def shorter(x: Column, t: Column, digits: int) -> Column:
        # some JVMs spell a digit or two more than are needed
        n = F.length(F.regexp_replace(F.substring_index(t, "E", 1), "[^0-9]", ""))
        other = lambda s: F.when(s.try_cast("double") == x, F.replace(s, F.lit("e"), F.lit("E"))).otherwise(t)
        return F.when(n > digits, bind(F.format_string(f"%.{digits - 1}e", x), other)).otherwise(t)

    def of(x: Column) -> Column:
        return bind(bind(bind(x.cast("string"), lambda t: shorter(x, t, 17)), lambda t: shorter(x, t, 16)), lambda t: _python_spelling(x, t))

    return bind(c, of)


def _python_spelling(x: Column, t: Column) -> Column:
    """Of a double and its shortest spelling by the JVM."""
    m = F.abs(x)
    power = F.substring_index(t, "E", -1).cast("int")
    mantissa = F.substring_index(F.replace(t, F.lit("-"), F.lit("")), "E", 1)
    digits_only = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
    whole = F.concat(digits_only, F.repeat(F.lit("0"), power + 1 - F.length(digits_only)))  # positive powers: the point moves right
    right = F.concat(F.substring(whole, F.lit(1), power + 1), F.lit("."), F.when(F.length(whole) > power + 1, F.substring(whole, power + 2, F.length(whole))).otherwise("0"))
    left = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits_only)
    plain = F.concat(F.when(x < 0, "-").otherwise(""), F.when(power >= 0, right).otherwise(left))
    digits = F.lpad(F.abs(power).cast("string"), 2, "0")
    small = F.concat(F.regexp_replace(F.substring_index(t, "E", 1), r"\.?0+$", ""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, digits).otherwise(F.abs(power).cast("string")))
    word = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(word, F.when(~F.contains(t, F.lit("E")), t).when((m >= 1e-4) & (m < 1e16), plain).otherwise(small))
