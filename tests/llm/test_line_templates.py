"""Templates of a leaf, what recurs, and odd tables for line dedup."""

import time

from pyspark.sql import functions as F

from millrace.llm import line_dedup

from .helpers import odd_docs


def cleaned(spark, texts, **how):
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    return [r["text"] for r in line_dedup.clean(odd_docs(spark, rows), **how).orderBy("doc_id").collect()]


def test_families_of_one_leaf_are_templates_of_their_own(spark):
    over = [f"the quick brown fox jumps over {w} dog in the morning" for w in ("lazy", "small", "big", "old")]
    under = [f"the quick brown fox sleeps under {w} tree until late evening" for w in ("green", "tall", "young")]
    other = [f"the quick brown fox {' '.join(f'{c}{k}x'.translate({48: 113, 49: 119, 50: 101, 51: 114, 52: 116}) for k in range(7))}" for c in "abcde"]
    got = cleaned(spark, over + under + other, words_together=33)
    assert got == [""] * 7 + other


def test_words_and_documents_decide_together(spark):
    two = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(25))
    texts = [f"{two}\nunlike {c * 3}" for c in "ab"]
    assert cleaned(spark, texts) == ["unlike aaa", "unlike bbb"]
    short = two.rpartition(" ")[0]
    assert cleaned(spark, [f"{short}\nunlike {c * 3}" for c in "ab"]) == [f"{short}\nunlike {c * 3}" for c in "ab"]
    names = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(40)]
    menu = [f"All rights reserved.\nunlike {x}" for x in names]
    assert cleaned(spark, menu[:16]) == menu[:16] and cleaned(spark, menu[:17]) == [f"unlike {x}" for x in names[:17]]
    # the same rule at every length: as many documents as give 50 words together
    for n in (5, 24):
        line, need = " ".join(f"{chr(98 + k)}q" for k in range(n)), -(-50 // n)
        assert cleaned(spark, [f"{line}\nunlike {x}" for x in (names * 2)[: need - 1]])[0].startswith(line) and cleaned(spark, [f"{line}\nunlike {k} {x}" for k, x in enumerate((names * 2)[:need])])[0].startswith("unlike")
    # copies of one text are one document
    assert cleaned(spark, [f"{two}\nend"] * 5) == [f"{two}\nend"] * 5


def test_odd_tables(spark):
    line = "this line recurs in every one of the documents"
    rows = [(None, f"{line}\na", "en", "a"), (None, f"{line}\nb", "en", "a"), (3, f"{line}\nc", "en", "a"), (3, f"{line}\nc", "en", "a"), (4, f"{line}\n\n\n{line}", "en", None), (5, "x" * 200_000, "en", "a"), (6, None, "en", "a"), (7, "", "en", "a")]
    got = sorted(((r["doc_id"] or 0), r["text"] or "", r["__n_lines"], r["__n_dropped"]) for r in line_dedup.clean(odd_docs(spark, rows), words_together=33).collect())
    assert got == [(0, "a", 2, 1), (0, "b", 2, 1), (3, "c", 2, 1), (3, "c", 2, 1), (4, "\n", 4, 2), (5, "x" * 200_000, 1, 0), (6, "", 0, 0), (7, "", 1, 0)]


def test_many_dropped_lines_take_linear_time(spark):
    docs = lambda n: spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("some line that recurs with "), F.translate(k.cast("string"), "0123456789", "abcdefghij"))), "\n"), F.lit("\nend "), F.col("id").cast("string")).alias("text"))
    seconds = []
    for n in (5_000, 40_000):
        began = time.time()
        got = line_dedup.clean(docs(n), words_together=18).collect()
        seconds.append(time.time() - began)
        assert [r["__n_dropped"] for r in got] == [n] * 3
    assert seconds[1] < 24 * seconds[0]  # 8 times the lines: 8 if linear, 64 if quadratic
