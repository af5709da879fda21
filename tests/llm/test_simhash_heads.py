from millrace.llm import simhash

from .helpers import odd_docs


def test_heads_that_share_an_identifier_all_stay(spark):
    a, b, c, d = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey", "it is another text altogether here")
    rows = [(None, a, "en", "a"), (None, b, "en", "a"), (None, c, "en", "a"), (5, d, "en", "a"), (5, d, "en", "a"), (5, "and one more that nobody shares", "en", "a")]
    got = sorted(r["text"] for r in simhash.deduplicate(odd_docs(spark, rows)).collect())
    assert got == sorted([a, b, c, d, "and one more that nobody shares"])


def test_the_head_stays_and_not_the_copy_under_its_identifier(spark):
    """Identifier 5 has a head and a copy of document 1; which of its rows is kept is no matter of hashes."""
    copied = "seven eight nine ten eleven twelve"
    for k in range(4):
        rows = [(1, copied, "en", "a"), (5, copied, "en", "a"), (5, f"a text of its own number {k}", "en", "a")]
        got = sorted((r["doc_id"], r["text"]) for r in simhash.deduplicate(odd_docs(spark, rows)).collect())
        assert got == sorted([(1, copied), (5, f"a text of its own number {k}")])
