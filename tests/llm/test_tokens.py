import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, token_counts
from millrace.llm.tokens import VOCABULARY, Encoder

from .helpers import odd_docs, write_tables

WHOLE = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
ENCODER = Encoder()


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=255), st.sampled_from(list(" 's\t\n\x1c.Σİ½1́<|>endoftext")), st.characters(blacklist_categories=("Cs",))), max_size=40), min_size=1, max_size=6))
def test_pieces_equal_the_whole_tokenizer(texts):
    got, offsets = ENCODER.encode_many(pa.array([*texts, None], pa.string()))
    for k, t in enumerate([*texts, None]):
        assert got[offsets[k] : offsets[k + 1]].tolist() == ids(t) == np.frombuffer(ENCODER.encode(t), "<u4").tolist()


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for _ in range(50):
        size = rng.choice([7, 16, 33])
        lengths = [rng.randrange(1, size + 1) for _ in range(rng.randrange(0, 60))]
        got = packing.best_fit_decreasing(lengths, size)
        windows = []
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            room = [(size - sum(lengths[j] for j in w), w) for w in windows]
            fit = [x for x in room if x[0] >= lengths[k]]
            if fit:
                min(fit, key=lambda x: x[0])[1].append(k)
            else:
                windows.append([k])
        assert sorted(sum(lengths[j] for j in w) for w in got) == sorted(sum(lengths[j] for j in w) for w in windows)


def test_packing_is_whole_and_dense(spark, tmp_path):
    docs = odd_docs(spark, [(i, "some words here " * (i % 90), "en", "a") for i in range(200)] + [(500, None, "en", "a"), (501, "", "en", "a"), (502, "long text " * 4000, "en", "a")])
    got = packing.op3_packing(spark, write_tables(spark, tmp_path, docs)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc, text in texts.items():
        own, at = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["start"]), 0
        want = np.array([*ids(text), 1], dtype="<u4")
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at.bit_count() == 1 and at < 2048
    assert packing.pack(odd_docs(spark, [])).count() == 0
    assert packing.pack(odd_docs(spark)).count() > 0


def test_small_buffers_lose_nothing(spark):
    docs = odd_docs(spark, [(i, "a b c " * (i % 50), "en", "a") for i in range(300)])
    got = packing.pack(docs, buffer_tokens=500, size=64).collect()
    assert sum(r["length"] for r in got) == sum(len(ids("a b c " * (i % 50))) + 1 for i in range(300))


def test_histogram_answers_every_limit(spark):
    docs = odd_docs(spark)
    lengths = [len(ids(r["text"])) for r in docs.collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(docs), block=4)
    rows = sums.collect()
    assert {r["length"] for r in rows} == set(lengths)
    for r in rows:
        n = r["length"]
        assert r["n_docs"] == lengths.count(n) and r["docs_longer"] == sum(x > n for x in lengths)
        assert r["tokens_longer"] == sum(x for x in lengths if x > n) and r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["docs_at_most"] == sum(x <= n for x in lengths) and r["n_all"] == len(lengths) and r["tokens_all"] == sum(lengths)
    for r in token_counts.limits(sums, [0, 1, 3, 100, 10**6]).collect():
        assert r["truncated_total"] == sum(min(x, r["limit"]) for x in lengths) and r["docs_longer"] == sum(x > r["limit"] for x in lengths)
    for r in token_counts.quantiles(sums, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r["length"] == min(n for n in lengths if sum(x <= n for x in lengths) >= r["q"] * len(lengths))
    empty = token_counts.suffix_sums(token_counts.histogram(odd_docs(spark, [])))
    assert empty.count() == 0 and token_counts.quantiles(empty, [0.5]).first()["length"] is None
    assert token_counts.limits(empty, [5]).first()["truncated_total"] == 0
