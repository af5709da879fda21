import base64
import gzip
import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.llm import classifier, mixing, pii, warc

from .helpers import odd_docs, write_tables


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights):
    out, full = {}, set()
    while True:
        rest = Fraction(sum(sizes)) - sum(3 * sizes[k] for k in full)
        w = sum(weights[k] for k in range(len(sizes)) if k not in full)
        out = {k: Fraction(3 * sizes[k]) if k in full else rest * weights[k] / w for k in range(len(sizes))}
        new = {k for k in out if out[k] > 3 * sizes[k]}
        if not new:
            return [out[k] for k in range(len(sizes))]
        full |= new


def mixed_docs(spark, n=500):
    rng = random.Random(6)
    names = ["a", "b", "Z", "é", None, "", "z"]
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), "en", names[0] if i % 3 == 0 else rng.choice(names)) for i in range(n)]
    return odd_docs(spark, [*rows, (n, None, None, None), (n + 1, "tiny", "en", "only"), (n + 2, "twice over", "en", "a"), (n + 2, "twice over", "en", "a")])


def test_targets_are_met_and_runs_agree(spark, tmp_path):
    docs = mixed_docs(spark)
    path = write_tables(spark, tmp_path, docs)
    got = mixing.op2_mixing(spark, path).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r["text"]) for r in rows if r["source"] == s) for s in names]
    want = brute_targets(sizes, [(1, 2, 3)[k % 3] for k in range(len(names))])
    source = {r["doc_id"]: r["source"] for r in rows}
    for k, s in enumerate(names):
        own = [r for r in got if source[r["doc_id"]] == s]
        assert {r["source_size"] for r in own} == {sizes[k]} and all(abs(r["target"] - float(want[k])) < 1e-9 for r in own)
        assert sum(r["taken"] for r in own) == round(want[k])
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert all(r["size"] == size(t) for r in got for t in [next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])])
    assert sorted(got) == sorted(mixing.op2_mixing(spark, path).collect())


def test_blocks_are_dealt_once_by_the_tree(spark):
    docs = mixed_docs(spark)
    how = dict(block_words=64, shard_words=512, range_rows=32)
    got = mixing.pieces(docs, size=mixing.words(F.col("text")), **how).where("words > 0").select("doc.*", "shard", "block", "words").collect()
    assert all(r["shard"] is not None for r in got)
    home = {}
    for r in got:
        home.setdefault((r["source"], r["block"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in home.values()) and len({x for s in home.values() for x in s}) > 5
    out = mixing.mix(docs, **how)
    assert out.columns == docs.columns
    assert sum(size(r["text"]) for r in out.collect()) == sum(r["words"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("lots", [2, 5])
def test_more_sources_than_lots_meet_the_same_targets(spark, lots):
    docs = mixed_docs(spark)
    how = dict(block_words=64, shard_words=512, range_rows=32)
    columns = ("doc.doc_id", "doc.source", "size", "source_size", "target", "words", "pass", "block", "shard")

    def rows(**more):
        found = mixing.pieces(docs, size=mixing.words(F.col("text")), **how, **more).select(*columns).collect()
        return sorted(found, key=str)

    few, many = rows(), rows(most_lots=lots)
    assert many == rows(most_lots=lots)
    # targets, passes and blocks don't depend on the way of planning; only the shards of pooled blocks do
    assert sorted(map(str, (r[:-1] for r in few))) == sorted(map(str, (r[:-1] for r in many)))
    homes = {}
    for r in many:
        if r["words"]:
            homes.setdefault((r["source"], r["block"]), set()).add(r["shard"])
    assert all(len(s) == 1 and None not in s for s in homes.values()) and len({x for s in homes.values() for x in s}) > 5


def test_tree_leaves_add_up():
    import pyarrow as pa

    quotas = [1000, 0, 37, 5]
    out = next(mixing._leaves(quotas, 9, 3)(iter([pa.RecordBatch.from_arrays([pa.array(range(9))], names=["id"])]))).to_pylist()
    assert [sum(r["count"] for r in out if r["source"] == s) for s in range(4)] == quotas
    assert max(sum(r["count"] for r in out if r["shard"] == k) for k in range(9)) - min(sum(r["count"] for r in out if r["shard"] == k) for k in range(9)) <= 9


def brute_pii(t):
    email, ip, card, phone = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [(0, *m.span()) for m in re.finditer(email, t)]
    out += [(1, *m.span()) for m in re.finditer(ip, t) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, card, 13, 19), (3, phone, 9, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or luhn(d)):
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(3)
    for alphabet in ("a@.b1-_ 2+", "0123456789 -.", "+1234 ().-5678900", "a1@.+ -é\n"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
            assert brute_pii(t) == pii.base_spans(t), t
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_contexts_discover_identifiers(spark, tmp_path):
    rows = [(i, f"Lorem ipsum é. Please call my number +1 555 010 {2000 + i} after nine today. Dolor sit {i}.", "en", "a") for i in range(12)]
    rows += [(40 + i, f"Please call my number (555) 010-77{10 + i} after nine today", "en", "a") for i in range(2)]
    rows += [(60 + i, f"Order code 88123{i}4417 was shipped by rail on monday", "en", "a") for i in range(9)]
    rows += [(80, None, None, None), (81, "", "en", "a"), (82, "mail a.b@c.org, host 10.0.0.1 or 300.1.1.1; card 4111 1111 1111 1111", "en", "a")]
    docs = odd_docs(spark, rows)
    got = {r["doc_id"]: r for r in pii.op1_pii(spark, write_tables(spark, tmp_path, docs)).collect()}
    for doc, text, *_ in rows:
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_pii(text or ""))
        assert got[doc]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, got[doc]["spans"].split(",")))
        counts = [sum(k == n for k, _, _ in brute_pii(text or "")) for n in range(4)]
        assert [got[doc][f"n_{k}"] for k in pii.KINDS] == counts
    for doc in (40, 41):
        kind, a, b = got[doc]["spans"].split(":")
        assert kind == "phone" and dict((r[0], r[1]) for r in rows)[doc][int(a) : int(b)].startswith("555) 010-77")
    assert all(got[60 + i]["spans"] == "" for i in range(9)) and got[80]["spans"] == ""
    assert got[82]["spans"] == "email:5:14,ip:21:29,card:49:68"
    assert pii.find(odd_docs(spark, [])).count() == 0


def test_rules_separate_held_out_documents(spark, tmp_path):
    rng = random.Random(8)
    words = "the quick brown fox jumps over lazy dogs while rain falls on green hills and rivers run".split()
    rows, labels = [], []
    for i in range(700):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["***", "$$$", "!!"])) for _ in range(rng.randrange(20, 80)))
        rows.append((i, text, "en", "a"))
        labels.append((i, int(good), 0))
    rows += [(900, None, None, None), (901, "", "en", "a"), (None, "the fox", "en", "a")]
    labels += [(5, 1, 0), (None, 1, 0), (6, None, 0), (99999, 0, 0)]
    path = write_tables(spark, tmp_path, odd_docs(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = classifier.op4_quality(spark, path).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = dict((a, b) for a, b, _ in labels[:700])
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    model = classifier.fit(odd_docs(spark, rows), spark.read.parquet(f"{path}/labels.parquet"), ~classifier.held_out(F.col("__id")))
    kept = classifier.accepted(odd_docs(spark, rows), model)
    assert kept.columns == odd_docs(spark, []).columns and 0 < kept.count() < len(rows)
    none = classifier.fit(odd_docs(spark, []), spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r["score"] for r in classifier.score(odd_docs(spark, rows), none).collect()} == {0.5}
    assert "size" in classifier.score(odd_docs(spark, rows), none).columns


def test_compiled_rules_equal_the_model(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((800, len(classifier.STATISTICS)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.4)).astype("float64")
    model = classifier.fit_rules(x, y)
    raw = model.matrix(x) @ np.array(model.weights) + model.intercept
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *(f"__{s}" for s in classifier.STATISTICS)])
    got = [r["p"] for r in df.select("i", model.column().alias("p")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-raw))) and ((np.array(got) > 0.5) == (y > 0.5)).mean() > 0.95


def pages(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "x" * 300_000), (None, "n", "<p>é</p>"), (9, "t", "twice"), (9, "t", "twice"), (10, "h", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, id long")


def test_archives_round_trip(spark, tmp_path):
    df = pages(spark)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(warc.op10_warc(spark, str(tmp_path)).collect(), key=str)
    rows = df.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["html"] or "", []).append(r["page_id"])
    assert sorted(str(r["page_id"]) for r in rows) == sorted(str(r["page_id"]) for r in got)
    for text, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        own = [g for g in got if g["payload_digest"] == digest]
        assert len(own) == len(ids) and {g["payload_bytes"] for g in own} == {len(text.encode())}
        first = max(i for i in ids if i is not None)
        assert [g["page_id"] for g in own if g["record_type"] == "response"] == [first]
        assert all(g["refers_to"] == first for g in own if g["record_type"] == "revisit") and len([g for g in own if g["refers_to"] is None]) == 1


def test_normalised_members_and_index(spark, tmp_path):
    mono, out = f"file://{tmp_path}/mono", f"file://{tmp_path}/out"
    warc.write_monolithic(warc.records(pages(spark).coalesce(1), least_bytes=6), mono)
    index = warc.normalise(spark, mono, out).collect()
    assert len(index) == 9 and sum(r["record_type"] == "revisit" for r in index) == 2
    for name in {r["archive"] for r in index}:
        data = open(name, "rb").read()
        own = sorted((r for r in index if r["archive"] == name), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["size"] for x in own[:k]) for k in range(len(own))]
        for r in own:
            raw = gzip.decompress(data[r["offset"] : r["offset"] + r["size"]])
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    assert sorted(p.name.split(".")[-1] for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) .count("parquet") == len({r["archive"] for r in index})
    with pytest.raises(ValueError):
        list(warc.split_stream(iter([b"WARC/1.1\r\nContent-Length: 50\r\n\r\nabc"])))
    empty = f"file://{tmp_path}/none"
    warc.write_monolithic(warc.records(pages(spark).limit(0)), empty)
    assert warc.read_records(warc.normalise(spark, empty, f"{empty}-out"), f"{empty}-out").count() == 0


def test_records_of_a_frame_that_is_no_scan(spark, tmp_path):
    from millrace.llm.common import is_plain_scan

    pages = spark.range(400).select((F.col("id") % 150).alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("x"), F.col("id") % 40).alias("html"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    scan = spark.read.parquet(f"{tmp_path}/pages.parquet")
    assert is_plain_scan(scan) and is_plain_scan(scan.where("page_id > 1").select("url"))
    mixed = scan.repartition(7).withColumn("r", F.rand()).orderBy("r")
    assert not is_plain_scan(mixed) and not is_plain_scan(pages)
    rows = [r["value"] for r in warc.records(mixed).collect()]
    name = lambda v, field: v.partition(f"{field}: ")[2].partition("\r\n")[0]
    responses = {name(v, "WARC-Record-ID"): name(v, "WARC-Payload-Digest") for v in rows if "WARC-Type: response" in v}
    revisits = [v for v in rows if "WARC-Type: revisit" in v]
    assert len(responses) == 40 and len(revisits) == 360 and all(responses[name(v, "WARC-Refers-To")] == name(v, "WARC-Payload-Digest") for v in revisits)
