"""Adaptive time partitions against a brute-force layout: leaves, parts, file contents, what stays and what goes."""

import binascii
import calendar
import datetime as dt
import glob
import hashlib
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import time_partitions as tp

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CUTOFF = dt.datetime(2024, 4, 1)


def moved(i, ts):
    if ts is None:
        return None
    k = binascii.crc32(str(i).encode()) % 128
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    if k > 111:
        return dt.datetime(ts.year, ts.month, ts.day) - dt.timedelta(days=ts.weekday())
    return ts


def layout(rows, limit, moment):
    """{(leaf, part): rows in file order} of rows with moment(row); rows start with (click_id, ts, arrived_at)."""
    timed, out = [(moment(r), r) for r in rows], {}

    def leaf(name, members):
        members = sorted(members, key=lambda x: (x[0] or dt.datetime.min, x[1][2], x[1][0] is None, x[1][0]))
        for k in range(0, len(members), limit):
            out[name, k // limit + 1] = [r for _, r in members[k : k + limit]]

    def split(prefix, level, members):
        if level == 0:
            years = [m.year for m, _ in members]
            keys = range(min(years), max(years) + 1) if years else []
        else:
            keys = range(1, 13) if level == 1 else range(1, calendar.monthrange(int(prefix[0]), int(prefix[1]))[1] + 1) if level == 2 else range(24)
        field = ("year", "month", "day", "hour")[level]
        by = {k: [] for k in keys}
        for x in members:
            by[getattr(x[0], field)].append(x)
        run = None

        def close():
            if run and run[2]:
                spell = (lambda k: f"{k:04d}") if level == 0 else (lambda k: f"{k:02d}")
                leaf("/".join([*prefix, f"{spell(run[0])}-{spell(run[1])}"]), run[2])

        for k in keys:
            if len(by[k]) > limit:
                close()
                run = None
                if level == 3:
                    leaf("/".join([*prefix, f"{k:02d}-{k:02d}"]), by[k])
                else:
                    split([*prefix, f"{k:04d}" if level == 0 else f"{k:02d}"], level + 1, by[k])
            elif run and len(run[2]) + len(by[k]) <= limit:
                run = (run[0], k, run[2] + by[k])
            else:
                close()
                run = (k, k, list(by[k]))
        close()

    split([], 0, [x for x in timed if x[0] is not None])
    leaf("null", [x for x in timed if x[0] is None])
    return out


def digest(rows):
    return hashlib.sha256(",".join("null" if r[0] is None else str(r[0]) for r in rows).encode()).hexdigest()


def clicks(seed=3, n=3000):
    rng, rows = random.Random(seed), []
    for i in range(n):
        day = rng.choice([0, 0, 1, 40, rng.randrange(119)])
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=rng.choice([rng.randrange(86400), 3600 * 5 + rng.randrange(60)]), microseconds=rng.choice([0, 0, 5]))
        arrived = ts + dt.timedelta(seconds=rng.choice([1, 1, 60, 86400 * 30]))
        ts = None if i % 40 == 7 or rng.random() < 0.02 else ts
        rows.append((i, ts, arrived, rng.choice([1, None]), rng.choice(["view", None]), 0.5, '{"k": 1}'))
    return rows + rng.sample(rows, 40) + [rows[5]] * 200


def equal_rows(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(key, a)) == sorted(map(key, b))


def test_query_against_brute_force(spark, tmp_path):
    rows = clicks()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/clicks.parquet")
    got = [r.asDict() for r in tp.op11_time_partitions(spark, str(tmp_path)).collect()]
    limit = 1 + len(rows) // 800
    moment = lambda r: moved(r[0], r[1])
    start, want = layout([r for r in rows if r[2] < CUTOFF], limit, moment), layout(rows, limit, moment)
    assert {(g["leaf"], g["part"]) for g in got} == set(want) and len(got) == len(want)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for g in got:
        key = g["leaf"], g["part"]
        table = pq.read_table(g["path"].removeprefix("file://"))
        held = [tuple(r[c] for c in names) for r in table.to_pylist()]
        stays = key in start and equal_rows(start[key], want[key])
        assert table.column_names == names == g["columns"].split(",") and equal_rows(held, want[key])
        assert [r[0] for r in held] == [r[0] for r in want[key]] and g["ids_sha256"] == digest(want[key])
        assert (g["n_rows"], g["n_new"]) == (len(held), sum(r[2] >= CUTOFF for r in held)) and g["rewritten"] == (not stays)
    folder = got[0]["path"].removeprefix("file://").rpartition("/")[0]
    assert sorted(glob.glob(f"{folder}/**", recursive=True))[1:] == sorted(g["path"].removeprefix("file://") for g in got)
    assert {g["rewritten"] for g in got} == {True, False} and any(g["part"] > 1 for g in got)


@pytest.mark.parametrize("limit", [2, 5])
def test_limits(spark, tmp_path, limit):
    rows = [(i, t, CUTOFF) for i, t in enumerate([dt.datetime(1999, 12, 31, 23), dt.datetime(2024, 2, 29, 0, 5), dt.datetime(2024, 2, 29, 0, 5), dt.datetime(2024, 2, 29, 23), dt.datetime(2024, 3, 1), None, None, None, dt.datetime(2031, 1, 1)])]
    df = spark.createDataFrame([*rows, (None, rows[1][1], CUTOFF)], "id long, ts timestamp_ntz, seen timestamp_ntz")
    got = tp.write(df, F.col("ts"), ["seen", "id"], limit, f"file://{tmp_path}/out", id_col="id").collect()
    want = layout([*rows, (None, rows[1][1], CUTOFF)], limit, lambda r: r[1]) if limit > 2 else None
    if want is not None:
        assert {(r["leaf"], r["part"], r["n_rows"]) for r in got} == {(*k, len(v)) for k, v in want.items()}
    assert sum(r["n_rows"] for r in got) == 10 and all(r["n_rows"] <= limit for r in got)


def test_empty_one_sided_and_clashing(spark, tmp_path):
    schema = "id long, ts timestamp_ntz, at long, rank string, file string, leaf string, part string, a string, bucket string, start string, n string, y string, `__x` map<string,int>"
    empty = spark.createDataFrame([], schema)
    none = tp.write(empty, F.col("ts"), ["id"], 3, f"file://{tmp_path}/empty", id_col="id")
    assert none.collect() == []
    rows = [(i, None if i % 2 else dt.datetime(2024, 1, 1, i), 7, *"abcdefghi", {"k": i}) for i in range(9)]
    df = spark.createDataFrame(rows, schema)
    # into what an empty table left
    after = tp.rewrite(df, F.col("ts"), ["id"], 3, f"file://{tmp_path}/empty", none, id_col="id", is_new=F.lit(True)).collect()
    assert sum(r["n_rows"] for r in after) == sum(r["n_new"] for r in after) == 9 and all(r["rewritten"] for r in after)
    held = [r for x in after for r in pq.read_table(x["path"].removeprefix("file://")).to_pylist()]
    assert sorted((r["id"], r["at"], r["rank"], r["y"], dict(r["__x"])["k"]) for r in held) == [(i, 7, "a", "i", i) for i in range(9)]
    # the same rows again: all stay; none: all go
    before = spark.createDataFrame(after).select(*(x.split()[0] for x in tp.MANIFEST.split(", ")))
    again = tp.rewrite(df, F.col("ts"), ["id"], 3, f"file://{tmp_path}/empty", before, id_col="id", is_new=F.lit(True)).collect()
    assert {r["path"] for r in again} == {r["path"] for r in after} and not any(r["rewritten"] or r["n_new"] for r in again)
    assert tp.rewrite(empty, F.col("ts"), ["id"], 3, f"file://{tmp_path}/empty", before, id_col="id", is_new=F.lit(True)).collect() == []
    assert glob.glob(f"{tmp_path}/empty/data/*") == []


def test_a_hot_moment_is_dealt_to_many_tasks(spark, tmp_path):
    rows = [(5, dt.datetime(2024, 1, 1), "same")] * 4000 + [(i, dt.datetime(2024, 1, 2), str(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, x string").repartition(8)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = tp.Sorted(df, F.col("ts"), ["id"], f"file://{tmp_path}/work").offsets.orderBy("p").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    ends = [*(r["offset"] for r in sizes[1:]), 8000]
    assert len(sizes) == 4 and max(z - r["offset"] for r, z in zip(sizes, ends, strict=True)) < 3500
