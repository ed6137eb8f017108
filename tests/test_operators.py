import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.operators import compare, index, ordered, profile, rollup, state, tasks


@given(st.integers(0, 60), st.integers(1, 80), st.integers(1, 30))
def test_tasks_absorb_a_last_one_of_one_block(begin, n, step):
    end, bounds, at = begin + n - 1, [], begin
    while at <= end:
        stop = min(at + step - 1, end)
        if end - stop == 1:
            stop = end
        bounds.append((at, stop))
        at = stop + 1
    count = tasks.n_tasks(begin, end, step)
    number = {b: min((b - begin) // step, count - 1) for b in range(begin, end + 1)}
    assert count == len(bounds)
    assert [(min(b for b in number if number[b] == t), max(b for b in number if number[b] == t)) for t in range(count)] == bounds


@pytest.mark.parametrize("args", [(5, 4, 1), (0, 5, 0), (-1, 5, 1)])
def test_bad_ranges(args):
    with pytest.raises(ValueError):
        tasks.check_range(*args)
    with pytest.raises(ValueError):
        tasks.check_range(0, 9, 1, last=8)


def test_task_table(spark):
    got = [tuple(r) for r in tasks.tasks(spark, 10, 31, 10).orderBy("task").collect()]
    assert got == [(0, 10, 19), (1, 20, 29), (2, 30, 31)]
    assert [tuple(r) for r in tasks.tasks(spark, 0, 10, 10).collect()] == [(0, 0, 10)]
    assert tasks.batches(0, 25, 10) == [(0, 9), (10, 19), (20, 25)]


@pytest.mark.parametrize("seed", range(3))
def test_two_level_windows(spark, seed):
    rng = random.Random(seed)
    keys = sorted(rng.sample(range(200), 90))
    rows = [(k, rng.randrange(1, 9)) for k in keys]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, v long").repartition(3)
    sums = {r.k: r.s for r in ordered.running_sum(df, "k", F.col("v"), "s", start=32, width=16).collect()}
    prior = {r.k: r.p for r in ordered.previous(df, "k", "v", "p", width=16).collect()}
    place = {r.k: r.p for r in ordered.position(df, "k", "p", width=16).collect()}
    total, last = 32, None
    for n, (k, v) in enumerate(rows, 1):
        assert (sums[k], prior[k], place[k]) == (total, last, n)
        total, last = total + v, v
    want, run = [], []
    for k in keys:
        if run and k != run[-1] + 1:
            want.append((run[0], run[-1], len(run)))
            run = []
        run.append(k)
    want.append((run[0], run[-1], len(run)))
    assert sorted(map(tuple, ordered.islands(df, "k", width=16).collect())) == want


def test_measured_buckets(spark):
    df = spark.createDataFrame([(f"0x{k:04x}", k * 1_000_000, k) for k in range(500)], "s string, n long, v long")
    assert ordered.measured(df, "s") == 2 + len("0x0") and ordered.measured(df.limit(0), "n") == 1
    assert ordered.measured(df, "n") == 499_000_001
    want = {f"0x{k:04x}": k * (k - 1) // 2 for k in range(500)}
    assert {r.s: r.x for r in ordered.running_sum(df, "s", F.col("v"), "x").collect()} == want
    assert {r.s: r.x for r in ordered.running_sum(df, "n", F.col("v"), "x").collect()} == want


def test_split_reads(spark):
    df = spark.createDataFrame([(bytearray(b"abcdef"),)], "d binary")
    r = df.select(index.split_reads(F.col("d"), F.lit(2), F.lit(3)).alias("a"), index.split_reads(F.col("d"), F.lit(4), F.lit(3)).alias("b")).first()
    assert bytes(r.a) == b"cde" and r.b is None


def test_index_validity_edges(spark):
    cases = [(1, 32, 5, True, True), (100_000_000, 32, 5, False, False), (1, 31, 5, False, False), (1, 101, 1, False, False), (1, 32, 0, False, False), (1, 32, 10_000_000, False, False), (1, 98, 5, True, False), (1, 95, 5, True, True)]
    df = spark.createDataFrame([c[:3] + (k,) for k, c in enumerate(cases)], "block long, offset long, length int, k int")
    got = df.select("k", index.valid(100, strict=False).alias("loose"), index.valid(100).alias("strict")).orderBy("k").collect()
    assert [(r.loose, r.strict) for r in got] == [c[3:] for c in cases]


def test_gaps_inside_and_outside(spark):
    df = spark.createDataFrame([(3,), (5,), (8,)], "block long")
    assert sorted(r.block for r in index.gaps(df, 0, 10).collect()) == [4, 6, 7]
    assert sorted(r.block for r in index.gaps(df, 0, 10, clip=False).collect()) == [0, 1, 2, 4, 6, 7, 9, 10]
    assert index.gaps(df.limit(0)).count() == 0


def test_compare_statuses(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("d", 3), ("ee", 4)], "key string, value int")
    b = spark.createDataFrame([("a", 1), ("b", 9), ("c", 3)], "key string, value int")
    got = {r.pos: r.status for r in compare.by_position(a, b, "key", "value").collect()}
    assert got == {1: "equal", 2: "value", 3: "key", 4: "left_only"}
    assert {r.status for r in compare.by_position(a, b, "key", "value", skip_depth=1).collect()} == {"left_only"}
    assert sorted((r.key, r.side) for r in compare.by_key(a, b).collect()) == [("b", "left"), ("b", "right"), ("c", "right"), ("d", "left"), ("ee", "left")]


def test_stacks(spark):
    df = spark.createDataFrame([(["c<x>", "b", "a"],), (["c<y>", "b", "a"],), ([],), (["m::n::f<T>"],)], "frames array<string>")
    assert {(r.stack, r.samples) for r in profile.folded(df).collect()} == {("a;b;c", 2), ("m::n::f", 1)}
    assert ("f", 1) in {(r.stack, r.samples) for r in profile.folded(df, most=10, reverse=False, last_segment=True).collect()}


def test_best_codec_ties_and_none(spark):
    df = spark.createDataFrame([(1, "lz4", 5, 9), (1, "zstd", 5, 9), (2, "zstd", 9, 9), (2, "lzma", 10, 9)], "id long, codec string, size long, original long")
    assert sorted(map(tuple, rollup.best_codec(df).collect())) == [(1, "zstd", 5), (2, "none", 9)]


def test_run_stats_of_published_runs(spark):
    df = spark.createDataFrame([("plain", 12.34), ("plain", 12.28), ("plain", 12.31), ("log", 8.45), ("log", 8.52), ("log", 8.48)], "mode string, seconds double")
    stats = rollup.run_stats(df, 1001)
    r = {x["mode"]: x for x in stats.collect()}
    assert round(r["plain"]["mean"], 2) == 12.31 and round(r["plain"]["deviation"], 2) == 0.02
    assert round(rollup.speed_up(stats, "plain", "log").first()["speed_up"], 2) == 1.45


def test_as_of_each(spark):
    v = spark.createDataFrame([("x", 3, 30), ("x", 5, 50)], "k string, valid_from long, value int")
    q = spark.createDataFrame([("x", 2), ("x", 3), ("x", 9), ("y", 9)], "k string, block long")
    got = {(r.k, r.block): r.value for r in state.as_of_each(q, v, ["k"]).collect()}
    assert got == {("x", 2): None, ("x", 3): 30, ("x", 9): 50, ("y", 9): None}


def test_rates_are_rounded_as_sql_rounds_them(spark):
    """Halves of hundredths, which are mostly not exact as binary numbers: 1.005 lies below the half."""
    import duckdb

    from blockloom.functions.scalars import ggas_per_s

    got = spark.range(0, 200_000, 5).select("id", ggas_per_s(F.col("id") * 1_000_000, F.lit(1.0)).alias("rate")).collect()
    assert {r.id: r.rate for r in got} == dict(duckdb.sql("SELECT n, round(n * 1000000 / 1e9, 2) FROM range(0, 200000, 5) AS r(n)").fetchall())
    assert {r.id: r.rate for r in got}[1005] == 1.0
