import pytest
from pyspark.sql import functions as F

from blockloom.plans import replay
from blockloom.streaming.ingest import ingest, read_blocks, retried, run_intervals


def executors():
    """Nested, so that they go to the workers by value."""

    def executor(block, reader):
        total = 0
        for k in range(block % 3):
            total += int.from_bytes(reader.basic(bytes([block, k])) or b"", "big") * 10 + int.from_bytes(reader.storage(bytes([block, k]), b"s"), "big")
        return total

    def longer(block, reader):
        return executor(block, reader) + int.from_bytes(reader.storage(bytes([block, 0]), b"s"), "big")

    return executor, longer


executor, longer = executors()


@pytest.fixture
def world(spark):
    blocks = spark.createDataFrame([(b,) for b in range(1, 7)], "block long")
    state = []
    for b in range(1, 7):
        for k in range(3):
            if (b + k) % 4:
                state.append((b, bytearray([b, k]), None, bytearray([b + k])))
            state.append((b, bytearray([b, k]), bytearray(b"s"), bytearray([k + 1])))
    return blocks, spark.createDataFrame(state, "block long, address binary, slot binary, value binary")


def test_replay_equals_record(world):
    blocks, state = world
    recorded = replay.record(blocks, state, executor).cache()
    logs = replay.payloads(recorded)
    assert logs.count() == 6  # empty blocks have a payload too
    want = {r.block: r.result for r in recorded.select("block", "result").distinct().collect()}
    got = replay.replay(blocks, logs, executor).collect()
    assert {r.block: r.result for r in got} == want and {r.status for r in got} == {"log"}
    fallback = replay.replay(blocks, logs.where("block > 3"), executor, state=state).collect()
    assert {r.block: r.result for r in fallback} == want
    assert {r.block: r.status for r in fallback} == {b: "log" if b > 3 else "fallback" for b in range(1, 7)}
    assert {r.status for r in replay.replay(blocks, logs.limit(0), executor).collect()} == {"failed"}


def test_exhausted_logs(world):
    blocks, state = world
    recorded = replay.record(blocks, state, executor)
    logs = replay.payloads(recorded)
    base = {r.block: r.result for r in recorded.select("block", "result").distinct().collect()}
    zero = {r.block: r.result for r in replay.replay(blocks, logs, longer, "zero", state).collect()}
    more = {r.block: r.result for r in replay.replay(blocks, logs, longer, "fallback", state).collect()}
    assert zero == base and more == {b: n + 1 for b, n in base.items()}


def test_fallback_of_a_block_that_reads_nothing(spark):
    """A corrupt record of a block without state: the fallback has nothing to read, but runs."""
    blocks = spark.createDataFrame([(1,)], "block long")
    logs = spark.createDataFrame([(1, bytearray(b"abc"))], "block long, data binary")
    none = spark.createDataFrame([], "block long, address binary, slot binary, value binary")
    assert [(r.result, r.status) for r in replay.replay(blocks, logs, lambda block, reader: 7, state=none).collect()] == [(7, "fallback")]
    assert [r.status for r in replay.replay(blocks, logs, lambda block, reader: 7).collect()] == ["failed"]


def test_stream_resumes_without_doubles(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.range(0, 10).select(F.col("id").alias("block")).coalesce(1).write.parquet(source)
    ingest(read_blocks(spark, source, "block long"), target, check).awaitTermination()
    spark.range(5, 20).select(F.col("id").alias("block")).coalesce(1).write.mode("append").parquet(source)
    ingest(read_blocks(spark, source, "block long"), target, check).awaitTermination()
    assert sorted(r.block for r in spark.read.parquet(target).collect()) == list(range(20))
    ingest(read_blocks(spark, source, "block long"), target, str(tmp_path / "lost")).awaitTermination()
    assert spark.read.parquet(target).count() == 20


def test_intervals_and_retries():
    seen = []
    assert run_intervals(0, 25, lambda a, b: seen.append((a, b)), 10, checkpoint=10) == 26
    assert seen == [(10, 19), (20, 25)]
    assert run_intervals(0, 25, lambda a, b: None, 10, stop=lambda: True) == 0
    tries = []
    assert retried(lambda: tries.append(1) or (len(tries) < 3 and 1 / 0) or "ok", wait_s=0) == "ok"
    with pytest.raises(ZeroDivisionError):
        retried(lambda: 1 / 0, times=2, wait_s=0)


def test_a_sign_for_no_account_is_the_same_in_state_and_record(spark):
    blocks = spark.createDataFrame([(b,) for b in range(4)], "block long")
    state = spark.createDataFrame([(b, bytearray(b"a"), None, bytearray(v)) for b, v in enumerate((b"", b"\x00", b"\xc0", b"\x00\xc0"))], "block long, address binary, slot binary, value binary")
    executor = lambda block, reader: {None: -1}.get(v := reader.basic(b"a"), len(v or b""))
    recorded = replay.record(blocks, state, executor)
    want = {0: -1, 1: -1, 2: -1, 3: 2}
    assert {r.block: r.result for r in recorded.collect()} == want
    assert {r.block: r.result for r in replay.replay(blocks, replay.payloads(recorded), executor).collect()} == want


@pytest.mark.parametrize("name", ["replay_exhausted", "replay_single_files", "replay_reads"])
def test_queries_of_users_beyond_the_small_tables(spark, tmp_path, name):
    """User 191 and its neighbours hold 192, which as one byte is the old sign for no account."""
    import duckdb

    from blockloom.plans.queries import oracle_sql, queries

    spark.createDataFrame([(n,) for n in range(185, 215)], "user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
