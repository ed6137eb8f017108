"""Registered queries of stores, payloads, executors and small functions, bound to the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions import codecs, entries, scalars
from blockloom.operators import compare, presence, rollup, state, tasks
from blockloom.plans import repair, replay
from blockloom.plans.queries import INDEX_SQL, log_bounds, log_index, query, requested, span, table
from blockloom.sources import files, logstore, segments, text

#: Payloads of documents: as many entries as the id modulo 4, of two bytes each.
PAYLOAD_SQL = "p AS (SELECT doc_id AS block, doc_id % 4 AS n, 8 + 3 * (doc_id % 4) AS length FROM documents), o AS (SELECT *, CAST(32 + coalesce(sum(length) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", row_number() OVER (ORDER BY block) - 1 AS append_pos FROM p)"
WITH_DATA = "block long, data binary"


def byte(c, n: int = 1):
    return F.unhex(F.lpad(F.hex(c), 2 * n, "0"))


def payloads(spark, sf) -> DataFrame:
    b = F.col("block")
    own = F.transform(F.sequence(F.lit(1), b % 4), lambda k: F.concat(byte(b % 256), byte(k)))
    x = requested(spark, sf).withColumn("entries", F.when(b % 4 > 0, own).otherwise(F.array().cast("array<binary>")))
    return x.select("block", entries.encode_entries_udf("entries").alias("data"))


def n_entries():
    return F.size(entries.decode_entries_udf("data")).cast("long").alias("n")


def new_store(spark, sf, layout: str = "v2") -> str:
    folder = files.scratch(spark, "store")
    logstore.write_store(payloads(spark, sf), folder, layout)
    return folder


def plant(spark, folder: str, faults) -> None:
    """Adds index rows: faults gives those that follow the row of a block."""
    rows = [(r["block"], r["offset"], r["length"]) for r in logstore.read_store(spark, folder, with_data=False).orderBy("append_pos").toLocalIterator()]
    logstore.write_index(folder, "v2", [x for r in rows for x in (r, *faults(r))])


@query(f"WITH {PAYLOAD_SQL} SELECT append_pos, block, \"offset\", length, n FROM o")
def store_roundtrip(spark, sf):
    return logstore.read_store(spark, new_store(spark, sf)).select("append_pos", "block", "offset", "length", n_entries())


@query("SELECT doc_id AS block, doc_id % 4 AS n FROM documents")
def store_of_packed_records(spark, sf):
    return logstore.read_store(spark, new_store(spark, sf, "file"), "file").select("block", n_entries())


def _faulty(spark, sf) -> str:
    """Some blocks have a second row, which points to the first payload; others one that is invalid, or one of zeros."""
    folder = new_store(spark, sf)

    def faults(r):
        return [(r[0], 32, 8)] * (r[0] % 7 == 0) + [(r[0], 5, 8)] * (r[0] % 11 == 0) + [(0, 0, 0)] * (r[0] % 29 == 0)

    plant(spark, folder, faults)
    return folder


@query(f"WITH {PAYLOAD_SQL} SELECT block, CASE WHEN block % 7 = 0 THEN 32 ELSE \"offset\" END AS \"offset\", CASE WHEN block % 7 = 0 THEN 8 ELSE length END AS length, CASE WHEN block % 7 = 0 THEN 0 ELSE n END AS n FROM o")
def store_open(spark, sf):
    """The first payload is that of block 0, which has no entries."""
    return logstore.open_store(spark, _faulty(spark, sf)).select("block", "offset", "length", n_entries())


@query("SELECT count(*) AS skipped FROM documents WHERE doc_id % 11 = 0")
def store_skipped_rows(spark, sf):
    return spark.createDataFrame([(logstore.skipped_rows(spark, _faulty(spark, sf)),)], "skipped long")


@query("SELECT doc_id AS block, CAST(1 AS BIGINT) AS copies, doc_id % 4 AS n FROM documents")
def store_resume(spark, sf):
    """Half is written, some of it marked as corrupt, then all is written: each block is there once."""
    folder = files.scratch(spark, "store")
    all_ = payloads(spark, sf)
    logstore.write_store(all_.where("block % 2 = 0"), folder)
    marked = [r["block"] for r in requested(spark, sf).where("block % 50 = 0").toLocalIterator()]
    logstore.drop_from_index(spark, folder, marked)
    logstore.write_store(all_, folder)
    return logstore.read_store(spark, folder).select("block", n_entries()).groupBy("block").agg(F.count("*").alias("copies"), F.max("n").alias("n"))


def _repaired(spark, sf, compact: bool) -> DataFrame:
    """Every 13th block's payload is cut short; the first row of a repeated block is as good as the last."""
    folder = new_store(spark, sf)
    rows = [(r["block"], r["offset"], r["length"]) for r in logstore.read_store(spark, folder, with_data=False).orderBy("append_pos").toLocalIterator()]
    logstore.write_index(folder, "v2", [x for b, o, n in rows for x in ([(b, o, 5 if b % 13 == 5 else n)] + [(b, o, n)] * (b % 17 == 0 and b % 13 != 5))])
    first, last = rows[0][0], rows[-1][0]
    repair.repair_store(spark, folder, first, last, compact=compact)
    return logstore.read_store(spark, folder).select("block", "offset", "length", n_entries())


@query(f"WITH {PAYLOAD_SQL} SELECT block, CAST(32 + coalesce(sum(length) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", length, n FROM p WHERE block % 13 <> 5")
def store_repair(spark, sf):
    return _repaired(spark, sf, compact=True)


@query(f"WITH {PAYLOAD_SQL} SELECT block, \"offset\", length, n FROM o WHERE block % 13 <> 5")
def store_rebuild(spark, sf):
    return _repaired(spark, sf, compact=False)


@query(f"WITH {PAYLOAD_SQL} SELECT append_pos, block, \"offset\", length, n FROM o")
def store_migration(spark, sf):
    """A store of one file, made of a store of two, becomes one of two again."""
    source, old, new = new_store(spark, sf), files.scratch(spark, "old"), files.scratch(spark, "new")
    data, index = logstore.paths(source, "v2")
    begin, n = logstore.index_span(source, "v2")
    size = files.size(data)
    files.make_folder(old)
    with files.writer(logstore.paths(old, "v1")[0]) as out, files.reader(data) as body:
        out.write((logstore.V1_MAGIC + (1).to_bytes(4, "little") + n.to_bytes(8, "little") + size.to_bytes(8, "little")).ljust(32, b"\0"))
        body.seek(logstore.HEADER)
        while chunk := body.read(1 << 20):
            out.write(chunk)
        out.write(files.read_range(index, begin, n * logstore.ROW["v1"].size))
    logstore.migrate_v1(old, new)
    return logstore.read_store(spark, new).select("append_pos", "block", "offset", "length", n_entries())


@query("SELECT doc_id AS block, doc_id % 4 AS n FROM documents")
def store_of_segments(spark, sf):
    """Some blocks are written first, with a payload that is corrupt for every tenth; then all."""
    folder = files.scratch(spark, "segments")
    all_ = payloads(spark, sf)
    segments.append(all_.where("block % 3 = 0").withColumn("data", F.when(F.col("block") % 10 == 0, F.substring("data", 1, 4)).otherwise(F.col("data"))), folder)
    segments.append(all_, folder)
    return segments.read(spark, folder).select("block", n_entries())


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'storage' WHEN 1 THEN 'account' WHEN 2 THEN 'storage' WHEN 3 THEN 'account' WHEN 4 THEN 'account' ELSE 'storage' END AS kind FROM documents")
def typed_entries(spark, sf):
    """Entries without kinds: a small number, a zero byte, the empty number, a list, a long string, a number of two bytes."""
    cases = F.array(*[F.unhex(F.lit(x)) for x in ("05", "00", "80", "C180", "B8" + "28" * 40, "821234")])
    one = F.element_at(cases, (F.col("doc_id") % 6 + 1).cast("int"))
    x = table(spark, sf, "documents").select("doc_id", entries.encode_entries_udf(F.array(one)).alias("payload"))
    return x.select("doc_id", F.explode(entries.typed_entries_udf("payload")).alias("e")).select("doc_id", "e.kind")


@query("SELECT doc_id, doc_id % 6 IN (0, 3, 5) AS valid, doc_id % 6 IN (0, 2, 3, 5) AS plausible FROM documents")
def payload_checks(spark, sf):
    """An entry, a count that is too large, an entry cut short, bytes behind the last entry, fewer than 8 bytes, no entries."""
    cases = F.array(*[F.unhex(F.lit(x)) for x in ("0100000000000000" + "020102", "41420F0000000000" + "00", "0100000000000000" + "0501", "0100000000000000" + "0101" + "FF", "010000", "0000000000000000")])
    x = table(spark, sf, "documents").select("doc_id", F.element_at(cases, (F.col("doc_id") % 6 + 1).cast("int")).alias("payload"))
    return x.select("doc_id", entries.valid_payload_udf("payload").alias("valid"), entries.plausible_payload_udf("payload").alias("plausible"))


LAST_SQL = "l AS (SELECT block, arg_max(strict, append_pos) AS strict, arg_max(ok, append_pos) AS ok FROM judged GROUP BY block)"


@query(f"WITH {INDEX_SQL}, {LAST_SQL} SELECT doc_id AS block, coalesce(strict, false) AS \"exists\", coalesce(strict AND ok, false) AS with_content FROM documents LEFT JOIN l ON doc_id = block")
def block_exists(spark, sf):
    index = log_index(spark, sf).withColumn("data", F.unhex(F.when(F.col("ok"), "0100000000000000020102").otherwise("01000000000000000201")))
    end = log_bounds(spark, sf)[0]
    x = presence.exists(requested(spark, sf), index.drop("data"), end)
    return presence.exists(x.withColumnRenamed("exists", "plain"), index, end, content=True).select("block", F.col("plain").alias("exists"), F.col("exists").alias("with_content"))


@query(f"WITH {INDEX_SQL}, {LAST_SQL} SELECT block FROM l WHERE NOT (strict AND ok)")
def corrupted_blocks(spark, sf):
    index = log_index(spark, sf).withColumn("data", F.unhex(F.when(F.col("ok"), "0100000000000000").otherwise("41420F0000000000")))
    return presence.corrupted(index, log_bounds(spark, sf)[0])


@query(f"WITH {INDEX_SQL}, s AS (SELECT min(block) AS lo, max(block) AS hi FROM idx) SELECT doc_id AS block, doc_id BETWEEN lo AND hi AS in_range FROM documents, s")
def block_in_range(spark, sf):
    return presence.in_range(requested(spark, sf), log_index(spark, sf))


@query("SELECT c_custkey AS account, CASE WHEN c_nationkey % 3 > 0 THEN 'h' || c_nationkey END AS code_hash, CASE WHEN c_nationkey % 3 > 0 THEN n_name END AS code FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def code_lookup(spark, sf):
    accounts = table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), F.when(F.col("c_nationkey") % 3 == 0, scalars.EMPTY_CODE).otherwise(F.concat(F.lit("h"), "c_nationkey")).alias("code_hash"))
    codes = table(spark, sf, "nation").select(F.concat(F.lit("h"), "n_nationkey").alias("code_hash"), F.col("n_name").alias("code"))
    return state.code_of(accounts, codes).select("account", "code_hash", "code")


@query("SELECT doc_id, 1 + doc_id % 120 AS nonce, lpad('', 60, '0') || printf('%04X', 32768 + doc_id % 1000) AS balance, CASE doc_id % 4 WHEN 2 THEN upper('c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470') WHEN 3 THEN repeat('02', 32) END AS root, CASE doc_id % 4 WHEN 1 THEN repeat('01', 32) WHEN 3 THEN repeat('01', 32) ELSE upper('c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470') END AS code FROM documents")
def account_decode(spark, sf):
    """RLP accounts without hashes, with the code's, with the empty code's (which counts as a root), with both."""
    d, empty = F.col("doc_id"), scalars.EMPTY_CODE.upper()
    body = F.concat(F.lpad(F.hex(1 + d % 120), 2, "0"), F.lit("82"), F.lpad(F.hex(32768 + d % 1000), 4, "0"))
    hashes = F.element_at(F.array(*map(F.lit, ("", "A0" + "01" * 32, "A0" + empty, "A0" + "02" * 32 + "A0" + "01" * 32))), (d % 4 + 1).cast("int"))
    head = F.element_at(F.array(*map(F.lit, ("C4", "E5", "E5", "F846"))), (d % 4 + 1).cast("int"))
    x = table(spark, sf, "documents").select("doc_id", entries.account_udf(scalars.EMPTY_CODE)(F.unhex(F.concat(head, body, hashes))).alias("a"))
    return x.select("doc_id", F.col("a.nonce").cast("long").alias("nonce"), F.hex("a.balance").alias("balance"), F.hex("a.storage_root").alias("root"), F.hex("a.code_hash").alias("code"))


@query("SELECT doc_id, true AS zstd, true AS lz4, true AS lzma, 'packed' AS packed, 'raw' AS raw FROM documents WHERE text <> ''")
def codec_roundtrip(spark, sf):
    return codecs.round_trips(table(spark, sf, "documents").where("text <> ''"), "doc_id", "text", ("zstd", "lz4", "lzma"))


def _users(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("block")).distinct()


def _adding(block: int, reader) -> int:
    """Adds its number to what the earlier blocks of its task have written."""
    before = reader.basic(b"sum")
    total = block + (int.from_bytes(before, "big") if before else 0)
    reader.write(b"sum", None, total.to_bytes(8, "big"))
    return total


@query("SELECT block, CAST(sum(block) OVER (PARTITION BY block // 100 ORDER BY block) AS BIGINT) AS result FROM (SELECT DISTINCT user_id AS block FROM events)")
def execute_tasks(spark, sf):
    none = spark.createDataFrame([], "block long, address binary, slot binary, value binary")
    return replay.execute(_users(spark, sf), none, _adding, step=100)


def _accounts(spark, sf, n: int) -> DataFrame:
    x = _users(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, range(n)))))
    return x.select("block", byte(F.col("k")).alias("address"), F.lit(None).cast("binary").alias("slot"), byte(1 + (F.col("block") + F.col("k")) % 200, 2).alias("value"))  # two bytes: one byte C0 is no account


def _reads(n: int):
    def executor(block: int, reader) -> int:
        total = 0
        for k in range(n):
            value = reader.basic(bytes([k]))
            total = total * 7 + (int.from_bytes(value, "big") if value else 0)
        return total

    return executor


@query("SELECT DISTINCT user_id AS block, CAST((1 + user_id % 200) * 49 + (1 + (user_id + 1) % 200) * 7 AS BIGINT) AS zero, CAST((1 + user_id % 200) * 49 + (1 + (user_id + 1) % 200) * 7 + 1 + (user_id + 2) % 200 AS BIGINT) AS fallback FROM events")
def replay_exhausted(spark, sf):
    """The record has two reads, the executor asks for a third."""
    users, known = _users(spark, sf), _accounts(spark, sf, 3)
    logs = replay.payloads(replay.record(users, known, _reads(2)))
    zero = replay.replay(users, logs, _reads(3), "zero").select("block", F.col("result").alias("zero"))
    return zero.join(replay.replay(users, logs, _reads(3), "fallback", known).select("block", F.col("result").alias("fallback")), "block")


@query("SELECT DISTINCT user_id AS block, CAST((1 + user_id % 200) * 7 + 1 + (user_id + 1) % 200 AS BIGINT) AS result, 'log' AS status FROM events")
def replay_single_files(spark, sf):
    """A file for each block, written and read back."""
    users, folder = _users(spark, sf), files.scratch(spark, "single")
    text.write_single_files(replay.payloads(replay.record(users, _accounts(spark, sf, 2), _reads(2))), folder)
    return replay.replay(users, text.read_single_files(spark, folder).withColumnRenamed("record", "data"), _reads(2))


def _code_and_hash(block: int, reader) -> int:
    return len(reader.code_by_hash(b"h") or b"") * 1000 + reader.block_hash(block - 1)[-1]


@query("SELECT DISTINCT user_id AS block, CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1000 * (1 + user_id % 5) END + CASE WHEN user_id % 2 = 0 THEN user_id % 250 ELSE 0 END AS BIGINT) AS result, CAST(0 AS BIGINT) AS recorded FROM events")
def code_and_hash_reads(spark, sf):
    """Codes and block hashes come from the state and are not recorded."""
    users, b = _users(spark, sf), F.col("block")
    codes = users.where("block % 3 > 0").select("block", F.lit(b"h").alias("code_hash"), F.expr("cast(repeat('x', cast(1 + block % 5 as int)) as binary)").alias("code"))
    hashes = users.where("block % 2 = 0").select("block", (b - 1).alias("number"), F.concat(F.unhex(F.lit("00" * 31)), byte(b % 250)).alias("hash"))
    none = spark.createDataFrame([], "block long, address binary, slot binary, value binary")
    return replay.record(users, none, _code_and_hash, codes=codes, hashes=hashes).groupBy("block", "result").agg(F.count("seq").alias("recorded"))


@query("SELECT bucket, CAST(max(last) OVER w AS BIGINT) AS block, blocks, txs, round(gas / 1e9, 2) AS ggas_per_s, CAST(sum(txs) OVER w AS BIGINT) AS total_txs, CAST(sum(gas) OVER w AS BIGINT) AS total_gas FROM (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS bucket, max(event_id) AS last, count(*) AS blocks, CAST(sum(user_id) AS BIGINT) AS txs, CAST(sum(CAST(floor(value) AS BIGINT) * 1000000) AS BIGINT) AS gas FROM events GROUP BY 1) WINDOW w AS (ORDER BY bucket)")
def progress_lines(spark, sf):
    ticks = table(spark, sf, "events").select("ts", F.col("event_id").alias("number"), F.col("user_id").alias("txs"), (F.floor("value").cast("long") * 1_000_000).alias("gas"))
    return rollup.progress(ticks, F.unix_timestamp(F.date_trunc("hour", "ts")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 50 > c_custkey % 41 THEN 'begin lies behind end' WHEN c_custkey % 41 > 35 THEN 'end lies beyond the last block' END AS error FROM customer")
def range_checks(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", tasks.range_error(k % 50, k % 41, F.lit(35)).alias("error"))


@query("WITH s AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS z FROM orders) SELECT CAST(a + 1000 * k AS BIGINT) AS start, CAST(least(a + 1000 * k + 999, z) AS BIGINT) AS \"end\" FROM s, LATERAL (SELECT unnest(range((z - a) // 1000 + 1)) AS k)")
def interval_ranges(spark, sf):
    return tasks.intervals(spark, *span(spark, sf)[:2])


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'all' WHEN 3 THEN 'unknown' ELSE 'block' END AS mode, CASE WHEN c_custkey % 4 IN (1, 2) THEN c_custkey END AS block FROM customer")
def log_sources(spark, sf):
    k = F.col("c_custkey")
    flag = F.when(k % 4 == 0, "on").when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.concat(F.lit("/a/block_"), k, F.lit("_reads.bin"))).otherwise("other.bin")
    return table(spark, sf, "customer").select("c_custkey", scalars.log_source(flag).alias("f")).select("c_custkey", "f.*")


@query("WITH a AS (SELECT repeat('a', CAST(c_custkey % 5 AS INTEGER)) || c_custkey AS left_key, c_nationkey AS left_value FROM customer), b AS (SELECT repeat('a', CAST(s_suppkey % 5 AS INTEGER)) || s_suppkey AS right_key, s_nationkey AS right_value FROM supplier), x AS (SELECT *, row_number() OVER (ORDER BY left_key) AS pos FROM a WHERE length(left_key) > 3), y AS (SELECT *, row_number() OVER (ORDER BY right_key) AS pos FROM b WHERE length(right_key) > 3) SELECT pos, left_key, left_value, right_key, right_value, CASE WHEN right_key IS NULL THEN 'left_only' WHEN left_key IS NULL THEN 'right_only' WHEN left_key <> right_key THEN 'key' WHEN left_value IS DISTINCT FROM right_value THEN 'value' ELSE 'equal' END AS status FROM x FULL JOIN y USING (pos)")
def positional_compare_deep(spark, sf):
    """Nodes of depth 3 or less are skipped."""
    side = lambda t, k, v: table(spark, sf, t).select(F.concat(F.repeat(F.lit("a"), (F.col(k) % 5).cast("int")), F.col(k)).alias("key"), F.col(v).alias("value"))
    return compare.by_position(side("customer", "c_custkey", "c_nationkey"), side("supplier", "s_suppkey", "s_nationkey"), "key", "value", skip_depth=3)


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN printf('%08X', doc_id) END AS raw, CAST(doc_id % 4 AS INTEGER) AS blobs FROM documents")
def transaction_sources(spark, sf):
    """Transactions as hex with and without 0x, or as something else; sidecars as JSON."""
    d = F.col("doc_id")
    hex_ = F.lpad(F.hex(d), 8, "0")
    value = F.when(d % 3 == 0, hex_).when(d % 3 == 1, F.concat(F.lit("0x"), hex_)).otherwise("zz")
    sidecar = F.concat(F.lit('{"blobs": ['), F.expr("array_join(array_repeat('\"0x00\"', cast(doc_id % 4 as int)), ',')"), F.lit('], "commitments": [], "proofs": []}'))
    return table(spark, sf, "documents").select("doc_id", F.hex(text.raw_transaction(value)).alias("raw"), F.size(text.blobs(sidecar)["blobs"]).alias("blobs"))
