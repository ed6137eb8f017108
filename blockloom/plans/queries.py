"""The registered queries of the block operators, bound to the driver's tables, with their DuckDB SQL.

Blocks are orders, their transactions line items, gas the quantities; the
requested range is documents, what is already there labels; events are an
append log by user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.entries import decode_entries_udf, encode_entries_udf, u64_from_le, u64_to_le, valid_payload_udf
from blockloom.functions.scalars import block_of_file, code_from_store, code_to_store, ggas_per_s, gib, hexed, missing_account, ratio_percent, saved_percent, slot_key
from blockloom.operators import compare, index, ordered, profile, rollup, state, tasks
from blockloom.plans import repair, replay

#: The range of the registered queries is that of their table; it is split into about so many tasks.
TASKS = 100
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """number, tx_count, gas_used; blocks without transactions too."""
    txs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("number")).agg(F.count("*").alias("tx_count"), F.sum("l_quantity").cast("long").alias("gas_used"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("number")).join(txs, "number", "left").fillna(0, ["tx_count", "gas_used"])


BLOCKS_SQL = """blocks AS (
  SELECT o_orderkey AS number, CAST(count(l_orderkey) AS BIGINT) AS tx_count, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS gas_used
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""
SPAN_SQL = """span AS (SELECT a, z, step, CAST(greatest(1, ceil((z - a) / step)) AS BIGINT) AS n FROM (SELECT a, z, greatest(1, (z - a) // 100) AS step FROM (SELECT min(o_orderkey) AS a, max(o_orderkey) AS z FROM orders)))"""
TASK_SQL = "least(CAST(floor((number - a) / step) AS BIGINT), n - 1)"


def span(spark: SparkSession, sf: str) -> tuple[int, int, int]:
    """First and last block of the table, and the step."""
    r = table(spark, sf, "orders").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("z")).first()
    begin, end = (r["a"], r["z"]) if r["a"] is not None else (0, 0)
    return begin, end, max(1, (end - begin) // TASKS)


def log_index(spark: SparkSession, sf: str) -> DataFrame:
    """Events as index rows with planted faults: blocks that are absent, lengths of 0, offsets before the data and past its end, contents that are corrupt, also those of the first and the last blocks."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("append_pos"), "user_id", F.expr("user_id + user_id div 7").alias("block"))
    last = F.lit(e.agg(F.max("user_id")).first()[0])
    offset = F.when(F.col("append_pos") % 89 == 0, F.lit(5).cast("long")).otherwise(32 + F.col("append_pos") * 10)
    length = F.when(F.col("append_pos") % 97 == 0, 0).otherwise(10).cast("int")
    ok = (F.col("append_pos") % 53 != 0) & (F.col("user_id") % 11 != 3) & F.col("user_id").between(2, last - 4)
    return e.withColumns({"offset": offset, "length": length, "ok": ok}).drop("user_id")


def log_bounds(spark: SparkSession, sf: str) -> tuple[int, int, int]:
    """Where the data of the log ends, a little before the last rows do, and the range of blocks that is asked for, which ends a little before the last block."""
    r = log_index(spark, sf).agg(F.max("append_pos").alias("pos"), F.min("block").alias("a"), F.max("block").alias("z")).first()
    return (32 + 10 * r["pos"] - 15, r["a"], r["z"] - 2) if r["pos"] is not None else (32, 0, 0)


INDEX_SQL = """raw AS (SELECT event_id AS append_pos, user_id, user_id + user_id // 7 AS block, CASE WHEN event_id % 89 = 0 THEN 5 ELSE 32 + event_id * 10 END AS "offset", CASE WHEN event_id % 97 = 0 THEN 0 ELSE 10 END AS length FROM events),
bound AS (SELECT 32 + 10 * max(append_pos) - 15 AS fin, min(block) AS first, max(block) - 2 AS last, max(user_id) AS users FROM raw),
idx AS (SELECT append_pos, block, "offset", length, append_pos % 53 <> 0 AND user_id % 11 <> 3 AND user_id BETWEEN 2 AND users - 4 AS ok, fin, first, last FROM raw, bound),
judged AS (SELECT *, block >= 0 AND block < 100000000 AND "offset" >= 32 AND "offset" <= fin AND length > 0 AND length < 10000000 AS loose,
  block >= 0 AND block < 100000000 AND "offset" >= 32 AND "offset" <= fin AND length > 0 AND length < 10000000 AND "offset" + length <= fin AS strict FROM idx)"""


@query(f"WITH {SPAN_SQL} SELECT o_orderkey AS number FROM orders, span WHERE o_orderkey BETWEEN a AND z")
def block_range_scan(spark, sf):
    return tasks.scan(table(spark, sf, "orders").select(F.col("o_orderkey").alias("number")), *span(spark, sf)[:2])


@query("SELECT max(o_orderkey) AS last_block FROM orders")
def latest_block(spark, sf):
    return rollup.latest(table(spark, sf, "orders").select(F.col("o_orderkey").alias("number")))


@query(f"WITH {SPAN_SQL} SELECT CAST(t AS BIGINT) AS task, CAST(min(a + t * step) AS BIGINT) AS start, CAST(min(CASE WHEN t = n - 1 THEN z ELSE a + (t + 1) * step - 1 END) AS BIGINT) AS \"end\", count(o_orderkey) AS blocks FROM span, LATERAL (SELECT unnest(range(n)) AS t) LEFT JOIN orders ON {TASK_SQL.replace('number', 'o_orderkey')} = t GROUP BY t")
def task_split(spark, sf):
    begin, end, step = span(spark, sf)
    counted = table(spark, sf, "orders").groupBy(tasks.task_of(F.col("o_orderkey"), begin, end, step).alias("task")).agg(F.count("*").alias("blocks"))
    return tasks.tasks(spark, begin, end, step).join(counted, "task", "left").fillna(0, ["blocks"])


@query(f"WITH {BLOCKS_SQL}, {SPAN_SQL} SELECT {TASK_SQL} AS task, count(*) AS blocks, CAST(sum(tx_count) AS BIGINT) AS txs, CAST(sum(gas_used) AS BIGINT) AS gas, min(number) AS min_block, max(number) AS max_block FROM blocks, span GROUP BY 1")
def range_rollup(spark, sf):
    return rollup.by_task(blocks(spark, sf), *span(spark, sf))


@query(f"WITH {BLOCKS_SQL} SELECT count(*) AS blocks, CAST(sum(tx_count) AS BIGINT) AS txs, CAST(sum(gas_used) AS BIGINT) AS gas, min(number) AS min_block, max(number) AS max_block FROM blocks")
def range_totals(spark, sf):
    return rollup.totals(blocks(spark, sf))


def requested(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("block"))


def present(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("block"), "quality", "toxic")


@query("SELECT doc_id AS block FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf):
    return index.missing_from(requested(spark, sf), present(spark, sf))


@query("SELECT doc_id AS block, quality, toxic FROM documents JOIN labels USING (doc_id)")
def index_lookup(spark, sf):
    return index.look_up(requested(spark, sf), present(spark, sf))


@query("SELECT 9999999 - doc_id AS pos, doc_id AS block, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def batch_lookup_ordered(spark, sf):
    asked = requested(spark, sf).withColumn("pos", F.lit(9_999_999).cast("long") - F.col("block"))
    return index.look_up_all(asked, present(spark, sf)).orderBy("pos")


@query("SELECT doc_id AS block, CAST(coalesce(quality, CASE WHEN doc_id % 3 = 0 THEN 7 END) AS INTEGER) AS quality, CASE WHEN quality IS NOT NULL THEN 'log' WHEN doc_id % 3 = 0 THEN 'fallback' ELSE 'failed' END AS source FROM documents LEFT JOIN labels USING (doc_id)")
def replay_with_fallback(spark, sf):
    store = requested(spark, sf).withColumn("quality", F.when(F.col("block") % 3 == 0, 7))
    return index.with_fallback(requested(spark, sf), present(spark, sf), store, "quality")


@query(f"WITH {BLOCKS_SQL} SELECT count(*) AS blocks, CAST(sum(tx_count) AS BIGINT) AS txs, CAST(sum(gas_used) AS BIGINT) AS gas, min(number) AS min_block, max(number) AS max_block FROM blocks WHERE number IN (SELECT doc_id FROM labels)")
def processed_stats_semi(spark, sf):
    return rollup.totals(blocks(spark, sf).join(present(spark, sf).select(F.col("block").alias("number")), "number", "left_semi"))


@query("SELECT n AS block FROM (SELECT unnest(range((SELECT min(doc_id) FROM labels), (SELECT max(doc_id) FROM labels) + 1)) AS n) WHERE n NOT IN (SELECT doc_id FROM labels)")
def missing_blocks(spark, sf):
    return index.gaps(present(spark, sf))


MISSING_SQL = "m AS (SELECT n FROM (SELECT unnest(range((SELECT min(doc_id) FROM labels), (SELECT max(doc_id) FROM labels) + 1)) AS n) WHERE n NOT IN (SELECT doc_id FROM labels)), r AS (SELECT min(n) AS start, max(n) AS \"end\", count(*) AS blocks FROM (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM m) GROUP BY g)"


@query(f"WITH {MISSING_SQL} SELECT start, \"end\", blocks, CASE WHEN blocks = 1 THEN 'Block ' || start ELSE 'Blocks ' || start || ' - ' || \"end\" || ' (' || blocks || ' blocks)' END AS label FROM r ORDER BY start LIMIT 20")
def missing_ranges(spark, sf):
    return index.gap_ranges(index.gaps(present(spark, sf)), most=20)


@query(f"WITH {MISSING_SQL} SELECT min(start) AS first_missing, max(\"end\") AS last_missing, CAST(sum(blocks) AS BIGINT) AS missing, count(*) AS ranges FROM r")
def missing_summary(spark, sf):
    return ordered.islands(index.gaps(present(spark, sf)), "block").agg(F.min("start").alias("first_missing"), F.max("end").alias("last_missing"), F.sum("blocks").alias("missing"), F.count("*").alias("ranges"))


@query("SELECT user_id AS block, max(event_id) AS append_pos, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def dedupe_keep_last(spark, sf):
    return index.dedupe(table(spark, sf, "events").select(F.col("user_id").alias("block"), F.col("event_id").alias("append_pos"), "event_type"))


@query("SELECT user_id AS block, min(event_id) AS append_pos, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def dedupe_keep_first(spark, sf):
    return index.dedupe(table(spark, sf, "events").select(F.col("user_id").alias("block"), F.col("event_id").alias("append_pos"), "event_type"), keep="first")


@query("SELECT count(*) - count(DISTINCT user_id) AS duplicates FROM events")
def duplicate_count(spark, sf):
    return index.duplicates(table(spark, sf, "events").select(F.col("user_id").alias("block")))


@query(f"WITH {INDEX_SQL} SELECT append_pos, block, loose, strict FROM judged")
def index_validity(spark, sf):
    return log_index(spark, sf).select("append_pos", "block", index.valid(log_bounds(spark, sf)[0], strict=False).alias("loose"), index.valid(log_bounds(spark, sf)[0]).alias("strict"))


OFFSET_SQL = "o AS (SELECT doc_id AS block, n_chars AS length, CAST(32 + coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents)"


@query(f"WITH {OFFSET_SQL} SELECT block, length, \"offset\" FROM o")
def append_offsets(spark, sf):
    return index.offsets(table(spark, sf, "documents").select(F.col("doc_id").alias("block"), F.col("n_chars").alias("length")))


@query(f"WITH {OFFSET_SQL}, k AS (SELECT length, \"offset\" + 100 * CAST(floor(block / 5) AS BIGINT) AS \"offset\" FROM o), f AS (SELECT *, CASE WHEN lag(\"offset\" + length) OVER (ORDER BY \"offset\") = \"offset\" THEN 0 ELSE 1 END AS new FROM k), i AS (SELECT *, sum(new) OVER (ORDER BY \"offset\") AS island FROM f) SELECT min(\"offset\") AS \"begin\", CAST(sum(length) AS BIGINT) AS bytes, count(*) AS reads FROM i GROUP BY island")
def coalesce_reads(spark, sf):
    """All payloads, with a hole in the file before every fifth."""
    return index.coalesce_ranges(append_offsets(spark, sf).withColumn("offset", F.col("offset") + 100 * F.floor(F.col("block") / 5)))


@query(f"WITH {INDEX_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY append_pos) - 1 AS pos FROM judged), a AS (SELECT count(*) AS n, CAST(sum(CAST(strict AS BIGINT)) AS BIGINT) AS v, min(pos) FILTER (WHERE NOT strict) AS bad, arg_max(\"offset\" + length, pos) FILTER (WHERE strict) AS tail FROM p) SELECT n AS rows, v AS valid_rows, CAST(bad AS BIGINT) AS first_invalid, CAST(coalesce(bad, n) AS BIGINT) AS valid_before, CAST(tail AS BIGINT) AS last_valid_end, CAST(greatest(fin - coalesce(tail, 32), 0) AS BIGINT) AS orphaned_bytes FROM a, bound")
def corruption_analysis(spark, sf):
    return repair.analyse(log_index(spark, sf).drop("ok"), log_bounds(spark, sf)[0])


def _flat(report: DataFrame) -> DataFrame:
    return report.withColumn("missing_blocks", F.array_join(F.transform("missing_blocks", lambda b: b.cast("string")), ","))


def _report_sql(keep: str) -> str:
    repairing, pick = keep == "last", "arg_max" if keep == "last" else "arg_min"
    within = "strict AND block <= last" if repairing else "strict"
    return f"""WITH {INDEX_SQL}, one AS (SELECT block, {pick}(ok, append_pos) AS ok FROM judged WHERE {within} GROUP BY block),
w AS (SELECT count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS corrupt, count(*) AS n, min(block) FILTER (WHERE ok) AS lo, max(block) FILTER (WHERE ok) AS hi FROM one),
m AS (SELECT b FROM (SELECT unnest(range(greatest(first, lo), least(last, hi) + 1)) AS b FROM w, bound) WHERE b NOT IN (SELECT block FROM one WHERE ok)
      UNION SELECT block FROM one, bound WHERE NOT ok AND block BETWEEN first AND last),
l AS (SELECT coalesce(string_agg(CAST(b AS VARCHAR), ',' ORDER BY b), '') AS s, count(*) AS k, min(b) AS a, max(b) AS z FROM m),
t AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT strict) AS bad, count(*) FILTER (WHERE strict AND block > last) AS beyond, count(*) FILTER (WHERE strict AND block <= last) AS inr FROM judged)
SELECT total AS total_entries, valid AS valid_entries, bad + corrupt AS invalid_entries, CAST({"inr - n" if repairing else "0"} AS BIGINT) AS duplicate_entries, CAST({"beyond" if repairing else "0"} AS BIGINT) AS truncated_entries,
       lo AS min_block, hi AS max_block, s AS missing_blocks, {"total > bad" if repairing else "true"} AS repaired, CASE WHEN k > 0 THEN k || ' blocks are missing, ' || a || ' to ' || z END AS error_message FROM t, w, l"""


@query(_report_sql("last"))
def repair_report(spark, sf):
    return _flat(repair.repair_report(log_index(spark, sf), *log_bounds(spark, sf)))


@query(_report_sql("first"))
def rebuild_report(spark, sf):
    return _flat(repair.rebuild_report(log_index(spark, sf), *log_bounds(spark, sf)))


@query("SELECT *, CAST(sum(blocks) OVER (ORDER BY bucket) AS BIGINT) AS blocks_so_far, CAST(sum(gas) OVER (ORDER BY bucket) AS BIGINT) AS gas_so_far FROM (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS bucket, count(*) AS blocks, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS gas FROM events GROUP BY 1)")
def progress_deltas(spark, sf):
    ticks = table(spark, sf, "events").select("ts", F.floor("value").cast("long").alias("gas"))
    return rollup.deltas(ticks, F.unix_timestamp(F.date_trunc("hour", "ts")))


SIDES_SQL = "a AS (SELECT c_custkey AS left_key, c_nationkey AS left_value, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer), b AS (SELECT s_suppkey AS right_key, s_nationkey AS right_value, row_number() OVER (ORDER BY s_suppkey) AS pos FROM supplier)"


@query(f"WITH {SIDES_SQL} SELECT pos, left_key, left_value, right_key, right_value, CASE WHEN right_key IS NULL THEN 'left_only' WHEN left_key IS NULL THEN 'right_only' WHEN left_key <> right_key THEN 'key' WHEN left_value IS DISTINCT FROM right_value THEN 'value' ELSE 'equal' END AS status FROM a FULL JOIN b USING (pos)")
def positional_compare(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("value"))
    right = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("value"))
    return compare.by_position(left, right, "key", "value")


@query("WITH a AS (SELECT c_custkey AS key, c_nationkey AS value FROM customer), b AS (SELECT s_suppkey AS key, s_nationkey AS value FROM supplier) SELECT *, 'left' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'right' AS side FROM (FROM b EXCEPT ALL FROM a)")
def keyed_compare(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("value"))
    right = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("value"))
    return compare.by_key(left, right)


@query("SELECT stack, count(*) AS samples FROM (SELECT array_to_string(list_reverse(list(split_part(role, '<', 1) ORDER BY turn)[1:20]), ';') AS stack FROM conversations WHERE role IS NOT NULL GROUP BY conv_id) WHERE stack <> '' GROUP BY stack")
def stack_histogram(spark, sf):
    frames = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    stacks = table(spark, sf, "conversations").where("role is not null").groupBy("conv_id").agg(frames.alias("frames"))
    return profile.folded(stacks)


@query("SELECT event_type AS mode, count(*) AS runs, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS deviation, round(1001 / avg(value), 6) AS blocks_per_s FROM events GROUP BY 1")
def run_stats(spark, sf):
    x = rollup.run_stats(table(spark, sf, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("seconds")), 1001)
    return x.withColumns({c: F.round(c, 6) for c in ("mean", "deviation", "blocks_per_s")})


@query("WITH s AS (SELECT doc_id AS id, n_chars AS original, codec, size, o FROM documents, LATERAL (VALUES ('zstd', n_chars * (doc_id % 7 + 4) // 8, 1), ('brotli', n_chars * (doc_id % 5 + 4) // 8, 2), ('lzma', n_chars * (doc_id % 3 + 6) // 8, 3), ('lz4', n_chars, 4)) AS c(codec, size, o)) SELECT id, coalesce(arg_min(codec, size * 10 + o) FILTER (WHERE size < original), 'none') AS codec, CAST(coalesce(min(size) FILTER (WHERE size < original), any_value(original)) AS BIGINT) AS size FROM s GROUP BY id")
def best_codec(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("original"))
    of = lambda name, size: F.struct(F.lit(name).alias("codec"), F.expr(size).cast("long").alias("size"))
    made = F.array(of("zstd", "original * (id % 7 + 4) div 8"), of("brotli", "original * (id % 5 + 4) div 8"), of("lzma", "original * (id % 3 + 6) div 8"), of("lz4", "original"))
    return rollup.best_codec(d.withColumn("c", F.explode(made)).select("id", "original", "c.*"))


@query("SELECT user_id, max(event_id) AS valid_from, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id <= (SELECT max(event_id) FROM events) GROUP BY user_id")
def asof_state(spark, sf):
    versions = table(spark, sf, "events").select("user_id", F.col("event_id").alias("valid_from"), "event_type")
    """The state at the end of the last block."""
    return state.as_of(versions, versions.agg(F.max("valid_from")).first()[0] or 0, ["user_id"])


@query("SELECT a.user_id, a.event_id AS block, b.event_id AS valid_from, b.event_type FROM events a ASOF LEFT JOIN events b ON a.user_id = b.user_id AND a.event_id - 1 >= b.event_id")
def asof_each_parent(spark, sf):
    e = table(spark, sf, "events")
    versions = e.select("user_id", F.col("event_id").alias("valid_from"), "event_type")
    asked = e.select("user_id", (F.col("event_id") - 1).alias("block"))
    return state.as_of_each(asked, versions, ["user_id"]).withColumn("block", F.col("block") + 1)


@query("SELECT DISTINCT l_partkey AS p_partkey, p_brand, p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def state_version_lookup(spark, sf):
    return state.needed(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")), table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), ["p_partkey"])


@query("SELECT number, greatest(number - 1, 0) AS parent, round(100.0 * (number % 90) / 90, 6) AS ratio, CASE WHEN number % 7 > 0 THEN round(number * 1e6 / (number % 7 + 0.37) / 1e9, 2) END AS ggas, round(number / (1024.0 * 1024 * 1024), 12) AS gib, round(100.0 * greatest(90 - number % 100, 0) / 90, 6) AS saved, CASE WHEN number % 2 = 0 THEN number END AS of_file, '0x' || lower(hex(CAST(number AS VARCHAR))) AS hexed FROM (SELECT o_orderkey AS number FROM orders)")
def scalar_functions(spark, sf):
    n = table(spark, sf, "orders").select(F.col("o_orderkey").alias("number"))
    name = F.when(F.col("number") % 2 == 0, F.concat(F.lit("block_"), "number", F.lit("_reads.bin"))).otherwise("other.bin")
    number = F.col("number")
    return n.select("number", tasks.parent(number).alias("parent"), F.round(ratio_percent(number % 90, F.lit(90)), 6).alias("ratio"), ggas_per_s(number * 1e6, F.when(number % 7 > 0, number % 7 + 0.37).otherwise(0.0)).alias("ggas"), F.round(gib(number), 12).alias("gib"), F.round(saved_percent(F.lit(90), number % 100), 6).alias("saved"), block_of_file(name).alias("of_file"), hexed(number.cast("string").cast("binary")).alias("hexed"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'aa' END AS stored, CASE WHEN doc_id % 4 = 0 THEN 'c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470' ELSE 'aa' END AS restored, doc_id % 4 < 3 AS missing, repeat('0', 62) || CASE WHEN doc_id % 2 = 0 THEN '2A' ELSE '07' END AS slot FROM documents")
def account_sentinels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    code = F.when(F.col("doc_id") % 4 == 0, F.lit("c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470")).otherwise("aa")
    entry = F.unhex(F.element_at(F.array(F.lit(""), F.lit("00"), F.lit("C0"), F.lit("C180")), (F.col("doc_id") % 4 + 1).cast("int")))
    slot = F.unhex(F.when(F.col("doc_id") % 2 == 0, "2A").otherwise("07"))
    return d.select("doc_id", code_to_store(code).alias("stored"), code_from_store(code_to_store(code)).alias("restored"), missing_account(entry).alias("missing"), F.hex(slot_key(slot)).alias("slot"))


@query()
def encode_decode_roundtrip(spark, sf):
    """Entries of each conversation through the store's payload form and back; same says whether they are equal."""
    e = table(spark, sf, "conversations").select("conv_id", "turn", F.substring(F.sha1("text"), 1, 20).cast("binary").alias("data"))
    e = e.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "data"))), lambda x: x["data"]).alias("entries"))
    e = e.withColumn("payload", encode_entries_udf("entries"))
    return e.select("conv_id", F.size("entries").alias("n"), (decode_entries_udf("payload") == F.col("entries")).alias("same"), valid_payload_udf("payload").alias("valid"), (u64_from_le(u64_to_le("conv_id")) == F.col("conv_id")).alias("number_same"))


def _sum_reads(block: int, reader) -> int:
    """A stand-in executor: reads accounts in a fixed order and adds what they hold, by place."""
    total = 0
    for k in range(3):
        value = reader.basic(bytes([block % 251, k]))
        total = total * 7 + (int.from_bytes(value, "big") if value else 0)
    return total


def _state(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("block")).distinct()
    byte = lambda c, n=1: F.unhex(F.lpad(F.hex(c), 2 * n, "0"))
    x = users.withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    address = F.concat(byte(F.col("block") % 251), byte(F.col("k")))
    return users, x.select("block", address.alias("address"), F.lit(None).cast("binary").alias("slot"), byte(1 + (F.col("block") + F.col("k")) % 200, 2).alias("value"))  # two bytes: one byte C0 is no account


FOLD_SQL = "SELECT DISTINCT user_id AS block, CAST((1 + user_id % 200) * 49 + (1 + (user_id + 1) % 200) * 7 + 1 + (user_id + 2) % 200 AS BIGINT) AS result"


@query("SELECT user_id AS block, CAST(k AS INTEGER) AS seq, 'account' AS kind, CAST((1 + user_id % 200) * 49 + (1 + (user_id + 1) % 200) * 7 + 1 + (user_id + 2) % 200 AS BIGINT) AS result FROM (SELECT DISTINCT user_id FROM events), range(3) AS r(k)")
def record_reads(spark, sf):
    users, known = _state(spark, sf)
    return replay.record(users, known, _sum_reads).select("block", "seq", "kind", "result")


@query(f"{FOLD_SQL}, CASE WHEN user_id % 5 = 0 THEN 'fallback' ELSE 'log' END AS status FROM events")
def replay_reads(spark, sf):
    users, known = _state(spark, sf)
    logs = replay.payloads(replay.record(users, known, _sum_reads))
    logs = logs.withColumn("data", F.when(F.col("block") % 5 == 0, F.substring("data", 1, 4)).otherwise(F.col("data")))  # records that are cut short
    return replay.replay(users, logs, _sum_reads, state=known)


def _all() -> None:
    """The other module adds its queries when it is imported."""
    import blockloom.plans.store_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(ORACLES)
