import os

import pytest
from pyspark.sql import functions as F

from blockloom.functions.entries import encode_entries
from blockloom.plans.repair import repair_store
from blockloom.sources import logstore, text


def payload(block):
    return encode_entries([bytes([block % 256, k]) for k in range(block % 4)])


def frame(spark, blocks):
    return spark.createDataFrame([(b, bytearray(payload(b))) for b in blocks], "block long, data binary")


@pytest.mark.parametrize("layout", ["v2", "file"])
def test_write_read_and_resume(spark, tmp_path, layout):
    folder = str(tmp_path / "store")
    logstore.write_store(frame(spark, range(0, 30)), folder, layout)
    before = os.path.getsize(logstore.paths(folder, layout)[0])
    logstore.write_store(frame(spark, range(10, 40)), folder, layout)
    rows = logstore.read_store(spark, folder, layout).collect()
    assert {r.block: bytes(r.data) for r in rows} == {b: payload(b) for b in range(40)} and len(rows) == 40
    logstore.write_store(frame(spark, range(40)), folder, layout)
    assert os.path.getsize(logstore.paths(folder, layout)[0]) > before
    assert logstore.index_span(folder, layout)[1] == 40
    assert not [f for f in os.listdir(folder) if f.startswith(".part")]


def test_short_last_row_and_low_header_count(spark, tmp_path):
    folder = str(tmp_path)
    logstore.write_store(frame(spark, range(8)), folder)
    index = logstore.paths(folder, "v2")[1]
    with open(index, "r+b") as f:
        f.seek(12)
        f.write((3).to_bytes(8, "little"))
        f.seek(0, 2)
        f.write(b"\x01" * 7)
    assert logstore.read_store(spark, folder, with_data=False).count() == 8


def test_bad_magic(spark, tmp_path):
    for path in logstore.paths(str(tmp_path), "v2"):
        with open(path, "wb") as f:
            f.write(b"WRONG".ljust(64, b"\0"))
    with pytest.raises(ValueError):
        logstore.index_span(str(tmp_path), "v2")


def test_reads_of_neighbours_keep_the_order_asked_for(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(bytes(range(50)))
    ranges = [(20, 5), (0, 10), (10, 10), (48, 5), (25, 1)]
    assert logstore.read_payloads(str(path), ranges) == [bytes(range(20, 25)), bytes(range(10)), bytes(range(10, 20)), None, bytes([25])]


@pytest.mark.parametrize("compact", [True, False])
def test_repair_of_planted_faults(spark, tmp_path, compact):
    folder = str(tmp_path / "store")
    logstore.write_store(frame(spark, [1, 2, 3, 5, 6, 9, 12]), folder)
    rows = [r[1:] for r in logstore.read_rows(folder, "v2", 0, 7)]
    by = {r[0]: r for r in rows}
    bad = (6, by[6][1] + 3, 9)  # content that can't be read
    rows = [*rows[:4], bad, *rows[5:], (100_000_000, 40, 8), (7, 5, 8), (8, 40, 0), (2, by[3][1], by[3][2])]
    logstore.write_index(folder, "v2", rows)
    report = repair_store(spark, folder, 0, 10, compact=compact)
    # without compaction nothing is truncated: 12 is written, and 10 lies before it
    assert report["total_entries"] == 11 and report["repaired"] and report["missing_blocks"] == ([4, 6, 7, 8] if compact else [4, 6, 7, 8, 10])
    got = {r.block: bytes(r.data) for r in logstore.read_store(spark, folder).collect()}
    want = {b: payload(b) for b in (1, 2, 3, 5, 9)} | ({2: payload(3)} if compact else {12: payload(12)})
    assert got == want
    assert report["duplicate_entries"] == (1 if compact else 0) and report["truncated_entries"] == (1 if compact else 0)


def test_drop_and_write_again(spark, tmp_path):
    folder = str(tmp_path)
    logstore.write_store(frame(spark, range(5)), folder)
    logstore.drop_from_index(spark, folder, [3])
    assert logstore.read_store(spark, folder, with_data=False).count() == 4
    logstore.write_store(frame(spark, range(5)), folder)
    assert {r.block for r in logstore.read_store(spark, folder).collect()} == set(range(5))


def test_v1_migration(spark, tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    old.mkdir()
    a, b = payload(1), payload(2)
    index = logstore.ROW["v1"].pack(1, 32, len(a)) + logstore.ROW["v1"].pack(2, 32 + len(a), len(b))
    head = (logstore.V1_MAGIC + (1).to_bytes(4, "little") + (2).to_bytes(8, "little") + (32 + len(a) + len(b)).to_bytes(8, "little")).ljust(32, b"\0")
    (old / logstore.FILES["v1"][0]).write_bytes(head + a + b + index)
    assert logstore.migrate_v1(str(old), str(new)) == 2
    assert {r.block: bytes(r.data) for r in logstore.read_store(spark, str(new)).collect()} == {1: a, 2: b}
    assert os.listdir(old) == [logstore.FILES["v1"][0] + ".backup"]


def test_text_log_and_specs(spark, tmp_path):
    reads = spark.createDataFrame([(7, 0, "account", bytearray(b"\x01\x02"), None, bytearray(b"\xff")), (7, 1, "storage", bytearray(b"\x01\x02"), bytearray(b"\x09"), bytearray(b"\x00"))], "block long, seq int, kind string, address binary, key binary, data binary")
    text.write_text_log(reads, str(tmp_path / "log"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert lines == ["0x0102, 0xff", "0x0102 0x09, 0x00"]
    back = text.read_text_log(spark, str(tmp_path / "log")).orderBy("kind").collect()
    assert [(r.block, r.kind, bytes(r.data)) for r in back] == [(7, "account", b"\xff"), (7, "storage", b"\x00")]
    (tmp_path / "block_12_reads.bin").write_bytes(b"abc")
    assert [(r.block, bytes(r.record)) for r in text.read_single_files(spark, str(tmp_path)).collect()] == [(12, b"abc")]
    assert text.chain_spec("dev") == {"name": "dev"} and text.chain_spec('{"a": 1}') == {"a": 1}
    assert [r.raw if r.raw is None else bytes(r.raw) for r in text.transactions(spark, ["0x0102", "ff"]).orderBy("pos").collect()] == [b"\x01\x02", b"\xff"]


def test_blocks_to_drop_are_walked_once(tmp_path):
    """Not once for each row of the index."""

    class Walked(list):
        times = 0

        def __iter__(self):
            Walked.times += 1
            return super().__iter__()

    folder = str(tmp_path)
    for name, magic in zip(logstore.FILES["v2"], (logstore.DATA_MAGIC, logstore.INDEX_MAGIC), strict=True):
        (tmp_path / name).write_bytes((magic + (2).to_bytes(4, "little")).ljust(32, b"\0"))
    logstore.write_index(folder, "v2", [(b, 32 + b, 8) for b in range(100)])
    logstore.drop_from_index(None, folder, Walked([-1, 3, 97, 1000]))
    assert logstore.read_rows(folder, "v2", 0, 200) == [(k, b, 32 + b, 8) for k, b in enumerate(b for b in range(100) if b not in (3, 97))]
    assert Walked.times == 1
