import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.functions import codecs, entries


@given(st.lists(st.binary(max_size=255), max_size=20), st.binary(max_size=9))
def test_entries_round_trip_and_trailing_bytes(items, tail):
    payload = entries.encode_entries(items)
    assert entries.decode_entries(payload) == items
    assert entries.decode_entries(payload + tail) == items
    assert entries.valid_payload(payload, strict=True)
    assert entries.valid_payload(payload + tail, strict=True) == (not tail)


def test_entry_of_256_bytes():
    entries.encode_entries([b"x" * 255])
    with pytest.raises(ValueError):
        entries.encode_entries([b"x" * 256])


@pytest.mark.parametrize("payload", [None, b"", b"1234567", (1_000_001).to_bytes(8, "little"), (1).to_bytes(8, "little"), (1).to_bytes(8, "little") + b"\x05abc"])
def test_corrupt_payloads(payload):
    assert not entries.valid_payload(payload)


def test_empty_block_is_valid():
    assert entries.valid_payload(bytes(8))


@settings(deadline=None, max_examples=30)
@given(st.binary(max_size=3000), st.sampled_from([*codecs.CODECS, "auto", "ZSTD"]))
def test_records_round_trip(data, codec):
    record = codecs.pack_record(data, codec)
    assert len(record) <= len(data) + 1
    assert codecs.unpack_record(record) == data


def test_codec_errors_and_statistics():
    with pytest.raises(ValueError):
        codecs.codec_id("gzip")
    with pytest.raises(ValueError):
        codecs.unpack_record(b"\x09abc")
    with pytest.raises(ValueError):
        codecs.decompress(b"ab", "lz4")
    assert [s[0] for s in codecs.statistics(b"a" * 5000)] == ["zstd", "brotli", "lzma", "lz4"]


def test_accounts():
    empty, other = b"\xc5" * 32, b"\x01" * 32
    assert entries.decode_account(b"\xc2\x80\x80", empty) == (0, bytes(32), None, empty)
    body = b"\x01\x82\x03\xe8\xa0" + other
    assert entries.decode_account(bytes([0xC0 + len(body)]) + body, empty) == (1, (1000).to_bytes(32, "big"), None, other)
    body = b"\x01\x82\x03\xe8\xa0" + empty
    assert entries.decode_account(bytes([0xC0 + len(body)]) + body, empty)[2:] == (empty, empty)
    assert entries.decode_account(b"\x00", empty) is None and entries.decode_account(b"\xc0", empty) is None


def test_round_trips_hold_one_record_at_a_time(spark):
    """Texts stay in the task; no column of packed or unpacked texts is made of a whole batch."""
    from blockloom.plans.queries import queries

    plan = queries()["codec_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
    rows = spark.createDataFrame([(1, bytearray(b"a" * 500)), (2, bytearray(b"b")), (3, None), (4, bytearray())], "id long, t binary")
    got = {r.id: tuple(r)[1:] for r in codecs.round_trips(rows, "id", "t", ("zstd", "lz4", "lzma")).collect()}
    assert got == {1: (True, True, True, "packed", "raw"), 2: (True, True, True, "packed", "raw"), 3: (None,) * 5, 4: (True, True, True, "packed", "raw")}
