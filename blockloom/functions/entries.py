"""Binary payloads: entries, little-endian numbers, account records. Plain functions, and Arrow-batched UDFs of them.

A payload is a count (8 bytes, little-endian), then so many entries of a
length byte and its data. Bytes after the last entry are allowed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_ENTRIES, LONGEST_ENTRY = 1_000_000, 255


def encode_entries(entries: list[bytes]) -> bytes:
    for e in entries:
        if len(e) > LONGEST_ENTRY:
            raise ValueError(f"an entry of {len(e)} bytes; {LONGEST_ENTRY} at most")
    return len(entries).to_bytes(8, "little") + b"".join(bytes([len(e)]) + e for e in entries)


def decode_entries(payload: bytes | None) -> list[bytes] | None:
    """None if the payload is corrupt."""
    if payload is None or len(payload) < 8:
        return None
    n, at, out = int.from_bytes(payload[:8], "little"), 8, []
    if n > MOST_ENTRIES:
        return None
    for _ in range(n):
        if at >= len(payload):
            return None
        end = at + 1 + payload[at]
        if end > len(payload):
            return None
        out.append(payload[at + 1 : end])
        at = end
    return out


def valid_payload(payload: bytes | None, strict: bool = False) -> bool:
    """strict: nothing may follow the last entry."""
    entries = decode_entries(payload)
    return entries is not None and (not strict or len(payload) == 8 + sum(1 + len(e) for e in entries))


def plausible_payload(payload: bytes | None) -> bool:
    """The weaker test: the count alone."""
    return payload is not None and len(payload) >= 8 and int.from_bytes(payload[:8], "little") <= MOST_ENTRIES


def rlp_items(data: bytes) -> list[bytes]:
    """The items of an RLP list of strings."""

    def head(at: int) -> tuple[bool, int, int]:
        b = data[at]
        if b < 0x80:
            return False, at, at + 1
        is_list = b >= 0xC0
        short = b - (0xC0 if is_list else 0x80)
        if short <= 55:
            return is_list, at + 1, at + 1 + short
        k = short - 55
        start = at + 1 + k
        return is_list, start, start + int.from_bytes(data[at + 1 : start], "big")

    is_list, at, end = head(0)
    if not is_list or end > len(data):
        raise ValueError("not an RLP list")
    out = []
    while at < end:
        inner, start, stop = head(at)
        if inner or stop > end:
            raise ValueError("not an RLP list of strings")
        out.append(data[start:stop])
        at = stop
    return out


def decode_account(data: bytes | None, empty_code: bytes) -> tuple[int, bytes, bytes | None, bytes] | None:
    """nonce, balance (32 bytes), storage root, code hash; None if there is no such account.

    Of one hash after nonce and balance, the one of empty code is taken as a root and any other as code; of two, root comes first.
    """
    if not data or data in (b"\x00", b"\xc0"):
        return None
    nonce, balance, *hashes = rlp_items(data)
    root, code = None, empty_code
    if len(hashes) == 1:
        root, code = (hashes[0], empty_code) if hashes[0] == empty_code else (None, hashes[0])
    elif len(hashes) >= 2:
        root, code = hashes[0], hashes[1]
    return int.from_bytes(nonce, "big"), balance.rjust(32, b"\x00"), root, code


@F.pandas_udf(T.BinaryType())
def encode_entries_udf(entries: pd.Series) -> pd.Series:
    return entries.map(lambda x: encode_entries([bytes(e) for e in x]))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def decode_entries_udf(payload: pd.Series) -> pd.Series:
    return payload.map(decode_entries)


@F.pandas_udf(T.BooleanType())
def valid_payload_udf(payload: pd.Series) -> pd.Series:
    return payload.map(valid_payload)


@F.pandas_udf(T.BooleanType())
def plausible_payload_udf(payload: pd.Series) -> pd.Series:
    return payload.map(plausible_payload)


def typed_entry(data: bytes) -> str:
    """storage if an entry of 33 bytes or fewer begins with the RLP form of a number, else account: the guess of logs without kinds."""
    if not data or len(data) > 33:
        return "account"
    if data[0] < 0x80:
        return "storage" if data[0] else "account"
    n = data[0] - 0x80
    if n > 32 or len(data) < 1 + n or (n and data[1] == 0) or (n == 1 and data[1] < 0x80):
        return "account"
    return "storage"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType())])))
def typed_entries_udf(payload: pd.Series) -> pd.Series:
    """The entries of a payload with guessed kinds; null if it is corrupt."""
    return payload.map(lambda p: None if (e := decode_entries(p)) is None else [{"kind": typed_entry(x), "data": x} for x in e])


@F.pandas_udf(T.LongType())
def u64_from_le(data: pd.Series) -> pd.Series:
    return data.map(lambda b: int.from_bytes(b, "little"))


@F.pandas_udf(T.BinaryType())
def u64_to_le(number: pd.Series) -> pd.Series:
    return number.map(lambda n: int(n).to_bytes(8, "little"))


def account_udf(empty_code_hex: str):
    empty = bytes.fromhex(empty_code_hex)

    @F.pandas_udf("nonce decimal(20,0), balance binary, storage_root binary, code_hash binary")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = [decode_account(d, empty) or (None, None, None, None) for d in data]
        return pd.DataFrame(rows, columns=["nonce", "balance", "storage_root", "code_hash"])

    return run
