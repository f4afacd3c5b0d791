"""Damaged archives: the sequential reader raises WarcError alone, the others go on behind the damage and count it."""

import random
import zlib

import pytest

from zonewright.llm import warc


def member(data):
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def reader(data):
    at = 0

    def read(n):
        nonlocal at
        at += n
        return data[at - n : at]

    return read


GOOD = [warc.record("response", str(i), f"http://x/{i}", random.Random(i).randbytes(400 * i)) for i in range(6)]
HEAD = b"WARC/1.1\r\nWARC-Type: response\r\n"
BAD = {
    "no length": member(HEAD + b"\r\nabc\r\n\r\n"),
    "words for a length": member(HEAD + b"Content-Length: abc\r\n\r\nabc\r\n\r\n"),
    "negative length": member(HEAD + b"Content-Length: -3\r\n\r\nabc\r\n\r\n"),
    "too long": member(HEAD + b"Content-Length: 900\r\n\r\nabc\r\n\r\n"),
    "too short": member(HEAD + b"Content-Length: 1\r\n\r\nabc\r\n\r\n"),
    "no record": member(b"hello"),
    "other text": member(b"hello\r\n\r\nyou"),
    "empty member": member(b""),
    "cut": GOOD[3][:-30],
    "flipped": GOOD[4][:200] + bytes([GOOD[4][200] ^ 255]) + GOOD[4][201:],
    "wrong digest": warc.record("response", "9", None, b"abc", sha1="A" * 32),
    "revisit without a number": member(b"WARC/1.1\r\nWARC-Type: revisit\r\nContent-Type: application/http\r\nContent-Length: 41\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: some\r\n\r\n\r\n\r\n"),
    "bytes that are no member": b"\x00" * 77,
    "magic without a member": b"\x1f\x8b\x08" + b"z" * 50,
}


@pytest.mark.parametrize("name", BAD)
def test_only_warc_errors(name):
    with pytest.raises(warc.WarcError):
        list(warc.records(reader(GOOD[1] + BAD[name])))
    kinds = [x if isinstance(x, int) else x[0]["warc-record-id"] for x in warc.salvaged(memoryview(GOOD[1] + BAD[name] + GOOD[2] + BAD[name]))]
    assert kinds == ["<urn:page:1>", len(BAD[name]), "<urn:page:2>", len(BAD[name])]


def test_archives_with_damage_are_read_on(spark, tmp_path):
    archives = [b"".join(GOOD), GOOD[0] + b"".join(BAD.values()) + GOOD[5], b"", None, b"nothing of the kind", GOOD[2] + GOOD[3][:-1]]
    df = spark.createDataFrame([(bytearray(x) if x is not None else None,) for x in archives], "warc binary").coalesce(1)
    for payloads in (False, True):
        got = warc.read_archives(df, with_payload=payloads).collect()
        assert sorted(r.record_id for r in got if r.record_type != "damaged") == sorted([*"012345", "0", "5", "2"])
        assert sorted(r.payload_bytes for r in got if r.record_type == "damaged") == sorted([sum(map(len, BAD.values())), len(archives[4]), len(GOOD[3]) - 1])
    (tmp_path / "a.warc.gz").write_bytes(archives[1])
    assert [r.record_type for r in warc.read_files(spark, str(tmp_path / "*.gz")).collect()] == ["response", "damaged", "response"]
