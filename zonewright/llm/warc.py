r"""WARC archives: a deduplicating writer, and a sequential reader.

Archives are rows of a binary column, about `SEGMENT` bytes each: a sequence of WARC/1.1 records, one gzip member per record.
Such rows can lie in any store that Spark writes; `read_files` reads ordinary .warc.gz files by the same reader. The reader
goes through an archive once: it inflates member after member in steps of `STEP` bytes, takes the header block, frames the
block by Content-Length, and verifies the block and payload digests while it inflates.

A revisit record (profile identical-payload-digest) holds the HTTP head of the payload it stands for, whose Content-Length is
the full payload's, and its digest.

Defined results: a null payload is an empty one. Of records with equal payloads that of the largest id is the response, and the
others revisit it; rows that repeat that id are responses as well. A null id never is the one that others refer to; a group with null ids
only has responses. Null URLs give no WARC-Target-URI. An empty table gives no archives. Other columns are ignored.

Damage: the sequential reader raises WarcError and nothing else. `read_archives` and `read_files` go on with the next gzip member that holds a whole record, and give
one row of record_type `damaged` for each stretch between, its payload_bytes being the stretch's length in the archive. An empty archive has no records; a null one neither.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Bytes of an archive, after which the next record starts a new one; bytes inflated at a time.
SEGMENT, STEP = 1 << 18, 1 << 16
_MEMBER = re.compile(rb"\x1f\x8b\x08")
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, ident: str, url: str | None, payload: bytes, refers_to: str | None = None, level: int = 1, sha1: str | None = None) -> bytes:
    """One record as one gzip member."""
    sha1 = sha1 or digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class WarcError(ValueError):
    """A record that is cut off, badly framed or fails its digest."""


def members(read: Callable[[int], bytes], ends: list[int] | None = None) -> Iterator[Iterator[bytes]]:
    """For each gzip member, its inflated bytes piece by piece; each is used up before the next is asked for. ends: gets the members' ends in the archive."""
    rest, taken = b"", 0

    def more() -> bytes:
        nonlocal taken
        data = read(STEP)
        taken += len(data)
        return data

    while rest := rest or more():
        z = zlib.decompressobj(31)

        def pieces(z=z):
            nonlocal rest
            data, rest = rest, b""
            while True:
                try:
                    out = z.decompress(data, STEP)
                except zlib.error as e:
                    raise WarcError(f"a member that can't be inflated: {e}") from e
                if out:
                    yield out
                if z.eof:
                    rest = z.unused_data
                    if ends is not None:
                        ends.append(taken - len(rest))
                    return
                data = z.unconsumed_tail or more()
                if not data and not out:
                    raise WarcError("the archive ends within a member")

        yield pieces()


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise WarcError(f"no Content-Length: {value[:20]!r}")
    return int(value)


def records(read: Callable[[int], bytes], verify: bool = True, ends: list[int] | None = None) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of each record, names in lower case; read(n): the next bytes of the archive."""
    for pieces in members(read, ends):
        buffer = b""
        while b"\r\n\r\n" not in buffer:
            if not (piece := next(pieces, b"")):
                raise WarcError("a record without a whole header")
            buffer += piece
        head, _, buffer = buffer.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError(f"not a WARC record: {version[:20]!r}")
        warc = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length, parts, sha = _length(warc), [], hashlib.sha1()
        while True:
            take, buffer = buffer[:length], buffer[length:]
            if take:
                parts.append(take)
                sha.update(take)
                length -= len(take)
            if not length and len(buffer) >= 4:
                break
            if not (piece := next(pieces, b"")):
                raise WarcError("a block shorter than its Content-Length")
            buffer += piece
        if buffer != b"\r\n\r\n" or next(pieces, b""):
            raise WarcError("bytes behind a record")
        block = b"".join(parts)
        if verify and warc.get("warc-block-digest", "").removeprefix("sha1:") not in ("", base64.b32encode(sha.digest()).decode()):
            raise WarcError(f"block digest of {warc.get('warc-record-id')}")
        http: dict[str, str] = {}
        payload = block
        if warc.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("utf-8", "replace").split("\r\n")[1:])}
        if verify and warc.get("warc-type") == "response" and (want := warc.get("warc-payload-digest")) and want != f"sha1:{digest(payload)}":
            raise WarcError(f"payload digest of {warc.get('warc-record-id')}")
        if warc.get("warc-type") == "revisit" and "content-length" in http:
            _length(http)
        yield warc, http, payload


def salvaged(data: memoryview, verify: bool = True) -> Iterator[tuple[dict[str, str], dict[str, str], bytes] | int]:
    """The records of an archive, and for each damaged stretch between them its length."""
    at = bad = 0
    while at < len(data):
        start, here, ends = at, at, []

        def read(n):
            nonlocal here  # noqa: B023
            here += n
            return bytes(data[here - n : here])

        try:
            for found in records(read, verify, ends):
                if bad:
                    yield bad
                bad, at = 0, start + ends[-1]
                yield found
        except WarcError:
            following = _MEMBER.search(data, at + 1)
            following = following.start() if following else len(data)
            bad, at = bad + following - at, following
    if bad:
        yield bad


def planned(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Each row's payload with the id of its response: groups are found by SHA-256 and joined back by it, which AQE splits where one is hot."""
    p = pages.select(F.col(ident).alias("_id"), F.col(url).alias("_url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_payload"))
    p = p.withColumn("_sha", F.unhex(F.sha2("_payload", 256)))
    ids = pages.select(F.col(ident).alias("_i"), F.unhex(F.sha2(F.coalesce(F.col(payload).cast("binary"), F.lit(b"")), 256)).alias("_s"))
    groups = ids.groupBy("_s").agg(F.max("_i").alias("_top"), F.count("*").alias("_n")).filter("_n > 1")
    return p.join(groups, F.col("_sha") == F.col("_s"), "left").select("_id", "_url", "_payload", F.when(~F.col("_top").eqNullSafe(F.col("_id")), F.col("_top")).alias("_refers"))


def write_archives(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT, level: int = 1) -> DataFrame:
    """Archives as rows (n_records int, warc binary) of about `segment` bytes."""

    def run(batches):
        parts, size = [], 0
        for b in batches:
            for i, u, x, r in zip(*(b.column(k) for k in range(4))):
                i, u, r = i.as_py(), u.as_py(), r.as_py()
                parts.append(record("response" if r is None else "revisit", "-" if i is None else str(i), u, x.as_py(), None if r is None else str(r), level))
                size += len(parts[-1])
                if size >= segment:
                    yield pa.RecordBatch.from_arrays([pa.array([len(parts)], pa.int32()), pa.array([b"".join(parts)], pa.binary())], names=["n_records", "warc"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([len(parts)], pa.int32()), pa.array([b"".join(parts)], pa.binary())], names=["n_records", "warc"])

    return planned(pages, ident, url, payload).mapInArrow(run, "n_records int, warc binary")


_FIELDS = {"record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}


def read_archives(archives: DataFrame, column: str = "warc", with_payload: bool = False) -> DataFrame:
    """Every record of every archive: record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest, and payload on request.

    Sizes and digests are of the full payload: of the bytes read back for a response, of the record's HTTP head for a revisit.
    """
    schema = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string"
    types = _FIELDS | ({"payload": pa.binary()} if with_payload else {})
    name = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">")

    def run(batches):
        for b in batches:
            for x in b.column(0):
                if not x.is_valid:
                    continue
                rows = []
                for found in salvaged(memoryview(x.as_buffer())):
                    if isinstance(found, int):
                        rows.append((None, "damaged", None, None, found, None, *([b""] if with_payload else [])))
                        continue
                    warc, http, payload = found
                    kind = warc.get("warc-type")
                    size, sha = (int(http.get("content-length", 0)), warc.get("warc-payload-digest", "")[5:]) if kind == "revisit" else (len(payload), digest(payload))
                    rows.append((name(warc.get("warc-record-id")), kind, warc.get("warc-target-uri"), name(warc.get("warc-refers-to")), size, sha, *([payload] if with_payload else [])))
                    if with_payload and sum(len(r[-1]) for r in rows) > 16 * SEGMENT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))

    return archives.select(column).mapInArrow(run, schema + (", payload binary" if with_payload else ""))


def read_files(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of .warc.gz files, through Spark's binaryFile source; an archive must fit a binary value (2 GB)."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("warc")), with_payload=with_payload)


def round_trip(pages: DataFrame, ident: str = "page_id") -> DataFrame:
    """Writes the archives to the shared folder and reads them back, one row per page."""
    back = read_archives(stored(write_archives(pages, ident), "warc", codec="uncompressed"))
    kind = pages.schema[ident].dataType
    return back.select(
        F.expr("nullif(record_id, '-')").cast(kind).alias(ident), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "target_uri"
    )


_BITS = ", ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((16 * (instr('0123456789abcdef', h[{5 * i // 4 + 1}]) - 1) + instr('0123456789abcdef', h[{5 * i // 4 + 2}]) - 1) >> {3 - 5 * i % 4}) & 31), 1)"
    for i in range(32)
)
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
g AS (SELECT sha256(x) AS s, max(page_id) AS top FROM p GROUP BY 1),
q AS (SELECT p.page_id, octet_length(encode(x)) AS n, string_split(sha1(x), '') AS h, CASE WHEN top <> page_id THEN top END AS top
      FROM p JOIN g ON sha256(x) = g.s)
SELECT page_id, n::BIGINT AS payload_bytes, concat({_BITS}) AS payload_digest,
       CASE WHEN top IS NULL THEN 'response' ELSE 'revisit' END AS record_type, top AS refers_to
FROM q
"""
