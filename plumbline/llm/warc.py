"""WARC archives: writing with deduplicated payloads, and a reader that salvages damaged files.

Records are written through Spark's own committed text writer, so any store that Spark writes works and a lost executor
only repeats its files. Each is a gzip member of its own: damage costs the records that it hits. The reader checks every record (version line, header block, length, closing lines, block digest).
After a failed check it searches for the next valid gzip member or version line, recovers the records from there on, and
logs the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import slices

log = logging.getLogger(__name__)

VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes that the writer hands on at once.
BUNDLE_BYTES = 4 << 20


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes = field(repr=False)


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(headers: dict[str, str], block: bytes, member: bool = False) -> bytes:
    """One record, as a gzip member of its own if asked for."""
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in headers.items()), f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not member:
        return raw
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(data: bytes, at: int) -> Record:
    """The record that starts at a byte; ValueError says which check failed."""
    if not VERSION_LINE.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("no end of headers")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("the block doesn't end where its length says")
    block = data[start:stop]
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and digest != sha1_base32(block):
        raise ValueError("the block's digest differs")
    return Record(at, stop + 4 - at, headers, block)


def salvage_plain(data: bytes) -> Iterator[Record | Gap]:
    """Records of an uncompressed archive, and the gaps between those that hold."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            record = parse_record(data, at)
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            following = VERSION_LINE.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        yield record
        at += record.length
    if bad is not None:
        yield Gap(bad, len(data), why)


def _fed(data: bytes, at: int) -> Iterator[memoryview]:
    """The bytes from a place on, in pieces that grow: what lies behind a member's end is never copied as a whole."""
    view, size = memoryview(data), 8192
    while at < len(data):
        yield view[at : at + size]
        at, size = at + size, min(2 * size, 1 << 20)


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member at a byte holds, and where it ends; ValueError if it is broken or cut off."""
    opener, out, end = zlib.decompressobj(31), [], at
    try:
        for piece in _fed(data, at):
            out.append(opener.decompress(piece))
            end += len(piece)
            if opener.eof:
                return b"".join(out), end - len(opener.unused_data)
    except zlib.error as e:
        raise ValueError(f"broken member: {e}") from None
    raise ValueError("cut off member")


def _head(data: bytes, at: int) -> tuple[list[Record], int]:
    """The whole records at the head of a broken member, and where the bytes that hold them end."""
    opener, out, size = zlib.decompressobj(31), [], 256
    view = memoryview(data)
    for k in range(at, len(data), size):
        try:
            out.append(opener.decompress(view[k : k + size]))
        except zlib.error:
            break
        if opener.eof:
            break
    raw, found, ends = b"".join(out), [], 0
    for x in salvage_plain(raw):
        if not isinstance(x, Record) or x.offset != ends:
            break  # whole records from the start on
        found.append(x)
        ends = x.offset + x.length
    if not found:
        return [], at
    # the fewest bytes that give them: piece by piece, the last piece byte by byte
    opener, given, k = zlib.decompressobj(31), 0, at
    while True:
        before = opener.copy()
        piece = opener.decompress(view[k : k + 4096])
        if given + len(piece) >= ends:
            break
        given, k = given + len(piece), k + 4096
    while given < ends:
        given, k = given + len(before.decompress(view[k : k + 1])), k + 1
    return found, k


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive: plain records, gzip members (one or many records in each), or both in any order.
    Offsets and lengths of records in a member are the member's; of a broken one, those of the part that held.

    After a failed check the nearer of the next member and the next version line that holds goes on; a member that closes
    a gap holds a record. Whole records at the head of every broken member are kept, and the gap starts behind them.
    Members are opened piece by piece, so the time is in proportion to the bytes.
    """
    at, bad, why = 0, None, ""
    member, version = -1, -1
    while at < len(data):
        packed = data.startswith(MEMBER[:2], at)
        try:
            if packed:
                raw, end = _member(data, at)
                inside = list(salvage_plain(raw))
                if bad is not None and not any(isinstance(x, Record) for x in inside):
                    raise ValueError("no record in a member")
            else:
                record = parse_record(data, at)
        except ValueError as e:
            held, behind = _head(data, at) if packed else ([], at)
            if held:
                if bad is not None:
                    yield Gap(bad, at, why)
                yield from (Record(at, behind - at, x.headers, x.block) for x in held)
                bad, why = behind, str(e)
            elif bad is None:
                bad, why = at, str(e)
            following = max(behind, at + 1)
            if member < following:
                member = data.find(MEMBER, following)
                member = len(data) if member < 0 else member
            if version < following:
                line = VERSION_LINE.search(data, following)
                version = line.start() if line else len(data)
            at = min(member, version)
            continue
        if bad is not None:
            if bad < at:
                yield Gap(bad, at, why)
            bad = None
        if packed:
            for x in inside:
                yield Record(at, end - at, x.headers, x.block) if isinstance(x, Record) else Gap(at, end, f"in a member, bytes {x.start} to {x.end}: {x.reason}")
            at = end
        else:
            yield record
            at += record.length
    if bad is not None and bad < len(data):
        yield Gap(bad, len(data), why)


def _base32(hexed: Column) -> Column:
    """Base32 of a SHA-1 (160 bits) given in hex: eight groups of 20 bits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*(F.lit(letters).substr(F.shiftright(g, s).bitwiseAND(31) + F.lit(1), F.lit(1)) for g in groups for s in (15, 10, 5, 0)))


def members(records: DataFrame, bundle: int = BUNDLE_BYTES) -> DataFrame:
    """``value`` (binary): gzip members, one a record, end to end in bundles of about so many bytes. The last byte of a
    bundle is left out: it is 0, the high byte of the last member's size; a member of 16 MB or more that ends otherwise is
    followed by an empty one. Spark's text writer then puts that byte where it puts line ends."""
    empty = zlib.compressobj(6, zlib.DEFLATED, 31).flush()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, 0):
            for raw in part.column(0).cast(pa.binary()).to_pylist():
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                held += [packer.compress(raw), packer.flush()]
                if held[-1][-1]:
                    held.append(empty)
                size += len(held[-2]) + len(held[-1])
                if size > bundle:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

    return records.mapInArrow(run, "value binary")


def write(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, compression: str = "gzip", bundles_per_file: int = 16) -> None:
    """Writes one record per row, each a gzip member of its own (``compression="none"``: plain records), in files of
    about ``bundles_per_file`` times ``BUNDLE_BYTES``.

    Of the rows whose payloads (null: empty) are equal and of ``min_bytes`` at least, the one with the smallest key
    becomes a response and the others revisit it; smaller payloads are all responses. Rows with the same key and
    payload are repeated records of one kind: all responses if the key is the smallest. A null key never becomes the
    response of a group unless all are null.
    """
    rows = df.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    rows = rows.withColumn("d", F.sha1(F.col("p").cast("binary"))).withColumn("n", F.octet_length("p").cast("long"))
    firsts = rows.filter(F.col("n") >= min_bytes).groupBy("d").agg(F.min("k").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select(F.col("d").alias("fd"), "first")
    # only keys travel to find the groups; payloads are shuffled once, by key, to meet what was found
    found = rows.filter(F.col("n") >= min_bytes).select("k", "d").distinct().join(firsts, F.col("d") == F.col("fd")).filter(~F.col("k").eqNullSafe(F.col("first"))).select(F.col("k").alias("fk"), F.col("fd"), "first")
    rows = rows.join(found, F.col("k").eqNullSafe(F.col("fk")) & (F.col("d") == F.col("fd")), "left")
    crlf = F.lit("\r\n")
    digest = _base32(F.col("d"))
    revisit = F.col("fd").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("p")))
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value, crlf)
    record = F.concat(
        F.lit(VERSION.decode() + "\r\n"),
        named("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        named("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("k").cast("string"), F.lit("")), F.lit(">"))),
        F.when(F.col("u").isNotNull(), named("WARC-Target-URI", F.regexp_replace("u", r"[\r\n]", "%0A"))).otherwise(F.lit("")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(named("WARC-Profile", F.lit(REVISIT_PROFILE)), named("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit(">"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        named("WARC-Block-Digest", F.concat(F.lit("sha1:"), _base32(F.col("bd")))),
        named("Content-Length", F.octet_length("b").cast("string")),
        crlf, F.col("b"), F.lit("\r\n\r"),
    )
    rows = rows.withColumn("b", block).withColumn("bd", F.sha1(F.col("b").cast("binary")))
    records = rows.select(record.alias("value"))
    if compression == "none":
        records.write.option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", 1000 * bundles_per_file).text(path)
        return
    whole = members(records.select(F.concat("value", F.lit("\n")).alias("value")))
    whole.select(F.col("value").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\0").option("maxRecordsPerFile", bundles_per_file).text(path)


READ_SCHEMA = "file string, offset long, length long, gap string, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, digest_holds boolean, payload_bytes long, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record below a path, and a row with ``gap`` (why) for each quarantined run of bytes.

    A task holds one file, and of what it packs one member at a time; files of 2 GB or more are beyond Spark's reader of
    whole files. A response's digest and length are taken from its payload anew; a revisit has no payload here, and those of its
    headers. ``digest_holds`` compares with the header. An empty file has no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "content")

    def bare(uri: str | None) -> str | None:
        return uri.strip("<>").removeprefix("urn:page:") if uri else None

    def row(name: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            log.warning("%s: bytes %d to %d are quarantined: %s", name, x.start, x.end, x.reason)
            return (name, x.start, x.end - x.start, x.reason, *[None] * 8)
        h = x.headers
        head, _, payload = x.block.partition(b"\r\n\r\n") if h.get("content-type", "").startswith("application/http") else (b"", b"", x.block)
        stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
        if h.get("warc-type") == "revisit":
            size = re.search(rb"(?im)^content-length: *(\d+)", head)
            known, count = stated, int(size[1]) if size else None
        else:
            known, count = sha1_base32(payload), len(payload)
        return name, x.offset, x.length, None, bare(h.get("warc-record-id")), h.get("warc-type"), h.get("warc-target-uri"), bare(h.get("warc-refers-to")), known, not stated or stated == known, count, payload if payloads else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.bool_(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                for rows in _chunks(row(name.as_py(), x) for x in salvage(content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(run, READ_SCHEMA)


def _chunks(rows: Iterable[tuple], most: int = 4 << 20) -> Iterator[list[tuple]]:
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += 200 + len(r[-1] or b"")
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part
