"""WARC archives: a writer in Spark and a salvage reader.

``write_warc`` turns pages into ``.warc.gz`` files, one gzip member a record.  Files go out through Spark's text source, so
its commit protocol holds when executors are lost: the last byte of a member (the top byte of its length, 0 below 16 MB;
longer records get an empty member behind them) is left to the writer's line separator.

``read_warc`` reads ``.warc`` and ``.warc.gz`` files.  Where a member does not inflate, or a record's version line, length or
digest is wrong, it looks for the next valid member or version line, goes on from there, and logs the bytes between as a
quarantined gap (kind ``gap`` with offset, length and reason; records have kind ``record``).  So it does inside the content of a
member of several records, and in what inflates of a member before its damage or end.

Payloads are the html in UTF-8, empty for null.  Of records with equal payloads of at least ``least`` bytes, the one with the
smallest page_id is a response and the others revisit it; smaller ones are all responses.  A page without page_id is
written without an id and never chosen over one with an id; among rows that repeat the smallest page_id all are
responses.  Empty tables give no file and no rows; extra columns are not archived, whatever their names.  A page of any
length is one record; a file is closed behind the record with which its members pass ``file_bytes``, so no file that is read as one
row has more than that and one record.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded_batches, discard, fresh_path, materialise
from .vector import slices

GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
END = b"\r\n\r\n"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
ID = re.compile(r"<urn:page:(-?\d+)>")
#: A table of revisits is broadcast up to this many rows (about 100 bytes each), and joined by page beyond.
BROADCAST_ROWS = 50_000
RECORDS_PER_FILE, FILE_BYTES = 50_000, 32 << 20
#: Payloads with more than one in HOT_SHARE of all rows are found by a broadcast, which thus has at most that many rows.
HOT_SHARE, HOT_LEAST = 2_000, 100


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: an HTTP response, or a revisit that holds its header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """``data`` as one gzip member whose last byte is 0."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def with_references(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest and refers_to (the page that a revisit refers to, else null)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    usable = rows.filter(F.octet_length("payload") >= least).select("page_id", "digest")
    repeated = usable.filter("page_id is not null").groupBy(F.col("digest").alias("same")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = materialise(repeated.filter("n > 1"), "warc-repeated")
    size = repeated.agg(F.count("*").alias("rows"), F.sum("n").alias("pages")).first()
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least), F.col("first")).alias("refers_to")
    names = ["page_id", "url", "payload", "digest"]
    if size["rows"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(repeated), rows.digest == repeated.same, "left").select(*names, refers)
    # pages of frequent payloads learn the first from a broadcast; of the others only ids are dealt by digest, and payloads by page
    hot = F.broadcast(repeated.filter(F.col("n") > max(size["pages"] // HOT_SHARE, HOT_LEAST)).select(F.col("same").alias("hot"), "first"))
    frequent = rows.join(hot, F.col("digest") == F.col("hot")).select(*names, refers)
    rare = usable.join(hot, F.col("digest") == F.col("hot"), "left_anti").join(repeated, F.col("digest") == F.col("same"))
    revisits = rare.filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    revisits = materialise(revisits, "warc-revisits")
    rest = rows.join(hot, F.col("digest") == F.col("hot"), "left_anti")
    rest = rest.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select(*names, F.col("first").alias("refers_to"))
    return frequent.unionByName(rest)


def write_warc(rows: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write rows of ``with_references`` as ``.warc.gz`` files below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, written, file = 0, 0, 0
        for batch in batches:
            for part in slices(batch, "payload", 4 << 20):
                members = [gzip_member(build_record(*r))[:-1] for r in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True)]
                files = []
                for m in members:
                    files.append(file)
                    held, written = held + 1, written + len(m) + 1
                    if written >= file_bytes or held >= records_per_file:
                        held, written, file = 0, 0, file + 1
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(files, pa.int32())], names=["member", "file"])

    bounded_batches(rows.sparkSession)
    members = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "member binary, file int")
    members.select(F.col("member").cast("string").alias("value"), "file").write.partitionBy("file").option("lineSep", "\0").text(path)


def _inflate(data: memoryview, start: int) -> tuple[bytes, int, bool]:
    """A member's content, the position after it, and whether it is whole; if not, what comes before the damage."""
    z, at, out = zlib.decompressobj(31), start, []
    try:
        while at < len(data):
            piece = data[at : at + (1 << 16)]
            out.append(z.decompress(piece))
            at += len(piece)
            if z.eof:
                return b"".join(out), at - len(z.unused_data), True
    except zlib.error:  # once more up to the damaged piece, and through that by single bytes
        z, out = zlib.decompressobj(31), []
        for k in range(start, at, 1 << 16):
            out.append(z.decompress(data[k : k + (1 << 16)]))
        try:
            while True:
                out.append(z.decompress(data[at : at + 1]))
                at += 1
        except zlib.error:
            pass
    return b"".join(out), at, False


def _reached(data: memoryview, start: int, stop: int, length: int) -> int:
    """The position up to which a member is read for the first ``length`` bytes of its content."""
    z = zlib.decompressobj(31)
    z.decompress(data[start:stop], length)
    return stop - len(z.unconsumed_tail)


def _parse(data: bytes, start: int) -> tuple[dict[str, str], bytes, int] | str:
    """Headers (names in lower case), block and the position after the record; or why it is not valid."""
    if not data.startswith(VERSION, start):
        return "no version line"
    stop = data.find(END, start)
    if stop < 0:
        return "header without an end"
    lines = data[start:stop].decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = headers.get("content-length", "")
    if not length.isdigit():
        return "no content length"
    begin = stop + len(END)
    after = begin + int(length)
    if data[after : after + len(END)] != END:
        return "the length does not lead to the record's end"
    block = data[begin:after]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        return "the block's digest differs"
    return headers, block, after + len(END)


def _records(data: bytes) -> tuple[list[tuple[dict[str, str], bytes]], int, str]:
    """Headers and block of all valid records of a member's content, the position after the last, and why others are not valid."""
    pos, found, end, why = 0, [], 0, ""
    while 0 <= pos < len(data):
        got = _parse(data, pos)
        if isinstance(got, str):
            why = why or got
            pos = data.find(VERSION, pos + 1)
        else:
            found.append(got[:2])
            pos = end = got[2]
    return found, end, why


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object, object]]:
    """("record", offset, length, headers, block) and ("gap", offset, length, reason, None), in the order of the bytes.

    Records of a gzip member have the place of the member, or of the part of it that they were read from.  If others of a whole member
    are not valid, a gap with the member's place follows them.
    """
    at, bad, why, view = 0, None, "", memoryview(data)

    def gap(to: int):
        nonlocal bad
        found, bad = bad, None
        return ("gap", found, to - found, why, None)

    while at < len(data):
        records, after, said, whole = [], at, "", True
        if data.startswith(GZIP, at):
            inner, after, whole = _inflate(view, at)
            records, end, said = _records(inner)
            if not whole:
                said = "the member does not inflate"
                after = _reached(view, at, after, end) if records else at
        else:
            got = _parse(data, at)
            if isinstance(got, str):
                said, whole = got, False
            else:
                records, after = [got[:2]], got[2]
        if bad is not None and (records or not said):
            yield gap(at)
        for headers, block in records:
            yield "record", at, after - at, headers, block
        if not said:
            at = after
        elif whole:  # a member that inflates, not all of it records
            if bad is None:
                bad, why = at, said
            at = after
            if records:
                yield gap(at)
        else:
            if bad is None:
                bad, why = max(at, after), said
            following = [x for x in (data.find(GZIP, max(at + 1, after)), data.find(VERSION, max(at + 1, after))) if x >= 0]
            at = min(following, default=len(data))
    if bad is not None:
        yield gap(len(data))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all files below ``path``."""
    schema = "archive string, kind string, offset long, length long, reason string, record_type string, page_id long, refers_to long, target_uri string, payload_digest string, payload_bytes long, payload binary"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def page(headers: dict[str, str], name: str) -> int | None:
        found = ID.fullmatch(headers.get(name, ""))
        return int(found[1]) if found else None

    def row(archive: str, kind: str, offset: int, length: int, said, block) -> tuple:
        if kind == "gap":
            return archive, kind, offset, length, said, None, None, None, None, None, None, None
        payload = block.partition(END)[2] if "http" in said.get("content-type", "") else block
        digest, size = said.get("warc-payload-digest", ""), said.get("warc-payload-length", "")
        revisit = said.get("warc-type") == "revisit"
        known = digest[7:] if revisit and digest.startswith("sha256:") else hashlib.sha256(payload).hexdigest()
        count = int(size) if revisit and size.isdigit() else len(payload)
        return archive, kind, offset, length, None, said.get("warc-type"), page(said, "warc-record-id"), page(said, "warc-refers-to"), said.get("warc-target-uri"), known, count, None if revisit else payload

    types = pa.schema([("archive", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                archive, rows, size = batch.column(0)[k].as_py(), [], 0
                for found in salvage(batch.column(1)[k].as_py()):
                    rows.append(row(archive, *found))
                    size += len(rows[-1][-1] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)

    return files.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, least: int = 100, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(with_references(pages, least), path, records_per_file, file_bytes)
    found = read_warc(spark, path)
    found.foliate_path = path
    return found


def archived_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages, read back from their archives.

    The archives are removed when they are read.  If they do not hold one record for each page, that is an error.
    """
    archives = archive_round_trip(pages, least)
    found = materialise(archives.select("kind", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    discard(archives)
    written, read = pages.count(), found.filter("kind = 'record'").count()
    if written != read:
        raise RuntimeError(f"{written} pages were archived and {read} records read back")
    return found.filter("kind = 'record'").drop("kind")
