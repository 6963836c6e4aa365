"""WARC archives: a writer, a normaliser of monolithic gzip files, and an indexed reader.

`write_archives` writes all pages as whole-file gzip streams, which can only be
read from the start, as a crawler does that knows no other page. `with_revisits`
finds records of equal payloads by their digests. `normalise` inflates each
stream once, rewrites every record as a gzip member of its own, repeated ones
as revisits without their payload, and writes a sidecar index (JSON lines:
offset, length, record id) beside it. `read_archives` takes ranges of the
sidecars, so any number of tasks can share a file. Files lie in the shared
folder; a task names its files anew on each attempt and only the names that
successful attempts return are read, so lost executors leave no half records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, scratch_path, sliced, stored

CHUNK, FILE_BYTES, RANGE_BYTES = 1 << 20, 64 << 20, 4 << 20
#: A digest of more than one in HOT of all records is a hot one.
HOT = 1000
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "/" + uri.removeprefix("file:").lstrip("/"))


def record(page_id: int | None, url: str | None, payload: bytes, sha: bytes) -> bytes:
    """A response with its payload, whose SHA-1 is given."""
    name = "" if page_id is None else page_id
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + END + body + END


def revisit(rec: bytes, refers_to: int) -> bytes:
    """A response as a revisit: it keeps the HTTP header of its payload, not the payload."""
    head, _, block = rec.partition(END)
    http = block[: block.index(END) + len(END)]
    lines = [x for x in head.decode().split("\r\n") if not x.startswith(("WARC-Type:", "Content-Length:"))]
    lines[1:1] = ["WARC-Type: revisit"]
    lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Content-Length: {len(http)}"]
    return "\r\n".join(lines).encode() + END + http + END


def inflated(read, chunk: int = CHUNK) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, inflated in one pass, at most `chunk` bytes at a time."""
    z, ended = zlib.decompressobj(31), True
    while data := read(chunk):
        while data or not (ended or z.eof):
            out = z.decompress(data, chunk)
            ended = z.eof
            data = z.unused_data if ended else z.unconsumed_tail
            if out:
                yield out
            if ended:
                z = zlib.decompressobj(31)
            elif not data and len(out) < chunk:
                break
    if not ended:
        raise ValueError("gzip stream is cut off")


def records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream; holds one record and one part at most."""
    held = bytearray()
    for part in parts:
        held += part
        at = 0
        while (split := held.find(END, at)) >= 0:
            m = re.search(rb"(?mi)^Content-Length:[ \t]*(\d+)", held[at:split])
            if not held.startswith(b"WARC/", at) or not m:
                raise ValueError("no WARC record where one should begin")
            to = split + 4 + int(m[1]) + 4
            if len(held) < to:
                break
            yield bytes(held[at:to])
            at = to
        del held[:at]
    if held:
        raise ValueError("the last record is cut off")


def fields(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, in lower case, and the block of a record."""
    head, _, rest = rec.partition(END)
    named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, v in named.items()}, rest[:-4]


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a response per row as monolithic gzip files of about file_bytes before compression; returns (path, place, page_id, sha) of all records.

    A null html is an empty payload. Nothing is shuffled.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).cast("binary").alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = z = path = None
        n = size = 0
        for b in sliced(batches, "html"):
            paths, places, digests = [], [], []
            for r in b.to_pylist():
                if out is None:
                    path, n, size = f"{folder}/whole-{uuid.uuid4().hex}.warc.gz", 0, 0
                    system, at = _open(path)
                    out, z = system.open_output_stream(at, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                sha = hashlib.sha1(r["html"]).digest()
                raw = record(r["page_id"], r["url"], r["html"], sha)
                out.write(z.compress(raw))
                paths.append(path)
                places.append(n)
                digests.append(sha)
                n, size = n + 1, size + len(raw)
                if size >= file_bytes:
                    out.write(z.flush())
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(places, pa.int32()), b.column("page_id"), pa.array(digests, pa.binary())], ["path", "place", "page_id", "sha"])
        if out is not None:
            out.write(z.flush())
            out.close()

    _made(folder)
    return stored(rows.mapInArrow(write, "path string, place int, page_id long, sha binary"), "whole")


def with_revisits(written: DataFrame) -> DataFrame:
    """(path, revisits) of every file that write_archives returns records of: places and the page_id of the response.

    Of records with equal payloads, the one with the largest page_id stays a
    response and the others revisit it; records that repeat that page_id stay
    responses too. Only digests, ids and places are shuffled. A digest of more
    than one in HOT of all records, of which there are fewer than HOT, is
    matched by broadcast, so no task gets its records together; the list of a
    file is as long as its records, whose bytes are bounded.
    """
    again = stored(written.groupBy("sha").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).filter("n > 1 AND latest IS NOT NULL"), "repeats")
    most = written.count() / HOT
    hot = F.broadcast(again.filter(F.col("n") > most).select("sha", "latest"))
    few = again.filter(F.col("n") <= most).select("sha", "latest")
    met = written.join(hot, "sha").unionByName(written.join(hot, "sha", "left_anti").join(few, "sha"))
    lists = met.filter(~F.col("page_id").eqNullSafe(F.col("latest"))).groupBy("path").agg(F.collect_list(F.struct("place", "latest")).alias("revisits"))
    files = stored(written.select("path").distinct().join(lists, "path", "left"), "files")
    dropped(written.sparkSession, again.scratch)
    return files


def _made(folder: str) -> None:
    system, at = _open(folder)
    system.create_dir(at, recursive=True)


def _spread(df: DataFrame) -> DataFrame:
    """A row a task, up to 10,000 tasks."""
    return df.repartition(max(1, min(10_000, df.count())))


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites each gzip file of `files` (path, revisits) with a member per record, those at the places of its revisits without their payload; returns (path, index, n)."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, again in zip(b.column("path").to_pylist(), b.column("revisits").to_pylist()):
                again = {x["place"]: x["latest"] for x in again or ()}
                system, at = _open(source)
                target = f"{folder}/members-{uuid.uuid4().hex}.warc.gz"
                offset = n = 0
                out_system, out_at = _open(target)
                with system.open_input_file(at) as read, out_system.open_output_stream(out_at, compression=None) as out, out_system.open_output_stream(out_at + ".idx") as index:
                    for rec in records(inflated(read.read)):
                        if n in again:
                            rec = revisit(rec, again[n])
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(rec) + z.flush()
                        out.write(member)
                        index.write((json.dumps({"offset": offset, "length": len(member), "id": fields(rec)[0].get("warc-record-id")}) + "\n").encode())
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"path": [target], "index": [f"{target}.idx"], "n": pa.array([n], pa.int64())})

    _made(folder)
    return stored(_spread(files).mapInArrow(rewrite, "path string, index string, n long"), "members")


def index_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offsets, lengths) of runs of members of about range_bytes, from the sidecars."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index in zip(b.column("path").to_pylist(), b.column("index").to_pylist()):
                system, at = _open(index)
                own: list[dict] = []
                with system.open_input_stream(at) as f:
                    lines = f.read().decode().splitlines()
                for x in map(json.loads, lines):
                    own.append(x)
                    if x["offset"] + x["length"] - own[0]["offset"] >= range_bytes:
                        yield _range(path, own)
                        own = []
                if own:
                    yield _range(path, own)

    return files.mapInArrow(ranges, "path string, offsets array<long>, lengths array<long>")


def _range(path: str, own: list[dict]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_pydict({"path": [path], "offsets": pa.array([[x["offset"] for x in own]], longs), "lengths": pa.array([[x["length"] for x in own]], longs)})


def read_archives(files: DataFrame) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Digest and size of a response are computed from the payload that is read
    and must agree with its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows = []
                system, at = _open(r["path"])
                with system.open_input_file(at) as f:
                    for offset, length in zip(r["offsets"], r["lengths"]):
                        f.seek(offset)
                        rows.append(_row(zlib.decompress(f.read(length), 31)))
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())]))

    ranges = stored(index_ranges(_spread(files.select("path", "index"))), "ranges")
    return _spread(ranges).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def _page(urn: str | None) -> int | None:
    own = (urn or "")[10:-1]
    return int(own) if own else None


def _row(rec: bytes) -> dict:
    head, block = fields(rec)
    http, _, payload = block.partition(END)
    size, digest = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1]), head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {head['warc-record-id']}")
    return {"page_id": _page(head["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": _page(head.get("warc-refers-to")), "target_uri": head.get("warc-target-uri")}


def resolved(rows: DataFrame) -> DataFrame:
    """rows of records; a revisit whose response is missing, or has another digest or size, is an error. Only ids, digests and sizes are shuffled."""
    own = rows.filter("record_type = 'response'").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes")).distinct()
    met = (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__bytes"))
    lost = (F.col("record_type") == "revisit") & F.col("__id").isNull()
    said = F.concat(F.lit("a revisit does not match its response: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    return rows.join(own, met, "left").withColumn("record_type", F.when(lost, F.raise_error(said)).otherwise(F.col("record_type"))).select(rows.columns)


def archived_pages(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes, normalises and reads back all pages; the monolithic files are deleted once they are rewritten.

    Sizes and digests of responses come from the payloads that are read, those
    of revisits are held against their response. A null html is an empty
    payload, a null url has no target, a null page_id no number; rows that
    repeat a page are records of their own; other columns are ignored. An empty
    table gives no rows.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    files = with_revisits(write_archives(pages, f"{folder}/whole", file_bytes))
    members = normalise(files, f"{folder}/members")
    dropped(spark, f"{folder}/whole")
    return resolved(stored(read_archives(members), "records"))
