"""WARC archives: a writer, and a sequential reader that verifies what it reads.

Every record is a gzip member of its own. The reader takes an archive in pieces: it inflates one member after another,
frames each record by its Content-Length and hashes the block and the payload as they pass, so that memory does not
depend on the archive's size. Archives are written by attempt and named by the rows that a finished task returns, so
files of lost tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, qualified, shared_dir, table, tidy
from .exact_dedup import tree_merge

LEAST_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 18
BATCH_BYTES = 4 << 20
LEVEL = 6
#: The longest header of a record or of its HTTP message.
HEADER_BYTES = 1 << 20
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:orrery:record:"
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"


class WarcError(ValueError):
    """An archive that breaks the format or a record whose digest is wrong."""


def _label(sha: bytes) -> str:
    return "sha1:" + base64.b32encode(sha).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE, level: int = LEVEL) -> bytes:
    """One gzip member: a response with the payload, or a revisit of the record ``refers_to`` with the HTTP header only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{RECORD_ID}{'' if page_id is None else page_id}>", "WARC-Date": date}
    if uri is not None:
        fields["WARC-Target-URI"] = urllib.parse.quote(uri, safe="!#$%&'()*+,/:;=?@[]~")
    fields |= {"WARC-Payload-Digest": _label(hashlib.sha1(payload).digest()), "WARC-Block-Digest": _label(hashlib.sha1(block).digest())}
    if refers_to is not None:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{RECORD_ID}{refers_to}>"}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "".join([VERSION, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(END) + packer.flush()


def members(pieces: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member in turn; a member must be read to its end before the next is asked for."""
    rest = b""
    pieces = iter(pieces)

    def one() -> Iterator[bytes]:
        nonlocal rest
        unpacker, data, rest = zlib.decompressobj(31), rest, b""
        while not unpacker.eof:
            data = data or next(pieces, b"")
            try:
                out = unpacker.decompress(data, READ_BYTES)  # however small the piece, no more than this comes of it at once
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            if not out and not data:
                raise WarcError("the archive ends within a record")
            data = unpacker.unconsumed_tail
            yield out
        rest = unpacker.unused_data

    while rest or (rest := next(pieces, b"")):
        yield one()


def _until(pieces: Iterator[bytes], mark: bytes, what: str) -> tuple[bytes, bytes]:
    held = b""
    for piece in pieces:
        held += piece
        if (at := held.find(mark)) >= 0:
            return held[:at], held[at + len(mark) :]
        if len(held) > HEADER_BYTES:
            raise WarcError(f"{what} is too long")
    raise WarcError(f"{what} has no end")


def _fields(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise WarcError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_record(pieces: Iterator[bytes], with_payload: bool = True) -> dict:
    """Fields, payload (None in a revisit), payload_bytes and payload_sha1 of one record. Raises WarcError if a digest or length is wrong."""
    head, rest = _until(pieces, END, "a record's header")
    fields = _fields(head)
    try:
        left = int(fields["content-length"])
    except (KeyError, ValueError):
        raise WarcError("a record without Content-Length") from None
    block, payload, kept, http, body = hashlib.sha1(), hashlib.sha1(), [], b"", 0
    in_payload = not fields.get("content-type", "application/http").startswith("application/http")  # else the block is the payload
    tail = b""
    while True:
        data, tail = rest[:left], rest[left:]
        left -= len(data)
        block.update(data)
        if not in_payload and data:
            http += data
            if (at := http.find(END)) >= 0:
                in_payload, data, http = True, http[at + len(END) :], http[:at]
            elif len(http) > HEADER_BYTES:
                raise WarcError("an HTTP header is too long")
        if in_payload and data:
            payload.update(data)
            body += len(data)
            if with_payload:
                kept.append(data)
        if not left:
            break
        rest = next(pieces, None)
        if rest is None:
            raise WarcError("a record is shorter than its Content-Length")
    for piece in pieces:
        tail += piece
        if len(tail) > len(END):
            break
    if tail != END:
        raise WarcError("a record is longer than its Content-Length")
    kind = fields.get("warc-type", "")
    stated = fields.get("warc-payload-digest", "")
    if fields.get("warc-block-digest", _label(block.digest())) != _label(block.digest()) or kind == "response" and stated not in ("", _label(payload.digest())):
        raise WarcError(f"wrong digest in {fields.get('warc-record-id')}")
    size, sha = body, payload.hexdigest()
    if kind == "revisit":  # the payload is elsewhere; its length is in the HTTP header and its digest in the record's
        lengths = [int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"]
        if not lengths or not stated.startswith("sha1:"):
            raise WarcError("a revisit without the length or digest of its payload")
        size, sha = lengths[0], base64.b32decode(stated[5:]).hex()
    return {"fields": fields, "kind": kind, "payload": b"".join(kept) if with_payload and kind == "response" else None, "payload_bytes": size, "payload_sha1": sha}


def _page(value: str | None) -> int | None:
    number = (value or "").strip("<>").removeprefix(RECORD_ID)
    return int(number) if number.lstrip("-").isdigit() else None


def _stream(path: str) -> Iterator[bytes]:
    store, at = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(at, compression=None) as file:  # else pyarrow inflates it by its name
        while piece := file.read(READ_BYTES):
            yield piece


def write_archives(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", folder: str | None = None, least: int = LEAST_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for every row; one row per archive: path, records, bytes.

    The payload is the body in UTF-8 (null: empty). Of equal payloads of ``least`` bytes or more the row with the largest
    id is the response and the others revisit it; rows that repeat that id are responses too, and so is a row with no id
    if its group has none. Null ids and URIs are left out of the record. Other columns aren't looked at. An empty table
    writes nothing. Archives go to ``folder`` (by default a new one in the shared folder; without a scheme it is on the
    cluster's default file system) and stay there, for the caller to remove.
    """
    spark = pages.sparkSession
    at = qualified(spark, folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    payload = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = bounded(pages).select(F.col(id_col).cast("long").alias("_id"), F.col(uri_col).cast("string").alias("_uri"), payload.alias("_payload"))
    # Equal payloads agree in two unrelated digests and their length. Spark makes both; the merge's runs hold no payloads.
    hashed = rows.select("*", F.unhex(F.sha1("_payload")).alias("_sha"), F.unhex(F.sha2("_payload", 256)).alias("_check"), F.octet_length("_payload").cast("long").alias("_size"))
    merged = tree_merge(hashed, ["_sha", "_check", "_size"], rows=pages.count())
    target = F.when((F.col("_size") >= least) & ~F.col("_id").eqNullSafe(F.col("_keep")), F.col("_keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = pafs.FileSystem.from_uri(at)
        store.create_dir(where, recursive=True)
        task, out, done, count = TaskContext.get(), None, [], 0

        def close() -> None:
            nonlocal out
            if out:
                done.append((f"{at}/{name}", count, out.tell()))
                out.close()
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out and out.tell() >= archive_bytes:
                    close()
                if not out:
                    name, count = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz", 0
                    out = store.open_output_stream(f"{where}/{name}", compression=None)
                out.write(record(row["_id"], row["_uri"], row["_payload"], row["_target"]))
                count += 1
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "records", "bytes"])

    written = merged.select("_id", "_uri", "_payload", target.alias("_target")).mapInArrow(tidy(run), "path string, records long, bytes long")
    return cut(written)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in the column path: page_id, uri, record_type, refers_to, payload_bytes, payload_digest, payload.

    Every archive is read by one task from its start to its end; digests and lengths are verified, and an archive that
    breaks them raises WarcError. payload_digest is the payload's SHA-1 in lower-case hex; a revisit has those of the payload that it
    stands for, and a null payload. Records that repeat an id are rows of their own; an id of another form is null. Of an
    archive no more than a record's payload and a piece of the stream is held; no archives give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for member in members(_stream(path)):
                    x = read_record(member, with_payload)
                    own = x["fields"]
                    rows.append((_page(own.get("warc-record-id")), own.get("warc-target-uri"), x["kind"], _page(own.get("warc-refers-to")), x["payload_bytes"], x["payload_sha1"], x["payload"]))
                    held += 500 + len(x["payload"] or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return archives.select("path").mapInArrow(tidy(run), "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, as the archives have them; a null html is an empty payload."""
    return read_archives(write_archives(table(spark, sf_dir, "pages")), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH sized AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
best AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keep FROM sized)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN payload_bytes < {LEAST_REVISIT_BYTES} OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_REVISIT_BYTES} AND keep <> page_id THEN keep END AS refers_to
FROM best
"""
