"""WARC 1.1 files: a sequential reader, and a writer that makes its input.

A file is a run of gzip members, one a record. The reader goes through it once: bytes are fetched
in steps of STEP, inflated as they come, and framed by the header's Content-Length; a member's end
must be a record's end. Members of several records, against the recommendation, are read as well.
The SHA-1 of the block, and of the payload after an HTTP header, is compared with the record's
digests (SHA-1, SHA-256, SHA-512 and MD5, in base32 or base16). Memory is bounded by STEP, inflated,
and the longest record, which is one value of a row in any case.

Each file is one task (files of a crawl hold about 1 GB); files are opened by URI, so any store that
pyarrow.fs knows will do. The writer names each file by its partition and renames it into place, so
that a task that runs again writes the same file.

Defined cases. A damaged member, a wrong length, and a digest that differs give the record with
`status` saying so ("truncated", "bad gzip", "bad length", "bad digest", "bad header"); reading goes
on with the next member where the format allows it, which is where the gzip framing is intact. What
follows a record of bad length or header within its member belongs to that record. Numbers in
headers are ASCII digits within 64 bits; others count as absent. Digests of other kinds aren't
checked. An empty file or member has no records. `offset` is that of the record's member, `place`
the record's number in it; `length` is the member's compressed length, known at its last record only
(null before). Pages of null url are written with the URI "urn:none"; null html is an
empty payload; repeated rows are records of their own; a null page_id comes back as null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import shared_dir, table

STEP = 1 << 16
RECORD = "file string, offset long, place int, length long, record_type string, target_uri string, record_id string, page_id long, content_length long, payload binary, block_sha1 string, payload_sha1 string, status string"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(uri: str | None, payload: bytes, page_id: int | None, place: str) -> bytes:
    """One response record as a gzip member; equal arguments give equal bytes."""
    block = _HTTP + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{place} {page_id} {uri}")
    clean = "".join(c for c in (uri or "urn:none") if c not in "\r\n")
    lines = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{sha1(block)}", f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def whole(text: str | None, least: int = 0) -> int | None:
    """A header's number: ASCII digits (after a minus, if it may be negative) within 64 bits; else None."""
    if text is None or not re.fullmatch(r"-?[0-9]{1,19}", text):
        return None
    return n if least <= (n := int(text)) < 1 << 63 else None


class Records:
    """Cuts the inflated bytes of one member into records, as they come."""

    def __init__(self) -> None:
        self.held, self.sought, self.need, self.lost = bytearray(), 0, 0, False

    def feed(self, data: bytes) -> Iterator[dict]:
        """Fields of each record that data completes."""
        self.held += data
        while not self.lost and len(self.held) >= self.need:
            if not self.need:
                end = self.held.find(b"\r\n\r\n", self.sought)
                if end < 0:
                    self.sought = max(0, len(self.held) - 3)
                    return
                n = whole(fields_of(self.held[:end]).get("content-length"))
                if n is None or not self.held.startswith(b"WARC/"):
                    self.lost = True
                    return
                self.need = end + 4 + n + 4
                continue
            if self.held[self.need - 4 : self.need] != b"\r\n\r\n":
                self.lost = True
                return
            yield parse(bytes(self.held[: self.need]), "")
            del self.held[: self.need]
            self.sought = self.need = 0

    def rest(self, error: str) -> list[dict]:
        """The record that the member's end, or the error, cut off."""
        return [parse(bytes(self.held), error)] if self.held or error else []


def members(stream) -> Iterator[dict]:
    """Records of a stream of gzip members, with offset, place and length."""
    held, at, ended = b"", 0, False
    while True:
        if not held:
            held = stream.read(STEP)
            if not held:
                return
        unpacker, records, used, error, last, place = zlib.decompressobj(31), Records(), 0, "", None, 0
        while True:
            try:
                for row in records.feed(unpacker.decompress(held)):
                    if last is not None:
                        yield last | {"offset": at, "place": place, "length": None}
                        place += 1
                    last = row
            except zlib.error:
                error = "bad gzip"
                break
            if unpacker.eof:
                used += len(held) - len(unpacker.unused_data)
                held = unpacker.unused_data
                break
            used += len(held)
            held = stream.read(STEP)
            if not held:
                error = "truncated"
                break
        if error == "bad gzip":
            # The next member begins at the next gzip magic number, if there is one.
            skipped, rest, first = 0, held, True
            while True:
                k = rest.find(b"\x1f\x8b\x08", 1 if first and not used else 0)
                if k >= 0:
                    skipped, held = skipped + k, rest[k:]
                    break
                more = stream.read(STEP)
                if not more:
                    skipped, held, ended = skipped + len(rest), b"", True
                    break
                keep = rest[-2:]
                skipped, rest, first = skipped + len(rest) - len(keep), keep + more, False
            used += skipped
        for row in [*([] if last is None else [last]), *records.rest(error)]:
            yield row | {"offset": at, "place": place, "length": used}
            place += 1
        at += used
        if ended or error == "truncated":
            return


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first of a name counts."""
    fields: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if colon:
            fields.setdefault(key.strip().lower(), value.strip())
    return fields


_ALGORITHMS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha512": hashlib.sha512, "md5": hashlib.md5}


def differs(want: str | None, data: bytes) -> bool:
    """Whether a digest field (algorithm:value, in base32 or base16) isn't that of data; unknown ones never differ."""
    name, _, value = (want or "").partition(":")
    make = _ALGORITHMS.get(name.strip().lower().replace("-", ""))
    if make is None:
        return False
    have, value = make(data).digest(), value.strip()
    return value.upper().rstrip("=") != base64.b32encode(have).decode().rstrip("=") and value.lower() != have.hex()


def parse(raw: bytes, error: str) -> dict:
    """Fields of one inflated record, with its status."""
    out: dict = dict.fromkeys(("record_type", "target_uri", "record_id", "page_id", "content_length", "payload", "block_sha1", "payload_sha1"))
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/"):
        return out | {"status": error or "bad header"}
    fields = fields_of(raw[:end])
    n = whole(fields.get("content-length"))
    out |= {"record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "record_id": fields.get("warc-record-id"), "page_id": whole(fields.get("x-page-id"), -(1 << 63))}
    if n is None:
        return out | {"status": error or "bad header"}
    block = raw[end + 4 : end + 4 + n]
    head = block.find(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else -4
    payload = block[head + 4 :] if head != -1 else block
    out |= {"content_length": n, "payload": payload, "block_sha1": sha1(block), "payload_sha1": sha1(payload)}
    if error:
        return out | {"status": error}
    if len(block) != n or raw[end + 4 + n :] != b"\r\n\r\n":
        return out | {"status": "bad length"}
    if differs(fields.get("warc-block-digest"), block) or differs(fields.get("warc-payload-digest"), payload):
        return out | {"status": "bad digest"}
    return out | {"status": "ok"}


def read_file(uri: str) -> Iterator[dict]:
    """Records of one WARC file, in order."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None, buffer_size=STEP) as stream:
        for row in members(stream):
            yield {"file": path.rsplit("/", 1)[-1]} | row


def read_warc(files: DataFrame) -> DataFrame:
    """Records of the files whose URIs are in column `uri`, one task a file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                if uri is None:
                    continue
                rows, size = [], 0
                for row in read_file(uri):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size > 1 << 22:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    uris = files.select(F.col("uri").cast("string"))
    return uris.mapInArrow(read, RECORD)


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one file a partition of pages; (uri, n_records, n_bytes) of each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        name = f"{path}/part-{context.partitionId():06d}.warc.gz"
        trial = f"{path}/.part-{context.partitionId():06d}-{context.taskAttemptId()}"
        records = size = 0
        store.create_dir(path, recursive=True)
        with store.open_output_stream(trial, compression=None) as out:
            for batch in batches:
                for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    member = record(url, (html or "").encode(), page, f"{context.partitionId()}/{records}")
                    out.write(member)
                    records += 1
                    size += len(member)
        store.move(trial, name)
        full = folder.rstrip("/") + name[len(path) :]
        yield pa.RecordBatch.from_arrays([pa.array([full]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["uri", "n_records", "n_bytes"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(write, "uri string, n_records long, n_bytes long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files in the shared folder, read back record by record."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if folder.startswith("/"):
        folder = f"file://{folder}"
    elif re.match(r"file:/(?!/)", folder):
        folder = f"file://{folder[5:]}"
    files = write_warc(table(spark, sf_dir, "pages"), folder).collect()
    uris = spark.createDataFrame([(r["uri"],) for r in files if r["n_records"]], "uri string").repartition(max(1, len(files)))
    found = read_warc(uris)
    return found.select("page_id", F.col("target_uri").alias("url"), F.col("payload").cast("string").alias("html"), "content_length", F.sha1("payload").alias("payload_sha1"), "status")


ORACLE_SQL = f"""
SELECT page_id, coalesce(url, 'urn:none') AS url, coalesce(html, '') AS html,
       CAST(octet_length(encode(coalesce(html, ''))) + {len(_HTTP)} AS BIGINT) AS content_length,
       sha1(coalesce(html, '')) AS payload_sha1, 'ok' AS status FROM pages"""
