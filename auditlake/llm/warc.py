"""WARC archives: writing, normalising monolithic gzip, and reading by offsets.

An archive that is one gzip stream can be read from its start only. The normaliser
inflates such a stream once, rewrites every record as a gzip member of its own, and writes
beside the archive an index (JSON lines) of each record's offset and length; then any record is read alone.

* write_archives() writes rows as archives of one stream each, of a bounded size.
* normalise() rewrites archives, its own or any others, one in a task; with ``plan`` it
  also makes records revisits, which keep their HTTP header and lose their payload.
* read_records() reads the records of an index, each by its range.
* revisits() finds equal payloads from a manifest of digests: no payload is shuffled.

Archives are read and written in pieces through pyarrow.fs, in any store that it knows. Each attempt of a task
writes files of its own names, and only files that a finished attempt reports are used.

A null payload is empty, a null url has no WARC-Target-URI, a null (or empty) id is empty in the record's id and null when
read. Control characters and blanks of a url are percent-encoded. Of rows with equal id and payload the first
written is the response. Repeated rows are records of their own. An archive that is cut off, corrupt or not WARC gives its whole
records, then one index row with ``error`` and no offset. A broken record of over MEMBER_BYTES, compressed, leaves a member that no
index row names. Empty tables give no archives. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import dropped, shared_folder, stored, table, with_group

#: Inflated bytes and records of a written archive, about.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 50_000
#: A record's member of at most so many bytes is written when it is whole.
MEMBER_BYTES = 16 << 20
PIECE = 1 << 16
#: Payloads of fewer bytes have no revisits.
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, number long, offset long, length long, record_id string, record_type string, uri string, payload_bytes long, payload_digest string, error string"


class WarcError(ValueError):
    """Bytes that are no WARC record."""


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    # Hadoop writes file:/x for file:///x
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _create(path: str) -> Any:
    fs, name = _place(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(name, compression=None)


def header_bytes(fields: list[tuple[str, str]]) -> bytes:
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace") + b"\r\n"


def record_id(row_id: object, archive: str, number: int) -> str:
    name = "" if row_id is None else quote(str(row_id), safe="")
    return f"<urn:record:{name}:{archive.rsplit('/', 1)[-1].split('.')[0]}:{number}>"


def row_id(record: str | None) -> str | None:
    """The row's id in a record's id."""
    name = record.strip("<>").split(":")[2] if record and record.startswith("<urn:record:") else ""
    return unquote(name) or None


def http_header(payload: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload}\r\n\r\n".encode()


class Record:
    """A record's fields, and its block in pieces; the block ends with the record."""

    def __init__(self, fields: list[tuple[str, str]], stream: BinaryIO):
        self.fields, self._stream = fields, stream
        try:
            self._left = int(self.get("Content-Length") or "")
        except ValueError:
            raise WarcError("record without a length") from None
        if self._left < 0:
            raise WarcError("record without a length")

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.fields if k.lower() == name.lower()), None)

    def line(self) -> bytes:
        out = self._stream.readline(min(self._left, PIECE))
        self._left -= len(out)
        return out

    def pieces(self) -> Iterator[bytes]:
        while self._left:
            out = self._stream.read(min(self._left, PIECE))
            if not out:
                raise WarcError("record is cut off")
            self._left -= len(out)
            yield out


def records(stream: BinaryIO) -> Iterator[Record]:
    """The records of an inflated stream. What is not read of a block is passed over."""
    while True:
        line = stream.readline(PIECE)
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise WarcError("not a WARC record")
        fields: list[tuple[str, str]] = []
        while (line := stream.readline(PIECE)).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and fields:  # a folded field goes on
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {text.strip()}")
            else:
                name, colon, value = text.partition(":")
                if not colon:
                    raise WarcError("field without a colon")
                fields.append((name.strip(), value.strip()))
        if not line:
            raise WarcError("header is cut off")
        record = Record(fields, stream)
        yield record
        for _ in record.pieces():
            pass


def inflated(raw: BinaryIO) -> BinaryIO:
    """A stream of gzip members, or of plain bytes, as plain bytes."""
    head = raw.read(2)
    raw.seek(0)
    return gzip.GzipFile(fileobj=raw) if head == b"\x1f\x8b" else io.BufferedReader(raw)


def http_head(record: Record) -> bytes:
    """The HTTP header of a record whose block has one; read from the block."""
    if "application/http" not in (record.get("Content-Type") or ""):
        return b""
    out = b""
    while line := record.line():
        out += line
        if line in (b"\r\n", b"\n"):
            break
    return out


def _declared(head: bytes) -> int | None:
    m = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return int(m[1]) if m else None


# --- writing -----------------------------------------------------------------


def write_archives(rows: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = DATE) -> DataFrame:
    """Writes each row as a response record, in archives of one gzip stream; returns their manifest
    (archive, number, id, record_id, payload_bytes, payload_digest), which is to be written once."""
    kind = rows.schema[id_col].dataType.simpleString()
    size, most = ARCHIVE_BYTES, ARCHIVE_RECORDS

    def write(batches):
        task = TaskContext.get()
        out, made = None, 0
        for batch in batches:
            found: list[tuple] = []
            for key, url, text in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.warc.gz"
                    out, pack, number, total, made = _create(path), zlib.compressobj(1, wbits=31), 0, 0, made + 1
                payload = (text or "").encode("utf-8", "replace")
                digest = hashlib.sha256(payload).hexdigest()
                head = http_header(len(payload))
                uri = [] if url is None else [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))]
                fields = [
                    ("WARC-Type", "response"), ("WARC-Record-ID", name := record_id(key, path, number)), *uri, ("WARC-Date", date),
                    ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(head) + len(payload))),
                ]
                for piece in (header_bytes(fields), head, payload, b"\r\n\r\n"):
                    out.write(pack.compress(piece))
                found.append((path, number, key, name, len(payload), digest))
                number, total = number + 1, total + len(payload)
                if total >= size or number >= most:
                    out.write(pack.flush())
                    out.close()
                    out = None
            columns = list(zip(*found)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), batch.schema.field(0).type, pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["archive", "number", "id", "record_id", "payload_bytes", "payload_digest"])
        if out is not None:
            out.write(pack.flush())
            out.close()

    chosen = rows.select(rows[id_col].alias("id"), rows[url_col].cast("string").alias("url"), rows[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(write, f"archive string, number long, id {kind}, record_id string, payload_bytes long, payload_digest string")


def revisits(manifest: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(archive, number, refers_to) of the records whose payload, of ``least`` bytes or more, a record of a
    smaller id has: ``refers_to`` is the id of the smallest one's record."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "archive", "number", "record_id")
    rows = manifest.where(F.col("payload_bytes") >= least).select("archive", "number", "id", "record_id", "payload_digest")
    # a payload may have any number of copies
    rows = with_group(rows, "payload_digest", "record_id", first=(F.min(order), "min"))
    return rows.where(F.col("record_id") != F.col("first.record_id")).select("archive", "number", F.col("first.record_id").alias("refers_to"))


# --- normalising -------------------------------------------------------------


class _Member:
    """One gzip member; held back until it is whole, unless it is large."""

    def __init__(self, out: Any):
        self.out, self.pack, self.held, self.size, self.sent = out, zlib.compressobj(6, wbits=31), [], 0, 0

    def write(self, piece: bytes) -> None:
        self._keep(self.pack.compress(piece))

    def _keep(self, packed: bytes) -> None:
        self.held.append(packed)
        self.size += len(packed)
        if self.size - self.sent > MEMBER_BYTES:
            self._send()

    def _send(self) -> None:
        for x in self.held:
            self.out.write(x)
        self.held, self.sent = [], self.size

    def close(self) -> int:
        self._keep(self.pack.flush())
        self._send()
        return self.size


def _rewrite(record: Record, member: _Member, refers_to: str | None) -> tuple:
    """Writes a record, as a revisit if it refers to one; its index fields."""
    head = http_head(record)
    digest, n = hashlib.sha256(), 0
    if refers_to is None:
        member.write(header_bytes(record.fields) + head)
        for piece in record.pieces():
            digest.update(piece)
            n += len(piece)
            member.write(piece)
    else:
        for piece in record.pieces():
            digest.update(piece)
            n += len(piece)
        changed = {"warc-type": "revisit", "content-length": str(len(head))}
        fields = [(k, changed.get(k.lower(), v)) for k, v in record.fields]
        member.write(header_bytes([*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]) + head)
    member.write(b"\r\n\r\n")
    kind = (record.get("WARC-Type") or "") if refers_to is None else "revisit"
    if kind == "revisit" and refers_to is None:  # the payload lies elsewhere
        return record.get("WARC-Record-ID"), kind, record.get("WARC-Target-URI"), _declared(head), _bare(record.get("WARC-Payload-Digest"))
    return record.get("WARC-Record-ID"), kind, record.get("WARC-Target-URI"), n, digest.hexdigest()


def _bare(digest: str | None) -> str | None:
    return digest.removeprefix("sha256:").lower() if digest else None


def _normalised(source: str, target: str, refer: Iterator[tuple[int, str]]) -> Iterator[tuple]:
    """Rewrites one archive; ``refer``: numbers of records in order with what they refer to. Yields index rows."""
    fs, name = _place(source)
    wanted = next(refer, None)
    with fs.open_input_file(name) as raw, _create(target) as out, _create(f"{target}.jsonl") as side:
        at, number = 0, 0
        try:
            for record in records(inflated(raw)):
                to = wanted[1] if wanted and wanted[0] == number else None
                wanted = next(refer, None) if to else wanted
                member = _Member(out)
                try:
                    fields = _rewrite(record, member, to)
                except BaseException:
                    at += member.sent
                    raise
                size = member.close()
                row = (target, number, at, size, *fields, None)
                side.write((json.dumps(dict(zip(("number", "offset", "length", "record_id", "record_type", "uri", "payload_bytes", "payload_digest"), row[1:]))) + "\n").encode())
                at, number = at + size, number + 1
                yield row
        except (EOFError, gzip.BadGzipFile, zlib.error, WarcError) as e:
            yield (target, number, *[None] * 7, f"{type(e).__name__}: {e}")


def normalise(archives: DataFrame, folder: str, plan: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Rewrites the archives of (archive) into ``folder`` with a sidecar each; returns the index, which is to
    be written once. ``plan``: (archive, number, refers_to) of records that become revisits. ``tasks``: how many, if not
    the number of archives."""
    rows = archives.select("archive", F.lit(-1).cast("long").alias("number"), F.lit(None).cast("string").alias("refers_to")).distinct()
    n = tasks or max(1, min(100_000, rows.count()))
    if plan is not None:
        rows = rows.union(plan.select("archive", "number", "refers_to"))

    def run(batches):
        task = TaskContext.get()
        rows = ((a, n, r) for b in batches for a, n, r in zip(*(c.to_pylist() for c in b.columns)))
        ahead = next(rows, None)
        kinds = [{"string": pa.string(), "long": pa.int64()}[f.split()[1]] for f in INDEX.split(", ")]

        def refers(archive: str) -> Iterator[tuple[int, str]]:
            nonlocal ahead
            while ahead and ahead[0] == archive:
                _, number, to = ahead
                ahead = next(rows, None)
                if number >= 0:
                    yield number, to

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], [f.split()[0] for f in INDEX.split(", ")])

        while ahead:
            source = ahead[0]
            refer = refers(source)
            name = re.sub(r"(\.warc)?(\.gz)?$", "", source.rsplit("/", 1)[-1])
            # archives of one name in different folders stay apart
            target = f"{folder}/{name}-{hashlib.sha256(source.encode()).hexdigest()[:8]}-{task.taskAttemptId()}.warc.gz"
            found: list[tuple] = []
            for row in _normalised(source, target, refer):
                found.append(row)
                if len(found) == 4096:
                    yield batch(found)
                    found = []
            for _ in refer:  # records behind a fault
                pass
            if found:
                yield batch(found)

    dealt = rows.repartition(n, "archive").sortWithinPartitions("archive", "number")
    return dealt.mapInArrow(run, INDEX)


# --- reading -----------------------------------------------------------------

RECORD = "archive string, number long, record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string"


def read_records(index: DataFrame, payload: bool = False, tasks: int | None = None) -> DataFrame:
    """(archive, number, record_id, record_type, uri, refers_to, payload_bytes, payload_digest[, payload]) of each row of an
    index that has an offset: the record is read alone by its range. Length and digest are made from the payload that is read; a
    revisit has none, and states those of the record it refers to."""
    rows = index.where("offset is not null").select("archive", "number", "offset", "length")
    n = tasks or max(1, min(100_000, rows.select("archive").distinct().count()))
    schema = RECORD + (", payload binary" if payload else "")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]

    def one(raw: Any, archive: str, number: int, offset: int, length: int) -> tuple:
        raw.seek(offset)
        record = next(records(gzip.GzipFile(fileobj=pa.BufferReader(raw.read(length)))))
        head = http_head(record)
        body = b"".join(record.pieces())
        kind = record.get("WARC-Type")
        if kind == "revisit":
            figures = (_declared(head), _bare(record.get("WARC-Payload-Digest")), None)
        else:
            figures = (len(body), hashlib.sha256(body).hexdigest(), body)
        return (archive, number, record.get("WARC-Record-ID"), kind, record.get("WARC-Target-URI"), record.get("WARC-Refers-To"), *figures[: 2 + payload])

    def run(batches):
        path, raw = None, None
        for batch in batches:
            found, held = [], 0
            for archive, number, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != path:
                    fs, name = _place(archive)
                    path, raw = archive, fs.open_input_file(name)
                found.append(one(raw, archive, number, offset, length))
                held += found[-1][6] or 0
                if payload and held > PIECE << 7:  # payloads are handed on in parts
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    return rows.repartition(n, "archive").sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def archived(rows: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Writes ``rows`` as normalised archives below ``folder``, equal payloads as revisits; returns the written index."""
    spark = rows.sparkSession
    manifest = stored(write_archives(rows, f"{folder}/streams", id_col, url_col, text_col), "warc-manifest")
    index = stored(normalise(manifest.select("archive"), f"{folder}/archives", revisits(manifest, least)), "warc-index")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/streams")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    dropped(manifest)
    return index


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    found = read_records(archived(pages, folder))
    kind = pages.schema["page_id"].dataType
    id_of = lambda c: F.nullif(F.url_decode(F.regexp_extract(c, "^<urn:record:([^:]*):", 1)), F.lit("")).cast(kind)
    refers = F.when(F.col("record_type") == "revisit", id_of("refers_to"))
    return found.select(id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))


SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id) AS first, row_number() OVER (PARTITION BY h ORDER BY page_id) AS k FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= {LEAST_REVISIT} AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= {LEAST_REVISIT} AND k > 1 THEN first END AS refers_to FROM d"""
