"""WARC archives: writing whole-file gzip, normalising it to one member per record, indexed reading.

Many archives arrive as one gzip stream over the whole file, which can only be read
from its start. The normaliser inflates such a stream once, piece by piece, rewrites
every record as a gzip member of its own and writes a sidecar of offsets, so that any
record can be read alone and one archive can be read by many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY_KEYS, as_table, fresh_path, open_fs

PIECE = 1 << 18
_GZIP = 31  # zlib's window bits for gzip framing
_DATE = "2024-01-01T00:00:00Z"


def record_head(page_id: int | None, url: str | None, digest: str, n_bytes: int, refers_to: int | None, revisit: bool) -> bytes:
    """The header of a response record, or a whole revisit record without its closing lines.

    A revisit keeps the HTTP header, and with it the payload's length, but no payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    target = "".join(c for c in (url or "") if c not in "\r\n") or f"urn:page:{page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}')}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Page-ID: {'' if page_id is None else page_id}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else n_bytes)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + http


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """Rows (page_id, url, payload, revisit, refers_to): of equal payloads the largest id is the response."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    long_enough = rows.where(F.length("payload") >= min_bytes)
    groups = as_table(long_enough.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("_rows")).where("_rows > 1 AND kept IS NOT NULL"), "payloads")
    total = int(groups.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0])
    # Rows of heavy payloads meet a broadcast of fewer than HEAVY_KEYS digests; in the shuffle
    # of all others they are spread by their id.
    heavy = groups.where(F.col("_rows") * F.lit(HEAVY_KEYS) > F.lit(total))
    light = groups.where(F.col("_rows") * F.lit(HEAVY_KEYS) <= F.lit(total))
    marked = (
        rows.join(F.broadcast(heavy.select("digest", F.col("kept").alias("_heavy"))), "digest", "left")
        .withColumn("_key", F.when(F.col("_heavy").isNull(), F.col("digest")).otherwise(F.xxhash64("page_id").cast("string")))
        .join(light.select(F.col("digest").alias("_key"), F.col("kept").alias("_light")), "_key", "left")
        .withColumn("_kept", F.coalesce("_heavy", "_light"))
    )
    return marked.select("page_id", "url", "payload", (F.col("_kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_kept"))).alias("revisit"), F.col("_kept").alias("refers_to"))


def write_monolithic(records: DataFrame, path: str, max_bytes: int = 256 << 20) -> DataFrame:
    """Writes ``records`` (of ``mark_revisits``) as whole-file gzip archives; returns (file, n_records).

    Each task writes files of its own, named by a fresh id, so a repeated task leaves an
    unused file and never a broken one; the returned table names those that count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(path)
        store.create_dir(base, recursive=True)
        out = None
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, revisit, refers_to = (batch.column(k)[row].as_py() for k in range(5))
                if out is None:
                    name, n, size, deflate = f"{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(1, zlib.DEFLATED, _GZIP)
                    out = store.open_output_stream(posixpath.join(base, name), compression=None)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                for piece in (record_head(page_id, url, digest, len(payload), refers_to, revisit), b"" if revisit else payload, b"\r\n\r\n"):
                    out.write(deflate.compress(piece))
                    size += len(piece)
                n += 1
                if size >= max_bytes:
                    out.write(deflate.flush())
                    out.close()
                    out = None
                    yield _batch(file=[f"{path}/{name}"], n_records=[n])
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield _batch(file=[f"{path}/{name}"], n_records=[n])

    return as_table(records.mapInArrow(run, "file string, n_records long"), "archives")


def _batch(**columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


class _Inflated:
    """Bytes of a gzip file of one or many members, read forward in pieces."""

    def __init__(self, stream):
        self._stream, self._zip, self._ready, self._left = stream, zlib.decompressobj(_GZIP), b"", b""

    def _more(self) -> bool:
        while True:
            if self._zip.eof:
                self._left = self._zip.unused_data or self._left
                self._zip = zlib.decompressobj(_GZIP)
            data = self._left or self._stream.read(PIECE)
            self._left = b""
            if not data:
                return False
            out = self._zip.decompress(data, PIECE)
            self._left = self._zip.unconsumed_tail
            if out:
                self._ready += out
                return True

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end of the file."""
        while (at := self._ready.find(b"\r\n\r\n")) < 0:
            if not self._more():
                return None
        found, self._ready = self._ready[: at + 4], self._ready[at + 4 :]
        return found

    def body(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if not self._ready and not self._more():
                raise EOFError("the archive ends within a record")
            piece, self._ready = self._ready[:n], self._ready[n:]
            n -= len(piece)
            yield piece


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise_archives(archives: DataFrame, path: str) -> DataFrame:
    """Rewrites each archive with a member per record, and its sidecar; returns (file, index_file, n_records).

    An archive is inflated once, in pieces of PIECE bytes, by one task; neither the
    archive nor a record is held whole. The sidecar ``<file>.idx`` has a JSON line per
    record: file, offset, length, type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = open_fs(path)
        target.create_dir(base, recursive=True)
        for batch in batches:
            for source in batch.column("file").to_pylist():
                store, inner = open_fs(source)
                name, at, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with store.open_input_stream(inner, compression=None) as raw, target.open_output_stream(posixpath.join(base, name), compression=None) as out, target.open_output_stream(posixpath.join(base, f"{name}.idx"), compression=None) as index:
                    records = _Inflated(raw)
                    while (head := records.head()) is not None:
                        fields = parse_head(head)
                        deflate = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
                        length = out.write(deflate.compress(head))
                        for piece in records.body(int(fields["content-length"]) + 4):
                            length += out.write(deflate.compress(piece))
                        length += out.write(deflate.flush())
                        index.write(json.dumps({"file": f"{path}/{name}", "offset": at, "length": length, "type": fields["warc-type"]}).encode() + b"\n")
                        at, n = at + length, n + 1
                yield _batch(file=[f"{path}/{name}"], index_file=[f"{path}/{name}.idx"], n_records=[n])

    # One archive a task: they are large, and each is a single stream.
    return as_table(archives.repartition(max(1, archives.count()), "file").mapInArrow(run, "file string, index_file string, n_records long"), "normalised")


def read_index(spark: SparkSession, normalised: DataFrame) -> DataFrame:
    """The sidecar rows (file, offset, length, type) of normalised archives."""
    sidecars = [r.index_file for r in normalised.select("index_file").toLocalIterator()]
    schema = "file string, offset long, length long, type string"
    return spark.read.schema(schema).json(sidecars) if sidecars else spark.createDataFrame([], schema)


def read_records(index: DataFrame, run_bytes: int = 16 << 20) -> DataFrame:
    """Reads single records by their offsets, each task about ``run_bytes`` of an archive.

    Returns page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload
    (null for a revisit). A response's digest and length are taken from the payload that
    was read, and must match its header; a revisit's come from its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = [_read_one(opened, *row) for row in zip(*(batch.slice(first, 256).column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
        for handle in opened.values():
            handle.close()

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    spread = index.repartition(total // run_bytes + 1, "file", F.floor(F.col("offset") / F.lit(run_bytes)))
    return spread.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read_one(opened: dict, file: str, offset: int, length: int) -> dict:
    if file not in opened:
        if len(opened) > 16:
            opened.pop(next(iter(opened))).close()
        store, inner = open_fs(file)
        opened[file] = store.open_input_file(inner)
    opened[file].seek(offset)
    record = zlib.decompress(opened[file].read(length), _GZIP)
    head, _, block = record.partition(b"\r\n\r\n")
    fields = parse_head(head)
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    n_bytes, digest = int(parse_head(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != n_bytes or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the record at {offset} of {file} doesn't match its digest")
    return {
        "page_id": int(fields["page-id"]) if fields["page-id"] else None,
        "url": fields["warc-target-uri"],
        "record_type": fields["warc-type"],
        "payload_bytes": n_bytes,
        "payload_digest": digest,
        "refers_to": int(fields["refers-to-page-id"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a record per page to whole-file gzip, normalises the archives and reads them back.

    Returns the columns of ``read_records``, a row per page. A null html is an empty
    payload; a null url becomes a URN. Of rows with equal payloads of at least
    ``min_bytes`` those with the largest id are responses (several if that id repeats, and
    all if every id is null); the others, null ids included, revisit it. Columns of other
    names are ignored. An empty table gives an empty result. Files go to the shared folder.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    archives = write_monolithic(mark_revisits(pages, id_col, url_col, html_col, min_bytes), f"{path}/monolithic")
    return read_records(read_index(spark, normalise_archives(archives, f"{path}/records")))
