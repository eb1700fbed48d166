"""WARC archives through a chunked record table.

A payload is cut into chunks, rows (record, chunk number, bytes), and everything after
works on chunks: SHA-1 is carried from chunk to chunk while rows stream by, archive
writers take a header row and then the record's chunks, and readers inflate and hash piece by piece,
so no task needs memory for a whole record. The chunk table is written to the shared folder
with record names of its own, so that later stages and retries see the same records.

Records with equal payloads (length and SHA-1) are one group; the one with the largest
page_id is a response, the others are revisit records that refer to it. A group of any
size is reduced to one row by partial aggregation before it is joined back.

Archives are ``.warc.gz`` files, a gzip member per record (WARC 1.1, identical-payload-digest
revisits). Each task attempt writes a file name of its own and the manifest
lists those that count.

Nulls: a null html is an empty payload; a null url is written as ``about:blank``; a null page_id sorts below all others. Rows
with equal page_id are records of their own; if they hold the group's largest page_id,
all of them are responses. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, fresh_path, ship

CHUNK = 64 << 10
ROWS_PER_FILE = 8192
MOST_FILES = 50_000  # beyond it files get larger
DATE = "2024-01-01T00:00:00Z"  # no clock: reruns write the same bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NONE = "none"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{NONE if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:page:").removesuffix(">")
    return None if name == NONE else int(name)


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Rows (record, page_id, url, chunk_no, data, n_bytes, digest, last), in the shared folder.

    n_bytes and digest (base-32 SHA-1) are those of the payload up to and with the chunk; in the
    row marked ``last`` they are the payload's. ``data`` is a zstandard frame of the chunk, which
    halves what is stored and shuffled.
    """
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    # Numbers are exploded, not chunks: each row then takes its own piece of the payload, so no row holds a second copy of all.
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("payload") / chunk).cast("int") - 1, F.lit(0)))
    short = F.length("payload") <= chunk
    piece = F.when(short, F.col("payload")).otherwise(F.substr(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    numbered = rows.select("page_id", "url", "payload", F.explode(numbers).alias("chunk_no"))
    chunks = numbered.select("page_id", "url", "chunk_no", piece.alias("data"), ((F.col("chunk_no") + 1) * chunk >= F.length("payload")).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, sha, size = TaskContext.get().partitionId(), -1, hashlib.sha1(), 0
        zip_ = zstandard.ZstdCompressor(3)
        for b in batches:
            names, sizes, digests, frames = [], [], [], []
            for no, data in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if no == 0:
                    n, sha, size = n + 1, hashlib.sha1(), 0
                sha.update(data)
                size += len(data)
                names.append(f"{part:06d}-{n:09d}")
                frames.append(zip_.compress(data))
                sizes.append(size)
                digests.append(base64.b32encode(sha.copy().digest()).decode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(b.column(i) for i in range(3)), pa.array(frames, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), b.column(4)], ["record", "page_id", "url", "chunk_no", "data", "n_bytes", "digest", "last"])

    ship(pages.sparkSession)
    return cut(chunks.mapInArrow(run, "record string, page_id long, url string, chunk_no int, data binary, n_bytes long, digest string, last boolean"), "chunks")


def classify(chunks: DataFrame) -> DataFrame:
    """Rows (record, page_id, url, n_bytes, digest, refers_to, revisit), one per record."""
    records = chunks.where("last").select("record", "page_id", "url", "n_bytes", "digest")
    groups = records.groupBy("n_bytes", "digest").agg(F.max("page_id").alias("first"), F.count("*").alias("k"))
    revisit = (F.col("k") > 1) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return records.join(groups, ["n_bytes", "digest"]).select(*records.columns, revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


class WarcWriter:
    """Writes records one after another, each a gzip member fed in pieces."""

    def __init__(self, root: str):
        self.path = f"{root}/part-{uuid.uuid4().hex}.warc.gz"
        fs, at = pafs.FileSystem.from_uri(self.path)
        self.out, self.n, self.zip = fs.open_output_stream(at, compression=None), 0, None

    def start(self, page_id, url, n_bytes, digest, revisit, refers_to) -> None:
        self.finish()
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
        head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {(url or 'about:blank').translate({10: ' ', 13: ' '})}", f"WARC-Payload-Digest: sha1:{digest}"]
        if revisit:
            head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n_bytes)}", "", ""]
        self.zip, self.n = zlib.compressobj(1, zlib.DEFLATED, 31), self.n + 1
        self.feed("\r\n".join(head).encode() + http)

    def feed(self, data: bytes) -> None:
        self.out.write(self.zip.compress(data))

    def finish(self) -> None:
        if self.zip is not None:
            self.out.write(self.zip.compress(b"\r\n\r\n") + self.zip.flush())
            self.zip = None

    def close(self) -> tuple[str, int]:
        self.finish()
        self.out.close()
        return self.path, self.n


def read_records(path: str, piece: int = CHUNK) -> Iterator[tuple[dict[str, str], dict[str, str], int, str]]:
    """(WARC headers, HTTP headers, payload bytes found, their base-32 SHA-1) of each record, read in pieces."""
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at, compression=None) as f:
        held, done = b"", False
        while True:
            unzip, text, state, warc, http, sha, size, left = zlib.decompressobj(31), b"", 0, {}, {}, hashlib.sha1(), 0, 0
            while not unzip.eof:
                raw = held or f.read(piece)
                out = unzip.decompress(raw, piece)
                if not raw and not out and not unzip.eof:
                    done = True
                    break
                held = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
                while out:
                    if state < 2:
                        text += out
                        out = b""
                        if (end := text.find(b"\r\n\r\n")) >= 0:
                            lines = text[:end].decode().split("\r\n")[1:]
                            fields = dict(x.split(": ", 1) for x in lines)
                            out, text = text[end + 4 :], b""
                            if state == 0:
                                warc, left = fields, int(fields["Content-Length"])
                            else:
                                http = fields
                            left -= (end + 4) if state == 1 else 0
                            state += 1
                    else:
                        part = out[:left]
                        sha.update(part)
                        size, left, out = size + len(part), left - len(part), b""
            if done:
                if warc or text:
                    raise ValueError(f"{path} is cut short")
                return
            if left:
                raise ValueError(f"{path}: {warc.get('WARC-Record-ID')} is cut short")
            yield warc, http, size, base64.b32encode(sha.digest()).decode()


def write_warc(pages: DataFrame, root: str, rows_per_file: int = ROWS_PER_FILE, **cols) -> DataFrame:
    """Write all pages as archives below ``root``; the manifest (path, n) is returned."""
    chunks = chunk_table(pages, **cols)
    records = cut(classify(chunks), "records")
    n = records.count()
    heads = records.select("record", F.lit(-1).alias("chunk_no"), "page_id", "url", "n_bytes", "digest", "revisit", "refers_to", F.lit(None).cast("binary").alias("data"))
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    bodies = chunks.where("n_bytes > 0").select("record", "chunk_no", null("page_id", "long"), null("url", "string"), null("n_bytes", "long"), null("digest", "string"), null("revisit", "boolean"), null("refers_to", "long"), "data")
    fs, at = pafs.FileSystem.from_uri(root)
    fs.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, unzip, revisit_now = None, zstandard.ZstdDecompressor(), False
        for b in batches:
            for no, page_id, url, size, digest, revisit, refers_to, data in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                writer = writer or WarcWriter(root)
                if no < 0:
                    writer.start(page_id, url, size, digest, revisit, refers_to)
                    revisit_now = revisit
                elif not revisit_now:
                    writer.feed(unzip.decompress(data))
        if writer is not None:
            path, k = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64())], ["path", "n"])

    placed = heads.union(bodies).repartition(max(1, min(-(-n // rows_per_file), MOST_FILES)), "record").sortWithinPartitions("record", "chunk_no")
    return cut(placed.mapInArrow(write, "path string, n long"), "manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """Read archives back: page_id, payload_bytes, payload_digest, record_type, refers_to; responses are verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for warc, http, size, digest in read_records(path):
                    told, length = warc["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                    kind = warc["WARC-Type"]
                    if kind == "response" and (told, length) != (digest, size):
                        raise ValueError(f"{path}: {warc['WARC-Record-ID']} is damaged")
                    rows.append((page_of(warc["WARC-Record-ID"]), length, told, kind, page_of(warc["WARC-Refers-To"]) if kind == "revisit" else None))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ship(manifest.sparkSession)
    files = max(1, manifest.count())
    return manifest.select("path").repartition(files, "path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every page's record as read back from the archives written."""
    root = fresh_path(spark, "warc")
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), root))


_BIT = "case substr(bits, i * 5 + j + 1, 1) when '1' then 16 >> j else 0 end"
ORACLE = f"""
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as n, from_hex(sha1(coalesce(html, '')))::bit::varchar as bits from pages),
d as (
  select page_id, n, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([{_BIT} for j in range(5)])::int, 1) for i in range(32)], 'string_agg', '') as digest from p),
g as (select *, max(page_id) over (partition by n, digest) as top, count(*) over (partition by n, digest) as k from d)
select page_id, n as payload_bytes, digest as payload_digest,
  case when k > 1 and page_id is distinct from top then 'revisit' else 'response' end as record_type,
  case when k > 1 and page_id is distinct from top then top end as refers_to
from g
"""
