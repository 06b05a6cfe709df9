"""WARC archives (op 8): writing, the monolithic gzip normaliser, and reading back.

A crawler that compresses a whole archive as one gzip stream leaves it without random access. The
normaliser inflates such a stream once, from beginning to end in bounded chunks, rewrites every record as a gzip
member of its own and writes a sidecar index of offsets, so that a reader can seek to a record.

Files lie in the shared folder. A task names its files at random and reports them when
they are whole; what a lost task left behind is never named and never read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_folder, pick, qualified, table

#: Payloads shorter than this are always stored.
LEAST_REVISIT = 100
#: An archive ends after the record that brings it to so many bytes before compression.
ARCHIVE_BYTES = 64 << 20
LEVEL = 4
CHUNK = 1 << 20
#: Members that lie side by side are read in ranges of about so many bytes.
RANGE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _at(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """A response record, or, where ``refers_to`` is given, a revisit record without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(stream) -> Iterator[bytes]:
    """The stream's bytes after inflation, in chunks; it may hold one gzip member or many."""
    d = zlib.decompressobj(31)
    while chunk := stream.read(CHUNK):
        while chunk:
            yield d.decompress(chunk, CHUNK)
            while d.unconsumed_tail:
                yield d.decompress(d.unconsumed_tail, CHUNK)
            chunk = d.unused_data
            if d.eof:
                d = zlib.decompressobj(31)
    yield d.flush()


def records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(head, whole record) one by one; what is held is one record and one chunk."""
    held = bytearray()
    need = None
    for c in chunks:
        held += c
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = bytes(held[:end])
                need = end + 4 + int(headers(head)["content-length"]) + 4
            if len(held) < need:
                break
            yield head, bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Archives of one gzip stream each, of rows (page_id, url, html, digest, size, refers_to); returns their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, z, size = None, None, 0

        def close() -> pa.RecordBatch:
            nonlocal out, size
            out.write(z.flush())
            out.close()
            out, size = None, 0
            return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

        for b in batches:
            for page_id, url, html, digest, n, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size", "refers_to")), strict=True):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, path = _at(name)
                    out, z = fs.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                r = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, n, refers)
                size += len(r)
                out.write(z.compress(r))
                if size >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    return cut(pages.mapInArrow(run, "file string"), "archives")


def normalise(archives: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite archives (column ``file``): one gzip member a record, and ``<file>.idx`` beside it with a line
    of offset, length, type, record id for each. Returns (file, index, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source in b.column("file").to_pylist():
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                fs, path = _at(source)
                to, target = _at(name)
                offset, n = 0, 0
                with fs.open_input_stream(path, compression=None) as s, to.open_output_stream(target, compression=None) as out, to.open_output_stream(target + ".idx", compression=None) as index:
                    for head, whole in records(inflate(s)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        h = headers(head)
                        index.write(f"{offset}\t{len(member)}\t{h['warc-type']}\t{h['warc-record-id']}\n".encode())
                        out.write(member)
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([name + ".idx"]), pa.array([n], pa.int64())], ["file", "index", "n_records"])

    return cut(_one_a_task(archives).mapInArrow(run, "file string, index string, n_records long"), "normalised")


def _one_a_task(files: DataFrame) -> DataFrame:
    """Archives are dealt out singly: a row is a file's name, its work a whole archive."""
    return files.repartition(max(1, files.count()))


def read_back(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Every record of normalised archives (file, index), read by the offsets of its sidecar: page_id, payload_bytes,
    payload_digest, record_type, refers_to. A payload that differs from its digest raises."""

    def page(value: str | None) -> str | None:
        found = value[len("<urn:page:") : -1] if value else ""
        return found or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for name, index in zip(b.column("file").to_pylist(), b.column("index").to_pylist(), strict=True):
                fs, path = _at(name)
                _, index_path = _at(index)
                out = []
                with fs.open_input_file(path) as f, fs.open_input_stream(index_path, compression=None) as s:
                    for kind, offset, member in _members(f, _lines(s)):
                        head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
                        h = headers(head)
                        http, _, body = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                        size = int(headers(http)["content-length"])
                        if kind == b"response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != size):
                            raise ValueError(f"{name}: the payload at {offset} differs from its digest")
                        out.append((page(h["warc-record-id"]), size, digest, h["warc-type"], page(h.get("warc-refers-to"))))
                        if len(out) == 5000:
                            yield batch(out)
                            out = []
                if out:
                    yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(cols)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    rows = _one_a_task(archives).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _members(f, lines: Iterator[bytes]) -> Iterator[tuple[bytes, int, bytes]]:
    """(type, offset, gzip member) of each line of an index, read in ranges of neighbouring members."""
    held: list[tuple[bytes, int, int]] = []

    def read() -> Iterator[tuple[bytes, int, bytes]]:
        start = held[0][1]
        f.seek(start)
        raw = f.read(held[-1][1] + held[-1][2] - start)
        for kind, offset, length in held:
            yield kind, offset, raw[offset - start : offset - start + length]
        held.clear()

    for line in lines:
        at, n, kind, _id = line.split(b"\t")
        offset, length = int(at), int(n)
        if held and (held[-1][1] + held[-1][2] != offset or offset + length - held[0][1] > RANGE_BYTES):
            yield from read()
        held.append((kind, offset, length))
    if held:
        yield from read()


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while chunk := stream.read(CHUNK):
        *whole, held = (held + chunk).split(b"\n")
        yield from whole


def marked(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Rows with digest, size and refers_to: the smallest page_id among equal payloads of at least
    ``least_revisit`` bytes, null for that page itself, for shorter payloads and where all ids are null."""
    d = pick(pages, "page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    d = d.withColumn("digest", F.sha2(html, 256)).withColumn("size", F.octet_length(html).cast("long"))
    # only payloads that more than one page has are looked up
    first = d.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = d.join(first, "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def archive(pages: DataFrame, least_revisit: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write, normalise; returns (file, index, n_records).

    A null html is an empty payload, a null url is left out, a null page_id stays null; rows that repeat the smallest
    page_id of a payload are responses each. A very long page is one record, held as a whole by one task. Other columns are
    left out, whatever their names. An empty table gives no archive.
    """
    spark = pages.sparkSession
    raw, final = (qualified(spark, new_folder(spark, n)) for n in ("warc-raw", "warc"))
    for folder in (raw, final):
        fs, path = _at(folder)
        fs.create_dir(path, recursive=True)
    return normalise(write_monolithic(marked(pages, least_revisit), raw, archive_bytes), final)


def op8_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return read_back(archive(pages), pages.schema["page_id"].dataType.simpleString())


OP8_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
