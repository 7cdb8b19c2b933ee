"""WARC archives compressed record by record with Zstandard and a shared dictionary."""
from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import shared_dir, written
from .common import table

#: Fixed values of the formats: magic numbers (little endian) and line ends.
DICTIONARY_FRAME, SKIPPABLE, SKIPPABLE_MASK, PACKED = 0x184D2A5D, 0x184D2A50, 0xFFFFFFF0, 0xFD2FB528
EOL, END = b"\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "path string, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path).replace("s3a://", "s3://"))


# --- writing -----------------------------------------------------------------------------------

def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record; a revisit keeps the HTTP head, with the length of the payload it does not repeat."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(33) + '#$%&()*+,/:;=?@[]~-._' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def trained_dictionary(samples: list[bytes], size: int):
    """A dictionary, or None where the samples are too few or too alike to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return None


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 64 << 20, dict_bytes: int = 16 << 10, sample_bytes: int = 2 << 20) -> DataFrame:
    """Writes ``records`` (record_id, url, payload, digest, refers_to) as archives in ``folder``; returns the manifest.

    Each task writes archives of about ``archive_bytes``. An archive starts with its dictionary in a
    skippable frame, trained on its first ``sample_bytes`` of records (compression only, it cannot
    change a record), then holds one frame per record. File names are unique per attempt and the
    manifest is committed by Spark, so files of lost or repeated tasks are simply not listed.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def stream():
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    record_id, url, payload, digest, refers_to = row
                    yield record_bytes(record_id, url, payload, digest, refers_to, date)

        todo = stream()
        while True:
            head, held = [], 0
            for rec in todo:
                head.append(rec)
                held += len(rec)
                if held >= sample_bytes:
                    break
            if not head:
                return
            fs, base = _filesystem(folder)
            path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
            trained = trained_dictionary([r[:65536] for r in head], dict_bytes)
            packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
            with fs.open_output_stream(f"{base}/{path.rpartition('/')[2]}", compression=None) as out:
                if trained is not None:
                    packed = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
                    size += out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed) or 0
                for group in (head, todo):
                    for rec in group:
                        frame = packer.compress(rec)
                        out.write(frame)
                        n, size = n + 1, size + len(frame)
                        if group is todo and size >= archive_bytes:
                            break
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    rows = records.select("record_id", "url", "payload", "digest", "refers_to")
    return written(rows.mapInArrow(write, MANIFEST), "warc-manifest")


# --- reading -----------------------------------------------------------------------------------

class _Source:
    """Bytes of a file in blocks, with what was read too far put back."""

    def __init__(self, stream, block: int = 1 << 16):
        self.stream, self.block, self.rest = stream, block, b""

    def take(self, n: int) -> bytes:
        """n bytes, fewer at the end."""
        while len(self.rest) < n and (more := self.stream.read(max(self.block, n - len(self.rest)))):
            self.rest += more
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def any(self) -> bytes:
        out, self.rest = self.rest or self.stream.read(self.block), b""
        return out


def frames(stream) -> Iterator[bytes]:
    """The content of each frame. A leading dictionary frame (packed or not) is loaded, other skippable frames are passed over."""
    import zstandard

    source, unpacker, first = _Source(stream), zstandard.ZstdDecompressor(), True
    while magic := source.take(4):
        if len(magic) < 4:
            raise ValueError("truncated frame header")
        (number,) = struct.unpack("<I", magic)
        if number & SKIPPABLE_MASK == SKIPPABLE:
            size = source.take(4)
            (n,) = struct.unpack("<I", size) if len(size) == 4 else (-1,)
            body = source.take(n) if n >= 0 else b""
            if len(body) != n:
                raise ValueError("truncated skippable frame")
            if first and number == DICTIONARY_FRAME:
                if body[:4] == struct.pack("<I", PACKED):
                    body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 28)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
        else:
            frame, chunks, data = unpacker.decompressobj(), [], magic
            while not frame.eof:
                if not data:
                    raise ValueError("truncated frame")
                chunks.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else source.any()
            source.rest = data + source.rest
            yield b"".join(chunks)
        first = False


def parsed(record: bytes) -> dict:
    """The fields of a record; raises ValueError on a bad version, header, length, ending or digest."""
    head, mark, rest = record.partition(END)
    first, *lines = head.split(EOL)
    if not mark or not re.fullmatch(rb"WARC/1\.[01]", first):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name.strip().lower().decode("ascii")] = value.strip().decode("utf-8")
    if missing := [k for k in REQUIRED if k not in fields]:
        raise ValueError(f"headers missing: {missing}")
    if not re.fullmatch(r"[0-9]+", fields["content-length"]) or len(rest) != int(fields["content-length"]) + len(END) or not rest.endswith(END):
        raise ValueError(f"block is not of the declared length {fields['content-length']}")
    kind, block, payload, size = fields["warc-type"], rest[: -len(END)], None, None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind in ("response", "revisit"):
        http, mark, body = block.partition(END)
        length = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", http)
        if not mark or not http.startswith(b"HTTP/") or not length:
            raise ValueError("no HTTP head with a length in the block")
        size = int(length[1])
        if kind == "response":
            payload = body
            if len(body) != size:
                raise ValueError("payload is not of the length its HTTP head declares")
            if digest and hashlib.sha256(body).hexdigest() != digest:
                raise ValueError("payload does not match its digest")
        elif body or "warc-refers-to" not in fields:
            raise ValueError("a revisit without reference or with a payload")
    own = {"record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri")}
    return own | {"refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "payload_digest": digest, "payload_bytes": size, "payload": payload}


def read_archives(manifest: DataFrame, strict: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of the archives named in ``manifest.path``, one row each, with their payloads.

    Files are streamed: a task holds one block, one record and one batch. A record that fails a check
    raises an error; with ``strict=False`` it is a row with ``error`` set, and so is a broken frame,
    after which the rest of that file cannot be read.
    """
    names = [f.split()[0] for f in RECORDS.split(", ")]
    schema = pa.schema([(n, {"payload_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            rows, held = [], 0
            fs, inner = _filesystem(path)
            with fs.open_input_stream(inner, compression=None) as stream:
                found = frames(stream)
                while True:
                    row = dict.fromkeys(names) | {"path": path}
                    try:
                        record = next(found, None)
                        if record is None:
                            break
                        row |= parsed(record)
                    except Exception as e:
                        if strict:
                            raise ValueError(f"{path}: {e}") from e
                        row["error"] = str(e)
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(tasks).mapInArrow(read, RECORDS)


# --- the pages ---------------------------------------------------------------------------------

def page_records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """A record per page: payload the html in UTF-8 (null: empty), and which earlier record it revisits.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the response. Repeated rows of
    that id are all responses; null ids revisit it, and where all ids are null all are responses.
    Repeats are found per digest with map-side counts; only digests that repeat are joined back, with
    no grouping above the join, so that a payload of a third of all pages can be split.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    rows = rows.join(firsts, "digest", "left")
    urn = F.lit("urn:x-page:")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        F.concat(urn, F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"), "url", "payload", "digest",
        F.when(other, F.concat(urn, F.col("first").cast("string"))).alias("refers_to"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/genoloom/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(page_records(table(spark, sf_dir, "pages")), folder)
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    return read_archives(manifest).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
