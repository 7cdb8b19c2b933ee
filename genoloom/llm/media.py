"""Byte payloads as columns of lossless WebP images, and features of the images read back."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .webp import containers, decode_streams, encode_images

#: A row of an image: 144 pixels of four 8-bit samples, 576 bytes. An image has at most MAX_ROWS rows; a longer payload is a series.
WIDTH, SAMPLES, MAX_ROWS = 144, 4, 8
UNIT = WIDTH * SAMPLES


def padded(data: bytes) -> bytes:
    """Filled with bytes 255 up to a positive multiple of 576."""
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return data + b"\xff" * (size - len(data))


def to_media(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 576 bytes) as files that follow each other, first rows first."""
    rows = np.array([len(p) // UNIT for p in payloads], np.int64)
    images = -(-rows // MAX_ROWS)
    owner = np.repeat(np.arange(len(rows)), images)
    last = np.cumsum(images) - 1
    heights = np.full(images.sum(), MAX_ROWS, np.int64)
    heights[last] = rows - (images - 1) * MAX_ROWS
    pixels = np.frombuffer(b"".join(payloads), "<u4").astype(np.uint32)
    files, out = encode_images(pixels, heights, WIDTH), [[] for _ in payloads]
    for i, data in zip(owner, files, strict=True):
        out[i].append(data)
    return [b"".join(x) for x in out]


def from_media(media: list[bytes]) -> list[np.ndarray]:
    """Pixel arrays (rows, 144, 4 samples) of each series."""
    streams = [containers(m) for m in media]
    images = iter(decode_streams([s for some in streams for s in some]))
    return [np.concatenate([next(images) for _ in some]).astype("<u4").view(np.uint8).reshape(-1, WIDTH, SAMPLES) for some in streams]


def feature(pixels: np.ndarray) -> str:
    """Average hash: the samples in 64 equal parts, a bit for each part that is at least as bright as the median part; 16 hex digits."""
    means = pixels.reshape(64, -1).mean(axis=1)
    return f"{int(np.packbits(means >= np.median(means)).view('>u8')[0]):016x}"


def _groups(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        end, held = at, 0
        while end < len(sizes) and (end == at or held + sizes[end] <= limit):
            held, end = held + sizes[end], end + 1
        yield at, end
        at = end


def _encode(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """id, data -> id, n_bytes, media"""
    for batch in batches:
        sizes = [n or 0 for n in pa.compute.binary_length(batch.column(1)).to_pylist()]
        for a, b in _groups(sizes, batch_bytes):
            media = to_media([padded(v or b"") for v in batch.column(1).slice(a, b - a).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes[a:b], pa.int64()), pa.array(media, pa.binary())], [batch.schema.names[0], "n_bytes", "media"])


def _decode(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """id, n_bytes, media -> id, n_bytes, payload, media_bytes, media_sha256, feature"""
    for batch in batches:
        media = batch.column(2).to_pylist()
        for a, b in _groups([len(m) for m in media], batch_bytes):
            some = media[a:b]
            pixels = from_media(some)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([p.tobytes() for p in pixels], pa.binary()), pa.array([len(m) for m in some], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in some]), pa.array([feature(p) for p in pixels]),
            ], [batch.schema.names[0], "n_bytes", "payload", "media_bytes", "media_sha256", "feature"])


STORED, READ = "n_bytes long, media binary", "n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string"


def _id(rows: DataFrame, id_col: str) -> str:
    return f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}"


def store(rows: DataFrame, id_col: str, data_col: str, batch_bytes: int = 2 << 20) -> DataFrame:
    """(id, n_bytes, media): the binary column ``data_col`` padded and stored as WebP files.

    Null is empty; every payload has at least one row of pixels. Equal payloads give equal files.
    About ``batch_bytes`` of payloads are encoded at a time; a longer one alone. Other columns are ignored.
    """
    given = rows.select(F.col(f"`{id_col}`"), F.col(f"`{data_col}`").cast("binary"))
    return given.mapInArrow(lambda batches: _encode(batches, batch_bytes), f"{_id(rows, id_col)}, {STORED}")


def read(stored: DataFrame, id_col: str, batch_bytes: int = 2 << 20) -> DataFrame:
    """(id, n_bytes, payload, media_bytes, media_sha256, feature) from ``store``'s columns: the files are decoded to pixel arrays."""
    return stored.select(F.col(f"`{id_col}`"), "n_bytes", "media").mapInArrow(lambda batches: _decode(batches, batch_bytes), f"{_id(stored, id_col)}, {READ}")


def stored_and_read(rows: DataFrame, id_col: str, data_col: str, batch_bytes: int = 2 << 20) -> DataFrame:
    """``read`` of ``store`` in one task: the files of a batch are written, then read back, and one Python worker does both."""
    given = rows.select(F.col(f"`{id_col}`"), F.col(f"`{data_col}`").cast("binary"))
    return given.mapInArrow(lambda batches: _decode(_encode(batches, batch_bytes), batch_bytes), f"{_id(rows, id_col)}, {READ}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    back = stored_and_read(docs, "doc_id", "data")
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
