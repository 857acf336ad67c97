"""Media columns: 8-bit grey PNG images in binary columns, and low-frequency cosine-transform hashes.

The codec is plain: chunks with CRC-32, zlib data, the five row filters undone with numpy. Encoding
takes, for the whole image, whichever of the filters none, left and up gives the smallest sum of
residuals, so that decoding undoes all its rows in one vectorised step.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the format
WIDTH = 64
SIDE, LOW = 32, 8
_DCT = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A PNG file of an image of uint8 samples (rows, columns)."""
    rows, cols = samples.shape
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    forms = (samples, left, up)
    kind = min(range(3), key=lambda i: int(np.minimum(forms[i], -forms[i]).sum()))
    lines = np.empty((rows, cols + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = forms[kind]
    header = struct.pack(">IIBBBBB", cols, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk; ValueError if the signature, a length or a checksum is wrong, or the end is missing."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG: signature")
    at = len(SIGNATURE)
    while True:
        if at + 12 > len(data):
            raise ValueError("not a PNG: it ends early")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r}: checksum")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undoes the row filters of one-byte samples; lines: (rows, 1 + columns), the filter first. Runs of rows with the same vectorisable filter go together."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    rows, cols = out.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    r = 0
    while r < rows:
        end = r + 1
        while end < rows and kinds[end] == kinds[r] and kinds[r] < 3:
            end += 1
        above = out[r - 1] if r else np.zeros(cols, np.uint8)
        if kinds[r] == 1:
            np.cumsum(out[r:end], axis=1, dtype=np.uint8, out=out[r:end])
        elif kinds[r] == 2:
            out[r] += above
            np.cumsum(out[r:end], axis=0, dtype=np.uint8, out=out[r:end])
        elif kinds[r] >= 3:
            row, prior = out[r].tolist(), above.tolist()
            for x in range(cols):
                a, b, c = (row[x - 1], prior[x], prior[x - 1]) if x else (0, prior[x], 0)
                if kinds[r] == 3:
                    guess = (a + b) // 2
                else:
                    near = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
                    guess = (a, b, c)[near.index(min(near))]
                row[x] = (row[x] + guess) & 255
            out[r] = row
        r = end
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples (rows, columns) of an 8-bit grey PNG that isn't interlaced."""
    header, body = None, []
    for kind, part in chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG")
    cols, rows = header[:2]
    flat = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(flat) != rows * (cols + 1):
        raise ValueError("its data don't fill the image")
    return unfilter(flat.reshape(rows, cols + 1))


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the 8x8 lowest cosine coefficients of the image, averaged down to 32x32, are over their median."""
    for axis in (0, 1):
        n = image.shape[axis]
        edges = np.arange(SIDE) * n // SIDE
        size = np.maximum((np.arange(SIDE) + 1) * n // SIDE - edges, 1)
        if n >= SIDE:
            image = np.add.reduceat(image, edges, axis=axis, dtype=np.float64) / size.reshape((-1, 1) if axis == 0 else (1, -1))
        else:
            image = np.take(image, edges, axis=axis).astype(np.float64)
    low = np.round(_DCT @ image @ _DCT.T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def payload(text: bytes) -> bytes:
    """Padded by zero bytes to a positive multiple of the width."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def store_media(docs: DataFrame, text: str = "text", level: int = 6) -> DataFrame:
    """Columns doc_id, n_bytes and media: each whole text's UTF-8 bytes, padded, as a PNG 64 samples wide. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                raw = [x or b"" for x in part["t"].to_pylist()]
                media = [encode_png(np.frombuffer(payload(x), np.uint8).reshape(-1, WIDTH), level) for x in raw]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("binary").alias("t")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """From doc_id, n_bytes and media: the digests and the feature of what is read back. A damaged image raises ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for media in batch["media"].to_pylist():
                image = decode_png(media)
                data = image.tobytes()
                out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
