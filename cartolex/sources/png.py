"""PNG images: 8 bits a channel, grey or colour, with or without alpha, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .varint import Malformed

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 4: 2, 2: 3, 6: 4}  # by colour type
MOST = 1 << 26  # bytes of pixels
SCHEMA = "width int, height int, rgba binary"


def _chunks(b: bytes):
    if not b.startswith(SIGNATURE):
        raise Malformed("not a PNG")
    at = len(SIGNATURE)
    while at < len(b):
        if at + 12 > len(b):
            raise Malformed("a truncated chunk")
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        if at + 12 + size > len(b):
            raise Malformed("a truncated chunk")
        yield kind, b[at + 8 : at + 8 + size]
        if kind == b"IEND":
            return
        at += 12 + size
    raise Malformed("no end")


def _near(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and above left, that nearest to left + above - above left; ties in this order."""
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def decode(b: bytes) -> np.ndarray:
    """Pixels as (height, width, 4)."""
    head, data = None, []
    for kind, body in _chunks(b):
        if kind == b"IHDR":
            if len(body) != 13:
                raise Malformed("a bad header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None:
        raise Malformed("no header")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in CHANNELS or interlaced or not width or not height or width * height * 4 > MOST:
        raise Malformed("a kind of PNG that is not read")
    n = CHANNELS[colour]
    try:
        raw = zlib.decompressobj().decompress(b"".join(data), height * (width * n + 1) + 1)
    except zlib.error as e:
        raise Malformed(str(e)) from e
    if len(raw) != height * (width * n + 1):
        raise Malformed("pixels missing or too many")
    lines = np.frombuffer(raw, np.uint8).reshape(height, -1)
    out = np.zeros((height + 1, width + 1, n), np.int32)  # a row above and a column to the left of zeros
    for y in range(height):
        how, line = int(lines[y, 0]), lines[y, 1:].reshape(width, n).astype(np.int32)
        up = out[y]
        row = out[y + 1]
        if how == 0:
            row[1:] = line
        elif how == 1:
            row[1:] = np.cumsum(line, 0) & 255
        elif how == 2:
            row[1:] = (line + up[1:]) & 255
        elif how in (3, 4):
            for x in range(1, width + 1):
                guess = (row[x - 1] + up[x]) >> 1 if how == 3 else _near(row[x - 1], up[x], up[x - 1])
                row[x] = (line[x - 1] + guess) & 255
        else:
            raise Malformed(f"filter {how}")
    pixels = out[1:, 1:].astype(np.uint8)
    rgba = np.full((height, width, 4), 255, np.uint8)
    rgba[..., :3] = pixels[..., : 3 if n > 2 else 1]
    if n in (2, 4):
        rgba[..., 3] = pixels[..., -1]
    return rgba


def encode(rgba: np.ndarray, how: int = 0) -> bytes:
    """A PNG of (height, width, 4) pixels, all rows by filter 0, 1 or 2."""
    height, width, _ = rgba.shape
    flat = rgba.reshape(height, -1).astype(np.int32)
    before = {0: np.zeros_like(flat), 1: np.pad(flat, ((0, 0), (4, 0)))[:, :-4], 2: np.pad(flat, ((1, 0), (0, 0)))[:-1]}[how]
    lines = np.concatenate([np.full((height, 1), how), (flat - before) & 255], 1).astype(np.uint8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode_images(images: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, width, height and rgba of images (``data``); nulls where the bytes are no such PNG."""
    kept = images.select(*keys)

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column("data").to_pylist():
                try:
                    p = decode(data or b"")
                    rows.append((p.shape[1], p.shape[0], p.tobytes()))
                except Malformed:
                    rows.append((None, None, None))
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *made], [*keys, "width", "height", "rgba"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + SCHEMA
    return images.select(*keys, "data").mapInArrow(run, schema)
