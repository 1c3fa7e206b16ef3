"""Tile archives: header, directories and a Spark data source that reads by ranges of tile ids."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .varint import Malformed, varint

HEADER = struct.Struct("<7sB11Q6B4iB2i")
NAMES = (
    "magic version root_offset root_length metadata_offset metadata_length leaf_offset leaf_length data_offset data_length addressed entries contents "
    "clustered internal_compression tile_compression tile_type min_zoom max_zoom min_lon min_lat max_lon max_lat center_zoom center_lon center_lat"
).split()
PLAIN, GZIP = 1, 2


@dataclass(frozen=True)
class Entry:
    tile_id: int
    offset: int
    length: int
    run: int  # 0: the entry points to a leaf directory


def header(b: bytes) -> dict:
    if len(b) < 127:
        raise Malformed("a header has 127 bytes")
    values = HEADER.unpack(b[: HEADER.size])
    if values[0] != b"PMTiles" or values[1] != 3:
        raise Malformed("not a version 3 archive")
    return dict(zip(NAMES, values, strict=True))


def inflate(b: bytes, compression: int) -> bytes:
    if compression in (0, PLAIN):
        return b
    if compression == GZIP:
        return gzip.decompress(b)
    raise Malformed("unsupported compression")


def directory(b: bytes) -> list[Entry]:
    """Entries of a directory: columns of id steps, runs, lengths, and offsets (0: right after the one before)."""
    n, at = varint(b, 0)
    if n > len(b):
        raise Malformed("more entries than bytes")
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            v, at = varint(b, at)
            column.append(v)
        columns.append(column)
    out, tile = [], 0
    for i, (step, run, length, offset) in enumerate(zip(*columns, strict=True)):
        tile += step
        if offset == 0 and i == 0:
            raise Malformed("the first offset is 0")
        out.append(Entry(tile, out[-1].offset + out[-1].length if offset == 0 else offset - 1, length, run))
    return out


def tile_zxy(tile_id: int) -> tuple[int, int, int]:
    """The tile of an id on the Hilbert curve."""
    z = 0
    while tile_id >= 4**z:
        tile_id -= 4**z
        z += 1
    x = y = 0
    for i in range(z):
        rx = 1 & tile_id >> 1
        ry = 1 & (tile_id ^ rx)
        if ry == 0:
            if rx == 1:
                x, y = (1 << i) - 1 - x, (1 << i) - 1 - y
            x, y = y, x
        x, y = x + (rx << i), y + (ry << i)
        tile_id >>= 2
    return z, x, y


class Archive:
    """An archive in a file; directories are read as they are needed."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        self.head = header(self._read(0, 127))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        b = self.file.read(n)
        if len(b) < n:
            raise Malformed("the archive ends early")
        return b

    def root(self) -> list[Entry]:
        return directory(inflate(self._read(self.head["root_offset"], self.head["root_length"]), self.head["internal_compression"]))

    def leaf(self, e: Entry) -> list[Entry]:
        return directory(inflate(self._read(self.head["leaf_offset"] + e.offset, e.length), self.head["internal_compression"]))

    def entries(self, among: list[Entry] | None = None, depth: int = 0) -> Iterator[Entry]:
        if depth > 3:
            raise Malformed("directories nest too deep")
        for e in self.root() if among is None else among:
            if e.run:
                yield e
            else:
                yield from self.entries(self.leaf(e), depth + 1)

    def find(self, tile_id: int) -> Entry | None:
        """The entry of a tile: the last one that starts at or before it, through at most three leaves."""
        entries = self.root()
        for _ in range(4):
            lo, hi = 0, len(entries)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if entries[mid].tile_id <= tile_id else (lo, mid)
            if not lo:
                return None
            e = entries[lo - 1]
            if e.run:
                return e if tile_id < e.tile_id + e.run else None
            entries = self.leaf(e)
        return None

    def tile(self, e: Entry) -> bytes:
        return inflate(self._read(self.head["data_offset"] + e.offset, e.length), self.head["tile_compression"])

    def metadata(self) -> bytes:
        return inflate(self._read(self.head["metadata_offset"], self.head["metadata_length"]), self.head["internal_compression"])


@dataclass
class Part(InputPartition):
    entries: list


class TileReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts = options["path"], int(options.get("partitions", 8))

    def partitions(self):
        root = Archive(self.path).root()
        n = max(1, min(self.parts, len(root)))
        return [Part(root[i * len(root) // n : (i + 1) * len(root) // n]) for i in range(n)]

    def read(self, part):
        a = Archive(self.path)
        for e in a.entries(part.entries):
            data = a.tile(e)
            for i in range(e.run):
                yield (e.tile_id + i, *tile_zxy(e.tile_id + i), data)


class PMTilesSource(DataSource):
    """``spark.read.format("pmtiles").load(path)``; the path is one that all executors can open."""

    @classmethod
    def name(cls):
        return "pmtiles"

    def schema(self):
        return "tile_id long, z int, x int, y int, data binary"

    def reader(self, schema):
        return TileReader(self.options)


def write(path: str, tiles: dict[int, bytes], min_zoom: int = 0, max_zoom: int = 14) -> None:
    """A small archive with one directory, for tests and export; equal neighbours become runs."""
    entries, data, known = [], b"", {}
    for tid in sorted(tiles):
        b = gzip.compress(tiles[tid], mtime=0)
        if b not in known:
            known[b] = len(data)
            data += b
        e = entries[-1] if entries else None
        if e and e.offset == known[b] and e.tile_id + e.run == tid:
            entries[-1] = Entry(e.tile_id, e.offset, e.length, e.run + 1)
        else:
            entries.append(Entry(tid, known[b], len(b), 1))

    def put(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    steps = [e.tile_id - (entries[i - 1].tile_id if i else 0) for i, e in enumerate(entries)]
    root = gzip.compress(put(len(entries)) + b"".join(map(put, [*steps, *(e.run for e in entries), *(e.length for e in entries), *(e.offset + 1 for e in entries)])), mtime=0)
    meta = gzip.compress(b"{}", mtime=0)
    head = HEADER.pack(b"PMTiles", 3, 127, len(root), 127 + len(root), len(meta), 0, 0, 127 + len(root) + len(meta), len(data), len(tiles), len(entries), len(known), 1, GZIP, GZIP, 1, min_zoom, max_zoom, -1800000000, -850000000, 1800000000, 850000000, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(head.ljust(127, b"\0") + root + meta + data)
