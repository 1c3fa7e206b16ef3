"""Variable-length integers and protobuf fields."""

from __future__ import annotations

from collections.abc import Iterator


class Malformed(ValueError):
    """The bytes are not what they should be."""


def varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise Malformed("truncated varint")
        out |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return out & (1 << 64) - 1, at
        shift += 7


def zigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def packed(b: bytes) -> list[int]:
    out, at = [], 0
    while at < len(b):
        v, at = varint(b, at)
        out.append(v)
    return out


def fields(b: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a message."""
    at = 0
    while at < len(b):
        tag, at = varint(b, at)
        kind = tag & 7
        if kind == 0:
            v, at = varint(b, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v, at = b[at : at + n], at + n
        elif kind == 2:
            n, at = varint(b, at)
            v, at = b[at : at + n], at + n
        else:
            raise Malformed(f"wire type {kind}")
        if at > len(b):
            raise Malformed("truncated field")
        yield tag >> 3, kind, v
