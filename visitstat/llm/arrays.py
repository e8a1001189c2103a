"""Compact binary form of integer arrays, for messages between tasks."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays (or float64) as one compressed value: each in its
    smallest width, bytes of equal weight together."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        if a.dtype == np.float64:
            kind = b"f"
        else:
            top = int(a.max()) if len(a) else 0
            kind = b"1" if top < 1 << 8 else b"2" if top < 1 << 16 else b"4" if top < 1 << 32 else b"8"
            a = a.astype(f"<u{kind.decode()}")
        head.append(kind + struct.pack("<q", len(a)))
        body.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``: int64 (uint64 where they need it) or float64."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = raw[0], 1 + 9 * raw[0], []
    for i in range(n):
        kind, size = raw[1 + 9 * i:2 + 9 * i], struct.unpack_from("<q", raw, 2 + 9 * i)[0]
        width = 8 if kind == b"f" else int(kind)
        flat = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        at += size * width
        a = np.ascontiguousarray(flat).view("<f8" if kind == b"f" else f"<u{width}").reshape(size)
        out.append(a if kind == b"f" else a.astype(np.uint64 if width == 8 else np.int64))
    return out
