"""Arrays of whole numbers as compressed bytes, for tables whose rows are batches."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on: byte planes together, as many as the largest number needs, so that what repeats compresses."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a, np.int64)
        width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        parts += [struct.pack("<qq", len(a), width), a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(data):
        n, width = struct.unpack_from("<qq", data, at)
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(planes.view(np.int64).reshape(-1))
        at += 16 + n * width
    return out
