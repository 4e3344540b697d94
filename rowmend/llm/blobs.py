"""Integer arrays as small binary values: minimal width, byte planes, zstd."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<IqB")


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**64."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    body = zstandard.ZstdCompressor(level=6).compress(planes)
    return _HEAD.pack(len(body), len(values), width) + body


def packed_all(*arrays: np.ndarray) -> bytes:
    return b"".join(packed(a) for a in arrays)


def unpacked_all(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        size, count, width = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        planes = zstandard.ZstdDecompressor().decompress(raw[at : at + size], max_output_size=max(1, count * width))
        at += size
        wide = np.zeros((count, 8), np.uint8)
        wide[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, count).T
        out.append(wide.view(np.uint64).reshape(-1))
    return out


def unpacked(raw: bytes) -> np.ndarray:
    return unpacked_all(raw)[0]
