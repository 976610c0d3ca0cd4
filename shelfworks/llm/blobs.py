"""Arrays of whole numbers as compressed bytes, for rows that carry many numbers at once."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def squeezed(raw: bytes) -> bytes:
    """Bytes, compressed, behind their length."""
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(blob: bytes) -> bytes:
    """The bytes of squeezed() again."""
    return pa.decompress(blob[8:], decompressed_size=struct.unpack_from("<Q", blob)[0], codec="zstd", asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers with equal byte places side by side, so that unused places cost nothing."""
    return squeezed(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unplaned(blob: bytes) -> np.ndarray:
    """The numbers of planes() again, unsigned."""
    raw = unsqueezed(blob)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def deltas(sorted_: np.ndarray) -> bytes:
    """A sorted array of unsigned numbers as the steps between them."""
    return planes(np.diff(sorted_, prepend=np.uint64(0)))


def undeltas(blob: bytes) -> np.ndarray:
    """The numbers of deltas() again."""
    return np.cumsum(unplaned(blob), dtype=np.uint64)


def runs_of(numbers: np.ndarray):
    """(number, slice) of each run of equal numbers in a sorted array."""
    if len(numbers):
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(numbers)]):
            yield int(numbers[a]), slice(a, b)
