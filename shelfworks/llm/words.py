"""Words of a text as bytes, and bounded per-worker memories of what a word stands for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import xxhash


def words(text: str | None) -> list[bytes]:
    """The runs of bytes between ASCII white space (0x20, 0x09-0x0D), as they are."""
    return (text or "").encode().split()


class Remembered(dict):
    """word -> number, worked out on first sight; it starts afresh when it has grown to ``most`` words."""

    def __init__(self, number: Callable[[bytes], int], most: int = 300_000):
        super().__init__()
        self.number, self.most = number, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = n = self.number(word)
        return n

    def of(self, found: Sequence[bytes], dtype=np.uint64) -> np.ndarray:
        """The numbers of a sequence of words."""
        return np.fromiter(map(self.__getitem__, found), dtype, len(found))


def word_hash(word: bytes) -> int:
    """64 bits that stand for a word."""
    return xxhash.xxh3_64_intdigest(word)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the published splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-word windows; one for the whole sequence where it is shorter; none where it is empty."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k])
    return out


_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """A random number per byte; powers of an odd base and of its inverse modulo 2**64. Made once a worker."""
    if not _tables:
        with np.errstate(over="ignore"):
            letters = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
            up = np.cumprod(np.append(np.uint64(1), np.full(_BLOCK, _BASE, np.uint64)), dtype=np.uint64)
            down = np.cumprod(np.append(np.uint64(1), np.full(_BLOCK, pow(_BASE, -1, 1 << 64), np.uint64)), dtype=np.uint64)
        letters[_SPACE] = 0
        _tables.extend((letters, up, down))
    return _tables


def hashes_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What word_hashes() gives for the words at these places of at most a block of bytes."""
    letters, up, down = _powers()
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(letters[data] * up[: len(data)], dtype=np.uint64))
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order, block by block; equal words have equal hashes wherever they are."""
    letters, up, down = _powers()
    parts, open_sum, open_len = [], 0, 0
    data = np.frombuffer(raw, np.uint8)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), _BLOCK):
            block = data[at : at + _BLOCK]
            inside = np.concatenate(([False], ~_SPACE[block], [False]))
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            starts, ends = edges[::2], edges[1::2]
            sums = np.append(np.uint64(0), np.cumsum(letters[block] * up[: len(block)], dtype=np.uint64))
            found, length = (sums[ends] - sums[starts]) * down[starts], (ends - starts).astype(np.uint64)
            if open_len:  # a word that began in the block before
                if len(starts) and starts[0] == 0:
                    found[0] = np.uint64(open_sum) + found[0] * np.uint64(pow(_BASE, open_len, 1 << 64))
                    length[0] += np.uint64(open_len)
                else:
                    parts.append(np.array([[open_sum], [open_len]], np.uint64))
                open_len = 0
            if len(ends) and ends[-1] == len(block) and at + _BLOCK < len(data):
                open_sum, open_len = int(found[-1]), int(length[-1])
                found, length = found[:-1], length[:-1]
            parts.append(np.vstack([found, length]))
        if not parts:
            return np.zeros(0, np.uint64)
        both = np.hstack(parts)
        return mix64(both[0] + both[1] * np.uint64(0xA24BAED4963EE407))
