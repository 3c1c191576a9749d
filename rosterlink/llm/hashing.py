"""Hashes of spans of bytes, vectorised: a random word for each byte value, times a power of an odd base, mod 2**64.

A span's hash is the difference of two prefix sums, times the inverse of the power at its start; then it is mixed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C17
SOME_BYTES = 1 << 20
_letters = np.random.default_rng(20_240_229).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; kept up to a few MB."""
    if n > len(_powers["up"]):
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(n, np.uint64(base), np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        if n > 2 * SOME_BYTES:
            return out[0], out[1]
        _powers["up"], _powers["down"] = out
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


class Spans:
    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_letters[data] * up[:-1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def all_of(self, size: int) -> np.ndarray:
        """The hashes of all spans of so many bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row (nulls: none), and where each text starts and the last ends."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def some_at_a_time(offsets: np.ndarray, most: int = SOME_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes in all, one text at least."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b
