"""Hashed sets of word shingles, computed over whole Arrow columns at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
#: Bytes hashed in one pass; a text is only divided at white space.
PIECE = 1 << 20
#: Bytes of text whose shingles are held at once, unless one text is longer.
PART = 6 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


CODES = mix(np.arange(1, 257, dtype=np.uint64))
FACTORS = mix(np.arange(1001, 1065, dtype=np.uint64)) | U(1)


def powers(n: int, base: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base & (2**64 - 1), np.uint64))))


class Hasher:
    """Word hashes of texts: lower-cased in ASCII, divided at ASCII white space."""

    def __init__(self) -> None:
        self.grow(PIECE)

    def grow(self, n: int) -> None:
        self.n, self.up, self.down = n, powers(n, BASE), powers(n, pow(BASE, -1, 2**64))

    def words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of every word of ``data``; words also end at the offsets ``cuts``."""
        if len(data) > self.n:
            self.grow(len(data))
        inside = ~SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins = cuts[cuts < len(data)]
        first[begins] = inside[begins]
        stops = cuts[(cuts > 0) & (cuts <= len(data))] - 1
        last[stops] = inside[stops]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(CODES[LOWER[data]] * self.up[: len(data)])))
        return mix((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64)), start

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Byte ranges that hold whole words, about PIECE long."""
        at, end = int(offsets[0]), int(offsets[-1])
        ends = offsets[1:]
        while at < end:
            stop = min(at + PIECE, end)
            if stop < end:
                i = int(np.searchsorted(ends, stop, "right")) - 1
                if i >= 0 and ends[i] > at:
                    stop = int(ends[i])  # between two texts
                else:
                    text_end = int(ends[i + 1])
                    white = np.flatnonzero(SPACE[data[stop:text_end]])
                    stop = stop + int(white[0]) if len(white) else text_end
            yield at, stop
            at = stop

    def sets(self, column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(row, sorted distinct hashes) of each text's k-word shingles; with fewer words, of the whole text as one."""
        texts = column.fill_null("").cast(pa.large_string())
        if not len(texts):
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
        part = (offsets[1:] - offsets[0]) // PART
        groups = np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1)
        for rows in groups:
            own = offsets[rows[0] : rows[-1] + 2]
            hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for lo, hi in self.pieces(data, own):
                h, start = self.words(data[lo:hi], own[(own >= lo) & (own <= hi)] - lo)
                hashes.append(h)
                docs.append(np.searchsorted(own, start + lo, "right") - 1)
            w, d = np.concatenate(hashes), np.concatenate(docs)
            first = np.searchsorted(d, np.arange(len(rows) + 1))
            m = len(w) - k + 1
            s = np.zeros(max(m, 0), np.uint64)
            for j in range(k if m > 0 else 0):
                s += w[j : j + m] * FACTORS[j]
            s = mix(s)
            for i, row in enumerate(rows.tolist()):
                a, b = int(first[i]), int(first[i + 1])
                if b - a >= k:
                    yield row, np.unique(s[a : b - k + 1])
                elif b > a:
                    yield row, mix(np.array([(w[a:b] * FACTORS[: b - a]).sum() + U(b - a)], np.uint64))
                else:
                    yield row, np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """64 bits that name a set, as a signed integer."""
    total = mix(mix(s ^ U(0x5851F42D4C957F2D)).sum(keepdims=True) + U(len(s)))
    return int(total.view(np.int64)[0])
