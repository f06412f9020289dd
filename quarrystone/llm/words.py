"""Words of whole texts as numpy arrays: boundaries, 64-bit hashes, hashes of runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from quarrystone.llm.store import ship

ship(__name__)

#: Bytes of text that are worked on at once; a longer text makes a block of its own.
BLOCK = 1 << 20
#: Bytes whose powers and products are held at once while words are hashed.
CHUNK = 1 << 22


def separators(kind: str) -> np.ndarray:
    """Which bytes of UTF-8 part words. "space": 0x20 and 0x09-0x0D. "alnum": all of ASCII but letters and digits."""
    out = np.zeros(256, bool)
    if kind == "space":
        out[[0x20, *range(0x09, 0x0E)]] = True
    else:
        out[:0x80] = True
        out[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
    return out


def lowered() -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes: every bit depends on every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """The words of a block of texts. norm: the words' bytes, one space after each; word i is norm[start[i]:end[i]]; text t has the words first[t]:first[t + 1]."""

    def __init__(self, texts: list[bytes | None], sep: np.ndarray, lower: np.ndarray | None = None):
        raw = b" ".join([t or b"" for t in texts]) + b" "
        buf = np.frombuffer(raw, np.uint8)
        lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        gap = sep[buf]
        ends = np.cumsum(lens + 1) - 1
        gap[ends] = True
        if lower is not None:
            buf = lower[buf]
        prev = np.empty_like(gap)
        prev[0], prev[1:] = True, gap[:-1]
        at = np.flatnonzero(~gap & prev)
        stop = np.flatnonzero(gap & ~prev)
        self.first = np.concatenate(([0], np.searchsorted(at, ends))).astype(np.int64)
        keep = ~(gap & prev)
        buf = np.where(gap, np.uint8(32), buf)[keep]
        length = stop - at
        self.start = np.cumsum(length + 1) - (length + 1)
        self.end = self.start + length
        self.norm = buf
        self.bytes = buf.tobytes()

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.start)
        if not n:
            return np.zeros(0, np.uint64)
        rng = np.random.default_rng(seed)
        values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        values[32] = 0  # the space after a word adds nothing
        length = self.end - self.start
        power = np.cumprod(np.full(int(length.max()) + 2, 0x9E3779B97F4A7C15 & ~7 | 5, np.uint64))
        h, at = np.empty(n, np.uint64), 0
        while at < n:  # some words at a time, so that a very long text needs no arrays of many bytes for each of its own
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + CHUNK)))
            begin, stop = self.start[at], self.end[to - 1] + 1
            inside = np.arange(begin, stop) - np.repeat(self.start[at:to], length[at:to] + 1)
            h[at:to] = np.add.reduceat(values[self.norm[begin:stop]] * power[inside], self.start[at:to] - begin)
            at = to
        return mixed(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (end exclusive) with one space between them."""
        return self.bytes[self.start[a] : self.end[b - 1]] if b > a else b""


def runs(h: np.ndarray, n: int, factor: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """Unmixed hashes of the runs of n words that start at each word; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, doubled, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out, have = doubled, size
            else:  # what is there, then a doubled run after it
                m = len(h) - have - size + 1
                out = out[:m] * np.uint64(pow(factor, size, 1 << 64)) + doubled[have : have + m]
                have += size
        if size * 2 > n:
            return out[: len(h) - n + 1]
        m = len(doubled) - size
        doubled = doubled[:m] * np.uint64(pow(factor, size, 1 << 64)) + doubled[size : size + m]
        size *= 2


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Arrow batches cut so that the texts of each cut have about BLOCK bytes, with those texts as UTF-8."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
        at = 0
        total = np.cumsum(sizes)
        while at < len(sizes):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + BLOCK, "right")))
            cut = batch.slice(at, to - at)
            yield cut, cut.column(column).cast(pa.binary()).to_pylist()
            at = to
