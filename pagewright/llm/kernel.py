"""Vectorised text kernel: words and their hashes over whole batches of texts.

A word is a maximal run of Unicode letters and digits (categories L and N), compared in lower
case. Texts of a batch are laid end to end as code points; word boundaries, lower casing and
64-bit word hashes are then a handful of numpy passes, so no Python code runs per word.
Lower casing is per code point (the first one where it expands), which keeps lengths equal.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points laid out at a time. Bounds the memory of a pass (about 60 bytes a code point);
#: a single longer text forms a block of its own.
BLOCK = 1_000_000

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        size = 0x110000
        kind = np.zeros(size, np.uint8)
        lower = np.arange(size, dtype=np.uint32)
        for c in range(size):
            if unicodedata.category(chr(c))[0] in "LN":
                kind[c] = 1
                low = chr(c).lower()
                if low[0] != chr(c):
                    lower[c] = ord(low[0])
        _tables.update(word=kind.view(bool), lower=lower)
    return _tables[name]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("pow")
    if have is None or len(have) < n:
        n = max(n, BLOCK + 1)
        for key, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 2**64))):
            step = np.full(n, base, U64)
            step[0] = 1
            _tables[key] = np.multiply.accumulate(step)
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words(NamedTuple):
    """Words of a block of texts. ``first[i]`` is the number of the first word of text i, and
    ``first[-1]`` the number of words; starts and ends are places in ``text``."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(texts: list[str | None]) -> Words:
    """Words of all texts; a null text counts as an empty one."""
    texts = [t or "" for t in texts]
    joined = "\n".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    inside = np.zeros(len(cps) + 2, bool)
    inside[1:-1] = _table("word")[cps]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(cps) + 1)
    total = np.zeros(len(cps) + 1, U64)
    np.cumsum(_table("lower")[cps].astype(U64) * power[: len(cps)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))
    return Words(joined, starts, ends, hashes, np.searchsorted(starts, bounds))


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of at most BLOCK code points together, each with the place of its first."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if size + n > BLOCK and i > start:
            yield start, texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, texts[start:]


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all sequences of n consecutive words inside one text, and the word each begins at."""
    h = w.hashes
    if len(h) < n:
        return np.empty(0, U64), np.empty(0, np.int64)
    acc = np.zeros(len(h) - n + 1, U64)
    for k in range(n):
        acc = acc * U64(_BASE) + h[k : len(h) - n + 1 + k]
    own = w.owner()
    at = np.flatnonzero(own[: len(h) - n + 1] == own[n - 1 :])
    return mix(acc[at]), at


# Bitmaps of fixed size over 64-bit hashes: without false negatives, and as large for any number of rows.
CHUNK = 16  # a chunk has 2**CHUNK bits


def places_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64)


def has(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes a packed bitmap may hold."""
    at = places_of(hashes, bits)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def gathered_bitmap(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, twice: bool = False) -> np.ndarray:
    """The packed bitmap of all hashes that a function gives for the batches of ``rows``, or of those that it
    gives at least twice.

    Each task makes its own bitmap and emits its chunks that aren't empty; the chunks of one place are
    OR-ed in tasks of their own, so exactly 2**bits / 8 bytes reach the driver, whatever the rows.
    """
    size, width = 1 << bits, 1 << min(CHUNK, bits)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, again = np.zeros(size, bool), np.zeros(size if twice else 1, bool)
        for b in batches:
            for h in hashes(b):
                at = places_of(h, bits)
                if twice:
                    at, n = np.unique(at, return_counts=True)
                    again[at] |= marks[at] | (n > 1)
                marks[at] = True
        packed = [np.packbits(x, bitorder="little").reshape(-1, width // 8) for x in ((marks, again) if twice else (marks,))]
        full = np.flatnonzero(packed[0].any(axis=1))
        yield _chunks(full, np.concatenate([x[full] for x in packed], axis=1))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, np.uint8)
                old = found.get(k)
                if old is not None and twice:
                    half = width // 8
                    part = np.concatenate([old[:half] | part[:half], old[half:] | part[half:] | old[:half] & part[:half]])
                elif old is not None:
                    part = old | part
                found[k] = part
        yield _chunks(np.array(list(found), np.int64), [x[-(width // 8) :] for x in found.values()])

    parts = rows.mapInArrow(own, "chunk int, data binary").repartition(min(8, size // width), "chunk").mapInArrow(together, "chunk int, data binary").toArrow()
    out = np.zeros((size // width, width // 8), np.uint8)
    for k, data in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True):
        out[k] = np.frombuffer(data, np.uint8)
    return out.ravel()


def _chunks(keys: np.ndarray, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([x.tobytes() for x in data], pa.binary())], names=["chunk", "data"])
