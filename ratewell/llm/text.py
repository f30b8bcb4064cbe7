"""Vectorised text helpers used inside Arrow tasks: batches cut by bytes, words and their hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes 09-0D and 20 separate words, in every operator of this package.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """The splitmix64 finaliser; out may be x itself."""
    z = np.add(x, _GOLD, out=out)
    t = z >> np.uint64(30)
    z ^= t
    z *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(z, np.uint64(27), out=t)
    z ^= t
    z *= np.uint64(0x94D049BB133111EB)
    np.right_shift(z, np.uint64(31), out=t)
    z ^= t
    return z


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset of each row in them (n + 1 values); null counts as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def give_back() -> None:
    """Worker processes outlive tasks; what a task has freed goes back to the machine, so that the next one's isn't added to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; one row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


class Words:
    """Words of a slice of texts: start and end bytes, row, and a 64-bit hash of each word's bytes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        if lower:
            raw = LOWER[raw]
        self.raw, self.offsets, n = raw, offsets, len(raw)
        inside = ~SPACE[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edges[1:] - 1] = inside[edges[1:] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # of each row's words, and the end
        if hashes:
            self.hash = self._hash(inside, n)

    def _hash(self, inside: np.ndarray, n: int) -> np.ndarray:
        """Sum of a random value for each (place in the word, byte), finalised: no order or repetition cancels out."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        place = np.arange(n, dtype=np.uint64)
        place[self.start[0] :] -= np.repeat(self.start.astype(np.uint64), np.diff(np.append(self.start, n)))
        place <<= np.uint64(8)
        place |= self.raw
        mix(place, place)
        place[~inside] = 0
        return mix(np.add.reduceat(place, self.start))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of k words within one row."""
        m = len(self.start) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.hash[:m].copy()
        for j in range(1, k):
            h *= _BASE
            h += self.hash[j : j + m]
        at = np.flatnonzero(self.row[:m] == self.row[k - 1 :])
        return at, mix(h[at])


#: Low bits that hold a position while minima slide; the other bits of a hash decide.
_PLACE = 27


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of values[i : i + width] for every i, by the upper bits of each value; the leftmost of equals.

    Longer arrays than positions have bits for are taken in overlapping parts, so a text may have any length.
    """
    n, most = len(values), 1 << _PLACE
    if n < width:
        return np.zeros(0, np.int64)
    if n > most:
        if 2 * width > most:
            raise ValueError(f"windows of {width} are too wide")
        step = most - width + 1
        return np.concatenate([at + sliding_argmin(values[at : at + most], width) for at in range(0, n - width + 1, step)])
    low = np.uint64(most - 1)
    keyed = np.full(-(-n // width) * width, ~np.uint64(0))
    keyed[:n] = (values & ~low) | np.arange(n, dtype=np.uint64)
    blocks = keyed.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def concat_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.Table]:
    """The same rows, in tables of about ``rows`` in which no run of equal values of ``column`` is cut."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            keys = batch.column(column).to_numpy()
            begins = changes(keys)
            if kept and keys[0] == kept[-1].column(column)[-1].as_py():
                begins = begins[1:]
            cut = next((int(b) for b in begins if size + b >= rows), None) if kept or len(begins) > 1 else None
            if cut is None:
                kept.append(batch)
                size += batch.num_rows
                break
            if cut:
                kept.append(batch.slice(0, cut))
            if kept:
                yield pa.Table.from_batches(kept)
            kept, size, batch = [], 0, batch.slice(cut)
    if kept:
        yield pa.Table.from_batches(kept)
    kept = []
    give_back()


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the (start, end) spans; spans that touch are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
