"""Quality rules: word and line counts, and compression bands over whole documents and fixed chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.text import Words, slices, string_buffer
from ratewell.llm.texts import ensure_checkpoints, stored

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Texts are banded by length, two bands to each doubling of their bytes: long ones compress more, whatever they say.
BANDS_PER_DOUBLING = 2
#: Documents are also judged by chunks of so many bytes; one fails when more than CHUNK_SHARE of its chunks do.
CHUNK_BYTES, CHUNK_SHARE = 2048, 0.5
#: Spreads (distance of the quartiles of the logarithm of the ratio, LEAST_SPREAD at least) beyond the quartiles of its band at which a ratio is rejected.
FENCE, CHUNK_FENCE, LEAST_SPREAD = 2.5, 3.0, 0.04
#: Steps of the logarithm in which ratios are counted.
BIN = 0.005
LEVEL = 3
#: A band with fewer distinct texts (or chunks) than this borrows from its neighbours.
BAND_TEXTS = 200

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "ratio double, n_chunks long, n_bad_chunks long, low double, high double"
)
#: (whether of chunks, band): least and most ratio.
Limits = dict[tuple[bool, int], tuple[float, float]]


def band(size: int) -> int:
    return int(BANDS_PER_DOUBLING * math.log2(size))


def ratios(raw: bytes, pack) -> tuple[float, list[tuple[int, float]]]:
    """Raw to compressed bytes of the whole, and (bytes, ratio) of each chunk. ``pack`` compresses bytes."""
    whole = len(raw) / len(pack(raw))
    parts = [raw[at : at + CHUNK_BYTES] for at in range(0, len(raw), CHUNK_BYTES)]
    return whole, [(len(part), len(part) / len(pack(part)) if len(parts) > 1 else whole) for part in parts]


def judged(size: int, ratio: float, chunks: list[tuple[int, float]], limits: Limits) -> tuple[int, bool, float, float]:
    """Chunks out of their band, whether the document stays, and the whole's limits. A band without limits rejects nothing."""
    everything = (0.0, math.inf)
    if not size:
        return 0, True, *everything
    low, high = limits.get((False, band(size)), everything)
    bad = 0
    for own_size, own in chunks:
        least, most = limits.get((True, band(own_size)), everything)
        bad += not least <= own <= most
    return bad, low <= ratio <= high and bad <= CHUNK_SHARE * len(chunks), low, high


def compression(raw: bytes, pack, limits: Limits) -> tuple[float, int, int, bool, float, float]:
    """Ratio of the whole, chunks, chunks out of their band, whether the document stays, and the whole's limits."""
    ratio, chunks = ratios(raw, pack) if raw else (0.0, [])
    bad, stays, low, high = judged(len(raw), ratio, chunks, limits)
    return ratio, len(chunks), bad, stays, low, high


def quantile(counts: dict[int, int], share: float) -> float:
    """The logarithm of the ratio up to which a share of the texts lie, from counts by bin."""
    bins = sorted(counts)
    upto = np.cumsum([counts[b] for b in bins])
    return (bins[int(np.searchsorted(upto, share * upto[-1]))] + 0.5) * BIN


def fences(counts: dict[int, int], fence: float) -> tuple[float, float]:
    """Limits of the logarithm of a ratio from its counts by bin."""
    low, high = quantile(counts, 0.25), quantile(counts, 0.75)
    room = fence * max(high - low, LEAST_SPREAD)
    return low - room, high + room


def rise(by_band: dict[int, dict[int, int]]) -> float:
    """By how much the logarithm of the ratio grows from band to band: the slope of the line through the bands' medians, by
    least squares with the bands' sizes as weights; 0 at least."""
    x, y, n = np.array([(b, quantile(counts, 0.5), sum(counts.values())) for b, counts in by_band.items()]).T
    apart = x - np.average(x, weights=n)
    spread = (n * apart * apart).sum()
    return max(0.0, float((n * apart * y).sum() / spread)) if spread else 0.0


def limits_of(by_band: dict[int, dict[int, int]], fence: float) -> dict[int, tuple[float, float]]:
    """Limits of each band from its counts by bin. A band with fewer than BAND_TEXTS texts doesn't set its own: it borrows
    the counts of its neighbours, nearest first, its own among them, until there are as many. What is rare in its length is
    so measured by what is common in lengths near it, and a document alone in its band can be rejected. As longer texts
    compress more, the limit on the side of the band is moved by the rise() among those (three bands at least) for each band
    between it and them.
    """
    out = {}
    for own in by_band:
        lent: dict[int, dict[int, int]] = {}
        merged: dict[int, int] = {}
        size = where = 0
        for near in sorted(by_band, key=lambda b: (abs(b - own), b)):
            if size >= BAND_TEXTS and len(lent) >= 3:
                break
            lent[near] = by_band[near]
            if size >= BAND_TEXTS:
                continue
            for bin_, n in by_band[near].items():
                merged[bin_] = merged.get(bin_, 0) + n
                size, where = size + n, where + n * near
        low, high = fences(merged, fence)
        shift = rise(lent) * (own - where / size)
        out[own] = math.exp(low + min(0.0, shift)), math.exp(high + max(0.0, shift))
    return out


#: What figures() adds to a row: counts of words and lines, and ratios; cells holds (band, ratio) of the whole, then of each chunk.
FIGURES = "size long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, cells array<struct<size long, band int, ratio double>>"


def figures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, FIGURES) of each row, in one pass over the texts; key is a hash of the text. No text is kept."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        kind = pa.list_(pa.struct([("size", pa.int64()), ("band", pa.int32()), ("ratio", pa.float64())]))
        for batch in slices(batches):
            raw, offsets = string_buffer(batch.column("text"))
            words = Words(raw, offsets)
            data = raw.tobytes()
            head = (raw & 0xC0) != 0x80  # one byte of each code point
            inside = np.zeros(len(raw) + 1, np.int8)
            np.add.at(inside, words.start, 1)
            np.add.at(inside, words.end, -1)
            sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])  # noqa: E731, B023
            word_chars = sums(head & (np.cumsum(inside[:-1]) > 0))
            n_symbols = sums(np.isin(raw, np.frombuffer(SYMBOLS.encode(), np.uint8)))
            n_repeat = repeated_words(words)
            dup, cells = [], []
            for a, b in zip(offsets, offsets[1:], strict=False):
                dup.append(duplicate_lines(data[a:b].decode()))
                whole, chunks = ratios(data[a:b], pack) if b > a else (0.0, [])
                cells.append([{"size": size, "band": band(size), "ratio": own} for size, own in ([(int(b - a), whole), *chunks] if b > a else [])])
            counts = (np.diff(offsets), words.count, word_chars, n_symbols, dup, n_repeat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), *(pa.array(np.asarray(x, np.int64)) for x in counts), pa.array(cells, kind)],
                names=["doc_id", "key", *(f.split()[0] for f in FIGURES.split("<")[0].split(", "))],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(measure, f"doc_id long, key long, {FIGURES}")


def _limits(measured: DataFrame) -> Limits:
    """Limits from what figures() gives."""
    once = measured.filter("size > 0").groupBy("key").agg(F.min("cells").alias("cells"))
    each = once.select(F.posexplode("cells").alias("at", "c")).select((F.col("at") > 0).alias("chunk"), "c.band", F.floor(F.ln("c.ratio") / BIN).alias("bin"))
    by_band: dict[bool, dict[int, dict[int, int]]] = {False: {}, True: {}}
    for r in each.groupBy("chunk", "band", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        by_band[r.chunk].setdefault(r.band, {})[r.bin] = r.n
    return {(chunk, b): limit for chunk, bands in by_band.items() for b, limit in limits_of(bands, CHUNK_FENCE if chunk else FENCE).items()}


def fit_limits(docs: DataFrame, text_col: str = "text") -> Limits:
    """Limits of every length band, from the ratios of all documents and all of their chunks.

    Equal texts count once, so copies don't set limits. Counts by (band, bin) come to the driver: a few thousand, whatever
    the input's size. They are exact and don't depend on partitions. Bands with few texts borrow: see limits_of().
    """
    return _limits(figures(docs.select(F.lit(None).cast("long").alias("_id"), F.col(text_col)), "_id", text_col).select("key", "size", "cells"))


def repeated_words(words: Words) -> np.ndarray:
    """Per row, words that lie in a 3-word window found twice or more in that row. Windows are compared by word ids, not by hash."""
    rows = len(words.count)
    covered = np.zeros(len(words.start) + 2, bool)
    if len(words.start) >= 3:
        _, word = np.unique(words.hash, return_inverse=True)
        m = len(word) - 2
        inside = np.flatnonzero(words.row[:m] == words.row[2:])
        wide = np.uint64(int(word.max()) + 1)
        w = word.astype(np.uint64)
        pair = w[:-1] * wide + w[1:]
        _, pair = np.unique(pair, return_inverse=True)
        key = (words.row[inside].astype(np.uint64) << np.uint64(42)) | pair[inside].astype(np.uint64) << np.uint64(0)
        _, front = np.unique(key, return_inverse=True)  # (row, first two words)
        key = front.astype(np.uint64) * wide + w[inside + 2]
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = inside[count[at] > 1]
        for j in range(3):
            covered[hit + j] = True
    return np.bincount(words.row[covered[: len(words.start)]], minlength=rows) if len(words.start) else np.zeros(rows, np.int64)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x and x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50, limits: Limits | None = None) -> DataFrame:
    """One row per document: counts, base_failed and kept, with the compression figures and limits behind the verdict.

    n_words and word_chars count maximal runs of characters other than space and 09-0D, and their code points;
    n_symbols the characters of SYMBOLS; n_dup_lines lines that hold a word and equal an earlier line;
    n_repeat_words words in 3-word windows found twice or more. base_failed: under ``min_words`` words, or more
    than ``max_repeat`` per cent of the words repeat. kept: not base_failed, and the ratio of the whole, and of enough of
    its chunks, lie within the limits of their length. ``limits``: fit_limits() of another table; None: of this one. Texts
    are read and compressed once: their figures are written, the limits are fitted to them and then applied to them.

    Null text counts as empty (no words: base_failed). Null ids pass through. Given the limits, rows are judged alone, so
    repeated rows get equal answers; no text is shuffled, and texts of any length are read whole. A ratio on a limit is
    within it. Extra columns are ignored. An empty table gives an empty result.
    """
    measured = figures(docs, id_col, text_col)
    if limits is None:
        ensure_checkpoints(docs.sparkSession)
        measured = stored(measured)
        limits = _limits(measured)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, repeat = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            failed = (n_words < min_words) | (100 * repeat > max_repeat * n_words)
            cells = [[(c["size"], c["ratio"]) for c in row] for row in batch.column("cells").to_pylist()]
            ratio = [row[0][1] if row else 0.0 for row in cells]
            found = [judged(size, own, row[1:], limits) for size, own, row in zip(batch.column("size").to_pylist(), ratio, cells, strict=True)]
            kept = ~failed & np.array([x[1] for x in found], bool)
            chunks = pa.array([max(0, len(row) - 1) for row in cells], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                + [pa.array(failed), pa.array(kept), pa.array(ratio, pa.float64()), chunks, pa.array([x[0] for x in found], pa.int64()), *(pa.array([x[k] for x in found], pa.float64()) for k in (2, 3))],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return measured.mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None, **how) -> DataFrame:
    """The rows that the rules keep, with all their columns. Rows with a null id are judged like others: by text."""
    from pyspark.sql.types import BooleanType

    limits = fit_limits(docs, text_col) if limits is None else limits

    @F.pandas_udf(BooleanType())
    def kept(text: pd.Series) -> pd.Series:
        return verdicts(text, limits, **how)

    return docs.filter(kept(F.col(text_col)))


def verdicts(text, limits: Limits, min_words: int = 50, max_repeat: int = 50) -> pd.Series:
    """kept, for a pandas column of texts."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    out = []
    column = pa.array(text, pa.string(), from_pandas=True)
    for batch in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])])):
        raw, offsets = string_buffer(batch.column("text"))
        words = Words(raw, offsets)
        data = raw.tobytes()
        failed = (words.count < min_words) | (100 * repeated_words(words) > max_repeat * words.count)
        out += [not bad and compression(data[a:b], pack, limits)[3] for bad, a, b in zip(failed, offsets, offsets[1:], strict=False)]
    return pd.Series(out, dtype=bool)
