"""Repeated byte strings in a collection, by column-wise construction of its transform and common prefixes.

Strings are lined up at a shared core and inserted column by column, from the right: each round adds one symbol of
every string of a bucket, re-sorts by that symbol (the column of the collection's Burrows-Wheeler transform) and
updates the longest common prefixes of neighbours. A common prefix of ``length`` bytes or more is a repeated string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.text import changes, concat_runs, merge_spans, mix, slices, sliding_argmin, string_buffer, whole_groups
from ratewell.llm.texts import NO_ID, OWNER, ensure_checkpoints, keyed, stored

#: Bytes of a string that counts as repeated and is removed; and of shorter ones that are reported as well.
LENGTH, SHORT = 400, 250
#: Strings of a bucket that are sorted together (65 MB of symbols, a few seconds); the core of a bucket with more is
#: lengthened until its parts fit.
MOST_STRINGS = 50_000
#: Starts of a part: 16 strings in a row share all of their bytes but 15 at either end.
PART = 16
#: Bytes of strings that are sorted at once: buckets are small, so many go together.
BATCH = 4 << 20

_STEP = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of an odd number and of its inverse, modulo 2^64."""
    size = max(1 << 20, 1 << n.bit_length()) + 1
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_STEP, np.uint64(pow(int(_STEP), -1, 1 << 64))):
            x = np.full(size, base)
            x[0] = 1
            both.append(np.cumprod(x))
        _powers[size] = tuple(both)
    return _powers[size]


class Rolling:
    """64-bit hashes of any stretch of the bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw))
        table = mix(np.arange(256, dtype=np.uint64) + np.uint64(977))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * up[: len(raw)], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        x = self.sums[size:] - self.sums[:-size]
        x *= self.down[: len(x)]
        return mix(x, x)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] ^ (end - start).astype(np.uint64))


def core_of(short: int) -> int:
    return max(1, short // 4)


def runs_of(texts: DataFrame, length: int, short: int) -> DataFrame:
    """Runs of consecutive starts of ``short`` bytes that share their least core, a quarter as long.

    core and run: hashes of the core and of all bytes from the first start to ``length`` behind the last (or to the text's
    end); start: the first; n: starts; off: core after start. Equal runs of one slice of texts come as one row, with
    their number in ``copies``; if there are several, rows without a core say where each of them is (n: bytes covered by
    ``short`` strings, off: by ``length`` ones). So a stretch that repeats itself, or a text with many copies, is a few
    rows. The choice of core depends on the ``short`` bytes alone, so equal strings have equal cores at equal places.
    """
    core = core_of(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = string_buffer(batch.column("text"))
            if len(raw) < short:
                continue
            rolling = Rolling(raw)
            hashes = rolling.windows(core)
            least = sliding_argmin(hashes, short - core + 1)
            fits = np.zeros(len(raw) + 1, np.int8)
            sizes = np.diff(offsets)
            long_ = sizes >= short
            np.add.at(fits, offsets[:-1][long_], 1)
            np.add.at(fits, offsets[1:][long_] - short + 1, -1)
            at = np.flatnonzero(np.cumsum(fits[:-1]))
            if not len(at):
                continue
            row = np.searchsorted(offsets, at, "right") - 1
            first = changes(row, least[at])
            n = np.diff(np.append(first, len(at)))
            row, start, place = row[first], at[first], least[at[first]]
            end = np.minimum(start + n - 1 + length, offsets[row + 1])
            core_hash, whole = hashes[place], rolling.spans(start, end)
            _, one, same, copies = np.unique(mix(core_hash) ^ whole, return_index=True, return_inverse=True, return_counts=True)
            # Runs that this slice holds twice are repeated, whatever else there is: neighbours of them make one span.
            twice = np.flatnonzero(copies[same] > 1)
            head = changes(row[twice], twice - np.arange(len(twice)))
            tail = np.append(head[1:], len(twice))[: len(head)] - 1
            head, tail = twice[head], twice[tail]
            covered, removed = start[tail] + n[tail] - 1 + short - start[head], np.where(end[head] - start[head] >= length, end[tail] - start[head], 0)
            owner = np.concatenate([row[one], row[head]])
            blank = np.zeros(len(head), np.int64)
            take, numbers = pa.array(owner), (
                np.concatenate([start[one], start[head]]) - offsets[owner], np.concatenate([n[one], covered]), np.concatenate([place[one] - start[one], removed]), np.concatenate([copies, blank])
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([core_hash[one].view(np.int64), blank]), mask=np.arange(len(owner)) >= len(one)), pa.array(np.concatenate([whole[one].view(np.int64), blank])),
                    batch.column("id").take(take), batch.column("k1").take(take), *(pa.array(x.astype(np.int32)) for x in numbers),
                ],
                names=["core", "run", "id", "k1", "start", "n", "off", "copies"],
            )

    return texts.select(*OWNER, "text").mapInArrow(run, "core long, run long, id long, k1 long, start int, n int, off int, copies int")


def insert_columns(matrix: np.ndarray, bucket: np.ndarray, ready: int, transform: np.ndarray | None = None) -> np.ndarray:
    """For each string (row) and each of the first ``ready`` columns: the longest prefix from there that another string of
    its bucket, lined up likewise, has too. ``transform``, if given, gets each column's block of the transform: in the
    order of the suffixes from there, the symbols before them.

    matrix: strings by columns, 0 where a string has no byte (such a place equals nothing), else byte + 1.
    bucket: sorted. One round per column, the last first: each inserts one symbol of every string, re-sorts and updates
    ``prefix``; ``prefix[k]`` is the common prefix of the k-th string in order with the one before it.
    """
    strings, columns = matrix.shape
    longest = np.zeros((strings, ready), np.uint16)
    order, prefix = np.arange(strings), np.zeros(strings + 1, np.int32)
    base = bucket.astype(np.int64) << 9
    for column in range(columns - 1, -1, -1):
        symbol = matrix[order, column]
        key = base[order] | symbol
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        again = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] & 511 > 0)) + 1
        lower, upper = moved[again - 1] + 1, moved[again] + 1
        least = prefix[lower].copy()
        apart = np.flatnonzero(upper - lower > 1)
        if len(apart):
            ends = np.stack([lower[apart], upper[apart]], 1).ravel()
            least[apart] = np.minimum.reduceat(prefix, ends)[::2]
        prefix = np.zeros(strings + 1, np.int32)
        prefix[again] = least + 1
        order = order[moved]
        if column < ready:
            longest[order, column] = np.maximum(prefix[:-1], prefix[1:])
        if transform is not None:
            transform[column] = matrix[order, column - 1] if column else 0
    return longest


#: A string of a bucket: where it is, how many starts it has, its core after the first; and the run that its answer is for.
STRING = "bucket long, core long, run long, main boolean, id long, k1 long, start int, n int, off int"
ANSWER = "core long, run long, level int, s int, e int"


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def spans_of(hit: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the stretches that strings of ``level`` bytes cover, from which places of each row begin one."""
    which, place = np.nonzero(hit)
    begin = place + first[which]
    head = changes(which, begin - np.arange(len(begin)))
    tail = np.append(head[1:], len(begin))[: len(head)] - 1
    return which[head], begin[head].astype(np.int32), (begin[tail] + level).astype(np.int32)


def sort_buckets(strings: DataFrame, length: int, short: int) -> DataFrame:
    """ANSWER rows of strings (STRING and bytes): what is covered by repeated strings of ``short`` and ``length`` bytes,
    counted from the core."""
    left = short - core_of(short)

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = rows.column("bytes").to_pylist()
        off, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("off", "n"))
        sizes = np.array([len(x) for x in texts])
        bucket = np.cumsum(np.isin(np.arange(len(texts)), changes(rows.column("bucket").to_numpy())))
        matrix = np.zeros((len(texts), left + length), np.uint16)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        where = np.repeat(np.arange(len(texts)) * matrix.shape[1] + left - off - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
        matrix.ravel()[where] = flat.astype(np.uint16) + 1
        longest = insert_columns(matrix, bucket, left + 1)
        place = np.arange(left + 1)
        own = (place >= (left - off)[:, None]) & (place < (left - off + n)[:, None]) & rows.column("main").to_numpy(zero_copy_only=False)[:, None]
        for level in (short, length):
            which, s, e = spans_of(own & (longest >= level), np.full(len(texts), -left), level)
            take = pa.array(which)
            yield _batch({c: rows.column(c).combine_chunks().take(take) for c in ("core", "run")} | {"level": np.full(len(which), level, np.int32), "s": s, "e": e})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "bucket", int(BATCH / (1.5 * length))):
            yield from solve(rows)

    return strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWER)


def _asked(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray, list[bytes]]:
    """Fields of all asked strings of a batch, the row of each, and the rows' bytes."""
    asked = batch.column("asked")
    row = np.repeat(np.arange(batch.num_rows), np.asarray(asked.value_lengths()))
    flat = asked.flatten()
    return {f: flat.field(f).to_numpy(zero_copy_only=False) for f in ("bucket", "core", "run", "main", "start", "n", "off")}, row, [t.encode() for t in batch.column("text").to_pylist()]


def with_bytes(asked: DataFrame, length: int) -> DataFrame:
    """STRING and bytes of what is asked for beside each text (column ``asked``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, row, raws = _asked(batch)
            parts = [raws[r][a:b] for r, a, b in zip(row.tolist(), x["start"].tolist(), (x["start"] + x["n"] - 1 + length).tolist(), strict=True)]
            take = pa.array(row)
            owner = {c: batch.column(c).take(take) for c in OWNER}
            yield _batch({c: x[c] for c in ("bucket", "core", "run", "main")} | owner | {c: x[c] for c in ("start", "n", "off")} | {"bytes": pa.array(parts, pa.binary())})

    return asked.select(*OWNER, "text", "asked").mapInArrow(run, STRING + ", bytes binary")


def lengthened(asked: DataFrame, short: int) -> DataFrame:
    """STRING rows of the parts of what is asked for: PART starts in a row, in the bucket of the bytes that all strings
    from these starts share. Parts begin at fixed distances from the core, so equal strings are in equal parts."""
    left = short - core_of(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, row, raws = _asked(batch)
            ends = np.cumsum([len(r) for r in raws])
            rolling = Rolling(np.frombuffer(b"".join(raws), np.uint8))
            place = left - x["off"]  # of the first start, counted from the first that a core allows
            lowest, highest = place // PART, (place + x["n"] - 1) // PART
            string = np.repeat(np.arange(len(row)), highest - lowest + 1)
            part = concat_runs(lowest.astype(np.int64), (highest - lowest + 1).astype(np.int64))
            a = np.maximum(part * PART, place[string])
            b = np.minimum((part + 1) * PART, (place + x["n"])[string])
            own, begin = row[string], (ends - [len(r) for r in raws])[row][string] + x["start"][string] - place[string]
            shared = rolling.spans(begin + np.minimum((part + 1) * PART - 1, left), begin + part * PART + short)
            bucket = mix(shared ^ mix(x["core"][string].view(np.uint64) + part.astype(np.uint64)))
            take = pa.array(own)
            yield _batch(
                {"bucket": bucket.view(np.int64)} | {c: x[c][string] for c in ("core", "run", "main")} | {c: batch.column(c).take(take) for c in OWNER}
                | {"start": (x["start"][string] + a - place[string]).astype(np.int32), "n": (b - a).astype(np.int32), "off": (left - a).astype(np.int32)}
            )

    return asked.select(*OWNER, "text", "asked").mapInArrow(run, STRING)


def whole_strings(asked: DataFrame, length: int, short: int) -> DataFrame:
    """(core, run, main, level, s, string) of every string of both lengths of what is asked for: its place from the core, its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, row, raws = _asked(batch)
            ends = np.cumsum([len(r) for r in raws])
            rolling = Rolling(np.frombuffer(b"".join(raws), np.uint8))
            string = np.repeat(np.arange(len(row)), x["n"])
            start = concat_runs((ends - [len(r) for r in raws])[row] + x["start"], x["n"].astype(np.int64))
            place = start - np.repeat((ends - [len(r) for r in raws])[row] + x["start"] + x["off"], x["n"])
            for level in (short, length):
                fits = np.flatnonzero(start + level <= ends[row][string])
                own = string[fits]
                yield _batch({c: x[c][own] for c in ("core", "run", "main")} | {"level": np.full(len(own), level, np.int32), "s": place[fits].astype(np.int32), "string": rolling.spans(start[fits], start[fits] + level).view(np.int64)})

    return asked.select(*OWNER, "text", "asked").mapInArrow(run, "core long, run long, main boolean, level int, s int, string long")


def repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, short: int | None = None, most_strings: int = MOST_STRINGS, with_text: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_short, n_short_spans (and kept_bytes).

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else in the collection, the
    same document included. n_short and n_short_spans: bytes covered by repeated strings of ``short`` bytes (five
    eighths of ``length`` if not given), and their stretches; they are reported and stay, as their common prefixes come
    out of the same rounds.

    1. Starts whose ``short`` bytes share their least core (a quarter as long) form a run. A core that occurs once holds
       nothing repeated, and most of the corpus goes here.
    2. Equal runs are one kind, of which two copies stand for all.
    3. The kinds of a core are its bucket, whose collection is built column by column (insert_columns): one symbol of
       every string a round, the column of the transform, and the common prefixes. Strings are lined up at the core, so
       equal strings begin in the same column: one block of the transform per column suffices, and is written over by the
       next. A common prefix of ``length`` bytes is a repeated string. Nothing else decides what is removed, but for
       copies that one slice of 1 MB of texts holds, and the last step of 4.
    4. A bucket of more than ``most_strings`` strings would be a task of its own. Its strings are dealt anew by longer
       cores, those that PART starts in a row share; what is then alone is dropped. Where even such a bucket is too large,
       whole strings are the cores: equal ones are repeated. Each step only sees what the one before couldn't settle.

    Cores and runs are compared by 64-bit hashes, a run by two of them. Runs are taken from the scan; afterwards the
    texts are shuffled once, by their document, to meet what is asked of them and what is cut from them.
    Null text: no bytes. Null ids pass through; rows that repeat an id are documents of their own, so a repeated row is a
    copy. Texts of any length are read whole, in one piece; a tie of cores goes to the leftmost. Extra columns are
    ignored. Empty table: empty result. Needs spark.checkpoint.dir. Bytes that remain need not be valid UTF-8, so
    kept_bytes is binary.
    """
    ensure_checkpoints(docs.sparkSession)
    short = max(1, length * 5 // 8) if short is None else short
    texts = keyed(docs, id_col, text_col).select(*OWNER, "text")
    runs = stored(runs_of(texts, length, short))
    inside = runs.filter("core is null")
    local = inside.select(*OWNER, F.lit(short).alias("level"), F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e"))
    local = local.union(inside.filter("off > 0").select(*OWNER, F.lit(length), "start", F.col("start") + F.col("off")))
    runs = runs.filter("core is not null")
    # What is counted is written before it is joined: both sides of each join are plain shuffles, which can be split where a core is hot.
    repeated = stored(runs.groupBy("core").agg(F.sum("copies").alias("all")).filter("`all` > 1").select("core"))
    hits = stored(runs.join(repeated, "core"))
    place = F.struct(*OWNER, "start", "n", "off")
    kinds = stored(hits.groupBy("core", "run").agg(F.sum("copies").alias("copies"), F.min(place).alias("r"), F.max(place).alias("last")))
    sizes = stored(kinds.groupBy("core").agg(F.sum(F.least("copies", F.lit(2))).alias("strings")))
    sources = F.when(F.col("copies") > 1, F.array("r", "last")).otherwise(F.array("r"))
    strings = kinds.join(sizes, "core").select("core", "run", "strings", F.posexplode(sources).alias("which", "r"))
    strings = strings.select(F.col("core").alias("bucket"), "core", "run", (F.col("which") == 0).alias("main"), "r.*", "strings")

    def ask(part: DataFrame) -> DataFrame:
        asked = part.groupBy(*OWNER).agg(F.collect_list(F.struct("bucket", "core", "run", "main", "start", "n", "off")).alias("asked"))
        return texts.join(asked, OWNER)

    sorted_ = strings.filter(F.col("strings") <= most_strings).drop("strings")
    large, answers = strings.filter(F.col("strings") > most_strings), []
    if not large.isEmpty():
        parts = stored(lengthened(ask(large), short))
        shared = stored(parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("strings")).filter("strings > 1"))
        parts = parts.join(shared, "bucket")
        sorted_ = sorted_.union(parts.filter(F.col("strings") <= most_strings).drop("strings"))
        rest = parts.filter(F.col("strings") > most_strings)
        if not rest.isEmpty():
            whole = stored(whole_strings(ask(rest), length, short))
            again = stored(whole.groupBy("core", "level", "s", "string").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"))
            answers.append(whole.filter("main").join(again, ["core", "level", "s", "string"]).select("core", "run", "level", "s", (F.col("s") + F.col("level")).alias("e")))
    answers.append(sort_buckets(with_bytes(ask(sorted_), length), length, short))
    found = stored(answers[0].union(answers[1]) if len(answers) > 1 else answers[0])
    at = F.col("start") + F.col("off")
    spans = local.union(hits.join(found, ["core", "run"]).select(*OWNER, "level", (at + F.col("s")).alias("s"), (at + F.col("e")).alias("e")))
    spans = spans.groupBy(*OWNER).agg(F.collect_list(F.struct("level", "s", "e")).alias("spans"))
    done = cut_bytes(texts.join(spans, OWNER, "left"), length, with_text)
    return done.withColumn("doc_id", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")))


def cut_bytes(texts: DataFrame, length: int, with_text: bool) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_short long, n_short_spans long" + ", kept_bytes binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "spans")), strict=True):
                raw = text.encode()
                parts, done, found = [], 0, merge_spans([(x["s"], x["e"]) for x in spans or () if x["level"] == length])
                for a, b in found:
                    parts.append(raw[done:a])
                    done = b
                left = b"".join([*parts, raw[done:]])
                every = merge_spans([(x["s"], x["e"]) for x in spans or ()])
                rows.append((len(raw), len(raw) - len(left), len(found), hashlib.sha256(left).hexdigest(), sum(b - a for a, b in every), len(every), *([left] if with_text else [])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (6 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("id")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    return texts.select("id", "text", "spans").mapInArrow(run, schema)
