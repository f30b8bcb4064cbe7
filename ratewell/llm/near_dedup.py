"""Near duplicates: MinHash bands propose, odd sketches estimate, full shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewell.llm.components import components
from ratewell.llm.text import Words, changes, concat_runs, mix, slices, string_buffer, whole_groups
from ratewell.llm.texts import ensure_checkpoints, stored

#: At a similarity of 0.8, all 32 bands of 4 miss a pair once in 20 million.
BANDS, ROWS = 32, 4
#: MinHash samples folded into each odd sketch, and its bits. The estimate's deviation near 0.8 is about 0.015.
SAMPLES, BITS = 1024, 4096
#: Pairs whose estimate is five deviations below the threshold are not checked on their full sets.
MARGIN = 0.075
#: Members of a bucket that are compared at once when parts of it are not linked yet; larger buckets go block by block.
BLOCK = 512
#: Pairs whose bands and sketches are in memory at once (20 times as many by their numbers alone).
CHUNK = 10_000

SIGNATURE = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
PROFILE = "rep long, n long, shingles binary, sketch binary"


def _seeds(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(2 * n, dtype=np.uint64) + np.uint64(salt))
    return x[:n], x[n:] | np.uint64(1)


def shingle_rows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle of k words, repeats included; a row with fewer words has its whole sequence as one."""
    at, h = words.windows(k)
    row = words.row[at]
    few = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(few):
        own = []
        for r in few:
            x = np.uint64(len(words.hash[words.first[r] : words.first[r + 1]]))
            for w in words.hash[words.first[r] : words.first[r + 1]]:
                x = mix(np.array([x], np.uint64) ^ w)[0]
            own.append(x)
        row, h = np.concatenate([row, few]), np.concatenate([h, np.array(own, np.uint64)])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, h


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, one after another; the rows that have any, and where each begins."""
    words = Words(*string_buffer(batch.column("text")), lower=True)
    row, h = shingle_rows(words, k)
    rows, first = np.unique(row, return_index=True)
    parts = [np.unique(h[a:b]) for a, b in zip(first, [*first[1:], len(h)], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), rows, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def minhash(shingles: np.ndarray, starts: np.ndarray, samples: int, salt: int) -> np.ndarray:
    """samples x sets: the least of each hash function over each set."""
    flip, times = _seeds(samples, salt)
    out = np.empty((samples, len(starts)), np.uint64)
    for j in range(samples):
        x = shingles ^ flip[j]
        x *= times[j]
        x ^= x >> np.uint64(32)
        np.minimum.reduceat(x, starts, out=out[j])
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, size and 128-bit id of the shingle set, and one key per band (band number mixed in); no keys if the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            shingles, rows, starts = _sets(batch, k)
            n = batch.num_rows
            size, s1, s2 = (np.zeros(n, np.int64) for _ in range(3))
            if len(rows):
                size[rows] = np.diff(starts)
                s1[rows] = np.add.reduceat(mix(shingles), starts[:-1]).view(np.int64)
                s2[rows] = np.bitwise_xor.reduceat(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts[:-1]).view(np.int64)
                least = minhash(shingles, starts[:-1], BANDS * ROWS, 1).reshape(BANDS, ROWS, -1)
                key = mix(np.arange(BANDS, dtype=np.uint64))[:, None] ^ least[:, 0]
                for r in range(1, ROWS):
                    key = mix(key) ^ least[:, r]
                keys = mix(key).T.astype(np.uint64).view(np.int64).ravel()
            else:
                keys = np.zeros(0, np.int64)
            lengths = np.zeros(n, np.int64)
            lengths[rows] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (size, s1, s2)), bands], names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.mapInArrow(run, SIGNATURE)


def odd_sketches(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of BITS / 8 bytes per set: each MinHash sample flips the bit that a hash of (sample number, value) names."""
    least = minhash(shingles, starts, SAMPLES, 7)
    bit = (mix(least ^ mix(np.arange(SAMPLES, dtype=np.uint64))[:, None]) % np.uint64(BITS)).astype(np.int64)
    bit += np.arange(len(starts)) * BITS
    return np.packbits((np.bincount(bit.ravel(), minlength=BITS * len(starts)) & 1).astype(np.uint8).reshape(len(starts), BITS), axis=1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing bits of two odd sketches."""
    inner = np.maximum(1 - 2 * differing / BITS, 1e-9)
    return 1 + BITS / (4 * SAMPLES) * np.log(inner)


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """Full sorted set and odd sketch of each document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 18):
            shingles, rows, starts = _sets(batch, k)
            if not len(rows):
                continue
            sketch = odd_sketches(shingles, starts[:-1])
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[rows]
            sets = [shingles[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(starts)), pa.array(sets, pa.binary()), pa.array([s.tobytes() for s in sketch], pa.binary())], names=["rep", "n", "shingles", "sketch"])

    return docs.mapInArrow(run, PROFILE)


def verified(pairs: DataFrame, profile: DataFrame, percent: int, sketched: bool = False) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Odd sketches come first, unless the pairs have been through them (``sketched``): pairs whose estimate is too low are
    dropped, and full sets are joined to the others only.
    """
    least = percent / 100 - MARGIN

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array(estimate(np.bitwise_count(x ^ y).sum(1)) >= least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def beside(pairs: DataFrame, column: str) -> DataFrame:
        left = profile.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col(column).alias("x"))
        right = profile.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col(column).alias("y"))
        return pairs.join(left, "a").join(right, "b")

    alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    proposed = pairs if sketched else stored(beside(pairs, "sketch").filter(alike).select("a", "b", "x", "y").mapInArrow(near, "a long, b long"))
    return beside(proposed, "shingles").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def rare_prefixes(profile: DataFrame, suspects: DataFrame, percent: int) -> DataFrame:
    """(key, rep, root, n, at, reach) of suspects (rep, root): the shingles that links can show in, and their places.

    Each set is put in one order, rare shingles first. Sets of n shingles that are linked share one among the first
    n - percent * n / 100 + 1 of each, so only those are returned, and of them only the ones that another suspect has.
    at: the place in the order. reach: the size of the largest set that can be linked to this one, if this shingle is the
    first that both have.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            keys = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.int64)
            rep, n = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("rep", "n"))
            for i in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)]) for x in (rep, n, keys)], names=["rep", "n", "key"])

    sets = profile.join(suspects.select("rep"), "rep", "left_semi").select("rep", "n", "shingles")
    grams = sets.mapInArrow(each, "rep long, n long, key long")
    shared = stored(grams.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1"))
    own = Window.partitionBy("rep")
    ranked = grams.join(shared, "key").withColumn("at", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("sets", "key")) - 1)
    first = ranked.filter(100 * (F.col("n") - F.col("at")) >= percent * F.col("n"))
    reach = F.floor((F.col("n") - F.col("at")) * (100 + percent) / percent) - F.col("n")
    return first.join(suspects, "rep").select("key", "rep", "root", "n", "at", reach.alias("reach"))


def unlinked_rows(prefixes: DataFrame) -> DataFrame:
    """Rows of rare_prefixes() that can be one half of a link between two roots, with the shape of their key's group: the
    root that most of its rows have, how many have it, and how many have others.

    Of two linked sets the smaller one reaches the larger, so only keys count where a set reaches its own size or more, and
    of their rows those that such a set can reach.
    """
    prefixes = stored(prefixes)
    reaching = F.col("reach") >= F.col("n")
    bounds = prefixes.groupBy("key").agg(F.min(F.when(reaching, F.col("n"))).alias("least"), F.max(F.when(reaching, F.col("reach"))).alias("most"), (F.min("root") != F.max("root")).alias("apart"))
    alive = prefixes.join(bounds.filter("apart and most is not null").drop("apart"), "key").filter("n <= most and reach >= least").drop("least", "most")
    alive = stored(alive)
    counts = alive.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    shape = F.struct(F.max_by("root", F.struct("rows", "root")).alias("big"), F.max("rows").alias("inside"), (F.sum("rows") - F.max("rows")).alias("outside"))
    return alive.join(stored(counts.groupBy("key").agg(shape.alias("shape")).filter("shape.outside > 0")), "key")


def unlinked_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, root_a, root_b, alike) of rows (key, shape, rep, root, n, at, sketch) with one key and two roots whose
    sketches say they may be similar, and how much.

    Members of the largest root of a key are linked already, so only the others (the outsiders) are compared, with everyone.
    Both sides are cut into blocks of BLOCK, and a task compares a block of outsiders with one other block; members of the
    largest root go to as many tasks as there are blocks of outsiders. Sizes and places rule out most pairs before their
    sketches are looked at, and only pairs that pass leave the task.
    """
    least = percent / 100 - MARGIN

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """All tasks' rows at once, as most tasks are a few rows: pairs are laid out for each outsider with its task."""
        rows = rows.combine_chunks()
        rep, root, n, at, block, outside, inner, alone, task = (rows.column(c).to_numpy() for c in ("rep", "root", "n", "at", "block", "outside", "inner", "alone", "task"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(rep), -1)
        first = changes(task)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(task))))
        outsiders = np.flatnonzero(outside)
        begin, mates = first[group[outsiders]], np.diff(np.append(first, len(task)))[group[outsiders]]
        upto = np.cumsum(mates)
        done = 0
        while done < len(outsiders):
            to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + 20 * CHUNK, "right")))
            p, q = np.repeat(outsiders[done:to], mates[done:to]), concat_runs(begin[done:to], mates[done:to])
            may = (root[p] != root[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
            # If this key is the first that both have, no more than what follows it can be common.
            may &= (100 + percent) * np.minimum(n[p] - at[p], n[q] - at[q]) >= percent * (n[p] + n[q])
            may &= np.where(inner[p], (q > p) & (alone[p] | (block[p] != block[q])), ~outside[q])
            p, q = p[may], q[may]
            for part in range(0, len(p), CHUNK):
                a, b = p[part : part + CHUNK], q[part : part + CHUNK]
                alike = estimate(np.bitwise_count(sketch[a] ^ sketch[b]).sum(1))
                near = alike >= least
                a, b = a[near], b[near]
                a, b = np.where(rep[a] < rep[b], a, b), np.where(rep[a] < rep[b], b, a)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (rep[a], rep[b], root[a], root[b], alike[near]))], names=["a", "b", "root_a", "root_b", "alike"])
            done = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "task", 4 * BLOCK):
            yield from compare(rows)

    cut = lambda size: F.ceil(size / BLOCK).cast("int")
    every = lambda blocks: F.sequence(F.lit(0), blocks - 1)
    task = lambda i, j, inner: F.struct(i.alias("i"), j.alias("j"), F.lit(inner).alias("inner"))
    dealt = rows.withColumns({"outside": F.col("root") != F.col("shape.big"), "o": cut(F.col("shape.outside")), "l": cut(F.col("shape.inside"))})
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("outside"), F.col("o")).otherwise(F.col("l"))).cast("int"))
    block = F.col("block")
    with_outsiders = F.when(F.col("shape.outside") > 1, F.transform(every(F.col("o")), lambda k: task(F.least(block, k), F.greatest(block, k), True))).otherwise(F.array())
    as_outsider = F.concat(F.transform(every(F.col("l")), lambda j: task(block, j, False)), with_outsiders)
    as_member = F.transform(every(F.col("o")), lambda i: task(i, block, False))
    tasks = dealt.select("key", "rep", "root", "n", "at", "sketch", "block", "outside", F.inline(F.when(F.col("outside"), as_outsider).otherwise(as_member)))
    tasks = tasks.select("rep", "root", "n", "at", "sketch", "block", "outside", "inner", (F.col("i") == F.col("j")).alias("alone"), F.xxhash64("key", "inner", "i", "j").alias("task"))
    # Two sets may meet under several keys.
    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long, root_a long, root_b long, alike double").distinct()


def linked_roots(pairs: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all roots that the pairs of unlinked_pairs() can connect.

    One link joins two components, so of the pairs of a member and another component the one that looks most alike is
    checked first; the others are checked where the components are still apart after that. No pair is checked twice.
    """
    pairs = stored(pairs)
    best = stored(pairs.groupBy("a", "root_b").agg(F.max_by("b", F.struct("alike", "b")).alias("b"), F.min("root_a").alias("root_a")))
    first = stored(verified(best.select("a", "b"), profile, percent, sketched=True))
    joined = first.join(best, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    groups = stored(components(joined))
    left = pairs.join(groups.toDF("root_a", "x"), "root_a", "left").join(groups.toDF("root_b", "y"), "root_b", "left")
    left = left.filter(F.coalesce("x", "root_a") != F.coalesce("y", "root_b")).select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti")
    return first.union(verified(left, profile, percent, sketched=True))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut into words at space and 09-0D. A document's set holds its distinct shingles
    of ``shingle`` words; with fewer words its whole sequence. Two documents are linked if 100 * intersection >=
    percent * union. component_id is the smallest id that links lead to.

    1. Equal sets are one class, found by a 128-bit set id; only the smallest id of a class goes on.
    2. Bands of MinHash values bucket the classes. In each bucket every member is paired with one hub, the member
       whose buckets are fullest, i.e. the one nearest to the others; pairs grow as the bucket, not as its square.
    3. Odd sketches drop pairs that are too far apart, the others are checked on their full sets; links are contracted
       to components.
    4. Members of buckets that still hold two components or more are suspects. Linked sets share one of their rarest
       shingles (rare_prefixes), so suspects meet by those, and each with an odd sketch; members outside a shingle's largest
       component are compared by sketch with everyone, in blocks. What sizes, places and sketches don't rule out is checked
       on full sets, the most alike first. So every link between bucket mates is found or implied, and documents of one
       template that aren't linked don't meet at all.

    Sets are compared by the 64-bit hashes of their shingles. Null or wordless text: n_shingles 0, linked with
    nothing. Null ids: component_id null, kept. Rows that share an id are one node: they get its component.
    Empty table: empty result. Extra columns are ignored. Needs spark.checkpoint.dir.
    """
    ensure_checkpoints(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = signatures(docs, shingle).checkpoint()
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    # Written before it is joined, so that the join with a set that very many documents have can be split.
    classes = stored(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    member = full.select("doc_id", "s1", "s2", "n_shingles").join(classes, ["s1", "s2", "n_shingles"]).select("doc_id", "rep")
    single = full.join(classes.select("rep", "s1", "s2"), (F.col("doc_id") == F.col("rep")) & (full["s1"] == classes["s1"]) & (full["s2"] == classes["s2"])).select("rep", "bands")

    keyed = single.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    mates = keyed.join(shared, "key").checkpoint()
    fullness = mates.groupBy("rep").agg(F.sum("size").alias("fullness")).checkpoint()
    profile = profiles(docs.join(fullness.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), shingle).checkpoint()

    ranked = mates.join(fullness, "rep")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("fullness", "rep")).getField("rep").alias("hub"))
    pairs = ranked.join(hubs, "key").filter("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    links = stored(verified(pairs, profile, percent))

    roots = stored(components(links))
    placed = mates.join(roots, mates["rep"] == roots["node"], "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    suspects = stored(placed.join(mixed, "key", "left_semi").select("rep", "root").distinct())
    rows = unlinked_rows(rare_prefixes(profile, suspects, percent)).join(profile.select("rep", "sketch"), "rep")
    more = stored(linked_roots(unlinked_pairs(rows, percent), profile, percent))
    if not more.isEmpty():
        roots = stored(components(links.union(more)))

    low = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    named = roots.join(low, "root").select(F.col("node").alias("rep"), "component_id")
    placed = member.join(named, "rep", "left").select(F.col("doc_id").alias("id"), F.coalesce("component_id", "rep").alias("component_id"))
    placed = placed.groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = signed.join(placed, signed["doc_id"] == placed["id"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows that stay, one document of each group, with all their columns."""
    gone = near_groups(docs, id_col, text_col, **how).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
