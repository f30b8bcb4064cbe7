"""Repeated word spans across documents: k-mer edges, compacted nonbranching paths, source coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewell.llm.text import Words, changes, concat_runs, merge_spans, mix, slices, sliding_argmin, string_buffer
from ratewell.llm.texts import KEY, NO_ID, OWNER, ensure_checkpoints, keyed, stored

#: Words in an edge of the graph, i.e. the shortest span that counts as repeated.
EDGE = 13
#: Words in a core. Each edge belongs to its least core; neighbouring edges mostly share one, and make a path.
CORE = 5
#: A task remembers the cores it has met in two tables of so many bits of places (8 MB each).
SEEN_BITS = 20


def paths(batch: pa.RecordBatch, edge: int, core: int):
    """Runs of consecutive edges that share their least core: row, core, first word, edges; and the hash of every edge.

    The choice of core depends on an edge's words alone, so equal edges of any documents have equal cores.
    """
    words = Words(*string_buffer(batch.column("text")))
    at, h = words.windows(edge)
    small, small_h = words.windows(core)
    every = np.full(len(words.start), ~np.uint64(0))
    every[small] = small_h
    least = sliding_argmin(every, edge - core + 1)[at] if len(at) else at
    first = changes(words.row[at], least)
    count = np.diff(np.append(first, len(at)))
    return words, at, h, first, count, words.row[at[first]], every[least[first]]


def cores_of(texts: DataFrame, edge: int, core: int) -> DataFrame:
    """(key, salt, id), once per text and core; key is core ^ salt << 40.

    Salt 0: nothing that the task has read before has the core, so rows with its key have to be counted. Where it has been
    read before, or several texts of a slice have it, each row has a key of its own (its salt says that the core is
    repeated), and one row without an id stands for them under the core, once for the task. So a core that a third of all
    texts have is a few rows per task. A task remembers cores in a table of fixed size, in which later ones replace
    earlier ones; a core that was forgotten is counted as if it were new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, told = np.zeros(1 << SEEN_BITS, np.uint64), np.zeros(1 << SEEN_BITS, np.uint64)
        for batch in slices(batches):
            *_, row, own = paths(batch, edge, core)
            if not len(row):
                continue
            order = np.lexsort((row, own))
            order = order[changes(own[order], row[order])]
            row, own = row[order], own[order]
            first = changes(own)
            texts_ = np.diff(np.append(first, len(own)))
            single = own[first]
            slot = mix(single) >> np.uint64(64 - SEEN_BITS)
            again = (texts_ > 1) | (met[slot] == single)
            met[slot] = single
            salt = np.where(np.repeat(again, texts_), row + 1, 0)
            new = again & (told[slot] != single)
            told[slot[new]] = single[new]
            shared = single[new]
            key = np.concatenate([own ^ (salt.astype(np.uint64) << np.uint64(40)), shared])
            id_ = pa.concat_arrays([batch.column("id").take(pa.array(row)), pa.nulls(len(shared), pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate([salt, np.zeros(len(shared), np.int64)]).astype(np.int32)), id_], names=["key", "salt", "id"])

    return texts.select("id", "text").mapInArrow(run, "key long, salt int, id long")


def repeated_paths(texts: DataFrame, edge: int, core: int) -> DataFrame:
    """(path, core, k1, id, pos, n) of the paths whose core is in column ``cores``: n edges from word ``pos`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, at, h, first, count, row, own = paths(batch, edge, core)
            asked = batch.column("cores")
            asked_row = mix(np.repeat(np.arange(batch.num_rows), np.asarray(asked.value_lengths())).astype(np.uint64))
            hit = np.flatnonzero(np.isin(own ^ mix(row.astype(np.uint64)), asked.flatten().to_numpy().view(np.uint64) ^ asked_row))
            if not len(hit):
                continue
            first, count, row, own = first[hit], count[hit], row[hit], own[hit]
            path = mix(h[first] ^ mix(h[first + count - 1] + count.astype(np.uint64)))
            place, take = at[first] - words.first[row], pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(path.view(np.int64)), pa.array(own.view(np.int64)), batch.column("k1").take(take), batch.column("id").take(take), pa.array(place.astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["path", "core", "k1", "id", "pos", "n"],
            )

    return texts.select("id", *KEY, "text", "cores").mapInArrow(run, "path long, core long, k1 long, id long, pos int, n int")


def edges_of(texts: DataFrame, edge: int) -> DataFrame:
    """(path, source, i, edge) for each edge of the paths asked for beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(*string_buffer(batch.column("text")))
            at, h = words.windows(edge)
            every = np.zeros(len(words.start), np.uint64)
            every[at] = h
            asked = batch.column("asked")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(asked.value_lengths()))
            fields = {f: asked.flatten().field(f).to_numpy() for f in ("path", "pos", "n")}
            n = fields["n"].astype(np.int64)
            begin = words.first[row] + fields["pos"]
            spot = concat_runs(begin, n)
            i = spot - np.repeat(begin, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(fields["path"], n)), batch.column("id").take(pa.array(np.repeat(row, n))), pa.array(i.astype(np.int32)), pa.array(every[spot].view(np.int64))], names=["path", "source", "i", "edge"]
            )

    return texts.select("id", *KEY, "text", "asked").mapInArrow(run, "path long, source long, i int, edge long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edge: int = EDGE, core: int = CORE, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    A word is removed if a run of ``edge`` words that covers it also starts in a document with a smaller id.

    The graph's edges are runs of ``edge`` words. Edges that follow each other and share their least core form a path:
    a path goes through the joins as one row instead of one row per edge.
    1. Cores that occur in one text only are dropped, and with them most of the corpus: no repeated edge lies there.
    2. Equal paths become one, with the least document that holds it as source. A core with one path only doesn't
       branch: the whole path is repeated wherever it occurs.
    3. The paths of a branching core are taken apart at their source's coordinates, and the least document is found for
       each edge.
    4. A join on the path leads from each place where a path occurs to its sources; what is covered comes back as
       word coordinates of the document and is cut out of the text itself.
    Of equal texts the least document alone is worked on; a later one loses every word if it has ``edge`` words or more.

    Cores are taken from the scan; afterwards hashes and coordinates move to the texts, which are shuffled by their
    document and shared by the steps of a query. Edges are compared by 64-bit hashes, paths by the hash of both of their
    ends. No list grows with a group: lists hold the cores, paths or spans of one text. Null text: no words. A null id
    counts as larger than any other, and no null id as smaller than another. Rows that share an id never remove each
    other's words. Empty table: empty result. Needs spark.checkpoint.dir.
    """
    ensure_checkpoints(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    texts = rows.select(*OWNER, "k2", "text")
    least = rows.groupBy(*KEY).agg(F.min("id").alias("low")).checkpoint()
    # One shuffle and one pass over the texts for both the count and the rows.
    weight = F.when((F.col("salt") > 0) | F.col("id").isNull(), 2).otherwise(1)
    cores = cores_of(texts, edge, core).withColumn("n", F.sum(weight).over(Window.partitionBy("key"))).filter("n > 1 and id is not null")
    asked = cores.groupBy("id").agg(F.collect_list(F.col("key").bitwiseXOR(F.shiftleft(F.col("salt").cast("long"), 40))).alias("cores"))
    # All joins with ``texts`` in one query read the same columns, so that they share one shuffle.
    asked = asked.join(least.select(F.col("low").alias("id"), "k1"), "id")
    asked = stored(asked)
    found = repeated_paths(texts.join(asked, OWNER), edge, core)

    unique = found.groupBy("path").agg(F.min(F.struct("id", "k1", "pos", "n", "core")).alias("s")).select("path", "s.*")
    unique = stored(unique)
    # What is counted is written before it is joined: both sides of each join are plain shuffles, which can be split where a core or an edge is hot.
    branching = stored(unique.groupBy("core").agg(F.count(F.lit(1)).alias("branches")).filter("branches > 1"))
    known = unique.join(branching, "core", "left")
    plain = known.filter("branches is null").select("path", F.col("id").alias("source"), F.lit(None).cast("array<long>").alias("sources"))
    taken = known.filter("branches is not null").groupBy(*OWNER).agg(F.collect_list(F.struct("path", "pos", "n")).alias("asked"))
    edges = edges_of(texts.join(taken, OWNER), edge)
    first = stored(edges.groupBy("edge").agg(F.min("source").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("edge", "first"))
    forked = edges.join(first, "edge", "left").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("first", "source").alias("first")))).alias("s"))
    forked = forked.select("path", F.lit(None).cast("long").alias("source"), F.col("s.first").alias("sources"))

    placed = found.join(plain.union(forked), "path")
    whole = F.when(F.col("source") < F.col("id"), F.array(F.struct(F.col("pos").alias("s"), (F.col("pos") + F.col("n") + (edge - 1)).alias("e")))).otherwise(F.array())
    each = F.filter(
        F.transform("sources", lambda x, i: F.when(x < F.col("id"), F.struct((F.col("pos") + i).alias("s"), (F.col("pos") + i + edge).alias("e")))), lambda x: x.isNotNull()
    )
    spans = placed.select(*OWNER, F.when(F.col("sources").isNull(), whole).otherwise(each).alias("spans")).filter(F.size("spans") > 0)
    spans = spans.groupBy(*OWNER).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    done = cut_words(texts.join(spans, OWNER, "left"), with_text).join(least, KEY)

    later = (F.col("id") > F.col("low")) & (F.col("n_words") >= edge)
    columns = [
        F.when(F.col("id") < NO_ID, F.col("id")).alias("doc_id"), "n_words", F.when(later, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    return done.select(*columns, *([F.when(later, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))


def cut_words(texts: DataFrame, with_text: bool) -> DataFrame:
    schema = "id long, k1 long, k2 long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                kept, done = [], 0
                for a, b in merge_spans([(x["s"], x["e"]) for x in spans or ()]):
                    kept += words[done:a]
                    done = b
                kept += words[done:]
                left = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), *([left.decode()] if with_text else [])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (3 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "k1", "k2")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    return texts.select("id", *KEY, "text", "spans").mapInArrow(run, schema)
