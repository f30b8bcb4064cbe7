"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.text import slices
from ratewell.llm.texts import ensure_checkpoints, stored

CAPACITY = 4096
#: Documents in a group, on average; groups are drawn by a hash of the document, so each is a random sample.
GROUP_PIECES = 2048
#: Distinct words whose ids a worker process remembers.
CACHE_WORDS = 1_000_000
#: The marks that compose with A-Z or a-z.
MARK = re.compile("[\u0300-\u036f]")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long, sequence_tokens long, padded_to long"


class WordEncoder:
    """ids of whole texts, as little-endian uint32 bytes, word by word through a bounded cache.

    The tokenizer folds case and splits at white space before anything else, so a text's ids are its words' ids in
    order. A-Z may be folded beforehand, except in words that may hold a special token, and before marks (J with a
    caron composes only once folded). Words of letters alone are one unit each to the tokenizer, so many are encoded
    in one call; a full stop or comma after a letter is a unit of its own. What a letter is the tokenizer decides
    (see probe()): some, such as U+0130 and U+FB2A, become a letter and a mark, which is a unit apart.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), cache_words
        self.known = {"": b""}
        self.letters, self.probed = set(), set()
        self.stop = self.tokenizer.encode(".", add_special_tokens=False).ids

    def probe(self, chars: set[str]) -> None:
        """Adds to ``letters`` those that stay letters alone: in a word and before a full stop they begin no unit."""
        for c in chars - self.probed:
            if c.isalpha():
                e = self.tokenizer.encode(f"a{c}a{c}.", add_special_tokens=False)
                if e.word_ids[-2:] == [0, 1] and e.ids[-1:] == self.stop:
                    self.letters.add(c)
        self.probed |= chars

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, new = {"": b""}, [w for w in words if w]
        self.probe(set().union(*new))
        ended = [w for w in new if w[-1] in ".," and w[-2:-1] in self.letters]
        plain = {w for w in new if not (w[-1] in ".," and w[-2:-1] in self.letters)} | {w[:-1] for w in ended} | {".", ","}
        plain = [w for w in plain if w not in self.known]
        letters = [w for w in plain if self.letters.issuperset(w)]
        for at in range(0, len(letters), 1024):
            part = letters[at : at + 1024]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, ends = np.array(e.ids, "<u4").tobytes(), np.searchsorted(e.word_ids, np.arange(len(part) + 1)).tolist()
            for w, a, b in zip(part, ends, ends[1:], strict=False):
                self.known[w] = ids[4 * a : 4 * b]
        rest = [w for w in plain if not self.letters.issuperset(w)]
        for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()
        for w in ended:
            self.known[w] = self.known[w[:-1]] + self.known[w[-1]]

    @staticmethod
    def split(text: str) -> list[str]:
        if "<|" in text or not text.isascii() and MARK.search(text):
            return [w.lower() if w.isascii() and "<|" not in w else w for w in text.replace("\n", " ").split(" ")]
        return text.encode().lower().decode().replace("\n", " ").split(" ")

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [self.split(t or "") for t in texts]
        out: list[bytes | None] = []
        for words in split:
            try:
                out.append(b"".join(map(self.known.__getitem__, words)))
            except KeyError:
                out.append(None)
        waiting = [k for k, x in enumerate(out) if x is None]
        if waiting:
            self.learn(set().union(*(split[k] for k in waiting)))
            for k in waiting:
                out[k] = b"".join(map(self.known.__getitem__, split[k]))
        return out


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process, so that what a task has learnt serves the next."""
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each document's ids, then ``end_id``, cut into pieces of ``capacity`` and a rest; one row per piece.

    The rest may be of any length from 1. with_ids adds the piece's ids as ``ids``, little-endian unsigned 32-bit
    numbers one after another (numpy: "<u4"), lighter than an array column.
    ``tokenizer`` names a file on every executor; None: the public word-level file.
    Null text counts as empty: one piece that holds the end id.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, size = word_encoder(tokenizer or default_tokenizer()), 4 * capacity
        for batch in batches:
            for part in slices(iter([batch])):
                rows: list[tuple] = []
                for i, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for a in range(0, len(ids), size):
                        b = ids[a : a + size]
                        rows.append((i, a // 4, len(b) // 4, zlib.crc32(b), len(ids) // 4, *([b] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.binary()) for c in columns[5:]], names=[f"c{k}" for k in range(len(columns))])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, the largest placed first, each in the first bin with room.

    A tournament tree holds at each node the most room below it: the first bin that fits is found in log(bins) steps.
    """
    n = len(lengths)
    size = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * size)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need, node = int(lengths[i]), 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        where[i], offset[i] = node - size, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            room = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == room:
                break
            tree[node] = room
            node //= 2
    return where, offset


def pack(cut: DataFrame, pieces_count: int, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = 17) -> DataFrame:
    """Adds sequence_id and offset to each piece; pieces of one sequence lie without gaps from offset 0.

    Pieces are dealt to pieces_count / group_pieces groups by a hash of the document and its piece, so a group holds a
    bounded random share of the table whatever the documents are, and hot sources or copies spread evenly. Each
    group packs alone. A sequence that isn't full is padded to ``capacity`` (column padded_to), except where its
    length is a power of two. Piece rows carry no text and no ids (unless asked for), so what moves is small.
    """
    groups = max(1, -(-pieces_count // group_pieces))
    fields = [f for f in cut.schema.fields if f.name not in {c.split()[0] for c in PIECES.split(", ")}]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["_group"].iloc[0])
        rows = rows.drop(columns="_group").sort_values(["length", "ids_crc32", "doc_id", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        where, offset = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        total = np.bincount(where, rows["length"])[where].astype(np.int64)
        power = (total & (total - 1)) == 0
        return rows.assign(sequence_id=(group << 32) + where, offset=offset, sequence_tokens=total, padded_to=np.where(power, total, capacity))

    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))
    schema = PIECES + "".join(f", {f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long, sequence_tokens long, padded_to long"
    return dealt.groupBy("_group").applyInPandas(fit, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Documents as packed sequences: one row per piece, see pieces() and pack().

    Ties in length go by checksum and id, so a repeated run gives the same sequences. Repeated rows are packed as
    often as they occur. Null ids pack like others. An empty table gives an empty result.
    with_ids: pieces carry their token ids (binary, see pieces()). Pieces are written and counted before they are dealt, so that texts are cut once
    and a group holds ``group_pieces`` pieces or so, however long the documents are. Needs spark.checkpoint.dir.
    """
    ensure_checkpoints(docs.sparkSession)
    cut = pieces(docs, id_col, text_col, tokenizer, end_id, capacity, with_ids)
    if not with_ids:
        cut = stored(cut)
        return pack(cut, cut.count(), capacity, group_pieces)
    # Ids stay where they are while their lengths are packed, and never come to a group's task.
    cut = stored(cut.withColumn("piece", F.monotonically_increasing_id()))
    places = pack(cut.drop("ids"), cut.count(), capacity, group_pieces)
    return places.join(cut.select("piece", "ids"), "piece").drop("piece")
