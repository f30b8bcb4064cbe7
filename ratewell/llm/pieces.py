"""SentencePiece models: Viterbi segmentation in numpy over many words at once, and decoding."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.text import mix, slices

#: Distinct words whose ids a worker process remembers.
CACHE_WORDS = 1_600_000
#: Cells (words x characters x piece lengths) worked on at once.
CELLS = 1 << 21
#: Words are runs of spaces with what follows up to the next space; pieces hold spaces in front only.
WORD = re.compile(" *[^ ]+| +")
_STEP = np.uint64(0x9FB21C651E98DF25)
#: The score of a character that is no piece, below the least piece by this much, as the library has it.
UNKNOWN_GAP = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_type(proto: bytes) -> int:
    """1: unigram, 2: merges. Field 3 of the message in field 2 of a model file."""

    def number(raw: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    def field(raw: bytes, wanted: int):
        at, found = 0, None
        while at < len(raw):
            tag, at = number(raw, at)
            if tag & 7 == 2:
                size, at = number(raw, at)
                value, at = raw[at : at + size], at + size
            elif tag & 7 == 0:
                value, at = number(raw, at)
            else:
                value, at = None, at + (4 if tag & 7 == 5 else 8)
            if tag >> 3 == wanted:
                found = value
        return found

    return field(field(proto, 2) or b"", 3) or 1


class Pieces:
    """A model's pieces by hash, and both directions of coding.

    Unigram models: ids are those of the segmentation with the largest sum of piece scores.
    Merge-trained (BPE) models: scores are merge ranks, whose sum doesn't choose what the merges would. But merges of a
    word keep the border between two neighbouring pieces exactly if merging the two pieces' characters alone keeps it.
    So each prefix of a word has one last piece that gets on with the one before it, and the same forward pass finds it:
    a piece gains nothing where it gets on with the best last piece before it, and is ruled out elsewhere. Whether two
    pieces get on is found from the scores for many pairs at once (``ask``), and remembered.
    Characters that are no piece become the byte pieces of their UTF-8. A U+2581 in a text does too, as the model writes
    spaces that way; so decoding gives every text back.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_id = np.zeros(256, np.uint32)
        self.merges, self.size = model_type(model.serialized_model_proto()) == 2, n
        self.pair, self.agrees = np.full(1 << 21, -1), np.zeros(1 << 21, bool)  # answers by hash of the pair; a later pair takes the place
        self.spelled = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(names[i][3:5], 16)] = i
                self.spelled[i] = bytes([int(names[i][3:5], 16)])
        for i in usual:
            self.spelled[i] = names[i].replace("▁", " ").encode()
        self.longest = max(len(names[i]) for i in usual)
        keys = np.array([self.fold(np.frombuffer(names[i].replace("▁", " ").encode("utf-32-le"), np.uint32)) for i in usual], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usual)[order]
        self.scores = np.array([model.get_score(i) for i in usual])[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.unknown = self.scores.min() - UNKNOWN_GAP
        self.maybe = np.zeros(1 << 22, bool)  # whether any key begins with these bits
        self.maybe[self.keys >> np.uint64(42)] = True
        self.known, self.past, self.most = {}, {}, cache_words
        if self.merges:
            self.prepare_merges({names[i]: i for i in usual}, np.array([model.get_score(i) for i in range(n)]))

    def prepare_merges(self, usual: dict[str, int], scores: np.ndarray) -> None:
        """What merging knows: every pair of pieces that together are a piece; and of each piece, its rank among merges
        (single characters come first) and the two pieces that its own merge joins (itself, if it is no merge).

        ``tied``: pieces whose rank others share, and those that merging never makes; they are merged in full when asked.
        """
        pairs = sorted((usual[x[:k]] * self.size + usual[x[k:]], own) for x, own in usual.items() for k in range(1, len(x)) if x[:k] in usual and x[k:] in usual)
        self.pair_keys, self.pair_ids = np.array([k for k, _ in pairs] or [-1]), np.array([own for _, own in pairs] or [-1])
        self.pair_scores = scores[self.pair_ids]
        self.letters = {own: [usual.get(c, -1) for c in x] for x, own in usual.items()}
        several = np.array([own for own, x in self.letters.items() if len(x) > 1] or [-1])
        self.rank, self.head, self.tail = np.arange(self.size), np.arange(self.size), np.arange(self.size)
        self.tied = np.zeros(self.size, bool)
        order = several[np.lexsort((several, -scores[several]))]
        self.rank[order] = self.size + np.arange(len(order))
        same = scores[order][1:] == scores[order][:-1]
        self.tied[order[1:][same]] = self.tied[order[:-1][same]] = True
        longest = max(map(len, self.letters.values()))
        for at in range(0, len(several), 8192):
            own = several[at : at + 8192]
            rows = np.array([self.letters[x] + [-2] * (longest - len(self.letters[x])) for x in own.tolist()])
            end, last = self.merge(rows)
            made = (end[:, 0] == own) & (end[:, 1] == -2)
            self.tied[own[~made]] = True
            self.head[own[made]], self.tail[own[made]] = last[made].T

    @staticmethod
    def fold(points: np.ndarray) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for x in mix(points.astype(np.uint64)):
            h = h * _STEP + x
        return h[0]

    def viterbi(self, points: np.ndarray) -> list[bytes]:
        """ids, as uint32 bytes, of words of one length: rows of code points."""
        n, size = points.shape
        most = min(self.longest, size)
        mixed = mix(points.astype(np.uint64))
        gain = np.full((n, size + 1, most), -np.inf)  # of the piece that ends there, by its length less one
        piece = np.full((n, size + 1, most), -1, np.int32)
        h = np.zeros((n, size), np.uint64)
        for length in range(1, most + 1):
            h = h[:, : size - length + 1] * _STEP + mixed[:, length - 1 :]
            word, start = np.nonzero(self.maybe[h >> np.uint64(42)] & (points[:, : size - length + 1] != 0x2581))
            own = h[word, start]
            at = np.searchsorted(self.keys, own)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == own
            word, end, at = word[hit], start[hit] + length, at[hit]
            if length == 1:
                gain[:, 1:, 0] = self.unknown
            gain[word, end, length - 1], piece[word, end, length - 1] = self.scores[at], self.ids[at]
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        step = np.zeros((n, size + 1), np.int32)
        last = np.full((n, size + 1), self.size + 1)  # piece that the best segmentation ends with; size: no piece
        rows = np.arange(n)
        for end in range(1, size + 1):
            k = min(most, end)
            total = best[:, end - k : end][:, ::-1] + (self.borders(last[:, end - k : end][:, ::-1], piece[:, end, :k], gain[:, end, :k]) if self.merges else gain[:, end, :k])
            step[:, end] = total.argmax(1)
            best[:, end] = total[rows, step[:, end]]
            own = piece[rows, end, step[:, end]]
            last[:, end] = np.where(own < 0, self.size, own)
        ends, found = np.full(n, size), []
        alive = rows
        while len(alive):
            e = ends[alive]
            s = step[alive, e]
            found.append((alive, e, piece[alive, e, s]))
            ends[alive] = e - s - 1
            alive = alive[ends[alive] > 0]
        who, end, own = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((end, who))
        who, end, own = who[order], end[order], own[order]
        cuts = np.searchsorted(who, np.arange(n + 1)).tolist()
        out = []
        plain = np.ones(n, bool)
        plain[who[own < 0]] = False
        ids = own.astype("<u4").tobytes()
        for w, (a, b, whole) in enumerate(zip(cuts, cuts[1:], plain.tolist(), strict=False)):
            if whole:
                out.append(ids[4 * a : 4 * b])
            else:
                parts = [self.byte_id[list(chr(points[w, end[k] - 1]).encode())] if own[k] < 0 else own[k : k + 1] for k in range(a, b)]
                out.append(np.concatenate(parts).astype("<u4").tobytes())
        return out

    def borders(self, before: np.ndarray, after: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """0 where merging leaves the border between the pieces, minus infinity elsewhere or where there's no piece."""
        out = np.full(before.shape, -np.inf)
        out[(after < 0) & (gain > -np.inf)] = 0
        which = np.nonzero(after >= 0)
        codes = before[which].astype(np.int64) * self.size + after[which]
        place = mix(codes.astype(np.uint64)) >> np.uint64(43)
        kept = self.agrees[place]
        unseen = np.flatnonzero(self.pair[place] != codes)
        if len(unseen):
            new, back = np.unique(codes[unseen], return_inverse=True)
            answers = self.ask(*np.divmod(new, self.size))
            kept[unseen] = answers[back]
            place = mix(new.astype(np.uint64)) >> np.uint64(43)
            self.pair[place], self.agrees[place] = new, answers
        out[which] = np.where(kept, 0, -np.inf)
        return out

    def ask(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merges keep the border of each pair of pieces; first: ``size`` or more where no piece stands before.

        A merge across the border would join a piece on the right edge of the first, as it was at some time, and one on
        the left edge of the second. Both edges are taken back merge by merge, the later one first; a pair that makes a
        piece before either of its members goes on into a larger piece breaks the border.
        """
        alone = first >= self.size
        tied = self.tied[second] | ~alone & self.tied[np.where(alone, 0, first)]
        out = np.ones(len(first), bool)
        out[tied] = self.ask_in_full(first[tied], second[tied])
        who = np.flatnonzero(~alone & ~tied)
        a, b, limit = first[who], second[who], np.full(len(who), np.iinfo(np.int64).max)
        while len(who):
            score, both = self.joined(a, b)
            broken = (score > -np.inf) & (self.rank[both] < limit)
            out[who[broken]] = False
            later = self.rank[a] > self.rank[b]
            rank_a, rank_b = self.rank[a], self.rank[b]
            whole_a, whole_b = self.tail[a] == a, self.head[b] == b
            left = np.where(later, ~whole_a, whole_b & ~whole_a)  # the edge that is taken back
            done = broken | whole_a & whole_b
            limit = np.where(left, rank_a, rank_b + 1)
            a, b = np.where(left, self.tail[a], a), np.where(left, b, self.head[b])
            who, a, b, limit = (x[~done] for x in (who, a, b, limit))
        return out

    def ask_in_full(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The same by merging all characters of each pair."""
        spelled = [(self.letters[a] if a < self.size else []) + self.letters[b] for a, b in zip(first.tolist(), second.tolist(), strict=True)]
        if not spelled:
            return np.zeros(0, bool)
        size = max(3, *map(len, spelled))
        left = self.merge(np.array([x + [-2] * (size - len(x)) for x in spelled]))[0]
        return np.where(first >= self.size, (left[:, 0] == second) & (left[:, 1] == -2), (left[:, 0] == first) & (left[:, 1] == second) & (left[:, 2] == -2))

    def merge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of pieces after all merges, filled up with -2, and the two pieces that each row's last merge joined: in
        each round every row merges the neighbours whose piece has the best score, the leftmost of equals."""
        rows, (n, size) = rows.copy(), rows.shape
        alive, place, last = np.arange(n), np.arange(size), np.full((n, 2), -2)
        gain, into = (x.reshape(n, size - 1) for x in self.joined(rows[:, :-1].ravel(), rows[:, 1:].ravel()))
        while size > 1 and len(alive):
            at = gain[alive].argmax(1)
            more = gain[alive, at] > -np.inf
            alive, at = alive[more], at[more]
            last[alive] = np.stack([rows[alive, at], rows[alive, at + 1]], 1)
            rows[alive, at] = into[alive, at]
            shift = place + (place > at[:, None])
            rows[alive] = np.take_along_axis(np.column_stack([rows[alive], np.full(len(alive), -2)]), shift, 1)
            shift = np.minimum(shift[:, :-1], size - 1)
            gain[alive] = np.take_along_axis(np.column_stack([gain[alive], np.full(len(alive), -np.inf)]), shift, 1)
            into[alive] = np.take_along_axis(np.column_stack([into[alive], np.full(len(alive), -2)]), shift, 1)
            for k in (at - 1, at):
                fits = (k >= 0) & (k < size - 1)
                who, k = alive[fits], k[fits]
                gain[who, k], into[who, k] = self.joined(rows[who, k], rows[who, k + 1])
        return rows, last

    def joined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece that two neighbours make, minus infinity if none."""
        key = np.where((a < 0) | (b < 0), -1, a * self.size + b)
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        hit = self.pair_keys[at] == key
        return np.where(hit & (key >= 0), self.pair_scores[at], -np.inf), self.pair_ids[at]

    def learn(self, words: set[str]) -> None:
        if 2 * (len(self.known) + len(words)) > self.most:  # words not met since the last time are forgotten
            self.known, self.past = {}, self.known
        self.known.update((w, self.past[w]) for w in words if w in self.past)
        new = [w for w in words if w not in self.known]
        by_size: dict[int, list[str]] = {}
        for w in new:
            by_size.setdefault(len(w), []).append(w)
        for size, own in by_size.items():
            step = max(1, CELLS // (size * min(size, self.longest)))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                points = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), size)
                self.known.update(zip(part, self.viterbi(points), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """ids as uint32 bytes; a space goes before the text, as the model's normaliser has it. Empty text: no ids."""
        split = [WORD.findall(" " + t) if t else [] for t in texts]
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

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


@functools.cache
def pieces_of(path: str) -> Pieces:
    """One for each worker process."""
    return Pieces(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each whole text. Null text: null ids; empty text: no ids. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(model or default_model())
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            ids = [None if t is None else np.frombuffer(x, "<u4").astype(np.int32) for t, x in zip(texts, coder.encode(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of ids. Null ids: null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(model or default_model())
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text string")


DIGEST = "doc_id long, n_tokens long, n_bytes_pieces long, ids_crc32 long, round_trip boolean"


def coding_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per document: tokens, tokens that are byte pieces, CRC-32 of the ids (little-endian uint32), and whether decoding
    gives the text back exactly. Null text counts as empty: no tokens. Null ids and repeated rows pass through, each row on
    its own. Texts of any length are coded whole; of segmentations with equal scores the one with the shortest last piece
    wins. Extra columns are ignored. Empty table: empty result. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(model or default_model())
        fallback = np.zeros(len(coder.spelled), bool)
        fallback[coder.byte_id] = True
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            coded = coder.encode(texts)
            rows = [(len(x) // 4, int(fallback[np.frombuffer(x, "<u4")].sum()), zlib.crc32(x), coder.decode(x) == (t or "")) for t, x in zip(texts, coded, strict=True)]
            columns = zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.bool_()], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in columns)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGEST)
