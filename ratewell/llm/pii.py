"""Personal data, also when disguised: an offset-preserving transducer, detection, spans mapped back to the source.

The text is rewritten piece by piece: homoglyphs to ASCII, spelled digits to digits, at/dot disguises to ``@`` and
``.``. Each rewritten piece remembers its source range, so what is found in the rewritten text comes back as a range
of the source.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.text import slices

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match can only begin where a run of digits does: so long runs are read once
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII ones, as (their code points in order, what they look like).
LOOKALIKES = (
    ("аеорсухіјѕһӏԁԛԝѵ", "aeopcyxijshldqwv"),  # Cyrillic small
    ("АВЕКМНОРСТХ", "ABEKMHOPCTX"),  # Cyrillic capital
    ("αγικνορυχ", "ayiknopux"),  # Greek small
    ("հոսօ", "hnuo"),  # Armenian small
    ("ıɡɑ", "iga"),  # Latin
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΧ", "ABEZHIKMNOPTX"),  # Greek capital
    ("\u2010\u2011\u2012\u2013\u2212", "-----"),  # hyphens and minus
    ("\u00a0\u2007\u202f", "   "),  # spaces that don't break
)
GLYPHS = {ord(a): b for froms, tos in LOOKALIKES for a, b in zip(froms, tos, strict=True)}
GLYPHS |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # fullwidth forms
#: Mathematical letters and digits, letterlike signs, raised, lowered and circled ones: where Unicode itself names one ASCII character.
STYLED = [*range(0x1D400, 0x1D800), *range(0x2070, 0x2090), *range(0x2100, 0x2140), *range(0x2460, 0x24EA), 0x00B2, 0x00B3, 0x00B9]
GLYPHS |= {c: plain for c in STYLED if len(plain := unicodedata.normalize("NFKC", chr(c))) == 1 and plain.isascii() and plain.isalnum()}
GLYPHS |= {c + i: str(i) for c in (0x0660, 0x06F0, 0x0966) for i in range(10)}  # Arabic, Persian, Devanagari digits
#: Characters that show nothing: dropped between others.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
GLYPHS |= {ord(c): "" for c in UNSEEN}
GLYPH_CHARS = frozenset(map(chr, GLYPHS))
GLYPH = re.compile("[" + "".join(map(re.escape, map(chr, GLYPHS))) + "]")

#: Digits as words.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT = "(?:" + "|".join(DIGITS) + ")"
#: Five spelled digits or more in a row, parted by a space, a hyphen or a dot; what lies between is dropped.
SPELLED = re.compile(rf"\b{_DIGIT}(?:[ .-]{_DIGIT}){{4,}}\b", re.I)
#: Four numbers of one to three digits, spelled or not, with "dot" or "point" between them.
_PART = rf"(?:{_DIGIT}|[0-9])(?:[ -]?(?:{_DIGIT}|[0-9])){{0,2}}"
SPELLED_IP = re.compile(rf"\b{_PART}(?: (?:dot|point) {_PART}){{3}}\b", re.I)
SPELLED_PLUS = re.compile(rf"\bplus (?={_DIGIT}[ .-]{_DIGIT}\b|[0-9])", re.I)
AT, DOT = r" ?[\[({<] ?at ?[\])}>] ?", r" ?[\[({<] ?dot ?[\])}>] ?"
BRACKET_AT, BRACKET_DOT = re.compile(AT, re.I), re.compile(DOT, re.I)
#: Bare words only where a whole address is spelled: name at host dot tld.
BARE_AT = re.compile(rf"(?:{AT})| at |@", re.I)
BARE_HOST = re.compile(r"[A-Za-z0-9-]++((?: dot [A-Za-z0-9-]++)++)", re.I)
#: Found in every text that one of the patterns from SPELLED to BARE_AT would rewrite.
_CUE = re.compile(r"[\[({<] ?(?:at|dot) ?[\])}>]| dot | point |\bplus [0-9]|[ .-](?:" + "|".join(DIGITS) + r")[ .-]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; found from each ``@`` outwards, so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns in ``text``, by start, then kind."""
    out = [(a, b, 0) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


class Tape:
    """A text as it is rewritten: pieces of (place in the new text, source start, source end, kept as it was)."""

    def __init__(self, text: str):
        self.text, self.at, self.source = text, [0], [(0, len(text), True)]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ranges of the present text; edits are sorted and don't overlap."""
        if not edits:
            return
        parts, at, source, done, size = [], [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            k = bisect.bisect_right(self.at, a) - 1
            while a < b:
                to = min(b, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                s, e, same = self.source[k]
                if to > a:
                    at.append(size)
                    source.append((s + a - self.at[k], s + to - self.at[k], True) if same else (s, e, False))
                    parts.append(self.text[a:to])
                    size += to - a
                a, k = max(a, to), k + 1

        for a, b, new in edits:
            keep(done, a)
            if new:
                at.append(size)
                source.append((*self.back(a, b), False))
                parts.append(new)
                size += len(new)
            done = b
        keep(done, len(self.text))
        self.text, self.at, self.source = "".join(parts), at or [0], source or [(0, 0, True)]

    def back(self, a: int, b: int) -> tuple[int, int]:
        """The source range of [a, b) of the present text; a rewritten piece counts as a whole."""
        k = bisect.bisect_right(self.at, a) - 1
        s, _, same = self.source[k]
        start = s + a - self.at[k] if same else s
        k = bisect.bisect_right(self.at, max(a, b - 1)) - 1
        s, e, same = self.source[k]
        return start, s + b - self.at[k] if same else e


def bare(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits that turn "name at host dot tld" into an address; found from each "at" outwards, so parts may be of any length."""
    done = at = 0
    while m := BARE_AT.search(text, at):
        at, start = m.start() + 1, m.start()
        if not (host := BARE_HOST.match(text, m.end())):
            continue
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if done <= start < m.start() and text[start].isalnum():
            yield m.start(), m.end(), "@"
            for dot in re.finditer(" dot ", host[1], re.I):
                yield host.start(1) + dot.start(), host.start(1) + dot.end(), "."
            done = at = host.end()


def numbers(said: str) -> str:
    """An address of four numbers as digits and dots."""
    parts = re.split(" (?:dot|point) ", said.lower())
    return ".".join("".join(DIGITS.get(x, x) for x in re.findall(f"{_DIGIT}|[0-9]", part)) for part in parts)


def normalise(text: str) -> Tape | None:
    """The tape after all rewriting, None if nothing had to be rewritten."""
    glyphs = not text.isascii() and not GLYPH_CHARS.isdisjoint(text)  # a search for that many characters takes ten times as long
    if not glyphs and not _CUE.search(text):
        return None
    tape = Tape(text)
    if glyphs:
        tape.rewrite([(m.start(), m.end(), GLYPHS[ord(m[0])]) for m in GLYPH.finditer(tape.text)])
    tape.rewrite(list(bare(tape.text)))
    tape.rewrite([(m.start(), m.end(), numbers(m[0])) for m in SPELLED_IP.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), ".") for m in BRACKET_DOT.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), "@") for m in BRACKET_AT.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), "+") for m in SPELLED_PLUS.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), "".join(DIGITS[x] for x in re.split("[ .-]", m[0].lower()))) for m in SPELLED.finditer(tape.text)])
    return tape if len(tape.at) > 1 or tape.text != text else None


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that only show after rewriting and overlap no base span of their kind."""
    base = find(text)
    tape = normalise(text)
    if tape is None:
        return base, []
    taken: dict[int, list[tuple[int, int]]] = {}
    for a, b, kind in base:
        taken.setdefault(kind, []).append((a, b))
    more = []
    for a, b, kind in find(tape.text):
        s, e = tape.back(a, b)
        own = taken.get(kind, [])
        k = bisect.bisect_left(own, (e,))
        if k == 0 or own[k - 1][1] <= s:
            more.append((s, e, kind))
    return base, more


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def redact(text: str) -> str:
    """The text with each maximal covered range replaced by its first span's kind in angle brackets."""
    out, done = [], 0
    for a, b, kind in sorted(sum(scan(text), []), key=lambda x: (x[0], -x[1])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_found long"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts by kind, digest of the base spans, all spans, how many the method added,
    and how many there are in all.

    Offsets are code points of the source text, end exclusive. Null text counts as empty: no spans, and the digest
    of the empty string. Rows are scanned alone and whole: null ids and repeated rows pass through, nothing is
    shuffled, extra columns are ignored, an empty table gives an empty result. An added span may touch or cross
    spans of other kinds, never one of its own kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, more = scan(text or "")
                n = [0] * 4
                for x in base:
                    n[x[2]] += 1
                rows.append((i, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more), len(base) + len(more)))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data replaced in ``text_col``; null stays null. ``size_col``, if there, is counted anew."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else redact(x))

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(size_col, F.char_length(text_col).cast(docs.schema[size_col].dataType)) if size_col in docs.columns else out
