"""Operators that judge each document alone, and exact dedup and packing, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ratewell.llm import exact_dedup, packing, pii, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, `_norm` int"
TEXTS = [
    None, "", " ", "\n\n", "one", "a b c a b c a b c", "ab\vcd\fef\rgh", "Größe É ÀB à\n\nx\nx\nx", "x " * 30000, "z" * 50000, "    a",
    "line one\nline two\nline one\n \n \nline two", "# * $ % & | < > ##", "Same Text", "same text", "SAME TEXT", "the cat sat " * 40 + "end", "ÉCOLE", "école",
    " ".join(f"w{i * i % 7919}" for i in range(900)), "".join(chr(33 + i * i % 90) + " " * (i % 6 == 0) for i in range(5000)),
    "mail a.b+c@x-y.example.com, 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8; 4111 1111 1111 1111, 4111-1111-1111-1112 +1 (555) 010-9999 +12",
    "a@b.c@d.e @x.y q@ z@z a@@b.c .@.x.y", "write to jane (at) mail [dot] example [dot] org or jane at mail dot example dot org",
    "call plus one two three four five six seven eight nine zero", "meet at noon dot", "user​@exаmple.com １２７.0.0.1",
    "<|endoftext|> it's 12,5 don't́", "'s't're\tDON'T", "00000000000000 " * 3,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(13, "Same Text", None, None), (None, "same text", "x", 1), (None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_exact(docs):
    rows, norm = docs.collect(), lambda t: (t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    want = Counter()
    for r in rows:
        g = groups[norm(r.text)]
        keep = max((x for x in g if x is not None), default=None)
        want[r.doc_id, keep, len(g), r.doc_id == keep, hashlib.sha256(norm(r.text).encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == want
    left = exact_dedup.drop_exact(docs).collect()
    assert Counter((r.doc_id, norm(r.text)) for r in left) == Counter((max((x for x in g if x is not None), default=None), t) for t, g in groups.items())
    assert {(r.doc_id, r.text, r.kept, r._norm) for r in left} <= {(r.doc_id, r.text, r.kept, r._norm) for r in rows} and left[0].asDict().keys() == {"doc_id", "text", "kept", "_norm"}


def test_exact_keeps_one_of_repeated_rows(spark):
    rows = [(5, "Same", 1), (5, "same", 2), (5, "Same", 1), (5, "other", 3), (None, "alone", 1), (None, "alone", 1), (2, "same", 9), (1, None, 0), (3, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(4)
    left = exact_dedup.drop_exact(df).collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in left if r.doc_id) == [(3, ""), (5, "other"), (5, "same")] and [r.text for r in left if r.doc_id is None] == ["alone"]
    assert sorted(map(tuple, left), key=str) == sorted(map(tuple, exact_dedup.drop_exact(df.repartition(1)).collect()), key=str)
    assert {r.doc_id for r in exact_dedup.drop_exact(df, keep="min").collect()} == {1, 2, 5, None}
    assert exact_dedup.drop_exact(df.limit(0)).count() == 0


def test_exact_empty(spark, docs):
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_collisions_fall_apart(spark):
    """With one hash for everything the bytes still decide."""
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(df, fold_case=False).collect()} == {(1, 1), (2, 2), (3, 3)}


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(docs):
    got = by_id(quality_rules.quality(docs))
    for i, t in enumerate(TEXTS):
        assert tuple(got[i])[1:7] == brute_quality(t), (i, t and t[:50])
        assert not (got[i].base_failed and got[i].kept)
    assert not got[16].kept
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect() if r.doc_id is not None} == {i for i, r in got.items() if r.kept}
    assert quality_rules.quality(docs.limit(0)).count() == 0


def banded_texts():
    """Prose of several lengths, some of it repetitive, some of it noise."""
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 9, 800)]
    prose = lambda n: " ".join(words[i] for i in rng.zipf(1.3, n) % 800)
    noise = lambda n: " ".join("".join(map(chr, rng.integers(33, 255, 6))) for _ in range(n))
    texts = [prose(n) for n in rng.integers(60, 2000, 300)]
    same = ["".join(f"row {k % 40} of the table is here again " for k in range(n)) for n in (20, 60, 200)]
    return texts + [texts[0]] * 40 + [noise(n) for n in (60, 200, 900)] + same + [texts[3] + noise(400)], {340, 341, 342}


def plain_limits(texts):
    import math

    import zstandard

    pack = zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress
    found = {}
    for raw in {t.encode() for t in texts if t}:
        parts = [raw] + [raw[k : k + 2048] for k in range(0, len(raw), 2048)]
        for k, part in enumerate(parts):
            found.setdefault((k > 0, int(2 * math.log2(len(part)))), []).append(math.floor(math.log(len(part) / len(pack(part))) / 0.005))
    out = {}
    for key in found:
        near = sorted((k[1] for k in found if k[0] == key[0]), key=lambda b: (abs(b - key[1]), b))
        upto = next((k for k in range(1, len(near)) if sum(len(found[key[0], b]) for b in near[:k]) >= quality_rules.BAND_TEXTS), len(near))
        bins = sorted(x for b in near[:upto] for x in found[key[0], b])
        lent = [sorted(found[key[0], b]) for b in near[: max(upto, 3)]]
        medians = [(x[math.ceil(0.5 * len(x)) - 1] + 0.5) * 0.005 for x in lent]
        slope = max(0.0, np.polyfit(near[: max(upto, 3)], medians, 1, w=[len(x) ** 0.5 for x in lent])[0]) if len(near) > 1 else 0.0
        shift = slope * (key[1] - np.average(near[:upto], weights=[len(found[key[0], b]) for b in near[:upto]]))
        low, high = ((bins[math.ceil(share * len(bins)) - 1] + 0.5) * 0.005 for share in (0.25, 0.75))
        room = (3.0 if key[0] else 2.5) * max(high - low, 0.04)
        out[key] = math.exp(low - room + min(0, shift)), math.exp(high + room + max(0, shift))
    return out


def test_compression_bands(spark):
    import math

    import zstandard

    pack = zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress
    texts, noise = banded_texts()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, None, 1)], "doc_id long, text string, limits int").repartition(5)
    limits, want = quality_rules.fit_limits(df), plain_limits(texts)
    assert limits.keys() == want.keys() and all(np.allclose(limits[k], want[k]) for k in want)
    got = by_id(quality_rules.quality(df))
    for i, t in enumerate(texts):
        raw = t.encode()
        inside = lambda part, chunk: want[chunk, int(2 * math.log2(len(part)))][0] <= len(part) / len(pack(part)) <= want[chunk, int(2 * math.log2(len(part)))][1]
        parts = [raw[k : k + 2048] for k in range(0, len(raw), 2048)]
        stays = inside(raw, False) and sum(not inside(p, True) for p in parts) <= 0.5 * len(parts)
        assert got[i].kept == (stays and not got[i].base_failed) and got[i].n_chunks == len(parts)
    assert all(not got[i].kept and not got[i].base_failed for i in noise)
    assert sum(got[i].kept for i in range(300)) > 280
    assert {r.doc_id for r in quality_rules.keep_good(df, limits=limits).collect()} == {i for i, r in got.items() if r.kept}


def test_a_repetitive_document_alone_in_its_band(spark):
    """It sets no limits of its own; clean documents alone in theirs stay."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrst"), rng.integers(3, 9))) for _ in range(4000)]
    say = lambda n: " ".join(rng.choice(words, n))
    junk = " ".join(f"{w} {k % 7}" for k, w in enumerate(list(rng.choice(words[:60], 60)) * 400))
    texts = [say(n) for n in rng.integers(60, 400, 400)] + [say(3000), say(9000), junk]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(quality_rules.quality(df, max_repeat=1000))
    assert not got[402].kept and got[402].ratio > got[402].high
    assert got[400].kept and got[401].kept and sum(r.kept for r in got.values()) > 395


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and brute_luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_pii(docs):
    got = by_id(pii.personal_data(docs))
    for i, t in enumerate(TEXTS):
        want = brute_pii(t or "")
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x[1] == k for x in want) for k in range(4))
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_disguises():
    def hidden(text):
        return [(pii.KINDS[k], text[a:b]) for a, b, k in pii.scan(text)[1]]

    assert hidden(TEXTS[23]) == [("email", "jane (at) mail [dot] example [dot] org"), ("email", "jane at mail dot example dot org")]
    assert hidden(TEXTS[24]) == [("phone", "plus one two three four five six seven eight nine zero")]
    assert hidden(TEXTS[25]) == []
    assert hidden(TEXTS[26]) == [("email", "user​@exаmple.com"), ("ip", "１２７.0.0.1")]
    assert hidden("He sat at the table dot one two three") == []
    assert hidden("x one nine two dot one six eight dot zero dot one y") == [("ip", "one nine two dot one six eight dot zero dot one")]
    assert hidden("10 point 0 dot two five five dot 1.") == [("ip", "10 point 0 dot two five five dot 1")]
    assert hidden("nine nine nine dot one dot one dot one") == [] and hidden("three point one four dot") == []  # parts over 255, too few parts
    styled = "".join(chr(0x1D5EE + ord(c) - 97) if c.isalpha() else c for c in "jo@ex.org")  # bold letters
    assert hidden(f"to {styled} now") == [("email", styled)]
    assert hidden("4111 1111 1111 1111") == [] and pii.redact("mail a@b.co now") == "mail <EMAIL> now"


def test_disguises_need_no_unrelated_cue(monkeypatch):
    for text in ("call plus 1 555 010 4477 now", "PLUS 1 555 010 4477", "é plus 15550104477."):
        base, more = pii.scan(text)
        assert base == [] and [k for _, _, k in more] == [3] and pii.scan(text + " one ") == (base, more) and "<PHONE>" in pii.redact(text)
    assert pii.scan("surplus 1 555 010 4477")[1] == []
    rng = np.random.default_rng(8)
    parts = ["plus", "surplus", "1 555 010 4477", "one", "two", "-", ".", " ", "(at)", "at", "dot", "[ dot ]", "<at", "ab", "a@b", "org", "seven eight nine zero one"]
    texts = ["".join(x + " " * rng.integers(0, 2) for x in rng.choice(parts, 9)) for _ in range(5000)]
    found = [pii.scan(t) for t in texts]
    monkeypatch.setattr(pii, "_CUE", re.compile(""))
    assert found == [pii.scan(t) for t in texts]


def test_random_texts_and_long_runs():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        text = "".join(rng.choice(list("0123456789..@+- ()ab%_\n"), rng.integers(1, 60)))
        assert [(a, k, b) for a, b, k in pii.find(text)] == brute_pii(text)
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "(at) " * 50_000, "one " * 50_000, "a at b dot c " * 30_000, " at " * 50_000):
        assert len(pii.scan(text)[0]) <= len(text)
    for n in (64, 70, 5000):
        assert [(k, text_[a:b]) for text_ in (f"to {'n' * n} at {'h' * n} dot {'t' * n} now",) for a, b, k in pii.scan(text_)[1]] == [(0, f"{'n' * n} at {'h' * n} dot {'t' * n}")]


BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*((?:{pii.AT})| at |@)[A-Za-z0-9-]+((?: dot [A-Za-z0-9-]+)+)(?![A-Za-z0-9-])", re.I)


def plain_scan(text):
    """All rewriting on a list of (character, source start, source end), one pattern after another."""
    tape = [(c, i, i + 1) for i, c in enumerate(text)]

    def rewrite(edits):
        nonlocal tape
        for a, b, new in sorted(edits, reverse=True):
            tape[a:b] = [(c, tape[a][1], tape[b - 1][2]) for c in new]

    now = lambda: "".join(c for c, _, _ in tape)
    rewrite([(i, i + 1, pii.GLYPHS[ord(c)]) for i, c in enumerate(text) if ord(c) in pii.GLYPHS])
    rewrite([e for m in BARE.finditer(now()) for e in ((m.start(1), m.end(1), "@"), *((m.start(2) + d.start(), m.start(2) + d.end(), ".") for d in re.finditer(" dot ", m[2], re.I)))])
    for pattern, new in ((pii.BRACKET_DOT, "."), (pii.BRACKET_AT, "@"), (pii.SPELLED_PLUS, "+")):
        rewrite([(m.start(), m.end(), new) for m in pattern.finditer(now())])
    rewrite([(m.start(), m.end(), "".join(pii.DIGITS[x] for x in re.split("[ .-]", m[0].lower()))) for m in pii.SPELLED.finditer(now())])
    base = brute_pii(text)
    more = {(tape[a][1], k, tape[b - 1][2]) for a, k, b in brute_pii(now())}
    return base, sorted(x for x in more if not any(k == x[1] and a < x[2] and x[0] < b for a, k, b in base))


def test_generated_disguises():
    """Every kind of disguise in every kind of data, and mixtures of them, as a plain version finds them."""
    rng = np.random.default_rng(12)
    looks = {b: [chr(a) for a, x in pii.GLYPHS.items() if x == b] for b in set(pii.GLYPHS.values()) if b}
    spell = {v: k for k, v in pii.DIGITS.items()}
    at, dot = ["@", " at ", "(at)", " [AT] ", "{ at }"], [".", " dot ", "(dot)", " [ Dot ] "]

    def glyphs(x):
        x = "".join(rng.choice(looks[c]) if c in looks and rng.random() < 0.3 else c for c in x)
        return "".join(c + "\u200b" * (rng.random() < 0.05) for c in x)

    def digits(n):
        d = [str(x) for x in rng.integers(0, 10, n)]
        return " ".join(spell[x] for x in d) if rng.random() < 0.5 else glyphs("".join(d))

    def one():
        kind = rng.integers(0, 5)
        if kind == 0:
            return glyphs("jane.d") + rng.choice(at) + glyphs("mail") + "".join(rng.choice(dot) + x for x in rng.choice(["example", "org", "co"], 2))
        if kind == 1:
            return glyphs(".".join(str(x) for x in rng.integers(0, 270, 4)))
        if kind == 2:
            return glyphs("4111 1111 1111 1111") if rng.random() < 0.5 else digits(16)
        if kind == 3:
            return rng.choice(["+", "plus "]) + digits(11)
        return str(rng.choice(["at noon", "dot", "one two", "(at)", "plus 5", "\u00ad", "сор", "x@y.zz", "10.0.0.1"]))

    added = Counter()
    for _ in range(4000):
        text = str(rng.choice(["", "see "])) + str(rng.choice([" ", ", ", "; and "])).join(one() for _ in range(rng.integers(1, 5)))
        base, more = pii.scan(text)
        want = plain_scan(text)
        assert [(a, k, b) for a, b, k in base] == want[0] and sorted((a, k, b) for a, b, k in more) == want[1], text
        added.update(k for _, _, k in more)
    assert all(added[k] > 100 for k in (0, 1, 2, 3)), added


def test_offsets_survive_rewriting():
    rng = np.random.default_rng(3)
    parts = ["x@y.zz", "jane (at) a [dot] b", "о", "​", "word", "one two three four five six", " ", "１", "+1 555 010 9999", "é"]
    for _ in range(200):
        text = " ".join(rng.choice(parts, 12))
        base, more = pii.scan(text)
        assert base == pii.find(text)
        for a, b, _k in more:
            assert 0 <= a < b <= len(text) and text[a:b].strip() == text[a:b]


def test_redacted(docs):
    out = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert out[0] is None and out[4] == "one" and "<EMAIL>" in out[21] and "4111 1111 1111 1111" not in out[21]


def test_packing(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(docs, group_pieces=8, with_ids=True).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(r.doc_id for r in docs.collect())
    found = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 13:
            found.setdefault(r.doc_id, []).append(r)
    for i, own in found.items():
        own.sort(key=lambda r: r.start)
        ids = whole.encode(TEXTS[i] or "", add_special_tokens=False).ids + [2]
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4")] == ids and all(r.doc_tokens == len(ids) and 4 * r.length == len(r.ids) for r in own)
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in own)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_words_in_batches_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    texts = [
        "abc İstanbul def", "abc \ufb2a def", "one İ. two\ufb2a, three", "x <|ENDOFTEXT|> y <|endoftext|> Z<|EndOfText|>.", "J\u030cX H\u0331 T\u0323\u0308 y", "\u0958क ab क़ cd",
        "plain  words, only.", "ΑΣ. ΌΣΟΣ ǅ, ﬁ ß ẞ K Å 각 \u1100\u1161", "\U0001e900\U0001df00. \U00031350, a\u1c89b.",
    ]
    for text in texts:
        for encode in (packing.WordEncoder(packing.default_tokenizer()), packing.WordEncoder(packing.default_tokenizer(), cache_words=3)):
            for t in (text, "  " + text):
                assert np.frombuffer(encode([t])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    encode = packing.WordEncoder(packing.default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_letter_keeps_its_neighbours_ids():
    import sys

    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(packing.default_tokenizer()), packing.WordEncoder(packing.default_tokenizer())
    letters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and not 0x3400 <= c < 0xD7A4 and not 0x17000 <= c < 0x18D00 and c < 0x20000]
    texts = ["so " + " ".join(f"{c}xy a{c}, b{c}" for c in letters[k : k + 9]) + " was warm today." for k in range(0, len(letters), 9)]
    rng = np.random.default_rng(0)
    texts += ["".join(chr(int(x)) if y < 0.8 else " " for x, y in zip(np.where(rng.random(40) < 0.5, rng.integers(32, 0x600, 40), rng.integers(0xE000, 0x1F000, 40)), rng.random(40), strict=True)) for _ in range(2000)]
    got = encode(texts)
    assert [t for t, g in zip(texts, got, strict=True) if np.frombuffer(g, "<u4").tolist() != whole.encode(t, add_special_tokens=False).ids] == []


def test_first_fit():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 500):
        sizes = rng.integers(1, 4097, n)
        where, offset = packing.first_fit_decreasing(sizes, 4096)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, x in enumerate(room) if x >= sizes[i]), len(room))
            if k == len(room):
                room.append(4096)
            want[i] = (k, 4096 - room[k])
            room[k] -= sizes[i]
        assert [(where[i], offset[i]) for i in range(n)] == [want[i] for i in range(n)]


def test_packing_very_long_texts(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(4)
    texts = [" ".join(f"word{i}" for i in rng.integers(0, 900, 90_000)), "x" * 200_000, "one\n" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole, found = Tokenizer.from_file(packing.default_tokenizer()), {}
    for r in packing.pack_documents(df).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, t in enumerate(texts):
        ids = whole.encode(t, add_special_tokens=False).ids + [2]
        assert sorted(found[i]) == [(a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 4096)]
