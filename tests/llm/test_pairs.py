"""Operators that compare documents with each other, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.llm import near_dedup, substring_dedup, suffix_dedup
from ratewell.llm.components import components

SCHEMA = "doc_id long, text string, core string, low int"


def rows():
    rng = random.Random(4)
    words = ["w" + str(i) for i in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line, out = say(60), say(14), [None, "", "  \n ", "one", "One two", "one TWO", "x " * 3000, "q" * 1200, "ab" * 700]
    for _ in range(25):
        out.append(say(rng.randint(5, 150)))
    for _ in range(10):
        out.append(say(rng.randint(1, 40)) + " " + passage + " " + say(rng.randint(1, 40)))
        out.append(say(20) + "\n" + line + "\n" + say(20))
    base = say(200).split()
    for k in range(20):  # a family whose members link through some others only
        edit = list(base)
        for _ in range(k):
            edit[rng.randrange(200)] = rng.choice(words)
        out.append(" ".join(edit))
    out += [out[12], out[12], out[12].upper(), out[40], passage, line, say(13), "é" * 500 + "x" * 399, "é" * 500 + "y" + "x" * 399]
    numbered = [(i, t, "c", i) for i, t in enumerate(out)]
    rng.shuffle(numbered)
    return [*numbered, (None, out[12], None, None), (None, passage, None, None), (70, out[41], "d", 1), (70, "other text of the same id", "d", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


def test_near(docs):
    sets, ids = {}, {}
    for i, t, *_ in rows():
        w = (t or "").encode().lower().split()
        s = frozenset(zip(w, w[1:], w[2:], w[3:], strict=False)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
        ids.setdefault((i, s), None)
        if s and i is not None:
            sets.setdefault(s, set()).add(i)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    every = list(sets)
    for own in sets.values():
        for i in own:
            parent[find(i)] = find(min(own))
    for k, a in enumerate(every):
        for b in every[:k]:
            if 100 * len(a & b) >= 80 * len(a | b):
                parent[find(min(sets[a]))] = find(min(sets[b]))
    low = {}
    for own in sets.values():
        for i in own:
            low[find(i)] = min(low.get(find(i), i), i)
    got = near_dedup.near_groups(docs, shingle=4).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == (low[find(r.doc_id)] if r.doc_id in parent else r.doc_id) and r.kept == (r.doc_id == r.component_id)
    assert {(r.doc_id, r.n_shingles) for r in got} == {(i, len(s)) for i, s in ids}
    assert len({r.component_id for r in got}) < len(got) - 8
    kept = near_dedup.drop_near(docs, shingle=4)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_blocks_find_the_same(docs, monkeypatch):
    want = {(r.doc_id, r.component_id) for r in near_dedup.near_groups(docs, shingle=4).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_groups(docs, shingle=4).collect()} == want


def test_sketch_estimates():
    rng = np.random.default_rng(2)
    for share in (0.95, 0.8, 0.5):
        n = 400
        common = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), np.uint64)
        a, b = (np.sort(np.concatenate([common, rng.integers(0, 2**63, n - len(common), np.uint64)])) for _ in range(2))
        true = len(common) / (2 * n - len(common))
        sketch = near_dedup.odd_sketches(np.concatenate([a, b]), np.array([0, n]))
        assert abs(near_dedup.estimate(np.bitwise_count(sketch[0] ^ sketch[1]).sum()) - true) < 0.06


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(5000, 5000), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[find(a)] = find(b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got.keys() == parent.keys()
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(find(node))
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len({find(x) for x in parent})


def brute_bytes(length):
    raws = [(i, (t or "").encode()) for i, t, *_ in rows()]
    seen = {}
    for _, b in raws:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "most"), [(400, 5000), (40, 5000), (40, 3), (40, 1), (40, 12)])
def test_repeated_bytes(docs, length, most):
    got = suffix_dedup.repeated_bytes(docs, length=length, most_strings=most)
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: str(r[:5]))
    assert [r[:5] for r in got] == brute_bytes(length)
    assert sorted(((r[0], r[5], r[6]) for r in got), key=str) == sorted(((i, gone, spans) for i, _, gone, spans, _ in brute_bytes(length * 5 // 8)), key=str)


def test_very_long_and_periodic_bytes(spark):
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    part, text = say(450), say(150_000)
    texts = [text, text[70_000:] + say(50), "z" * 5000, "z" * 399, "z" * 400, "xy" * 3000, part + say(3000), say(2000) + part, part[:399] + "!" + say(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    seen = {}
    for t in texts:
        for k in range(len(t) - 399):
            seen[hash(t[k : k + 400])] = seen.get(hash(t[k : k + 400]), 0) + 1
    got = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_bytes(df).collect()}
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                gone[k : k + 400] = b"\1" * 400
        assert got[i] == sum(gone), i


def test_bytes_kept(docs):
    r = suffix_dedup.repeated_bytes(docs, with_text=True).filter("n_removed = 0 and n_bytes > 0").first()
    assert hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 and len(r.kept_bytes) == r.n_bytes
    assert suffix_dedup.repeated_bytes(docs.limit(0)).count() == 0


def test_columns_of_the_transform():
    """Longest common prefixes, and the transform's symbols in the order of suffixes, after each column."""
    rng = np.random.default_rng(0)
    for _ in range(20):
        n, width = 12, 9
        matrix = rng.integers(0, 3, (n, width)).astype(np.uint16)
        bucket = np.sort(rng.integers(0, 3, n))
        transform = np.zeros((width, n), np.uint16)
        longest = suffix_dedup.insert_columns(matrix, bucket, width, transform)
        for c in range(width):
            for i in range(n):
                common = [next((k for k in range(width - c) if matrix[i, c + k] != matrix[j, c + k] or matrix[i, c + k] == 0), width - c) for j in range(n) if j != i and bucket[j] == bucket[i]]
                assert longest[i, c] == max(common, default=0)
            rows = sorted(range(n), key=lambda i: (bucket[i], *matrix[i, c:]))
            assert [(matrix[i, c - 1] if c else 0) for i in rows] == transform[c].tolist() or len({(bucket[i], *matrix[i, c:]) for i in rows}) < n


def brute_words(k):
    last, low, out = 2**63 - 1, {}, []
    for i, t, *_ in rows():
        w = (t or "").encode().split()
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            low[key] = min(low.get(key, last), last if i is None else i)
    for i, t, *_ in rows():
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for s in range(len(w) - k + 1):
            if low[tuple(w[s : s + k])] < (last if i is None else i):
                gone[s : s + k] = b"\1" * k
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_spans(docs):
    assert sorted(map(tuple, substring_dedup.repeated_spans(docs).collect()), key=str) == brute_words(13)
    assert substring_dedup.repeated_spans(docs.limit(0)).count() == 0


def test_spans_kept(docs):
    r = substring_dedup.repeated_spans(docs, with_text=True).filter(F.col("n_removed").between(1, 60)).first()
    assert len(r.kept_text.split()) == r.n_words - r.n_removed


def test_very_long_texts(spark):
    """Texts of some 700 kB: near copies, a long shared stretch, and one word over and over."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(20_000)]
    base = [rng.choice(words) for _ in range(120_000)]
    near, far = list(base), list(base)
    for k in rng.sample(range(120_000), 3_000):
        near[k] = "near"
    for k in rng.sample(range(120_000), 12_000):
        far[k] = "far"
    texts = [" ".join(base), " ".join(near), " ".join(far), " ".join([rng.choice(words) for _ in range(50_000)] + base[40_000:90_000]), "same " * 150_000, "same " * 140_000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, key int").repartition(3)
    sets = [set(zip(*(t.split()[k:] for k in range(4)), strict=False)) for t in texts]
    links = [(a, b) for b in range(6) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links == [(0, 1), (4, 5)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(df, shingle=4).collect()}
    assert got == {i: (len(s), {1: 0, 5: 4}.get(i, i)) for i, s in enumerate(sets)}
    low, want = {}, {}
    for i, t in enumerate(texts):
        w = t.split()
        gone = bytearray(len(w))
        for s in range(len(w) - 12):
            if low.setdefault(hash(tuple(w[s : s + 13])), i) < i:
                gone[s : s + 13] = b"\1" * 13
        want[i] = (len(w), sum(gone))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.repeated_spans(df).collect()} == want


def test_buckets_of_near_copies_that_drift(spark, monkeypatch):
    """Chains of copies, each near the next alone: most of a bucket isn't linked through its hub."""
    rng = random.Random(21)
    words, rows_ = [f"w{i}" for i in range(5000)], []
    for chain in range(3):
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(40):
            for k in rng.sample(range(120), 3):
                text[k] = rng.choice(words)
            rows_.append(" ".join(text))
    sets = [set(zip(*(t.split()[k:] for k in range(4)), strict=False)) for t in rows_]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    df = spark.createDataFrame(list(enumerate(rows_)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(df, shingle=4).collect()}
    assert got == {i: find(i) for i in range(len(sets))} and 3 <= len(set(got.values())) < 60


@pytest.mark.parametrize("own", [(24, 24), (10, 34)])
def test_documents_of_one_template(spark, monkeypatch, own):
    """Texts that share most of their words without being linked don't go to full sets; of lengths that lead to similarities
    on both sides of the threshold, pairs within the margin of the estimate do."""
    sent, checked = [], near_dedup.verified

    def counted(pairs, profile, percent, sketched=False):
        if sketched:
            pairs = near_dedup.stored(pairs)
            sent.append(pairs.count())
        return checked(pairs, profile, percent, sketched)

    monkeypatch.setattr(near_dedup, "verified", counted)
    for n in (200,):
        rng = random.Random(8)
        template = [f"w{rng.randrange(10**6)}" for _ in range(165)]
        texts = []
        for i in range(n):
            new = [f"o{i}_{j}" for j in range(rng.randint(*own))]
            at = rng.randint(0, 165)
            texts.append(template[:at] + new + template[at:])
        sets = [set(zip(*(t[k:] for k in range(4)), strict=False)) for t in texts]
        root = list(range(n))
        for b in range(n):
            for a in range(b):
                if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root = [low if r == high else r for r in root]
        sent.clear()
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in near_dedup.near_groups(df, shingle=4).collect()} == dict(enumerate(root))
        assert sum(sent) <= (0 if own[0] == own[1] else 0.05 * n * (n - 1) / 2)
