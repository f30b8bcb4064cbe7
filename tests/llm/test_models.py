"""SentencePiece coding against the library; toxicity and quality on held-out rows."""

import random
import re

import numpy as np
import pytest

from ratewell.llm import pieces, site_quality, toxicity
from ratewell.llm.linear import Rows, fit, sigmoid
from ratewell.llm.text import Words, sliding_argmin

TEXTS = [
    None, "", " ", "   ", "a", "a  b ", "\n\nx y\t", "Hello world's best: naïve café, 東京 \U0001f600 re­re", "ouch çréoi êment ouréaux", "x" * 3000, "ab " * 2000, "a▁b",
    "The quick brown fox, jumped over 12345.678 (lazy) dogs!!", "'s don't … “quoted” —", "é‍﻿", "aaaa aaaaa aaaaaaaaaaa",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 2), (4, "a", 3)], "doc_id long, text string, ids int").repartition(3).cache()


def test_encoding_is_the_librarys(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r.doc_id: r.ids for r in pieces.encode(docs).collect() if r.doc_id is not None}
    assert got[0] is None
    for i, t in enumerate(TEXTS[1:], 1):
        if "▁" not in t:
            assert got[i] == model.encode(t), t


def test_round_trip(docs):
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect() if r.doc_id is not None}
    assert [back[i] for i in range(len(TEXTS))] == TEXTS
    digest = pieces.coding_digest(docs).collect()
    assert all(r.round_trip for r in digest) and len(digest) == len(TEXTS) + 2
    assert pieces.coding_digest(docs.limit(0)).count() == 0


def test_random_words():
    import sentencepiece

    rng, coder = random.Random(3), pieces.pieces_of(pieces.default_model())
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = ["".join(rng.choice("etaoinshrdlu THE,.\n01é中") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [model.encode(t) for t in texts]


def test_viterbi_maximises_scores():
    """With scores in place of merges, against plain dynamic programming."""
    coder = pieces.Pieces(pieces.default_model())
    coder.merges = False
    score = {coder.spelled[i].decode(): (s, i) for i, s in zip(coder.ids, coder.scores, strict=True)}
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("thesandwich") for _ in range(rng.randint(1, 14)))
        word, best = " " + text, {0: (0.0, [])}
        for e in range(1, len(word) + 1):
            best[e] = max(((best[s][0] + score[word[s:e]][0], best[s][1] + [score[word[s:e]][1]]) for s in range(e) if s in best and word[s:e] in score), key=lambda x: x[0])
        assert sum(coder.scores[list(coder.ids).index(i)] for i in np.frombuffer(coder.encode([text])[0], "<u4")) == pytest.approx(best[len(word)][0])


def test_fit_finds_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (sigmoid(x @ [2.0, -1.0, 0.0] + 0.5) > rng.random(300)).astype(int)
    rows = Rows(np.zeros(0, int), np.zeros(0, int), 300, 0, x)
    w = fit(rows, y, 1.0)
    gradient = rows.back(sigmoid(rows.dot(w)) - y) + np.append(w[:3], 0)
    assert np.abs(gradient).max() < 0.05 and w[0] > 1 and w[1] < -0.5


def corpus(spark, n=700):
    rng = random.Random(9)
    words, bad = [f"{a}{b}" for a in "bcdfgklm" for b in ("an", "et", "or", "ush", "ile", "ost")], ["vile", "scum", "idiot", "trash"]
    docs, labels = [], []
    for i in range(n):
        toxic, junk = i % 6 == 0, i % 5 == 0
        w = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        if toxic:
            for b in rng.sample(bad, 3):
                w.insert(rng.randrange(len(w)), b.upper() + "!")
        if junk:
            w = [x + "###" for x in w]
        docs.append((i, " ".join(w), f"host{i % 3}" if i % 7 else None, "en"))
        labels.append((i, int(not junk), int(toxic), None))
    docs += [(None, None, None, None), (n, "", "lonely", None)]
    labels += [(None, 1, 1, None), (0, 1, 1, "again"), (99999, 0, 1, None), (n, None, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_toxicity(spark):
    docs, labels = corpus(spark)
    chain = toxicity.train(docs, labels.filter("doc_id % 4 > 0"), toxicity.CATEGORIES)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    held = [i for i in range(700) if i % 4 == 0]
    assert len(got) == 702 and sum(got[i].toxic == (i % 6 == 0) for i in held) >= 0.98 * len(held)
    assert chain.out_of_fold.shape[1] == 3 and not got[700].toxic and not got[None].toxic
    assert toxicity.toxic(docs.limit(0), labels).count() == 0
    assert toxicity.toxic(docs, labels.limit(0)).filter("toxic").count() == 0


def test_site_quality(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in site_quality.posterior_quality(docs, labels.filter("doc_id % 4 > 0")).collect()}
    held = [i for i in range(700) if i % 4 == 0]
    assert len(got) == 702 and sum(got[i].kept == (i % 5 > 0) for i in held) >= 0.98 * len(held)
    assert all(0 < got[i].p_path < 1 for i in got)
    assert site_quality.posterior_quality(docs.limit(0), labels).count() == 0
    assert site_quality.posterior_quality(docs, labels.limit(0)).count() == 702


def test_sparse_sites_shrink(spark):
    """A site with one document stays near the mean of all, a site with many goes its own way."""
    rows = [(i, "clean words here " + str(i), "big", "en") for i in range(300)] + [(1000, "### &&& ###", "small", "en")] + [(2000 + i, "### &&& $$$ " + str(i), "junk", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], int("clean" in r[1])) for r in rows if r[0] % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in site_quality.posterior_quality(docs, labels).collect()}
    assert got[0].p_host > 0.8 and got[2000].p_host < 0.2 and abs(got[1000].p_host - 0.5) < abs(got[2000].p_host - 0.5)


def test_pairs_of_pieces_get_on_as_full_merges_say():
    coder = pieces.pieces_of(pieces.default_model())
    rng, ids = np.random.default_rng(0), np.array(list(coder.letters))
    for a, b in ((rng.choice(ids, 20_000), rng.choice(ids, 20_000)), np.divmod(rng.choice(coder.pair_keys, 20_000), coder.size)):
        assert (coder.ask(a, b) == coder.ask_in_full(a, b)).all()


def test_runs_of_spaces_and_very_long_texts():
    import sentencepiece

    model, coder = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), pieces.pieces_of(pieces.default_model())
    texts = [" " * a + "a" + " " * b + "the" for a in range(0, 40, 3) for b in range(40)] + ["lorem ipsum 42 " * 20_000, "y" * 40_000, ("ab" * 700 + " ") * 40, " " * 5000, "\U0001f600" * 20_000]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [model.encode(t) for t in texts]
    assert all(coder.decode(x) == t for t, x in zip(texts, coder.encode(texts), strict=True))


def test_chain_scores_like_plain_python(spark):
    """Link after link, word by word, from the fitted weights; and each link's weights are an optimum of its own loss."""
    import math

    docs, labels = corpus(spark, 300)
    docs = docs.union(spark.createDataFrame([(1000, "vile idiot " * 60_000, None, None), (5, "VILE scum", None, None), (5, "VILE scum", None, None)], docs.schema))
    chain = toxicity.train(docs, labels, toxicity.CATEGORIES)
    place = {int(h): k for k, h in enumerate(chain.vocabulary)}
    sigma = lambda z: 1 / (1 + math.exp(-max(-35, min(35, z))))
    got = toxicity.score(docs, chain).collect()
    rows = docs.collect()
    assert len(got) == len(rows)

    def plain(text):
        words = {w for w in re.split("[^a-z]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w}
        known = [place[h] for h in (int(Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hash[0]) for w in words) if h in place]
        p = []
        for w in chain.weights:
            z = w[-1] + sum(w[k] for k in known) + sum(w[len(place) + j] * math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6))) for j, x in enumerate(p))
            p.append(sigma(z))
        return p

    want = sorted((str(r.doc_id), [round(x, 9) for x in plain(r.text)]) for r in rows)
    assert sorted((str(r.doc_id), [round(r[f"p_{c}"], 9) for c in chain.names]) for r in got) == want
    assert all(r[c] == (r[f"p_{c}"] > cut) for r in got for c, cut in zip(chain.names, chain.thresholds, strict=True))


def test_site_posteriors_like_plain_python(spark):
    import math
    from collections import defaultdict

    docs, labels = corpus(spark, 240)
    docs = docs.union(spark.createDataFrame([(1000, "plain words " * 50_000, "host1", "de"), (7, "again", "host1", "en"), (7, "again", "host1", "en"), (8, "only one", "single", None)], docs.schema))
    model = site_quality.document_model(docs, labels, "doc_id", "text", "quality = 1", site_quality.TRAIN_ROWS)
    scored = site_quality.evidence(docs, model, "doc_id", "text", "source", "lang").collect()
    paths, hosts = defaultdict(list), defaultdict(list)
    for r in scored:
        paths[r.host, r.path].append(r.p)
        hosts[r.host].append(r.p)
    mean = sum(r.p for r in scored) / len(scored)

    def strength(groups):
        n, inside = sum(len(x) for x, _ in groups), sum(sum(v * v for v in x) - sum(x) ** 2 / len(x) for x, _ in groups)
        between = n - sum(len(x) ** 2 for x, _ in groups) / n
        spread = sum(len(x) * (sum(x) / len(x) - around) ** 2 for x, around in groups)
        if len(groups) < 2 or n <= len(groups) or not between:
            return 50.0
        inside = max(inside / (n - len(groups)), 1e-9)
        return min(max(inside / max((spread - (len(groups) - 1) * inside) / between, inside / 1000), 1.0), 1000.0)

    k = strength([(x, mean) for x in hosts.values()])
    j = strength([(x, sum(hosts[h]) / len(hosts[h])) for (h, _), x in paths.items()])
    logit = lambda x: math.log(x / (1 - x))
    want = []
    for r in scored:
        host = (sum(hosts[r.host]) - r.p + k * mean) / (len(hosts[r.host]) - 1 + k)
        path = (sum(paths[r.host, r.path]) - r.p + j * host) / (len(paths[r.host, r.path]) - 1 + j)
        want.append((str(r.doc_id), r.p, host, path, sigmoid(logit(r.p) + logit(path) - logit(mean))))
    got = sorted((str(r.doc_id), r.p_document, r.p_host, r.p_path, r.p_quality) for r in site_quality.posterior_quality(docs, labels).collect())
    assert len(got) == len(want) == docs.count()
    for a, b in zip(got, sorted(want), strict=True):
        assert a[0] == b[0] and np.allclose(a[1:], b[1:])


def test_minima_of_arrays_longer_than_positions(monkeypatch):
    from ratewell.llm import text

    values = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    want = sliding_argmin(values, 37)
    assert want.tolist() == [i + int(np.argmin(values[i : i + 37] >> np.uint64(27))) for i in range(5000 - 36)]
    monkeypatch.setattr(text, "_PLACE", 8)
    values &= ~np.uint64((1 << 27) - 1)
    assert (text.sliding_argmin(values, 37) == want).all()
