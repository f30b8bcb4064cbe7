"""The pipeline, stage by stage, against the operators' own brute-force rules; and that each stage keeps the columns."""

import numpy as np
import pytest

import corpus_pipeline
from ratewell.llm import packing, pii, quality_rules

PROSE = "Some words that differ in every line so that nothing repeats itself here: {} "


def texts():
    import random

    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("n", "rt", "st", "lk", "sh")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_ = [say(150) for _ in range(12)]
    near = long_[0].split()
    near[75] = "changed"
    return [*long_, long_[1], long_[1].upper(), " ".join(near), "too short", None, "", "again and again " * 80, say(120) + " write to jo@ex.example.com or 10.0.0.1", say(9000)]


def test_stages(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts())], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    out, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "unused")
        if name != "packing":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
            seen.append({r.doc_id: r.text for r in out.collect()})
    good, exact, near, private = seen
    limits = quality_rules.fit_limits(docs)
    assert set(good) == {i for i, t in enumerate(texts()) if quality_rules.verdicts([t], limits)[0]} == {*range(15), 19, 20}
    assert set(exact) == set(good) - {1, 12}
    assert set(near) == set(exact) - {14}
    assert private == {i: pii.redact(t) for i, t in near.items()} and "<EMAIL>" in private[19] and "<IP>" in private[19]
    rows = out.collect()
    encode = packing.WordEncoder(packing.default_tokenizer())
    want = {i: len(encode([t])[0]) // 4 + 1 for i, t in private.items()}
    got, ids = {}, {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.length
        ids.setdefault(r.doc_id, {})[r.start] = own
    assert got == want
    joined = {i: [x for _, part in sorted(parts.items()) for x in part] for i, parts in ids.items()}
    assert joined == {i: [*np.frombuffer(encode([t])[0], "<u4").tolist(), 2] for i, t in private.items()}


def test_run(spark, tmp_path):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {*range(14), 19, 20} - {1, 12}


ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b c` string, `Ünder``tick` int, _hash string"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None, None)] * 2, [(3, texts()[4], "en", "s", 9, "x", 1, "h")] * 3 + [(None, texts()[5], None, None, None, None, None, None)] * 2 + [(4, texts()[4], "en", "s", 9, "y", 2, "h"), (5, None, "en", "s", 0, "x", 1, "h"), (4, texts()[6], "en", "t", 9, "x", 1, None)]])
def test_odd_tables_go_through_all_stages(spark, rows):
    docs = out = spark.createDataFrame(rows, ODD).repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "unused")
        if name != "packing":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
    found = sorted((r.doc_id or 0, r.start, r.length) for r in out.collect())
    texts_ = {0: texts()[5], 4: texts()[4]}
    encode = packing.WordEncoder(packing.default_tokenizer())
    want = [(i, 0, len(encode([t])[0]) // 4 + 1) for i, t in sorted({**texts_, 4.5: texts()[6]}.items())] if len(rows) > 2 else []
    assert found == sorted((int(i), a, n) for i, a, n in want)
