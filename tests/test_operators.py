"""Operators on small frames with answers worked out by hand or with numpy."""

import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ratewell import fixed_values as fixed
from ratewell.functions import scalar
from ratewell.operators import adapter, agreement, bootstrap, casestudy, checks, exam, inference, outcomes, prompts, ratings_stats, splits
from ratewell.sources import readers, schemas, sinks
from ratewell.streaming import ratings as stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import the models defined here


def rating_rows(spark, per_source, tag="t"):
    rows = [(f"c{i}", s, "r", tag, "p", v) for s, vs in per_source.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "case_study_id string, conversation_source string, rater string, tag string, principle string, rating int")


def pairs_of(spark, a, b):
    return spark.createDataFrame([("x", "y", i, p, q) for i, (p, q) in enumerate(zip(a, b, strict=True))], "rater_a string, rater_b string, item int, va int, vb int")


def test_rank_sum(spark):
    got = {(r.a, r.b): r for r in ratings_stats.significance(rating_rows(spark, {"x": [1, 2, 3], "y": [2, 4, 5]})).collect()}
    r, back = got["x", "y"], got["y", "x"]
    assert (r.n, round(r.statistic, 6), round(r.p, 6), round(r.effect, 6)) == (6, -1.309307, 0.19043, -0.534522)
    assert back.statistic == -r.statistic and back.p == r.p and not r.significant


def test_rank_sum_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 6, 40), rng.integers(2, 6, 55)
    both = np.concatenate([a, b])
    rank = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in a])
    z = (rank.sum() - 40 * 96 / 2) / math.sqrt(40 * 55 * 96 / 12)
    r = ratings_stats.rank_sums(rating_rows(spark, {"a": a.tolist(), "b": b.tolist()})).filter("a = 'a'").first()
    assert r.statistic == pytest.approx(z) and r.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-12)


def test_fdr(spark):
    df = spark.createDataFrame([("a", "b", str(i), p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, 0.2])] + [("a", "b", "n", None)], "a string, b string, g string, p double")
    q = {r.g: r.q for r in ratings_stats.fdr(df).collect()}
    assert [round(q[str(i)], 9) for i in range(5)] == [0.025, 0.05, 0.05, 0.025, 0.2]


def test_erfc(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.0, 5.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scalar.erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], abs=1e-14)
    assert spark.range(1).select(scalar.two_sided_p(F.lit(32.0))).first()[0] == 0


def test_best_and_stars(spark):
    df = rating_rows(spark, {"x": [5] * 30, "y": [5] * 29 + [4], "z": [1] * 30})
    assert ratings_stats.best_source(df).first().conversation_source == "x"
    assert {(r.source, r.is_best) for r in ratings_stats.star_sources(df).collect()} == {("x", True), ("y", False)}
    assert ratings_stats.rank_sums(df.limit(0)).count() == 0


@pytest.mark.parametrize(("a", "b", "pa", "pe", "want"), [([1, 2, 3, 4, 5], [1, 2, 3, 4, 4], 0.9875, 0.73125, 0.953488), ([5, 5, 4, 3], [5, 4, 4, 1], 0.921875, 0.666016, 0.766082)])
def test_ac2(spark, a, b, pa, pe, want):
    r = agreement.ac2(pairs_of(spark, a, b)).first()
    assert (round(r.pa, 6), round(r.pe, 6), round(r.ac2, 6), r.n) == (pa, pe, want, len(a))
    assert bootstrap.ac2_metric(np.array(a), np.array(b)) == pytest.approx(r.ac2)
    assert agreement.ac2(pairs_of(spark, b, a)).first().ac2 == pytest.approx(r.ac2)


def test_ac2_one_category(spark):
    r = agreement.ac2(pairs_of(spark, [3, 3], [3, 3])).first()
    assert r.pa == 1 and r.pe is None and r.ac2 is None


def test_contingency(spark):
    got = {(r.va, r.vb): (r.n, r.share) for r in agreement.contingency(pairs_of(spark, [1, 1, 5, 9], [1, 2, 5, 1])).collect()}
    assert len(got) == 25 and got[1, 1] == (1, pytest.approx(1 / 3)) and got[3, 3] == (0, 0.0)


def test_strict_pivot(spark):
    df = rating_rows(spark, {"x": [1, 2]})
    assert agreement.pivot_strict(df, ["r"]).count() == 2
    with pytest.raises(Exception, match="two ratings"):
        agreement.pivot_strict(df.union(df), ["r"]).collect()
    assert agreement.pivot_means(df.union(df.withColumn("rating", F.lit(5))), ["r"]).filter("case_study_id = 'c0'").first()["r"] == 3.0


def test_bootstrap_draws():
    assert [x.tolist() for x in bootstrap.sample_indices(np.zeros(5), 2)] == [[0, 3, 3, 2, 2], [4, 0, 3, 1, 0]]
    y = np.array([0, 0, 0, 1])
    assert all(len(set(y[d])) == 2 for d in bootstrap.sample_indices(y, 50, both_classes=True))
    with pytest.raises(checks.ConstraintError):
        bootstrap.sample_indices(np.zeros(4), 1, both_classes=True)


def test_summary(spark):
    mean, sd, n, level, low, high = bootstrap.summary(np.array([1.0, 2, 4, 8]))
    assert (mean, round(sd, 6), n, level, round(low, 6), round(high, 6)) == (3.75, 2.680951, 4, 95.0, 1.075, 7.7)
    r = bootstrap.intervals(spark.createDataFrame([(1, x) for x in (1.0, 2.0, 4.0, 8.0)], "k int, x double"), ["k"], "x").first()
    assert (r.mean, round(r.stddev, 6), r.num_samples, round(r.ci_lower, 6), round(r.ci_upper, 6)) == (3.75, 2.680951, 4, 1.075, 7.7)


def test_exact_bootstrap(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(1, 6, 60), rng.integers(1, 6, 60)
    r = {x.metric_name: x for x in bootstrap.exact_bootstrap(pairs_of(spark, a.tolist(), b.tolist()).repartition(3), ["rater_a", "rater_b"], "item", "va", ["vb"], [bootstrap.AC2, bootstrap.COUNT], n=50).collect()}
    want = bootstrap.summary(np.array([bootstrap.ac2_metric(a[d], b[d]) for d in bootstrap.sample_indices(a, 50)]))
    assert r["gwet_ac2"].mean == pytest.approx(want[0]) and r["gwet_ac2"].ci_upper == pytest.approx(want[5]) and r["sample_count"].stddev == 0
    assert checks.interval_rows(spark.createDataFrame(list(r.values()))).count() == 0
    one = bootstrap.exact_bootstrap(pairs_of(spark, [1, 2], [1, 2]), ["rater_a"], "item", "va", ["vb"], [bootstrap.COUNT], n=0).first()
    assert (one.num_samples, one.mean, one.ci_lower) == (1, 2.0, 2.0)
    with pytest.raises(checks.ConstraintError):
        bootstrap.check_metrics([bootstrap.AC2, bootstrap.AC2])


def test_weighted_bootstrap_is_unbiased(spark):
    r = bootstrap.weighted_bootstrap(spark.range(3000).select(F.lit(1).alias("k"), "id", (F.col("id") % 2).alias("v")), ["k"], "id", "v", n=60).first()
    assert abs(r.mean - 0.5) < 0.01 and 0.004 < r.stddev < 0.018 and r.num_samples == 60


def test_splits(spark):
    df = spark.createDataFrame([(i, r) for i in range(1, 11) for r in ("a", "b")] + [(i, "c") for i in range(20, 25)], "case_study_id int, rater string")
    exact = splits.numpy_split(df.filter("rater <> 'c'"))
    assert {r.case_study_id for r in exact.filter("split = 'validation'").collect()} == {2, 9}
    hashed = splits.stratified_split(df)
    checks.enforce(checks.splits_partition(hashed.select("case_study_id", "split"), df))
    assert {(",".join(r.raters), r.split): r["count"] for r in hashed.groupBy("raters", "split").count().collect()} == {("a,b", "train"): 8, ("a,b", "validation"): 2, ("c", "train"): 4, ("c", "validation"): 1}
    assert {(r.case_study_id, r.split) for r in splits.stratified_split(df.repartition(7)).collect()} == {(r.case_study_id, r.split) for r in hashed.collect()}
    four = splits.stratified_split(df, fractions={"train": 0.5, "validation": 0.2, "test": 0.2, "holdout": 0.1})
    assert {r.split: r["count"] for r in four.filter("case_study_id < 20").groupBy("split").count().collect()} == {"train": 5, "validation": 2, "test": 2, "holdout": 1}


@pytest.mark.parametrize("shares", [[0.8, 0.3], [1.2, -0.2]])
def test_bad_fractions(shares):
    with pytest.raises(checks.ConstraintError):
        checks.fractions(shares)


def test_checks(spark):
    df = spark.createDataFrame([("1", "train"), ("1", "test"), ("2", "train")], "case_study_id string, split string")
    with pytest.raises(checks.ConstraintError, match="in several splits: 1"):
        checks.enforce(checks.splits_partition(df, df))
    assert checks.splits_disjoint(df.filter("split = 'train'"), df.filter("case_study_id = '2'")).first().item == "train::2"
    with pytest.raises(checks.ConstraintError):
        checks.columns(df, ["case_study_id", "other"])
    assert checks.not_empty(spark.createDataFrame([("1", ""), ("2", None), ("3", "x")], "id string, t string"), "t", "id").count() == 2
    assert checks.difficulty_all_or_none(spark.createDataFrame([("Easy",), (None,)], "difficulty string")).count() == 1
    assert checks.binary_label(spark.createDataFrame([(0,), (1,)], "y int"), "y").count() == 0
    assert checks.rating_range(rating_rows(spark, {"x": [0, 3, 6]})).count() == 2


def test_case_data(spark):
    rows = [(str(i), str(i), "sleep", "train", "x", "", "", "") for i in range(3)] + [("9", "9", "sleep", s, "same", "", "", "") for s in ("holdout", "holdout_model")]
    df = spark.createDataFrame(rows, schemas.SLEEP_CASE)
    fine = {"rows": 5, "ids": 4, "users": 4, "train": 3, "holdout": 1, "holdout_model": 1}
    checks.enforce(checks.case_data(df, "sleep", fine))
    broken = df.withColumn("input", F.when(F.col("split") == "holdout", "other").otherwise(F.col("input")))
    with pytest.raises(checks.ConstraintError, match="holdout differs"):
        checks.enforce(checks.case_data(broken, "sleep", fine))
    assert checks.case_data(df, "sleep").filter("check = 'unexpected count'").count() == 8


def conversation(spark, rows):
    return spark.createDataFrame([(c, c, [(t, r, [(x, None, None)], None) for t, r, x in ms]) for c, ms in rows], schemas.CONVERSATION)


def test_messages_and_prompts(spark, tmp_path):
    expert = conversation(spark, [("1", [("insight", "USER", "the {OBJECTIVE} data"), ("insight", "ASSISTANT", "expert says")])]).withColumn("conversation_source", F.lit("human_expert"))
    other = conversation(spark, [("1", [("insight", "ASSISTANT", "model says"), ("insight", "USER", "own data")])]).withColumn("conversation_source", F.lit("base_model"))
    m = other.select(scalar.message_text(F.col("messages"), F.lit("insight"), F.lit("USER")), scalar.message_index(F.col("messages"), F.lit("insight"), F.lit("USER")), scalar.message_index(F.col("messages"), F.lit("x"), F.lit("USER"))).first()
    assert tuple(m) == ("own data", 1, -1)
    rows = {(r.tag, r.principle): r.inputs for r in prompts.candidate_prompts(other, expert, "sleep").collect()}
    assert len(rows) == 60
    p = rows["insight", "readable"]
    assert "the {OBJECTIVE} data" in p and "model says" in p and fixed.OBJECTIVES["sleep"]["insight"] in p and p.count("```") == 4 and "{" not in p.replace("{OBJECTIVE}", "")
    assert "None" in rows["overall", "readable"] and '"Overall"' in rows["overall", "readable"]
    with pytest.raises(Exception, match="no expert conversation"):
        prompts.candidate_prompts(other, expert.limit(0), "sleep").collect()
    ratings = spark.createDataFrame([("1", "1", "base_model", "Primary A", "insight", "non_harmful", 5)], schemas.RATINGS)
    sp = spark.createDataFrame([("1", "train")], "case_study_id string, split string")
    r = prompts.rating_examples(ratings, sp, expert.unionByName(other), "sleep").first()
    assert r.targets == "5. There is no information that could lead to harm.<stop>" and "the {OBJECTIVE} data" in r.inputs and r.split == "train"
    own = prompts.rating_examples(ratings, sp, expert.unionByName(other), "sleep", user_text_from="own").first()
    assert "own data" in own.inputs
    with pytest.raises(Exception, match="rating must be"):
        prompts.rating_examples(ratings.withColumn("rating", F.lit(6)), sp, expert.unionByName(other), "sleep").collect()
    assert prompts.missing_parts(ratings, sp.limit(0), other.limit(0)).count() == 2
    both = expert.unionByName(other)
    for what, args in {"no split": (ratings, sp.limit(0), both), "no conversation": (ratings, sp, expert), "no conversation of the expert": (ratings, sp, other), "unknown tag": (ratings.withColumn("tag", F.lit("x")), sp, both)}.items():
        with pytest.raises(Exception, match=f"{what} for the rating of"):
            prompts.rating_examples(*args, "sleep").collect()
        examples, counts = prompts.counted_examples(*args, "sleep")
        assert examples.collect() == [] and counts.get == {"examples": 0, **dict.fromkeys(prompts.PROBLEMS, 0), what: 1}
        with pytest.raises(checks.ConstraintError, match="1 ratings"):
            prompts.write_matched_examples(*args, "sleep", str(tmp_path / "e"))
        assert not (tmp_path / "e").exists()
    assert prompts.write_matched_examples(ratings, sp, both, "sleep", str(tmp_path / "e"))["examples"] == 1 and (tmp_path / "e").exists()
    twice = conversation(spark, [("1", [("a", "USER", ""), ("a", "USER", "")])])
    assert checks.tag_roles(twice).first().item == "1"


def test_inference(spark):
    df = spark.createDataFrame([("one",), ("two",)], "inputs string")
    scored = inference.best_option(inference.run_inference(df, inference.HashModel, "score", partitions=2))
    model = inference.HashModel()
    for r in scored.collect():
        s = [model.score(r.inputs, str(i)) for i in range(1, 6)]
        assert r.predicted_rating == int(np.argmax(s)) + 1 and r.inference_score_option_2 == pytest.approx(s[1], abs=1e-6)
    assert dict(scored.dtypes)["inference_score_option_1"] == "float"
    assert inference.run_inference(df, inference.HashModel, "generate").filter("inference_text_output like '%<answer>%'").count() == 2
    with pytest.raises(checks.ConstraintError):
        inference.generate_answers(inference.generate_answers(df, inference.HashModel), inference.HashModel)
    with pytest.raises(NotImplementedError):
        inference.run_inference(df, inference.HashModel, "other")
    with pytest.raises(Exception, match="empty inputs"):
        inference.run_inference(spark.createDataFrame([("",)], "inputs string"), inference.HashModel, "score").collect()


def test_votes(spark):
    said = lambda *xs: [f"<answer>({x})</answer>" if x else "?" for x in xs]
    rows = [(k, i, t) for k, ts in {"win": said("A", "A", "B"), "tie": said("A", "B"), "none": said(None, None), "case": ["<Answer>(c)</ANSWER>"], "f": said("F", "F", "A")}.items() for i, t in enumerate(ts)]
    got = {r.k: (r.vote, r.generation) for r in exam.majority(spark.createDataFrame(rows, "k string, i int, t string"), "k", "i", "t").collect()}
    assert got == {"win": ("(A)", "<answer>(A)</answer>"), "case": ("(C)", "<Answer>(c)</ANSWER>"), "f": ("(A)", "<answer>(A)</answer>")}


class Sure:
    """Answers B in words, and scores C highest."""

    def generate(self, prompt):
        return ["<answer>(B)</answer>"]

    def score(self, prompt, completion):
        return float(completion == "(C)")


class Unsure(Sure):
    def generate(self, prompt):
        return ["no answer"]


def exam_frame(spark):
    rows = [("Q1", {"(A)": "x", "(B)": "y", "(C)": "z"}, "Sleep", "Easy", "(C)", 1), ("Q2", {"(A)": "x", "(B)": "y", "(C)": "z"}, "Fitness", "Hard", "(B)", 2)]
    return spark.createDataFrame(rows, "question string, choices map<string,string>, domain string, difficulty string, answer string, id int")


def test_exam(spark):
    df = exam_frame(spark)
    assert {r.model_answer for r in exam.evaluate(df, "id", Sure, "score").collect()} == {"(C)"}
    assert {r.model_answer for r in exam.evaluate(df, "id", Sure, "generate").collect()} == {"(B)"}
    assert {(r.model_answer, r.voted) for r in exam.evaluate(df, "id", Sure, "self_consistency", rounds=3).collect()} == {("(B)", True)}
    assert {(r.model_answer, r.voted) for r in exam.evaluate(df, "id", Unsure, "self_consistency", rounds=3).collect()} == {("(C)", False)}
    assert {r.skipped for r in exam.evaluate(df, "id", Unsure, "generate").collect()} == {1}
    assert {r.model_generation for r in exam.evaluate(df, "id", Unsure, "self_consistency", rounds=2).collect()} == {exam.NO_MAJORITY}
    acc = {r.stratum: (r.correct, r.incorrect, r.accuracy) for r in exam.accuracy(exam.evaluate(df, "id", Sure, "score")).collect()}
    assert acc == {"All": (1, 1, 0.5), "Easy": (1, 0, 1.0), "Hard": (0, 1, 0.0)}
    nothing = {r.stratum: r.accuracy for r in exam.accuracy(exam.evaluate(df, "id", Unsure, "generate"), skipped_is_wrong=False).collect()}
    assert nothing["All"] is None
    with pytest.raises(Exception, match="no cot template"):
        exam.by_text(df.withColumn("domain", F.lit("Cooking")), Sure).collect()
    with pytest.raises(NotImplementedError):
        exam.evaluate(df, "id", Sure, "other")
    bad = df.withColumn("choices", F.create_map(F.lit("(A)"), F.lit("x"), F.lit("(C)"), F.lit("y")))
    assert checks.exam_items(df, "id").count() == 0 and checks.exam_items(bad, "id").count() == 2
    assert exam.first_examples(df, "id", -1).count() == 2 and exam.first_examples(df, "id", 1).count() == 1


def test_case_parsing(spark):
    df = spark.createDataFrame([("a", "The user is male, 80+ years old.\nmore"), ("b", "The user is female, [40-44] years old."), ("c", "Something else")], "case_study_id string, input string")
    got = {r.case_study_id: (r.sex, r.age) for r in casestudy.sleep_demographics(df).collect()}
    assert got == {"a": ("Male", 82), "b": ("Female", 42), "c": (None, None)}
    assert casestudy.unparsed(casestudy.sleep_demographics(df), ("sex", "age")).count() == 2
    f = casestudy.fitness_demographics(spark.createDataFrame([("Age: [30-34]\nHeight: 1.75m\nWeight: 70.5kg\nBMI: 23.0\nx\nGender: Male",), ("Age: ?",), (None,)], "demographics_input string")).collect()
    assert (f[0].age, f[0].height, f[0].weight, f[0].bmi, f[0].gender) == (32.0, 1.75, 70.5, 23.0, "Male") and f[1].age is None and f[2].gender is None


def test_histograms(spark):
    df = spark.createDataFrame([(x,) for x in (25.0, 29.9, 30.0, 85.0, 86.0, None)], "v double")
    assert [r.n for r in casestudy.fixed_histogram(df, "v").orderBy("bin").collect()] == [2, 1] + [0] * 9 + [1]
    assert [r.n for r in casestudy.equal_width_histogram(df.filter("v < 31"), "v", 2).orderBy("bin").collect()] == [1, 2]
    assert [r.n for r in casestudy.equal_width_histogram(df.filter("v = 25"), "v", 2).orderBy("bin").collect()] == [1, 0]
    last = casestudy.last_per_user(casestudy.numbered(spark.createDataFrame([("u", 1, "x"), ("u", 2, "y"), ("w", 3, "z")], "user_id string, o int, s string"), "o"), "line")
    assert {(r.user_id, r.s) for r in last.collect()} == {("u", "y"), ("w", "z")}


def test_outcomes(spark):
    df = spark.createDataFrame([("alertness_score_binary_llm",), ("alertness_score_binary_xyz",), ("quality_score_binary_cnn",)], "prediction_name string")
    assert [(r.Target, r.Model) for r in outcomes.named(df).collect()] == [("Alert", "Tuned w/ Adapter"), ("alertness_score_binary", ""), ("Quality", "CNN")]
    with pytest.raises(Exception, match="no known outcome"):
        outcomes.named(spark.createDataFrame([("mood",)], "prediction_name string")).collect()
    scores = spark.createDataFrame([(1, y, s) for y, s in ((0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8))], "k int, y int, s double")
    assert outcomes.auroc(scores, ["k"], "y", "s").first().auroc == pytest.approx(0.875)
    prevalence = spark.createDataFrame([(0.1, 0.1, 0.1, "Alert", "Prevalence")], schemas.PREVALENCE)
    assert outcomes.random_baseline("auc", prevalence).first().baseline == 0.5 and outcomes.random_baseline("auprc", prevalence).first().baseline == 0.1


def test_adapter(spark):
    layers = adapter.random_layers(seed=3)
    x = np.random.default_rng(0).normal(size=(8, 40)).astype(np.float32)
    df = spark.createDataFrame([(i, r[:20].tolist(), r[20:].tolist()) for i, r in enumerate(x)], "i int, m array<float>, v array<float>").withColumn("x", adapter.statistics(F.col("m"), F.col("v")))
    got = {r.i: np.array(r.embedding) for r in adapter.project(df, "x", layers).collect()}
    want = adapter.forward(x, layers, 10)
    assert want.shape == (8, 10, 128) and all(np.allclose(got[i], want[i], atol=1e-4) for i in range(8))


def test_texts(spark):
    row = spark.range(1).select(
        scalar.rater_label(F.lit("sleep_primary_c")), scalar.rater_kind(F.lit("sleep_primary_c")), scalar.base_name(F.lit("/a/b/model.v1.tsv")), scalar.percent_text(F.lit(0.12345)),
        scalar.interval_label(F.lit(0.5), F.lit(0.25), F.lit(0.75), F.lit(12)), scalar.enum_name(F.lit("TRAIN"), fixed.SPLITS), scalar.date_token(F.lit("2024-03-05").cast("date")),
        scalar.composite_key("id"), scalar.fill("{A} and {B}", {"A": F.lit("{B}"), "B": F.lit(None).cast("string")}), scalar.strip_vertical(F.lit("Sleep Primary C")),
    ).first()
    assert tuple(row) == ("Sleep Primary C", "primary", "model.v1", "12.35%", ".500\n[.25–.75]\nn=12", "train", "20240305", "0", "{B} and None", "Primary C")
    with pytest.raises(Exception, match="unknown name"):
        spark.range(1).select(scalar.enum_name(F.lit("later"), fixed.SPLITS)).collect()
    assert len(fixed.PRINCIPLES) == 15 and set(fixed.PRINCIPLES) == set(fixed.PRINCIPLE_ORDER)


def test_files(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("1", "1", "base_model", "Primary A", "insight", "readable", 4), ("2", "2", "base_model", "Primary B", "overall", "readable", 2)], schemas.RATINGS)
    sinks.write_tsv(df, readers.ratings_path(root, "Sleep", "2024-01-02"))
    assert readers.ratings_path(root, "Sleep", "2024-01-02").endswith("sleep/rater_responses.20240102.tsv")
    assert sorted(map(tuple, readers.ratings(spark, root, "sleep", "2024-01-02").collect())) == sorted(map(tuple, df.collect()))
    sp = spark.createDataFrame([("2", "train"), ("1", "train"), ("3", "validation")], "case_study_id string, split string")
    sinks.write_splits(sp, f"{root}/splits")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_splits(sp, f"{root}/splits")
    sinks.write_splits(sp, f"{root}/splits", overwrite=True)
    assert spark.read.csv(f"{root}/splits", header=True).count() == 3
    for s in ("train", "validation"):
        sp.filter(f"split = '{s}'").select("case_study_id").write.csv(readers.split_path(root, "sleep", s, "2024-01-02"), header=True)
    assert {(r.case_study_id, r.split) for r in readers.splits(spark, root, "sleep", "2024-01-02").collect()} == {("1", "train"), ("2", "train"), ("3", "validation")}
    with pytest.raises(ValueError, match="none of"):
        readers.split_path(root, "sleep", "later", "2024-01-02")
    ex = df.withColumns({"inputs": F.lit("i"), "split": F.lit("train")})
    sinks.write_examples(ex, f"{root}/examples")
    assert readers.examples(spark, f"{root}/examples", "train").filter("tag = 'insight'").count() == 1
    sinks.write_results(exam.by_score(exam_frame(spark), Sure), f"{root}/results", "id")
    assert [r["index"] for r in spark.read.csv(f"{root}/results", header=True, multiLine=True, escape='"').orderBy("index").collect()] == ["0", "1"]
    (tmp_path / "exam.csv").write_text("question,choices,domain,difficulty,answer\n\"Two\nlines, \"\"quoted\"\"\",\"{'(A)': 'x', '(B)': 'it is'}\",Sleep,Easy,(A)\nOne,\"{'(A)': 'y'}\",Fitness,None,(A)\n")
    rows = readers.exam(spark, f"{root}/exam.csv", "Sleep", ("Easy",)).collect()
    assert len(rows) == 1 and rows[0].question == 'Two\nlines, "quoted"' and rows[0].choices == {"(A)": "x", "(B)": "it is"} and rows[0].options == ["(A)", "(B)"]
    (tmp_path / "cases.jsonl").write_text('{"case_study_id": "1", "user_id": "7", "vertical": "sleep", "split": "train", "input": "a\\nb"}\n')
    assert readers.case_studies(spark, f"{root}/cases.jsonl", "sleep").first().input == "a\nb"
    conv = conversation(spark, [("1", [("a", "USER", "x")])]).withColumns({"vertical": F.lit("sleep"), "conversation_source": F.lit("base_model")})
    conv.write.partitionBy("vertical", "conversation_source").parquet(f"{root}/conversations")
    assert readers.conversations(spark, f"{root}/conversations", "sleep", "base_model").count() == 1 and readers.conversations(spark, f"{root}/conversations", "sleep", "x").count() == 0
    (tmp_path / "auto.tsv").write_text("case_study_id\trater\ttag\tprinciple\tconversation_source\trating_human_expert\trating_auto\n1\ta\tt\tp\ts\t\t3.5\n")
    wide = readers.expert_ratings(spark, f"{root}/auto.tsv", ("rating_auto",))
    both = agreement.with_auto_rater(rating_rows(spark, {"s": [4]}), wide, "a", "rating_auto", "auto")
    assert {(r.rater, float(r.rating)) for r in both.collect()} == {("r", 4.0), ("auto", 3.5)}


def test_streams(spark, tmp_path):
    rows = [("t", "x", 4, "2024-01-01 00:10:00"), ("t", "x", 2, "2024-01-01 00:20:00"), ("t", "y", 5, "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "tag string, conversation_source string, rating int, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, out in (("means", stream.running_means(source)), ("counts", stream.windowed_counts(source))):
        q = out.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.conversation_source, r.mean_rating, r.n) for r in spark.table("means").collect()} == {("x", 3.0, 2), ("y", 5.0, 1)}
    assert spark.table("counts").count() == 3


class Told:
    """Says in its answer which options it got."""

    def generate(self, prompt, **options):
        return [f"{options} <answer>({'AB'[options.get('seed', 1) % 2]})</answer>"]

    def score(self, prompt, completion, **options):
        raise AssertionError("a question with a majority isn't scored")


def test_votes_share_a_prompt_and_only_ties_are_scored(spark):
    df = exam_frame(spark)
    got = exam.by_vote(df, "id", Told, rounds=3, seed_option="seed", options={"temperature": 0.7}).collect()
    assert {(r.model_answer, r.voted, r.model_generation) for r in got} == {("(B)", True, "{'temperature': 0.7, 'seed': 1} <answer>(B)</answer>")}
    assert inference.model_options(None, 5) == {"max_decode_steps": 5} and inference.model_options() == {}


def test_cell_bootstrap_is_near_a_plain_one(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(1, 6, 800)
    plain = np.percentile([rng.choice(x, len(x)).mean() for _ in range(2000)], [2.5, 97.5])
    r = bootstrap.cell_bootstrap(spark.createDataFrame([("g", int(v)) for v in x] + [("g", None)], "g string, v int"), ["g"], "v", n=2000).first()
    assert r["mean"] == pytest.approx(x.mean()) and abs(r.low - plain[0]) < 0.02 and abs(r.high - plain[1]) < 0.02


def test_split_files_are_looked_at_before_any_is_written(spark, tmp_path):
    from ratewell.sources import readers, sinks

    df = spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "test")], "case_study_id string, split string")
    df.select("case_study_id").write.csv(readers.split_path(str(tmp_path), "sleep", "test", "2024-01-02"))
    with pytest.raises(FileExistsError):
        sinks.write_split_files(df, str(tmp_path), "sleep", "2024-01-02")
    assert not sinks.exists(spark, readers.split_path(str(tmp_path), "sleep", "train", "2024-01-02"))
    sinks.write_split_files(df, str(tmp_path), "sleep", "2024-01-02", overwrite=True)
    assert sorted(map(tuple, readers.splits(spark, str(tmp_path), "sleep", "2024-01-02", ("train", "test")).collect())) == [("a", "train"), ("b", "train"), ("c", "test")]
