"""More queries beside their SQL: what is written and read back, checks on data that break them, bootstraps, small functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell import fixed_values as fixed
from ratewell.functions import scalar
from ratewell.operators import agreement, bootstrap, casestudy, checks, exam, merging, outcomes, prefix, prompts, ratings_stats, splits
from ratewell.operators.inference import HashModel, generate_answers, model_options, run_inference, run_with_ledger, runs_of
from ratewell.operators.resample import FEW
from ratewell.plans import views
from ratewell.plans.catalog import _AC2, _ASK, _ONE, _PARSED, _SPLIT, NAN, C, O, P, R, X, _examples, _tagged, query, rounded
from ratewell.plans.catalog import _EXAMPLES as EX
from ratewell.sources import readers, records, schemas, sinks
from ratewell.sources.scratch import folder, saved

DAY = "2024-05-01"

# ---- written and read back


@query(f"{R} select case_study_id, rater, tag, principle, conversation_source, count(*) n, sum(rating)::bigint total from r group by all")
def q_tsv_file(spark, d):
    """Ratings as a tab-separated file with a header."""
    place = folder(spark)
    sinks.write_tsv(views.ratings(spark, d).select(*(c.split()[0] for c in schemas.EXPERT_RATINGS.split(", "))), place)
    back = readers.tsv(spark, place, schemas.EXPERT_RATINGS)
    return back.groupBy("case_study_id", "rater", "tag", "principle", "conversation_source").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


@query(f"{R} select rater, conversation_source, count(*) n, sum(rating)::double total, round(sum(round(rating * 0.9, 3)), 3) total_auto from r group by all")
def q_expert_ratings_file(spark, d):
    """A wide file: human ratings, and automatic ones beside them."""
    place = folder(spark)
    wide = views.ratings(spark, d).select("case_study_id", "rater", "tag", "principle", "conversation_source", F.col("rating").cast("double").alias("rating_human_expert"), F.round(F.col("rating") * 0.9, 3).alias("rating_auto"))
    sinks.write_tsv(wide, place)
    back = readers.expert_ratings(spark, place, ("rating_auto",))
    sums = F.count("*").alias("n"), F.sum("rating_human_expert").alias("total"), F.round(F.sum("rating_auto"), 3).alias("total_auto")
    return back.groupBy("rater", "conversation_source").agg(*sums)


@query(f"{R} select conversation_id, rater, count(*) n, sum(rating)::bigint total from (select *, case_study_id || '-' || conversation_source conversation_id from r) group by all")
def q_rater_responses_file(spark, d):
    """Ratings under their dated name."""
    root = folder(spark)
    rows = views.ratings(spark, d).withColumn("conversation_id", F.concat_ws("-", "case_study_id", "conversation_source"))
    sinks.write_tsv(rows.select(*(c.split()[0] for c in schemas.RATINGS.split(", "))), readers.ratings_path(root, "Sleep", DAY))
    return readers.ratings(spark, root, "sleep", DAY).groupBy("conversation_id", "rater").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


@query(f"{_SPLIT} select case_study_id, split from sp")
def q_split_files(spark, d):
    """A dated file of ids for each split, read back as one frame."""
    root = folder(spark)
    sinks.write_split_files(splits.stratified_split(views.panel(spark, d)), root, "sleep", DAY)
    return readers.splits(spark, root, "sleep", DAY)


@query(f"{_SPLIT} select split, count(*) n, min(case_study_id) first_id, true sorted from sp group by 1")
def q_split_folders(spark, d):
    """One folder per split in one write; whether each file holds its ids in order."""
    place = folder(spark)
    sinks.write_splits(splits.stratified_split(views.panel(spark, d)), place)
    files = spark.read.text(place, wholetext=True).select("split", F.slice(F.split(F.rtrim("value", F.lit("\n")), "\n"), 2, 1 << 30).alias("ids"))
    return files.groupBy("split").agg(F.sum(F.size("ids")).cast("long").alias("n"), F.min(F.array_min("ids")).alias("first_id"), F.bool_and(F.col("ids") == F.array_sort("ids")).alias("sorted"))


def _stored_conversations(spark, d) -> str:
    place = folder(spark)
    every = [views.conversations(spark, d, s).withColumn("vertical", F.lit(v)) for v, s in (("sleep", "human_expert"), ("sleep", "base_model"), ("fitness", "tuned_model"))]
    every[0].unionByName(every[1]).unionByName(every[2]).write.partitionBy("vertical", "conversation_source").parquet(place)
    return place


_TURNS = "select conv_id::varchar conversation_id, turn, upper(role) role, text from conversations"


@query(_TURNS)
def q_conversation_store(spark, d):
    """One source's conversations from a store of nested messages, by partition."""
    rows = readers.conversations(spark, _stored_conversations(spark, d), "SLEEP", "base_model")
    return rows.select("conversation_id", F.inline("messages")).select("conversation_id", "turn", "role", F.col("chunks")[0]["text"].alias("text"))


@query("select s conversation_source, count(distinct conv_id) n, count(*) n_messages from conversations, (select unnest(['human_expert', 'base_model']) s) group by 1")
def q_conversation_sources(spark, d):
    """All sources of one vertical in one scan."""
    rows = readers.conversations(spark, _stored_conversations(spark, d), "sleep")
    return rows.groupBy("conversation_source").agg(F.count("*").alias("n"), F.sum(F.size("messages")).cast("long").alias("n_messages"))


@query(f"{EX} select rater, conversation_source, tag, principle, split, count(*) n, min(md5(inputs)) first_prompt from ex where split = 'train' group by all")
def q_example_store(spark, d):
    """Grading examples in folders by rater, source, tag and principle, found again by listing them."""
    place = folder(spark)
    sinks.write_examples(_examples(spark, d), place)
    return readers.examples(spark, place, "train").groupBy("rater", "conversation_source", "tag", "principle", "split").agg(F.count("*").alias("n"), F.min(F.md5("inputs")).alias("first_prompt"))


@query(f"{EX} select rater, conversation_source, tag, principle, split, count(*) n, sum(rating)::bigint total, min(md5(inputs)) first_prompt, max(md5(targets)) last_target from ex where tag = 'insight' and principle in {tuple(fixed.PRINCIPLE_ORDER[1:4])!r} group by all")
def q_record_files(spark, d):
    """Grading examples as record files, of which only those of some tags and principles are opened again."""
    place = folder(spark)
    records.write(_examples(spark, d), place, compression="gzip")
    back = records.read(spark, place, records.SCHEMA.replace("inputs string", "inputs string not null")).filter(F.col("tag") == "insight").filter(F.col("principle").isin(*fixed.PRINCIPLE_ORDER[1:4]))
    return back.groupBy("rater", "conversation_source", "tag", "principle", "split").agg(F.count("*").alias("n"), F.sum("rating").alias("total"), F.min(F.md5("inputs")).alias("first_prompt"), F.max(F.md5("targets")).alias("last_target"))


_PRO = """p as (select p_partkey, 'sleep' || (p_partkey % 7) || '_llm, "x"' prediction_name, 'auc' metric_name, p_retailprice / 10000 mean, p_size / 100.0 ci_lower, p_size / 50.0 ci_upper from part)"""


@query(f"with {_PRO} select prediction_name, metric_name, round(avg(mean), 6) mean, round(min(ci_lower), 6) ci_lower, round(max(ci_upper), 6) ci_upper, count(*) n, round(avg(p.p), 6) prevalence from (select *, (p_partkey % 10 + 1) / 100.0 p from p) p group by all")
def q_outcome_files(spark, d):
    """Both outcome tables as tab-separated files, read back and joined by the outcome."""
    part = views.table(spark, d, "part")
    name = F.concat(F.lit("sleep"), (F.col("p_partkey") % 7).cast("string"), F.lit('_llm, "x"'))
    rows = part.select(name.alias("prediction_name"), F.lit("auc").alias("metric_name"), (F.col("p_retailprice") / 10000).alias("mean"), (F.col("p_size") / 100.0).alias("ci_lower"), (F.col("p_size") / 50.0).alias("ci_upper"))
    share = (F.col("p_partkey") % 10 + 1) / 100.0
    shares = part.select(share.alias("mean"), (share - 0.005).alias("ci_lower"), (share + 0.005).alias("ci_upper"), name.alias("Target"), F.lit("Prevalence").alias("Model"))
    one, two = folder(spark), folder(spark)
    sinks.write_tsv(rows, one)
    sinks.write_tsv(shares, two)
    means = readers.outcomes(spark, one).groupBy("prediction_name", "metric_name").agg(F.avg("mean").alias("mean"), F.min("ci_lower").alias("ci_lower"), F.max("ci_upper").alias("ci_upper"), F.count("*").alias("n"))
    prevalence = readers.prevalence(spark, two).filter("Model = 'Prevalence'").groupBy(F.col("Target").alias("prediction_name")).agg(F.avg("mean").alias("prevalence"))
    return rounded(means.join(prevalence, "prediction_name"), "mean", "ci_lower", "ci_upper", "prevalence")


@query(f"{_PARSED} select case_study_id, sex, b age_bucket from y")
def q_case_study_file(spark, d):
    """Case studies as JSON lines, their schema given."""
    place = folder(spark)
    views.cases(spark, d).select("case_study_id", "user_id", "vertical", "split", "input").write.json(place)
    return casestudy.sleep_demographics(readers.case_studies(spark, place, "sleep")).select("case_study_id", "sex", "age_bucket")


@query(f"{X} select md5(question || chr(10) || '\"quoted\", and more') question_md5, '(A), (B), (C), (D)' options, '(C) = it''s three' as third, difficulty, answer from x where domain = 'Sleep' and difficulty in ('Easy', 'Hard')")
def q_exam_file(spark, d):
    """Exam questions as CSV with line breaks and quotes inside, choices as JSON text; one domain, two difficulties."""
    place = folder(spark)
    rows = views.exam(spark, d).withColumn("question", F.concat("question", F.lit('\n"quoted", and more')))
    choices = F.to_json(F.transform_values("choices", lambda k, v: F.when(k == "(C)", F.concat(F.lit("it's "), v)).otherwise(v)))
    rows.select("question", choices.alias("choices"), "domain", "difficulty", "answer").write.csv(place, header=True, quote='"', escape='"')
    back = readers.exam(spark, place, "Sleep", ("Easy", "Hard"))
    third = F.concat(F.lit("(C) = "), F.col("choices")["(C)"])
    return back.select(F.md5("question").alias("question_md5"), F.array_join("options", ", ").alias("options"), third.alias("third"), "difficulty", "answer")


_ROWS = [
    ("How many hours do adults sleep at least?", {"(A)": "five", "(B)": "seven"}, "Sleep", "Easy", "(B)"),
    ("Which light shifts sleep later?\nPick one.", {"(A)": "evening", "(B)": "noon", "(C)": "none"}, "Sleep", "Hard", "(A)"),
    ("What does a \"rest day\" serve?", {"(A)": "recovery", "(B)": "speed", "(C)": "nothing"}, "Fitness", "Easy", "(A)"),
]


@query(f"{X}, t as (select unnest([('Sleep', 'Easy', '(B)', 2, 'seven'), ('Sleep', 'Hard', '(A)', 3, 'evening'), ('Fitness', 'Easy', '(A)', 3, 'recovery')]) v) select domain, difficulty, answer, 4::int n_choices, case answer when '(A)' then 'one' when '(B)' then 'two' when '(C)' then 'three' else 'four' end right_choice, count(*) n from x group by all union all select v[1], v[2], v[3], v[4]::int, v[5], 1 from t".replace("unnest([(", "unnest([row(").replace("), (", "), row("))
def q_exam_rows(spark, d):
    """Every question of a table, and some given in code, by way of a file."""
    place = folder(spark)
    rows = readers.exam_table(views.exam(spark, d)).union(readers.exam_rows(spark, _ROWS))
    rows.write.csv(place, header=True, quote='"', escape='"')
    back = readers.exam(spark, place)
    return back.groupBy("domain", "difficulty", "answer", F.size("choices").alias("n_choices"), F.col("choices")[F.col("answer")].alias("right_choice")).agg(F.count("*").alias("n"))


_SCORE = "('0x' || substr(md5(concat(prompt, '|', l)), 1, 8))::bigint"


@query(f"{X}, y as (select *, {_ASK} prompt from x), b as (select item_id, answer, l model_answer from (select y.*, l from y, (select unnest(['(A)', '(B)', '(C)', '(D)']) l)) qualify row_number() over (partition by item_id order by {_SCORE} desc, l) = 1) select (row_number() over (order by item_id) - 1)::int as index, item_id, model_answer, (model_answer = answer)::int correct from b")
def q_results_file(spark, d):
    """A whole evaluation, saved as CSV with the number of each row, read back."""
    place = folder(spark)
    exam.evaluate(views.exam(spark, d), "item_id", HashModel, "score", place)
    back = spark.read.csv(place, header=True, multiLine=True, escape='"', inferSchema=True)
    return back.select("index", F.col("item_id").cast("long").alias("item_id"), "model_answer", F.col("correct").cast("int").alias("correct"))


@query("""select p_brand model, vertical, split, method, 'runs/' || vertical || '/' || p_brand || '.' || split || '.20240501.' || method || '.tsv' path
from (select distinct p_brand from part), (select unnest(['sleep', 'fitness']) vertical), (select unnest(['train', 'validation']) split), (select unnest(['score', 'generate']) "method")""")
def q_inference_runs(spark, d):
    """Every vertical, split and method of every model's runs, with the file that each writes."""
    models = views.table(spark, d, "part").select(F.col("p_brand").alias("model"))
    return runs_of(models, "runs", DAY, fixed.VERTICALS, ("train", "validation"), ("score", "generate"))


@query(f"{X}, s as (select item_id, question, o, ln((('0x' || substr(md5(question || '|' || o), 1, 8))::bigint + 1) / 4294967296.0)::float::double sc from x, (select unnest(['1', '2', '3', '4', '5']) o)) select item_id, round(max(sc) filter (o = '1'), 4) s1, round(max(sc) filter (o = '2'), 4) s2, round(max(sc) filter (o = '3'), 4) s3, round(max(sc) filter (o = '4'), 4) s4, round(max(sc) filter (o = '5'), 4) s5 from s group by 1")
def q_inference_file(spark, d):
    """Scores of five options per prompt, written under the run's name and read back."""
    place = readers.inference_path(folder(spark), "sleep", "m1", "validation", DAY, "score")
    scored = run_inference(views.exam(spark, d).select("item_id", F.encode("question", "UTF-8").alias("raw"), F.col("question").alias("inputs")), HashModel, "score", options=model_options(temperature=0.0))
    sinks.write_tsv(scored.drop("inputs"), place)
    back = readers.tsv(spark, place, "item_id long, raw string, " + ", ".join(f"inference_score_option_{i} float" for i in range(1, 6)), multi_line=True)
    return back.select("item_id", *(F.round(F.col(f"inference_score_option_{i}").cast("double"), 4).alias(f"s{i}") for i in range(1, 6)))


@query(f"{X} select item_id, '(' || substr('ABCDE', (('0x' || substr(md5(question || '|max_decode_steps=16|temperature=0.5'), 1, 4))::bigint % 5)::int + 1, 1) || ')' with_options, '(' || substr('ABCDE', (('0x' || substr(md5(question || '|temperature=0.5'), 1, 4))::bigint % 5)::int + 1, 1) || ')' with_one from x")
def q_model_options(spark, d):
    """Options reach the model only where they are given."""
    rows = views.exam(spark, d).select("item_id", F.col("question").alias("inputs"))
    both = generate_answers(rows, HashModel, options=model_options(0.5, 16)).select("item_id", scalar.answer_in(F.col("inference_text_output")).alias("with_options"))
    one = generate_answers(rows, HashModel, options=model_options(0.5)).select("item_id", scalar.answer_in(F.col("inference_text_output")).alias("with_one"))
    return both.join(one, "item_id")


# ---- checks


@query("select role, lower(role) as name, count(*) n from (select upper(role) role from conversations) group by all")
def q_enum_names(spark, d):
    roles = views.table(spark, d, "conversations").select(F.upper("role").alias("role"))
    return roles.select("role", scalar.enum_name(F.col("role"), tuple(r.lower() for r in fixed.ROLES)).alias("name")).groupBy("role", "name").agg(F.count("*").alias("n"))


@query("select 'duplicate l_orderkey, l_linenumber' \"check\", l_orderkey || '::' || l_linenumber item from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def q_duplicate_ids(spark, d):
    return checks.unique(views.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"{P}, ids as (select distinct case_study_id, case when case_study_id::int % 2 = 0 then 'train' else 'validation' end split from r) select 'duplicate split, case_study_id' \"check\", split || '::' || case_study_id item from ids where case_study_id::int % 3 = 0")
def q_split_groups_disjoint(spark, d):
    """Two groups' splits that share some ids."""
    ids = views.panel(spark, d).select("case_study_id").distinct().withColumn("split", F.when(F.col("case_study_id").cast("int") % 2 == 0, "train").otherwise("validation"))
    return checks.splits_disjoint(ids, ids.filter("cast(case_study_id as int) % 3 = 0"))


@query(f"{P}, ids as (select distinct case_study_id, case when case_study_id::int % 2 = 0 then 'train' else 'validation' end split from r) select split, count(*) n, min(case_study_id) first_id from ids group by 1")
def q_merged_splits(spark, d):
    ids = views.panel(spark, d).select("case_study_id").distinct().withColumn("split", F.when(F.col("case_study_id").cast("int") % 2 == 0, "train").otherwise("validation"))
    parts = [ids.filter(f"cast(case_study_id as int) % 3 = {k}") for k in range(3)]
    return splits.merge(*parts).groupBy("split").agg(F.count("*").alias("n"), F.min("case_study_id").alias("first_id"))


@query("select 'duplicate conversation_source, case_study_id' \"check\", 'base_model::' || conv_id item from conversations where conv_id % 5 = 0 group by conv_id")
def q_one_conversation(spark, d):
    rows = _tagged(spark, d, "base_model")
    return checks.one_conversation(rows.unionByName(rows.filter("cast(case_study_id as int) % 5 = 0")))


@query("select 'empty text' \"check\", doc_id::varchar item from documents where doc_id % 7 = 0 or coalesce(length(text), 0) = 0")
def q_empty_prompts(spark, d):
    rows = views.table(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 14 == 0, "").when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("text")))
    return checks.not_empty(rows, "text", "doc_id")


@query("select 'impossible interval' \"check\", concat_ws('::', p_name, p_brand, 'm') item from part where p_size in (1, 2, 3) or p_partkey % 50 = 0")
def q_impossible_intervals(spark, d):
    """Results with no sample, a spread from one sample, or a level that is none."""
    mean = F.col("p_retailprice")
    rows = views.table(spark, d, "part").select(
        F.col("p_name").alias("model_name"), F.col("p_brand").alias("prediction_name"), F.lit("m").alias("metric_name"), mean.alias("mean"), F.when(F.col("p_size") == 2, 0.5).otherwise(0.0).alias("stddev"),
        F.when(F.col("p_size") == 1, 0).otherwise(1).alias("num_samples"), F.when(F.col("p_partkey") % 50 == 0, 0.0).otherwise(95.0).alias("ci_level"), mean.alias("ci_lower"), F.when(F.col("p_size") == 3, mean + 1).otherwise(mean).alias("ci_upper"),
    )
    return checks.interval_rows(rows)


@query(f"{X} select 'difficulty on some rows only' \"check\", count(*) filter (item_id % 2 = 0) || '/' || count(*) item from x")
def q_difficulty_on_some(spark, d):
    rows = views.exam(spark, d)
    return checks.all_of(checks.difficulty_all_or_none(rows), checks.difficulty_all_or_none(rows.withColumn("difficulty", F.when(F.col("item_id") % 2 == 0, F.col("difficulty")))))


@query(f"{_PARSED} select 'no age' \"check\", case_study_id item from y where line % 9 = 0 union all select 'no sex', case_study_id from y where line % 10 = 0")
def q_unparsed_cases(spark, d):
    """Case studies whose text doesn't give a field."""
    broken = F.when(F.col("line") % 10 == 0, F.replace("input", F.lit("The user is "), F.lit("A person, "))).otherwise(F.col("input"))
    broken = F.when(F.col("line") % 9 == 0, F.replace(broken, F.lit(" years old."), F.lit(" years"))).otherwise(broken)
    return casestudy.unparsed(casestudy.sleep_demographics(views.cases(spark, d).withColumn("input", broken)), ("age", "sex"))


def _fitness(spark, d):
    rows = views.cases(spark, d).withColumns({"vertical": F.lit("fitness"), "case_study_id": F.floor(F.col("line") / 5).cast("string")})
    texts = {c: F.lit(c) for c in (*schemas.FITNESS_INPUTS[1:], "demographics_output", "training_load_output", "sleep_output")}
    return rows.withColumns({**texts, "demographics_input": F.lit("same"), "sleep_output": F.when((F.col("line") % 35 == 0), "other").otherwise("sleep_output")})


@query(f"""{C}, f as (select (line // 5)::varchar id, user_id, split, line from c), n as (select unnest(['rows=' || count(*), 'ids=' || count(distinct id), 'users=' || count(distinct user_id), 'holdout=' || count(*) filter (split = 'holdout')]) x from f),
a as (select * from f where split = 'holdout'), b as (select * from f where split = 'holdout_model')
select 'unexpected count' "check", x item from n union all select 'holdout differs from holdout_model', coalesce(a.id, b.id) from a full join b on a.id = b.id where a.id is null or b.id is null or a.line % 35 = 0""")
def q_fitness_constraints(spark, d):
    """Counts of a fitness data set, and holdout pairs that must agree in nine texts."""
    return checks.case_data(_fitness(spark, d), "fitness", {"rows": 1, "ids": 1, "users": 1, "holdout": -1})


def _accepted(call: Callable[[], object]) -> bool:
    try:
        call()
    except (checks.ConstraintError, ValueError, FileExistsError):
        return False
    return True


_ARGUMENTS = [("fractions sum to one", True), ("fractions sum to more", False), ("fractions below zero", False), ("columns there", True), ("columns missing", False), ("columns repeat", False), ("metrics named", True), ("metrics named twice", False), ("no metric", False), ("target is new", True), ("target is there", False), ("target may be replaced", True), ("vertical known", True), ("vertical unknown", False)]


@query(f"select * from (values {', '.join(f'({name!r}, {ok})' for name, ok in _ARGUMENTS)}) t(argument, accepted)")
def q_argument_checks(spark, d):
    """What operators refuse before they run."""
    rows, root = views.panel(spark, d), folder(spark)
    own = splits.stratified_split(rows)
    calls = [
        lambda: checks.fractions([0.8, 0.2, 0.0]), lambda: checks.fractions([0.8, 0.3]), lambda: checks.fractions([1.2, -0.2]),
        lambda: checks.columns(rows, ["tag", "rater"]), lambda: checks.columns(rows, ["tag", "nothing"]), lambda: checks.columns(rows, ["tag", "tag"]),
        lambda: bootstrap.check_metrics([bootstrap.AC2, bootstrap.COUNT]), lambda: bootstrap.check_metrics([bootstrap.AC2, bootstrap.AC2]), lambda: bootstrap.check_metrics([]),
        lambda: sinks.write_split_files(own, root, "sleep", DAY), lambda: sinks.write_split_files(own, root, "sleep", DAY), lambda: sinks.write_split_files(own, root, "sleep", DAY, overwrite=True),
        lambda: readers.one_of("Fitness", fixed.VERTICALS), lambda: readers.one_of("cooking", fixed.VERTICALS),
    ]
    return spark.createDataFrame([(name, _accepted(call)) for (name, _), call in zip(_ARGUMENTS, calls, strict=True)], "argument string, accepted boolean")


# ---- agreement, bootstraps, baselines


@query(f"{R}, one as (select case_study_id, tag, principle, conversation_source, rater, max(rating) m from r group by all) select case_study_id, tag, principle, conversation_source, max(m) filter (rater = 'primary_a') primary_a, max(m) filter (rater = 'primary_b') primary_b, max(m) filter (rater = 'secondary_a') secondary_a, max(m) filter (rater = 'secondary_b') secondary_b from one group by all")
def q_pivot_strict(spark, d):
    """One column per rater, for ratings without repeats (a repeat would be an error)."""
    return agreement.pivot_strict(agreement.per_rater(views.ratings(spark, d), "max"), ["primary_a", "primary_b", "secondary_a", "secondary_b"])


_NAMES = ("primary_a", "primary_b", "secondary_a", "secondary_b")


@query(_AC2 + ", m as (select rater_a o, rater_b i, (pa - pe) / (1 - pe) v from g union all select rater_b, rater_a, (pa - pe) / (1 - pe) from g) select list_position(" + repr(list(_NAMES)) + ", o)::int place, o as \"outer\"" + "".join(f", round(max(v) filter (i = '{x}'), 6) {x}" for x in _NAMES) + " from m group by o")
def q_agreement_matrix(spark, d):
    pairs = agreement.reflected(agreement.ac2(agreement.rater_pairs(views.ratings(spark, d), "max"), undefined=NAN), "ac2")
    return rounded(agreement.matrix(pairs, "ac2", _NAMES), *_NAMES)


_WHOLE = "select rater_b model_name, rater_a prediction_name, 'gwet_ac2' metric_name, round((pa - pe) / (1 - pe), 6) mean, 0.0::double stddev, 1 num_samples, 95.0::double ci_level, round((pa - pe) / (1 - pe), 6) ci_lower, round((pa - pe) / (1 - pe), 6) ci_upper from g union all select rater_b, rater_a, 'sample_count', n, 0, 1, 95, n, n from g"


@query(f"{_AC2} {_WHOLE}")
def q_bootstrap_without_draws(spark, d):
    """All metrics of each pair of raters on all of its rows: what a bootstrap of no draws gives."""
    out = bootstrap.rater_pair_bootstrap(agreement.rater_pairs(views.ratings(spark, d), "max"), n=0)
    return rounded(out, "mean", "stddev", "ci_lower", "ci_upper")


@query(f"{_AC2} select rater_b model_name, rater_a prediction_name, n::double mean, 0.0::double stddev, 1000 num_samples, n::double ci_lower, n::double ci_upper from g")
def q_bootstrap_sample_count(spark, d):
    """The metric that is alike in all 1,000 draws: every draw has as many items as the pair."""
    keyed = agreement.rater_pairs(views.ratings(spark, d), "max").withColumn("item", F.concat_ws("::", *agreement.KEYS))
    out = bootstrap.exact_bootstrap(keyed, ["rater_a", "rater_b"], "item", "va", ["vb"], [bootstrap.COUNT], n=1000)
    return out.select(F.col("rater_b").alias("model_name"), F.col("rater_a").alias("prediction_name"), "mean", "stddev", "num_samples", "ci_lower", "ci_upper")


@query("""with x as (select l.doc_id, quality, (n_chars > 2000)::int guess, (doc_id % 3 = 0)::int other from labels l join documents using (doc_id) where toxic = 0)
select 'all' one, 'guess' model_name, 'share right' metric_name, round(avg((quality = guess)::int), 6) mean, 1 num_samples from x union all select 'all', 'other', 'share right', round(avg((quality = other)::int), 6), 1 from x
union all select 'all', 'guess', 'recall', round(sum(quality * guess) / sum(quality), 6), 1 from x union all select 'all', 'other', 'recall', round(sum(quality * other) / sum(quality), 6), 1 from x""")
def q_metrics_under_mask(spark, d):
    """Metrics of the user's own, one of them for binary labels, of two predictions, on the rows that a mask leaves."""
    rows = views.table(spark, d, "labels").join(views.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select("doc_id", "toxic", F.lit("all").alias("one"), F.col("quality").cast("int").alias("quality"), (F.col("n_chars") > 2000).cast("int").alias("guess"), (F.col("doc_id") % 3 == 0).cast("int").alias("other"))
    own = [bootstrap.Metric("share right", lambda y, p: float((y == p).mean())), bootstrap.Metric("recall", lambda y, p: float((y * p).sum() / y.sum()), binary=True)]
    out = bootstrap.exact_bootstrap(rows, ["one"], "doc_id", "quality", ["guess", "other"], own, n=0, mask=F.col("toxic") == 0)
    return rounded(out.select("one", F.col("model_name"), "metric_name", "mean", "num_samples"), "mean")


@query(f"""{P}, sp as (select distinct case_study_id from r where case_study_id::int % 7 <> 0), cv as (select distinct conv_id::varchar case_study_id from conversations where conv_id % 11 <> 0),
x as (select sp.case_study_id is null no_split, cv.case_study_id is null or (conversation_source = 'base_model' and r.case_study_id::int % 3 = 0) no_conv, he.case_study_id is null no_expert, principle = 'p7' bad from r left join sp using (case_study_id) left join cv using (case_study_id) left join cv he using (case_study_id)),
y as (select case when no_split then 'no split' when no_conv then 'no conversation' when no_expert then 'no conversation of the expert' when bad then 'unknown principle' else 'examples' end problem from x)
select p problem, count(y.problem) n from (select unnest(['examples', 'no split', 'no conversation', 'no conversation of the expert', 'unknown tag', 'unknown principle']) p) left join y on p = y.problem group by all""")
def q_examples_unmatched(spark, d):
    """Examples written from ratings of which some lack a split, a conversation or a known principle; how many, counted by
    the pass that writes."""
    principles = F.array(*map(F.lit, fixed.PRINCIPLE_ORDER))
    named = F.when(F.col("principle") != "p7", F.get(principles, F.substring("principle", 2, 1).cast("int"))).otherwise(F.col("principle"))
    rows = views.panel(spark, d).withColumns({"tag": F.when(F.col("tag") == "insights", "insight").when(F.col("tag") == "recommendations", "recommendation").otherwise("etiology"), "principle": named, "conversation_id": F.col("case_study_id")})
    sp = rows.filter("cast(case_study_id as int) % 7 <> 0").select("case_study_id").distinct().withColumn("split", F.lit("train"))
    number = F.col("case_study_id").cast("int")
    rated = rows.select("case_study_id").distinct()  # 200, by the view; only their conversations are gathered
    every = _tagged(spark, d, "human_expert", rated).unionByName(_tagged(spark, d, "base_model", rated).filter(number % 3 != 0)).unionByName(_tagged(spark, d, "tuned_model", rated)).filter(number % 11 != 0)
    counts = prompts.write_matched_examples(rows, sp, every, "sleep", folder(spark), allowed=2**62)
    return spark.createDataFrame([(p, counts[p]) for p in ("examples", *prompts.PROBLEMS)], "problem string, n bigint")


@query(f"{X} select item_id, 'Reasoning. <answer>(' || substr('ABCDE', (('0x' || substr(md5(question), 1, 4))::bigint % 5)::int + 1, 1) || ')</answer>' inference_text_output, round(ln((('0x' || substr(md5(question || '|' || inference_text_output), 1, 8))::bigint + 1) / 4294967296.0)::float::double, 4) inference_score_output, item_id % 3 = 0 answered_before from x")
def q_inference_restarted(spark, d):
    """A run over all prompts after one that answered a third of them: what the ledger holds isn't asked again."""
    rows, ledger = views.exam(spark, d).select("item_id", F.col("question").alias("inputs")), folder(spark)
    run_with_ledger(rows.filter("item_id % 3 = 0"), "item_id", HashModel, "generate", ledger)
    before = saved(spark.read.parquet(ledger).select("item_id", F.lit(True).alias("answered_before")))
    out = run_with_ledger(rows, "item_id", HashModel, "generate", ledger).join(before, "item_id", "left")
    return out.select("item_id", "inference_text_output", F.round(F.col("inference_score_output").cast("double"), 4).alias("inference_score_output"), F.coalesce("answered_before", F.lit(False)).alias("answered_before"))


@query(f"""{_ONE}, c as (select ma::double va, mb::double vb, count(*)::double n from pairs group by all),
mg as (select v, sum(n) m from (select va v, n from c union all select vb, n from c) group by all),
sz as (select min(v) lo, max(v) hi, count(*) q, sum(m) / 2 n, sum(m * m) mm from mg),
w as (select sum(1 - (x.v - y.v) ** 2 / (hi - lo) ** 2) tw from mg x, mg y, sz),
pa as (select sum((1 - (va - vb) ** 2 / (hi - lo) ** 2) * c.n) / sum(c.n) pa, sum(abs(va - vb) * c.n) / sum(c.n) off from c, sz),
g as (select pa, off, tw / (q * (q - 1)) * (1 - mm / (4 * n * n)) pe, n from sz, w, pa),
s as (select vb, sum(case when va > 3 then n else 0 end) p, sum(case when va > 3 then 0 else n end) q from c group by 1),
k as (select *, coalesce(sum(q) over (order by vb rows between unbounded preceding and 1 preceding), 0) below from s)
select 'gwet_ac2' metric_name, round((pa - pe) / (1 - pe), 6) as "value", n::bigint n from g union all select 'mean distance', round(off, 6), n::bigint from g
union all select 'auroc', round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6), sum(p + q)::bigint from k""")
def q_merged_metrics(spark, d):
    """AC2, AUROC and a metric of the user's own over all pairs of raters as one group, which many tasks share."""
    pairs = agreement.rater_pairs(views.ratings(spark, d), "max").withColumns({"one": F.lit("all"), "high": (F.col("va") > 3).cast("int")})
    distance = merging.Merging("mean distance", lambda: (0.0, 0), lambda s, a, b: (s[0] + float(np.abs(a - b).sum()), s[1] + len(a)), lambda s, t: (s[0] + t[0], s[1] + t[1]), lambda s: s[0] / s[1])
    one = merging.merged_metrics(pairs, ["one"], "va", ["vb"], [merging.AC2, distance])
    two = merging.merged_metrics(pairs, ["one"], "high", ["vb"], [merging.AUROC])
    both = one.union(two).withColumn("value", F.coalesce("value", F.lit(NAN)))  # one category or class: zero by zero
    return rounded(both.select("metric_name", "value", "n"), "value")


_HOT = "case when o_orderkey % 3 = 0 then 'hot' else o_orderpriority end"


@query(f"""with c as (select {_HOT} g, o_orderstatus s, o_totalprice v, count(*) n from orders group by all),
pr as (select x.g, x.s a, y.s b from (select distinct g, s from c) x join (select distinct g, s from c) y on x.g = y.g and x.s < y.s),
m as (select pr.g, a, b, v, sum(case when s = a then n else 0 end) na, sum(n) nn from pr join c on pr.g = c.g and (s = a or s = b) group by all),
k as (select *, coalesce(sum(nn) over (partition by g, a, b order by v rows between unbounded preceding and 1 preceding), 0) + (nn + 1) / 2.0 rk from m),
t as (select g, a, b, sum(na * rk)::double s, sum(na)::double n1, (sum(nn) - sum(na))::double n2 from k group by all),
z as (select g, a, b, (n1 + n2)::bigint n, (s - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) z from t)
select g, a, b, n, round(z, 6) statistic from z union all select g, b, a, n, round(-z, 6) from z""")
def q_ranksum_many_levels(spark, d):
    """Rank sums of prices, nearly all different, with a third of the rows in one group."""
    hot = F.when(F.col("o_orderkey") % 3 == 0, "hot").otherwise(F.col("o_orderpriority"))
    rows = views.table(spark, d, "orders").select(hot.alias("tag"), F.col("o_orderstatus").alias("conversation_source"), F.col("o_totalprice").alias("rating"))
    return rounded(ratings_stats.rank_sums(rows, many_levels=True), "statistic").drop("p")


@query(f"select {_HOT} g, round(avg(o_totalprice), 6) mean, round(stddev_pop(o_totalprice), 6) stddev, count(*) num_samples, round(quantile_cont(o_totalprice::double, 0.025), 6) ci_lower, round(quantile_cont(o_totalprice::double, 0.975), 6) ci_upper from orders group by all")
def q_percentiles_of_many_values(spark, d):
    """Exact percentile intervals of groups whose values are nearly all different."""
    hot = F.when(F.col("o_orderkey") % 3 == 0, "hot").otherwise(F.col("o_orderpriority"))
    rows = views.table(spark, d, "orders").select(hot.alias("g"), F.col("o_totalprice").cast("double").alias("v"))
    return rounded(bootstrap.exact_intervals(rows, ["g"], "v"), "mean", "stddev", "ci_lower", "ci_upper")


@query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as \"index\" from orders")
def q_numbered_rows(spark, d):
    """Every row's number in one order, given by ranges."""
    rows = views.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return prefix.numbered(rows, [-F.col("o_totalprice"), "o_orderkey"]).select("o_orderkey", "index")


def _drawn(keys: str, value: str, cells: str, draws: int = 1000) -> str:
    """CTEs that end in drw (keys, v, draw, w): resamples as counts of cells, where ``cells`` selects (keys, v, n) and v, as
    text, is ``value``. A cell's share of what is left is found from probabilities by the log gamma function."""
    key = f"concat_ws(':', '42', draw::varchar, {keys}, {value}, '{{}}')"
    u = "(('0x' || substr(md5({}), 1, 8))::bigint + 0.5) / 4294967296.0"
    cut = "(lgamma(lt + 1) - lgamma(k + 1) - lgamma(lt - k + 1) + k * ln(r) + (lt - k) * ln(1 - r))"
    return f"""cel as ({cells}),
cell_of as (select *, row_number() over (partition by {keys} order by v) i, sum(n) over (partition by {keys} order by v rows between unbounded preceding and current row) - n before, sum(n) over (partition by {keys}) total, count(*) over (partition by {keys}) m from cel),
drw as (with recursive step as (
  select o.* exclude (n, before, m), draw::int draw, 0::bigint i0, 0::bigint w, total::bigint lt from cell_of o, (select unnest(range(1, {draws + 1})) draw) where i = 1
  union all
  select {', '.join('nx.' + k.strip() for k in keys.split(','))}, nx.v, nx.i, nx.total, nx.draw, nx.i, nx.x, nx.lt - nx.x from (
    select *, (case when p >= 1 then lt when lt = 0 then 0 when p <= 0.5 then f else lt - f end)::bigint x from (
      select *, case when lt * r < {FEW} then least(lt, len(list_filter(list_transform(range(0, least(lt, ceil(lt * r + 7 * sqrt(lt * r) + 12))::bigint + 1), lambda j: list_sum(list_transform(range(0, j + 1), lambda k: exp({cut})))), lambda y: y < u)))
        else greatest(0, least(lt, floor(lt * r + sqrt(lt * r * (1 - r) - 1 / 12.0) * z + (1 - 2 * r) * (z * z - 1) / 6 + 0.5))) end f
      from (select *, sqrt(-2 * ln(u)) * cos(2 * pi() * u2) z from (select *, least(p, 1 - p) r, {u.format(key.format('a'))} u, {u.format(key.format('b'))} u2
        from (select o.*, s.draw, s.lt, o.n / (o.total - o.before) p from (select *, i0 + 1 nxt from step) s join cell_of o on {' and '.join(f's.{k.strip()} = o.{k.strip()}' for k in keys.split(','))} and o.i = s.nxt)))
    )) nx)
  select {keys}, v, draw, w from step where i0 > 0 and w > 0)"""


def _bars(group: str) -> str:
    cells = f"select {group}, conversation_source, rating v, count(*) n from r group by all"
    return f"""{R}, {_drawn(f'{group}, conversation_source', 'v::varchar', cells)}, m as (select {group}, conversation_source, round(sum(n * v) / sum(n), 6) mean from cel group by all),
s as (select {group}, conversation_source, draw, sum(w * v) / sum(w) x from drw group by all) select {group}, conversation_source, mean, round(quantile_cont(x, 0.025), 6) low, round(quantile_cont(x, 0.975), 6) high from s join m using ({group}, conversation_source) group by all"""


@query(_bars("tag"))
def q_bar_means_by_section(spark, d):
    """Mean ratings with intervals from 1,000 draws, as bars of a report by section."""
    return rounded(bootstrap.cell_bootstrap(views.ratings(spark, d), ["tag", "conversation_source"], "rating"), "mean", "low", "high")


@query(_bars("principle"))
def q_bar_means_by_principle(spark, d):
    return rounded(bootstrap.cell_bootstrap(views.ratings(spark, d), ["principle", "conversation_source"], "rating"), "mean", "low", "high")


_AC2_CELLS = _drawn("rater_a, rater_b", "(v).va::varchar, (v).vb::varchar", "select rater_a, rater_b, {'va': ma, 'vb': mb} v, count(*) n from pairs group by all")


@query(f"""{_AC2}, {_AC2_CELLS},
dm as (select rater_a, rater_b, draw, v, sum(w) m from (select rater_a, rater_b, draw, (v).va::double v, w from drw union all select rater_a, rater_b, draw, (v).vb::double, w from drw) group by all),
ds as (select rater_a, rater_b, draw, min(v) lo, max(v) hi, count(*) q, sum(m) / 2 n, sum(m * m) mm from dm group by all),
dw as (select x.rater_a, x.rater_b, x.draw, sum(1 - (x.v - y.v) ** 2 / (hi - lo) ** 2) tw from dm x join dm y on x.rater_a = y.rater_a and x.rater_b = y.rater_b and x.draw = y.draw join ds on x.rater_a = ds.rater_a and x.rater_b = ds.rater_b and x.draw = ds.draw group by all),
dp as (select d.rater_a, d.rater_b, d.draw, sum((1 - ((v).va::double - (v).vb::double) ** 2 / (hi - lo) ** 2) * w) / sum(w) pa from drw d join ds on d.rater_a = ds.rater_a and d.rater_b = ds.rater_b and d.draw = ds.draw group by all),
x as (select rater_a, rater_b, draw, pa, tw / (q * (q - 1)) * (1 - mm / (4 * n * n)) pe from ds join dw using (rater_a, rater_b, draw) join dp using (rater_a, rater_b, draw)),
i as (select rater_a, rater_b, (pa - pe) / (1 - pe) a from x)
select rater_a, rater_b, g.n, round((g.pa - g.pe) / (1 - g.pe), 6) ac2, round(avg(a), 6) mean, round(stddev_pop(a), 6) stddev, count(a) num_samples, round(quantile_cont(a, 0.025), 6) ci_lower, round(quantile_cont(a, 0.975), 6) ci_upper from i join g using (rater_a, rater_b) group by all""")
def q_bootstrap_ac2_cells(spark, d):
    """AC2 of each pair of raters with intervals from 1,000 draws of its contingency cells."""
    out = bootstrap.ac2_from_cells(agreement.rater_pairs(views.ratings(spark, d), "max"))
    return rounded(out, "ac2", "mean", "stddev", "ci_lower", "ci_upper")


@query(f"{R}, a as (select tag, avg(rating) m, count(*) n from r group by 1), b as (select tag, avg(rating) m, count(*) n from r where rater = 'primary_a' group by 1) select 'all' run, tag, round(m, 6) mean, n num_samples from a union all select 'primary_a', tag, round(m, 6), n from b")
def q_runs_together(spark, d):
    """Results of several runs as one frame."""
    rows = views.ratings(spark, d)
    frames = {"all": rows, "primary_a": rows.filter("rater = 'primary_a'")}
    return rounded(bootstrap.compare({name: bootstrap.intervals(df, ["tag"], "rating") for name, df in frames.items()}).select("run", "tag", "mean", "num_samples"), "mean")


@query(f"{O}, p as (select prediction_name as name, avg(mean) m from o group by 1) select 'auc' metric, name, 0.5::double baseline from p union all select 'auprc', name, round(m, 6) from p")
def q_random_baseline(spark, d):
    """What a random guess reaches: one half, or the prevalence."""
    prevalence = views.predictions(spark, d).groupBy(F.col("prediction_name").alias("Target")).agg(F.avg("mean").alias("mean"))
    both = [outcomes.random_baseline(m, prevalence).withColumn("metric", F.lit(m)) for m in ("auc", "auprc")]
    return rounded(both[0].unionByName(both[1]).withColumnRenamed("Target", "name"), "baseline")


# ---- small functions


@query("select url, regexp_extract(split_part(url, '/', -1), '^(.*?)(\\.[^./]*)?$', 1) base from pages")
def q_base_names(spark, d):
    return views.table(spark, d, "pages").select("url", scalar.base_name(F.col("url")).alias("base"))


@query("select c_name, replace(replace(case when c_custkey % 2 = 0 then 'Sleep ' else 'Fitness ' end || c_name, 'Sleep ', ''), 'Fitness ', '') label, case when length(c_custkey::varchar) >= 4 then c_custkey::varchar else lpad(c_custkey::varchar, 4, '0') end padded from customer")
def q_labels_without_vertical(spark, d):
    rows = views.table(spark, d, "customer")
    label = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Sleep ").otherwise("Fitness "), F.col("c_name"))
    return rows.select("c_name", scalar.strip_vertical(label).alias("label"), scalar.zero_padded(F.col("c_custkey")).alias("padded"))


@query("select doc_id, md5(text) text_md5, length(text) n from documents where text is not null")
def q_decoded_texts(spark, d):
    """Texts that come as bytes."""
    rows = views.table(spark, d, "documents").filter("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return rows.select("doc_id", scalar.utf8(F.col("raw")).alias("text")).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


@query(f"{R}, a as (select tag, conversation_source, count(*) n, sum(rating)::bigint total from r group by all) select tag, conversation_source, n, total from a")
def q_sections_from_one_pass(spark, d):
    """Counts and sums per cell, from which every mean follows."""
    return ratings_stats.cells(views.ratings(spark, d)).groupBy(F.col("g").alias("tag"), F.col("s").alias("conversation_source")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("total"))
