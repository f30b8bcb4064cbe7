"""Grading prompts and targets from conversations, and the joins that lead to them.

Keys are joined first and the template is rendered last, so its kilobytes don't go through a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ratewell import fixed_values as fixed
from ratewell.functions.scalar import fill, lookup, message_text
from ratewell.operators.checks import ConstraintError, all_of, found
from ratewell.sources.sinks import removed, repeated, write_examples


def principle_table(spark: SparkSession) -> DataFrame:
    """(principle, criterion, option_1 .. option_5): 15 rows, to be broadcast."""
    rows = [(p, criterion, *options) for p, (criterion, options) in fixed.PRINCIPLES.items()]
    return spark.createDataFrame(rows, "principle string, criterion string, " + ", ".join(f"option_{i} string" for i in range(1, 6)))


def tag_table(spark: SparkSession, vertical: str) -> DataFrame:
    """(tag, tag_label, objective) of a vertical."""
    return spark.createDataFrame([(t, label, fixed.OBJECTIVES[vertical][t]) for t, label in fixed.TAG_LABELS[vertical].items()], "tag string, tag_label string, objective string")


def grading_prompt(vertical: Column, case_text: Column, answer: Column) -> Column:
    """The prompt from columns tag_label, objective, criterion, option_1 .. option_5. A null prints as None."""
    values = {"VERTICAL": vertical, "TAG_LABEL": F.col("tag_label"), "OBJECTIVE": F.col("objective"), "CASE_STUDY_DATA": case_text, "ASSISTANT_TEXT": answer, "PRINCIPLE_CRITERIA": F.col("criterion")}
    return fill(fixed.GRADING_PROMPT, values | {f"OPTION_{i}": F.col(f"option_{i}") for i in range(1, 6)})


def target(rating: Column) -> Column:
    """``<n>. <text of option n><stop>``; an error outside 1 to 5."""
    options = F.array(*(F.col(f"option_{i}") for i in range(1, 6)))
    text = F.when(rating.between(1, 5), F.get(options, (rating - 1).cast("int"))).otherwise(F.raise_error(F.concat(F.lit("rating must be 1 to 5: "), F.coalesce(rating.cast("string"), F.lit("null")))))
    return F.concat(rating.cast("string"), F.lit(". "), text, F.lit(fixed.TARGET_END))


def expand(conversations: DataFrame, tags: Sequence[str], principles: Sequence[str] = fixed.PRINCIPLE_ORDER) -> DataFrame:
    """Each conversation with every tag and principle: 60 rows for four tags and 15 principles."""
    spark = conversations.sparkSession
    grid = spark.createDataFrame([(t, p) for t in tags for p in principles], "tag string, principle string")
    return conversations.crossJoin(F.broadcast(grid))


def candidate_prompts(candidates: DataFrame, experts: DataFrame, vertical: str, principles: Sequence[str] = fixed.PRINCIPLE_ORDER) -> DataFrame:
    """(vertical, case_study_id, conversation_id, inputs, tag, principle) for grading candidates.

    The user's data come from the expert's conversation on the same case, the answer from the candidate's. A case
    without an expert conversation is an error.
    """
    spark = candidates.sparkSession
    both = candidates.join(experts.select("case_study_id", F.col("messages").alias("expert_messages")), "case_study_id", "left")
    both = both.withColumn("expert_messages", F.coalesce("expert_messages", F.raise_error(F.concat(F.lit("no expert conversation: "), F.col("case_study_id"))).cast(experts.schema["messages"].dataType)))
    rows = expand(both, list(fixed.TAG_LABELS[vertical]), principles)
    rows = rows.join(F.broadcast(tag_table(spark, vertical)), "tag").join(F.broadcast(principle_table(spark)), "principle")
    case_text = message_text(F.col("expert_messages"), F.col("tag"), F.lit("USER"))
    answer = message_text(F.col("messages"), F.col("tag"), F.lit("ASSISTANT"))
    prompt = grading_prompt(F.lit(vertical), case_text, answer)
    return rows.select(F.lit(vertical).alias("vertical"), "case_study_id", "conversation_id", prompt.alias("inputs"), "tag", "principle")


#: What a rating can lack to become an example, in the order in which it is looked for.
PROBLEMS = ("no split", "no conversation", "no conversation of the expert", "unknown tag", "unknown principle")


#: Columns of a rating that its example depends on; ratings equal in all of them have the same example.
RATING = ("case_study_id", "conversation_id", "conversation_source", "rater", "tag", "principle", "rating")


def _matched(ratings: DataFrame, splits: DataFrame, conversations: DataFrame, vertical: str, user_text_from: str, cases: DataFrame | None) -> DataFrame:
    """Ratings beside their split, conversations, tag and principle; ``problem`` is the first of PROBLEMS, or null.

    Equal ratings are one row, and ``copies`` says how many they are. Splits and messages are joined to the rated
    conversations first, each of which is one row; ratings meet those rows once, so messages don't go through a shuffle with
    them.
    """
    spark = ratings.sparkSession
    counted = ratings.groupBy(*RATING).agg(F.count(F.lit(1)).alias("copies"))
    own = conversations.select("conversation_source", "case_study_id", "messages")
    source = F.lit("human_expert") if user_text_from == "expert" else F.col("conversation_source")
    user = own.select(F.col("conversation_source").alias("user_source"), "case_study_id", F.col("messages").alias("user_messages"))
    rated = counted.select("conversation_source", "case_study_id").distinct().withColumn("user_source", source)
    if cases is not None:
        rated = rated.join(cases.select("case_study_id"), "case_study_id", "left_semi")
    rated = rated.join(splits.select("case_study_id", "split"), "case_study_id", "left").join(own, ["conversation_source", "case_study_id"], "left").join(user, ["user_source", "case_study_id"], "left")
    df = counted.join(rated, ["conversation_source", "case_study_id"], "left" if cases is None else "inner")
    df = df.join(F.broadcast(tag_table(spark, vertical)), "tag", "left").join(F.broadcast(principle_table(spark)), "principle", "left")
    found = [F.when(F.col(c).isNull(), F.lit(p)) for c, p in zip(("split", "messages", "user_messages", "tag_label", "criterion"), PROBLEMS, strict=True)]
    return df.withColumn("problem", F.coalesce(*found))


def _rendered(df: DataFrame, vertical: str) -> DataFrame:
    case_text = message_text(F.col("user_messages"), F.col("tag"), F.lit("USER"))
    answer = message_text(F.col("messages"), F.col("tag"), F.lit("ASSISTANT"))
    return df.select(
        F.lit(vertical).alias("vertical"), "case_study_id", "conversation_id", grading_prompt(F.lit(vertical), case_text, answer).alias("inputs"), target(F.col("rating")).alias("targets"),
        "rater", "conversation_source", "tag", "principle", F.col("rating").cast("bigint").alias("rating"), "split", "copies",
    )


def rating_examples(ratings: DataFrame, splits: DataFrame, conversations: DataFrame, vertical: str, user_text_from: str = "expert", cases: DataFrame | None = None, copies: bool = False) -> DataFrame:
    """Grading examples with inputs, targets and split, from ratings of conversations.

    user_text_from: "expert" takes the user's data from the human expert's conversation on the case, "own" from the
    rated one. ``cases`` restricts to known case studies. A rating whose case has no split, whose conversation isn't there,
    or whose tag or principle isn't known, is an error that names it: no example is lost silently. To go on without such
    ratings, and know how many they were, see counted_examples(). Equal ratings are rendered once and have a row each, or,
    with ``copies``, one row and a column of that name; writers write it as often (sinks.repeated).
    """
    df = _matched(ratings, splits, conversations, vertical, user_text_from, cases)
    said = F.concat_ws(" ", F.col("problem"), F.lit("for the rating of"), F.concat_ws("::", "case_study_id", "conversation_source", "rater", "tag", "principle"))
    split = F.when(F.col("problem").isNull(), F.col("split")).otherwise(F.raise_error(said).cast("string"))
    out = _rendered(df.withColumn("split", split), vertical)
    return out if copies else repeated(out)


def counted_examples(ratings: DataFrame, splits: DataFrame, conversations: DataFrame, vertical: str, user_text_from: str = "expert", cases: DataFrame | None = None, copies: bool = False) -> tuple[DataFrame, Observation]:
    """The examples of rating_examples() without the ratings that lack something, and an observation that counts both.

    The counts (columns ``examples`` and each of PROBLEMS) are made in the pass that writes or otherwise consumes the
    examples and are there when it has ended; nothing is read twice. They are exact unless a lost executor makes Spark run
    part of the pass again, which can count its rows twice; the examples themselves are right in any case.
    """
    counts = Observation()
    ok = F.col("problem").isNull()
    df = _matched(ratings, splits, conversations, vertical, user_text_from, cases)
    # A condition that always holds, but that Spark can't know: where it knows that no rating has an example (an empty table
    # of splits), it would leave out the pass, and the counts with it.
    df = df.withColumn("problem", F.when(F.rand() >= 0, F.col("problem")))
    df = df.observe(counts, _copies(ok).alias("examples"), *(_copies(F.col("problem") == p).alias(p) for p in PROBLEMS))
    out = _rendered(df.filter(ok), vertical)
    return out if copies else repeated(out), counts


def _copies(which: Column) -> Column:
    """How many ratings stand behind the rows where ``which`` holds."""
    return F.coalesce(F.sum(F.when(which, F.col("copies"))), F.lit(0))


def write_matched_examples(ratings: DataFrame, splits: DataFrame, conversations: DataFrame, vertical: str, path: str, allowed: int = 0, overwrite: bool = False, **how) -> dict[str, int]:
    """Writes counted_examples() and returns the counts; more than ``allowed`` ratings without an example are an error, and
    nothing stays at the path."""
    examples, observed = counted_examples(ratings, splits, conversations, vertical, **how, copies=True)
    write_examples(examples, path, overwrite)
    try:
        counts = dict(observed.get)
    except Py4JJavaError:  # not one example: Spark then drops the pass from the plan it reports on, and its counts
        problems = _matched(ratings, splits, conversations, vertical, how.get("user_text_from", "expert"), how.get("cases")).groupBy("problem").agg(F.sum("copies").alias("count"))
        counts = {"examples": 0, **dict.fromkeys(PROBLEMS, 0), **{r.problem: r["count"] for r in problems.collect()}}
    lost = sum(counts[p] for p in PROBLEMS)
    if lost > allowed:
        removed(ratings.sparkSession, path)
        raise ConstraintError(f"{lost} ratings can't become examples: {counts}")
    return counts


def missing_parts(ratings: DataFrame, splits: DataFrame, conversations: DataFrame) -> DataFrame:
    """(check, item): ratings without a split, and ratings without their conversation."""
    return all_of(
        found(ratings.join(splits, "case_study_id", "left_anti"), "no split", F.col("case_study_id")),
        found(ratings.join(conversations, ["conversation_source", "case_study_id"], "left_anti"), "no conversation", F.concat_ws("::", "conversation_source", "case_study_id")),
    )


def options_of(rows: DataFrame) -> DataFrame:
    """Five rows per example: option and its target text, for scoring."""
    return rows.withColumn("option", F.explode(F.sequence(F.lit(1), F.lit(5))))


def report_tag(tag: Column) -> Column:
    """A grading tag by the name that reports use."""
    return F.coalesce(lookup(tag, fixed.TAG_ALIASES), tag)
