"""Multiple-choice exams: prompts, answers from scores, texts or votes, and accuracy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell import fixed_values as fixed
from ratewell.functions.scalar import answer_in, fill
from ratewell.operators.inference import ModelFactory
from ratewell.sources.scratch import saved
from ratewell.sources.sinks import write_results


def option_text(choices: Column) -> Column:
    return F.array_join(F.array_sort(F.map_keys(choices)), ", ")


def score_prompt(question: Column, choices: Column, domain: Column) -> Column:
    return F.concat(fill(fixed.EXAM_INSTRUCTION, {"domain": domain, "options": option_text(choices)}), question)


def answer_prompt(question: Column, choices: Column, domain: Column, kind: str, templates: Mapping[tuple[str, str], str] = fixed.EXAM_TEMPLATES) -> Column:
    """The prompt of a kind ("cot", "step_back") by domain; an error for a domain without a template."""
    values = {"mcq_question": F.regexp_replace(question, r"^\s+|\s+$", ""), "mcq_options": option_text(choices), "domain": domain}
    out = F.raise_error(F.concat(F.lit(f"no {kind} template for "), F.coalesce(domain, F.lit("null")))).cast("string")
    for (k, d), template in templates.items():
        if k == kind:
            out = F.when(domain == d, fill(template, values)).otherwise(out)
    return out


def _ask(df: DataFrame, model: ModelFactory, added: str, kind: str, call: Callable) -> DataFrame:
    """Adds what ``call`` gets from a client (one for each task) for each row, a dict of its columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {added} {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for batch in batches:
            yield batch.assign(**{added: [call(client, row) for row in batch.to_dict("records")]})

    return df.mapInPandas(run, schema)


def by_score(exam: DataFrame, model: ModelFactory) -> DataFrame:
    """Adds model_scores (of each letter, in order) and model_answer: the letter with the highest, the first of equals."""
    asked = exam.withColumn("options", F.array_sort(F.map_keys("choices"))).withColumn("prompt", score_prompt(F.col("question"), F.col("choices"), F.col("domain")))
    scored = _ask(asked, model, "model_scores", "array<double>", lambda m, row: [m.score(row["prompt"], x) for x in row["options"]])
    ranked = F.array_max(F.zip_with("model_scores", F.transform("options", lambda x, i: F.struct((-i).alias("i"), x.alias("letter"))), lambda s, o: F.struct(s.alias("s"), o["i"].alias("i"), o["letter"].alias("letter"))))
    return graded(scored.withColumn("model_answer", ranked["letter"])).drop("prompt")


def by_text(exam: DataFrame, model: ModelFactory, kind: str = "cot", templates: Mapping = fixed.EXAM_TEMPLATES, letters: str = "ABCDE", options: Mapping | None = None) -> DataFrame:
    """Adds model_generations and model_answer: the most frequent letter among them, of equals the first letter."""
    asked = exam.withColumn("prompt", answer_prompt(F.col("question"), F.col("choices"), F.col("domain"), kind, templates))
    told = _ask(asked, model, "model_generations", "array<string>", lambda m, row: list(m.generate(row["prompt"], **(options or {}))))
    answers = F.filter(F.transform("model_generations", lambda g: answer_in(g, letters)), lambda a: a.isNotNull())
    counted = F.transform(F.array_sort(F.array_distinct(answers)), lambda a, i: F.struct(F.size(F.filter(answers, lambda b: b == a)).alias("n"), (-i).alias("i"), a.alias("a")))
    return graded(told.withColumn("model_answer", F.array_max(counted)["a"])).drop("prompt")


def majority(generations: DataFrame, key: str, order: str, text: str, letters: str = "ABCDE") -> DataFrame:
    """(key, vote, generation): the letter with strictly more answers than any other, and the first text that gives it.

    Texts without an answer don't count. Without a strict winner there is no row.
    """
    answers = generations.withColumn("a", answer_in(F.col(text), letters)).filter("a is not null")
    counts = answers.groupBy(key, "a").agg(F.count(F.lit(1)).alias("n"), F.min_by(text, order).alias("generation"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "a")
    ranked = counts.withColumn("place", F.row_number().over(best)).withColumn("next", F.coalesce(F.lead("n").over(best), F.lit(0)))
    return ranked.filter("place = 1 and n > next").select(key, F.col("a").alias("vote"), "generation")


#: Stands in the place of generations where no answer leads.
NO_MAJORITY = "no_majority_vote"


def by_vote(
    exam: DataFrame, key: str, model: ModelFactory, rounds: int = 5, kind: str = "cot", templates: Mapping = fixed.EXAM_TEMPLATES, letters: str = "ABCDE", options: Mapping | None = None, seed_option: str | None = None
) -> DataFrame:
    """Adds model_answer, voted and model_generation: the majority of ``rounds`` answers in words to one and the same
    prompt, and the first text that gives it; where none leads, the answer by score and NO_MAJORITY.

    seed_option: the option under which a round's number goes to models that would repeat themselves otherwise. Only
    questions without a majority are scored.
    """
    prompt = answer_prompt(F.col("question"), F.col("choices"), F.col("domain"), kind, templates)
    asked = exam.select(key, prompt.alias("prompt")).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    told = _ask(asked, model, "model_generations", "array<string>", lambda m, row: list(m.generate(row["prompt"], **(options or {}), **({seed_option: row["round"]} if seed_option else {}))))
    single = told.select(key, "round", F.posexplode("model_generations").alias("place", "text")).withColumn("order", F.struct("round", "place"))
    votes = saved(majority(single, key, "order", "text", letters))  # read twice, so that the model is asked once
    voted = exam.join(votes, key).withColumns({"model_answer": F.col("vote"), "model_generation": F.col("generation"), "voted": F.lit(True)}).drop("vote", "generation")
    scored = by_score(exam.join(votes, key, "left_anti"), model).drop("correct", "incorrect", "skipped", "model_scores", "options")
    scored = scored.withColumns({"model_generation": F.lit(NO_MAJORITY), "voted": F.lit(False)})
    return graded(voted.unionByName(scored.select(voted.columns)))


def graded(df: DataFrame) -> DataFrame:
    """Adds correct, incorrect and skipped (no answer found)."""
    right = F.col("model_answer") == F.col("answer")
    return df.withColumns({"correct": F.coalesce(right, F.lit(False)).cast("int"), "incorrect": F.coalesce(~right, F.lit(False)).cast("int"), "skipped": F.col("model_answer").isNull().cast("int")})


def evaluate(exam: DataFrame, key: str, model: ModelFactory, method: str = "score", path: str | None = None, overwrite: bool = False, **how) -> DataFrame:
    """Answers of a whole exam by "score", "generate" or "self_consistency"; always a frame. With ``path`` they are also
    saved as CSV, numbered in the order of ``key``."""
    ways = {"score": lambda: by_score(exam, model), "generate": lambda: by_text(exam, model, **how), "self_consistency": lambda: by_vote(exam, key, model, **how)}
    if method not in ways:
        raise NotImplementedError(method)
    results = ways[method]()
    if path:
        write_results(results, path, key, overwrite)
    return results


def accuracy(results: DataFrame, skipped_is_wrong: bool = True) -> DataFrame:
    """(stratum, correct, incorrect, accuracy) for All and each difficulty; accuracy is null without answers."""
    wrong = F.col("incorrect") + F.col("skipped") * int(skipped_is_wrong)
    sums = results.rollup("difficulty").agg(F.sum("correct").alias("correct"), F.sum(wrong).alias("incorrect"), F.grouping("difficulty").alias("all"))
    named = sums.filter("all = 1 or difficulty is not null").withColumn("stratum", F.when(F.col("all") == 1, "All").otherwise(F.col("difficulty")))
    share = F.col("correct") / F.nullif(F.col("correct") + F.col("incorrect"), F.lit(0))
    return named.select("stratum", "correct", "incorrect", share.alias("accuracy")).orderBy("stratum")


def top_answers(generations: DataFrame, key: str, text: str, n: int = 2, letters: str = "ABCDE") -> DataFrame:
    """(key, answer, n, place): the n most frequent answers of each question, of equals the first letter."""
    counts = generations.select(key, answer_in(F.col(text), letters).alias("answer")).dropna(subset=["answer"]).groupBy(key, "answer").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "answer"))).filter(F.col("place") <= n)


def first_examples(exam: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by ``order``; all if n is negative."""
    return exam if n < 0 else exam.orderBy(order).limit(n)
