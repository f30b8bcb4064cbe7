"""Readers of ratings, splits, conversations, case studies, exams and outcome tables; and the names of their files."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell import fixed_values as fixed
from ratewell.sources import schemas


def one_of(name: str, allowed: tuple[str, ...]) -> str:
    """``name`` in lower case; ValueError unless it is one of ``allowed``."""
    if name.lower() not in {a.lower() for a in allowed}:
        raise ValueError(f"{name!r} is none of {allowed}")
    return name.lower()


def token(day: str) -> str:
    """An ISO date as YYYYMMDD."""
    return date.fromisoformat(day).strftime("%Y%m%d")


def ratings_path(root: str, vertical: str, day: str) -> str:
    return f"{root}/{one_of(vertical, fixed.VERTICALS)}/rater_responses.{token(day)}.tsv"


def split_path(root: str, vertical: str, split: str, day: str) -> str:
    return f"{root}/{one_of(vertical, fixed.VERTICALS)}/{one_of(split, fixed.SPLITS)}.{token(day)}.csv"


def inference_path(root: str, vertical: str, model: str, split: str, day: str, method: str) -> str:
    return f"{root}/{one_of(vertical, fixed.VERTICALS)}/{model}.{one_of(split, fixed.SPLITS)}.{token(day)}.{one_of(method, ('score', 'generate'))}.tsv"


def tsv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """multi_line: fields in quotes may hold line breaks; a file is then read by one task."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, escape='"', multiLine=multi_line)


def ratings(spark: SparkSession, root: str, vertical: str, day: str) -> DataFrame:
    return tsv(spark, ratings_path(root, vertical, day), schemas.RATINGS)


def expert_ratings(spark: SparkSession, path: str, auto_columns: tuple[str, ...] = ()) -> DataFrame:
    """Ratings by people, or with ``auto_columns`` a wide table that holds automatic ratings beside them."""
    if not auto_columns:
        return tsv(spark, path, schemas.EXPERT_RATINGS)
    return tsv(spark, path, schemas.EXPERT_RATINGS.replace("rating int", "rating_human_expert double") + "".join(f", {c} double" for c in auto_columns))


def splits(spark: SparkSession, root: str, vertical: str, day: str, names: tuple[str, ...] = ("train", "validation"), id_col: str = "case_study_id") -> DataFrame:
    """(id, split) of the named splits; a missing file is an error."""
    frames = [spark.read.csv(split_path(root, vertical, s, day), header=True, schema=f"{id_col} string").withColumn("split", F.lit(s)) for s in names]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def conversations(spark: SparkSession, root: str, vertical: str, source: str | None = None) -> DataFrame:
    """Nested conversations stored under vertical=/conversation_source=; a source is a partition, so others aren't read."""
    df = spark.read.parquet(root).filter(F.col("vertical") == one_of(vertical, fixed.VERTICALS))
    return df if source is None else df.filter(F.col("conversation_source") == source)


def examples(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """Grading examples stored under rater=/conversation_source=/tag=/principle=."""
    df = spark.read.parquet(root)
    return df if split is None else df.filter(F.col("split") == one_of(split, fixed.SPLITS))


def case_studies(spark: SparkSession, path: str, vertical: str) -> DataFrame:
    schema = {"sleep": schemas.SLEEP_CASE, "fitness": schemas.FITNESS_CASE}[one_of(vertical, fixed.VERTICALS)]
    return spark.read.json(path, schema=schema)


def exam(spark: SparkSession, path: str, domain: str | None = None, difficulties: tuple[str, ...] | None = None) -> DataFrame:
    """Questions with choices as a map and their letters in order. Line breaks inside quotes belong to the question."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=schemas.EXAM)
    df = df.withColumn("choices", F.from_json("choices", "map<string,string>", {"allowSingleQuotes": "true"})).withColumn("options", F.array_sort(F.map_keys("choices")))
    if domain is not None:
        df = df.filter(F.col("domain") == domain)
    return df if difficulties is None else df.filter(F.col("difficulty").isin(*difficulties))


def exam_rows(spark: SparkSession, rows: list[tuple[str, dict[str, str], str, str, str]]) -> DataFrame:
    """Questions given in code, as (question, choices, domain, difficulty, answer); choices become JSON text, as in files."""
    return spark.createDataFrame([(q, json.dumps(c), *rest) for q, c, *rest in rows], schemas.EXAM)


def exam_table(questions: DataFrame) -> DataFrame:
    """A table of questions, with choices as a map, as exam files hold it: choices as JSON text."""
    return questions.select("question", F.to_json("choices").alias("choices"), "domain", "difficulty", "answer")


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.OUTCOMES)


def prevalence(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.PREVALENCE)
