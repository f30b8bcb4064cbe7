"""Model calls: a factory makes one client per task, rows go through in Arrow batches."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.operators.checks import ConstraintError
from ratewell.sources import manifest
from ratewell.sources.readers import inference_path


class LanguageModel(Protocol):
    def generate(self, prompt: str, **options) -> list[str]: ...

    def score(self, prompt: str, completion: str, **options) -> float: ...


ModelFactory = Callable[[], LanguageModel]


def model_options(temperature: float | None = None, max_decode_steps: int | None = None) -> dict[str, float]:
    """Options of model calls; what isn't given isn't passed on."""
    return {k: v for k, v in (("temperature", temperature), ("max_decode_steps", max_decode_steps)) if v is not None}


class HashModel:
    """A stand-in for tests: answers and log probabilities from an md5 of the prompt."""

    def __init__(self, letters: str = "ABCDE"):
        self.letters = letters

    @staticmethod
    def share(text: str) -> float:
        return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 1) / 2**32

    def generate(self, prompt: str, **options) -> list[str]:
        key = prompt + "".join(f"|{k}={v}" for k, v in sorted(options.items()))
        letter = self.letters[int(hashlib.md5(key.encode()).hexdigest()[:4], 16) % len(self.letters)]
        return [f"Reasoning. <answer>({letter})</answer>"]

    def score(self, prompt: str, completion: str, **options) -> float:
        return math.log(self.share(f"{prompt}|{completion}"))


def _new(df: DataFrame, *names: str) -> None:
    if taken := sorted(set(names) & set(df.columns)):
        raise ConstraintError(f"columns are there already: {taken}")


def _scores(client: LanguageModel, prompts: Sequence[str], completions: Sequence[str], options: Mapping) -> list[float]:
    """Log probability of each prompt's completion. A client that has ``score_batch`` gets all at once."""
    if hasattr(client, "score_batch"):
        return list(client.score_batch(list(prompts), list(completions), **options))
    return [client.score(p, c, **options) for p, c in zip(prompts, completions, strict=True)]


def _texts(client: LanguageModel, prompts: Sequence[str], options: Mapping) -> list[list[str]]:
    """Texts for each prompt. A client that has ``generate_batch`` gets all prompts at once."""
    return list(client.generate_batch(list(prompts), **options)) if hasattr(client, "generate_batch") else [client.generate(p, **options) for p in prompts]


def _scored(completions: Sequence[str], options: Mapping) -> Callable[[LanguageModel, Sequence[str]], list[tuple]]:
    def call(client: LanguageModel, prompts: Sequence[str]) -> list[tuple]:
        pairs = [(p, c) for p in prompts for c in completions]
        found = _scores(client, [p for p, _ in pairs], [c for _, c in pairs], options)
        return [tuple(found[i : i + len(completions)]) for i in range(0, len(found), len(completions))]

    return call


def _generated(options: Mapping) -> Callable[[LanguageModel, Sequence[str]], list[tuple]]:
    def call(client: LanguageModel, prompts: Sequence[str]) -> list[tuple]:
        texts = _texts(client, prompts, options)
        for t in texts:
            if len(t) != 1:
                raise ValueError(f"one text expected, got {len(t)}")
        return list(zip((t[0] for t in texts), _scores(client, prompts, [t[0] for t in texts], options), strict=True))

    return call


GENERATED = {"inference_text_output": "string", "inference_score_output": "float"}
LIKERT = ("1", "2", "3", "4", "5")


def _score_columns(completions: Sequence[str]) -> dict[str, str]:
    return {f"inference_score_option_{i}": "float" for i in range(1, len(completions) + 1)}


def score_options(df: DataFrame, model: ModelFactory, prompt: str = "inputs", completions: tuple[str, ...] = LIKERT, options: Mapping[str, float] | None = None) -> DataFrame:
    """Adds inference_score_option_1 .. n (float): the model's log probability of each completion."""
    added = _score_columns(completions)
    _new(df, *added)
    return _apply(df, _scored(completions, options or {}), model, prompt, added)


def generate_answers(df: DataFrame, model: ModelFactory, prompt: str = "inputs", options: Mapping[str, float] | None = None) -> DataFrame:
    """Adds inference_text_output and inference_score_output (float); a model must give exactly one text."""
    _new(df, *GENERATED)
    return _apply(df, _generated(options or {}), model, prompt, GENERATED)


def run_inference(df: DataFrame, model: ModelFactory, method: str, prompt: str = "inputs", partitions: int | None = None, options: Mapping[str, float] | None = None) -> DataFrame:
    """Scores or generates. ``partitions`` limits the calls that run at once; ``options``: see model_options(). Empty prompts are an error."""
    if partitions:
        df = df.repartition(partitions)
    given = F.when(F.coalesce(F.length(prompt), F.lit(0)) > 0, F.col(prompt)).otherwise(F.raise_error(F.lit(f"empty {prompt}")))
    df = df.withColumn(prompt, given)
    if method == "score":
        return score_options(df, model, prompt, options=options)
    if method == "generate":
        return generate_answers(df, model, prompt, options)
    raise NotImplementedError(method)


def _apply(df: DataFrame, call: Callable, model: ModelFactory, prompt: str, added: dict[str, str]) -> DataFrame:
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` {t}" for n, t in added.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for batch in batches:
            rows = call(client, list(batch[prompt]))
            yield batch.assign(**{n: [r[k] for r in rows] for k, n in enumerate(added)})

    return df.mapInPandas(run, schema)


def run_with_ledger(
    df: DataFrame, key: str, model: ModelFactory, method: str, ledger: str, prompt: str = "inputs", options: Mapping[str, float] | None = None, partitions: int | None = None, batch: int = 64
) -> DataFrame:
    """Like run_inference(), for runs that are dear: answers are kept in the folder ``ledger`` as soon as they are there, and
    a run that broke off goes on where it was. Prompts have a unique ``key``.

    A task writes a small file after each ``batch`` of answers, under a name made of what was asked. A later run leaves out
    what the ledger holds (a left anti join on key and a digest of prompt, method and options, so that changed prompts are
    asked again). A task that Spark repeats within a run meets the same batches in the same order and takes the answers it
    finds under their names, so a lost executor costs one batch per task at most. The folder is shared by all executors.
    """
    calls = {"score": (_scored(LIKERT, options or {}), _score_columns(LIKERT)), "generate": (_generated(options or {}), GENERATED)}
    if method not in calls:
        raise NotImplementedError(method)
    call, added = calls[method]
    _new(df, *added, "asked")
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    said = repr((method, sorted((options or {}).items())))
    asked = F.sha2(F.concat_ws("|", F.lit(said), F.col(prompt)), 256)
    given = F.when(F.coalesce(F.length(prompt), F.lit(0)) > 0, F.col(prompt)).otherwise(F.raise_error(F.lit(f"empty {prompt}")))
    schema = f"`{key}` {kind}, asked string, " + ", ".join(f"{n} {t}" for n, t in added.items())
    store, base = manifest.opened(ledger)
    store.create_dir(base, recursive=True)

    def answers() -> DataFrame:
        return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(ledger).dropDuplicates([key, "asked"])

    rows = df.select(key, given.alias("_prompt")).withColumn("asked", F.sha2(F.concat_ws("|", F.lit(said), F.col("_prompt")), 256))
    left = rows.join(answers().select(key, "asked"), [key, "asked"], "left_anti")
    tasks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, (files, place) = None, manifest.opened(ledger)
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                name = hashlib.sha256("".join(part.column("asked").to_pylist()).encode()).hexdigest()
                if files.get_file_info(f"{place}/{name}.parquet").type == fs.FileType.NotFound:
                    client = client or model()
                    found = call(client, part.column("_prompt").to_pylist())
                    kinds = {"string": pa.string(), "float": pa.float32()}
                    columns = [pa.array([r[k] for r in found], kinds[t]) for k, t in enumerate(added.values())]
                    table = pa.table([part.column(key), part.column("asked"), *columns], names=[key, "asked", *added])
                    temporary = f"{place}/_{uuid.uuid4().hex}"
                    with files.open_output_stream(temporary, compression=None) as out:
                        pq.write_table(table, out)
                    files.move(temporary, f"{place}/{name}.parquet")
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows])], names=["n"])

    left.repartition(tasks, key).sortWithinPartitions(key).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    return df.withColumn("asked", asked).join(answers(), [key, "asked"]).drop("asked").select(*df.columns, *added)


def best_option(df: DataFrame, n: int = 5) -> DataFrame:
    """Adds ``predicted_rating``: the option with the highest score, the first of equals. (Our addition.)"""
    scores = [F.struct(F.col(f"inference_score_option_{i}").alias("score"), F.lit(-i).alias("i")) for i in range(1, n + 1)]
    return df.withColumn("predicted_rating", -F.array_max(F.array(*scores))["i"])


def runs(spark: SparkSession, root: str, model: str, day: str, verticals: Sequence[str], splits: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """(vertical, split, method, path): every run of a model, as rows of one frame instead of nested loops."""
    rows = [(v, s, m, inference_path(root, v, model, s, day, m)) for v in verticals for s in splits for m in methods]
    return spark.createDataFrame(rows, "vertical string, split string, method string, path string")


def runs_of(models: DataFrame, root: str, day: str, verticals: Sequence[str], splits: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """(model, vertical, split, method, path): likewise of every model in a table (column ``model``), a few rows for each."""
    grid = runs(models.sparkSession, root, "{model}", day, verticals, splits, methods)
    path = F.replace("path", F.lit("{model}"), F.col("model"))
    return models.select("model").distinct().crossJoin(F.broadcast(grid)).select("model", "vertical", "split", "method", path.alias("path"))
