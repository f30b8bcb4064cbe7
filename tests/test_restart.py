"""Runs that break half-way: model calls that go on where they were, and files that appear all at once."""

import os

import pytest
from pyspark.sql import functions as F

from ratewell.operators import inference
from ratewell.sources import readers, sinks


def counted(folder):
    """A model that writes down every prompt it is asked, and breaks at one of them while a file says so."""

    class Counted(inference.HashModel):
        def generate_batch(self, prompts, **options):
            if "p33" in prompts and os.path.exists(f"{folder}/break"):
                raise RuntimeError("lost")
            with open(f"{folder}/asked-{os.getpid()}", "a") as f:
                f.writelines(p + "\n" for p in prompts)
            return [self.generate(p, **options) for p in prompts]

    return Counted


def asked(folder):
    return sorted(x for f in os.listdir(folder) if f.startswith("asked") for x in open(f"{folder}/{f}").read().split())


def test_a_broken_run_asks_each_prompt_once(spark, tmp_path):
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    (calls / "break").touch()
    folder = str(calls)
    df = spark.createDataFrame([(i, f"p{i}") for i in range(60)], "k int, inputs string").repartition(4)
    run = lambda rows, **how: inference.run_with_ledger(rows, "k", counted(folder), "generate", ledger, batch=5, partitions=4, **how)
    with pytest.raises(Exception, match="lost"):
        run(df)
    some = asked(folder)
    assert 0 < len(some) < 60
    (calls / "break").unlink()
    got = run(df).collect()
    assert asked(folder) == sorted(f"p{i}" for i in range(60))
    want = inference.generate_answers(df, inference.HashModel).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    run(df.union(spark.createDataFrame([(60, "p60")], df.schema)))
    assert asked(folder) == sorted(f"p{i}" for i in range(61))
    run(df.filter("k = 1").withColumn("inputs", F.lit("other")))  # a prompt that changed is asked
    assert len(asked(folder)) == 62
    scores = inference.run_with_ledger(df, "k", inference.HashModel, "score", ledger).collect()
    assert sorted(map(tuple, scores)) == sorted(map(tuple, inference.score_options(df, inference.HashModel).collect()))


def test_repeated_tasks_take_what_they_find(spark, tmp_path):
    """The same batches meet the same names, so a second run over an equal ledger without the anti join asks nothing."""
    calls = tmp_path / "c"
    calls.mkdir()
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "k int, inputs string")
    folder, ledger = str(calls), str(tmp_path / "l")
    inference.run_with_ledger(df, "k", counted(folder), "generate", ledger, batch=4, partitions=2)
    names = {f for f in os.listdir(ledger) if f.endswith(".parquet")}
    other = str(tmp_path / "m")
    inference.run_with_ledger(df, "k", inference.HashModel, "generate", other, batch=4, partitions=2)
    assert {f for f in os.listdir(other) if f.endswith(".parquet")} == names
    with pytest.raises(Exception, match="empty inputs"):
        inference.run_with_ledger(df.withColumn("inputs", F.lit("")), "k", inference.HashModel, "generate", str(tmp_path / "n"))
    with pytest.raises(NotImplementedError):
        inference.run_with_ledger(df, "k", inference.HashModel, "sing", ledger)


SPLITS = [("b", "train"), ("a", "train"), ("c", "test"), ("d", "validation")]


def files_of(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.startswith("."))


@pytest.mark.parametrize("fails", ["write", "rename"])
def test_split_files_appear_all_or_none(spark, tmp_path, monkeypatch, fails):
    root, df = str(tmp_path), spark.createDataFrame(SPLITS, "case_study_id string, split string")
    place = readers.split_path(root, "sleep", "train", "2024-01-02")
    calls, rename = [], sinks.rename

    def third(spark, source, target):
        calls.append(source)
        if len(calls) == 3:
            raise OSError("stop")
        return rename(spark, source, target)

    if fails == "rename":
        monkeypatch.setattr(sinks, "rename", third)
        bad = df
    else:
        bad = df.withColumn("case_study_id", F.when(F.col("split") == "validation", F.raise_error(F.lit("stop"))).otherwise(F.col("case_study_id")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_split_files(bad, root, "sleep", "2024-01-02")
    assert files_of(root) == []
    monkeypatch.setattr(sinks, "rename", rename)
    sinks.write_split_files(df, root, "sleep", "2024-01-02")
    before = files_of(root)
    assert sorted(map(tuple, readers.splits(spark, root, "sleep", "2024-01-02", ("train", "test", "validation")).collect())) == sorted(SPLITS) and os.path.isdir(place)
    calls.clear()
    if fails == "rename":
        monkeypatch.setattr(sinks, "rename", third)
    with pytest.raises(Exception, match="stop"):
        sinks.write_split_files(bad, root, "sleep", "2024-01-02", overwrite=True)
    assert files_of(root) == before  # what was there is there again
