"""Writers; each fails if its target is there, unless told to overwrite."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell import fixed_values as fixed
from ratewell.functions.scalar import utf8
from ratewell.operators.prefix import numbered
from ratewell.sources.readers import split_path
from ratewell.sources.scratch import saved


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_splits(splits: DataFrame, path: str, id_col: str = "case_study_id", overwrite: bool = False) -> None:
    """One folder per split, ids sorted inside: its files are ranges of the ids, so a large split is several tasks. All splits
    are one write, so either all appear or none."""
    rows = splits.select(id_col, "split")
    ranges = int(splits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(ranges, "split", id_col).sortWithinPartitions("split", id_col).write.partitionBy("split").mode(_mode(overwrite)).csv(path, header=True)


def write_split_files(splits: DataFrame, root: str, vertical: str, day: str, id_col: str = "case_study_id", overwrite: bool = False) -> None:
    """A CSV of sorted ids for each split, under its dated name (readers.split_path): all of them, or none.

    All targets are looked at first. The splits are worked out once, every file is written in a staging folder beside the
    targets, and only when all are complete are they renamed. What fails, whether a write or a rename, leaves the targets as
    they were: files that were there before come back. Splits are known by name, so none are looked for; ids of one split are
    sorted across its part files."""
    spark = splits.sparkSession
    paths = {s: split_path(root, vertical, s, day) for s in fixed.SPLITS}
    if not overwrite and (there := [p for p in paths.values() if exists(spark, p)]):
        raise FileExistsError(there)
    staging = f"{root}/{vertical.lower()}/_staging-{uuid.uuid4().hex}"
    rows = saved(splits.select(id_col, "split"))
    try:
        for split in paths:
            rows.filter(F.col("split") == split).select(id_col).orderBy(id_col).write.csv(f"{staging}/new/{split}", header=True)
        moved: list[tuple[str, str]] = []
        try:
            for split, path in paths.items():
                if exists(spark, path):
                    moved.append(rename(spark, path, f"{staging}/old/{split}"))
                moved.append(rename(spark, f"{staging}/new/{split}", path))
        except Exception:
            for source, target in reversed(moved):
                rename(spark, target, source)
            raise
    finally:
        removed(spark, staging)


def rename(spark: SparkSession, source: str, target: str) -> tuple[str, str]:
    """Moves a file or folder, and returns both names; an error if it can't be moved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = path(target)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    if not files.rename(path(source), place):
        raise OSError(f"can't move {source} to {target}")
    return source, target


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def removed(spark: SparkSession, path: str) -> None:
    """Nothing is at the path any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def repeated(df: DataFrame) -> DataFrame:
    """Every row as often as its column ``copies`` says, without that column."""
    return df.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")).drop("copies", "_copy")


#: Files of one task that are open side by side; a task that meets more sorts its rows.
OPEN_FILES = 512


def write_examples(examples: DataFrame, path: str, overwrite: bool = False) -> None:
    """One folder per (rater, conversation_source, tag, principle). Rows meet by those keys and the case, so a large
    group is several files. Rows with a column ``copies`` are shuffled once and then written as often as it says."""
    keys = ["rater", "conversation_source", "tag", "principle"]
    spark, setting = examples.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    dealt = examples.repartition(*keys, F.pmod(F.xxhash64("case_study_id"), F.lit(8)))
    if "copies" in examples.columns:  # sorted here: equal texts stand together and are stored once in a file's dictionary
        dealt = repeated(dealt.sortWithinPartitions(*keys, "case_study_id"))
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(OPEN_FILES))  # Spark would sort the repeated rows for the folders, kilobytes each
    try:
        dealt.write.partitionBy(*keys).mode(_mode(overwrite)).parquet(path)
    finally:
        spark.conf.set(setting, before)


def write_tsv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Tab-separated with a header; binary columns as UTF-8 text."""
    texts = df.withColumns({f.name: utf8(F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() == "binary"})
    texts.write.mode(_mode(overwrite)).csv(path, sep="\t", header=True, escape='"')


def write_results(results: DataFrame, path: str, order_by: str, overwrite: bool = False) -> None:
    """CSV with a row number from 0 in the order of ``order_by``; arrays and maps as JSON. Numbers are given
    by ranges of the order, so no task sees all rows; rows of equal order are numbered by a hash."""
    nested = [f.name for f in results.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    flat = results.withColumns({c: F.to_json(c) for c in nested})
    rows = numbered(flat, [order_by]).select("index", *results.columns)
    rows.orderBy("index").write.mode(_mode(overwrite)).csv(path, header=True, escape='"')
