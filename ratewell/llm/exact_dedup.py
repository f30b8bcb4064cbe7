"""Exact duplicates: 128-bit content hash, bytes compared inside each hash group, one stable row kept.

Everything is DataFrame code; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.llm.texts import quoted

#: The letters that are folded, and what they fold to.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else. ASCII texts take the engine's byte-wise lower(); only others pay for translate()."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_case: bool = True, keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are keyed by a 128-bit content hash (MD5). The grouping key is (hash, bytes), so texts whose hashes
    collide fall apart by their bytes. Partial aggregation leaves one row per distinct text and task before the
    shuffle, so a text that fills a third of the table costs no more than one that occurs once per task. Only
    digests are joined back, by a join that can be split where a key is hot.

    keep: "max" or "min", the id that stays. Null text counts as empty. A null id never wins against another id;
    a group of null ids only has keep_id null and keeps all its rows, as rows without an id can't be told apart.
    Rows that repeat an id and its text are all reported, each with the same answer. An empty table gives an empty
    result. Other columns, whatever their names, are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), (fold_ascii(text) if fold_case else text).alias("_norm"))
    hashed = base.select("_id", "_norm", F.unhex(F.md5("_norm")).alias("_hash"), F.unhex(F.sha2("_norm", 256)).alias("_sha"))
    pick = F.max if keep == "max" else F.min
    classes = (
        hashed.groupBy("_hash", "_norm")
        .agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("_sha").alias("_sha"))
        .select(F.col("_hash").alias("_h"), F.col("_sha").alias("_s"), "keep_id", "group_size")
    )
    rows = hashed.select("_id", "_hash", "_sha")
    out = rows.join(classes, (F.col("_hash") == F.col("_h")) & (F.col("_sha") == F.col("_s")))
    return out.select(
        F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long"), F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_case: bool = True, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one of each group of equal texts.

    The groups are those of exact_groups(): keyed by (hash, bytes), so colliding texts stay apart. Whole rows go through
    one shuffle, and partial aggregation leaves one row per text and task before it. Among rows that share an id and a
    text, the one with the largest hash of all its columns stays (rows that agree in it too are the same row stored
    twice). Columns may have any names. Null text counts as empty; a null id stays only where no row of the group has an id. Empty table: empty result.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    norm, every = fold_ascii(text) if fold_case else text, [F.col(quoted(c)) for c in docs.columns]
    row = F.struct(*(c.alias(f"c{k}") for k, c in enumerate(every)))
    whole = docs.select(F.unhex(F.md5(norm)).alias("_hash"), norm.alias("_norm"), row.alias("_row"), F.col(quoted(id_col)).alias("_id"), F.xxhash64(F.to_json(row)).alias("_tie"))
    order = F.struct(F.col("_id").isNotNull() if keep == "max" else F.col("_id").isNull(), "_id", "_tie")
    left = whole.groupBy("_hash", "_norm").agg((F.max_by if keep == "max" else F.min_by)("_row", order).alias("_row"))
    return left.select(*(F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)))
