"""Examples of many ratings: equal ones are rendered and shuffled once, and every one of them is there."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from ratewell.operators import prompts
from ratewell.plans import catalog, catalog_more  # noqa: F401  (registers more)
from ratewell.sources import readers, schemas, sinks

SF = "/root/testdata/sf0.001"


def _inputs(spark, repeats=30):
    message = F.array(F.struct(F.lit("insight").alias("tag"), F.lit("USER").alias("role"), F.array(F.struct(F.lit("data").alias("text"))).alias("chunks")))
    both = spark.createDataFrame([(s, c) for s in ("human_expert", "base_model") for c in ("1", "2")], "conversation_source string, case_study_id string").withColumn("messages", message)
    rows = [(c, c, "base_model", "Primary A", "insight", "non_harmful", 1 + k % 2) for c in ("1", "2", "3") for k in range(repeats)]
    return spark.createDataFrame(rows, schemas.RATINGS), spark.createDataFrame([("1", "train"), ("2", "validation"), ("3", "train")], "case_study_id string, split string"), both


def test_equal_ratings_are_one_row_with_copies(spark):
    ratings, sp, both = _inputs(spark)
    known = spark.createDataFrame([("1",), ("2",)], "case_study_id string")
    rows = prompts.rating_examples(ratings, sp, both, "sleep", cases=known, copies=True).collect()
    assert sorted((r.case_study_id, r.rating, r.split, r.copies) for r in rows) == [("1", 1, "train", 15), ("1", 2, "train", 15), ("2", 1, "validation", 15), ("2", 2, "validation", 15)]
    plain = prompts.rating_examples(ratings, sp, both, "sleep", cases=known)
    assert "copies" not in plain.columns and plain.count() == 60
    examples, counts = prompts.counted_examples(ratings, sp, both, "sleep")
    assert examples.count() == 60 and counts.get["examples"] == 60 and counts.get["no conversation"] == 30


def test_store_holds_every_copy(spark, tmp_path):
    ratings, sp, both = _inputs(spark)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    sinks.write_examples(prompts.rating_examples(ratings.filter("case_study_id <> '3'"), sp, both, "sleep", copies=True), str(tmp_path / "e"))
    back = readers.examples(spark, str(tmp_path / "e"))
    assert back.count() == 60 and back.filter("split = 'train'").count() == 30 and "copies" not in back.columns
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    counts = prompts.write_matched_examples(ratings, sp, both, "sleep", str(tmp_path / "f"), allowed=30)
    assert counts["examples"] == 60 and counts["no conversation"] == 30 and readers.examples(spark, str(tmp_path / "f")).count() == 60


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """A thousand ratings, and each of them sixteen times."""
    folders = []
    for k in (1, 16):
        place = tmp_path_factory.mktemp(f"times{k}")
        duckdb.sql(f"copy (select l.* replace (l_orderkey + k * 600 as l_orderkey, l_partkey + k * 600 as l_partkey, l_suppkey + k * 600 as l_suppkey) from (select * from '{SF}/lineitem.parquet' limit 1000) l, (select unnest(range({k})) k)) to '{place}/lineitem.parquet' (format parquet)")
        for t in ("conversations", "customer"):
            duckdb.sql(f"copy (select * from '{SF}/{t}.parquet') to '{place}/{t}.parquet' (format parquet)")
        folders.append(str(place))
    return folders


def _shuffled(spark, run):
    """Bytes that stages shuffle while run() goes, and what it gives."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    out = run()
    return sum(n for k, n in total().items() if k not in before), out


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables aren't here")
@pytest.mark.parametrize("known", [True, False])
def test_examples_are_rendered_once_for_equal_ratings(spark, many, known):
    """Those of q_examples_of_known_cases and q_examples_join."""
    cases = spark.read.parquet(f"{many[0]}/customer.parquet").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("case_study_id")) if known else None
    one, more = (catalog._examples(spark, d, cases).count() for d in many)
    assert one == more > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables aren't here")
@pytest.mark.parametrize("name", ["q_examples_of_known_cases", "q_examples_join", "q_examples_unmatched"])
def test_equal_ratings_are_not_shuffled(spark, many, name):
    """Sixteen times the ratings: the rows of the SQL, and about the shuffle of the ratings once."""
    (one, _), (more, got) = (_shuffled(spark, lambda d=d: catalog.QUERIES[name](spark, d).collect()) for d in many)
    con = duckdb.connect()
    for t in ("lineitem", "conversations", "customer"):
        con.execute(f"create view {t} as select * from '{many[1]}/{t}.parquet'")
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in got)
    assert 0 < more < 2 * one


@pytest.fixture(scope="module")
def told(many, tmp_path_factory):
    """The thousand ratings beside the conversations, and beside these and forty times as many that nobody rated."""
    place = tmp_path_factory.mktemp("told")
    for t in ("lineitem", "customer"):
        duckdb.sql(f"copy (select * from '{many[0]}/{t}.parquet') to '{place}/{t}.parquet' (format parquet)")
    duckdb.sql(f"copy (select c.* replace (conv_id + k * 100000 as conv_id) from '{SF}/conversations.parquet' c, (select unnest(range(41)) k)) to '{place}/conversations.parquet' (format parquet)")
    return many[0], str(place)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables aren't here")
@pytest.mark.parametrize("name", ["q_examples_of_known_cases", "q_examples_join", "q_examples_unmatched"])
def test_conversations_that_nobody_rated_are_not_shuffled(spark, told, name):
    """The same rows, and about the same shuffle."""
    (one, few), (more, got) = (_shuffled(spark, lambda d=d: catalog.QUERIES[name](spark, d).collect()) for d in told)
    assert sorted(map(str, got)) == sorted(map(str, few)) and len(got) > 0
    assert 0 < more < 1.5 * one


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables aren't here")
@pytest.mark.parametrize("name", ["q_examples_of_known_cases", "q_examples_join"])
def test_prompts_are_not_sorted(spark, many, name):
    """Aggregates take the prompts' digests; what is sorted for them doesn't hold the prompts."""
    plan = catalog.QUERIES[name](spark, many[0])._jdf.queryExecution().executedPlan().toString()
    assert "inputs" not in plan and "prompt_md5" in plan
