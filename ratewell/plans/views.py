"""Tables of the domain, derived by projection from the tables at hand. The SQL runs in Spark and elsewhere alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATINGS_SQL = """
select cast(l_orderkey % 200 as string) case_study_id,
       case l_suppkey % 4 when 0 then 'primary_a' when 1 then 'primary_b' when 2 then 'secondary_a' else 'secondary_b' end rater,
       case l_returnflag when 'A' then 'insights' when 'N' then 'etiology' else 'recommendations' end tag,
       concat('p', cast(l_linenumber as string)) principle,
       case l_partkey % 3 when 0 then 'human_expert' when 1 then 'base_model' else 'tuned_model' end conversation_source,
       cast(least(5, (cast(l_quantity as int) % 5) + 1
            + case when l_partkey % 3 = 2 and l_returnflag = 'A' then 1
                   when l_partkey % 3 = 0 and l_returnflag = 'R' and l_suppkey % 2 = 0 then 1 else 0 end) as int) rating
from lineitem"""

#: Cases rated by differing panels: a rater is on a case's panel by the two numbers of the case.
PANEL_SQL = f"""select * from ({RATINGS_SQL}) x where not (rater = 'secondary_b' and cast(case_study_id as int) % 3 = 0) and not (rater = 'primary_b' and cast(case_study_id as int) % 5 = 0)"""

CASES_SQL = """
select cast(c_custkey as string) case_study_id, cast(c_custkey % 400 as string) user_id, 'sleep' vertical,
       case c_custkey % 5 when 0 then 'holdout' when 1 then 'holdout_model' else 'train' end split, c_custkey line,
       concat('The user is ', case when c_custkey % 2 = 0 then 'female' else 'male' end, ', ',
              case c_custkey % 4 when 0 then '<30' when 1 then '[40-44]' when 2 then '[65-69]' else '80+' end, ' years old.', chr(10), c_name) input,
       concat('Age: ', cast(25 + c_custkey % 60 as string), chr(10), 'Height: 1.', cast(50 + c_custkey % 45 as string), 'm', chr(10), 'Weight: ', cast(50 + c_custkey % 61 as string), '.5kg', chr(10),
              'BMI: ', cast(18 + c_custkey % 17 as string), '.25', chr(10), c_mktsegment, chr(10), 'Gender: ', case when c_custkey % 3 = 0 then 'Male' else 'Female' end) demographics_input
from customer"""

EXAM_SQL = """
select item_id, text question, case when item_id % 2 = 0 then 'Sleep' else 'Fitness' end domain,
       case item_id % 3 when 0 then 'Easy' when 1 then 'Moderate' else 'Hard' end difficulty,
       case item_id % 4 when 0 then '(A)' when 1 then '(B)' when 2 then '(C)' else '(D)' end answer
from benchmark"""

PREDICTIONS_SQL = """
select concat(case p_partkey % 4 when 0 then 'alertness_score_binary' when 1 then 'quality_score_binary' when 2 then 'enough_sleep_score_binary' else 'restless_score_binary' end,
              case p_size % 6 when 0 then '_llm' when 1 then '_llm_few_shot' when 2 then '_llm_zero_shot' when 3 then '_logreg_2914_data' when 4 then '_cnn' else '_other' end) prediction_name,
       case when p_partkey % 2 = 0 then 'auc' else 'auprc' end metric_name, p_retailprice / 10000 as mean, p_retailprice / 10000 - 0.05 as ci_lower, p_retailprice / 10000 + 0.04 as ci_upper, p_partkey
from part"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    return spark.sql(text.replace(f"from {name}", f"from {{{name}}}"), **{name: table(spark, sf_dir, name)})


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RATINGS_SQL, "lineitem")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PANEL_SQL, "lineitem")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CASES_SQL, "customer")


def exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = F.create_map(*(F.lit(x) for pair in (("(A)", "one"), ("(B)", "two"), ("(C)", "three"), ("(D)", "four")) for x in pair))
    return _sql(spark, sf_dir, EXAM_SQL, "benchmark").withColumn("choices", choices)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PREDICTIONS_SQL, "part")


def conversations(spark: SparkSession, sf_dir: str, source: str = "human_expert", cases: DataFrame | None = None) -> DataFrame:
    """Nested conversations: a message per turn, tagged by the turn, its role in capitals. Turns of one conversation only
    are gathered. ``cases`` restricts to the conversations of some case studies, few enough to broadcast: turns of others are
    left out before they are shuffled."""
    rows = table(spark, sf_dir, "conversations")
    if cases is not None:
        rows = rows.join(F.broadcast(cases.select("case_study_id")), F.col("conv_id").cast("string") == F.col("case_study_id"), "left_semi")
    message = F.struct("turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("tag"), F.upper("role").alias("role"), F.array(F.struct("text")).alias("chunks"))
    nested = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    return nested.select(F.col("conv_id").cast("string").alias("case_study_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.lit(source).alias("conversation_source"), "messages")
