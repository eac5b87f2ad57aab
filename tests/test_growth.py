"""What must not grow with tables: tasks, broadcasts, states and jobs."""

import threading

from pyspark.sql import functions as F

from kilnwork.operators import sample
from kilnwork.plans import adapters
from kilnwork.plans.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def part(spark, folder, n):
    rows = spark.range(1, n + 1, 1, 1)
    names = {"p_partkey": F.col("id"), "p_name": F.lit("green tea"), "p_brand": F.lit("Brand#1"), "p_type": F.lit("t"), "p_size": (F.col("id") % 50).cast("int"), "p_retailprice": F.lit(1.0)}
    rows.select(*(c.alias(n_) for n_, c in names.items())).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_a_file_of_many_prompts_is_many_tasks(spark, tmp_path):
    at = part(spark, tmp_path, 60_000)
    assert adapters.parts(spark, at).rdd.getNumPartitions() == 3
    assert adapters.run(spark, at, adapters.A_TOOL).rdd.getNumPartitions() == 3


def test_no_sum_of_a_mask_for_every_place(spark, tmp_path):
    df = QUERIES["tensor_contents"](spark, part(spark, tmp_path, 5))
    assert "forall" not in plan_of(df) and df.where("used is null").count() == 0


def test_rows_are_never_the_broadcast_side(spark, tmp_path):
    spark.range(1000).select("id", F.repeat(F.lit("x"), 500).alias("text")).write.parquet(f"{tmp_path}/t")
    ranked = sample.global_rank(spark.read.parquet(f"{tmp_path}/t"), "id", 1)
    assert "BuildLeft" not in plan_of(ranked)
    done = plan_of(QUERIES["shuffled_prompts"](spark, part(spark, tmp_path, 50)))
    assert done.count("BroadcastHashJoin") <= 2 and "BuildLeft" not in done  # a histogram of buckets, for each side of the union


def test_threads_are_used_again():
    from kilnwork.operators.endpoint import Limits, asked

    got = list(asked(((i, i) for i in range(300)), lambda r: threading.current_thread().name, Limits(in_flight=4)))
    assert len(got) == 300 and len({name for _, name, _, _ in got}) <= 4
