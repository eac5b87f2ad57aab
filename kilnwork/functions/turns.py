"""First user turn and the answer to it, from arrays of turns or from a table with a row per turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip


def first_turns(turns: Column) -> Column:
    """struct<user, assistant> of array<struct<role, content, from, value>>: the first user turn with content and the first
    assistant turn with content behind it. An empty role or content counts as missing, then `from` and `value` are used. What is
    missing is empty; a null array has neither."""

    def clean(x: Column, i: Column) -> Column:
        some = lambda a, b: F.coalesce(F.nullif(x[a], F.lit("")), x[b])
        return F.struct(some("role", "from").alias("role"), strip(F.coalesce(some("content", "value"), F.lit(""))).alias("text"), i.alias("at"))

    said = F.filter(F.transform(turns, clean), lambda x: x["text"] != "")
    user = F.get(F.filter(said, lambda x: x["role"] == "user"), F.lit(0))
    answer = F.get(F.filter(said, lambda x: (x["role"] == "assistant") & (x["at"] > user["at"])), F.lit(0))
    return F.struct(F.coalesce(user["text"], F.lit("")).alias("user"), F.coalesce(answer["text"], F.lit("")).alias("assistant"))


def gather_turns(df: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A row per conversation: its key, the text of its first system turn (empty if none) and the array of its turns in order."""
    one = F.struct(F.col(order).alias("turn"), F.col("role"), F.col("text"))
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("value")))
    system = F.get(F.filter("t", lambda x: x["role"] == "system"), F.lit(0))["text"]
    return rows.select(key, F.coalesce(system, F.lit("")).alias("system"), turns.alias("conversations"))
