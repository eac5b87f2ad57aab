"""Exact, deterministic shuffles, splits, samples and bands.

Rows are ordered by md5(seed:key), then key. The order's first four hex digits are a bucket; a histogram of at most 65,536
buckets gives each bucket's offset, and ranks are taken inside buckets only, so no sort meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def global_rank(df: DataFrame, key: str, seed: int, by: list[str] | None = None, name: str = "rank", total: str | None = None) -> DataFrame:
    """Adds the rank (from 1) of every row in the seeded order, apart for each value of `by`, and the number of rows ranked
    together, if `total` names it; null keys come last, in the order of a hash of their other columns."""
    by = by or []
    rest = [F.col(f"`{f.name}`") for f in df.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    last = F.concat(F.lit("~"), F.hex(F.xxhash64(F.lit(seed), *rest)))
    h = df.withColumn("h_", F.coalesce(order_hash(F.col(key), seed), last)).withColumn("b_", F.substring("h_", 1, 4))
    group = Window.partitionBy(*by)
    before = group.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = h.groupBy(*by, "b_").count().withColumn("offset_", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("n_", F.sum("count").over(group)).drop("count")
    names = {c: f"{c}_of_" for c in [*by, "b_"]}
    right = offsets.withColumnsRenamed(names)
    match = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    inside = Window.partitionBy(*by, "b_").orderBy("h_", key)
    # never the rows themselves: a plan that guesses their size from the files may take texts made of few bytes for the smaller side
    joined = (h.hint("merge").join(right, match) if by else h.join(F.broadcast(right), match)).withColumn(name, (F.col("offset_") + F.row_number().over(inside)).cast("long"))
    joined = joined.withColumnRenamed("n_", total) if total else joined.drop("n_")
    return joined.drop("h_", "b_", "offset_", *names.values())


def part_of(total: str, share: float) -> Column:
    """int(total * share), of doubles."""
    return F.floor(F.col(total).cast("double") * F.lit(float(share)))


def train_test(df: DataFrame, key: str, *, test: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds split: the first ceil(n * test) rows of the seeded order are test, the others train."""
    ranked = global_rank(df, key, seed, name="rank_", total="of_")
    first = F.ceil(F.col("of_").cast("double") * F.lit(float(test)))
    return ranked.withColumn("split", F.when(F.col("rank_") <= first, "test").otherwise("train")).drop("rank_", "of_")


def take_fraction(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """The first int(n * fraction) rows of the seeded order."""
    return global_rank(df, key, seed, name="rank_", total="of_").where(F.col("rank_") <= part_of("of_", fraction)).drop("rank_", "of_")


def bands(df: DataFrame, key: str, shares: dict[str, float], seed: int, *, rest: str | None = None, name: str = "mode") -> DataFrame:
    """Adds a mode: consecutive bands of int(n * share) rows each in the seeded order. What is left gets `rest`, or else the last band."""
    ranked, upto = global_rank(df, key, seed, name="rank_", total="of_"), F.lit(0)
    mode = F.when(F.lit(False), F.lit(""))
    for label, share in list(shares.items())[: None if rest else -1]:
        upto = upto + part_of("of_", share)
        mode = mode.when(F.col("rank_") <= upto, label)
    return ranked.withColumn(name, mode.otherwise(rest or list(shares)[-1])).drop("rank_", "of_")


def sample_of_total(eligible: DataFrame, key: str, total: int, ratio: float, seed: int) -> DataFrame:
    """round(total * ratio) of the eligible rows in the seeded order, or all of them if they are fewer."""
    return global_rank(eligible, key, seed, name="rank_").where(F.col("rank_") <= round(total * ratio)).drop("rank_")


def first_per_label(df: DataFrame, label: str, key: str, n: int = 3) -> DataFrame:
    """The n rows of each label with the least keys, and their rank."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(key))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
