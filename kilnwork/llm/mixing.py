"""Operator 10, mixing sources to target weights: subset-sum budget fitting.

Documents are counted by (source, exact length). Each source's budget is filled with whole passes over the source, then
with a proportional share of every length, and bounded-knapsack dynamic programming over the lengths that are left settles
the remaining words. Which documents of a length are taken is decided by a seeded hash: whole hash buckets, and ranks only
inside the one bucket where the count is reached, so no group of equal lengths meets in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import WORD, materialize, table

#: Words that the dynamic programming may settle; beyond it the proportional share and a greedy pass go first.
DP_WORDS = 1 << 16
BUCKETS = 4096


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Share `total` by weight; a share stops at `most` times its size, and the excess goes to the others by weight."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        whole = sum(weights[i] for i in sorted(open_))
        shares = {i: left * weights[i] / whole for i in open_}
        full = sorted(i for i in open_ if shares[i] >= most * sizes[i])
        if not full:
            for i in open_:
                out[i] = shares[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= set(full)
        left = max(left, 0.0)
    return out


def subset_sum(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many items of each length to take so that their sum is as near under `budget` as bounded counts allow (exact where reachable)."""
    if budget <= 0:
        return {}
    mask, bits = (1 << (budget + 1)) - 1, 1
    first = np.full(budget + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for length, count in zip(lengths, counts):
        if bits >> budget & 1:
            break
        step = 1
        while count > 0 and length * step <= budget and not bits >> budget & 1:
            n = min(step, count)
            new = (bits << (length * n)) & mask & ~bits
            if new:
                at = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(at[: budget + 1])] = len(items)
                bits |= new
            items.append((length, n))
            count -= n
            step *= 2
    taken: dict[int, int] = {}
    at = bits.bit_length() - 1
    while at > 0:  # a sum first reached at item i comes from a sum that was reached before i
        length, n = items[first[at]]
        taken[length] = taken.get(length, 0) + n
        at -= length * n
    return taken


def plan_source(sizes: np.ndarray, counts: np.ndarray, target: float, seed: int) -> tuple[int, np.ndarray]:
    """Whole passes over a source, and of each length how many documents are taken once more."""
    total = int((sizes * counts).sum())
    extra = np.zeros(len(sizes), np.int64)
    if total <= 0 or target <= 0:
        return 0, extra
    passes = int(target // total)
    rest = int(round(target - passes * total))
    if rest <= 0:
        return passes, extra
    share = min(1.0, rest / total)
    extra = np.where(sizes > 0, np.floor(counts * share), 0).astype(np.int64)
    while int((extra * sizes).sum()) > rest:  # only by rounding of the share
        extra[np.flatnonzero(extra)[-1]] -= 1
    rest -= int((extra * sizes).sum())
    order = np.random.default_rng(seed).permutation(len(sizes))
    for i in order:  # greedy until dynamic programming can settle what remains
        if rest <= DP_WORDS:
            break
        if sizes[i] > 0 and extra[i] < counts[i]:
            n = int(min(counts[i] - extra[i], max(1, (rest - DP_WORDS // 2) // sizes[i]), rest // sizes[i]))
            extra[i] += n
            rest -= n * int(sizes[i])
    if rest <= DP_WORDS:
        use = [i for i in order if 0 < sizes[i] <= rest and extra[i] < counts[i]]
        found = subset_sum([int(sizes[i]) for i in use], [int(counts[i] - extra[i]) for i in use], rest)
        for i in use:
            extra[i] += found.get(int(sizes[i]), 0)
    return passes, extra


def mix(docs: DataFrame, *, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, whole_rows: bool = False, name: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of `docs` (doc_id, text, source).

    Null texts have size 0 and are never taken. A null source is a source of its own, the last one. Repeated rows are
    rows like others. Ties: which rows of a length are taken follows a hash of doc_id and text, so rows that repeat an id under
    another text are told apart, and rows equal in both are interchangeable. Empty tables give an empty result; other columns are ignored. A
    source of size 0 has target 0. `share` times all words are shared; no document is taken more than `most` times.
    One row per source is collected to the driver to share the budget. With `whole_rows`, a struct column `row_` carries
    the input row along.
    """
    spark = docs.sparkSession
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_")] if whole_rows else []
    sized = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *row,
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
    )
    sized = materialize(sized.withColumn("bucket", F.shiftrightunsigned("h", 64 - 12).cast("int")), f"{name}-sized")
    by_length = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    sums = sorted(by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect(), key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    of = [float(weights[i % len(weights)]) for i in range(len(sums))]
    targets = water_fill([r.s for r in sums], of, share * sum(r.s for r in sums), most)
    goal = spark.createDataFrame([(r.source, int(r.s), float(t)) for r, t in zip(sums, targets)], "source string, source_size long, target double")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        passes, extra = plan_source(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["target"].iloc[0]), seed)
        return pdf.assign(passes=passes, extra=extra)[["source", "size", "n", "source_size", "target", "passes", "extra"]]

    joined = by_length.join(goal.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    plans = materialize(joined.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, passes long, extra long"), f"{name}-plan")
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    part = plans.where("extra > 0 and extra < n")
    up_to = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    some = sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("c"))
    cut = (
        some.join(part.select("source", "size", "extra"), same(some, part)).select(some["source"], some["size"], "bucket", "c", "extra")
        .withColumn("cum", F.sum("c").over(up_to)).where("cum >= extra and cum - c < extra")
        .select("source", "size", F.col("bucket").alias("cut"), (F.col("extra") - F.col("cum") + F.col("c")).alias("need"))
    )
    # written before it is joined, so that a length which many documents share can be split
    goals = materialize(plans.join(cut, same(plans, cut), "left").select(*(plans[c] for c in plans.columns), "cut", "need"), f"{name}-goals")
    whole = sized.join(goals, same(sized, goals)).select(sized["*"], "source_size", "target", "passes", F.when(F.col("extra") >= F.col("n"), BUCKETS).when(F.col("extra") <= 0, -1).otherwise(F.col("cut")).alias("cut"), "need")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id"))
    inside, edge = whole.where("bucket <> cut"), whole.where("bucket = cut").withColumn("r", rank)
    copies = inside.withColumn("copies", F.col("passes") + (F.col("bucket") < F.col("cut")).cast("long")).drop("cut", "need").unionByName(
        edge.withColumn("copies", F.col("passes") + (F.col("r") <= F.col("need")).cast("long")).drop("cut", "need", "r")
    )
    return copies.select("doc_id", "source", "size", "source_size", "target", *["row_"] * whole_rows, F.when(F.col("size") > 0, F.col("copies")).otherwise(0).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents themselves, all columns: each row as often as the mix takes it. Texts without words, null ones among
    them, are not taken; a null source is a source; repeated rows are taken each for itself; an empty table stays empty."""
    mixed = mix(docs, whole_rows=True, name="mix-stage").where("copies > 0")
    return mixed.select("row_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_")).select("row_.*")
