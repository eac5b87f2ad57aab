"""Counts, ratios, length statistics and the texts made of them."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import ratio

PERCENTS = (50, 90, 95, 99)


def frequency(df: DataFrame, column: Column | str, name: str = "value") -> DataFrame:
    """value, n, ratio."""
    c = F.col(column) if isinstance(column, str) else column
    counted = df.groupBy(c.alias(name)).agg(F.count("*").alias("n"))
    return counted.withColumn("ratio", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def filter_report(df: DataFrame, condition: Column) -> DataFrame:
    """One row: rows before and after a filter, those removed and their share (0 of an empty table)."""
    got = df.agg(F.count("*").alias("rows_before"), F.count_if(condition).alias("rows_after"))
    return got.withColumn("removed", F.col("rows_before") - F.col("rows_after")).withColumn("removed_ratio", ratio(F.col("removed"), F.col("rows_before")))


def length_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: n, min, p50, p90, p95, p99, max of a whole-number column, nulls left out; zeros for an empty table.

    A percentile is the value at rank round-half-even(q/100 * (n - 1)). Values are counted first, so what is sorted is the
    number of distinct lengths, not of rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("v")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda q: F.min(F.when(F.col("upto") > F.bround(F.lit(float(q)) / 100 * (F.col("n") - 1)), F.col("v")))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return upto.agg(zero(F.max("n"), "n"), zero(F.min("v"), "min"), *(zero(at(q), f"p{q}") for q in PERCENTS), zero(F.max("v"), "max"))


def grouped_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """grouping, value, n of every column, in one pass."""
    labels = F.explode(F.array(*(F.struct(F.lit(c).alias("grouping"), F.col(c).cast("string").alias("value")) for c in columns))).alias("g")
    return df.select(labels).groupBy("g.grouping", "g.value").agg(F.count("*").alias("n"))


def report_rows(before: DataFrame, after: DataFrame, length: str) -> DataFrame:
    """side (0 before a filter, 1 after it), grouping, value, n, of (all of the side): what a report shows, in one pass over both tables.

    Groupings are extract_failed of all rows, then refusal, tool_type and tool_bucket of those that are left, and `length`, of which only the values
    stay that are its least, its percentiles or its largest (`shows` names them, as length_stats does). Lengths that are null are left out. Counts are what
    meets in a task: one for each value, so lengths should be whole numbers of some range.
    """
    from .classify import tool_bucket

    names = ("extract_failed", "refusal", "tool_type", "tool_bucket", "length")
    none = lambda c: F.lit(None).cast("string").alias(c)
    one = before.select(F.lit(0).alias("side"), F.col("extract_failed").cast("string").alias("extract_failed"), *map(none, names[1:]))
    two = after.select(F.lit(1).alias("side"), none("extract_failed"), F.col("refusal").cast("string").alias("refusal"), F.col("tool_type").cast("string").alias("tool_type"), tool_bucket(F.col("tool_count")).alias("tool_bucket"), F.col(length).cast("long").cast("string").alias("length"))
    both = one.unionByName(two)
    counted = both.groupingSets([[both.side, both[c]] for c in names], "side", *names).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"no_{c}") for c in names))
    of = F.coalesce(*(F.when(F.col(f"no_{c}") == 0, F.lit(c)) for c in names))
    named = counted.select("side", of.alias("grouping"), F.coalesce(*names).alias("value"), "n").where("(side = 0) = (grouping = 'extract_failed') and (grouping <> 'length' or value is not null)")
    inside = Window.partitionBy("side", "grouping")
    ordered = named.withColumn("v", F.expr("try_cast(value as bigint)"))
    upto = ordered.withColumns({"of": F.sum("n").over(inside), "upto": F.sum("n").over(inside.orderBy("v", "value").rowsBetween(Window.unboundedPreceding, 0))})
    rank = lambda q: F.bround(F.lit(float(q)) / 100 * (F.col("of") - 1))
    at = lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r)
    shows = [F.when(at(F.lit(0)), "min"), *(F.when(at(rank(q)), f"p{q}") for q in PERCENTS), F.when(F.col("upto") == F.col("of"), "max")]
    out = upto.withColumn("shows", F.when(F.col("grouping") == "length", F.array_compact(F.array(*shows))))
    return out.where("grouping <> 'length' or size(shows) > 0").select("side", "grouping", "value", "n", "of", "shows")


def dataset_report(before: DataFrame, after: DataFrame, length: str) -> dict:
    """Rows before and after the length filter, frequencies of refusals, tool types and tool counts, and length statistics: one job."""
    got = report_rows(before, after, length).collect()  # a row for each value of a grouping, and seven lengths at most
    table = lambda c: {str(r.value): {"count": r.n, "ratio": r.n / r.of} for r in sorted((r for r in got if r.grouping == c), key=lambda r: str(r.value))}
    n, kept = (next((r.of for r in got if r.grouping == c), 0) for c in ("extract_failed", "refusal"))
    lengths = {s: int(r.value) for r in got if r.grouping == "length" for s in r.shows}
    return {
        "rows_before": n, "rows_after": kept, "removed": n - kept, "removed_ratio": (n - kept) / n if n else 0.0,
        "refusal": table("refusal"), "tool_type": table("tool_type"), "tool_bucket": table("tool_bucket"),
        "extract_failed": sum(r.n for r in got if r.grouping == "extract_failed" and r.value == "true"),
        "length": {"n": next((r.of for r in got if r.grouping == "length"), 0)} | {k: lengths.get(k, 0) for k in ("min", *(f"p{q}" for q in PERCENTS), "max")},
    }


def markdown_table(header: list[str], rows: list[list]) -> str:
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])


def percent(part: int, whole: int) -> str:
    return f"{100 * part / whole if whole else 0:.2f}%"


def report_markdown(report: dict, title: str = "Dataset report") -> str:
    shares = [f"## {k}\n\n" + markdown_table([k, "count", "ratio"], [[v, x["count"], f"{x['ratio']:.2%}"] for v, x in report[k].items()]) for k in ("refusal", "tool_type", "tool_bucket")]
    rows = markdown_table(["rows before", "rows after", "removed"], [[report["rows_before"], report["rows_after"], f"{report['removed']} ({report['removed_ratio']:.2%})"]])
    return "\n\n".join([f"# {title}", rows, *shares, "## length\n\n" + markdown_table(list(report["length"]), [list(report["length"].values())])]) + "\n"


def refusal_markdown(counts: dict[str, dict[str, int]], examples: dict[str, list[dict]]) -> str:
    """A table per grouping, largest share first, then the examples by class."""
    out = ["# Refusals"]
    for name, table in counts.items():
        whole = sum(table.values())
        out.append(f"## {name}\n\n" + markdown_table([name, "count", "ratio"], [[k, n, percent(n, whole)] for k, n in sorted(table.items(), key=lambda x: (-x[1], x[0]))]))
    for label, rows in sorted(examples.items()):
        out += [f"## Examples: {label}", *("```json\n" + json.dumps(r, ensure_ascii=False, indent=2) + "\n```" for r in rows)]
    return "\n\n".join(out) + "\n"


def save_text(text: str, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def save_json(value: dict, path: str) -> None:
    """ASCII-escaped."""
    save_text(json.dumps(value, indent=2), path)


def short_examples(df: DataFrame, key: str = "key") -> DataFrame:
    """The first 500 characters of user, 800 of assistant, 30 names."""
    return df.select(key, F.substring("user", 1, 500).alias("user"), F.substring("assistant", 1, 800).alias("assistant"), F.slice("names", 1, 30).alias("names"))


def metadata(frames: dict[str, DataFrame], paths: dict[str, str] | None = None, flags: dict[str, str] | None = None) -> dict:
    """Row counts by name, where `flags` has a condition for a name also the rows that meet it, and the paths written: one job for all tables."""
    out: dict = {}
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.count_if(F.expr((flags or {}).get(name, "false"))).alias("flagged")) for name, df in frames.items()]
    for row in functools.reduce(DataFrame.unionByName, parts).collect() if parts else []:
        out[row.name] = {"rows": row.rows} | ({"flagged": row.flagged} if row.name in (flags or {}) else {})
    return {name: out[name] for name in frames} | ({"paths": paths} if paths else {})


def counting(df: DataFrame, flag: str | None = None) -> tuple[DataFrame, Callable[[], dict]]:
    """A table that counts its rows, and those that meet a condition, while it is written; behind the write the counts are there without another job."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *([F.count_if(F.expr(flag)).alias("flagged")] if flag else [])]
    return df.observe(seen, *counts), lambda: dict(seen.get)


def write_all(frames: dict[str, DataFrame], paths: dict[str, str], write: Callable[[DataFrame, str], None], flags: dict[str, str] | None = None) -> dict:
    """Writes tables to their paths and returns metadata() of them, counted by the writes themselves."""
    out: dict = {}
    for name, df in frames.items():
        counted, counts = counting(df, (flags or {}).get(name))
        write(counted, paths[name])
        out[name] = counts()
    return out | {"paths": paths}
