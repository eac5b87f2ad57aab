"""Reports in one pass, counts from writes."""

import pytest
from pyspark.sql import functions as F

from kilnwork.operators import report
from kilnwork.sources import io

ROWS = "key long, extract_failed boolean, refusal int, tool_type string, tool_count int, length int"


def several(df, kept, length):
    """Every figure by a job of its own."""
    n, m = df.count(), kept.count()
    table = lambda c: {str(r.value): {"count": r.n, "ratio": r.ratio} for r in report.frequency(kept, c).orderBy("value").collect()}
    from kilnwork.operators.classify import tool_bucket

    return {
        "rows_before": n, "rows_after": m, "removed": n - m, "removed_ratio": (n - m) / n if n else 0.0, "refusal": table("refusal"), "tool_type": table("tool_type"), "tool_bucket": table(tool_bucket(F.col("tool_count"))),
        "extract_failed": df.where("extract_failed").count(), "length": report.length_stats(kept, length).first().asDict(),
    }


@pytest.mark.parametrize("n", [0, 1, 2, 3, 97, 400])
def test_one_pass_says_what_several_do(spark, n):
    df = spark.range(n).selectExpr("id as key", "id % 7 = 0 as extract_failed", "cast(id % 3 = 0 as int) as refusal", "case when id % 5 = 0 then null when id % 2 = 0 then 'json' else 'non_json' end as tool_type", "cast(id % 4 as int) - 1 as tool_count", "cast(case when id % 11 = 5 then null else (id * 37) % 250 end as int) as length").repartition(3)
    kept = df.where("length < 120 or length is null")
    one, many = report.dataset_report(df, kept, "length"), several(df, kept, "length")
    for c in ("tool_type",):
        assert one[c].keys() == many[c].keys()
    assert {k: v if not isinstance(v, dict) else {str(a): b for a, b in v.items()} for k, v in one.items()} == many


def jobs(spark, run):
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    try:
        out = run()
        return out, len(sc.statusTracker().getJobIdsForGroup("counted"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_counts_come_with_the_write(spark, tmp_path):
    frames = {"all": spark.range(100), "some": spark.range(40).withColumn("x", F.col("id") % 2), "none": spark.range(0)}
    paths = {k: str(tmp_path / k) for k in frames}
    got = report.write_all(frames, paths, lambda df, path: io.save_dataset(df, path), {"some": "x = 1"})
    assert got == {"all": {"rows": 100}, "some": {"rows": 40, "flagged": 20}, "none": {"rows": 0}, "paths": paths}
    assert io.read_dataset(spark, paths["some"]).count() == 40
    same, n = jobs(spark, lambda: report.metadata(frames, paths, {"some": "x = 1"}))
    assert same == got and n <= 4 and report.metadata({}) == {}
