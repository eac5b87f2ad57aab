"""Sources, sinks and reports."""

import json

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kilnwork.functions.sql import register
from kilnwork.operators import report, teacher
from kilnwork.plans import adapters, pipelines
from kilnwork.sources import io

SCHEMA = f"source_index long, ablation_mode string, teacher_success {teacher.SUCCESS}, teacher_failed {teacher.FAILED}, teacher_description string"


def records(spark):
    rows = [(i, "m", [("r", "f", "[f()]")] if i % 2 else [], [], "d", s) for i, s in enumerate(["valid", "valid", "invalid_schema", "failed_parse_or_request", "odd", None, "dry_run"])]
    return spark.createDataFrame(rows, SCHEMA + ", status string")


def test_buckets(spark, tmp_path):
    folder = str(tmp_path / "b")
    assert io.read_buckets(spark, folder, SCHEMA).count() == 0
    io.write_buckets(records(spark), folder)
    back = io.read_buckets(spark, folder, SCHEMA)
    assert {r.status: r["count"] for r in back.groupBy("status").count().collect()} == {"valid": 2, "invalid_schema": 1, "failed_parse_or_request": 3}
    assert io.success_cases(spark, folder, SCHEMA).count() == 1


def test_jsonl_keeps_text_and_skips_blank_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": "\u00e9"}\n\n{"a": "b"}\n')
    assert sorted(r.a for r in io.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a string").where("a is not null").collect()) == ["b", "\u00e9"]


def test_datasets(spark, tmp_path):
    path = str(tmp_path / "d")
    io.save_dataset(spark.range(3), f"{path}/train")
    assert io.read_dataset(spark, path).count() == 3 and io.read_dataset(spark, f"{path}/train").count() == 3
    with pytest.raises(AnalysisException):
        io.save_dataset(spark.range(3), f"{path}/train", overwrite=False)
    spark.range(4).write.json(f"{path}/json")
    assert io.read_dataset(spark, f"{path}/json", form="json").count() == 4
    batch = pa.record_batch([pa.array([1, 2])], ["v"])
    for name in "ab":
        with pa.OSFile(str(tmp_path / name), "wb") as f, pa.ipc.new_stream(f, batch.schema) as w:
            w.write_batch(batch)
    assert io.read_arrow_dir(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).agg(F.sum("v")).first()[0] == 6


def part(spark, n=40):
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("blue tin").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit(3).alias("p_size")).createOrReplaceTempView("kilnwork_part")
    return spark.sql(adapters.A_PROCESSED.replace("FROM part", "FROM kilnwork_part"))


def test_reports(spark, tmp_path):
    df = part(spark).withColumns({"prompt_token_length": F.col("key").cast("int"), "extract_failed": F.lit(False)})
    got = report.dataset_report(df, pipelines.within(df, 19), "prompt_token_length")
    assert got["rows_before"] == 40 and got["removed_ratio"] == 0.5 and got["length"]["max"] == 19 and got["refusal"]["0"]["count"] == 8
    assert "| rows before |" in report.report_markdown(got)
    report.save_json({"a": "\u00e9"}, str(tmp_path / "r/x.json"))
    assert (tmp_path / "r/x.json").read_text() == json.dumps({"a": "\u00e9"}, indent=2)
    assert report.metadata({"all": df, "some": df}, flags={"some": "refusal = 1"})["some"] == {"rows": 40, "flagged": 24}
    assert report.percent(0, 0) == "0.00%" and "Examples: x" in report.refusal_markdown({"t": {"a": 1}}, {"x": [{"k": 1}]})
    assert [r["key"] for r in io.first_rows(df, "key", 2, "refusal = 1")] == [2, 3]
    io.save_readable(df, str(tmp_path / "readable"))
    assert spark.read.json(str(tmp_path / "readable")).columns == sorted(["system", "user", "assistant", "tools", "tool_type", "tool_count", "refusal", "prompt_token_length"])


def test_annotation_dataset_and_sql(spark):
    done = teacher.dry_run(pipelines.annotation_plan(part(spark)))
    assert len(teacher.dataset(done).columns) == 13 and teacher.dataset(done).first().teacher_success == "[]"
    names = register(spark)
    row = part(spark).where("key = 1").selectExpr("described_parameters(tools) d", "tool_names(tools) n").first()
    assert row.d == ["size", "brand"] and row.n == ["get_part_1"] and "tool_names" in names


def test_validation_is_idempotent(spark):
    df = records(spark).drop("status").withColumns({"tool_names": F.array(F.lit("f")), "old_names": F.expr("cast(array() as array<string>)")})
    once = teacher.check_annotations(df)
    twice = teacher.check_annotations(once.drop("validation_errors", "status"))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_parts_are_kept_and_a_broken_run_goes_on(spark, tmp_path):
    """Each part has its folder of buckets; what is there is not asked for again."""
    plan = pipelines.annotation_plan(part(spark)).cache()
    folder, reply = str(tmp_path / "parts"), '{"success": [], "failed": [], "description": "d"}'
    n = plan.count()
    parts = pipelines.annotate_in_parts(plan, lambda: lambda messages: reply, folder, every=2)
    assert parts == -(-n // 2) > 1 and pipelines.annotate_in_parts(plan, lambda: lambda messages: 1 / 0, folder, every=2) == 0
    rows = spark.read.option("basePath", folder).json(f"{folder}/part=*/bucket=*")
    assert rows.count() == n and rows.select("source_index").distinct().count() == n and {r.bucket for r in rows.select("bucket").distinct().collect()} == {"invalid"}


def test_previews(spark):
    df = part(spark).withColumns({"ablation_mode": F.when(F.col("key") % 2 == 0, "none").otherwise("a"), "ablation_applied": F.col("key") > 30})
    keys = {kind: [r.key for r in io.preview(df, "key", kind).collect()] for kind in io.PREVIEWS}
    assert keys == {"structured": [0, 1, 2, 3, 4], "parameters": [31, 32, 33, 34, 35], "modes": list(range(1, 17, 2)), "annotations": list(range(10))}
    text = io.preview_markdown([{"key": 1, "tools": "[\n1\n]", "none": None}], "Rows", ("key", "tools", "none"))
    assert text.startswith("# Rows") and "- key: `1`" in text and "### tools" in text and "none" not in text
