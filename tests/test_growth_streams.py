"""State and jobs of annotation runs that have many keys or parts."""

import json

from kilnwork.plans import pipelines
from kilnwork.sources import io
from kilnwork.sources.ledger import Ledger
from kilnwork.streaming import resume

from test_streams import SCHEMA, record, wave


def test_state_is_kept_by_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resume, "STATES", 3, raising=False)
    into = tmp_path / "in"
    into.mkdir()
    wave(into, "a.json", [record(k, k % 2 == 0, "n", "2024-01-01T01:00:00Z") for k in range(60)])
    q = resume.stream_to_ledger(spark, str(into), SCHEMA, str(tmp_path / "out"), str(tmp_path / "check"), time="asked_at", partitions=2)
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 3
    assert Ledger(spark, str(tmp_path / "out")).log().count() == 60


def test_many_parts_are_few_jobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipelines, "WAVES", 2, raising=False)
    jobs, annotate = [], pipelines.annotate
    monkeypatch.setattr(pipelines, "annotate", lambda *a: jobs.append(1) or annotate(*a))
    tools = '[{"name": "f", "parameters": {}}]'
    plan = spark.createDataFrame([(k, "m", tools, "{}", [("user", "x")]) for k in range(40)], "source_index long, ablation_mode string, tools string, parameter_mapping string, teacher_prompt array<struct<role:string,content:string>>")
    reply = json.dumps({"success": [{"request": "r", "tool": "f", "call": "[f()]"}], "failed": [], "description": "d"})
    folder = str(tmp_path / "run")
    assert pipelines.annotate_in_parts(plan, lambda: lambda messages: reply, folder, every=8) == 5
    ledger = Ledger(spark, folder)
    assert len(jobs) == 2 and len(ledger.parts()) == 5 and ledger.parts() == sorted(set(ledger.parts()))
    assert ledger.of_plan(plan, pipelines.record_schema(plan)).where("status = 'valid'").count() == 40
    assert ledger.sweep() == [] and all(n == "log" or n.startswith("part=") for n in io.children(spark, folder))
    assert pipelines.annotate_in_parts(plan, lambda: lambda messages: 1 / 0, folder, every=8) == 0
