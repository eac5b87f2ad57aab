"""Streams of annotation records: repeated, late and improving ones."""

import json

from kilnwork.operators import teacher
from kilnwork.sources.ledger import Ledger
from kilnwork.streaming.resume import stream_to_ledger

SCHEMA = f"source_index long, ablation_mode string, teacher_success {teacher.SUCCESS}, teacher_failed {teacher.FAILED}, teacher_description string, tool_names array<string>, old_names array<string>, note string, asked_at timestamp"


def record(key, good, note, at, mode="m"):
    return {"source_index": key, "ablation_mode": mode, "teacher_success": [{"request": "r", "tool": "f", "call": "[f()]" if good else "none"}], "teacher_failed": [], "teacher_description": "d", "tool_names": ["f"], "old_names": [], "note": note, "asked_at": at}


def wave(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_the_best_record_stays(spark, tmp_path):
    into, out = tmp_path / "in", str(tmp_path / "out")
    into.mkdir()

    def run():
        stream_to_ledger(spark, str(into), SCHEMA, out, str(tmp_path / "check"), time="asked_at", late="2 hours", files=1).awaitTermination()
        rows = Ledger(spark, out).records(f"{SCHEMA}, status string").collect()
        return sorted((r.source_index, r.ablation_mode, r.status, r.note) for r in rows)

    day = "2024-01-01T{:02d}:00:00Z".format
    wave(into, "a.json", [record(1, False, "a", day(1)), record(2, True, "a", day(1)), record(2, True, "b", day(1)), record(3, False, "a", day(1)), record(3, False, "a", day(1), "other")])
    first = [(1, "m", "invalid_schema", "a"), (2, "m", "valid", "a"), (3, "m", "invalid_schema", "a"), (3, "other", "invalid_schema", "a")]
    assert run() == first
    wave(into, "b.json", [record(1, True, "better", day(2)), record(2, False, "worse", day(2)), record(3, False, "again", day(2))])
    second = [(1, "m", "valid", "better"), *first[1:]]
    assert run() == second
    assert run() == second  # nothing new
    wave(into, "c.json", [record(9, True, "far on", day(12))])
    assert run() == [*second, (9, "m", "valid", "far on")]
    wave(into, "d.json", [record(3, True, "too late", day(3)), record(9, False, "worse", day(12)), record(4, True, "in time", day(11))])
    assert run() == [*second, (4, "m", "valid", "in time"), (9, "m", "valid", "far on")]
    parts = Ledger(spark, out).parts()
    assert len(parts) == len(set(parts)) >= 4 and Ledger(spark, out).append(spark.createDataFrame([], f"{SCHEMA}, status string"), name=parts[0]) == parts[0]
