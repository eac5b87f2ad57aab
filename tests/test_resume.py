"""Resumed annotation: the log, plans that change between runs, broken runs; and the window of requests."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from kilnwork.operators import teacher
from kilnwork.operators.endpoint import Limits, TokenBucket, asked
from kilnwork.plans import pipelines
from kilnwork.sources import io
from kilnwork.sources.ledger import Ledger

PLAN = "source_index long, ablation_mode string, tools string, parameter_mapping string, teacher_prompt array<struct<role:string,content:string>>"
TOOLS = json.dumps([{"name": "f", "parameters": {}}])
GOOD = {"success": [{"request": "r", "tool": "f", "call": "[f()]"}], "failed": [], "description": "d"}


def plan(spark, modes):
    return spark.createDataFrame([(k, m, TOOLS, "{}", [("user", f"{k} {m}")]) for k, m in modes.items()], PLAN).repartition(3)


def client(folder, bad=()):
    """Notes every question in a file; keys in `bad` get a reply that is no JSON."""

    def make():
        def reply(messages):
            key, mode = messages[0]["content"].split()
            with open(f"{folder}/asked", "a") as f:
                f.write(f"{key} {mode}\n")
            return "no" if int(key) in bad else json.dumps(GOOD)

        return reply

    return make


def asked_in(folder):
    try:
        return sorted((int(k), m) for k, m in (line.split() for line in open(f"{folder}/asked")))
    finally:
        open(f"{folder}/asked", "w").close()


def current(spark, p, folder):
    return sorted((r.source_index, r.ablation_mode, r.status) for r in Ledger(spark, folder).of_plan(p, pipelines.record_schema(p)).collect())


def test_plans_that_grow_shrink_and_change_modes(spark, tmp_path):
    folder, notes = str(tmp_path / "run"), str(tmp_path)
    small = {k: "a" for k in range(20)}
    assert pipelines.annotate_in_parts(plan(spark, small), client(notes), folder, every=10) == 2
    assert asked_in(notes) == sorted(small.items())
    grown = {k: "a" for k in range(50)}
    assert pipelines.annotate_in_parts(plan(spark, grown), client(notes), folder, every=10) == 3
    assert asked_in(notes) == [(k, "a") for k in range(20, 50)]
    assert current(spark, plan(spark, grown), folder) == [(k, "a", "valid") for k in range(50)]
    shrunk = {k: "a" for k in range(10, 15)}
    assert pipelines.annotate_in_parts(plan(spark, shrunk), client(notes), folder, every=10) == 0 and asked_in(notes) == []
    assert current(spark, plan(spark, shrunk), folder) == [(k, "a", "valid") for k in range(10, 15)]
    moded = {k: "b" if k % 5 == 0 else "a" for k in range(60)}
    assert pipelines.annotate_in_parts(plan(spark, moded), client(notes), folder, every=7) == -(-20 // 7)
    assert asked_in(notes) == sorted((k, m) for k, m in moded.items() if m == "b" or k >= 50)
    assert current(spark, plan(spark, moded), folder) == sorted((k, m, "valid") for k, m in moded.items())
    assert pipelines.annotate_in_parts(plan(spark, grown), client(notes), folder, every=10) == 0  # what was asked for under the old modes is still there


def test_records_that_failed_are_tried_again_if_told(spark, tmp_path):
    folder, notes = str(tmp_path / "run"), str(tmp_path)
    p = plan(spark, {k: "a" for k in range(12)})
    pipelines.annotate_in_parts(p, client(notes, bad={3, 7}), folder, every=5)
    assert [s for _, _, s in current(spark, p, folder)].count("failed_parse_or_request") == 2
    asked_in(notes)
    assert pipelines.annotate_in_parts(p, client(notes), folder) == 0
    assert pipelines.annotate_in_parts(p, client(notes), folder, retry=pipelines.RETRIED) == 1
    assert asked_in(notes) == [(3, "a"), (7, "a")]
    assert current(spark, p, folder) == [(k, "a", "valid") for k in range(12)]


def test_what_no_log_has_does_not_count(spark, tmp_path):
    """A part that was written, and one whose keys were, before the run ended; both go at the next run."""
    folder, notes = str(tmp_path / "run"), str(tmp_path)
    p = plan(spark, {k: "a" for k in range(6)})
    ledger = Ledger(spark, folder)
    records = pipelines.annotate(p, p.select("source_index").limit(0), client(notes))
    io.write_buckets(records, f"{folder}/part=00000000-broken")
    records.select("source_index", "ablation_mode", "status").write.parquet(f"{folder}/uncommitted-00000000-broken")
    assert ledger.parts() == [] and ledger.log().count() == 0 and ledger.of_plan(p, pipelines.record_schema(p)).count() == 0
    asked_in(notes)
    assert pipelines.annotate_in_parts(p, client(notes), folder, every=2) == 3 and len(asked_in(notes)) == 6
    assert current(spark, p, folder) == [(k, "a", "valid") for k in range(6)]
    assert all("broken" not in n for n in io.children(spark, folder))


def test_stored_records_are_judged_anew(spark, tmp_path):
    """A record that was stored as invalid and validates now counts as valid without being asked for; one that no longer validates counts as invalid."""
    folder, notes = str(tmp_path / "run"), str(tmp_path)
    p = plan(spark, {k: "a" for k in range(4)})
    records = pipelines.annotate(p, p.select("source_index").limit(0), client(notes))
    wrong = F.when(F.col("source_index") == 1, "invalid_schema").otherwise(F.col("status"))
    broken = F.when(F.col("source_index") == 2, F.col("teacher_json").withField("description", F.lit(""))).otherwise(F.col("teacher_json"))
    Ledger(spark, folder).append(records.withColumns({"status": wrong, "teacher_json": broken}))
    asked_in(notes)
    assert pipelines.annotate_in_parts(p, client(notes), folder) == 0 and asked_in(notes) == []
    assert current(spark, p, folder) == [(0, "a", "valid"), (1, "a", "valid"), (2, "a", "invalid_schema"), (3, "a", "valid")]
    stored = Ledger(spark, folder).of_plan(p, pipelines.record_schema(p)).where("source_index = 1").first()
    assert stored.tools == TOOLS and stored.bucket == "valid"
    assert pipelines.annotate_in_parts(p, client(notes), folder, retry=pipelines.RETRIED) == 1 and asked_in(notes) == [(2, "a")]


def test_empty_and_repeated_plans(spark, tmp_path):
    folder, notes = str(tmp_path / "run"), str(tmp_path)
    assert pipelines.annotate_in_parts(plan(spark, {}) if False else spark.createDataFrame([], PLAN), client(notes), folder) == 0
    p = plan(spark, {1: "a", 2: "b"})
    twice = p.unionByName(p)
    assert pipelines.annotate_in_parts(twice, client(notes), folder) == 1 and len(asked_in(notes)) == 2
    assert current(spark, twice, folder) == [(1, "a", "valid"), (2, "b", "valid")]


# ---- the window of requests ----


def test_window_keeps_so_many_going_and_slow_ones_hold_up_nothing():
    lock, now, most, order = threading.Lock(), [0], [0], []

    def ask(request):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.4 if request == 0 else 0.01)
        with lock:
            now[0] -= 1
        return request * 10

    for key, answer, error, tries in asked(((i, i) for i in range(40)), ask, Limits(in_flight=4)):
        order.append(key)
        assert answer == key * 10 and error is None and tries == 1
    assert sorted(order) == list(range(40)) and most[0] == 4 and order.index(0) > 30


def test_requests_are_taken_as_they_are_needed():
    taken = []
    source = (taken.append(i) or (i, i) for i in range(100))
    window = asked(source, lambda r: r, Limits(in_flight=3))
    next(window)
    assert len(taken) <= 4
    assert len(list(window)) == 99


def test_failures_are_retried_later_and_reported():
    lock, calls = threading.Lock(), {}

    def ask(request):
        with lock:
            calls[request] = calls.get(request, 0) + 1
            n = calls[request]
        if request % 3 == 0 and n < 3:
            raise ConnectionError(f"try {n}")
        if request == 7:
            raise ValueError("never")
        return n

    got = {k: (a, e, t) for k, a, e, t in asked(((i, i) for i in range(10)), ask, Limits(in_flight=2, tries=3, backoff=0.01))}
    assert len(got) == 10 and all(got[i][0] == 3 and got[i][2] == 3 for i in (0, 3, 6, 9)) and isinstance(got[7][1], ValueError) and got[7][2] == 3 and got[1] == (1, None, 1)


def test_timeouts():
    stop = threading.Event()

    def ask(request):
        if request == 1:
            stop.wait(20)
        return request

    got = {k: (a, e) for k, a, e, _ in asked(((i, i) for i in range(6)), ask, Limits(in_flight=2, timeout=0.15, tries=2, backoff=0.01))}
    assert isinstance(got.pop(1)[1], TimeoutError) and got == {i: (i, None) for i in (0, 2, 3, 4, 5)}
    with pytest.raises(RuntimeError, match="hang"):
        list(asked(((i, 1) for i in range(6)), ask, Limits(in_flight=2, timeout=0.05, tries=1, hanging=2)))
    stop.set()


def test_tokens_are_spent_at_their_rate():
    at = [0.0]
    bucket = TokenBucket(2.0, lambda: at[0])  # 120 at first
    bucket.spend(120)
    assert bucket.wait(10) == 5.0
    at[0] = 5.0
    assert bucket.wait(10) == 0.0
    bucket.spend(10)
    at[0] = 1000.0
    assert bucket.wait(500) == 0.0  # more than a bucket holds: when it is full
    bucket.spend(500)
    assert bucket.wait(1) == pytest.approx((1 + 380) / 2)
    began = time.monotonic()
    assert len(list(asked(((i, i) for i in range(5)), lambda r: r, Limits(tokens_per_minute=60 * 20, tasks=1), cost=lambda r: 310.0))) == 5
    assert time.monotonic() - began > (5 * 310 - 1200) / 20 - 1
    with pytest.raises(ValueError):
        Limits(tokens_per_minute=5).share()


def test_annotation_over_batches_with_slow_and_failing_replies(spark):
    asked_for = spark.range(30).select(F.col("id").cast("string").alias("source_index"), F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("teacher_prompt"))

    def make():
        tries = {}

        def reply(messages):
            i = int(messages[0]["content"])
            tries[i] = tries.get(i, 0) + 1
            time.sleep(0.2 if i % 7 == 0 else 0)
            return "none" if i % 10 == 3 else json.dumps({"description": f"d{i}"})

        return reply

    got = {r.source_index: r for r in teacher.annotate(asked_for, make, limits=Limits(in_flight=3, tries=2, backoff=0.01, every=4, tasks=2)).collect()}
    assert sorted(got, key=int) == [str(i) for i in range(30)]
    assert all((r.description is None and "ValueError" in r.error and r.raw == "none") if int(k) % 10 == 3 else r.description == f"d{k}" and r.error is None for k, r in got.items())
