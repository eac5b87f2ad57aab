"""Saving in two phases."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kilnwork.sources import io


def names(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.endswith(".crc"))


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_a_table_replaces_its_own_input(spark, tmp_path, form):
    path = str(tmp_path / "t")
    io.save_dataset(spark.range(10), path, form=form)
    for _ in range(2):
        df = io.read_dataset(spark, path, form=form)
        io.save_dataset(df.select((F.col("id") + 1).alias("id")), path, form=form)
    assert sorted(r.id for r in io.read_dataset(spark, path, form=form).collect()) == list(range(2, 12))
    assert names(tmp_path) == ["t"]


def test_a_job_that_fails_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "t")
    io.save_dataset(spark.range(3), path)
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error("end")).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="end"):
        io.save_dataset(broken, path)
    assert io.read_dataset(spark, path).count() == 3 and names(tmp_path) == ["t"]


def test_an_existing_table_is_an_error_before_and_after_the_work(spark, tmp_path):
    path, seen = str(tmp_path / "t"), spark.sparkContext.accumulator(0)
    io.save_dataset(spark.range(3), path)

    def noted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(4).mapInArrow(noted, "id long")
    with pytest.raises(AnalysisException, match="exists"):
        io.save_dataset(df, path, overwrite=False)
    assert seen.value == 0  # nothing was computed

    late = str(tmp_path / "late")

    def other_run(batches):
        import os

        os.makedirs(late, exist_ok=True)  # appears while this run works
        yield from batches

    with pytest.raises(AnalysisException, match="exists"):
        io.save_dataset(spark.range(4).mapInArrow(other_run, "id long"), late, overwrite=False)
    assert names(tmp_path / "late") == [] and names(tmp_path) == ["late", "t"]


def test_the_old_table_comes_back_if_the_new_one_cannot_take_its_place(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "t"), io.rename
    io.save_dataset(spark.range(3), path)
    monkeypatch.setattr(io, "rename", lambda s, old, new: False if ".new-" in old else real(s, old, new))
    with pytest.raises(OSError, match="put in place"):
        io.save_dataset(spark.range(9), path)
    monkeypatch.undo()
    assert io.read_dataset(spark, path).count() == 3 and names(tmp_path) == ["t"]
