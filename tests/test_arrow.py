"""The Arrow folder source: splits, formats, columns, filters, commits."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kilnwork.sources import arrow as A


def table(n=1000):
    words = pa.array([f"w{i % 7}" if i % 11 else None for i in range(n)])
    return pa.table({"a": pa.array(range(n), pa.int64()), "b": words, "c": words.dictionary_encode(), "d": pa.array([[i, None] for i in range(n)], pa.list_(pa.int32())), "e": pa.array([{"x": float(i)} for i in range(n)])})


def save(path, t, rows=50, form="stream", **options):
    make = {"stream": pa.ipc.new_stream, "file": pa.ipc.new_file}[form]
    with pa.OSFile(str(path), "wb") as f, make(f, t.schema, options=pa.ipc.IpcWriteOptions(**options)) as w:
        for b in t.to_batches(max_chunksize=rows):
            w.write_batch(b)


@pytest.mark.parametrize("form", ["stream", "file"])
@pytest.mark.parametrize("options", [{}, {"compression": "zstd"}, {"use_legacy_format": True}])
def test_every_batch_belongs_to_one_range(tmp_path, form, options):
    if form == "file" and options.get("use_legacy_format"):
        pytest.skip("files never had it")
    t = table()
    save(tmp_path / "x.arrow", t, form=form, **options)
    path = str(tmp_path / "x.arrow")
    size = (tmp_path / "x.arrow").stat().st_size
    for split in (1, 1000, 4096, 10**9) if not options else (3000,):
        parts = [list(A.batches_between(path, at, at + split, ["a", "c"])) for at in range(0, size, split)] if split > 1 else [list(A.batches_between(path, 0, size, ["a", "c"]))]
        got = pa.Table.from_batches([b for p in parts for b in p])
        assert got.column("a").to_pylist() == t.column("a").to_pylist() and got.column("c").to_pylist() == t.column("c").to_pylist() and got.schema.names == ["a", "c"]
        assert split >= size or split == 1 or sum(map(bool, parts)) > 3
    assert A.schema_of(path).names == t.schema.names


def test_source_splits_one_file_and_prunes_columns(spark, tmp_path):
    t = table(2000)
    save(tmp_path / "data-0.arrow", t)
    save(tmp_path / "data-1.arrow", t.slice(0, 0), form="file")
    (tmp_path / "state.json").write_text("{}")
    df = A.read_arrow(spark, str(tmp_path), split_bytes=8000)
    assert df.rdd.getNumPartitions() > 8 and df.count() == 2000 and set(df.columns) == set(t.schema.names)
    assert df.select(F.sum("a"), F.count("b"), F.count("c"), F.sum(F.size("d")), F.sum("e.x")).first()[:4] == (1999000, 2000 - 182, 2000 - 182, 4000)
    few = A.read_arrow(spark, f"file://{tmp_path}", ["b", "a"])
    assert few.columns == ["b", "a"] and few.where("b = 'w3'").count() == sum(1 for i in range(2000) if i % 7 == 3 and i % 11)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "b#" in plan and "d#" not in plan and "e#" not in plan
    with pytest.raises(Exception, match="no .arrow file|No such|not found"):
        (tmp_path / "none").mkdir()
        A.read_arrow(spark, str(tmp_path / "none")).count()


def test_writing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).select("id", F.col("id").cast("string").alias("s"), F.array("id").alias("l")).repartition(3)
    A.write_arrow(df, path)
    A.write_arrow(df.where("id < 10"), path, "append")
    assert A.read_arrow(spark, path).count() == 110 and A.read_arrow(spark, path, ["s"]).where("s = '3'").count() == 2
    A.write_arrow(df.where("id < 5"), path, "overwrite")
    assert sorted(r.id for r in A.read_arrow(spark, path).collect()) == list(range(5))
    broken = df.withColumn("id", F.when(F.col("id") == 99, F.raise_error("end")).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="end"):
        A.write_arrow(broken, path, "append")
    assert A.read_arrow(spark, path).count() == 5  # a task that was still writing may leave a hidden file, which is never read
    A.write_arrow(df.where("false"), path, "overwrite")
    assert A.read_arrow(spark, path).count() == 0 and A.read_arrow(spark, path).columns == ["id", "s", "l"]


def test_stores_that_only_hadoop_knows(spark, tmp_path):
    save(tmp_path / "a.arrow", table(300))
    save(tmp_path / "b.arrow", table(200), form="file", compression="zstd")
    (tmp_path / "state.json").write_text("{}")
    assert A.reaches(str(tmp_path)) and A.reaches("file:///x") and not A.reaches("viewfs://cluster/x")
    df = A.whole_files(spark, str(tmp_path), ["c", "a"])
    assert df.columns == ["c", "a"] and df.agg(F.sum("a"), F.count("c")).first()[:2] == (sum(range(300)) + sum(range(200)), 500 - len(range(0, 300, 11)) - len(range(0, 200, 11)))
    assert sorted(map(str, A.whole_files(spark, str(tmp_path)).collect())) == sorted(map(str, A.read_arrow(spark, str(tmp_path)).collect()))
    with pytest.raises(FileNotFoundError):
        A.whole_files(spark, str(tmp_path / "state.json"))
