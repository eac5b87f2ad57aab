"""Tables and JSONL in and out."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = {"valid": "valid", "invalid": "invalid_schema", "failed": "failed_parse_or_request", "dry_run": "dry_run"}


def exists(spark: SparkSession, path: str) -> bool:
    """On any Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Moves a folder to a name that is free; whether it did."""
    fs, p = _at(spark, old)
    to = _at(spark, new)[1]
    fs.mkdirs(to.getParent())
    return not fs.exists(to) and fs.rename(p, to)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, p = _at(spark, path)
    fs.create(p, True).close()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below spark.checkpoint.dir, the folder that driver and executors share; below the machine's temporary one where none is set and all runs here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/kilnwork-{os.getuid()}"
    return f"{found.rstrip('/')}/kilnwork-core/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """A table that is evaluated once, written and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_dataset(spark: SparkSession, path: str, split: str = "train", form: str = "parquet") -> DataFrame:
    """A table in any format that Spark reads; of a folder of splits the named one, if it is there."""
    inner = f"{path}/{split}"
    return spark.read.format(form).load(inner if exists(spark, inner) else path)


def read_arrow_dir(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Arrow IPC stream files that every executor can open, a task for each."""
    import pyarrow as pa

    with pa.OSFile(paths[0], "rb") as f:
        schema = pa.ipc.open_stream(f).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                with pa.OSFile(path, "rb") as f:
                    yield from pa.ipc.open_stream(f)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return files.mapInArrow(run, from_arrow_schema(schema))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file or folder; blank lines are skipped, a path that isn't there is empty."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_buckets(spark: SparkSession, folder: str, schema: str, names: tuple[str, ...] = ("valid", "invalid", "failed")) -> DataFrame:
    """The result buckets of an earlier run, each row with its bucket's status."""
    parts = [read_jsonl(spark, f"{folder}/bucket={n}", schema).withColumn("status", F.lit(BUCKETS[n])) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_buckets(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """One write, so that the input is evaluated once: a JSONL folder per bucket (bucket=valid and so on), unknown statuses with the failed ones."""
    with_bucket(df).write.mode(mode).partitionBy("bucket").json(folder)


def with_bucket(df: DataFrame) -> DataFrame:
    bucket = F.lit("failed")
    for name, status in BUCKETS.items():
        bucket = F.when(F.col("status") == status, name).otherwise(bucket)
    return df.withColumn("bucket", bucket)


def success_cases(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Valid rows that have a success."""
    return read_buckets(spark, folder, schema, ("valid",)).where(F.size("teacher_success") > 0)


def save_dataset(df: DataFrame, path: str, *, overwrite: bool = True, form: str = "parquet") -> None:
    """Saves a table in two phases, so that a job that fails leaves what was there, and a table may replace its own input.

    Everything is written to a hidden folder beside the target, which then takes its name; an old table stands aside until that is done and
    comes back if it can't be. Without `overwrite` an existing target is an error, both before anything is computed and when the rows are
    written, if another run was faster. Between the two renames of a replacement the table is missing for a moment.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    parent, _, name = path.rpartition("/")
    mark = uuid.uuid4().hex
    staged, aside = f"{parent}/.{name}.new-{mark}", f"{parent}/.{name}.old-{mark}"

    def check() -> None:
        if not overwrite and exists(spark, path):
            raise AnalysisException(f"{path} exists already")

    check()
    try:
        df.write.format(form).save(staged)
        check()
        if exists(spark, path) and not rename(spark, path, aside):
            raise OSError(f"{path} could not be set aside")
        if not rename(spark, staged, path):
            if exists(spark, aside):
                rename(spark, aside, path)
            raise OSError(f"{path} could not be put in place")
    finally:
        delete(spark, staged)
    delete(spark, aside)


def save_readable(df: DataFrame, path: str) -> None:
    """The seven columns and the prompt's length, as JSONL."""
    df.select("system", "user", "assistant", "tools", "tool_type", "tool_count", "refusal", F.col("prompt_token_length")).write.mode("overwrite").json(path)


def first_rows(df: DataFrame, key: str, n: int, condition: str = "true") -> list[dict]:
    """For previews: the n rows of least key that meet a condition."""
    return [json.loads(x) for x in df.where(condition).orderBy(key).limit(n).toJSON().collect()]


#: What each kind of preview shows: how many rows, and which.
PREVIEWS = {"structured": (5, "true"), "parameters": (5, "ablation_applied"), "modes": (8, "ablation_mode <> 'none'"), "annotations": (10, "true")}


def preview(df: DataFrame, key: str, kind: str) -> DataFrame:
    """The rows of least key that a preview of this kind shows."""
    n, condition = PREVIEWS[kind]
    return df.where(condition).orderBy(key).limit(n)


def preview_markdown(rows: list[dict], title: str, fields: tuple[str, ...]) -> str:
    """Rows as a document: a section each, short values as a list, others in blocks. Fields that a row lacks are left out."""
    out = [f"# {title}"]
    for i, row in enumerate(rows, 1):
        texts = {f: row[f] if isinstance(row[f], str) else json.dumps(row[f], ensure_ascii=False, indent=2) for f in fields if row.get(f) is not None}
        short = [f"- {f}: `{t}`" for f, t in texts.items() if len(t) <= 60 and "\n" not in t]
        long = [f"### {f}\n\n````\n{t}\n````" for f, t in texts.items() if len(t) > 60 or "\n" in t]
        out += [f"## {i}", *(["\n".join(short)] if short else []), *long]
    return "\n\n".join(out) + "\n"
