"""Annotation records that are kept part by part: an append-only log by (source_index, mode) says which parts count.

    folder/part=<number>-<run>/bucket=valid/...   records as JSONL, by bucket
    folder/log/part=<number>-<run>/...            their keys, modes and statuses as Parquet

A part is written first. Its keys go to a folder beside the log, and renaming that into the log commits the part: what was written
by a run that broke off before is in no log, counts nowhere and goes at the next run. Nothing that is committed is changed later; of records
of one key and mode the one of the last part counts. So a plan may grow, shrink or change its modes between runs, in any order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import io

KEY, MODE = "source_index", "ablation_mode"


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, *, key: str = "long"):
        """`key` is the SQL type of source_index."""
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._run = uuid.uuid4().hex[:12]

    def _parts(self, where: str) -> list[str]:
        return sorted(n.removeprefix("part=") for n in io.children(self.spark, where) if n.startswith("part="))

    def parts(self) -> list[str]:
        """The committed parts, in their order; their number is that of records divided by the size of a part."""
        return [p for p in self._parts(f"{self.folder}/log") if io.exists(self.spark, f"{self.folder}/log/part={p}/_SUCCESS")]

    def sweep(self) -> list[str]:
        """Deletes what was never committed. Only while no other run writes here."""
        known = set(self.parts())
        gone = [f"part={p}" for p in self._parts(self.folder) if p not in known] + [n for n in io.children(self.spark, self.folder) if n.startswith("uncommitted-")]
        for name in gone:
            io.delete(self.spark, f"{self.folder}/{name}")
        return gone

    def append(self, records: DataFrame, name: str | None = None) -> str:
        """Writes records (with source_index, ablation_mode, status) as a part of their own and commits it; evaluates them once. A part of a given
        name that is committed already stays as it is."""
        parts = self.parts()
        if name in parts:
            return name
        name = name or f"{int(parts[-1].split('-')[0]) + 1 if parts else 0:08d}-{self._run}"
        io.write_buckets(records, f"{self.folder}/part={name}")
        keys = io.read_jsonl(self.spark, f"{self.folder}/part={name}", f"{KEY} {self.key}, {MODE} string, status string").select(KEY, MODE, "status")
        keys.write.mode("overwrite").parquet(f"{self.folder}/uncommitted-{name}")
        if not io.rename(self.spark, f"{self.folder}/uncommitted-{name}", f"{self.folder}/log/part={name}"):
            raise OSError(f"part {name} of {self.folder} could not be committed")
        return name

    def append_parts(self, records: DataFrame, number: str) -> list[str]:
        """Writes records as several parts, those of one value of the column `number` each, in one job, and commits each part by itself, in the
        order of numbers; the records are evaluated once."""
        parts = self.parts()
        first = int(parts[-1].split("-")[0]) + 1 if parts else 0
        staged = f"{self.folder}/uncommitted-{uuid.uuid4().hex}"
        io.with_bucket(records).write.partitionBy(number, "bucket").json(f"{staged}/records")
        names = {}
        for i in sorted(int(n.partition("=")[2]) for n in io.children(self.spark, f"{staged}/records") if n.startswith(f"{number}=")):
            names[i] = f"{first + len(names):08d}-{self._run}"
        keys = self.spark.read.schema(f"{KEY} {self.key}, {MODE} string, status string, {number} int").json(f"{staged}/records").select(KEY, MODE, "status", number)
        keys.repartition(number).write.partitionBy(number).parquet(f"{staged}/keys")
        for i, name in names.items():
            io.touch(self.spark, f"{staged}/keys/{number}={i}/_SUCCESS")
            for old, new in (("records", f"{self.folder}/part={name}"), ("keys", f"{self.folder}/log/part={name}")):
                if not io.rename(self.spark, f"{staged}/{old}/{number}={i}", new):
                    raise OSError(f"part {name} of {self.folder} could not be committed")
        io.delete(self.spark, staged)
        return list(names.values())

    def log(self) -> DataFrame:
        """source_index, ablation_mode, status, part of all committed records."""
        schema, parts = f"{KEY} {self.key}, {MODE} string, status string, part string", self.parts()
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/log").parquet(*(f"{self.folder}/log/part={p}" for p in parts))

    def latest(self) -> DataFrame:
        """The log, one row for each key and mode: that of the last part."""
        return self.log().groupBy(KEY, MODE).agg(F.max(F.struct("part", "status")).alias("last")).select(KEY, MODE, "last.status", "last.part")

    def records(self, schema: str) -> DataFrame:
        """The committed records that count, with part and bucket; `schema` is that of a record."""
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, part string, bucket string")
        all_ = self.spark.read.schema(f"{schema}, part string, bucket string").option("basePath", self.folder).json([f"{self.folder}/part={p}" for p in parts])
        last = self.latest().select(F.col(KEY).alias("k_"), F.col(MODE).alias("m_"), F.col("part").alias("p_"))
        got = all_.join(last.hint("merge"), F.col(KEY).eqNullSafe(F.col("k_")) & F.col(MODE).eqNullSafe(F.col("m_")) & (F.col("part") == F.col("p_")), "left_semi")
        return got

    def of_plan(self, plan: DataFrame, schema: str) -> DataFrame:
        """For every planned key its record under the planned mode, if there is one; a key that the plan repeats once."""
        planned = plan.select(F.col(KEY).alias("k_"), F.col(MODE).alias("m_")).distinct()
        got = self.records(schema).join(planned.hint("merge"), (F.col(KEY) == F.col("k_")) & F.col(MODE).eqNullSafe(F.col("m_")), "left_semi")
        one = F.row_number().over(Window.partitionBy(KEY, MODE).orderBy("bucket"))
        return got.withColumn("one_", one).where("one_ = 1").drop("one_")

    def pending(self, plan: DataFrame, retry: tuple[str, ...] = ()) -> DataFrame:
        """Planned rows whose key has no record under the planned mode, or one of a status that is to be tried again."""
        done = self.latest()
        done = done.where(~F.col("status").isin(*retry)) if retry else done
        done = done.select(F.col(KEY).alias("k_"), F.col(MODE).alias("m_"))
        return plan.join(done.hint("merge"), (F.col(KEY) == F.col("k_")) & F.col(MODE).eqNullSafe(F.col("m_")), "left_anti")
