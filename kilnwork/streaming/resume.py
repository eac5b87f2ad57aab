"""Annotations as a stream: files of records come in, are checked, and go to their buckets batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.teacher import STATUSES, check_annotations
from ..sources.ledger import KEY, MODE, Ledger

#: From the worst status to the best.
ORDER = tuple(reversed(STATUSES))
#: Groups that keys are dealt over, for as long as a checkpoint lives; and a time behind all others.
STATES, NEVER = 4096, (1 << 63) - 1


def stream_to_buckets(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Reads JSONL from `source`, validates every record and appends it under its status. A batch that runs again overwrites its own
    folder, so each record is kept once. Stops when what is there has been read."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("status").json(f"{folder}/batch={number}")

    records = check_annotations(spark.readStream.schema(schema).json(source))
    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def improving(records: DataFrame, *, time: str, late: str = "1 day") -> DataFrame:
    """Of a stream of records (source_index, ablation_mode, status, `time` and others) those that are the first of their key and mode, or have
    a better status than all before them; what is repeated or worse goes.

    State is one small number for each key and mode. It is kept until the watermark, `late` behind the latest time seen, has passed its last
    record by as much again; records that come later than the watermark are dropped. Of records of one status in a batch the
    earliest counts, then the least as text. A status of no rank counts as the worst. Keys are dealt by hash over STATES groups, each with a
    table of its keys' numbers as its state, so that Python is called for groups of records, not for every key.
    """
    rank = F.coalesce(*(F.when(F.col("status") == s, i) for i, s in enumerate(ORDER)), F.lit(-1))
    name, order = F.to_json(F.struct(KEY, MODE)), F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(NEVER))
    light = records.withWatermark(time, late).select(F.pmod(F.xxhash64(KEY, MODE), F.lit(STATES)).alias("group"), name.alias("name"), F.col(time).alias("at"), order.alias("micros"), rank.alias("rank"), F.to_json(F.struct(*(F.col(c) for c in records.columns))).alias("record"))
    hold = int(pd.Timedelta(late).total_seconds() * 1000)

    def first(rows: list[pd.DataFrame]) -> pd.DataFrame:
        both = pd.concat(rows) if len(rows) > 1 else rows[0]
        return both.sort_values(["rank", "micros", "record"], ascending=[False, True, True]).drop_duplicates("name")

    def better(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = pa.ipc.open_stream(state.get[0]).read_pandas().set_index("name") if state.exists else pd.DataFrame({"best": [], "until": []}, dtype="int64", index=pd.Index([], name="name", dtype=object))
        if not state.hasTimedOut:
            top = None
            for pdf in parts:
                pdf = pdf[["name", "micros", "rank", "record"]]
                top = first([pdf] if top is None else [top, pdf])
            if top is not None and len(top):
                best = held["best"].reindex(top["name"]).fillna(-2).to_numpy()
                good = top["rank"].to_numpy() > best
                if good.any():
                    yield pd.DataFrame({"record": top["record"][good]})
                seen = top["micros"].where(top["micros"] != NEVER, 0).to_numpy() // 1000
                fresh = pd.DataFrame({"best": np.maximum(best, top["rank"].to_numpy()).astype(np.int64), "until": np.maximum(seen, now) + hold}, index=pd.Index(top["name"], name="name"))
                held = pd.concat([held[~held.index.isin(fresh.index)], fresh])
        held = held[held["until"] >= now]
        if len(held):
            out = pa.BufferOutputStream()
            table = pa.table({"name": pa.array(held.index, pa.string()), "best": held["best"].to_numpy(), "until": held["until"].to_numpy()})
            with pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table)
            state.update((out.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(int(held["until"].min()))
        elif state.exists:
            state.remove()

    kept = light.groupBy("group").applyInPandasWithState(better, "record string", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(F.from_json("record", records.schema).alias("r_")).select("r_.*")


def stream_to_ledger(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, *, time: str, late: str = "1 day", files: int | None = None, partitions: int | None = None) -> StreamingQuery:
    """As stream_to_buckets(), but into a ledger, a part for each batch, and only what improves(): the last record of a key and mode is its best one.
    A batch that was committed before the run broke off is not committed again. `files`: of how many files a batch is at most; `partitions`: into how many the state is dealt, for as long as the checkpoint lives (the session's
    shuffle partitions by default)."""
    key = spark.createDataFrame([], schema).schema[KEY].dataType.simpleString()

    def put(batch: DataFrame, number: int) -> None:
        Ledger(batch.sparkSession, folder, key=key).append(batch, name=f"{number:08d}-stream")

    reader = spark.readStream.schema(schema)
    records = check_annotations((reader.option("maxFilesPerTrigger", files) if files else reader).json(source))
    writer = improving(records, time=time, late=late).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:  # a stream takes the setting over when it starts
        if partitions:
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
        return writer.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
