"""What the corpus operators share: reading tables, the shared folder, words and their hashes."""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as a Java and RE2 pattern. ``bytes.split()`` cuts at the same six ASCII bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is set, as in tests, a temporary one if all
    runs on this machine. On a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/kilnwork-{os.getuid()}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kilnwork/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives the loss of executors, and keeps Python work from running twice."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    for df in tables:
        spark, path = df.sparkSession, df.written_at
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of a bitmap filter: at least and at most so many (32 MB).
BITS_LEAST, BITS_MOST = 1 << 20, 1 << 28


class KeyFilter:
    """Tells rows whose key is surely not among `keys` from those where it may be: a bitmap over hashes, at most 32 MB at any size,
    that is broadcast. More keys make it less selective, never wrong; a join on the keys themselves follows it."""

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.bits = min(max(BITS_LEAST, 1 << (32 * n).bit_length()), BITS_MOST)
        place = keys.select(self.place(*keys.columns).alias("p"))
        maps = place.groupBy(F.shiftright("p", 15).alias("kf_part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("kf_map"))
        self.maps = materialize(maps, "filter")

    def place(self, *columns):
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits))

    def mark(self, df: DataFrame, name: str, *columns) -> DataFrame:
        """df with a boolean column: whether its key in `columns` may be among the keys."""
        at = df.withColumn("kf_at", self.place(*columns))
        both = at.join(F.broadcast(self.maps), F.shiftright("kf_at", 15) == F.col("kf_part"), "left")
        byte = F.conv(F.hex(F.substring(F.col("kf_map"), F.shiftright(F.col("kf_at").bitwiseAND(32767), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = F.getbit(byte, F.col("kf_at").bitwiseAND(7).cast("int")) == 1
        return both.withColumn(name, F.coalesce(held, F.lit(False))).drop("kf_at", "kf_part", "kf_map")

    def may_hold(self, df: DataFrame, *columns) -> DataFrame:
        return self.mark(df, "kf_held", *columns).where("kf_held").drop("kf_held")


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text as UTF-8 bytes; a null text has none. Lone surrogates (not possible in UTF-8 tables) pass through."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Hashes(dict):
    """XXH64 by word, remembered. The memo empties itself at `limit` words, so a task's memory doesn't grow with the vocabulary."""

    def __init__(self, seed: int = 0, limit: int = 300_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return found

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class KeyedNames(dict):
    """BLAKE2b of 128 bits by word, under a key, remembered as Hashes are."""

    def __init__(self, key: bytes, limit: int = 300_000):
        super().__init__()
        self.key, self.limit = key, limit

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = hashlib.blake2b(word, digest_size=16, key=self.key).digest()
        return found

    def array(self, words: list[bytes]) -> np.ndarray:
        """Two numbers a word."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64).reshape(-1, 2)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int, factor: int) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive numbers."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    out, n = np.zeros(len(h) - width + 1, np.uint64), len(h) - width + 1
    for i in range(width):
        out *= np.uint64(factor)
        out += h[i : i + n]
    return mix64(out)


def give_back() -> None:
    """Returns to the system what this process has freed. Python workers outlive their tasks, and Arrow's and C's allocators keep
    what one stage has freed beside what the next one takes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def returning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what is free is given back behind each of them."""
    for b in batches:
        yield b
        del b
        give_back()


def rows(batches: Iterator[pa.RecordBatch], *names: str, limit_bytes: int = 4 << 20) -> Iterator[list[tuple]]:
    """Rows of Arrow batches in lists of about `limit_bytes` of text at most (one longer text is a list of its own)."""
    out, held = [], 0
    for b in (b.slice(i, 512) for b in returning(batches) for i in range(0, b.num_rows, 512)):
        for row in zip(*(b.column(n).to_pylist() for n in names)):
            size = sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if out and held + size > limit_bytes:
                yield out
                out, held = [], 0
            out.append(row)
            held += size
    if out:
        yield out


def crc_text(column: str):
    """crc32 of the id as text, as Spark's crc32 and zlib have it; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """About `most` rows, those of least seeded hash of `key`, one for each key (of rows that repeat it that of the least other columns). No task
    holds more of them than its share. Of n rows so many keys are drawn that `most` is what is expected; that twice as many come is as good as impossible."""
    n = df.count()
    rest = [c for c in df.columns if c != key]
    room = 1 << 40
    drawn = df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(room)) < F.lit(room * most // n)) if n > most else df
    one = drawn.groupBy(key).agg(F.min(F.struct(*rest)).alias("one_"))
    return one.select(*(key if c == key else F.col(f"one_.{c}") for c in df.columns))
