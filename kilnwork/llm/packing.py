"""Operator 6, best-fit packing: the sum-of-squares rule.

Documents become pieces of at most `capacity` tokens. Of the open sequences with room and a new one a piece goes where the sum, over
gaps, of the squared number of open sequences with that gap becomes smallest. At the end sequences with much room are dissolved where
the same rule finds room for all their pieces in the others. Pieces are dealt by a hash into shards of bounded size that are packed apart,
largest pieces first, so the sequences left open at the end are few against those that are full.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, rows, table, words_of

CAPACITY = 4096
#: Pieces that one task packs; a shard of this size leaves well under a thousandth of its sequences open.
SHARD_PIECES = 40_000
END_ID = 1


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet, by code point: bytes that print stand for themselves, the others follow from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(others)}


class WordIds(dict):
    """A word's ids as little-endian unsigned 32-bit numbers. This vocabulary drops white space and no token spans it, so a
    text's ids are those of its words in turn. A word of Latin letters with ASCII punctuation behind it is cut by the
    pre-tokenizer just there and its case is folded, so both parts are looked up apart and letters go straight to
    the BPE model. The memo has two generations of at most `limit` words: once the younger one is full it becomes the elder, and
    words that are met again move on, so frequent ones stay."""

    SHAPE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+)([.,;:!?%#$&*|]*)")

    def __init__(self, path: str, limit: int = 150_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.letters, self.elder = Tokenizer.from_file(path), limit, byte_letters(), {}
        self.encode, self.split = self.tokenizer.encode, self.tokenizer.model.tokenize
        probe = "Probe,"
        got = [t.id for t in self.split("probe")] + self.encode(",", add_special_tokens=False).ids
        self.plain = got == self.encode(probe, add_special_tokens=False).ids  # another vocabulary may not work so

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.elder = dict(self)
            self.clear()
        if (found := self.elder.get(word)) is not None:
            self[word] = found
            return found
        text = word.decode("utf-8", "replace")
        shape = self.SHAPE.fullmatch(text) if self.plain else None
        if shape is None:
            ids = self.encode(text, add_special_tokens=False).ids
        elif shape[2] or not text.islower():
            found = self[shape[1].lower().encode()] + (self[shape[2].encode()] if shape[2] else b"")
            self[word] = found
            return found
        else:
            ids = [t.id for t in self.split(word.decode("latin-1").translate(self.letters))]
        found = self[word] = np.array(ids, "<u4").tobytes()
        return found


_memo: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row: its ids, then END_ID, in pieces of `capacity` tokens. A null text is empty: END_ID alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _memo.get(path) or _memo.setdefault(path, WordIds(path))  # stays with the worker, for its next tasks
        step = 4 * capacity
        for part in rows(batches, "doc_id", "text"):
            out = []
            for doc_id, text in part:
                ids = b"".join(map(ids_of.__getitem__, words_of(text))) + END_ID.to_bytes(4, "little")
                out += [(doc_id, k, k * capacity, len(x) // 4, zlib.crc32(x)) for k in range(-(-len(ids) // step)) for x in (ids[k * step : (k + 1) * step],)]
            yield pa.record_batch([pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(zip(*out))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Sequences:
    """Open sequences by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, np.zeros(capacity + 1, np.int64)  # full ones and new ones don't count
        self.gap: list[int] = []  # by sequence; -1 once it is dissolved
        self.holders: list[list[int]] = [[] for _ in range(capacity + 1)]  # may hold sequences whose gap has changed since

    def enter(self, s: int, gap: int) -> None:
        self.gap[s] = gap
        if gap > 0:
            self.n[gap] += 1
            self.holders[gap].append(s)

    def leave(self, s: int, gap: int = -1) -> None:
        if self.gap[s] > 0:
            self.n[self.gap[s]] -= 1
        self.gap[s] = gap

    def place(self, size: int, opens: bool = True) -> int:
        """Puts a piece where the sum, over gaps, of the squared number of open sequences becomes smallest: into the sequence with
        that gap (of ties the smallest gap), or a new one if `opens` and no other does as well. -1 if it fits nowhere."""
        # taking a sequence of gap g turns it into one of gap g - size: the sum changes by (1 - 2 n[g]) + (1 + 2 n[g - size])
        old, new = self.n[size:], self.n[: self.capacity + 1 - size]
        cost = np.where(old > 0, 2 - 2 * old + 2 * new, np.iinfo(np.int64).max)
        if old[0] > 0:
            cost[0] = 1 - 2 * old[0]  # fills it
        g = int(cost.argmin())
        fresh = 1 + 2 * int(self.n[self.capacity - size]) if size < self.capacity else 0
        if opens and fresh < cost[g]:
            self.gap.append(0)
            s = len(self.gap) - 1
            self.enter(s, self.capacity - size)
            return s
        if cost[g] == np.iinfo(np.int64).max:
            return -1
        g += size
        while self.gap[s := self.holders[g].pop()] != g:
            pass
        self.leave(s)
        self.enter(s, g - size)
        return s


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """For each piece, in the order given, its sequence. Afterwards sequences with much room are dissolved where the rule finds room for
    all their pieces in others."""
    open_ = Sequences(capacity)
    seq = np.array([open_.place(size) for size in lengths.tolist()], np.int64)
    order = np.argsort(seq, kind="stable")
    cuts = np.searchsorted(seq[order], np.arange(len(open_.gap) + 1))
    members = {s: order[cuts[s] : cuts[s + 1]].tolist() for s, gap in enumerate(open_.gap) if gap > 0}
    for s in sorted(members, key=lambda s: (-open_.gap[s], s)):
        gap, moved = open_.gap[s], []
        if gap <= 0:
            continue
        open_.leave(s)
        for i in sorted(members[s], key=lambda i: -lengths[i]):
            if (to := open_.place(int(lengths[i]), opens=False)) < 0:
                break
            moved.append((i, to))
        if len(moved) == len(members[s]):
            for i, to in moved:
                seq[i] = to
                members[to].append(i)
            continue
        for i, to in reversed(moved):
            back = open_.gap[to] + int(lengths[i])
            open_.leave(to)
            open_.enter(to, back)
        open_.enter(s, gap)
    return seq


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place there of every piece, by the sum-of-squares rule, largest pieces first. Sequences are numbered without gaps."""
    order = np.argsort(-sizes, kind="stable")
    seq, off = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    seq[order] = sum_of_squares(sizes[order], capacity)
    seq = np.unique(seq, return_inverse=True)[1]
    by = np.argsort(seq, kind="stable")
    before = np.cumsum(sizes[by]) - sizes[by]
    first = np.searchsorted(seq[by], seq[by])
    off[by] = before - before[first]
    return seq, off


def pack(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, name: str = "pack") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of `docs` (doc_id, text).

    Null and empty texts are END_ID alone; repeated rows and null ids are packed like others; an empty table gives no rows;
    other columns are ignored. Sequences are gapless from offset 0. Ties: the smallest gap.
    """
    # equal rows are spread by their place in the table that is written here, once
    cut = materialize(pieces(docs, path or vocabulary(), capacity).withColumn("salt", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())), f"{name}-pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        seq, off = best_fit(pdf["length"].to_numpy(np.int64), capacity)
        return pdf.assign(sequence_id=seq * shards + pdf["shard"].to_numpy(np.int64), offset=off).drop(columns=["salt", "shard"])

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return cut.withColumn("shard", F.pmod("salt", F.lit(shards))).groupBy("shard").applyInPandas(one, out)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """pack() over what the stages before kept; a document that the mix repeats is packed as often."""
    return pack(docs, name="pack-stage")
