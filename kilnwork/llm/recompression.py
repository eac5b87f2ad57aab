"""Operator 1, substring dedup by recompression.

Rounds name runs of equal words, then again and again pairs of neighbouring symbols: a seeded bit of a symbol's name makes it
a left or a right one, and a left one followed by a right one become one symbol. A name is a 64-bit hash of what it stands
for, so it is the same in every partition and no round needs a shuffle. With each symbol goes its reach, the span of
words that decided how it was parsed; a symbol whose reach lies inside a window is therefore named alike wherever the
window's words occur. Each window picks one such symbol of the highest round that has any (single words in the worst case,
as inside a long run), so equal windows pick equal anchors.

Spark counts anchors over all documents; those of one document only are gone for good. What is left is verified: windows
around shared anchors get names of 128 bits, two halves each made pair by pair from those of their words (two, four, ... words, then the
whole); a word's are the halves of a BLAKE2b of 128 bits under a secret key of the run. The smallest doc_id of each name is joined back.
Whole texts are told apart by SHA-256.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Hashes, KeyedNames, KeyFilter, materialize, release, mix64, rows, table, words_of

WINDOW = 50
ROUNDS = 8
#: Odd factors of the two rolling hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Prefix:
    """64-bit hashes of any span of a sequence of numbers: equal spans hash alike. Sequences can be built whose spans hash alike though they
    differ, so these only choose what is compared."""

    def __init__(self, h: np.ndarray, factor: int):
        n = len(h) + 1
        powers = np.full(n, factor, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(h * powers[:-1], out=self.sums[1:])
        inverse = np.full(n, pow(factor, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64))


def levels(h: np.ndarray, bar: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, lo, hi) of the symbols of every round; lo and hi bound the reach. `bar` marks the barriers between documents: they join with nothing."""
    n = len(h)
    at = np.arange(n)
    out = [(h, at, at + 1)]
    same = (h[1:] == h[:-1]) & ~bar[1:] & ~bar[:-1]
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(head, n))
    name = np.where(size > 1, mix64(h[head] + size.astype(np.uint64) * np.uint64(FACTORS[1])), h[head])
    lo, hi, wall = np.maximum(head - 1, 0), np.minimum(head + size + 1, n), bar[head]
    for k in range(rounds):
        out.append((name, lo, hi))
        left = (mix64(name ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(name), bool)
        joins[:-1] = left[:-1] & ~left[1:] & ~wall[:-1] & ~wall[1:]
        mate = np.where(left, np.minimum(np.arange(len(name)) + 1, len(name) - 1), np.maximum(np.arange(len(name)) - 1, 0))  # whose side decides
        lo, hi = np.minimum(lo, lo[mate]), np.maximum(hi, hi[mate])
        second = np.concatenate([[False], joins[:-1]])
        first = np.flatnonzero(joins)
        name = name.copy()
        name[first] = mix64(name[first] * np.uint64(FACTORS[0]) + mix64(name[first + 1]) + np.uint64(k + 1))
        lo[first], hi[first] = np.minimum(lo[first], lo[first + 1]), np.maximum(hi[first], hi[first + 1])
        keep = ~second
        name, lo, hi, wall = name[keep], lo[keep], hi[keep], wall[keep]
    out.append((name, lo, hi))
    return out[::-1]


def window_names(h: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A 64-bit name for every `width` consecutive numbers: pairs of neighbouring names are named again and again, and two overlapping
    names of the largest power of two name the window. Each step scrambles, so unlike a polynomial it has no structure to meet."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    pair = lambda a, b: mix64(a * np.uint64(FACTORS[0]) + mix64(b + np.uint64(salt)))
    name, size = mix64(h + np.uint64(salt)), 1
    while 2 * size <= width:
        name, size = pair(name[: len(name) - size], name[size:]), 2 * size
    rest = width - size
    return pair(name[: len(name) - rest], name[rest:]) if rest else name


def anchors(h: np.ndarray, bar: np.ndarray, starts: np.ndarray, prefix: Prefix, width: int = WINDOW) -> np.ndarray:
    """For each window start the key of the anchor that the window picks: of the highest round's symbols with their reach inside it the one of least hash."""
    keys = np.empty(len(starts), np.uint64)
    todo = np.arange(len(starts))
    for depth, (name, lo, hi) in enumerate(levels(h, bar)):
        if not len(todo):
            break
        p = starts[todo]
        j0, j1 = np.searchsorted(lo, p), np.searchsorted(hi, p + width, side="right")
        ok = np.flatnonzero(j0 < j1)
        if not len(ok):
            continue
        a, b = j0[ok], j1[ok]
        low = (mix64(name) >> np.uint64(26) << np.uint64(26)) | (np.arange(len(name), dtype=np.uint64) & np.uint64((1 << 26) - 1))
        size = b - a
        best, step, table_ = np.full(len(ok), np.iinfo(np.uint64).max, np.uint64), 1, low
        while True:  # minimum over a range: two overlapping power-of-two ranges
            now = np.flatnonzero((size >= step) & (size < 2 * step))
            if len(now):
                best[now] = np.minimum(table_[a[now]], table_[b[now] - step])
            if not (size >= 2 * step).any():
                break
            table_ = np.minimum(table_[:-step], table_[step:])
            step *= 2
        base = a & ~((1 << 26) - 1)
        j = base + (best & np.uint64((1 << 26) - 1)).astype(np.int64)
        j = np.where(j < a, j + (1 << 26), j)
        keys[todo[ok]] = mix64(prefix.spans(lo[j], hi[j]) + np.uint64(depth))
        todo = np.delete(todo, ok)
    return keys


class Batch:
    """Some documents' words one after the other, with a barrier before, between and after them."""

    def __init__(self, words: list[list[bytes]], memo: Hashes):
        n = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(n + 1) - n  # place of each document's first word
        self.n = n
        total = int((n + 1).sum()) + 1
        self.h, self.bar = np.empty(total, np.uint64), np.zeros(total, bool)
        for at, w in zip(self.first.tolist(), words):
            self.h[at : at + len(w)] = memo.array(w)
        self.bar[np.append(self.first - 1, total - 1)] = True
        self.h[self.bar] = 0
        self.prefix = Prefix(self.h, FACTORS[0])

    def named(self, words: list[list[bytes]], names: KeyedNames) -> tuple[np.ndarray, np.ndarray]:
        """The two keyed names of every word, in its place."""
        both = np.zeros((len(self.h), 2), np.uint64)
        for at, w in zip(self.first.tolist(), words):
            both[at : at + len(w)] = names.array(w)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows and the document (by index) of each."""
        count = np.maximum(self.n - width + 1, 0)
        doc = np.repeat(np.arange(len(count)), count)
        return self.first[doc] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), doc


def digest(words: list[bytes]) -> bytes:
    """SHA-256 of words, which hold no spaces, joined by spaces: texts of equal digests have equal words."""
    return hashlib.sha256(b" ".join(words)).digest()


def long_array(x) -> pa.Array:
    return pa.array(x, pa.int64())


def parse(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, sig (SHA-256 of all words), n_words, and the keys of the anchors that its windows pick."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashes()
        for part in rows(batches, "doc_id", "text", limit_bytes=2 << 20):
            words = [words_of(t) for _, t in part]
            batch = Batch(words, memo)
            starts, doc = batch.windows(width)
            keys = anchors(batch.h, batch.bar, starts, batch.prefix, width)
            order = np.lexsort((keys, doc))
            keys, doc = keys[order], doc[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            keys, doc = keys[new], doc[new]
            offsets = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
            yield pa.record_batch(
                [long_array([r[0] for r in part]), pa.array([digest(w) for w in words], pa.binary()), pa.array(batch.n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))],
                ["doc_id", "sig", "n_words", "anchors"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sig binary, n_words long, anchors array<long>")


def candidate_windows(candidates: DataFrame, width: int) -> DataFrame:
    """h1, h2, doc_id, tag, place of every window of the candidates (doc_id, tag, text, keys) that picks one of `keys`."""
    key = secrets.token_bytes(32)  # any will do; without it nobody can make words or texts that are named alike
    salts = [secrets.randbits(64) for _ in range(2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, names = Hashes(), KeyedNames(key)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                words = [words_of(t) for t in c.column("text").to_pylist()]
                batch = Batch(words, memo)
                starts, doc = batch.windows(width)
                keys = anchors(batch.h, batch.bar, starts, batch.prefix, width).view(np.int64)
                lists = c.column("keys")
                shared, of = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(c.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                tag = lambda k, d: mix64(k.view(np.uint64) + mix64(d.astype(np.uint64)))
                use = np.flatnonzero(np.isin(tag(keys, doc), tag(shared, of)))
                p, d = starts[use], doc[use]
                cols = [window_names(h, width, s)[p].view(np.int64) for h, s in zip(batch.named(words, names), salts)]
                cols += [c.column(n).to_numpy(zero_copy_only=False)[d] for n in ("doc_id", "tag")] + [p - batch.first[d]]
                for i in range(0, len(use), 1 << 16):
                    yield pa.record_batch([pa.array(x[i : i + (1 << 16)], pa.int64()) for x in cols], ["h1", "h2", "doc_id", "tag", "place"])

    return candidates.select("doc_id", "tag", "text", "keys").mapInArrow(run, "h1 long, h2 long, doc_id long, tag long, place long")


def strip(candidates: DataFrame, width: int, keep_text: bool) -> DataFrame:
    """doc_id, sig, n_removed, sig_kept, kept text (if asked for) of candidates (doc_id, sig, text, places of repeated windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, sig, text, places in zip(*(b.column(n).to_pylist() for n in ("doc_id", "sig", "text", "places"))):
                w = words_of(text)
                edge = np.zeros(len(w) + 1, np.int64)
                at = np.unique(np.array(places, np.int64))
                edge[at] += 1
                np.add.at(edge, at + width, -1)
                kept = [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                out.append((doc_id, sig, len(w) - len(kept), digest(kept), b" ".join(kept).decode("utf-8", "surrogatepass") if keep_text else None))
            if out:
                types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], ["doc_id", "sig", "n_removed", "sig_kept", "kept_text"])

    return candidates.select("doc_id", "sig", "text", "places").mapInArrow(run, "doc_id long, sig binary, n_removed long, sig_kept binary, kept_text string")


def dedup(docs: DataFrame, *, width: int = WINDOW, keep_text: bool = False, name: str = "op1") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of `docs` (doc_id, text); with keep_text also kept_text, null where nothing was removed.

    A word goes if a window of `width` words over it also starts in a document with a smaller doc_id. Null texts have no
    words; texts shorter than a window lose nothing. Rows without a doc_id lose nothing and cost others nothing. Repeated
    ids don't count against each other. Empty tables give no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    light = materialize(parse(docs, width), f"{name}-parse")
    known = light.where("doc_id is not null")
    # copies of a whole text: all windows of those with larger ids start in the first of them
    first = known.groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    copied = materialize(first.where("first_id < last_id").drop("last_id"), f"{name}-copied")
    of_copies = known.select("doc_id", "sig").join(copied, ["sig"]).where("doc_id > first_id").select("doc_id", "sig").distinct()
    copies = materialize(of_copies, f"{name}-copies")
    # only rows that may be copies are joined: lists of anchors are too much to shuffle
    marked = KeyFilter(copies.select("doc_id", "sig")).mark(known, "maybe_", "doc_id", "sig")
    base = marked.where(~F.col("maybe_")).unionByName(marked.where("maybe_").join(copies, ["doc_id", "sig"], "left_anti")).drop("maybe_")
    marks = base.select("doc_id", "sig", F.explode("anchors").alias("key"))
    # written before they are joined: a join of two plain exchanges can be split where one key has many rows
    shared = materialize(marks.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key"), f"{name}-shared")
    hits = materialize(marks.join(shared, "key").groupBy("doc_id", "sig").agg(F.collect_set("key").alias("keys")), f"{name}-hits")
    texts = KeyFilter(hits.select("doc_id").distinct()).may_hold(docs, "doc_id")  # other texts aren't shuffled
    # of rows that repeat a doc_id the tag tells which is meant, shorter than sig
    candidates = materialize(with_signature(texts).join(hits, ["doc_id", "sig"]).withColumn("tag", F.xxhash64("sig")), f"{name}-texts")
    windows = materialize(candidate_windows(candidates, width), f"{name}-windows")
    owner = materialize(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2", "a"), f"{name}-owner")
    found = windows.join(owner, ["h1", "h2"]).where("doc_id > a").groupBy("doc_id", "tag").agg(F.collect_set("place").alias("places"))
    stripped = materialize(strip(candidates.drop("keys").join(found, ["doc_id", "tag"]), width, keep_text).distinct(), f"{name}-strip")
    release(copied, shared, hits, candidates, windows, owner)
    gone = copies.select("doc_id", "sig", F.lit(True).alias("copy_"))
    joined = light.drop("anchors").join(stripped, ["doc_id", "sig"], "left").join(gone, ["doc_id", "sig"], "left")
    copy = F.col("copy_").isNotNull() & (F.col("n_words") >= width)
    out = joined.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.lower(F.hex(F.when(copy, F.lit(digest([]))).otherwise(F.coalesce("sig_kept", "sig")))).alias("kept_sha256"),
        F.when(copy, "").otherwise(F.col("kept_text")).alias("kept_text"),
    )
    return out if keep_text else out.drop("kept_text")


def with_signature(docs: DataFrame) -> DataFrame:
    """Adds sig, as parse() has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches, "doc_id", "text", limit_bytes=2 << 20):
            sigs = [digest(words_of(t)) for _, t in part]
            yield pa.record_batch([long_array([r[0] for r in part]), pa.array([r[1] for r in part], pa.string()), pa.array(sigs, pa.binary())], ["doc_id", "text", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, sig binary")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p+49], ' ')) AS k FROM s),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS a FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM m WHERE a < doc_id),
x AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY 1),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r,
  CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept
  FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
