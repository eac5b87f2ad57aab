"""Operator 13, phrase collocation mining: a minimal perfect hash over Apriori-safe candidates, level by level.

Words are counted and those frequent enough numbered; texts become arrays of numbers, 0 where a piece ends or a word is rare. A phrase
of k words is the pair of its first and its last k - 1 words, so its key is two numbers and exact, and it is a candidate only if
both are frequent and its bucket of a sieve (hashed counts of all such pairs) is. Tasks add up the candidates they see and hand on
sorted arrays of keys and counts, a slice of the keys each; slices are added up, and what is frequent goes into a minimal perfect
hash that stores its keys, with counts by slot. Tasks look up their pairs: what is frequent is numbered by its slot, arrays of these
numbers replace those of the level before, and counts of a phrase's parts, its cuts, are read by slot.

What is broadcast is bounded: WORDS words or KEYS frequent phrases at a time, a group of them by hash, and 2^SIEVE_MOST bits. More of them take
more passes over the number arrays, none is left out; rare pairs take none, however many a full sieve lets through.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import give_back, materialize, mix64, release, returning, rows, table
from .lm import CHUNK, add_sparse, packed_chunks, sum_chunks
from .perfecthash import PerfectHash

#: Words, and candidates, that are broadcast at a time.
WORDS, KEYS = 250_000, 1_000_000
#: A group's numbers; a group holds far fewer.
ROOM = 22
#: log2 of the sieve's buckets, at least and at most; more pairs make a full sieve less selective, never wrong.
SIEVE_LEAST, SIEVE_MOST = 16, 24
#: Distinct words or keys that a task holds before it hands them on.
HELD, HELD_KEYS = 400_000, 1_000_000
#: Slices of the candidates for every group of them.
SLICES = 256
#: Partial ranks of a language are taken in so many parts first.
PARTS = 64
ENDS = b".,;:!?\n\x0b\x0c\r"
MARK = b"."
_TABLE = bytes.maketrans(ENDS + b"\t", MARK * len(ENDS) + b" ")


def words_in(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with MARK between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE).replace(MARK, b" . ").split(b" ") if text else []


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, c: occurrences, added up in every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                c.pop(MARK, None)
                c.pop(b"", None)
                words = list(c)
                for i in range(0, len(words), 50_000):
                    part = words[i : i + 50_000]
                    yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array([c[w] for w in part], pa.int64())], ["lang", "word", "c"])
            counts.clear()

        for part in rows(batches, "lang", "text"):
            for lang, text in part:
                counts.setdefault(lang, Counter()).update(words_in(text))
            if sum(map(len, counts.values())) > HELD:
                yield from flush()
        yield from flush()

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, word binary, c long")
    return parts.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("c").alias("c"))


def numbers_of(column: pa.Array) -> np.ndarray:
    """The numbers of all rows of a binary column, one behind the other."""
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.empty(0, np.uint32)
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint32, (int(at[-1]) - int(at[0])) // 4, int(at[0]))


def column_of(numbers: np.ndarray, like: pa.Array) -> pa.Array:
    """Other numbers, dealt over rows as those of a column are."""
    at = np.frombuffer(like.buffers()[1], np.int32, len(like) + 1, like.offset * 4)
    return pa.Array.from_buffers(pa.binary(), len(like), [None, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(np.ascontiguousarray(numbers, np.uint32).tobytes())])


def binary(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def spell(docs: DataFrame, vocabulary: DataFrame, groups: int, name: str) -> DataFrame:
    """`now` (binary): every text's words as numbers, 0 for rare ones and between pieces, and behind each text. A group of the vocabulary at a
    time is broadcast; while there are more, texts are carried along."""
    spark, at = docs.sparkSession, docs.select("lang", "text", F.lit(None).cast("binary").alias("now"))
    for g in range(groups):
        mine = vocabulary.where(F.col("g") == g).select("lang", "word", "id").toLocalIterator()  # about WORDS at most
        known: dict[str, dict[bytes, int]] = {}
        for r in mine:
            known.setdefault(r.lang, {})[r.word.encode("utf-8", "surrogatepass")] = r.id
        shared, last = spark.sparkContext.broadcast(known), g == groups - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for part in rows(batches, "lang", "text", "now"):
                out = []
                for lang, text, now in part:
                    ids = shared.value.get(lang, {})
                    words = [w for w in words_in(text) if w]
                    found = np.fromiter((ids.get(w, 0) for w in words), np.uint32, len(words))
                    found = np.append(found, np.uint32(0))
                    out.append((found if now is None else found + np.frombuffer(now, np.uint32)).tobytes())
                columns = [pa.array(out, pa.binary())] if last else [pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array(out, pa.binary())]
                yield pa.record_batch(columns, ["now"] if last else ["lang", "text", "now"])

        before, at = at, materialize(at.mapInArrow(run, "now binary" if last else "lang string, text string, now binary"), f"{name}-spelt")
        shared.unpersist()
        del known
        if g:
            release(before)
    return at


def pairs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where two numbers follow each other, and both as one key."""
    at = np.flatnonzero((numbers[:-1] != 0) & (numbers[1:] != 0))
    return at, numbers[at].astype(np.uint64) << np.uint64(32) | numbers[at + 1]


def sieve(spelt: DataFrame, bits: int, least: int, name: str) -> np.ndarray:
    """Packed bits of the buckets that hold `least` pairs or more."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.uint8)
        for b in returning(batches):
            all_ = numbers_of(binary(b.column("now")))
            for i in range(0, len(all_), 1 << 20):
                at, n = np.unique((mix64(pairs(all_[i : i + (1 << 20) + 1])[1]) & mask).astype(np.int64), return_counts=True)
                held[at] = np.minimum(held[at] + n, 255)
        for column in zip(*packed_chunks([held])):
            yield pa.record_batch([pa.array([column[0]], pa.int32()), pa.array([column[1]], pa.int32()), pa.array([column[2]], pa.binary())], ["chunk", "salt", "counts"])

    parts = sum_chunks(spelt.select("now").mapInArrow(run, "chunk int, salt int, counts binary"))
    summed = materialize(sum_chunks(parts.withColumn("salt", F.lit(0))), f"{name}-sieve")
    kept = np.zeros((1 << bits) // 8, np.uint8)
    for r in summed.toLocalIterator():  # a fixed number of chunks
        whole = np.zeros(CHUNK, np.uint64)
        add_sparse(whole, bytes(r.counts))
        packed = np.packbits(whole[: 1 << bits] >= least, bitorder="little")
        kept[r.chunk * CHUNK // 8 : r.chunk * CHUNK // 8 + len(packed)] = packed
    release(summed)
    return kept


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return ((mix64(keys) >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if len(keys) == 1:
        return keys[0], counts[0]
    all_, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_, kind="stable")
    all_ = all_[order]
    at = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
    return all_[at], np.add.reduceat(n[order], at)


def candidates(spelt: DataFrame, kept: np.ndarray | None, bits: int, slices: int, least: int) -> DataFrame:
    """slice, keys (sorted, as bytes), counts, n: the pairs that occur `least` times or more, of those that pass the sieve, if there is one. Tasks
    add up what they hold and hand on sorted arrays, a slice of the keys each; a slice's are added up in one task. One pass, whatever their number."""
    shared = None if kept is None else spelt.sparkSession.sparkContext.broadcast(kept)  # 2^SIEVE_MOST bits at most
    mask, fields = np.uint64((1 << bits) - 1), ["slice", "keys", "counts"]
    none = np.empty(0, np.uint64), np.empty(0, np.int64)

    def dealt(held: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = slice_of(held, slices)
        order = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[order], prepend=-1, append=slices))
        small = n.astype(np.uint32)  # occurrences in one task, of less than 2^32
        out = [(int(at[order[i]]), held[order[i:j]].tobytes(), small[order[i:j]].tobytes()) for i, j in zip(edges, edges[1:])]
        yield pa.record_batch([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = none, []

        def merge_in() -> tuple[np.ndarray, np.ndarray]:
            new = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return added([held[0], new[0]], [held[1], new[1]])

        for b in returning(batches):
            all_ = numbers_of(binary(b.column("now")))
            for i in range(0, len(all_), 1 << 20):
                keys = pairs(all_[i : i + (1 << 20) + 1])[1]
                if shared is not None:
                    at = (mix64(keys) & mask).astype(np.int64)
                    keys = keys[shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
                if len(keys):
                    waiting.append(keys)
                if sum(map(len, waiting)) >= HELD_KEYS:
                    held = merge_in()
                if len(held[0]) > HELD_KEYS:
                    yield from dealt(*held)
                    held = none
        if waiting:
            held = merge_in()
        if len(held[0]):
            yield from dealt(*held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[list[np.ndarray], list[np.ndarray], int]] = {}
        for b in returning(batches):
            for at, keys, counts in zip(b.column("slice").to_pylist(), b.column("keys"), b.column("counts")):
                arrays, ns, size = sums.get(at, ([], [], 0))
                arrays.append(np.frombuffer(keys.as_buffer(), np.uint64).copy())
                ns.append(np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64))
                size += len(arrays[-1])
                if size > 2 * len(arrays[0]) + 10_000:  # merged whenever a slice has doubled
                    one, n = added(arrays, ns)
                    arrays, ns, size = [one], [n], len(one)
                sums[at] = arrays, ns, size
        for at in list(sums):
            keys, n = added(*sums.pop(at)[:2])
            keys, n = keys[n >= least], n[n >= least]
            if len(keys):
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([len(keys)], pa.int64())], [*fields, "n"])

    return spelt.select("now").mapInArrow(run, "slice int, keys binary, counts binary").repartition("slice").mapInArrow(merge, "slice int, keys binary, counts binary, n long")


def hashed(found: DataFrame, group_of: dict[int, int]) -> DataFrame:
    """g, hash, a: the perfect hash of each group of slices, built in a task from about KEYS keys, and their counts by slot."""
    spark = found.sparkSession
    groups = spark.createDataFrame(list(group_of.items()), "s_ int, g int")

    def build(rows_: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k.as_buffer(), np.uint64) for k in rows_.column("keys")])
        made, counts = PerfectHash(keys), np.zeros(len(keys), np.int64)
        counts[made.find(keys)] = np.concatenate([np.frombuffer(c.as_buffer(), np.int64) for c in rows_.column("counts")])
        return pa.table({"g": pa.array(rows_.column("g").to_pylist()[:1], pa.int32()), "hash": pa.array([pickle.dumps(made)], pa.binary()), "a": pa.array([counts.tobytes()], pa.binary())})

    return found.join(groups, F.col("slice") == F.col("s_")).select("g", "keys", "counts").groupBy("g").applyInArrow(build, "g int, hash binary, a binary")


def numbered(hashes: DataFrame) -> DataFrame:
    """id, prefix, suffix, a of every key of the hashes, read by slot."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, hash_, a in zip(b.column("g").to_pylist(), b.column("hash"), b.column("a")):
                keys, counts = pickle.loads(hash_.as_buffer()).keys, np.frombuffer(a.as_buffer(), np.int64)
                for i in range(0, len(keys), 50_000):
                    part = keys[i : i + 50_000]
                    yield pa.record_batch([pa.array((g << ROOM) + 1 + i + np.arange(len(part))), pa.array((part >> np.uint64(32)).astype(np.int64)), pa.array((part & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts[i : i + 50_000])], ["id", "prefix", "suffix", "a"])

    return hashes.mapInArrow(read, "id long, prefix long, suffix long, a long")


def respell(at: DataFrame, shared, first: int, last: bool, name: str) -> DataFrame:
    """`then`: the numbers of the frequent phrases that begin at every place, those of other groups kept; the last group drops `now`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_ = shared.value
        for b in returning(batches):
            now = binary(b.column("now"))
            all_ = numbers_of(now)
            then = numbers_of(binary(b.column("then"))).copy() if "then" in b.schema.names else np.zeros(len(all_), np.uint32)
            for i in range(0, len(all_), 1 << 20):
                place, keys = pairs(all_[i : i + (1 << 20) + 1])
                slots = hash_.find(keys)
                hit = slots >= 0
                then[i + place[hit]] = first + 1 + slots[hit]
            out = column_of(then, now)
            yield pa.record_batch([out] if last else [now, out], ["now"] if last else ["now", "then"])

    return materialize(at.mapInArrow(run, "now binary" if last else "now binary, then binary"), name)


def longer(spelt: DataFrame, level: DataFrame, k: int, total: int, least: int, keys_at_once: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases of k words (as `level` has those of k - 1), and the texts spelt in their numbers."""
    spark = spelt.sparkSession
    bits = min(max(SIEVE_LEAST, (total // 8 + 1).bit_length()), SIEVE_MOST)
    # where most buckets hold enough pairs by chance a sieve only costs its pass
    kept = sieve(spelt, bits, least, name) if total >> bits < max(least // 2, 1) else None
    likely = min(total // least, total if kept is None else int(np.bitwise_count(kept).sum()) * 8)  # phrases that are frequent, at most or about
    slices = max(SLICES, 4 * likely // keys_at_once, total >> 22)
    found = materialize(candidates(spelt, kept, bits, slices, least), f"{name}-candidates")
    group_of, groups, held = {}, 0, 0
    for r in found.select("slice", "n").orderBy("slice").toLocalIterator():  # in proportion to the groups
        if not groups or held + r.n > keys_at_once:
            groups, held = groups + 1, 0
        group_of[r.slice], held = groups - 1, held + r.n
        if r.n >= 1 << ROOM or groups << ROOM >= 1 << 32:
            raise ValueError(f"{slices} slices of phrases don't fit into numbers of 32 bits")
    grams, at = spark.createDataFrame([], "id long, prefix long, suffix long, a long"), spelt
    hashes = materialize(hashed(found, group_of), f"{name}-hashes") if groups else None
    if groups:
        grams = materialize(numbered(hashes), f"{name}-counted")
    for g in range(groups if k < 4 else 0):
        hash_ = pickle.loads(hashes.where(F.col("g") == g).first().hash)  # about 10 bytes for each of KEYS
        shared = spark.sparkContext.broadcast(hash_)
        del hash_
        before, at = at, respell(at, shared, g << ROOM, g == groups - 1, f"{name}-spelt")
        if before is not spelt:
            release(before)
        shared.unpersist()
        give_back()
    release(found, *([hashes] if hashes is not None else []))
    own = lambda side, *c: level.select(F.col("id").alias(side), *c)
    whole = grams.join(own("prefix", "lang", F.col("phrase").alias("head"), "heads"), "prefix").join(own("suffix", F.col("last"), "tails"), "suffix")
    both = whole.select("id", "prefix", "suffix", "a", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", F.array_append("heads", F.col("a")).alias("heads"), F.array_append("tails", F.col("a")).alias("tails"))
    return materialize(both, f"{name}-level"), at


def cut(k: int) -> Column:
    """struct<score, k, l, r> of the cut of least score."""
    at = F.sequence(F.lit(1), F.lit(k - 1))
    parts = F.transform(at, lambda i: F.struct(i.alias("i"), F.element_at("heads", i).alias("l"), F.element_at("tails", F.lit(k) - i).alias("r")))
    return F.array_min(F.transform(parts, lambda x: F.struct(F.call_function("div", F.lit(2000000).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)"), (x["l"].cast("decimal(19,0)") + x["r"].cast("decimal(19,0)"))).alias("score"), x["i"].alias("k"), x["l"].alias("l"), x["r"].alias("r"))))


def collocations(docs: DataFrame, *, least: int = 30, inside: int = 80, most: int = 2000, words_at_once: int = WORDS, keys_at_once: int = KEYS, name: str = "phrases") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `most` best phrases of 2 to 4 words of `docs` (lang, text).

    A null text is empty, a null lang is `und`. Repeated rows count each; empty tables give no rows; other columns are ignored. Equal
    scores are ordered by a, then by phrase, in bytes. A phrase goes if a longer one holds it that occurs `inside` percent as often or more;
    a word more is enough to look at, since what is longer still occurs no more often.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts = materialize(count_words(docs), f"{name}-words")
    usual = counts.where(F.col("c") >= least)
    groups = max(1, -(-usual.count() // words_at_once))
    of_group = F.row_number().over(Window.partitionBy("g").orderBy("lang", "word"))
    vocabulary = materialize(usual.withColumn("g", F.pmod(F.xxhash64("lang", "word"), F.lit(groups)).cast("int")).withColumn("id", (F.col("g").cast("long") * (1 << ROOM)) + of_group), f"{name}-vocabulary")
    if groups << ROOM >= 1 << 32:
        raise ValueError(f"{groups} groups of words don't fit into numbers of 32 bits")
    spelt = spell(docs, vocabulary, groups, name)
    level = vocabulary.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("c").alias("heads"), F.array("c").alias("tails"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first().n
    levels = {}
    for k in (2, 3, 4):
        before = spelt
        level, spelt = longer(spelt, level, k, total, least, keys_at_once, f"{name}-{k}")
        levels[k] = level
        if before is not spelt:
            release(before)
    kept = None
    for k, own in levels.items():
        out = own.withColumn("cut", cut(k)).select("id", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        if k < 4:
            holds = levels[k + 1].select(F.explode(F.array_distinct(F.array("prefix", "suffix"))).alias("h_"), "a").groupBy("h_").agg(F.max("a").alias("m_"))
            out = out.join(holds, F.col("id") == F.col("h_"), "left").where(F.col("m_").isNull() | (100 * F.col("m_") < inside * F.col("a"))).drop("h_", "m_")
        kept = out if kept is None else kept.unionByName(out)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = kept.withColumn("p_", part).withColumn("r_", F.row_number().over(Window.partitionBy("lang", "p_").orderBy(*order))).where(F.col("r_") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    n = counts.groupBy(F.col("lang").alias("l_")).agg(F.sum("c").alias("n"))
    return ranked.join(n, F.col("lang") == F.col("l_")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_mine_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT i, lang, unnest(x) AS piece, unnest(range(len(x))) AS j FROM (SELECT i, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS x FROM d)),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda s: array_to_string(w[s : s + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) ks(k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS x FROM g WHERE k >= 2 AND a >= 30),
cuts AS (SELECT lang, k, phrase, a, x, j, array_to_string(x[1 : j], ' ') AS h, array_to_string(x[j + 1 : k], ' ') AS t FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT c.lang, c.k, c.phrase, c.a, h.a AS l, t.a AS r, CAST((2000000::HUGEINT * c.a) // (h.a + t.a) AS BIGINT) AS score, row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (2000000::HUGEINT * c.a) // (h.a + t.a), j) AS o FROM cuts c JOIN g h ON h.lang = c.lang AND h.k = c.j AND h.phrase = c.h JOIN g t ON t.lang = c.lang AND t.k = c.k - c.j AND t.phrase = c.t),
sub AS (SELECT DISTINCT lang, array_to_string(x[b : b + m - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, k - m + 2)) AS b FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
big AS (SELECT lang, phrase, max(a) AS m FROM sub GROUP BY ALL),
o AS (SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, score FROM s LEFT JOIN big USING (lang, phrase) WHERE s.o = 1 AND (m IS NULL OR 100 * m < 80 * a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""
