"""Operator 2, approximate nearest neighbours by inner product: adaptive dimension scan.

Vectors are dealt into lists by k-means centroids, and each query probes the lists of the largest inner products. Inside
a list vectors are rotated at random and scanned in blocks of columns: after each block a hypothesis test on the partial
distance asks whether the whole one can still meet the query's threshold, and abandons candidates early. Survivors get exact
scores in double precision. The centroids, the number of probes and the first thresholds come from a bounded sample; every
row is indexed. Neighbouring lists form groups, and long groups and many queries are dealt into chunks, so no list meets in
one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .base import bounded_sample, materialize, mix64, table

K, EVERY = 20, 20
#: Vectors in the sample, about; lists, rows of a chunk, queries of a chunk: at most so many.
SAMPLE, LISTS, CHUNK, QUERIES = 20_000, 4096, 16_384, 4096
#: Rows of a group of neighbouring lists, about: a task scans one group (or a chunk of it) for a block of queries.
GROUP = 8192
#: Rows of the sample that every query is compared with first: their k-th best score is its first threshold.
SEEDS = 1024
#: Vectors of larger powers of two are scaled down to this one for the scan, so that no product overflows.
SAFE = 500
#: Columns of a block, and standard deviations that a partial distance is given before its candidate is abandoned.
BLOCK, SIGMAS = 16, 3.0
#: Recall on the sample that the number of probes is chosen for.
AIM = 0.98


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows in double precision, summed in the order of the components, so equal vectors score equally."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += q[:, d].astype(np.float64) * x[:, d].astype(np.float64)
    return out


def scores_of(q: np.ndarray, x: np.ndarray, shift: int) -> np.ndarray:
    """Inner products of rows with rows. Where a double can't hold them on the way they are those of vectors scaled down by 2**shift, scaled
    back: infinite, if they are larger than any double, and never undefined."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = exact(q, x)
        large = ~np.isfinite(s) if shift else np.zeros(len(s), bool)
        if large.any():
            s[large] = np.ldexp(exact(np.ldexp(q[large], -shift), np.ldexp(x[large], -shift)), 2 * shift)
    return s


def mixed(i: int) -> int:
    return int(mix64(np.array([i & (1 << 64) - 1], np.uint64))[0])


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    names = np.unique(x, axis=0)
    c = names[rng.choice(len(names), min(k, len(names)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 2000] @ c.T - half, 1) for i in range(0, len(x), 2000)]) if len(x) else np.empty(0, np.int64)


def choose_probes(x: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> int:
    """The least number of lists whose candidates hold AIM of the k best, over queries of the sample against the sample."""
    at = nearest(x, c)
    q = np.arange(0, len(x), max(1, len(x) // 400))
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    best = np.argpartition(-s, k - 1, 1)[:, :k]
    order = np.argsort(-(x[q] @ c.T), 1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(c))[None].repeat(len(q), 0), 1)
    need = np.take_along_axis(rank, at[best], 1)
    return int(np.quantile(need, AIM)) + 1


class Scan:
    """The k best so far of some queries, over lists of candidates that are scanned one after the other.

    A candidate qualifies if its inner product reaches the query's threshold, that is if its squared distance is at most
    T = |q|^2 + |x|^2 - 2 * threshold. After a random rotation the first c of D columns hold a share of the squared distance
    that is Beta distributed with mean c / D, whatever the two vectors are; a candidate is abandoned when they hold
    more of T than SIGMAS standard deviations above that mean (or than all of T).
    """

    def __init__(self, q: np.ndarray, ids: np.ndarray, floor: np.ndarray, rotation: np.ndarray, k: int, shift: int = 0):
        """`shift`: the scan takes vectors times 2**-shift, whose products no double overflows at; scores are those of the vectors as they are."""
        self.original, self.shift = q, shift
        q = np.ldexp(q, -shift) if shift else q
        self.q, self.ids, self.rotation, self.k = q, ids, rotation, k
        self.floor = self.scaled(floor)
        dim = q.shape[1]
        self.turned = q @ rotation
        self.cuts = [0, *range(BLOCK, dim, BLOCK), dim]
        self.share = [min(1.0, c / dim + SIGMAS * np.sqrt(2 * c * (dim - c) / (dim * dim * (dim + 2)))) for c in self.cuts]
        self.norms, self.whole = self.prefix_norms(self.turned), (q * q).sum(1)
        self.scores, self.found = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

    def scaled(self, score: np.ndarray) -> np.ndarray:
        """The least product of scaled vectors that has this score; of infinite ones all that overflow."""
        if not self.shift:
            return score.copy()
        return np.minimum(np.ldexp(score, -2 * self.shift), np.ldexp(1 - 2.0**-40, 1024 - 2 * self.shift))

    def prefix_norms(self, m: np.ndarray) -> list[np.ndarray]:
        return [(m[:, :c] ** 2).sum(1) for c in self.cuts]

    def least(self, i: int, norms: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """One vector's part of the partial inner product up to cut i that leaves a candidate in the running: the test on
        partial distances, solved for it, is the sum of the query's part, the candidate's and share * threshold."""
        return (norms - (self.share[i] + 1e-9) * whole) / 2

    def list(self, asking: np.ndarray, x: np.ndarray, x_ids: np.ndarray) -> None:
        """Scans one list for the queries (by place) that probe it: whole blocks while many candidates are left, then single ones."""
        original, x = x, np.ldexp(x, -self.shift) if self.shift else x
        turned, x_whole = x @ self.rotation, (x * x).sum(1)
        x_norms = self.prefix_norms(turned)
        of_x = [self.least(i, n, x_whole) for i, n in enumerate(x_norms)]
        of_q = [self.least(i, n, self.whole) for i, n in enumerate(self.norms)]
        for lo in range(0, len(x), 1024):
            rows = slice(lo, lo + 1024)
            inner, alive, i = np.zeros((len(asking), len(x[rows]))), None, 0
            while i + 1 < len(self.cuts) and (alive is None or alive.mean() > 0.05):
                columns = slice(self.cuts[i], self.cuts[i + 1])
                inner += self.turned[asking, columns] @ turned[rows, columns].T
                i += 1
                least = (of_q[i] + self.share[i] * self.floor)[asking]
                now = inner >= np.add.outer(least, of_x[i][rows])
                alive = now if alive is None else alive & now
            a, b = np.nonzero(alive)
            got = inner[a, b]
            a, b = asking[a], b + lo
            for i in range(i + 1, len(self.cuts)):
                columns = slice(self.cuts[i - 1], self.cuts[i])
                got = got + np.einsum("ij,ij->i", self.turned[a, columns], turned[b, columns])
                ok = got >= of_q[i][a] + of_x[i][b] + self.share[i] * self.floor[a]
                a, b, got = a[ok], b[ok], got[ok]
            other = self.ids[a] != x_ids[b]
            a, b = a[other], b[other]
            s = scores_of(self.original[a], original[b], self.shift)
            ok = self.scaled(s) >= self.floor[a]
            self.merge(a[ok], x_ids[b[ok]], s[ok])

    def merge(self, a: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Takes candidates in; a query's k-th best so far is its next threshold."""
        if not len(a):
            return
        who, at = np.unique(a, return_inverse=True)
        k = self.k
        owner = np.concatenate([np.repeat(np.arange(len(who)), k), at])
        score, name = np.concatenate([self.scores[who].ravel(), s]), np.concatenate([self.found[who].ravel(), ids])
        order = np.lexsort((name, -score, owner))
        first = np.searchsorted(owner[order], np.arange(len(who)))[:, None] + np.arange(k)
        self.scores[who], self.found[who] = score[order][first], name[order][first]
        self.floor[who] = np.maximum(self.floor[who], self.scaled(self.scores[who, k - 1]))


def search(vectors: DataFrame, *, every: int = EVERY, k: int = K, seed: int = 42, name: str = "ann") -> DataFrame:
    """query_id, rank, vec_id, score: of rows of `vectors` (vec_id, embedding) whose id `every` divides, the k nearest found.

    Null ids, null or zero vectors, those with null or non-finite components, and those of another length than most
    (of lengths as frequent, the shorter) take no part. Ties go to the smaller vec_id; rows that repeat an id and a vector count once, and never
    as their own id's neighbours. Products larger than any double are infinite, and tie. Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    fine = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    lengths = fine.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, n = lengths[0]["dim"], lengths[0]["count"]
    fine = materialize(fine.where(F.col("dim") == dim).drop("dim").dropDuplicates(["vec_id", "embedding"]), f"{name}-rows")  # repeats would fill the k best
    got = sorted(bounded_sample(fine, "vec_id", SAMPLE, seed).collect(), key=lambda r: (mixed(r.vec_id), r.vec_id))
    top = fine.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0]
    shift = max(0, int(np.frexp(float(top))[1]) - SAFE)
    whole_, ids = np.array([r.embedding for r in got], np.float64), np.array([r.vec_id for r in got], np.int64)
    xs = np.ldexp(whole_, -shift)
    centroids = k_means(xs, min(LISTS, max(1, int(np.sqrt(n)))), seed)
    # where products overflow, infinite ones tie across all lists
    probes = len(centroids) if shift else choose_probes(xs, ids, centroids, k)
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
    groups = nearest(centroids, k_means(centroids, -(-n // GROUP), seed))
    model = spark.sparkContext.broadcast((xs[:SEEDS], ids[:SEEDS], centroids, rotation, whole_[:SEEDS]))  # bounded by SEEDS and LISTS

    kind = np.float32 if vectors.schema["embedding"].dataType.elementType == FloatType() else np.float64  # as they come: scores are exact

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b)
            at = nearest(np.ldexp(x, -shift) if shift else x, model.value[2])
            yield pa.record_batch([pa.array(groups[at], pa.int32()), pa.array(at, pa.int32()), b.column("vec_id"), packed(x)], ["group", "list", "vec_id", "vector"])

    def packed(x: np.ndarray) -> pa.Array:
        return pa.array([v.tobytes() for v in np.ascontiguousarray(x, kind)], pa.binary())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ids, c, _, whole_ = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                original, q_ids = matrix(b).astype(np.float64), b.column("vec_id").to_numpy()
                q = np.ldexp(original, -shift)
                lists = np.argsort(-(q @ c.T), 1, kind="stable")[:, :probes].astype(np.int32)
                s = q @ xs.T
                s[q_ids[:, None] == ids[None]] = -np.inf
                top = np.argsort(-s, 1, kind="stable")[:, :k]
                have = np.isfinite(np.take_along_axis(s, top, 1))
                a = np.repeat(np.arange(len(q)), have.sum(1))
                at_ = top[have]
                scores = np.split(scores_of(original[a], whole_[at_], shift), np.cumsum(have.sum(1))[:-1])
                floor = np.array([x.min() if len(x) == k else -np.inf for x in scores])
                seeds = [pa.array([x.tolist() for x in v], pa.list_(t)) for v, t in ((np.split(ids[at_], np.cumsum(have.sum(1))[:-1]), pa.int64()), (scores, pa.float64()))]
                yield pa.record_batch([b.column("vec_id"), packed(original), pa.array(floor), pa.array(list(lists), pa.list_(pa.int32())), pa.array([np.unique(groups[x]) for x in lists], pa.list_(pa.int32())), *seeds], ["query_id", "query", "floor", "lists", "groups", "seed_ids", "seed_scores"])

    rows = materialize(fine.mapInArrow(assign, "group int, list int, vec_id long, vector binary"), f"{name}-lists")
    queries = materialize(fine.where(F.col("vec_id") % every == 0).mapInArrow(probe, "query_id long, query binary, floor double, lists array<int>, groups array<int>, seed_ids array<long>, seed_scores array<double>"), f"{name}-queries")
    asked = queries.select("query_id", "query", "floor", "lists", F.explode("groups").alias("group"))
    seeds = queries.select("query_id", F.explode(F.arrays_zip("seed_ids", "seed_scores")).alias("s")).select("query_id", F.col("s.seed_ids").alias("vec_id"), F.col("s.seed_scores").alias("score"))
    parts = rows.groupBy("group").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).join(asked.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")), "group")
    parts = materialize(parts, f"{name}-parts")  # one row per group, at most LISTS
    part = lambda key, n: F.pmod(F.xxhash64(F.lit(seed), key), F.col(n)).cast("int")
    left = rows.join(F.broadcast(parts), "group").select("group", part("vec_id", "chunks").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "vec_id", "vector")
    right = asked.join(F.broadcast(parts), "group").select("group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), part("query_id", "blocks").alias("block"), "query_id", "query", "floor", "lists")

    def pairs(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        read = lambda column: np.frombuffer(b"".join(column), kind).reshape(-1, dim).astype(np.float64)
        q_ids = q["query_id"].to_numpy(np.int64)
        work = Scan(read(q["query"]), q_ids, q["floor"].to_numpy(np.float64), model.value[3], k, shift)
        x = x.sort_values(["list", "vec_id"], kind="stable")
        vectors, x_ids, names = read(x["vector"]), x["vec_id"].to_numpy(np.int64), x["list"].to_numpy()
        probing = np.zeros((len(q), len(model.value[2])), bool)
        probing[np.repeat(np.arange(len(q)), [len(v) for v in q["lists"]]), np.concatenate(q["lists"].to_list())] = True
        for name_ in np.unique(names):
            lo, hi = np.searchsorted(names, [name_, name_ + 1])
            work.list(np.flatnonzero(probing[:, name_]), vectors[lo:hi], x_ids[lo:hi])
        a, b = np.nonzero(work.found != np.iinfo(np.int64).max)
        return pd.DataFrame({"query_id": q_ids[a], "vec_id": work.found[a, b], "score": work.scores[a, b]})

    key = ("group", "chunk", "block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(pairs, "query_id long, vec_id long, score double")
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.unionByName(seeds).withColumn("rank", rank).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
