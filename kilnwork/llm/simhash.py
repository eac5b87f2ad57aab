"""Operator 5, SimHash near-duplicates found with vantage-point trees.

Fingerprints are partitioned by their Hamming distance from vantage points. A node's distance is taken on a few bits that no
node above it has used, so the triangle bounds along a path add up: a search may deviate from its own rings by `radius`
bits in all, and every branch beyond that is pruned. A tree over a bounded sample gives the shards; each fingerprint lives in
its home shard and visits the shards whose rings its ball overlaps; inside a shard the same tree goes on. The pairs found
are exact. Only distinct fingerprints are searched, and shards give spanning links, not all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import KeyFilter, materialize, mix64, release, rows, table, words_of
from .components import components, local_labels

SEED = 42
RADIUS = 2
#: Bits that a node of the tree looks at, and fingerprints that a leaf may hold before it is split.
NODE_BITS, LEAF = 4, 16
#: The tree of shards is built over one fingerprint in 256, at least and at most so many.
SAMPLE_LEAST, SAMPLE_MOST = 1 << 15, 1 << 20

_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def majority(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per group of hashes (groups end at `ends`, one after the other) the number whose bits are set in over half of the group; 0 for an empty group."""
    out = np.zeros(len(ends), np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    full = np.flatnonzero(ends > starts)
    if not len(full):
        return out
    n = (ends - starts)[full]
    cuts = -(-n // 255)  # bytes count to 255
    owner = np.repeat(np.arange(len(full)), cuts)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    at = starts[full][owner] + 255 * nth
    lanes = h.view(np.uint8).reshape(-1, 8)
    first = np.cumsum(cuts) - cuts
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[lanes[:, k]], at).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(sums.astype(np.int64), first, axis=0)
        out[full] |= ((counts * 2 > n[:, None]) << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(1).astype(np.uint64)
    return out


def shingle_hashes(text: str | None, width: int, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of the text with A-Z lower-cased; a text of fewer words has one shingle, all its words; none without words."""
    w = words_of(text)
    w = [x.lower() for x in w]
    if not w:
        return []
    if len(w) < width:
        return [xxhash.xxh64_intdigest(b" ".join(w), seed)]
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(s), seed) for s in zip(*(w[i:] for i in range(width)))]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches, "doc_id", "text"):
            hashes, ends = [], []
            total = 0
            for _, text in part:
                h = np.array(shingle_hashes(text, width), np.uint64)
                hashes.append(h)
                total += len(h)
                ends.append(total)
            fp = majority(np.concatenate(hashes), np.array(ends))
            yield pa.record_batch([pa.array([r[0] for r in part], pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def node_of(points: np.ndarray, used: int) -> tuple[int, int] | None:
    """A vantage point and the unused bits on which the points are most evenly split; None if no unused bit tells them apart."""
    bits = np.unpackbits(np.ascontiguousarray(points[:: -(-len(points) // 4096)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").mean(0)
    spread = np.minimum(bits, 1 - bits)
    spread[[i for i in range(64) if used >> i & 1]] = -1
    best = np.argsort(-spread, kind="stable")[:NODE_BITS]
    best = best[spread[best] > 0]
    return (int(points[0]), int(sum(1 << int(i) for i in best))) if len(best) else None


def rings(points: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int8)


def build(points: np.ndarray, leaves: list[int], used: int = 0):
    """The tree over a sample: (vantage, mask, children by ring) or a leaf's number; `leaves` gets the bits that each leaf's path has used."""
    node = node_of(points, used) if len(points) > LEAF else None
    if node is None:
        leaves.append(used)
        return len(leaves) - 1
    vantage, mask = node
    d = rings(points, vantage, mask)
    return vantage, mask, [build(points[d == r], leaves, used | mask) for r in range(mask.bit_count() + 1)]


def route(tree, points: np.ndarray, at: np.ndarray, budget: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Leaves with the points (by index) that visit them and the bits each may still deviate by."""
    if not len(at):
        return
    if isinstance(tree, int):
        yield tree, at, budget
        return
    vantage, mask, children = tree
    d = rings(points[at], vantage, mask)
    for ring, child in enumerate(children):
        left = budget - np.abs(d - np.int8(ring))
        yield from route(child, points, at[left >= 0], left[left >= 0])


def search(home: np.ndarray, query: np.ndarray, budget: np.ndarray, used: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, home) of differing fingerprints within `radius` bits, the query being the larger number."""
    if not len(home) or not len(query):
        return
    node = node_of(home, used) if len(home) > 8 * LEAF else None
    if node is None:
        step = max(1, (1 << 20) // len(home))
        for i in range(0, len(query), step):
            q = query[i : i + step]
            near = (np.bitwise_count(q[:, None] ^ home[None, :]) <= radius) & (q[:, None] > home[None, :])
            a, b = np.nonzero(near)
            yield q[a], home[b]
        return
    dh, dq = rings(home, *node), rings(query, *node)
    for ring in np.unique(dh):
        left = budget - np.abs(dq - ring)
        ok = left >= 0
        yield from search(home[dh == ring], query[ok], left[ok], used | node[1], radius)


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same numbers as `pairs` do, one per number at most."""
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    held, size = [], 0

    def reduce_() -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.concatenate([p[i] for p in [(a, b), *held]]) for i in (0, 1))
        if not len(x):
            return x, y
        names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        lab = local_labels(len(names), at[: len(x)], at[len(x) :])
        own = np.flatnonzero(lab != np.arange(len(names)))
        return names[own], names[lab[own]]

    for p in pairs:
        held.append(p)
        size += len(p[0])
        if size > 1 << 20:
            a, b = reduce_()
            held, size = [], 0
    return reduce_()


def links_within(points: DataFrame, radius: int = RADIUS, name: str = "vp") -> DataFrame:
    """(a, b): links between distinct fingerprints `points` (fp) that connect exactly what links of at most `radius` differing bits connect."""
    n = points.count()
    size = min(max(SAMPLE_LEAST, n // 256), SAMPLE_MOST)
    every = max(1, -(-n // size))
    sample = np.array([r.fp for r in points.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").collect()], np.int64).view(np.uint64)
    leaves: list[int] = []
    tree = build(np.sort(sample), leaves)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            out = []
            for leaf, at, left in route(tree, fp, np.arange(len(fp)), np.full(len(fp), radius, np.int8)):
                out += [(leaf, fp[at[i : i + 4096]].tobytes(), left[i : i + 4096].tobytes()) for i in range(0, len(at), 4096)]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))] if out else [pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary())], ["leaf", "fps", "budgets"])

    def pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        query = np.frombuffer(b"".join(pdf["fps"]), np.uint64)
        budget = np.frombuffer(b"".join(pdf["budgets"]), np.int8)
        a, b = spanning(search(query[budget == radius], query, budget, leaves[key[0]], radius))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    visits = points.select("fp").mapInArrow(deal, "leaf int, fps binary, budgets binary")
    return visits.groupBy("leaf").applyInPandas(pair, "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 3, radius: int = RADIUS, name: str = "simhash") -> DataFrame:
    """doc_id, fp, component_id of every row of `docs` (doc_id, text).

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest doc_id of all rows that links
    reach (null if none of them has an id). Null, empty and white texts have fingerprint 0, which links like any other.
    Repeated rows keep their rows. Empty tables give no rows; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, width), f"{name}-fp")
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), f"{name}-groups")
    roots = components(materialize(links_within(groups, radius, name), f"{name}-found"), name)
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = materialize(rooted.join(least, "root").select("fp", "component_id"), f"{name}-of")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near-duplicates at a similarity of shingle sets --------------------------------------------------------------

#: Samples of a document's shingles whose fingerprints must meet, and the similarity that links.
SAMPLES, SIMILARITY, SHINGLE = 24, 0.8, 5
#: By size of the shingle set: sets below the first number take samples of the second number of shingles.
TAKE = ((8, 2), (64, 4), (512, 6))
#: Texts and shingles of a block: larger groups of candidates are cut into so many.
BLOCK, BLOCK_SHINGLES = 512, 4 << 20
#: Pairs that are compared without a further vantage point.
LEAF_PAIRS = 4096


def samples_of(h: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(number, shingles) of a set's samples: for each of SAMPLES seeds the few shingles of least seeded hash; of a large set the
    few of least hash in each of SAMPLES classes of hashes. Two sets of similarity 0.8 share all six with a chance of about
    0.8**6, so some of 24 samples meet in 999 of 1000 cases. How many are taken depends on the size; a set that a larger
    similar one could outgrow that way takes the samples of both sizes. An empty set has one empty sample."""
    if not len(h):
        return [(0, h)]
    out = []
    for level in sorted({sum(n >= most for most, _ in TAKE) for n in (len(h), int(len(h) / SIMILARITY))}):
        first = 1 + level * SAMPLES
        if level == len(TAKE):
            v = mix64(h ^ np.uint64(0x5851F42D4C957F2D))
            v = np.sort((v % np.uint64(SAMPLES)) << np.uint64(59) | v >> np.uint64(5))
            at = np.searchsorted(v, np.arange(SAMPLES + 1, dtype=np.uint64) << np.uint64(59))
            out += [(first + i, mix64(v[a : min(b, a + TAKE[-1][1])])) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if a < b]
            continue
        take = TAKE[level][1]
        if len(h) <= take:
            out.append((first, mix64(h)))
            continue
        scrambled = mix64(h[None, :] ^ mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64))[:, None])
        out += [(first + i, row) for i, row in enumerate(np.partition(scrambled, take - 1, 1)[:, :take].copy())]
    return out


def sketches(keyed: DataFrame, width: int) -> DataFrame:
    """doc_id, k, size of the shingle set, fp (the SimHash of the whole text), nths and fps (numbers and SimHashes of the samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches, "doc_id", "k", "text", limit_bytes=1 << 20):
            hashes = [np.array(shingle_hashes(t, width), np.uint64) for _, _, t in part]
            whole = majority(np.concatenate(hashes), np.cumsum([len(h) for h in hashes]))
            sets = [np.unique(h) for h in hashes]
            drawn = [samples_of(s) for s in sets]
            flat = [x for d in drawn for _, x in d]
            fps = majority(np.concatenate(flat), np.cumsum([len(x) for x in flat])).view(np.int64)
            offsets = pa.array(np.cumsum([0, *map(len, drawn)]), pa.int32())
            nths = pa.ListArray.from_arrays(offsets, pa.array([n for d in drawn for n, _ in d], pa.int32()))
            yield pa.record_batch(
                [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part]), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole.view(np.int64)), nths, pa.ListArray.from_arrays(offsets, pa.array(fps))],
                ["doc_id", "k", "size", "fp", "nths", "fps"],
            )

    return keyed.select("doc_id", "k", "text").mapInArrow(run, "doc_id long, k string, size long, fp long, nths array<int>, fps array<long>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """k, doc_id and the sorted set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches, "k", "doc_id", "text"):
            sets = [np.unique(np.array(shingle_hashes(t, width), np.uint64)).tobytes() for _, _, t in part]
            yield pa.record_batch([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int64()), pa.array(sets, pa.binary())], ["k", "id_", "shingles"])

    return texts.select("k", "doc_id", "text").mapInArrow(run, "k string, id_ long, shingles binary")


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many numbers each sorted set of x has in common with each of y."""
    names = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, len(names), 8192):
        part, both = names[lo : lo + 8192], []
        for sets in (x, y):
            dense = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                at = np.searchsorted(part, s)
                dense[i, at[part[at] == s]] = 1
            both.append(dense)
        out += both[0] @ both[1].T
    return out


def enough(shared: np.ndarray, one: np.ndarray, two: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes that share so much are similar; two empty sets are."""
    return shared >= similarity * (one + two - shared)


def distances(sets: list[np.ndarray], at: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    """Hamming distance from the vantage point's set to each of the sets: the shingles that just one of the two has."""
    n = np.array([len(sets[i]) for i in at])
    if not len(vantage) or not n.sum():
        return n + len(vantage)
    flat = np.concatenate([sets[i] for i in at])
    hit = vantage[np.minimum(np.searchsorted(vantage, flat), len(vantage) - 1)] == flat
    return n + len(vantage) - 2 * np.bincount(np.repeat(np.arange(len(at)), n), hit, len(at)).astype(np.int64)


def alike(sets: list[np.ndarray], q: np.ndarray, x: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a set in q and one in x (by index) that are similar, by a vantage-point tree over x.

    Sets of similarity s differ in at most (1 - s) / (1 + s) * (sum of their sizes) shingles. By the triangle inequality two sets
    whose distances from a vantage point differ by more can't be similar, so a query goes only to the halves of x that
    its ball reaches."""
    size = lambda at: np.array([len(sets[i]) for i in at])
    nq, nx = size(q), size(x)
    if len(q) * len(x) <= LEAF_PAIRS or len(x) < 8:
        step = max(1, LEAF_PAIRS // len(x))
        for i in range(0, len(q), step):
            a, b = np.nonzero(enough(shared_counts([sets[j] for j in q[i : i + step]], [sets[j] for j in x]), nq[i : i + step, None], nx[None, :], similarity))
            yield q[i : i + step][a], x[b]
        return
    vantage = sets[x[len(x) // 2]]
    dq, dx = distances(sets, q, vantage), distances(sets, x, vantage)
    reach = (1 - similarity) / (1 + similarity) * (nq.max() + nx.max()) + 1e-6
    inner = dx <= np.median(dx)
    if inner.all():
        inner = np.arange(len(x)) < len(x) // 2
    for half in (inner, ~inner):
        asked = q[(dq >= dx[half].min() - reach) & (dq <= dx[half].max() + reach)]
        if len(asked):
            yield from alike(sets, asked, x[half], similarity)


def links_between(k: np.ndarray, sets: list[np.ndarray], q: np.ndarray, x: np.ndarray, similarity: float) -> pd.DataFrame:
    """a, b: links that join what all similar pairs of q and x join."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in alike(sets, q, x, similarity) if len(q) and len(x) else ():
        a.append(i)
        b.append(j)
    lab = local_labels(len(k), np.concatenate(a), np.concatenate(b))
    own = np.flatnonzero(lab != np.arange(len(k)))
    return pd.DataFrame({"a": k[own], "b": k[lab[own]]}, dtype=object)


def read_sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column]


def links_of_groups(members: DataFrame, similarity: float) -> DataFrame:
    """Links within groups of members (comp, k, shingles) that fit a block."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        every = np.arange(len(pdf))
        return links_between(pdf["k"].to_numpy(), read_sets(pdf["shingles"]), every, every, similarity)

    return members.select("comp", "k", "shingles").groupBy("comp").applyInPandas(run, "a string, b string")


def links_to_centres(members: DataFrame, centres: DataFrame, similarity: float) -> DataFrame:
    """Links between members (comp, k, shingles) and the centre of their group (comp, centre, middle: its shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("shingles"), b.column("middle")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(bool(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity)))
            yield pa.record_batch([b.column(n).filter(pa.array(keep, pa.bool_())) for n in ("centre", "k")], ["a", "b"])

    return members.join(centres, "comp").select("k", "shingles", "centre", "middle").mapInArrow(run, "a string, b string")


def links_of_blocks(rows_: DataFrame, similarity: float) -> DataFrame:
    """Links between the rows (comp, u, a, asks, k, shingles) that ask and the others, block by block."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        return links_between(pdf["k"].to_numpy(), read_sets(pdf["shingles"]), np.flatnonzero(asks), np.flatnonzero(~asks), similarity)

    return rows_.groupBy("comp", "u", "a").applyInPandas(run, "a string, b string")


def candidate_groups(texts: DataFrame, name: str) -> DataFrame:
    """c (a text's hash), comp and score of every text that some other may resemble: groups are texts whose whole fingerprints the
    vantage-point tree links within RADIUS bits, and texts of which a sample's fingerprints meet; comp joins overlapping groups,
    score counts the texts it meets. Hashes only spread texts over groups: those that fall together are compared, not merged."""
    whole = materialize(texts.select("fp").distinct(), f"{name}-whole")
    found = materialize(links_within(whole, RADIUS, name), f"{name}-found")
    near = components(found, f"{name}-fp").select(F.col("node").alias("fp"), "root")
    of_whole = texts.select("c", "fp").join(near, "fp").select(F.xxhash64(F.lit(-1), "root").alias("g"), "c")
    of_samples = texts.select("c", F.explode(F.arrays_zip("nths", "fps")).alias("s")).select(F.xxhash64("s.nths", "s.fps").alias("g"), "c")
    same_whole = texts.select(F.xxhash64(F.lit(-2), "fp").alias("g"), "c")
    marks = of_samples.unionByName(of_whole).unionByName(same_whole)
    groups = materialize(marks.groupBy("g").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("n")).where("a < b").select("g", "a", "n"), f"{name}-groups")
    met = materialize(marks.join(groups, "g").select("a", F.col("c").alias("b"), "n"), f"{name}-met")
    comps = components(met.select("a", "b"), f"{name}-comps").toDF("c", "comp")
    out = materialize(comps.join(met.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("score")), "c"), f"{name}-candidates")
    release(whole, found, groups, met)
    return out


def keepers(docs: DataFrame, *, width: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, name: str = "near") -> DataFrame:
    """k (md5 of a text), keep_k and keep_id of every text of which more than one row or more than one near-duplicate is there: the text that stays for
    its class, and the smallest doc_id of the class.

    Texts whose sets of `width`-word shingles have a Jaccard similarity of `similarity` or more are linked. Within a group of
    candidates a vantage-point tree over the whole sets finds every similar pair. Groups too large for a block are compared with
    their centre first; texts that this leaves unlinked then meet all texts of the group, in blocks.
    """
    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("k"), "text")
    sketch = materialize(sketches(keyed, width), f"{name}-sketch")
    one = sketch.groupBy("k").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("nths").alias("nths"), F.first("fps").alias("fps"))
    texts = materialize(one.withColumn("c", F.xxhash64("k")), f"{name}-uniq")
    release(sketch)
    light = texts.select("k", "rep", "copies", "size", "c")
    members = materialize(light.join(candidate_groups(texts, name), "c"), f"{name}-members")
    # of each member the row with its least id gives the shingles: copies, however many, don't meet
    wanted = KeyFilter(members.select("k", "rep"))
    sets = shingle_sets(wanted.may_hold(keyed, "k", "doc_id"), width).dropDuplicates(["k", "id_"])
    # written before it is joined, so that a group with many texts can be split
    of_groups = materialize(members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1"), f"{name}-sizes")
    blocks = lambda n, total: F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(total) / block_shingles)).cast("int")
    placed = members.join(of_groups, "comp").select("comp", "k", "rep", "score", blocks("n", "total").alias("na"))
    filled = materialize(placed.join(sets.withColumnRenamed("k", "k_"), (F.col("k") == F.col("k_")) & F.col("rep").eqNullSafe(F.col("id_"))).drop("k_", "id_", "rep"), f"{name}-filled")
    links = materialize(links_of_groups(filled.where("na = 1"), similarity), f"{name}-small")
    large = filled.where("na > 1")
    first = large.groupBy("comp").agg(F.min(F.struct(-F.col("score"), F.col("k").alias("k"))).alias("m")).select(F.col("comp").alias("comp_"), F.col("m.k").alias("centre"))
    centres = materialize(large.join(first, (F.col("comp") == F.col("comp_")) & (F.col("k") == F.col("centre"))).select("comp", "centre", F.col("shingles").alias("middle")), f"{name}-centres")
    central = materialize(links_to_centres(large, centres, similarity), f"{name}-central")  # the centre is similar to itself
    left = materialize(large.join(central.select(F.col("b").alias("k")), "k", "left_anti").select("comp", "k", "na", "shingles"), f"{name}-left")
    asking = left.groupBy("comp").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles") / 8).alias("total")).select("comp", blocks("n", "total").alias("nu"))
    asking = materialize(asking, f"{name}-asking")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    ask = left.join(asking, "comp").select("comp", part("nu").alias("u"), spread("na").alias("a"), F.lit(True).alias("asks"), "k", "shingles")
    answer = large.join(asking, "comp").select("comp", spread("nu").alias("u"), part("na").alias("a"), F.lit(False).alias("asks"), "k", "shingles")
    crossed = materialize(links_of_blocks(ask.unionByName(answer), similarity), f"{name}-crossed")
    roots = components(links.unionByName(central).unionByName(crossed), name).toDF("k", "root")
    rooted = light.join(roots, "k", "left").where("copies > 1 or root is not null").select("k", "rep", F.coalesce("root", "k").alias("root"))
    rooted = materialize(rooted, f"{name}-rooted")
    least = materialize(rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "k")).alias("m")), f"{name}-least")
    out = materialize(rooted.join(least, "root").select("k", F.col("m.k").alias("keep_k"), F.col("m.rep").alias("keep_id")), f"{name}-keep")
    release(texts, members, of_groups, filled, links, centres, central, left, asking, crossed, rooted, least)
    return out


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates, all columns: that of the smallest doc_id, and of rows that repeat it with
    one text, one. Null, empty and white texts are alike; rows without an id stay only where their class has none; an empty
    table stays empty. Rows that resemble nothing stay where they are; only one row of each class is shuffled."""
    keep = keepers(docs, name="near-stage")
    touched, staying = KeyFilter(keep.select("k")), KeyFilter(keep.where("k = keep_k").select("k", "keep_id"))
    row = docs.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("k_"), F.col("doc_id").alias("id_"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"))
    marked = touched.mark(row, "touched_", "k_")
    alone = marked.where(~F.col("touched_")).select("row_")
    maybe = marked.where("touched_").drop("touched_")
    known = keep.select("k", "keep_k", "keep_id")
    # among rows that the first filter lets through by chance are some that the table doesn't know; they stay as well
    unknown = materialize(maybe.select("k_").distinct().join(known.select("k"), F.col("k_") == F.col("k"), "left_anti").toDF("k"), "near-stage-unknown")
    chance = KeyFilter(unknown).may_hold(maybe, "k_").join(unknown, F.col("k_") == F.col("k"), "left_semi").select("row_")
    one = staying.may_hold(maybe, "k_", "id_").join(known.where("k = keep_k"), (F.col("k_") == F.col("k")) & F.col("id_").eqNullSafe(F.col("keep_id")))
    return alone.unionByName(chance).unionByName(one.dropDuplicates(["k_"]).select("row_")).select("row_.*")
