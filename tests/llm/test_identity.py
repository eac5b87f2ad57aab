"""Words that a public hash takes for one another, ids that repeat, products that overflow."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kilnwork.llm import ann, pii, recompression, stats
from kilnwork.llm.base import Hashes, bounded_sample

P1, P2 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F


@pytest.fixture(scope="module")
def twins():
    """Two different words of 64 letters with one XXH64 under seed 0: what the first stripe changes in a lane the second one undoes."""
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)
    base = rng.choice(letters, 64).astype(np.uint8)
    first = lambda x: (lambda v: (v << np.uint64(31) | v >> np.uint64(33)) * np.uint64(P1))(np.uint64((P1 + P2) % (1 << 64)) + x * np.uint64(P2))
    one, two = base[:8].view(np.uint64), base[32:40].view(np.uint64)
    with np.errstate(over="ignore"):
        while True:
            other = rng.choice(letters, (1_000_000, 8)).astype(np.uint8).view(np.uint64).ravel()
            undo = two + (first(one) - first(other)) * np.uint64(pow(P2, -1, 1 << 64))
            good = np.flatnonzero(np.isin(undo.view(np.uint8).reshape(-1, 8), letters).all(1))
            if len(good):
                break
    word = base.copy()
    word[:8], word[32:40] = other[good[:1]].view(np.uint8), undo[good[:1]].view(np.uint8)
    a, b = base.tobytes().decode(), word.tobytes().decode()
    assert a != b and xxhash.xxh64_intdigest(a) == xxhash.xxh64_intdigest(b)
    return a, b


def test_substring_dedup_tells_twins_apart(spark, twins):
    a, b = ([f"w{i}" for i in range(30)] + [t] + [f"v{i}" for i in range(30)] for t in twins)
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in recompression.dedup(docs).collect()} == {1: 0, 2: 0, 3: 61}


def test_repeated_windows_tell_twins_apart(twins):
    words = [f"w{i}" for i in range(7)]
    one, two = (" ".join([*words, t]) for t in twins)
    assert stats.describe(f"{one} x {two}", Hashes())[0][4] == 0
    assert stats.describe(f"{one} x {one} y {two}", Hashes())[0][4] == 16


def test_a_sample_of_ids_that_repeat_stays_small(spark):
    docs = spark.range(21_000).select(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(7, 1), (20_100, 0), (20_200, 1)], "doc_id long, quality int")
    x, y = stats.labelled_sample(stats.statistics(docs), labels, "true", 10)
    assert len(x) == 3 and sorted(y) == [0, 1, 1]
    drawn = bounded_sample(docs, "doc_id", 500)
    assert 0 < drawn.count() <= 1000 and drawn.groupBy("doc_id").count().where("count > 1").count() == 0
    assert bounded_sample(docs.where("doc_id = 7"), "doc_id", 50_000).collect()[0].text == "text 0"
    assert "SinglePartition" not in drawn._jdf.queryExecution().executedPlan().toString()


def test_long_texts_are_no_single_task(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("words "), 20_000), F.lit("mail a@b.example")).alias("text"))
    found = pii.corpus_examples(docs, 40)
    assert found.count() > 0
    drawn = bounded_sample(docs, "doc_id", 40)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan and drawn.count() <= 80


def nearest(rows, every, k):
    out = {}
    for i, q in rows:
        if i % every == 0:
            with np.errstate(over="ignore"):
                s = [(-float(np.float64(q[0]) * x[0] + np.float64(q[1]) * x[1]), j) for j, x in rows if j != i]
            out[i] = [(j, -v) for v, j in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("of", [lambda k: [1e200 * k, 1.0], lambda k: [1e200 * (k - 30), 1e-200], lambda k: [1e300 if k % 7 == 0 else 1e-5 * (k + 1), 2.0], lambda k: [1e150 * k, -1.0]])
def test_products_that_no_double_holds(spark, of):
    rows = [(k, of(k)) for k in range(60)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = nearest(rows, 20, 20)
    assert {q: [(j, s) for _, j, s in sorted(v)] for q, v in got.items()} == want


def test_recall_on_clusters_of_varied_norms(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32)) * rng.uniform(0.2, 3, 40)[:, None]
    x = (centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 32))).astype(np.float32)
    found = {}
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        s = x.astype(np.float64) @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hits / (20 * 300) >= 0.95
