"""The language model's mixer learns within documents of ordinary length, bit for bit as a plain model does."""

import math

import numpy as np
import pytest

from kilnwork.llm import lm


def plain_score(mixer, data, ends, texts):
    """One text after the other and one bit after the other, in plain Python numbers."""
    code = mixer.code
    symbols = code.symbol[data]
    ctx = lm.contexts(symbols, int(code.symbol[32]), data >= 128, lm.starts_of(ends))
    out, begin = [], 0
    for end in ends[:texts].tolist():
        depths = max(map(len, code.paths))
        share, proof = [[1.0] * 3 for _ in range(depths)], [[lm.FIRM] * 3 for _ in range(depths)]
        last, proof_last = [0.0] * depths, [lm.FIRM_LAST] * depths
        total, lo = 0.0, 0
        while begin + lo < end:
            size = max(lm.BLOCK, lo // lm.GROWS)
            pull, mass = [[0.0] * 4 for _ in range(depths)], [[0.0] * 4 for _ in range(depths)]
            for at in range(begin + lo, min(begin + lo + size, end)):
                for j, (node, bit) in enumerate(code.paths[symbols[at]]):
                    x = [int(t[int(c[at]) + node]) / lm.SCALE for t, c in zip(mixer.tables, ctx)]
                    z = last[j] + sum(s * v for s, v in zip(share[j], x))
                    z = min(max(round(z * lm.FINE), -lm.LIMIT * lm.FINE), lm.LIMIT * lm.FINE) / lm.FINE
                    p = 1 / (1 + math.exp(-z))
                    total += math.log10(p if bit else 1 - p)
                    for k, v in enumerate([*x, 1.0]):
                        pull[j][k] += (bit - p) * v
                        mass[j][k] += p * (1 - p) * v * v
                total -= 8 * math.log10(2) * (symbols[at] == lm.SYMBOLS - 1)
            for j in range(depths):
                for k in range(3):
                    proof[j][k] += mass[j][k]
                    share[j][k] = min(max(share[j][k] + pull[j][k] / proof[j][k], 0.0), 3.0)
                proof_last[j] += mass[j][3]
                last[j] = min(max(last[j] + pull[j][3] / proof_last[j], -2.0), 2.0)
            lo += size
        out.append(total)
        begin = end
    return out


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 110, rng.integers(2, 7)).astype(np.uint8)).decode() for _ in range(50)]
    draw = lambda n: " ".join(words[i] for i in rng.integers(0, 50, n))
    _, data, ends = lm.read([draw(400) for _ in range(20)])
    code = lm.Code.of(np.bincount(data, minlength=256))
    counts = [np.zeros(lm.SYMBOLS << r, np.uint32) for r in lm.ROWS]
    lm.add_counts(counts, code, data, ends)
    return code, counts, draw


def test_scores_are_those_of_a_plain_model(model):
    code, counts, draw = model
    mixer = lm.Mixer(code, lm.odds(counts, code, np.tile(lm.PRIOR, (lm.SYMBOLS, 1))))
    texts = ["", "a", draw(3), draw(30), draw(150), "Ünïcode ß " * 9, draw(60).upper() + " 12345"]
    _, data, ends = lm.read(texts)
    got, want = mixer.score(data, ends), plain_score(mixer, data, ends, len(texts))
    assert got == pytest.approx(want, rel=2e-3)  # a bit on the edge between two FINE-ths may fall to either side
    alone = [mixer.score(*lm.read([t])[1:])[0] for t in texts]
    assert got.tolist() == pytest.approx(alone, rel=1e-9)


def test_documents_of_ordinary_length_are_mixed_online(model):
    code, counts, draw = model
    mixer = lm.Mixer(code, lm.odds(counts, code, np.tile(lm.PRIOR / 4, (lm.SYMBOLS, 1))))  # far too timid: only learning can help
    for n in (80, 310):
        _, data, ends = lm.read([draw(n)])
        assert len(data) < 4096 and mixer.score(data, ends)[0] > 0.97 * mixer.score(data, ends, learn=False)[0]  # log10 probabilities, below 0


CLASHES = ("rid", "word", "fp", "k", "shard", "features", "score", "group", "list", "query", "chunk", "kf_at", "row_")


def test_clashing_names_odd_texts_and_empty_tables(spark):
    """Every operator and stage that takes documents bears columns of its own names, null and odd texts, and no rows at all."""
    from kilnwork.llm import packing, ranking, simhash

    texts = [None, "", " \n\t", "a", "x" * 50_000, "Ünïcode ß　end 😀 done", "same line\nsame line\n\nsame line", "word " * 3000, "a"]
    rows = [(i if i != 3 else None, t, *["clash"] * len(CLASHES)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))
    none = docs.limit(0)
    for run in (simhash.near_duplicates, lambda d: lm.score_texts(d, "true"), lambda d: ranking.rank_documents(d, spark.createDataFrame([], "doc_id long, quality int"))):
        assert run(docs).count() == len(texts) and run(none).count() == 0
    packed = packing.pack_stage(spark, docs, "").toPandas()
    assert packed.groupby("piece").size()[0] == len(texts) and packing.pack_stage(spark, none, "").count() == 0
    sf = "/root/testdata/sf0.001"
    kept = ranking.classifier_stage(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() <= len(texts) and ranking.classifier_stage(spark, none, sf).count() == 0
    near = simhash.near_dup_stage(spark, docs, "")
    assert near.columns == docs.columns and near.count() == 6  # null, empty and white are one, and so are both "a"


def test_clashing_names_of_vectors(spark):
    from kilnwork.llm import ann

    rows = [(i, [float(i % 7), 1.0, float(-i)], *["clash"] * len(CLASHES)) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, " + ", ".join(f"{c} string" for c in CLASHES))
    got = ann.search(vectors).toPandas()
    assert len(got) == 60 and set(got.query_id) == {0, 20, 40}
    exact = {(r.query_id, r.vec_id): sum(a * b for a, b in zip(rows[r.query_id][1], rows[r.vec_id][1])) for r in got.itertuples()}
    assert all(exact[r.query_id, r.vec_id] == r.score for r in got.itertuples())


def test_weights_are_fitted_on_every_bit_of_every_training_document(spark, model, monkeypatch):
    """What the fit gets is every training document's every bit, looked up in the tables of the half that the document isn't in."""
    draw = model[2]
    texts = [None, "", "Ünïcode ß", "a b", "a b", *(draw(n % 23) for n in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, fit = [], lm.fit_weights
    monkeypatch.setattr(lm, "fit_weights", lambda tally, *a: (seen.append(tally), fit(tally, *a))[1])
    assert lm.score_texts(docs, "doc_id % 7 <> 2").count() == len(texts)
    halves = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "pmod(xxhash64(42, text), 2) h").collect()}
    known = [i for i in range(len(texts)) if i % 7 != 2]
    data = [lm.read([texts[i]])[1] for i in known]
    code = lm.Code.of(np.bincount(np.concatenate(data), minlength=256))
    tables = []
    for h in (0, 1):
        counts = [np.zeros(lm.SYMBOLS << r, np.float32) for r in lm.ROWS]
        for i, d in zip(known, data):
            if halves[i] == h:
                for c, at in zip(counts, lm.contexts(code.symbol[d], int(code.symbol[32]), d >= 128, lm.starts_of(np.array([len(d)])))):
                    for a, s in zip(at, code.symbol[d]):
                        c[a + s] += 1
        tables.append(lm.odds(counts, code))
    want = np.zeros_like(seen[0])
    for i, d in zip(known, data):
        ctx = lm.contexts(code.symbol[d], int(code.symbol[32]), d >= 128, lm.starts_of(np.array([len(d)])))
        for *at, s in zip(*ctx, code.symbol[d]):
            for node, bit in code.paths[s]:
                level = [min(max(math.floor(int(t[a + node]) / 8 + 0.5), -15), 15) + 16 for a, t in zip(at, tables[1 - halves[i]])]
                want[node, bit, (level[0] * 32 + level[1]) * 32 + level[2]] += 1
    assert {0, 1} == set(halves.values()) and want.sum() > 10_000 and (seen[0] == want).all()


def test_equal_symbols_in_equal_contexts_are_looked_up_once(model):
    code, counts, draw = model
    taken = []

    class Counted(np.ndarray):
        def take(self, at, axis=None):
            taken.append(len(at))
            return np.asarray(self).take(at, axis=axis)

    tables = [lm.levels(np.concatenate([x, x[::-1]])) for x in lm.odds(counts, code)]
    once, often = (np.zeros((lm.SYMBOLS, 2, lm.LEVELS**3), np.uint32) for _ in range(2))
    text = draw(300)
    _, data, ends = lm.read([text, text])
    lm.add_tally(once, code, tables, data, ends, np.array([0, 1]))
    _, data, ends = lm.read([text] * 60)
    lm.add_tally(often, code, [t.view(Counted) for t in tables], data, ends, np.arange(60) % 2)
    assert (often == 30 * once).all() and sum(taken) <= 3 * len(data) // 30


def test_weights_of_a_tally_are_those_of_logistic_regression():
    rng = np.random.default_rng(5)
    level = rng.integers(1, lm.LEVELS, (3, 200_000))
    x = (level - lm.LEVELS // 2) / 2
    bit = rng.random(x.shape[1]) < 1 / (1 + np.exp(-np.array([0.7, 0.1, 0.3]) @ x))
    tally = np.zeros((lm.SYMBOLS, 2, lm.LEVELS**3))
    np.add.at(tally, (5, bit.astype(int), (level[0] * lm.LEVELS + level[1]) * lm.LEVELS + level[2]), 1)
    weights = lm.fit_weights(tally)
    assert weights[5] == pytest.approx([0.7, 0.1, 0.3], abs=0.02) and (weights[4] == lm.PRIOR).all()


def test_bits_are_looked_up_for_many_blocks_at_once(model):
    """By depth, in the order of the symbols: what each predictor says of a bit, and where each stretch's bits end."""
    code, counts, draw = model
    mixer = lm.Mixer(code, lm.odds(counts, code))
    _, data, ends = lm.read([draw(40), "é", draw(90)])
    symbols, ctx = lm.located(code, data, ends)
    stops = np.array([7, 7, 50, len(data)])
    bits = mixer.look_up(symbols, ctx, stops)
    for depth, (odds, side, to) in enumerate(bits):
        at = [i for i, s in enumerate(symbols) if len(code.paths[s]) > depth]
        paths = [code.paths[symbols[i]][depth] for i in at]
        assert odds.tolist() == [[int(t[int(c[i]) + node]) for i, (node, _) in zip(at, paths)] for t, c in zip(mixer.tables, ctx)]
        assert (side > 0).tolist() == [bit == 1 for _, bit in paths] and to.tolist() == [sum(i < e for i in at) for e in (0, *stops)]
    assert len(bits) == max(map(len, code.paths))
