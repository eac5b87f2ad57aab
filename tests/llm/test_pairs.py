"""Substring dedup, nearest neighbours, SimHash and the near-duplicate stage against brute force on small tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from kilnwork.llm import ann, recompression, simhash
from kilnwork.llm.components import components


def make_docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, other = words(70), words(51)
    out = [words(40) + passage + words(30), words(20) + passage, passage[:49] + words(60), passage[5:60], ["same"] * 300, ["x"] + ["same"] * 120 + ["y"], other + words(3) + other, other, words(49), [], words(3000), ["a", "b"] * 60, ["b", "a"] * 60]
    out += [list(out[0]), list(out[7]), list(out[8])]
    near = words(400)
    for i in range(6):
        copy = list(near)
        copy[50 * i] = "changed"
        out.append(copy)
    return [" ".join(w) for w in out] + [None, "", "  \n\t ", "one", "Ünïcode ß　x"]


def brute_dedup(rows, width=50):
    words = [(i, d, t.encode().split() if t else []) for i, (d, t) in enumerate(rows)]
    first = {}
    for _, d, w in words:
        if d is not None:
            for p in range(len(w) - width + 1):
                k = tuple(w[p : p + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for _, d, w in words:
        gone = set()
        for p in range(len(w) - width + 1) if d is not None else ():
            if first[tuple(w[p : p + width])] < d:
                gone.update(range(p, p + width))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_dedup(spark, texts):
    rows = [*enumerate(texts), (3, texts[0]), (3, texts[0]), (None, texts[0]), (1, "again"), (100, texts[10])]
    got = recompression.dedup(make_docs(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute_dedup(rows)


def test_dedup_text_and_empty(spark, texts):
    got = {r.doc_id: r.kept_text for r in recompression.dedup(make_docs(spark, list(enumerate(texts))), keep_text=True).collect()}
    assert got[13] == "" and got[0] is None and got[7] == ""
    assert recompression.dedup(make_docs(spark, [])).count() == 0
    clash = make_docs(spark, [(1, "a b", 7, "x")], ", sig int, sha string")
    assert recompression.dedup(clash).first().n_words == 2


@pytest.mark.parametrize("stride", [16, 64])
def test_texts_on_which_polynomial_hashes_meet_are_told_apart(spark, stride):
    """At every stride-th place one of two words by the parity of the place's set bits, the other one in the second text."""
    def text(turned):
        return " ".join(("alpha", "beta")[(i.bit_count() + turned) % 2] if i % stride == 0 else f"u{i}" for i in range(8192))

    rows = [(1, text(0)), (2, text(1))]
    got = recompression.dedup(make_docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_dedup(rows)
    if stride == 64:
        assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 8064}


def test_window_names_tell_thue_morse_words_apart():
    thue = np.array([i.bit_count() % 2 for i in range(4096)], np.uint64) + np.uint64(11)
    names = recompression.window_names(thue, 50, 5)
    plain = {}
    for i in range(len(names)):
        plain.setdefault(tuple(thue[i : i + 50].tolist()), set()).add(int(names[i]))
    assert all(len(v) == 1 for v in plain.values()) and len({next(iter(v)) for v in plain.values()}) == len(plain) == len(set(names.tolist()))


def test_levels_name_equal_substrings_alike():
    rng = np.random.default_rng(1)
    shared = rng.integers(1, 1 << 60, 200).astype(np.uint64)
    bar = lambda n: np.array([True] + [False] * n + [True])
    seen = []
    for pad in (0, 5, 37):
        h = np.concatenate([[0], rng.integers(1, 1 << 60, pad).astype(np.uint64), shared, [0]]).astype(np.uint64)
        prefix = recompression.Prefix(h, recompression.FACTORS[0])
        starts = np.arange(1 + pad, 1 + pad + 151)
        seen.append(recompression.anchors(h, bar(pad + 200), starts, prefix))
    assert (seen[0] == seen[1]).all() and (seen[0] == seen[2]).all() and len(set(seen[0].tolist())) < 60


def brute_simhash(text, width=3):
    w = text.encode().lower().split() if text else []
    s = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def classes(n, linked):
    lab = list(range(n))
    find = lambda i: i if lab[i] == i else find(lab[i])
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                lab[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, texts):
    rows = [*enumerate(texts), (2, texts[0]), (None, texts[0])]
    got = simhash.near_duplicates(make_docs(spark, rows).repartition(3)).collect()
    fp = [brute_simhash(t) for _, t in rows]
    root = classes(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == sorted(((rows[i][0], fp[i], least[root[i]]) for i in range(len(rows))), key=str)
    assert simhash.near_duplicates(make_docs(spark, [])).count() == 0


def test_vantage_point_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 60, 4)).astype(np.uint64)
    points = np.unique(np.concatenate([centres, np.bitwise_xor.reduce(flips, 2).ravel() ^ np.repeat(centres, 60), rng.integers(0, 1 << 63, 3000).astype(np.uint64)]))
    leaves = []
    tree = simhash.build(points[::7], leaves)
    pairs = set()
    for radius in (2,):
        home, visits = {}, {}
        for leaf, at, left in simhash.route(tree, points, np.arange(len(points)), np.full(len(points), radius, np.int8)):
            home[leaf], visits[leaf] = points[at[left == radius]], (points[at], left)
        for leaf, (query, left) in visits.items():
            for a, b in simhash.search(home[leaf], query, left, leaves[leaf], radius):
                pairs |= set(zip(a.tolist(), b.tolist()))
    want = {(int(p), int(q)) for p in points for q in points[(np.bitwise_count(points ^ p) <= 2) & (points < p)]}
    assert pairs == want and len(want) > 100


@pytest.mark.parametrize("few", [0, 60, 1 << 20])
def test_components(spark, few):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(40)] + [(5000, i) for i in range(6000, 6100)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), few=few).collect()}
    nodes = sorted({x for l in links for x in l if l[0] != l[1]})
    at = {x: i for i, x in enumerate(nodes)}
    edges = {(at[a], at[b]) for a, b in links} | {(at[b], at[a]) for a, b in links}
    want = classes(len(nodes), lambda i, j: (i, j) in edges)
    by = {}
    for n in nodes:
        by.setdefault(want[at[n]], set()).add(got[n])
    assert set(got) == set(nodes) and all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dup_stage(spark, texts):
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(3, texts[3], 5), (3, texts[3], 5)]
    got = simhash.near_dup_stage(spark, make_docs(spark, rows, ", k long"), "").collect()
    shingles = [simhash.shingle_hashes(t, 5) for _, t, _ in rows]
    sets = [set(s) for s in shingles]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    root = classes(len(rows), alike)
    keep = {min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root}
    assert sorted(r.doc_id for r in got) == sorted(keep) and got[0].asDict().keys() == {"doc_id", "text", "k"}
    assert simhash.near_dup_stage(spark, make_docs(spark, []), "").count() == 0


def edited(words, places):
    return [f"new{p}" if p in places else w for p, w in enumerate(words)]


def shingle_set(text):
    return set(simhash.shingle_hashes(text, 5))


def stays(spark, texts, **options):
    """The ids that the near-dup stage keeps, and what brute force keeps."""
    keep = simhash.keepers(make_docs(spark, list(enumerate(texts))), **options)
    gone = {r.k for r in keep.where("k <> keep_k").collect()}
    sets = [shingle_set(t) for t in texts]
    root = classes(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    mine = [i for i, t in enumerate(texts) if hashlib.md5(t.encode()).hexdigest() not in gone]
    return mine, sorted(set(root))


@pytest.mark.parametrize("block", [16, 512])
@pytest.mark.parametrize("copies", [12, 300])
def test_near_copies_of_a_base_that_is_not_the_least(spark, copies, block):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [edited(base, set(rng.sample(range(0, 400, 5), 8))) for _ in range(copies)] + [base]
    texts = [" ".join(f"{w}x{n}" if w.startswith("new") else w for w in t) for n, t in enumerate(texts)]
    sets = [shingle_set(t) for t in texts]
    assert all(len(s & sets[-1]) >= 0.8 * len(s | sets[-1]) for s in sets)
    assert simhash.keepers(make_docs(spark, list(enumerate(texts))), block=block).select("keep_id").distinct().count() == 1


@pytest.mark.parametrize("block", [40, 512])
def test_pairs_that_share_a_template_are_found(spark, block):
    """60 pairs at 0.84, all texts of one template and 0.6 to 0.75 alike, among 200 others of it, then as many of templates of their own."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(360)]

    def of(base, tag):
        free = sorted(rng.sample(range(0, 360, 12), 7))
        return [f"{tag}y{p}" if p in free else w for p, w in enumerate(base)]

    texts = []
    for i in range(60):
        one = of(template, f"p{i}")
        two = list(one)
        for p in rng.sample([q for q in range(6, 360, 12)], 6):
            two[p] = f"q{i}z{p}"
        texts += [one, two]
    texts += [of(of(template, f"r{i}"), f"s{i}") for i in range(200)]
    rng.shuffle(texts)
    mine, want = stays(spark, [" ".join(t) for t in texts], block=block)
    assert len(want) < len(texts) - 50
    assert mine == want  # no link lost, none made up


def test_similar_sets_of_every_size_meet_in_a_sample():
    """Pairs at a similarity of just 0.8 share a sample, small sets, large ones and those on either side of a boundary alike."""
    rng = np.random.default_rng(3)
    for n, least in ((5, 0.97), (7, 0.97), (9, 0.99), (60, 0.99), (70, 0.99), (300, 0.99), (500, 0.99), (620, 0.99), (4000, 0.99)):
        met = 0
        for _ in range(150):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
            gap = n - int(np.ceil(n * 0.8 - 1e-9))  # the smaller set lies in the larger
            drawn = [{(i, tuple(sorted(x.tolist()))) for i, x in simhash.samples_of(np.sort(pool[:m]))} for m in (n, n - gap)]
            met += bool(drawn[0] & drawn[1])
        assert met >= least * 150, n
    assert len(simhash.samples_of(np.empty(0, np.uint64))) == 1


def test_vantage_points_over_sets_lose_no_pair():
    rng = np.random.default_rng(8)
    base = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (30, 100, 100, 400)]
    sets = [np.empty(0, np.uint64), np.empty(0, np.uint64)]
    for b in base:
        for _ in range(90):
            keep = b[rng.random(len(b)) > rng.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)])))
    every = np.arange(len(sets))
    got = {(i, j) for a, b in simhash.alike(sets, every, every, 0.8) for i, j in zip(a.tolist(), b.tolist())}
    plain = [set(s.tolist()) for s in sets]
    want = {(i, j) for i in every.tolist() for j in every.tolist() if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j])}
    assert got == want and len(want) > 3 * len(sets)


def test_pairs_between_fingerprints_are_verified_before_links_are_reduced(spark, monkeypatch):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(edited(base, set(range(start, 400, 50)))) for start in (10, 20, 30)] + [" ".join(base), "something else " * 30]
    fps = {0: 0b1, 3: 0b111, 1: 0b11111, 2: 0b11111, 4: 0b11111}  # texts 1 and 2 are within two bits of the base alone
    keys = [hashlib.md5(t.encode()).hexdigest() for t in texts]
    rows = [(i, keys[i], len(shingle_set(texts[i])), fp, [1], [1000 * i + 1000]) for i, fp in fps.items()]
    monkeypatch.setattr(simhash, "sketches", lambda keyed, width: spark.createDataFrame(rows, "doc_id long, k string, size long, fp long, nths array<int>, fps array<long>"))
    got = simhash.near_dup_stage(spark, make_docs(spark, list(enumerate(texts))), "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 4]


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] * 24), (1060, [1.0] * 3), (1080, [1.0, None] * 12), (None, [1.0] * 24), (60, x[60].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    ids = np.arange(400)
    hit = 0
    for q in range(0, 400, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        best = np.lexsort((ids, -np.round(s, 9)))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, s[mine.vec_id])
        hit += len(set(best) & set(mine.vec_id))
    assert hit >= 0.95 * 400 and set(got.query_id) == set(range(0, 400, 20))
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")).toPandas()
    assert few.sort_values("rank").vec_id.tolist() == [1, 2]


def test_repeated_rows_take_one_place_among_the_neighbours(spark):
    x = np.random.default_rng(6).normal(size=(120, 16)).astype(np.float32)
    x[7] = 3 * x[0]  # far ahead of all others for query 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 40
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("query_id = 0").toPandas()
    assert got["rank"].tolist() and sorted(got["rank"]) == list(range(1, 21)) and got.vec_id.nunique() == 20


def test_scan_abandons_without_loss():
    rng = np.random.default_rng(9)
    q, x = rng.normal(size=(30, 64)), rng.normal(size=(3000, 64))
    x[:900] = q[np.arange(900) % 30] + 0.2 * rng.normal(size=(900, 64))  # neighbours far nearer than the rest
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    work = ann.Scan(q, np.full(30, -1), np.full(30, -np.inf), rotation, 10)
    work.list(np.arange(30), x, np.arange(3000))
    want = np.argsort(-(q @ x.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(want, work.found)]) > 0.98


def test_probes_are_chosen_for_the_aim():
    x = np.random.default_rng(2).normal(size=(400, 8))
    ids = np.arange(400)
    assert ann.AIM >= 0.98
    c = ann.k_means(x, 20, 1)
    probes, at = ann.choose_probes(x, ids, c, 20), ann.nearest(x, c)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    best, order = np.argsort(-s, 1)[:, :20], np.argsort(-(x @ c.T), 1)[:, :probes]
    assert np.mean([np.isin(at[b], o).mean() for b, o in zip(best, order)]) >= 0.98
