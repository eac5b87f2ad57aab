"""WARC, packing, mixing, LM scoring, PII, quality and the pipeline on small tables."""

import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from kilnwork.llm import boosting, lm, mixing, packing, pii, ranking, registry, rules, stats, warc
from kilnwork.llm.base import Hashes, fresh_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "a", "x" * 50_000, "Ünïcode ß　end 😀 done", "same line\nsame line\n\nsame line", "word " * 3000]


def odd_docs(spark, rows=None):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(ODD)] + [(3, "a", "en", "s0", 1), (3, "a", "en", "s0", 1), (None, "b c", None, None, None)] if rows is None else rows
    return spark.createDataFrame(rows, DOCS)


# ---- WARC ----


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/", big), (5, "http://b/", big), (9, None, big), (2, "u v", "short"), (3, "x", "short"), (4, "y", None), (6, "z", "\r\n\r\nWARC/1.1\r\n" * 200), (None, "n", big), (9, "again", big)]
    path = fresh_path(spark, "warc-test")
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int").repartition(2)
    warc.write_warc(pages, path)
    for size in (37, 1000, 1 << 20):
        back = warc.read_warc(spark, path, split_bytes=size).collect()
        assert len(back) == len(rows)
        got = sorted((str(r.page_id), r.record_type, str(r.refers_to), bytes(r.payload).decode()) for r in back)
        want = sorted((str(i), "revisit" if h == big and i != 9 else "response", "9" if h == big and i != 9 else "None", "" if h == big and i != 9 else h or "") for i, _, h in rows)
        assert got == want
    out = {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.resolve(warc.figures(warc.read_warc(spark, path))).collect()}
    assert out == {(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows}
    folder = path.removeprefix("file://")
    files = [f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part-")]
    assert sum(gzip.open(f).read().count(b"WARC-Record-ID") for f in files) == len(rows)  # any reader can


def test_warc_false_magic_and_empty(spark, tmp_path):
    noise = random.Random(1).randbytes(3000).replace(b"\x1f\x8b\x08", b"")
    inner = noise + warc.MAGIC + noise + warc.MAGIC + b"\x00" * 40
    z = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so the magic shows inside the member
    member = z.compress(warc.record("response", 7, "u", inner, None)) + z.flush()
    (tmp_path / "a.warc.gz").write_bytes(warc.gzip_member(warc.record("response", 1, "u", b"one", None)) + member + warc.EMPTY_MEMBER + warc.gzip_member(warc.record("response", 2, "u", b"two", None)))
    for size in (11, 500, 1 << 20):
        got = warc.read_warc(spark, str(tmp_path), split_bytes=size).collect()
        assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(1, b"one"), (2, b"two"), (7, inner)]
    path = fresh_path(spark, "warc-empty")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


# ---- packing ----


def test_memo_of_word_ids_is_bounded_and_keeps_frequent_words():
    """Executors hold a memo for every Python worker beside the heap: it stays small, and its ids are those of the tokenizer."""
    ids = packing.WordIds(packing.vocabulary(), limit=20)
    calls, split = [], ids.split
    ids.split = lambda word: (calls.append(word), split(word))[1]
    rare = [("a" * (i % 9 + 1) + "bcdefgh"[i % 7] * (i // 9 + 1)).encode() for i in range(200)]
    want = packing.WordIds(packing.vocabulary())
    for word in rare:
        assert ids[b"often"] == want[b"often"] and ids[word] == want[word]
        assert len(ids) <= 20 and len(ids.elder) <= 20
    assert calls.count("often") == 1
    assert 2 * packing.WordIds(packing.vocabulary()).limit < 400_000


def test_workers_give_back_what_they_freed(monkeypatch):
    from kilnwork.llm import base

    given = []
    monkeypatch.setattr(base, "give_back", lambda: given.append(1))
    batches = [pa.record_batch([pa.array(["x" * 9] * 600)], ["text"]) for _ in range(3)]
    assert [len(part) for part in base.rows(iter(batches), "text", limit_bytes=9 * 600)] == [600] * 3 and len(given) == 3


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    docs = odd_docs(spark)
    got = packing.pack(docs, shard_pieces=5).toPandas()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(-(-len(ids) // 4096)):
            x = ids[4096 * k : 4096 * (k + 1)]
            want[(str(r.doc_id), k, 4096 * k, len(x), zlib.crc32(x.tobytes()))] += 1
    assert Counter((("None" if np.isnan(float(d)) else str(int(d))), p, s, n, c) for d, p, s, n, c in zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert packing.pack(odd_docs(spark, [])).count() == 0


@given(st.lists(st.integers(1, 64), min_size=1, max_size=400))
@settings(max_examples=60, deadline=None)
def test_sum_of_squares_is_gapless_and_tight(sizes):
    sizes = np.array(sizes)
    seq, off = packing.best_fit(sizes, 64)
    for s in np.unique(seq):
        at = np.flatnonzero(seq == s)
        at = at[np.argsort(off[at])]
        assert off[at].tolist() == [0, *np.cumsum(sizes[at])[:-1].tolist()] and sizes[at].sum() <= 64
    assert len(np.unique(seq)) <= 1.3 * math.ceil(sizes.sum() / 64) + 2


# ---- mixing ----


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 450, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.water_fill([10, 0], [5, 2], 15, 2) == pytest.approx([20, 0]) or sum(mixing.water_fill([10, 0], [5, 2], 15, 2)) <= 15 + 1e-9
    assert mixing.water_fill([], [], 0, 2) == []


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(0, 120))
@settings(max_examples=100, deadline=None)
def test_subset_sum_is_best(items, budget):
    got = mixing.subset_sum([a for a, _ in items], [n for _, n in items], budget)
    assert all(0 <= got.get(a, 0) <= n for a, n in items)
    reach = {0}
    for a, n in items:
        reach = {r + a * k for r in reach for k in range(n + 1)}
    assert sum(a * k for a, k in got.items()) == max(r for r in reach if r <= budget)


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(40), None, rng.choice(["b", "a", None, "c"]), None) for i in range(900)] + [(i, "w " * 10, None, "a", None) for i in range(900, 3000)]
    docs = odd_docs(spark, rows)
    got = mixing.mix(docs.repartition(3)).toPandas()
    sizes = docs.toPandas().assign(n=lambda d: d.text.str.split().str.len())
    order = ["a", "b", "c", None]
    total = {s: int(sizes[sizes.source.isna() if s is None else sizes.source == s].n.sum()) for s in order}
    want = dict(zip(order, mixing.water_fill([total[s] for s in order], [5, 2, 1, 5], 1.5 * sum(total.values()), 2)))
    for s in order:
        g = got[got.source.isna() if s is None else got.source == s]
        assert set(g.source_size) == {total[s]} and g.target.iloc[0] == pytest.approx(want[s]) and abs(g.taken.sum() - want[s]) <= 1
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].replace(0, 1) == 0).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))
    staged = mixing.mix_stage(spark, docs, "")
    assert staged.columns == docs.columns and staged.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    assert mixing.mix(odd_docs(spark)).count() == len(ODD) + 3 and mixing.mix(odd_docs(spark, [])).count() == 0


def test_mixing_tells_rows_of_one_id_apart_and_bears_clashing_names(spark):
    rows = [(i % 7, f"w{i} x y", "a" if i % 3 else None, i, "b", i, -i, "c") for i in range(60)] + [(None, f"n{i} x y", "a", 0, "b", 0, 0, "c") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, h int, bucket string, size int, copies int, row_ string")
    kept = [sorted(map(tuple, mixing.mix_stage(spark, docs.repartition(n), "").collect()), key=str) for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) > 60 and set(kept[0]) <= set(rows)


# ---- LM ----


def test_lm(spark):
    rng = random.Random(2)
    syllables = ["ka", "lo", "mi", "ru", "te"]
    text = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 200)))
    rows = [(i, text(), None, None, None) for i in range(300)] + [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "ka lo", None, None, None), (3, "ka", None, None, None)]
    docs = odd_docs(spark, rows)
    got = lm.score_texts(docs, "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 <> 2").collect()
    tokens = [(d, [w.lower() for w in (t or "").encode().split()] + [b""]) for d, t, *_ in rows]
    c = Counter(w for d, ws in tokens if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    plain = [r for r in got if r.doc_id is not None and r.doc_id < 300]
    assert sum(r.score for r in plain) > 1.1 * sum(r.base_score for r in plain) and all(r.score < 0 for r in got)
    alone = {r.doc_id: r.score for r in lm.score_texts(docs.repartition(5), "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 <> 2").collect() if r.doc_id is not None and r.doc_id != 3}
    assert all(alone[r.doc_id] == pytest.approx(r.score, rel=1e-6) for r in got if r.doc_id in alone)
    assert lm.score_texts(odd_docs(spark, []), "true").count() == 0 and lm.score_texts(odd_docs(spark), "false").count() == len(ODD) + 3


def test_code_is_a_prefix_code_and_sparse_counts_return():
    code = lm.Code.of(np.bincount(np.frombuffer(b"the quick brown fox jumps over the lazy dog" * 9, np.uint8), minlength=256))
    assert sum(2.0 ** -len(p) for p in code.paths) == 1.0
    c = np.random.default_rng(1).integers(0, 3, lm.CHUNK).astype(np.uint32) * np.random.default_rng(2).integers(0, 400, lm.CHUNK).astype(np.uint32)
    back = np.zeros(lm.CHUNK, np.uint64)
    lm.add_sparse(back, lm.sparse(c))
    assert (back == c).all()


# ---- PII ----

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    luhn = lambda s: sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0
    ok = {"email": lambda v: True, "ip": lambda v: all(int(x) <= 255 for x in v.split(".")), "card": lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v)), "phone": lambda v: 8 <= len(digits(v)) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if ok[k](m[0])]


def test_pii(spark):
    rng = random.Random(6)
    bits = ["a@b.c", "x.y@z-1.co.uk_q@w.de", "1.2.3.4.5.6.7.8", "000255.1.1.1", "256.1.1.1", "4111 1111-1111 1111", "41111111111111112", "+1 (555) 010-2030", "+12", "😀", "a", "@", ".", " ", "1", "-", "é", "+", "(415) 555-1234", "bob (at) site (dot) com", "12345678901234567890"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(400)] + [None, "", "1" * 20_000, "a" * 20_000 + "@b.c", "9 " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    found = pii.detect(df)
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().executedPlan().toString())
    for r in found.select(F.col("row_.doc_id").alias("i"), pii.named("base").alias("b"), pii.named("spans").alias("s")).collect():
        want = brute_pii(texts[r.i])
        assert r.b == ",".join(want) and set(want) <= set(filter(None, r.s.split(","))), texts[r.i]
    more = spark.createDataFrame([(1, "call (415) 555-1234 now", 0), (2, "order 415-555-123456", 0)], "doc_id long, text string, n_chars int")
    out = {r.doc_id: r for r in pii.pii_stage(spark, more, "").collect()}
    assert out[1].text == "call [PHONE] now" and out[1].n_chars == len(out[1].text) and out[2].text == "order 415-555-123456"
    assert pii.pii_stage(spark, df.limit(0), "").count() == 0


def test_selector_learns_from_the_corpus(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    spans = ["ab.cd@mail.example.com", "41.223.162.36", "4111111111111111", "+1 (578) 555-6437"]
    rows = [(i, " ".join([word(), word(), spans[i % 4].replace("41.", f"{i % 200 + 1}."), word(), word()])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.kind, r.y): r["count"] for r in pii.corpus_examples(docs).groupBy("kind", "y").count().collect()}
    assert {k for k, _ in found} == {0.0, 1.0, 2.0, 3.0} and all(found.get((k, y), 0) > 50 for k in (0.0, 1.0, 3.0) for y in (0, 1))
    assert all(p >= 0.95 and r >= 0.9 for p, r, n in pii.selector_quality(docs).values())


# ---- quality ----


def test_base_counts():
    for text in [*ODD, "a b c d e f g h i " * 4, "x # y\nx # y\n |z| & <b> $5 100%"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
        assert stats.describe(text, Hashes())[0] == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)]


def test_boosting_is_monotone_and_learns():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] + np.sin(3 * x[:, 1]) - x[:, 2]) > 0).astype(float)
    trees = boosting.fit(x, y, monotone={0: 1, 2: -1})
    assert ((trees.margin(x) > 0) == (y == 1)).mean() > 0.93
    for f, sign in ((0, 1), (2, -1)):
        grid = np.repeat(x[:50], 40, 0)
        grid[:, f] = np.tile(np.linspace(-3, 3, 40), 50)
        assert (sign * np.diff(trees.margin(grid).reshape(50, 40), axis=1) >= -1e-9).all()
    slow = np.full(20, trees.base)
    for i in range(20):
        for t in range(len(trees.feature)):
            at = 0
            while at < len(trees.feature[t]):
                at = 2 * at + 1 + int(x[i, trees.feature[t, at]] > trees.threshold[t, at])
            slow[i] += trees.value[t, at - len(trees.feature[t])]
    assert np.allclose(slow, trees.margin(x[:20])) and boosting.fit(x, np.ones(3000)).probability(x[:1])[0] > 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_quality_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ranked = registry.QUERIES["op9_quality_ranking"](spark, sf).collect()
    held = [(label[r.doc_id], r.predicted, r.score) for r in ranked if r.held_out and r.doc_id in label]
    assert np.mean([a == b for a, b, _ in held]) > 0.93 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in ranked)
    ruled = registry.QUERIES["op4_quality_rules"](spark, sf).collect()
    assert np.mean([r.kept == label[r.doc_id] for r in ruled if r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]) > 0.9


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark)
    assert ranking.rank_documents(docs, none).where("predicted = 1").count() == len(ODD) + 3
    got = rules.quality_rules(docs, none).collect()
    assert len(got) == len(ODD) + 3 and not any(r.kept and r.n_words < 20 for r in got)
    assert ranking.rank_documents(odd_docs(spark, []), none).count() == 0 and rules.quality_rules(odd_docs(spark, []), none).count() == 0


# ---- queries and pipeline ----


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    cols = sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).map(lambda v: int(v) if isinstance(v, float) else v).astype(str).to_numpy().tolist()))
    assert cols == sorted(got.columns) and rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    assert [s.split()[0] for s, _ in corpus_pipeline.STAGES] == ["quality", "SimHash", "PII", "mixing", "best-fit"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()
    clean = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    assert clean.count() == docs.count() and clean.where(F.col("text").rlike(BASE["email"])).count() == 0
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and (out.groupby("sequence_id").length.sum() <= 4096).all()
