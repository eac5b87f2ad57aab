"""Phrase mining against plain Python, and the perfect hash against sets."""

import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kilnwork.llm import collocation as C
from kilnwork.llm.perfecthash import PerfectHash

DOCS = "doc_id long, text string, lang string, id int, phrase int, a int, n int"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.lists(st.integers(0, 2**64 - 1), max_size=100))
def test_perfect_hash_is_minimal_and_knows_its_keys(keys, others):
    keys = np.array(sorted(keys), np.uint64)
    h = PerfectHash(keys)
    assert sorted(h.find(keys).tolist()) == list(range(len(keys)))
    foreign = np.array([x for x in others if x not in set(keys.tolist())], np.uint64)
    assert (h.find(foreign) == -1).all()


def test_perfect_hash_of_many_keys_is_small():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 300_000).astype(np.uint64))
    h = PerfectHash(keys)
    assert (np.sort(h.find(keys)) == np.arange(len(keys))).all() and (h.words.nbytes + h.ranks.nbytes) * 8 < 6.5 * len(keys)


def brute(docs, least=30, inside=80, most=2000):
    """All contiguous phrases counted, as the contract words it."""
    f, out = {}, []
    for text, lang in docs:
        own = f.setdefault("und" if lang is None else lang, Counter())
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, ".")
        for piece in text.split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        usual = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in usual.items():
            if any(100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in usual.items() if len(q) > len(p)):
                continue
            score, _, l, r = min((int(Fraction(2_000_000 * a, own[p[:k]] + own[p[k:]])), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:most])]
    return sorted(out)


def made(seed=3, n=400):
    rng = random.Random(seed)
    common = ["the", "of", "Red", "red", "über", "😀", "x" * 30, "and", "New", "York", "city"]
    out = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.8 else f"w{rng.randint(0, 2000)}" for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            words[10:10] = ["New", "york", "City", "hall"]
        out.append((rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]).join(words), rng.choice(["en", "de", None, "und", ""])))
    return [*out, (None, "en"), ("", None), (" \n.", "fr"), *out[:40], ("a b " * 3000, "rep")]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def table_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, g, 1, 1, 1, 1) for i, (t, g) in enumerate(rows)], DOCS).repartition(parts)


@pytest.mark.parametrize("words, keys", [(500_000, 2_000_000), (4, 11)])
def test_phrases_equal_brute_force(spark, words, keys):
    """In one group, and with words and candidates dealt over many; nulls, ties, repeated rows, a phrase of itself, clashing names."""
    rows = made()
    got = C.collocations(table_of(spark, rows), least=9, words_at_once=words, keys_at_once=keys).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows, least=9) and len(got) > 50


def test_cuts_tops_and_empty_tables(spark):
    rows = made(8, 150)
    for options in ({"least": 5, "most": 20}, {"least": 8, "inside": 40, "most": 7}):
        got = C.collocations(table_of(spark, rows), **options).collect()
        assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows, **options)
    assert C.collocations(table_of(spark, [])).count() == 0
    assert C.collocations(table_of(spark, [(None, None), ("one two", "en")])).count() == 0


def test_query_against_sql(spark, tmp_path):
    table_of(spark, made(5)).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = C.op13_mine_collocations(spark, str(tmp_path)).toPandas(), con.execute(C.OP13_SQL).df()
    text = lambda df: sorted(map(tuple, df[COLUMNS].astype(str).to_numpy().tolist()))
    assert text(got) == text(want) and len(got)


def test_rare_pairs_take_no_passes(spark, monkeypatch):
    """A sieve that is full lets every pair through; passes over the texts follow what is frequent."""
    monkeypatch.setattr(C, "SIEVE_LEAST", 4)
    monkeypatch.setattr(C, "SIEVE_MOST", 4)
    passes, respell = [], C.respell
    monkeypatch.setattr(C, "respell", lambda *a: passes.append(1) or respell(*a))
    rng = random.Random(4)
    rows = [(" ".join(f"w{rng.randint(0, 39)}" for _ in range(40)) + ". New York city. New York city", "en") for _ in range(60)]
    got = C.collocations(table_of(spark, rows), least=30, keys_at_once=60).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows) and got and len(passes) == 2
