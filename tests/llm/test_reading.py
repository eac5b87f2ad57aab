"""The language model's texts are read, cut into words, counted and hashed by whole arrays, as a plain reader does it word by word."""

import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kilnwork.llm import lm


def plain_words(texts):
    return [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]


def odd_texts():
    rng = random.Random(1)
    pieces = ["a", "B", "É", "　", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\x00", "word", "😀", "\ud800"]
    for _ in range(500):
        yield [None if rng.random() < 0.05 else "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]


def test_reading_makes_no_object_for_each_word():
    """A word is a place in an array."""
    texts = [" ".join(f"word{i}x{k}" for k in range(1000)) for i in range(20)]
    lm.read(texts)
    before = sys.getallocatedblocks()
    words, _, _ = lm.read(texts)
    assert sys.getallocatedblocks() - before < 2000 and len(words) == 20_000


def test_odd_texts_are_read_and_counted_as_a_plain_reader_does():
    for k, texts in enumerate(odd_texts()):
        want = plain_words(texts)
        words, data, ends = lm.read(texts)
        parts = [b" ".join(w) + b"\n" for w in want]
        assert data.tobytes() == b"".join(parts) and ends.tolist() == np.cumsum([len(p) for p in parts]).tolist()
        words, begin = lm.split(data, ends)
        flat = words.to_pylist()
        assert [flat[i:j] for i, j in zip(begin, [*begin[1:], len(flat)])] == [w or [b""] for w in want]
        counts = Counter(x for w in want for x in w) + Counter({b"": len(texts)})
        got = lm.tally_words(words, int((np.diff(ends, prepend=0) > 1).sum())).group_by("word").aggregate([("n", "sum")])
        assert {r["word"]: r["n_sum"] for r in got.to_pylist()} == counts
        logs = {b"": 1.5, b"a": 2.0, b"word": 3.25} if k % 3 else {b"": 0.0}
        known, sums, rare, n = lm.base(words, begin, pa.array(logs, pa.binary()), np.array(list(logs.values())))
        assert n.tolist() == [len(w) for w in want] and rare.to_pylist() == [[x for x in w if x not in logs] for w in want]
        assert known.tolist() == [sum(x in logs for x in w) + bool(logs[b""]) for w in want]
        assert sums.tolist() == pytest.approx([sum(logs.get(x, 0.0) for x in [*w, b""]) for w in want])


def test_contexts_are_those_of_their_definition():
    texts = ["", "a", "ab", "the cat sat", "Ünï cö dé", "é é x", "", "последнее слово", "b c"] * 3
    _, data, ends = lm.read(texts)
    code = lm.Code.of(np.bincount(data, minlength=256))
    symbols, got = lm.located(code, data, ends)
    cut = lambda h, r: ((h % 2**32) >> (32 - r)) << 6
    begin = 0
    for end in ends.tolist():
        wide, word, tongue = 0, [], 0
        for at in range(begin, end):
            recent = [int(s) + 1 for s in symbols[max(begin, at - 4) : at][::-1]]
            if at > begin and symbols[at - 1] == code.symbol[32]:
                word, tongue = [], wide
            h = (sum(s * pow(lm.FACTOR, i, 2**32) for i, s in enumerate(word)) + len(word)) % 2**32
            h ^= h >> 15
            want = [cut((h + tongue * 0x85EBCA6B) * 3266489917, lm.ROWS[0])]
            want += [cut(sum(s * 65**i for i, s in enumerate(recent[:k])) * 2654435761, r) for k, r in zip((4, 3), lm.ROWS[1:])]
            assert [int(c[at]) for c in got] == want
            word.append(int(symbols[at]) + 1)
            wide = int(symbols[at]) + 1 if data[at] >= 128 else wide
        begin = end


def test_frequent_and_rare_words_of_odd_texts_make_the_base_score(spark, monkeypatch):
    """By the broadcast and by the join."""
    monkeypatch.setattr(lm, "HOT", 40)
    texts = [t for texts in list(odd_texts())[:120] for t in texts if "\ud800" not in (t or "")]
    got = lm.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "doc_id % 7 <> 2").toPandas().set_index("doc_id")
    want = plain_words(texts)
    counts = Counter(x for i, w in enumerate(want) if i % 7 != 2 for x in [*w, b""])
    total = sum(counts.values())
    assert len(counts) > 80 and len(got) == len(texts) and set(got.train_tokens) == {total}
    for i, w in enumerate(want):
        tokens = [*w, b""]
        assert (got.n_tokens[i], got.n_known[i]) == (len(tokens), sum(x in counts for x in tokens))
        assert got.base_score[i] == pytest.approx(sum(np.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in tokens))


def test_words_of_one_task_are_looked_up_in_several_batches(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 300, 5000) ** 2) for _ in range(2 * lm.WORDS_LOOKED_UP // 5000 + 30)]
    got = lm.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "doc_id < 20").toPandas().set_index("doc_id")
    counts = Counter(x for t in texts[:20] for x in t.split()) + Counter({"": 20})
    log = {w: np.log10(c + 1) for w, c in counts.items()}
    least = np.log10(sum(counts.values()) + len(counts) + 1)
    assert sorted(got.index) == list(range(len(texts)))
    for i, t in enumerate(texts):
        tokens = [*t.split(), ""]
        assert got.n_known[i] == sum(x in log for x in tokens) and got.base_score[i] == pytest.approx(sum(log.get(x, 0.0) - least for x in tokens))
