"""Batch tokenization and labels against one row at a time; many names against one pattern a name."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kilnwork.functions import jsontext as J
from kilnwork.functions import names as N
from kilnwork.operators import classify, perturb, tokens

# ---- labels ----


def by_position(ids, mask, head, end):
    out, at = [-100] * len(ids), 0
    find = lambda p, i: next((j for j in range(i, len(ids) - len(p) + 1) if ids[j : j + len(p)] == p), -1) if p else -1
    while (h := find(head, at)) >= 0:
        start = h + len(head)
        e = find(end, start)
        at = e + len(end) if e >= 0 else len(ids)
        out[start:at] = ids[start:at]
    return [-100 if mask is not None and i < len(mask) and mask[i] == 0 else x for i, x in enumerate(out)]


few = st.lists(st.integers(1, 3), max_size=14)


@settings(max_examples=400, deadline=None)
@given(st.lists(few, min_size=1, max_size=6), st.lists(st.integers(1, 3), max_size=3), st.lists(st.integers(1, 3), max_size=3))
def test_labels_of_rows_one_behind_the_other(rows, head, end):
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    got = tokens.labels_of(np.array([x for r in rows for x in r], np.int64), offsets, head, end)
    assert [got[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [by_position(r, None, head, end) for r in rows]


def test_labels_of_columns_with_nulls(spark):
    rows = [([1, 2, 5, 9], [1, 1, 1, 1]), (None, None), ([], []), ([1, 2, 5, 6], [1, 1, 0]), ([1, 2, 7], None), ([1, 2, 8, 9, 1, 2, 4], [1, 1, 1, 1, 1, 1, 0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ids array<int>, mask array<int>").repartition(1)
    got = {r.i: r.l for r in df.select("i", tokens.answer_labels(F.col("ids"), F.col("mask"), [1, 2], [9]).alias("l")).collect()}
    assert got == {i: by_position(ids or [], mask, [1, 2], [9]) for i, (ids, mask) in enumerate(rows)}


def test_tensors_of_a_batch(spark):
    texts = ["a b", None, "", "w " * 40, "é <|x|> 9", *(" ".join(random.Random(i).choices("abc", k=i)) for i in range(30))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    got = {r.i: r for r in df.select("i", tokens.tokenized(F.col("t"), 16, -7).alias("x"), tokens.token_length(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        ids = tokens.default_tokenizer(t or "")
        cut = ids[:16]
        assert got[i].n == len(ids) and got[i].x.input_ids == cut + [-7] * (16 - len(cut)) and got[i].x.attention_mask == [1] * len(cut) + [0] * (16 - len(cut))


def test_file_tokenizer_takes_batches(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    plain, special = tokens.file_tokenizer(path), tokens.file_tokenizer(path, special=True)
    texts = ["Hello world", "", "é" * 50, "a\nb"]
    assert plain.batch(texts) == [plain(t) for t in texts] and special.batch(texts) == [special(t) for t in texts]


# ---- names ----


def one_by_one(text, names, kind="parameters"):
    """The rule as it is worded: the longest first, quoted and then bare, one pattern after the other."""
    for old, new in sorted(names.items(), key=lambda x: -len(x[0])):
        word = re.escape(old)
        forms = (rf"""(?<=(["'])){word}(?=\1\s*[=:/|~])""", rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])(?=\s*[=:/|~])") if kind == "parameters" else (rf"(?<![A-Za-z0-9_.]){word}(?=\s*\()",)
        for f in forms:
            text = re.sub(f, lambda _: new, text)  # noqa: B023
    return text


letters = st.text(alphabet="ab_A. =:(\"'\\/é", max_size=30)
name = st.text(alphabet="ab_A.é =", min_size=0, max_size=3)


@settings(max_examples=500, deadline=None)
@given(letters, st.dictionaries(name, st.text(alphabet="ab_=\"' (x\\", max_size=4), max_size=5))
def test_renaming_equals_one_pattern_after_the_other(text, names):
    assert J.rename_assignments(text, names) == one_by_one(text, names)
    assert J.rename_calls(text, names) == one_by_one(text, names, "functions")


@settings(max_examples=500, deadline=None)
@given(letters, st.lists(name, max_size=5))
def test_what_stands_in_a_text_equals_a_pattern_for_each_name(text, names):
    esc = lambda n: re.escape(n)
    bare = lambda n: rf"(?<![A-Za-z0-9_]){esc(n)}(?![A-Za-z0-9_])"
    assert N.assigned(text, names) == any(re.search(rf"""(?:(['"]){esc(n)}\1|{bare(n)})(?=\s*[=:/|~])""", text) for n in names)
    assert N.mentioned(text, names) == any(re.search(bare(n.lower()), text.lower()) for n in names)
    assert N.called(text, names) == any(re.search(rf"(?<![A-Za-z0-9_.]){esc(n)}\s*\(", text) for n in names)
    left = sorted(n for n in names if re.search(rf"{bare(n)}(?=\s*[=:])", text))
    assert N.first_left(text, names) == (left[0] if left else None)


def test_native_and_automaton_agree_on_columns(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice(["a", "ab", "_", " ", "=", ":", "(", '"', "'", ".", "A"]) for _ in range(rng.randint(0, 14))), [rng.choice(["a", "ab", "a_", "b.a", "A"]) for _ in range(rng.randint(0, 3))]) for _ in range(600)]
    df = spark.createDataFrame([*rows, (None, ["a"]), ("a=1", None)], "t string, n array<string>").repartition(3)
    native = F.when(classify.assigns_any(F.col("t"), F.col("n")), "assigned").when(classify.mentions_any(F.col("t"), F.col("n")), "mentioned")
    assert df.where(~classify.uses_any("t", "n").eqNullSafe(native)).count() == 0
    assert {r.u for r in df.select(classify.uses_any("t", "n").alias("u")).distinct().collect()} == {None, "assigned", "mentioned"}


def test_fifty_names_are_faster_than_fifty_patterns():
    rng = random.Random(1)
    names = {f"parameter_{rng.randint(0, 9999)}_{i}": f"param_{i:04d}" for i in range(50)}
    texts = [f"[f({', '.join(f'{n}={i}' for i, n in enumerate(rng.sample(list(names), 3)))})] " + "some words of an answer " * 10 for _ in range(60)]
    began = time.perf_counter()
    fast = [J.rename_assignments(t, names) for t in texts]
    middle = time.perf_counter()
    assert fast == [one_by_one(t, names) for t in texts]
    assert middle - began < 0.5 * (time.perf_counter() - middle)


def test_perturbing_is_what_it_was():
    row = perturb.perturb_row('[{"name": "f", "parameters": {"properties": {"size": {"description": "s"}, "no": {}}, "required": ["size", 3]}}]', "[f(size=1, no=2)] size: x", True, True, True, 5)
    assert row["applied"] and "size" not in row["assistant"] and "no=2" in row["assistant"] and '"3"' in row["tools"]


def test_strict_renaming_leaves_values_alone():
    answer = "[f(data=1, note='see data/x or data | b', link=\"data://y\", 'data': 2)]"
    row = lambda strict: perturb.perturb_row('[{"name": "f", "parameters": {"properties": {"data": {"description": "d"}}}}]', answer, True, False, True, 5, strict)["assistant"]
    new = row(True).split("(")[1].split("=")[0]
    assert row(True) == answer.replace("(data=", f"({new}=").replace("'data':", f"'{new}':")
    assert row(False) == answer.replace("data", new)
