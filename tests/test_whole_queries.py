"""Queries without SQL over their whole tables, against Python."""

import json
import os

import pytest

from kilnwork.operators.prompt import EOT, header
from kilnwork.plans.queries import QUERIES, processed

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_prompts_of_all_rows(spark):
    rows = processed(spark, SF).collect()
    got = {r.key: r.text for r in QUERIES["render_prompts"](spark, SF).collect()}
    assert got.keys() == {r.key for r in rows} and any(k % 8 < 2 for k in got)
    for r in rows:
        system = f"{r.system.strip()}\n\n{json.dumps(json.loads(r.tools), ensure_ascii=False, indent=2)}"
        assert got[r.key] == "<|begin_of_text|>" + "".join(header(n) + t + EOT for n, t in (("system", system), ("user", r.user), ("assistant", r.assistant)))
    assert QUERIES["padded_tensors"](spark, SF).count() == len(rows)


def brute_tokens(text):
    n, inside = 0, False
    for c in text or "":
        word = c.isalnum() or c == "_"
        n += (word and not inside) or (not word and not c.isspace())
        inside = word
    return n


def test_token_lengths_of_all_documents(spark, tmp_path):
    texts = [None, "", "plain text", "déjà vu", "naïve “quote”—ok", "größe_x 東京 3"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in QUERIES["token_lengths"](spark, str(tmp_path)).collect()}
    assert got == {i: brute_tokens(t) for i, t in enumerate(texts)} and list(got[i] for i in range(6)) == [0, 0, 2, 2, 6, 3]
