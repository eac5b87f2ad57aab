"""The selector of op8 on sentences labelled by hand, none of which it has seen."""

import os

import pytest

from kilnwork.llm import pii

SF = "/root/testdata/sf0.01"
#: (text, kind, whether what the generators propose there is personal data)
SENTENCES = [
    ("write to bob (at) example.com please", "email", True), ("meet [at] noon (dot) later", "email", False), ("reach ann.lee [at] corp [dot] org today", "email", True), ("j.smith(at)uni(dot)edu", "email", True), ("sam [at] shop.net, thanks", "email", True),
    ("contact k99 (at) firm [dot] de now", "email", True), ("look [at] this.then go", "email", False), ("arrive (at) eight (dot) tomorrow", "email", False), ("we stop [at] station[dot]please", "email", False), ("info(at)museum.info", "email", True),
    ("shoot (at) will [dot] again", "email", False), ("her mail is mia_7 [at] post (dot) com", "email", True),
    ("server 10[.]1[.]2[.]3 is down", "ip", True), ("at 999[.]10[.]20[.]30 it says", "ip", False), ("host 192[.]168[.]0[.]14", "ip", True), ("from 8[.]8[.]4[.]4 again", "ip", True), ("no 300[.]1[.]1[.]1 here", "ip", False), ("values 1[.]2[.]3[.]256 there", "ip", False),
    ("amex card 378282246310005 works", "card", True), ("card: 371449635398431", "card", True), ("visa 4222222222222 old", "card", True), ("card 378282246310006 is wrong", "card", False), ("serial 123456789012345 on it", "card", False), ("number 99887766554433 only", "card", False),
    ("call (212) 555-0147 now", "phone", True), ("phone 415-555-0132", "phone", True), ("mobile 202.555.0188 please", "phone", True), ("order no. 415-555-0132 shipped", "phone", False), ("invoice 212 555 0147 paid", "phone", False),
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_sentences_labelled_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = spark.createDataFrame([(10**9 + i, t) for i, (t, _, _) in enumerate(SENTENCES)], "doc_id long, text string")
    found = {r.row_.doc_id - 10**9: {pii.KINDS[s.k] for s in r.spans} for r in pii.detect(docs.select("doc_id", "text").unionByName(rows)).where("row_.doc_id >= 1000000000").collect()}
    said = {i: kind in found[i] for i, (_, kind, _) in enumerate(SENTENCES)}
    wrong = [SENTENCES[i] for i in said if said[i] != SENTENCES[i][2]]
    right = [i for i in said if said[i] and SENTENCES[i][2]]
    assert said[0] and not said[1]
    assert len(right) / max(1, sum(said.values())) >= 0.95 and len(right) / sum(g for *_, g in SENTENCES) >= 0.8, wrong


def test_no_feature_is_the_label(spark):
    """Of the examples of each kind no single feature says alone which are good; the bracket and the written dot say nothing."""
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(pii.invented_examples())], "i long, text string, y int")
    got = df.select("y", pii.F.explode(pii.candidates(pii.F.col("text"))).alias("c")).select("y", "c.*").toPandas()
    mail = got[got.kind == 0]
    assert len(mail) > 200 and abs(mail[mail.y == 1].written.mean() - mail[mail.y == 0].written.mean()) < 0.15
    for kind in (0, 2, 3):
        mine = got[got.kind == kind]
        for f in pii.FEATURES[1:]:
            best = max((((mine[f] <= c) == (mine.y == good)).mean() for c in mine[f].unique() for good in (0, 1)))
            assert best < 0.999, (kind, f)
