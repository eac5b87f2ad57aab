"""Semantics on small literals."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kilnwork import config
from kilnwork.functions import jsontext as J
from kilnwork.functions import text as T
from kilnwork.functions.turns import first_turns
from kilnwork.operators import classify, extract, perturb, report, sample, teacher, tokens
from kilnwork.plans import pipelines

TOOL = {"name": "book", "parameters": {"type": "object", "properties": {"city": {"type": "string", "description": "City"}, "guest": {"type": "object", "description": "Guest", "properties": {"name": {"description": "Name"}, "vip": {"type": "boolean"}}}, "note": {"type": "string"}}, "required": ["city", "guest"]}}
OTHER = {"name": "pay", "parameters": {"properties": {"coupon_id": {"description": "Coupon"}, "channel": {"description": None}}}}


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def turns(spark, *rows):
    schema = "conversations array<struct<role:string,content:string,from:string,value:string>>"
    return spark.createDataFrame([(list(rows),)], schema).select(first_turns(F.col("conversations")).alias("t")).first().t


@pytest.mark.parametrize(("rows", "want"), [
    ([("user", " hi ", None, None), ("assistant", "yo", None, None)], ("hi", "yo")),
    ([(None, None, "user", "hi"), ("", "", "assistant", "yo")], ("hi", "yo")),
    ([("assistant", "early", None, None), ("user", "hi", None, None)], ("hi", "")),
    ([("user", "  ", None, None), ("user", "hi", None, None), ("user", "again", None, None), ("assistant", " ", None, None), ("assistant", "yo", None, None)], ("hi", "yo")),
    ([("human", "hi", None, None), ("gpt", "yo", None, None)], ("", "")),
    ([], ("", "")),
])
def test_first_turns(spark, rows, want):
    assert tuple(turns(spark, *rows)) == want


@pytest.mark.parametrize(("text", "want"), [
    ('Use "Latest Rates:(a=1)"', False), ("Latest Rates:(a=1)", True), ('"[f(x=1)]"', True), ("", False), ("  {", True), ("Sorry, none (really)", False), ("get rates (x)", True), (None, False),
])
def test_function_call(spark, text, want):
    assert one(spark, classify.is_function_call(F.col("a")), a=text) is want


@pytest.mark.parametrize(("text", "want"), [
    ("Which one do you mean?", "missing_parameters_or_clarification"), ("I cannot deliver that", "realtime_or_external_access_limit"), ("None of the functions fit", "no_matching_tool"),
    ("word " * 40, "direct_explanation"), ("[" + "word " * 40, "other_refusal"), ("word " * 39, "other_refusal"), ("", "other_refusal"), (None, "other_refusal"), ("I cannot. Which one? latest", "missing_parameters_or_clarification"),
])
def test_refusal_class(spark, text, want):
    assert one(spark, classify.refusal_class(F.col("a")), a=text) == want


@pytest.mark.parametrize(("text", "want"), [
    ('x {"required": []} [{"name": "f"}] y', [{"name": "f"}]), ('{"a": {"api_name": "g"}}', [{"api_name": "g"}]), ("list of tools as JSON: []", []), ("[] list of tools as JSON", None), ("list of tools as JSON:" + " " * 181 + "[]", None),
    ('{"function": {"name": "h"}}', [{"function": {"name": "h"}}]), ("[1, 2]", None), ("[" * 3000, None), ("", None),
])
def test_tool_block(text, want):
    found = J.tool_block(text)
    assert (found and found[2]) == want if want else (found is None if want is None else found[2] == [])


def test_written_tools(spark):
    system = "tool_name: a\nfirst\n* **tool_name**: b\nsecond\nWhen invoking tools, stop"
    assert one(spark, F.to_json(extract.written_tools(F.col("a"))), a=system) == json.dumps(["tool_name: a\nfirst", "* **tool_name**: b\nsecond"], separators=(",", ":"))
    xml = "<tool_name>a</tool_name> x <TOOL_NAME>b</TOOL_NAME> y\nShould you decide so"
    assert json.loads(one(spark, F.to_json(extract.written_tools(F.col("a"))), a=xml)) == ["<tool_name>a</tool_name> x", "<TOOL_NAME>b</TOOL_NAME> y"]
    assert one(spark, F.to_json(extract.written_tools(F.col("a"))), a="nothing") == "[]"


def test_parse_system_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, 'Hi [{"name": "f"}] there'), (4, "plain")], "k int, system string")
    got = {r.k: (r.system, r.tools, r.tool_count, r.tool_type, r.extract_failed) for r in extract.parse_system(df).collect()}
    assert got == {1: ("", "[]", 0, "non_json", True), 2: ("", "[]", 0, "non_json", True), 3: ("Hi  there", '[{"name": "f"}]', 1, "json", False), 4: ("plain", "[]", 0, "non_json", True)}


def test_names():
    assert J.described_names([TOOL, OTHER]) == ["city", "guest", "name", "coupon_id", "channel"]
    assert J.all_names(TOOL) == ["city", "guest", "name", "note", "vip"]
    assert J.strict_name({"api_name": "x"}) == "" and J.loose_name({"api_name": "x"}) == "x"
    assert J.tool_index([TOOL, {"x": 1}]) == {"book": ["city", "guest", "name", "note", "vip"]}


def test_perturb_row_keeps_what_must_stay():
    answer = '[book(city="x city", guest={"name": "a", "vip": true}, note="city and name")]'
    got = perturb.perturb_row(J.dump([TOOL, OTHER]), answer, True, True, True, 7)
    names, calls = json.loads(got["parameter_mapping"]), json.loads(got["function_mapping"])
    tools = {t["name"]: t for t in json.loads(got["tools"])}
    props = tools[calls["book"]]["parameters"]["properties"]
    assert set(props) == {names["city"], names["guest"], "note"} and set(props[names["guest"]]["properties"]) == {names["name"], "vip"}
    assert sorted(tools[calls["book"]]["parameters"]["required"]) == sorted([names["city"], names["guest"]])
    assert got["assistant"] == f'[{calls["book"]}({names["city"]}="x city", {names["guest"]}={{"{names["name"]}": "a", "vip": true}}, note="city and name")]'
    assert perturb.perturb_row("[]", "a", True, True, True, 7)["applied"] is False


@given(st.lists(st.integers(), min_size=2, unique=True), st.integers())
@settings(max_examples=50, deadline=None)
def test_forced_order_differs(items, seed):
    got = J.reorder(items, seed, ("p",), forced=True)
    assert got != items and sorted(got) == sorted(items)


def test_fresh_names_never_collide():
    names = [f"param_{i:04d}" for i in range(300)]
    got = J.fresh_names(names, "param", 1)
    assert len(set(got.values())) == 300 and not set(got.values()) & set(names)


def test_sampling_is_exact_and_partition_free(spark):
    df = spark.range(997).withColumnRenamed("id", "k")
    a = {r.k for r in sample.take_fraction(df.repartition(1), "k", 0.29, 5).collect()}
    assert a == {r.k for r in sample.take_fraction(df.repartition(37), "k", 0.29, 5).collect()} and len(a) == int(997 * 0.29)
    split = {r.split: r["count"] for r in sample.train_test(df, "k").groupBy("split").count().collect()}
    assert split == {"test": 50, "train": 947}
    modes = {r.mode: r["count"] for r in sample.bands(df, "k", perturb.TEACHER_MODES, 1).groupBy("mode").count().collect()}
    assert modes == {"original_refusal": 598, "param_only": 199, "function_only": 99, "param_and_function": 101}


@pytest.mark.parametrize("values", [[], [5], [1, 2], list(range(1, 101)), [3, 3, 3, 9]])
def test_length_stats(spark, values):
    got = report.length_stats(spark.createDataFrame([(v,) for v in values], "n int"), "n").first()
    v = sorted(values)
    at = lambda q: v[round(q / 100 * (len(v) - 1))] if v else 0
    assert tuple(got) == (len(v), v[0] if v else 0, at(50), at(90), at(95), at(99), v[-1] if v else 0)


def test_labels():
    lab = lambda ids, mask=None: tokens._labels(ids, mask, [1, 2], [9])
    assert lab([1, 2, 5, 9, 7, 1, 2, 6]) == [-100, -100, 5, 9, -100, -100, -100, 6]
    assert lab([5, 9]) == [-100, -100] and lab([]) == [] and lab(None) == []
    assert lab([1, 2, 5, 9], [1, 1, 1, 0]) == [-100, -100, 5, -100]
    assert tokens._labels([1, 2], None, [], [9]) == [-100, -100]


@pytest.mark.parametrize(("reply", "want"), [('```json\n{"a": 1}\n```', {"a": 1}), ('so {"a": 1} it is', {"a": 1}), ("[1]", None), ("none", None), (None, None)])
def test_lenient(reply, want):
    if want is None:
        with pytest.raises(ValueError):
            J.lenient_object(reply)
    else:
        assert J.lenient_object(reply) == want


def test_annotation_and_resume(spark):
    plan = spark.createDataFrame([(i, [("user", str(i))]) for i in range(4)], "source_index long, teacher_prompt array<struct<role:string,content:string>>")
    reply = {"success": [{"request": "r", "tool": "f", "call": "f(a=1)"}], "failed": [], "description": "ok"}

    def client():
        return lambda messages: "broken" if messages[0]["content"] == "2" else json.dumps(reply)

    got = {r.source_index: r for r in teacher.annotate(teacher.pending(plan, plan.where("source_index = 0")), client).collect()}
    assert sorted(got) == [1, 2, 3] and got[2].error and got[1].success[0].call == "f(a=1)"


def test_config():
    base = {"a": {"b": 1, "c": 2}, "profiles": {"x": {"a": {"b": 3}}}, "active_profile": "x"}
    assert config.with_profile(base)["a"] == {"b": 3, "c": 2} and base["a"]["b"] == 1
    with pytest.raises(KeyError):
        config.with_profile(base, "nope")


def test_prompt_shuffle(spark):
    prompt = "x " + J.dump([TOOL]) + J.USER_HEADER + ' [{"name": 1, "parameters": 2}]'
    df = spark.createDataFrame([(1, prompt), (2, "none"), (3, J.USER_HEADER + J.dump([TOOL]))], "k long, text string")
    got = {r.k: r for r in pipelines.shuffled_prompts(df, "k", ratio=1.0).collect()}
    assert got[1].changed and got[1].text != prompt and json.loads(got[1].text[2 : got[1].text.index(J.USER_HEADER)]) == [TOOL | {"parameters": TOOL["parameters"]}] or sorted(got[1].text) == sorted(prompt)
    assert not got[2].changed and not got[3].changed


def test_strip(spark):
    for s in ("\x1c a ", " x　", "", " \t\n"):
        assert one(spark, T.strip(F.col("a")), a=s) == s.strip()


def test_streaming_buckets(spark, tmp_path):
    from kilnwork.streaming.resume import stream_to_buckets

    schema = f"source_index long, teacher_success {teacher.SUCCESS}, teacher_failed {teacher.FAILED}, teacher_description string, tool_names array<string>, old_names array<string>"
    rows = [{"source_index": i, "teacher_success": [{"request": "r", "tool": "f", "call": "f(a=1)" if i else ""}], "teacher_failed": [], "teacher_description": "d", "tool_names": ["f"], "old_names": []} for i in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    stream_to_buckets(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r.status: r["count"] for r in spark.read.option("basePath", str(tmp_path / "out")).json(f"{tmp_path}/out").groupBy("status").count().collect()}
    assert got == {"valid": 2, "invalid_schema": 1}


def test_file_tokenizer(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    want = len(Tokenizer.from_file(path).encode("Hello world, twice", add_special_tokens=False).ids)
    assert one(spark, tokens.token_length(F.col("a"), tokens.file_tokenizer(path)), a="Hello world, twice") == want
    assert tokens.local_or_name("/nowhere", "x") == "x" and tokens.local_or_name("/tmp", "x") == "/tmp"


def test_older_readers():
    from kilnwork.config import for_older_readers

    new = {"rope_parameters": {"rope_theta": 5.0, "rope_type": "x"}, "dtype": "bfloat16", "tokenizer_class": "TokenizersBackend", "other": 1}
    assert for_older_readers(new) == {"rope_scaling": {"rope_type": "x"}, "rope_theta": 5.0, "torch_dtype": "bfloat16", "tokenizer_class": "PreTrainedTokenizerFast", "other": 1}
    assert "rope_parameters" in new and for_older_readers({"tokenizer_class": "Kept"}) == {"tokenizer_class": "Kept"}


def test_logger_adds_nothing_twice(tmp_path):
    from kilnwork.config import logger

    path = str(tmp_path / "logs" / "run.log")
    for _ in range(3):
        log = logger("kilnwork-test", path)
    assert len(log.handlers) == 2
    log.info("hello")
    assert open(path).read().count("hello") == 1


def test_special_ids():
    from kilnwork.operators.tokens import special_ids

    encode = lambda t: [len(t)]
    assert special_ids(encode, "ab", "c", pad=None, eos=9) == {"head": [2], "end": [1], "pad": 9} and special_ids(encode, "ab", "c", pad=0, eos=9)["pad"] == 0
    with pytest.raises(ValueError):
        special_ids(encode, "a", "b")
