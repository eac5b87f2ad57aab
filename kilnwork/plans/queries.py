"""Registered queries of the tool-calling engine and their DuckDB SQL. The adapters' SQL is shared; the oracles' logic is not."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..functions import text as T
from ..functions.turns import first_turns, gather_turns
from ..operators import classify, extract, perturb, report, sample, teacher, tokens
from ..operators.prompt import EOT, header, render_prompt
from . import adapters as A
from ..sources import io
from ..sources.arrow import read_arrow, write_arrow
from ..sources.ledger import Ledger
from ..streaming.resume import stream_to_ledger
from . import pipelines

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run(spark, sf_dir, A.A_PROCESSED)


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run(spark, sf_dir, A.A_TOOL)


P, TOOL = f"p AS ({A.A_PROCESSED})", f"t AS ({A.A_TOOL})"
TURNS = """u AS (SELECT conv_id, min(turn) AS ut FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1),
a AS (SELECT c.conv_id, min(turn) AS a_t FROM conversations c JOIN u USING (conv_id) WHERE role = 'assistant' AND trim(text) <> '' AND turn > ut GROUP BY 1),
f AS (SELECT k.conv_id, coalesce(trim(x.text), '') AS user_text, coalesce(trim(y.text), '') AS assistant_text FROM (SELECT DISTINCT conv_id FROM conversations) k
  LEFT JOIN u USING (conv_id) LEFT JOIN a USING (conv_id) LEFT JOIN conversations x ON x.conv_id = k.conv_id AND x.turn = ut LEFT JOIN conversations y ON y.conv_id = k.conv_id AND y.turn = a_t)"""
CALL = r"""regexp_matches(regexp_replace(trim(assistant, ' '), '^"+|"+$', '', 'g'), '^([\[{(<]|[A-Za-z0-9_. -]{1,80}\s*:?\s*\()')"""
CLASS = """CASE WHEN contains(assistant, '?') AND regexp_matches(lower(assistant), 'may i know|could you provide|please provide|please specify|which |what |need the|need your|required|missing|lack') THEN 'missing_parameters_or_clarification'
  WHEN regexp_matches(lower(assistant), 'real-time|current|latest|live|trending|right now|directly fetch|access to|browse|internet|up-to-date') AND regexp_matches(lower(assistant), 'i don''t have|i do not have|i can''t|i cannot|unable to') THEN 'realtime_or_external_access_limit'
  WHEN regexp_matches(lower(assistant), 'none of the|no function|no tool|does not provide|do not provide|not designed|not available|cannot provide a way') THEN 'no_matching_tool'
  WHEN len(regexp_extract_all(assistant, '\\S+')) >= 40 AND NOT starts_with(trim(assistant), '[') THEN 'direct_explanation' ELSE 'other_refusal' END""".replace("\\\\", "\\")
ORDER = "row_number() OVER (ORDER BY md5('{seed}:' || cast(key AS VARCHAR)), key)"
NAMES = "CASE key % 8 WHEN 0 THEN CASE WHEN key % 3 = 0 THEN ['size', 'depot'] ELSE ['size', 'brand', 'depot'] END WHEN 1 THEN CASE WHEN key % 3 = 0 THEN ['size'] ELSE ['size', 'brand'] END ELSE CAST([] AS VARCHAR[]) END"
FEASIBLE = f"""CASE WHEN tool_type <> 'json' THEN 'cannot_ablate_non_json_tool' WHEN len({NAMES}) = 0 THEN 'cannot_ablate_no_described_parameters'
  WHEN len(list_filter({NAMES}, lambda n: regexp_matches(assistant, '(^|[^A-Za-z0-9_])' || n || '\\s*[=:/|~]'))) > 0 THEN 'can_ablate_tools_and_assistant_safely'
  WHEN len(list_filter({NAMES}, lambda n: regexp_matches(lower(assistant), '(^|[^a-z0-9_])' || n || '($|[^a-z0-9_])'))) > 0 THEN 'can_ablate_tools_only_assistant_mentions_params_in_prose'
  ELSE 'can_ablate_tools_only_assistant_no_param_reference' END"""
BUCKET = "CASE WHEN tool_count <= 0 THEN 'zero_tool' WHEN tool_count = 1 THEN 'single_tool' ELSE 'multiple_tool' END"


# ---- turns, calls, frequencies ----


@query(f"WITH {TURNS} SELECT conv_id, user_text, assistant_text FROM f")
def first_turn(spark, sf_dir):
    return gather_turns(read(spark, sf_dir, "conversations")).withColumn("t", first_turns(F.col("conversations"))).select("conv_id", F.col("t.user").alias("user_text"), F.col("t.assistant").alias("assistant_text"))


@query(f"""WITH {TURNS}, c AS (SELECT {CLASS} AS value FROM (SELECT assistant_text AS assistant FROM f) WHERE NOT {CALL})
SELECT value, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS ratio FROM c GROUP BY 1""")
def refusal_frequency(spark, sf_dir):
    first = first_turn(spark, sf_dir).where(~classify.is_function_call(F.col("assistant_text")))
    return report.frequency(first, classify.refusal_class(F.col("assistant_text")))


@query(f"WITH {P} SELECT key, {CALL} AS is_call FROM p")
def function_call_detection(spark, sf_dir):
    return processed(spark, sf_dir).select("key", classify.is_function_call(F.col("assistant")).alias("is_call"))


@query(f"WITH {P} SELECT {BUCKET} AS value, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS ratio FROM p GROUP BY 1")
def tool_bucket_frequency(spark, sf_dir):
    return report.frequency(processed(spark, sf_dir), classify.tool_bucket(F.col("tool_count")))


@query(f"WITH {P} SELECT tool_type AS value, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS ratio FROM p GROUP BY 1")
def tool_type_frequency(spark, sf_dir):
    return report.frequency(processed(spark, sf_dir), "tool_type")


@query("""WITH v AS (SELECT list(n_chars ORDER BY n_chars) AS v FROM documents WHERE n_chars IS NOT NULL)
SELECT CAST(len(v) AS BIGINT) AS n, v[1] AS min, """ + ", ".join(f"v[CAST(round_even({q}::DOUBLE / 100 * (len(v) - 1), 0) AS BIGINT) + 1] AS p{q}" for q in report.PERCENTS) + ", v[len(v)] AS max FROM v")
def length_stats(spark, sf_dir):
    return report.length_stats(read(spark, sf_dir, "documents"), "n_chars")


@query("""SELECT count(*) AS rows_before, count(*) FILTER (n_chars <= 1024) AS rows_after, count(*) - count(*) FILTER (n_chars <= 1024) AS removed,
(count(*) - count(*) FILTER (n_chars <= 1024))::DOUBLE / count(*) AS removed_ratio FROM documents""")
def length_filter_report(spark, sf_dir):
    return report.filter_report(read(spark, sf_dir, "documents"), F.col("n_chars") <= 1024)


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 1024")
def length_filter(spark, sf_dir):
    return pipelines.within(read(spark, sf_dir, "documents"), 1024, "n_chars").select("doc_id", "n_chars")


# ---- tools out of prompts ----


@query(f"""WITH {TOOL}, r AS (SELECT key, unnest(regexp_extract_all(system, '(?is)<tr>(.*?)</tr>', 1)) AS r FROM t), c AS (SELECT key, r, regexp_extract(r, '(?is)<td>(.*?)</td>', 1) AS name FROM r)
SELECT key, trim(regexp_replace(regexp_replace(r, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS tool FROM c WHERE trim(name) <> '' AND lower(trim(name)) <> 'tool_name'""")
def html_tools(spark, sf_dir):
    return tools(spark, sf_dir).select("key", F.explode(extract.html_tools(F.col("system"))).alias("tool"))


@query(f"WITH {TOOL} SELECT key, trim(split_part(regexp_extract(system, '(?s)<tool_name>.*'), chr(10) || 'Please use', 1)) AS tool FROM t WHERE contains(system, '<tool_name>')")
def xml_tools(spark, sf_dir):
    return tools(spark, sf_dir).select("key", F.explode(extract.xml_tools(F.col("system"))).alias("tool"))


@query(f"""WITH {TOOL}, r AS (SELECT key, unnest(string_split(system, chr(92) || chr(92))) AS r FROM t WHERE contains(system, 'tabular'))
SELECT key, trim(replace(r, chr(92) || 'hline', '')) AS tool FROM r WHERE contains(r, '&') AND NOT contains(r, 'tool_name')""")
def latex_tools(spark, sf_dir):
    return tools(spark, sf_dir).select("key", F.explode(extract.latex_tools(F.col("system"))).alias("tool"))


@query(f"WITH {TOOL} SELECT key, split_part(system, chr(10) || 'Should you', 1) AS tool FROM t WHERE contains(system, '**tool_name**')")
def tool_name_blocks(spark, sf_dir):
    return tools(spark, sf_dir).select("key", F.explode(extract.name_block_tools(F.col("system"))).alias("tool"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '**', ''), chr(92), ' '), '\\s+', ' ', 'g'), ' |') AS clean FROM pages""".replace("\\\\", "\\"))
def clean_markup(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.clean_markup(F.col("html")).alias("clean"))


@query(f"WITH {P} SELECT key, system, tools, tool_count, tool_type, key % 8 = 7 AS extract_failed FROM p".replace("system, tools", "trim(system) AS system, tools"))
def parse_system(spark, sf_dir):
    return extract.parse_system(tools(spark, sf_dir)).select("key", "system", "tools", "tool_count", "tool_type", "extract_failed")


#: Tools that hold their names under every field, padded, blank or as numbers.
NAMED = """SELECT p_partkey AS key, concat('[{"name": "  n', p_partkey, ' "}, {"tool_name": "t', p_partkey, '", "api_name": "x"}, {"name": "", "API_Name": "A', p_partkey, '"}, {"name": "   ", "function": {"name": " f', p_partkey, '"}}, {"function_name": "g"}, {"name": 5, "function": {"name": "h"}}, {"api_name": "", "function": {"name": "k"}}]') AS tools FROM part"""


def named_tools(spark, sf_dir):
    return A.run(spark, sf_dir, NAMED)


@query(f"WITH m AS ({NAMED}), n AS (SELECT key, unnest(['n' || key, 'f' || key, 'h', 'k']) AS name FROM m), {P} SELECT key, name FROM n UNION ALL SELECT key, unnest(CASE WHEN tool_type = 'json' THEN CAST(json_extract_string(tools, '$[*].name') AS VARCHAR[]) ELSE [] END) FROM p")
def tool_names(spark, sf_dir):
    rows = named_tools(spark, sf_dir).unionByName(processed(spark, sf_dir).select("key", "tools"))
    return rows.select("key", F.explode(extract.function_names("tools")).alias("name"))


@query(f"WITH m AS ({NAMED}), n AS (SELECT key, unnest(['  n' || key || ' ', 't' || key, 'A' || key, '   ', 'g', '5', 'k']) AS name FROM m), {P} SELECT key, name FROM n UNION ALL SELECT key, unnest(CASE WHEN tool_type = 'json' THEN CAST(json_extract_string(tools, '$[*].name') AS VARCHAR[]) ELSE [] END) FROM p")
def loose_tool_names(spark, sf_dir):
    rows = named_tools(spark, sf_dir).unionByName(processed(spark, sf_dir).select("key", "tools"))
    return rows.select("key", F.explode(extract.loose_names("tools")).alias("name"))


@query(f"WITH {P} SELECT key, array_to_string({NAMES}, ',') AS names FROM p")
def described_parameters(spark, sf_dir):
    return processed(spark, sf_dir).select("key", F.array_join(extract.described_names("tools"), ",").alias("names"))


@query(f"WITH {P} SELECT key, CASE key % 8 WHEN 0 THEN 'brand,depot,note,size' WHEN 1 THEN 'brand,note,size' ELSE '' END AS names FROM p")
def all_parameters(spark, sf_dir):
    return processed(spark, sf_dir).select("key", F.array_join(extract.all_names("tools"), ",").alias("names"))


@query(f"""WITH {P}, e AS (SELECT key, CASE key % 8 WHEN 0 THEN ['get_part_' || key || ':brand,note,size', 'get_stock_' || key || ':depot'] WHEN 1 THEN ['get_part_' || key || ':brand,note,size'] ELSE [] END AS x FROM p)
SELECT key, unnest(x) AS entry FROM e""")
def tool_parameter_index(spark, sf_dir):
    entry = F.explode(F.map_entries(extract.tool_parameters("tools"))).alias("e")
    return processed(spark, sf_dir).select("key", entry).select("key", F.concat("e.key", F.lit(":"), F.array_join("e.value", ",")).alias("entry"))


# ---- prompts and tokens ----


PRETTY = "array_to_string(list_transform(string_split(json_pretty(tools::JSON), chr(10)), lambda l: repeat(' ', ((length(l) - length(ltrim(l, ' '))) // 2)::BIGINT) || ltrim(l, ' ')), chr(10))"
RENDERED = f"""r AS (SELECT *, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || trim(system, ' ' || chr(10)) || chr(10) || chr(10) || {PRETTY}
|| '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || "user" || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || assistant || '<|eot_id|>' AS text FROM p)"""


@query(f"WITH {P}, {RENDERED} SELECT key, text FROM r")
def render_prompts(spark, sf_dir):
    return processed(spark, sf_dir).select("key", render_prompt(F.col("system"), F.col("user"), F.col("assistant"), F.col("tools")).alias("text"))


@query(f"WITH {P}, {RENDERED}, s AS (SELECT key, text, strpos(text, '[') - 1 AS a, strpos(text, '<|eot_id|>') - 1 AS b FROM r WHERE key % 8 < 2) SELECT key, CAST(a AS INT) AS first, CAST(b AS INT) AS past, len(CAST(json_extract(text[a + 1 : b], '$[*].name') AS JSON[])) AS tools FROM s")
def prompt_tool_spans(spark, sf_dir):
    found = T.arrow(lambda t: (lambda x: None if x is None else {"first": x[0], "past": x[1], "tools": len(x[2])})(J.prompt_tools(t or "")), "first int, past int, tools long")
    return render_prompts(spark, sf_dir).select("key", found("text").alias("s")).where("s is not null").select("key", "s.*")


# Python's classes of letters, digits and white space, in RE2's terms
PIECES = r"<\|[^|<>]+\|>|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{PIECES}')) AS INT) AS n_tokens FROM documents")
def token_lengths(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tokens.token_length(F.col("text")).alias("n_tokens"))


LABEL_IDS = "flatten(transform(sequence(1, p_size), x -> array(x % 7, 90, 91, x % 5 + 10, CASE WHEN x % 3 = 0 THEN 99 ELSE 98 END)))"


@query("""WITH a AS (SELECT p_partkey AS key, flatten(list_transform(range(1, p_size + 1), lambda x: [x % 7, 90, 91, x % 5 + 10, CASE WHEN x % 3 = 0 THEN 99 ELSE 98 END])) AS ids FROM part),
e AS (SELECT key, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM a),
s AS (SELECT key, id, i, last_value(CASE WHEN id = 99 THEN 0 WHEN prev = 91 AND prev2 = 90 THEN 1 END IGNORE NULLS) OVER (PARTITION BY key ORDER BY i) AS cur, last_value(CASE WHEN id = 99 THEN 0 WHEN prev = 91 AND prev2 = 90 THEN 1 END IGNORE NULLS) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
 FROM (SELECT *, lag(id) OVER w AS prev, lag(id, 2) OVER w AS prev2 FROM e WINDOW w AS (PARTITION BY key ORDER BY i)))
SELECT key, string_agg(CAST(CASE WHEN cur = 1 OR (id = 99 AND before = 1) THEN id ELSE -100 END AS VARCHAR), ',' ORDER BY i) AS labels FROM s GROUP BY key""")
def assistant_labels(spark, sf_dir):
    ids = A.parts(spark, sf_dir).select(F.col("p_partkey").alias("key"), F.expr(LABEL_IDS).alias("ids"))
    mask = F.transform("ids", lambda x: F.lit(1))
    return ids.select("key", F.concat_ws(",", tokens.answer_labels(F.col("ids"), mask, [90, 91], [99]).cast("array<string>")).alias("labels"))


@query("""SELECT p_partkey AS key, CAST(coalesce(list_position(list_transform(range(0, p_size * 5 - 1), lambda i: (flatten(list_transform(range(1, p_size + 1), lambda x: [x % 7, 90, 91, x % 5 + 10, CASE WHEN x % 3 = 0 THEN 99 ELSE 98 END])))[i + 1 : i + 2] = [14, 99]), true), 0) - 1 AS INT) AS place FROM part""")
def find_token_pattern(spark, sf_dir):
    ids = A.parts(spark, sf_dir).select(F.col("p_partkey").alias("key"), F.expr(LABEL_IDS).alias("ids"))
    return ids.select("key", tokens.find_pattern(F.col("ids"), [14, 99]).cast("int").alias("place"))


@query(f"""WITH {P}, {RENDERED}, n AS (SELECT len(regexp_extract_all(text, '{PIECES}')) AS n, len(regexp_extract_all(split_part(text, 'assistant<|end_header_id|>', 1) || 'assistant<|end_header_id|>', '{PIECES}')) AS m FROM r)
SELECT CAST(256 AS INT) AS length, CAST(least(n, 256) AS INT) AS used, CAST(greatest(least(n, 256) - m, 0) AS INT) AS labelled FROM n""")
def padded_tensors(spark, sf_dir):
    df = render_prompts(spark, sf_dir)
    pad = tokens.add_tensors(df, "text", length=256, pad=0, head=tokens.default_tokenizer(header("assistant")), end=tokens.default_tokenizer(EOT))
    return pad.select(F.size("input_ids").alias("length"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"), F.size(F.filter("labels", lambda x: x != tokens.IGNORE)).alias("labelled"))


@query(f"WITH {P} SELECT key, tools, tool_count FROM p")
def arrow_folder(spark, sf_dir):
    """The rows written as a folder of Arrow files and read back in splits, three columns of them."""
    path = io.scratch(spark, "arrow")
    write_arrow(processed(spark, sf_dir), path)
    return read_arrow(spark, path, ["key", "tools", "tool_count"], split_bytes=1 << 20)


# ---- refusals ----


@query(f"WITH {P} SELECT key, {CLASS} AS refusal_type FROM p WHERE refusal = 1")
def classify_refusals(spark, sf_dir):
    return processed(spark, sf_dir).where("refusal = 1").select("key", classify.refusal_class(F.col("assistant")).alias("refusal_type"))


@query(f"WITH {P} SELECT key, {FEASIBLE} AS feasibility FROM p WHERE refusal = 1 AND tool_count > 0")
def ablation_feasibility(spark, sf_dir):
    return pipelines.refusal_analysis(processed(spark, sf_dir)).select("key", "feasibility")


@query(f"""WITH {P}, r AS (SELECT {CLASS} AS refusal_type, tool_type, {BUCKET} AS tool_bucket, {FEASIBLE} AS feasibility FROM p WHERE refusal = 1 AND tool_count > 0)
SELECT 'refusal_type' AS "grouping", refusal_type AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'tool_type', tool_type, count(*) FROM r GROUP BY 2
UNION ALL SELECT 'tool_bucket', tool_bucket, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'feasibility', feasibility, count(*) FROM r GROUP BY 2""")
def refusal_report(spark, sf_dir):
    return report.grouped_counts(pipelines.refusal_analysis(processed(spark, sf_dir)), ["refusal_type", "tool_type", "tool_bucket", "feasibility"])


@query(f"""WITH {P}, r AS (SELECT key, unnest([{CLASS}, {FEASIBLE}]) AS label FROM p WHERE refusal = 1 AND tool_count > 0)
SELECT key, label, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key) AS rank FROM r) WHERE rank <= 3""")
def topk_examples(spark, sf_dir):
    rows = pipelines.refusal_analysis(processed(spark, sf_dir)).select("key", F.explode(F.array("refusal_type", "feasibility")).alias("label"))
    return sample.first_per_label(rows, "label", "key").select("key", "label", "rank")


@query(f"WITH {P} SELECT key, substr(\"user\", 1, 500) AS \"user\", substr(assistant, 1, 800) AS assistant, array_to_string({NAMES}, ',') AS names FROM p WHERE refusal = 1 AND tool_count > 0")
def short_examples(spark, sf_dir):
    return report.short_examples(pipelines.refusal_analysis(processed(spark, sf_dir))).withColumn("names", F.array_join("names", ","))


# ---- shuffles, splits, samples ----


@query(f"WITH {P} SELECT key, {ORDER.format(seed=42)} AS rank FROM p")
def seeded_shuffle(spark, sf_dir):
    return sample.global_rank(processed(spark, sf_dir), "key", 42).select("key", "rank")


@query(f"WITH {P} SELECT key, CASE WHEN {ORDER.format(seed=42)} <= ceil(count(*) OVER () * 0.05::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM p")
def train_eval_split(spark, sf_dir):
    return sample.train_test(processed(spark, sf_dir), "key").select("key", "split")


ELIGIBLE = f"e AS (SELECT * FROM p WHERE tool_type = 'json' AND tool_count >= 1 AND refusal = 0 AND len({NAMES}) > 0)"


@query(f"WITH {P}, {ELIGIBLE} SELECT key FROM e")
def parameter_eligible(spark, sf_dir):
    return perturb.parameter_eligible(processed(spark, sf_dir)).select("key")


@query(f"WITH {P}, {ELIGIBLE} SELECT key FROM e")
def mode_eligible(spark, sf_dir):
    return perturb.mode_eligible(processed(spark, sf_dir)).select("key")


@query(f"WITH {P} SELECT key FROM p WHERE tool_type = 'json' AND tool_count >= 1 AND refusal = 1 AND len({NAMES}) > 0")
def teacher_eligible(spark, sf_dir):
    return perturb.teacher_eligible(processed(spark, sf_dir)).select("key")


@query(f"WITH {P}, {ELIGIBLE} SELECT key FROM (SELECT key, {ORDER.format(seed=143)} AS r, count(*) OVER () AS n FROM e) WHERE r <= floor(n * 0.2::DOUBLE)")
def exact_sample(spark, sf_dir):
    return sample.take_fraction(perturb.parameter_eligible(processed(spark, sf_dir)), "key", 0.2, 143).select("key")


@query(f"""WITH {P}, {ELIGIBLE}, r AS (SELECT key, {ORDER.format(seed=2244)} AS r, count(*) OVER () AS n FROM e)
SELECT key, CASE WHEN r <= floor(n * 0.15::DOUBLE) THEN 'parameter_only' WHEN r <= floor(n * 0.15::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'function_only' WHEN r <= floor(n * 0.15::DOUBLE) + floor(n * 0.1::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'parameter_and_function' ELSE 'none' END AS mode FROM r""")
def mode_bands(spark, sf_dir):
    return sample.bands(perturb.mode_eligible(processed(spark, sf_dir)), "key", perturb.TRAIN_MODES, 2244, rest="none").select("key", "mode")


@query(f"""WITH {P}, e AS (SELECT * FROM p WHERE refusal = 1 AND tool_type = 'json' AND tool_count > 0), r AS (SELECT key, {ORDER.format(seed=7043)} AS r, count(*) OVER () AS n FROM e)
SELECT key, CASE WHEN r <= floor(n * 0.6::DOUBLE) THEN 'original_refusal' WHEN r <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'param_only' WHEN r <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'function_only' ELSE 'param_and_function' END AS mode FROM r""")
def teacher_mode_plan(spark, sf_dir):
    return sample.bands(perturb.teacher_eligible(processed(spark, sf_dir)), "key", perturb.TEACHER_MODES, 7043).select("key", "mode")


@query(f"WITH {P}, r AS (SELECT key, {ORDER.format(seed=42)} AS r, (SELECT count(*) FROM p) AS n FROM p WHERE key % 8 < 2) SELECT key FROM r WHERE r <= round_even(n * 0.2::DOUBLE, 0)")
def sample_rewritable(spark, sf_dir):
    df = processed(spark, sf_dir)
    return sample.sample_of_total(df.where("key % 8 < 2"), "key", df.count(), 0.2, 42).select("key")


# ---- renaming ----


@query(f"WITH {P} SELECT key, replace(replace(assistant, '(size=', '(param_0001='), ' brand=', ' param_0002=') AS renamed FROM p WHERE refusal = 0")
def rename_parameters(spark, sf_dir):
    names = F.create_map(F.lit("size"), F.lit("param_0001"), F.lit("brand"), F.lit("param_0002"))
    return processed(spark, sf_dir).where("refusal = 0").select("key", perturb.rename_with(F.col("assistant"), names).alias("renamed"))


@query(f"WITH {P} SELECT key, replace(assistant, 'get_part_' || key || '(', 'func_' || key || '(') AS renamed FROM p WHERE refusal = 0")
def rename_functions(spark, sf_dir):
    names = F.create_map(F.concat(F.lit("get_part_"), F.col("key").cast("string")), F.concat(F.lit("func_"), F.col("key").cast("string")))
    return processed(spark, sf_dir).where("refusal = 0").select("key", perturb.rename_with(F.col("assistant"), names, "functions").alias("renamed"))


QUOTED = "array_to_string(list_sort(regexp_extract_all(tools, '\"[^\"]*\"')), ' ')"


def quoted_texts(tools):
    """All quoted texts of a JSON text, names and values alike, in sorted order: what a schema says, whatever its order."""
    return F.array_sort(F.regexp_extract_all(tools, F.lit('"[^"]*"'), 0))


@query(f"""WITH {P}, {ELIGIBLE} SELECT key, {QUOTED} AS tools, assistant, array_to_string(list_sort({NAMES}), ',') AS names, CASE WHEN tool_count = 2 THEN 'get_part_' || key || ',get_stock_' || key ELSE 'get_part_' || key END AS calls, true AS fresh FROM e""")
def perturbed_rows(spark, sf_dir):
    """Renamed and reordered rows with their new names put back: what is left must be what was there."""
    rows = perturb.perturb(perturb.mode_eligible(processed(spark, sf_dir)).withColumn("mode", F.lit("parameter_and_function")), "key", 42)
    names, calls = (F.from_json(c, "map<string,string>") for c in ("parameter_mapping", "function_mapping"))
    back = lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))
    rows = rows.withColumns({"names": names, "calls": calls, "back": F.map_concat(back(names), back(calls))})
    bare = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)
    old = F.array_sort(F.transform(quoted_texts(F.col("tools")), lambda t: F.coalesce(F.concat(F.lit('"'), F.try_element_at("back", bare(t)), F.lit('"')), t)))
    answer = perturb.rename_with(perturb.rename_with(F.col("assistant"), back(F.col("calls")), "functions"), back(F.col("names")))
    fresh = F.forall(F.map_values("names"), lambda n: n.rlike("^param_[0-9]{4}$")) & F.forall(F.map_values("calls"), lambda n: n.rlike("^func_[0-9]{4}$")) & (F.size("back") == F.size("names") + F.size("calls")) & (F.col("assistant") != answer)
    keys = lambda c: F.array_join(F.array_sort(F.map_keys(c)), ",")
    return rows.select("key", F.array_join(old, " ").alias("tools"), answer.alias("assistant"), keys("names").alias("names"), keys("calls").alias("calls"), fresh.alias("fresh"))


def _shuffled(spark, sf_dir, forced: bool) -> DataFrame:
    shuffled = F.udf(lambda t, s: J.dump([J.permuted(x, s, forced=forced, path=(i,)) for i, x in enumerate(J.load_tools(t))]), "string", useArrow=True)
    return processed(spark, sf_dir).where("tool_type = 'json' and tool_count > 0").withColumn("s", shuffled("tools", perturb.row_seed(F.col("key"), 42)))


@query(f"WITH {P} SELECT key, {QUOTED} AS texts, CAST(json_extract_string(tools, '$[*].name') AS VARCHAR[])[1] AS first_tool, true AS changed FROM p WHERE tool_type = 'json' AND tool_count > 0")
def forced_schema_shuffle(spark, sf_dir):
    df = _shuffled(spark, sf_dir, True)
    return df.select("key", F.array_join(quoted_texts(F.col("s")), " ").alias("texts"), F.get_json_object("s", "$[0].name").alias("first_tool"), (F.col("tools") != F.col("s")).alias("changed"))


@query(f"WITH {P} SELECT key, {QUOTED} AS texts, CAST(json_extract_string(tools, '$[*].name') AS VARCHAR[])[1] AS first_tool, 'Size in mm' AS size_is FROM p WHERE tool_type = 'json' AND tool_count > 0")
def schema_shuffle(spark, sf_dir):
    df = _shuffled(spark, sf_dir, False)
    return df.select("key", F.array_join(quoted_texts(F.col("s")), " ").alias("texts"), F.get_json_object("s", "$[0].name").alias("first_tool"), F.get_json_object("s", "$[0].parameters.properties.size.description").alias("size_is"))


@query(f"""WITH {P}, {RENDERED}, e AS (SELECT key, {ORDER.format(seed=42)} AS r FROM p WHERE tool_type = 'json' AND tool_count > 0),
x AS (SELECT r.key, e.r IS NOT NULL AND e.r <= round_even((SELECT count(*) FROM p) * 0.2::DOUBLE, 0) AS changed, array_to_string(list_sort(regexp_extract_all(text, '"[^"]*"')), ' ') AS texts, strpos(text, '[') AS opens, length(text) AS n FROM r LEFT JOIN e USING (key))
SELECT key, changed, texts, opens, n FROM x""")
def shuffled_prompts(spark, sf_dir):
    done = pipelines.shuffled_prompts(render_prompts(spark, sf_dir), "key")
    spaces = F.when(F.col("changed"), F.col("n")).otherwise(F.length("text"))
    lengths = render_prompts(spark, sf_dir).select("key", F.length("text").alias("n"))
    return done.join(lengths.hint("merge"), "key").select("key", "changed", F.array_join(quoted_texts(F.col("text")), " ").alias("texts"), F.instr("text", "[").cast("long").alias("opens"), spaces.cast("long").alias("n"))


# ---- unions and pipelines ----


def annotated(spark, sf_dir) -> DataFrame:
    rows = processed(spark, sf_dir).where("refusal = 1 and tool_count > 0 and tool_type = 'json'")
    described = F.when(F.col("key") % 4 == 0, F.concat(F.lit(" Done "), F.col("key").cast("string"), F.lit(" "))).otherwise(F.lit(" "))
    held = F.when(F.col("key") % 4 == 1, F.concat(F.lit('{"description": "Json '), F.col("key").cast("string"), F.lit('"}'))).otherwise(F.lit("{}"))
    answer = F.when(F.col("key") % 16 == 2, F.lit('{"description": "In answer"}')).when(F.col("key") % 16 == 10, F.lit('{"other": 1}')).otherwise(F.col("assistant"))
    return rows.withColumns({"teacher_description": described, "teacher_json": held, "assistant": answer})


DESCRIBED = "CASE key % 4 WHEN 0 THEN 'Done ' || key WHEN 1 THEN 'Json ' || key ELSE CASE key % 16 WHEN 2 THEN 'In answer' WHEN 10 THEN '' ELSE assistant END END"


@query(f"WITH {P} SELECT key, {DESCRIBED} AS description FROM p WHERE refusal = 1 AND tool_count > 0 AND tool_type = 'json'")
def teacher_descriptions(spark, sf_dir):
    df = annotated(spark, sf_dir)
    return df.select("key", teacher.description_of(df).alias("description"))


UNION = f"""g AS (SELECT key, assistant, 0 AS refusal, 'none' AS ablation_mode, 'non_refusal' AS source_dataset FROM p WHERE refusal = 0 AND tool_type = 'json'
UNION ALL SELECT key, {DESCRIBED}, 1, 'teacher_refusal_description', 'teacher_refusal_description' FROM p WHERE refusal = 1 AND tool_count > 0 AND tool_type = 'json' AND {DESCRIBED} <> ''
UNION ALL SELECT key, assistant, 1, 'toolace_zero_tool_refusal', 'toolace_zero_tool_refusal' FROM p WHERE refusal = 1 AND tool_count = 0)"""


@query(f"WITH {P}, {UNION} SELECT key, assistant, refusal, ablation_mode, source_dataset FROM g")
def ablation_union(spark, sf_dir):
    return pipelines.refusal_union(processed(spark, sf_dir), annotated(spark, sf_dir)).select("key", "assistant", "refusal", "ablation_mode", "source_dataset")


@query(f"WITH {P}, {UNION} SELECT source_dataset AS value, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS ratio FROM g GROUP BY 1")
def ablation_report(spark, sf_dir):
    return report.frequency(ablation_union(spark, sf_dir), "source_dataset")


@query(f"""WITH {P}, s AS (SELECT *, CASE WHEN {ORDER.format(seed=42)} <= ceil(count(*) OVER () * 0.05::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM p),
n AS (SELECT split, count(*) AS rows, floor(count(*) FILTER (tool_type = 'json' AND tool_count >= 1 AND refusal = 0) * CASE split WHEN 'train' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END)::BIGINT AS applied FROM s GROUP BY 1) SELECT * FROM n""")
def parameter_ablation(spark, sf_dir):
    done = pipelines.perturbed_parameters(processed(spark, sf_dir), "key")
    return done.groupBy("split").agg(F.count("*").alias("rows"), F.count_if("ablation_applied").alias("applied"))


@query(f"""WITH {P}, {UNION}, s AS (SELECT *, CASE WHEN {ORDER.format(seed=42)} <= ceil(count(*) OVER () * 0.05::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM g),
e AS (SELECT key, s.split, row_number() OVER (PARTITION BY s.split ORDER BY md5(CASE s.split WHEN 'train' THEN '46:' ELSE '47:' END || cast(key AS VARCHAR)), key) AS r, count(*) OVER (PARTITION BY s.split) AS n FROM s JOIN p USING (key) WHERE p.refusal = 0 AND tool_type = 'json' AND tool_count >= 1 AND len({NAMES}) > 0),
m AS (SELECT key, CASE WHEN split = 'test' THEN CASE WHEN r <= floor(n * 0.5::DOUBLE) THEN 'parameter_and_function' END WHEN r <= floor(n * 0.15::DOUBLE) THEN 'parameter_only' WHEN r <= floor(n * 0.15::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'function_only'
  WHEN r <= floor(n * 0.15::DOUBLE) + floor(n * 0.1::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'parameter_and_function' END AS mode FROM e)
SELECT split, coalesce(mode, ablation_mode) AS ablation_mode, count(*) AS rows, count(*) FILTER (mode IS NOT NULL) AS applied FROM s LEFT JOIN m USING (key) GROUP BY 1, 2""")
def mode_ablation(spark, sf_dir):
    union = pipelines.refusal_union(processed(spark, sf_dir), annotated(spark, sf_dir))
    return pipelines.perturbed_modes(union, "key").groupBy("split", "ablation_mode").agg(F.count("*").alias("rows"), F.count_if("applied").alias("applied"))


@query(f"""WITH {TURNS}, s AS (SELECT conv_id, trim(text) AS system FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'system') WHERE r = 1)
SELECT conv_id, coalesce(system, '') AS system, user_text AS "user", assistant_text AS assistant, '[]' AS tools, 'non_json' AS tool_type, CAST(0 AS INT) AS tool_count, CAST(CASE WHEN {CALL.replace('assistant', 'assistant_text')} THEN 0 ELSE 1 END AS INT) AS refusal FROM f LEFT JOIN s USING (conv_id)""")
def structured_conversations(spark, sf_dir):
    done = pipelines.structure(gather_turns(read(spark, sf_dir, "conversations")))
    return done.select("conv_id", "system", "user", "assistant", "tools", "tool_type", "tool_count", "refusal")


# ---- annotations ----


def annotations(spark, sf_dir) -> DataFrame:
    df = A.run(spark, sf_dir, A.A_TEACHER)
    success = F.array(F.struct("request", "tool", "call"))
    failed = F.array(F.struct(F.col("request"), F.col("tool"), F.col("reason"), F.array("missing").alias("missing_parameters"), F.create_map(F.lit("size"), F.lit("1")).alias("provided_arguments"), F.col("description")))
    return df.select("source_index", "ablation_mode", success.alias("teacher_success"), failed.alias("teacher_failed"), F.col("description").alias("teacher_description"), F.array("tool").alias("tool_names"), F.array(F.lit("old_size"), F.lit("zzz")).alias("old_names"))


TEACHER = f"a AS ({A.A_TEACHER})"
FIXED = "CASE source_index % 6 WHEN 0 THEN '[' || call || ']' WHEN 1 THEN '[' || tool || '(size=1)]' ELSE call END"


@query(f"WITH {TEACHER} SELECT source_index, {FIXED} AS call FROM a")
def teacher_normalize_calls(spark, sf_dir):
    df = annotations(spark, sf_dir)
    return df.select("source_index", teacher.normalized(F.col("teacher_success"), F.col("tool_names"))[0]["call"].alias("call"))


CODES = f"""list_filter([CASE WHEN description = '' THEN 'description_missing' END, CASE WHEN request = '' THEN 'success_0_request_missing' END,
  CASE source_index % 6 WHEN 4 THEN 'success_0_call_missing' WHEN 2 THEN 'success_0_call_not_bfcl_list' WHEN 3 THEN 'success_0_old_parameter_name_left:old_size' END,
  CASE WHEN request = '' THEN 'failed_0_request_missing' END, CASE WHEN reason = 'other' THEN 'failed_0_invalid_reason:other' END, CASE WHEN description = '' THEN 'failed_0_description_missing' END,
  CASE WHEN reason = 'no_suitable_tool' THEN 'failed_0_no_suitable_tool_requires_null_tool' END, CASE WHEN reason = 'no_suitable_tool' THEN 'failed_0_no_suitable_tool_requires_empty_missing' END, CASE WHEN reason = 'no_suitable_tool' THEN 'failed_0_no_suitable_tool_requires_empty_provided' END,
  CASE WHEN reason = 'miss_param' AND missing = 'old_size' THEN 'failed_0_old_missing_name:old_size' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {TEACHER} SELECT source_index, array_to_string({CODES}, ';') AS codes, CASE WHEN len({CODES}) > 0 THEN 'invalid_schema' ELSE 'valid' END AS status FROM a")
def teacher_validate(spark, sf_dir):
    return teacher.check_annotations(annotations(spark, sf_dir)).select("source_index", F.array_join("validation_errors", ";").alias("codes"), "status")


@query(f"WITH {TEACHER}, s AS (SELECT CASE WHEN len({CODES}) > 0 THEN 'invalid_schema' ELSE 'valid' END AS status FROM a) SELECT status, count(*) AS n, count(*) AS success_items, count(*) AS failed_items FROM s GROUP BY 1")
def teacher_status_counts(spark, sf_dir):
    checked = teacher.check_annotations(annotations(spark, sf_dir))
    return checked.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("teacher_success")).cast("long").alias("success_items"), F.sum(F.size("teacher_failed")).cast("long").alias("failed_items"))


@query(f"WITH {TEACHER} SELECT source_index FROM a WHERE source_index % 3 <> 1")
def resume_pending(spark, sf_dir):
    planned = annotations(spark, sf_dir)
    return teacher.pending(planned, planned.where("source_index % 3 = 1")).select("source_index")


@query(f"WITH {TEACHER} SELECT source_index, CASE WHEN source_index % 3 = 0 THEN 'stale' ELSE 'kept' END AS state FROM a")
def resume_canonical(spark, sf_dir):
    planned = annotations(spark, sf_dir)
    stored = planned.withColumn("ablation_mode", F.lit("function_only"))
    kept, stale = teacher.canonical(stored, planned)
    return kept.select("source_index", F.lit("kept").alias("state")).unionByName(stale.select("source_index", F.lit("stale").alias("state")))


@query(f"WITH {TEACHER}, s AS (SELECT source_index, source_index % 3 = 0 AS was_valid, CASE WHEN source_index % 2 = 1 THEN CASE WHEN source_index % 3 = 0 THEN 'valid' ELSE 'invalid_schema' END WHEN len({CODES}) > 0 THEN 'invalid_schema' ELSE 'valid' END AS status, CASE WHEN source_index % 2 = 1 THEN 'stored' ELSE {FIXED} END AS call FROM a)"
       " SELECT source_index, status, call, NOT was_valid AND status = 'valid' AS came_over, CASE WHEN was_valid OR status = 'valid' THEN 'valid' ELSE 'invalid' END AS bucket FROM s")
def resume_repair(spark, sf_dir):
    """Stored results taken up again; every second one holds its annotation, the others stay as they were stored."""
    held = F.struct(F.col("teacher_success").alias("success"), F.col("teacher_failed").alias("failed"), F.col("teacher_description").alias("description"))
    stored = F.transform("teacher_success", lambda x: x.withField("call", F.lit("stored")))
    was = F.when(F.col("source_index") % 3 == 0, "valid").otherwise("invalid_schema")
    rows = annotations(spark, sf_dir).withColumns({"teacher_json": F.when(F.col("source_index") % 2 == 0, held), "teacher_success": stored, "validation_errors": F.expr("cast(array() as array<string>)"), "status": was})
    done = teacher.repaired(rows.where("status = 'valid'"), rows.where("status <> 'valid'"))
    return done.select("source_index", "status", F.col("teacher_success")[0]["call"].alias("call"), "came_over", "bucket")


def stand_in(bad: int):
    """A client that calls the first tool it is shown, or answers nothing of use where the request's length is a multiple of `bad`."""

    def make():
        def reply(messages: list[dict]) -> str:
            asked = json.loads(messages[1]["content"])
            tool = J.function_names(asked["tools"])[0]
            return "I can't." if len(asked["user_request"]) % bad == 0 else J.dump({"success": [{"request": asked["user_request"], "tool": tool, "call": f"[{tool}()]"}], "failed": [], "description": "Done."})

        return reply

    return make


MODE = "CASE WHEN r <= floor(n * 0.6::DOUBLE) THEN 'original_refusal' WHEN r <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'param_only' WHEN r <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'function_only' ELSE 'param_and_function' END"


@query(f"""WITH {P}, e AS (SELECT key, length("user") AS asks FROM p WHERE refusal = 1 AND tool_type = 'json' AND tool_count > 0),
one AS (SELECT key, {MODE} AS mode, asks % 4 <> 0 AS good FROM (SELECT *, {ORDER.format(seed=49)} AS r, count(*) OVER () AS n FROM e WHERE key % 3 <> 0)),
two AS (SELECT key, asks, {MODE} AS mode FROM (SELECT *, {ORDER.format(seed=49)} AS r, count(*) OVER () AS n FROM e))
SELECT two.key AS source_index, two.mode AS ablation_mode, NOT coalesce(one.good AND one.mode = two.mode, false) AS asked_again,
  CASE WHEN coalesce(one.good AND one.mode = two.mode, false) OR asks % 8 <> 0 THEN 'valid' ELSE 'failed_parse_or_request' END AS status FROM two LEFT JOIN one ON one.key = two.key""")
def resumed_annotations(spark, sf_dir):
    """A run over two thirds of the refusals, then one over all of them, whose plan gives many another mode: what is valid under its planned mode stays, the rest is asked for."""
    rows, folder = processed(spark, sf_dir), io.scratch(spark, "resumed")
    pipelines.annotate_in_parts(pipelines.annotation_plan(rows.where("key % 3 <> 0")), stand_in(4), folder, every=1000)
    plan = pipelines.annotation_plan(rows)
    ledger = Ledger(spark, folder, key="int" if dict(plan.dtypes)["source_index"] == "int" else "bigint")
    before = ledger.parts()
    pipelines.annotate_in_parts(plan, stand_in(8), folder, every=1000, retry=pipelines.RETRIED)
    kept = ledger.of_plan(plan, pipelines.record_schema(plan))
    return kept.select("source_index", "ablation_mode", (F.col("part") > F.lit(before[-1])).alias("asked_again") if before else F.lit(True).alias("asked_again"), "status")


@query("""WITH r AS (SELECT p_partkey AS source_index, k, (p_partkey + k) % 3 = 0 AS good FROM part, (VALUES (0), (1), (2)) t(k) WHERE (p_partkey + k) % 4 <> 0)
SELECT source_index, CASE WHEN bool_or(good) THEN 'valid' ELSE 'invalid_schema' END AS status, CAST(coalesce(min(CASE WHEN good THEN k END), -1) AS INT) AS good_from FROM r GROUP BY 1""")
def streamed_annotations(spark, sf_dir):
    """Records that come in three waves, repeated and of changing quality, as a stream into a ledger: each key's best one stays."""
    at, rows = io.scratch(spark, "streamed"), annotations(spark, sf_dir)
    good = lambda k: (F.col("source_index") + k) % 3 == 0
    fields = {"teacher_description": "Done.", "failed": "cast(array() as %s)" % teacher.FAILED, "old": "cast(array() as array<string>)"}
    for k in range(3):
        call = F.when(good(k), F.concat(F.lit("["), F.col("tool_names")[0], F.lit("()]"))).otherwise("no call")
        success = F.array(F.struct(F.lit("Find it").alias("request"), F.col("tool_names")[0].alias("tool"), call.alias("call")))
        wave = rows.where((F.col("source_index") + k) % 4 != 0).select("source_index", F.lit("none").alias("ablation_mode"), success.alias("teacher_success"), F.expr(fields["failed"]).alias("teacher_failed"), F.lit(fields["teacher_description"]).alias("teacher_description"), "tool_names", F.expr(fields["old"]).alias("old_names"), F.lit(k).alias("wave"), F.expr(f"timestamp'2024-01-01 00:00:00' + interval {k} hours").alias("asked_at"))
        wave.write.mode("append").json(f"{at}/in")
        schema = ", ".join(f"{n} {t}" for n, t in wave.dtypes)
        stream_to_ledger(spark, f"{at}/in", schema, f"{at}/out", f"{at}/checkpoint", time="asked_at", partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    kept = Ledger(spark, f"{at}/out", key=dict(wave.dtypes)["source_index"]).records(f"{schema}, status string")
    return kept.select("source_index", "status", F.when(F.col("status") == "valid", F.col("wave")).otherwise(-1).cast("int").alias("good_from"))


@query(f"WITH {P} SELECT key, assistant, tools FROM p ORDER BY key LIMIT 5")
def preview_rows(spark, sf_dir):
    return io.preview(processed(spark, sf_dir), "key", "structured").select("key", "assistant", "tools")


@query(f"WITH {P} SELECT key, CASE WHEN key % 3 < 2 THEN 'Json ' || key END AS description, key % 3 = 2 AS failed, CASE WHEN key % 3 = 2 THEN 'failed_parse_or_request' ELSE 'unchecked' END AS status FROM p")
def lenient_replies(spark, sf_dir):
    body = F.concat(F.lit('{"description": "Json '), F.col("key").cast("string"), F.lit('"}'))
    reply = F.when(F.col("key") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("key") % 3 == 1, F.concat(F.lit("Here: "), body, F.lit(" ok."))).otherwise("nothing")
    asked = processed(spark, sf_dir).select(F.col("key").alias("source_index"), F.array(F.struct(F.lit("user").alias("role"), reply.alias("content"))).alias("teacher_prompt"))
    return teacher.annotate(asked, lambda: lambda messages: messages[0]["content"]).select(F.col("source_index").alias("key"), "description", F.col("error").isNotNull().alias("failed"), F.when(F.col("error").isNotNull(), "failed_parse_or_request").otherwise("unchecked").alias("status"))


@query(f"WITH {TEACHER} SELECT source_index, contains(call, tool || '(') AS known, CASE WHEN contains(call, 'old_size=') THEN 'old_size' END AS old_name FROM a")
def call_checks(spark, sf_dir):
    df = A.run(spark, sf_dir, A.A_TEACHER)
    return df.select("source_index", classify.calls_any(F.col("call"), F.array("tool")).alias("known"), classify.first_old_name(F.col("call"), F.array(F.lit("zzz"), F.lit("old_size"))).alias("old_name"))


@query(f"""WITH {P} SELECT key AS source_index, 'dry_run' AS status, CAST(0 AS INT) AS success_items, CAST(2 AS INT) AS messages, p."user" AS asks, length(tools) > 2 AS asks_about_tools, CAST(NULL AS VARCHAR) AS shows_answer FROM p WHERE refusal = 1 AND tool_count > 0 AND tool_type = 'json'""")
def dry_run_plan(spark, sf_dir):
    df = teacher.dry_run(pipelines.annotation_plan(processed(spark, sf_dir)))
    question = F.get_json_object(df["teacher_prompt"][1]["content"], "$.tools")
    return df.select("source_index", "status", F.size("teacher_success").alias("success_items"), F.size("teacher_prompt").alias("messages"), F.get_json_object(df["teacher_prompt"][1]["content"], "$.user_request").alias("asks"), (F.json_array_length(question) > 0).alias("asks_about_tools"), F.get_json_object(df["teacher_prompt"][1]["content"], "$.assistant").alias("shows_answer"))


@query(f"WITH {P} SELECT key, tool_count, {ORDER.format(seed=1)} AS rank FROM p WHERE key % 8 = 7")
def extraction_failures(spark, sf_dir):
    rows = extract.parse_system(tools(spark, sf_dir)).where("extract_failed")
    return sample.global_rank(rows, "key", 1).select("key", "tool_count", "rank")


from . import more_queries  # noqa: E402, F401  registers its own
