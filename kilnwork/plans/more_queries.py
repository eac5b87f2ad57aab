"""More registered queries: what tables hold after they were written, and contents where others count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql as tables
from ..operators import extract, perturb, report, sample, teacher, tokens
from ..operators.prompt import EOT, header
from ..sources import io
from . import pipelines
from .queries import CODES, ELIGIBLE, MODE, NAMES, ORDER, P, PIECES, QUOTED, RENDERED, TEACHER, TOOL, UNION, annotated, annotations, processed, query, quoted_texts, render_prompts
from .queries import tools as prompts

# ---- tables that were written ----


@query(f"WITH {P} SELECT key, tools, tool_count FROM p WHERE key % 2 = 0")
def saved_over_itself(spark, sf_dir):
    """A table saved, read, filtered and saved over itself."""
    path = io.scratch(spark, "saved")
    io.save_dataset(processed(spark, sf_dir), f"{path}/train")
    io.save_dataset(io.read_dataset(spark, path).where("key % 2 = 0"), f"{path}/train")
    return io.read_dataset(spark, path).select("key", "tools", "tool_count")


@query(f"WITH {P} SELECT key, system, \"user\", assistant, refusal FROM p")
def jsonl_round_trip(spark, sf_dir):
    df, path = processed(spark, sf_dir).select("key", "system", "user", "assistant", "refusal"), io.scratch(spark, "jsonl")
    io.save_dataset(df, path, form="json")
    return io.read_jsonl(spark, path, ", ".join(f"{n} {t}" for n, t in df.dtypes))


@query(f"""WITH {TEACHER}, s AS (SELECT source_index, len({CODES}) > 0 AS bad FROM a)
SELECT source_index, CASE WHEN source_index % 5 = 0 THEN 'failed_parse_or_request' WHEN bad THEN 'invalid_schema' ELSE 'valid' END AS status, source_index % 5 <> 0 AND NOT bad AS success_case FROM s""")
def bucket_round_trip(spark, sf_dir):
    """Validated annotations in their buckets, read back, with those that count as successes."""
    path = io.scratch(spark, "buckets")
    checked = teacher.check_annotations(annotations(spark, sf_dir))
    io.write_buckets(checked.withColumn("status", F.when(F.col("source_index") % 5 == 0, "failed_parse_or_request").otherwise(F.col("status"))), path)
    schema = f"source_index {dict(checked.dtypes)['source_index']}, teacher_success {teacher.SUCCESS}"
    good = io.success_cases(spark, path, schema).select(F.col("source_index").alias("s_"), F.lit(True).alias("ok"))
    all_ = io.read_buckets(spark, path, schema)
    return all_.join(good.hint("merge"), F.col("source_index") == F.col("s_"), "left").select("source_index", "status", F.coalesce("ok", F.lit(False)).alias("success_case"))


@query(f"""WITH {P}, {RENDERED} SELECT p.system, p."user", p.assistant, p.tools, p.tool_type, CAST(p.tool_count AS BIGINT) AS tool_count, CAST(p.refusal AS BIGINT) AS refusal, len(regexp_extract_all(r.text, '{PIECES}')) AS prompt_token_length FROM p JOIN r USING (key)""")
def readable_export(spark, sf_dir):
    path = io.scratch(spark, "readable")
    texts = render_prompts(spark, sf_dir).select(F.col("key").alias("k_"), tokens.token_length(F.col("text")).alias("prompt_token_length"))
    io.save_readable(processed(spark, sf_dir).join(texts.hint("merge"), F.col("key") == F.col("k_")), path)
    return spark.read.json(path)


@query(f"WITH {P} SELECT 'all' AS name, count(*) AS rows, count(*) FILTER (refusal = 1) AS flagged FROM p UNION ALL SELECT 'json', count(*), count(*) FILTER (tool_count > 1) FROM p WHERE tool_type = 'json'")
def counted_writes(spark, sf_dir):
    """Rows that writes counted themselves."""
    df, path = processed(spark, sf_dir), io.scratch(spark, "counted")
    frames = {"all": df, "json": df.where("tool_type = 'json'")}
    got = report.write_all(frames, {n: f"{path}/{n}" for n in frames}, lambda d, at: io.save_dataset(d, at), {"all": "refusal = 1", "json": "tool_count > 1"})
    return spark.createDataFrame([(n, got[n]["rows"], got[n]["flagged"]) for n in frames], "name string, rows long, flagged long")


# ---- reports ----


@query(f"""WITH {P}, d AS (SELECT *, length(assistant) AS v, key % 8 = 7 AS failed FROM p), k AS (SELECT * FROM d WHERE v <= 40), l AS (SELECT list(v ORDER BY v) AS v FROM k),
q AS (SELECT v, len(v) AS n FROM l), m AS (SELECT unnest([('min', v[1]), """ + ", ".join(f"('p{q}', v[CAST(round_even({q}::DOUBLE / 100 * (n - 1), 0) AS BIGINT) + 1])" for q in report.PERCENTS) + """, ('max', v[n])]) AS x FROM q WHERE n > 0), y AS (SELECT x[1] AS name, x[2] AS v FROM m)
SELECT 'extract_failed' AS "grouping", CAST(failed AS VARCHAR) AS value, count(*) AS n, '' AS shows FROM d GROUP BY 2 UNION ALL SELECT 'refusal', CAST(refusal AS VARCHAR), count(*), '' FROM k GROUP BY 2 UNION ALL SELECT 'tool_type', tool_type, count(*), '' FROM k GROUP BY 2
UNION ALL SELECT 'tool_bucket', CASE WHEN tool_count <= 0 THEN 'zero_tool' WHEN tool_count = 1 THEN 'single_tool' ELSE 'multiple_tool' END, count(*), '' FROM k GROUP BY 2
UNION ALL SELECT 'length', CAST(v AS VARCHAR), (SELECT count(*) FROM k WHERE k.v = y.v), string_agg(name, ',' ORDER BY name) FROM y GROUP BY v""")
def dataset_report(spark, sf_dir):
    """Everything a report shows of a table before and after its length filter, in one pass."""
    df = processed(spark, sf_dir).withColumns({"length": F.length("assistant"), "extract_failed": F.col("key") % 8 == 7})
    rows = report.report_rows(df, pipelines.within(df, 40, "length"), "length")
    return rows.select("grouping", "value", "n", F.array_join(F.array_sort(F.coalesce("shows", F.expr("cast(array() as array<string>)"))), ",").alias("shows"))


# ---- contents ----

CRC = """bits(i, v, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"""


@query(f"""WITH RECURSIVE {CRC}, {P}, {RENDERED}, x AS (SELECT key, regexp_extract_all(text, '{PIECES}') AS w FROM r), d AS (SELECT DISTINCT unnest(w) AS piece FROM x),
c AS (SELECT piece, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(piece, ''), lambda s: ascii(s)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 1048576 + 1 AS id FROM d, crc),
u AS (SELECT key, w, unnest(w[1:256]) AS piece, unnest(range(1, least(len(w), 256) + 1)) AS j FROM x),
h AS (SELECT key, len(w) AS n, list_position(list_transform(range(1, len(w) - 1), lambda i: w[i] = '<|start_header_id|>' AND w[i + 1] = 'assistant'), true) + 2 AS a FROM x),
i AS (SELECT u.key, list(c.id ORDER BY j) AS ids, min(h.n) AS n, min(h.a) AS a FROM u JOIN c USING (piece) JOIN h USING (key) GROUP BY 1)
SELECT key, array_to_string(list_transform(range(1, 257), lambda j: coalesce(ids[j], 0)), ',') AS ids, CAST(least(n, 256) AS BIGINT) AS used, array_to_string(list_transform(range(1, 257), lambda j: CASE WHEN j > a AND j <= n THEN coalesce(ids[j], 0) ELSE -100 END), ',') AS labels FROM i""")
def tensor_contents(spark, sf_dir):
    """Padded ids, the mask's length and labels of every prompt, by key."""
    df = render_prompts(spark, sf_dir)
    pad = tokens.add_tensors(df, "text", length=256, pad=0, head=tokens.default_tokenizer(header("assistant")), end=tokens.default_tokenizer(EOT), keep=("key",))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    used = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    ones = F.array_size(F.array_remove("attention_mask", 0))  # a sum inside a lambda would be taken again for every place
    whole = F.col("attention_mask") == F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), 256 - ones))
    return pad.select("key", joined("input_ids").alias("ids"), F.when(whole, used).alias("used"), joined("labels").alias("labels"))


@query(f"""WITH {P}, {RENDERED}, s AS (SELECT *, CASE WHEN {ORDER.format(seed=42)} <= ceil(count(*) OVER () * 0.05::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM p),
e AS (SELECT key, split, row_number() OVER (PARTITION BY split ORDER BY md5('43:' || cast(key AS VARCHAR)), key) AS r, count(*) OVER (PARTITION BY split) AS n FROM s WHERE tool_type = 'json' AND tool_count >= 1 AND refusal = 0),
c AS (SELECT key FROM e WHERE r <= floor(n * CASE split WHEN 'train' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END))
SELECT s.key, s.split, r.text FROM s JOIN r USING (key) WHERE s.key NOT IN (SELECT key FROM c)""")
def texts_left_alone(spark, sf_dir):
    """The prompt texts of rows that the parameter perturbation does not touch, with their split."""
    return pipelines.perturbed_parameters(processed(spark, sf_dir), "key").where("not ablation_applied").select("key", "split", "text")


PLAN = f"""s AS (SELECT *, CASE WHEN {ORDER.format(seed=42)} <= ceil(count(*) OVER () * 0.05::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM g),
e AS (SELECT key, s.split, row_number() OVER (PARTITION BY s.split ORDER BY md5(CASE s.split WHEN 'train' THEN '46:' ELSE '47:' END || cast(key AS VARCHAR)), key) AS r, count(*) OVER (PARTITION BY s.split) AS n FROM s JOIN p USING (key) WHERE p.refusal = 0 AND tool_type = 'json' AND tool_count >= 1 AND len({NAMES}) > 0),
m AS (SELECT key, CASE WHEN split = 'test' THEN CASE WHEN r <= floor(n * 0.5::DOUBLE) THEN 'parameter_and_function' END WHEN r <= floor(n * 0.15::DOUBLE) THEN 'parameter_only' WHEN r <= floor(n * 0.15::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'function_only'
  WHEN r <= floor(n * 0.15::DOUBLE) + floor(n * 0.1::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'parameter_and_function' END AS mode FROM e)"""


@query(f"WITH {P}, {UNION}, {PLAN} SELECT key, split, coalesce(mode, ablation_mode) AS ablation_mode, mode IS NOT NULL AS applied FROM s LEFT JOIN m USING (key)")
def mode_plan(spark, sf_dir):
    """Split, mode and whether it was applied, of every row."""
    union = pipelines.refusal_union(processed(spark, sf_dir), annotated(spark, sf_dir))
    return pipelines.perturbed_modes(union, "key").select("key", "split", "ablation_mode", "applied")


@query(f"WITH {P}, {UNION}, {PLAN} SELECT key, coalesce(mode, ablation_mode) AS ablation_mode FROM s LEFT JOIN m USING (key) WHERE coalesce(mode, ablation_mode) <> 'none' ORDER BY key LIMIT 8")
def preview_modes(spark, sf_dir):
    return io.preview(mode_plan(spark, sf_dir), "key", "modes").select("key", "ablation_mode")


def put_back(rows: DataFrame) -> DataFrame:
    """`back`: new names to old ones, of parameters and functions."""
    names, calls = (F.from_json(c, "map<string,string>") for c in ("parameter_mapping", "function_mapping"))
    back = lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))
    return rows.withColumn("back", F.map_concat(back(names), back(calls)))


def old_name(c) -> F.Column:
    return F.coalesce(F.try_element_at("back", c), c)


SCHEMA = "array<struct<name:string,parameters:struct<properties:map<string,string>,required:array<string>>>>"


@query(f"""WITH {P}, {ELIGIBLE}, t AS (SELECT key, tool_count, unnest(range(tool_count)) AS i FROM e)
SELECT key, CASE i WHEN 0 THEN 'get_part_' || key ELSE 'get_stock_' || key END AS tool, CASE i WHEN 0 THEN 'brand,note,size' ELSE 'depot' END AS properties, CASE i WHEN 0 THEN 'size' ELSE '' END AS required, true AS tied FROM t""")
def renamed_schemas(spark, sf_dir):
    """Renamed and reordered schemas, tool by tool: properties and required names with their old names put back, and whether each required one is a property."""
    rows = put_back(perturb.perturb(perturb.mode_eligible(processed(spark, sf_dir)).withColumn("mode", F.lit("parameter_and_function")), "key", 42))
    tool = rows.select("key", "back", F.explode(F.from_json("tools", SCHEMA)).alias("t"))
    have, need = F.map_keys("t.parameters.properties"), F.coalesce("t.parameters.required", F.expr("cast(array() as array<string>)"))
    shown = lambda a: F.array_join(F.array_sort(F.transform(a, old_name)), ",")
    return tool.select("key", old_name(F.col("t.name")).alias("tool"), shown(have).alias("properties"), shown(need).alias("required"), (F.size(F.array_except(need, have)) == 0).alias("tied"))


@query(f"""WITH {P}, e AS (SELECT * FROM p WHERE refusal = 1 AND tool_type = 'json' AND tool_count > 0), m AS (SELECT *, {MODE} AS mode FROM (SELECT *, {ORDER.format(seed=49)} AS r, count(*) OVER () AS n FROM e))
SELECT key, mode AS ablation_mode, {QUOTED} AS tools, mode <> 'original_refusal' AS changed FROM m""")
def planned_tools(spark, sf_dir):
    """The tools of an annotation plan with their old names put back: what a schema says is what it said, and the mode says whether names changed."""
    rows = put_back(pipelines.annotation_plan(processed(spark, sf_dir)))
    bare = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)
    said = F.array_sort(F.transform(quoted_texts(F.col("tools")), lambda t: F.concat(F.lit('"'), old_name(bare(t)), F.lit('"'))))
    return rows.select("key", "ablation_mode", F.array_join(said, " ").alias("tools"), (F.size("back") > 0).alias("changed"))


@query(f"""WITH {P}, e AS (SELECT * FROM p WHERE refusal = 1 AND tool_type = 'json' AND tool_count > 0), m AS (SELECT *, {MODE} AS mode FROM (SELECT *, {ORDER.format(seed=49)} AS r, count(*) OVER () AS n FROM e))
SELECT system, "user", tool_count, tool_type, refusal, mode AS ablation_mode, '[]' AS teacher_success, '[]' AS teacher_failed, '' AS teacher_description FROM m""")
def annotation_dataset(spark, sf_dir):
    """The kept columns of planned rows, nested ones as JSON."""
    done = teacher.dataset(teacher.dry_run(pipelines.annotation_plan(processed(spark, sf_dir))))
    return done.select("system", "user", "tool_count", "tool_type", "refusal", "ablation_mode", "teacher_success", "teacher_failed", "teacher_description")


@query(f"""WITH {TOOL}, h AS (SELECT key, unnest(regexp_extract_all(system, '(?is)<tr>(.*?)</tr>', 1)) AS r FROM t)
SELECT key, 'html_tools' AS notation, trim(regexp_replace(regexp_replace(r, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS tool FROM h WHERE trim(regexp_extract(r, '(?is)<td>(.*?)</td>', 1)) <> '' AND lower(trim(regexp_extract(r, '(?is)<td>(.*?)</td>', 1))) <> 'tool_name'
UNION ALL SELECT key, 'xml_tools', trim(split_part(regexp_extract(system, '(?s)<tool_name>.*'), chr(10) || 'Please use', 1)) FROM t WHERE contains(system, '<tool_name>')
UNION ALL SELECT key, 'latex_tools', trim(replace(r, chr(92) || 'hline', '')) FROM (SELECT key, unnest(string_split(system, chr(92) || chr(92))) AS r FROM t WHERE contains(system, 'tabular')) WHERE contains(r, '&') AND NOT contains(r, 'tool_name')
UNION ALL SELECT key, 'name_block_tools', split_part(system, chr(10) || 'Should you', 1) FROM t WHERE contains(system, '**tool_name**')""")
def tools_by_sql(spark, sf_dir):
    """The tools of every notation through the SQL table functions, with LATERAL."""
    names = tables.register_tables(spark)
    prompts(spark, sf_dir).createOrReplaceTempView("kilnwork_prompts")
    return spark.sql(" UNION ALL ".join(f"SELECT p.key, '{n}' AS notation, x.tool FROM kilnwork_prompts p, LATERAL {n}(p.system) x" for n in names))


@query(f"WITH {P}, r AS (SELECT key, {ORDER.format(seed=42)} AS r, (SELECT count(*) FROM p) AS n FROM p WHERE key % 8 < 2) SELECT key FROM r WHERE r <= round_even(n * 0.2::DOUBLE, 0)")
def sample_of_shufflable(spark, sf_dir):
    """Of prompts whose tool list the operator itself finds as many as a share of all."""
    df = render_prompts(spark, sf_dir)
    return sample.sample_of_total(df.where(F.col("text").contains("[") & perturb.has_prompt_tools("text")), "key", df.count(), 0.2, 42).select("key")


#: Two tools with nested parameters, one of which the answer doesn't call, in the words of every part.
CORNER = """SELECT p_partkey AS key, concat('[{"name": "book_room", "description": "Books ', p_name, '", "parameters": {"type": "object", "properties": {"city": {"type": "string", "description": "Where"}, "guest": {"type": "object", "description": "Who stays", "properties": {"name": {"type": "string", "description": "Full name"}, "vip": {"type": "boolean"}}, "required": ["name"]}, "note": {"type": "string"}}, "required": ["city", "guest"]}}, {"name": "apply_coupon", "description": "Applies", "parameters": {"type": "object", "properties": {"coupon_id": {"type": "string", "description": "Which"}, "channel": {"type": "string", "description": "', p_brand, '"}}}}]') AS tools,
  concat('[book_room(city=''Rome'', guest={''name'': ''', p_name, ''', ''vip'': true}, note=''city and guest stay words'')]') AS assistant, 'parameter_only' AS mode FROM part"""


@query("SELECT p_partkey AS key, parameter, renamed, contains('note=''city and guest stay words''', 'city and guest') AS words_stay FROM part, (VALUES ('channel', true), ('city', true), ('coupon_id', true), ('guest', true), ('name', true), ('note', false), ('vip', false)) t(parameter, renamed)")
def corner_cases(spark, sf_dir):
    """The hand-built case in the words of every part: of two tools' parameters those that are described get new names, nested ones and uncalled tools' alike."""
    from . import adapters

    done = perturb.perturb(adapters.run(spark, sf_dir, CORNER), "key", 7)
    names = F.from_json("parameter_mapping", "map<string,string>")
    each = done.select("key", "assistant", names.alias("m"), F.explode(F.array_distinct(F.concat(F.map_keys(names), F.array(F.lit("vip"), F.lit("note"))))).alias("parameter"), extract.all_names("tools").alias("left"))
    here = lambda n: F.array_contains("left", n)
    new = F.try_element_at("m", F.col("parameter"))
    return each.select("key", "parameter", F.coalesce(~here(F.col("parameter")) & here(new), F.lit(False)).alias("renamed"), (F.col("assistant").contains("note='city and guest stay words'") & F.col("assistant").contains("'vip': true")).alias("words_stay"))

