"""Tool-calling tables made from the star schema. One SQL text serves Spark and DuckDB, so both see the same bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = "cast(p_partkey as string)"
NL, BS = "chr(10)", "chr(92)"
TOOL = f"""concat('{{"name": "get_part_', {K}, '", "description": "Look up ', p_name, '", "parameters": {{"type": "object", "properties": {{"size": {{"type": "integer", "description": "Size in mm"}}, "brand": {{"type": "string"', case when p_partkey % 3 = 0 then '' else ', "description": "Brand name"' end, '}}, "note": {{"type": "string"}}}}, "required": ["size"]}}}}')"""
SECOND = f"""concat('{{"name": "get_stock_', {K}, '", "parameters": {{"type": "object", "properties": {{"depot": {{"type": "string", "description": "Depot"}}}}}}}}')"""

#: Prompts: p_partkey % 8 says how the tools are written (list, object, announced empty list, HTML, XML, LaTeX, name blocks, not at all).
SYSTEM = f"""case p_partkey % 8
  when 0 then concat('Tools follow. ', '[', {TOOL}, ', ', {SECOND}, ']', {NL}, 'Answer briefly.')
  when 1 then concat('Your tool: ', {TOOL})
  when 2 then concat('Here is a list of functions in JSON format: []', {NL}, 'Say so if none fits.')
  when 3 then concat('<table><tr><th>x</th></tr><tr><td>tool_name</td><td>about</td></tr><tr><td>get_part_', {K}, '</td><td>Look up ', p_name, '</td></tr></table>')
  when 4 then concat('Tools:', {NL}, '<tool_name>get_part_', {K}, '</tool_name> looks up ', p_name, {NL}, 'Please use the following format: x')
  when 5 then concat({BS}, 'begin{{tabular}}{{ll}} ', {BS}, {BS}, ' tool_name & about ', {BS}, {BS}, ' ', {BS}, 'hline get_part_', {K}, ' & Look up ', p_name, ' ', {BS}, {BS}, ' ', {BS}, 'end{{tabular}}')
  when 6 then concat('- **tool_name**: get_part_', {K}, {NL}, 'Looks up ', p_name, {NL}, 'Should you decide to answer')
  else 'Answer as well as you can.' end"""
TOOLS = f"""case p_partkey % 8
  when 0 then concat('[', {TOOL}, ', ', {SECOND}, ']') when 1 then concat('[', {TOOL}, ']') when 2 then '[]'
  when 3 then concat('["get_part_', {K}, ' Look up ', p_name, '"]') when 4 then concat('["<tool_name>get_part_', {K}, '</tool_name> looks up ', p_name, '"]')
  when 5 then concat('["get_part_', {K}, ' & Look up ', p_name, '"]') when 6 then concat('["- **tool_name**: get_part_', {K}, {BS}, 'nLooks up ', p_name, '"]') else '[]' end"""
REST = f"""case p_partkey % 8 when 0 then concat('Tools follow. ', {NL}, 'Answer briefly.') when 1 then 'Your tool:' when 2 then concat('Here is a list of functions in JSON format: ', {NL}, 'Say so if none fits.') else {SYSTEM} end"""
ANSWER = f"""case when p_partkey % 5 < 2 then concat('[get_part_', {K}, '(size=', cast(p_size as string), ', brand="', p_brand, '")]')
  when p_partkey % 5 = 2 and p_partkey % 2 = 0 then 'Which size do you need?' when p_partkey % 5 = 2 then 'I cannot reach the latest list: size=unknown'
  when p_partkey % 5 = 3 then 'None of the functions delivers that brand.' when p_partkey % 2 = 0 then concat('First, ', repeat('take care ', 24), 'then go on.') else 'Sorry.' end"""
COUNT = "case p_partkey % 8 when 0 then 2 when 2 then 0 when 7 then 0 else 1 end"
TYPE = "case when p_partkey % 8 < 3 then 'json' else 'non_json' end"

A_TOOL = f"SELECT p_partkey AS key, {SYSTEM} AS system FROM part"
A_PROCESSED = f"""SELECT p_partkey AS key, {REST} AS system, concat('Find ', p_name, '.') AS user, {ANSWER} AS assistant, {TOOLS} AS tools,
  cast({COUNT} as int) AS tool_count, {TYPE} AS tool_type, cast(case when p_partkey % 5 < 2 then 0 else 1 end as int) AS refusal FROM part"""
#: Annotations, some of them at fault, flat: one success and one failed item each.
A_TEACHER = f"""SELECT p_partkey AS source_index, concat('get_part_', {K}) AS tool,
  case p_partkey % 7 when 0 then '' else concat('Find ', p_name) end AS request,
  case p_partkey % 6 when 0 then concat('get_part_', {K}, '(size=1)') when 1 then concat('[GetPart', {K}, '(size=1)]') when 2 then 'no call' when 3 then concat('[get_part_', {K}, '(old_size=1)]') when 4 then '' else concat('[get_part_', {K}, '(size=1)]') end AS call,
  case p_partkey % 4 when 0 then 'miss_param' when 1 then 'no_suitable_tool' when 2 then 'other' else 'miss_param' end AS reason,
  case when p_partkey % 8 < 2 then 'old_size' else 'size' end AS missing, case p_partkey % 9 when 0 then '' else 'Done.' end AS description,
  case when p_partkey % 3 = 0 then 'param_only' else 'function_only' end AS ablation_mode FROM part"""


#: Rows of a task, about. Prompts are made of few bytes, so a file's splits say nothing of the work.
ROWS = 25_000


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table part, dealt by key over as many tasks as it has ROWS; a file of one row group is one task otherwise, whatever its size."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    tasks = -(-df.count() // ROWS)  # the files' footers tell it
    return df.repartition(tasks, "p_partkey") if tasks > 1 else df


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    parts(spark, sf_dir).createOrReplaceTempView("kilnwork_part")
    return spark.sql(sql.replace("FROM part", "FROM kilnwork_part"))
