"""Chat prompts: system content with tools, the template, teacher messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..functions.text import arrow, strip

#: The segments of the chat template.
BEGIN, EOT = "<|begin_of_text|>", "<|eot_id|>"


def header(role: str) -> str:
    return f"<|start_header_id|>{role}<|end_header_id|>\n\n"


indented = arrow(lambda t: J.dump(J.load_tools(t), indent=2), "string")


def render_system(system: Column, tools: Column) -> Column:
    """The stripped system text, a blank line, the tools indented; the tools alone if there is no text."""
    text, shown = strip(F.coalesce(system, F.lit(""))), indented(tools)
    return F.when(text == "", shown).otherwise(F.concat(text, F.lit("\n\n"), shown))


def render_prompt(system: Column, user: Column, assistant: Column, tools: Column) -> Column:
    parts = [F.lit(BEGIN)]
    for role, content in (("system", render_system(system, tools)), ("user", user), ("assistant", assistant)):
        parts += [F.lit(header(role)), F.coalesce(content, F.lit("")), F.lit(EOT)]
    return F.concat(*parts)


def add_prompt(df: DataFrame, name: str = "text") -> DataFrame:
    return df.withColumn(name, render_prompt(F.col("system"), F.col("user"), F.col("assistant"), F.col("tools")))


#: What an annotator is told. Our own wording of the task; the keys, reasons and call format are fixed values.
TEACHER_TASK = """You annotate how an assistant should use tools for a user's request.
Answer with one JSON object and nothing else, no markdown:
{"success": [{"request": "...", "tool": "...", "call": "[tool(parameter=value)]"}],
 "failed": [{"request": "...", "tool": "... or null", "reason": "miss_param or no_suitable_tool",
             "missing_parameters": [], "provided_arguments": {}, "description": "..."}],
 "description": "..."}
Split the request into its explicit parts and annotate every part by itself, also when two parts need the same call.
A part is a success if a tool performs exactly what it asks for and every required parameter is given or has a default in the schema.
If a fitting tool lacks required parameters, the part failed with miss_param: name the tool, the missing parameters and the arguments given.
If no tool performs it, the part failed with no_suitable_tool: tool null, nothing missing, nothing provided.
Never make values up. The outer description sums the whole annotation up so that it can be read alone."""

_question = arrow(lambda user, tools: J.dump({"tools": J.load_tools(tools), "user_request": user or ""}, indent=2), "string")


def teacher_messages(user: Column, tools: Column) -> Column:
    """array<struct<role, content>>; the original answer is deliberately left out."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(say("system", F.lit(TEACHER_TASK)), say("user", _question(user, tools)))
