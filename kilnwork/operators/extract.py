"""Tools out of prompts: embedded JSON through an Arrow UDF, other notations with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..functions.text import arrow, clean_markup, fragments, strip

_BLOCK = "tools string, rest string"


def _block(system: str | None) -> dict | None:
    found = J.tool_block(system or "")
    if found is None:
        return None
    start, end, tools = found
    return {"tools": J.dump(tools), "rest": (system[:start] + system[end:]).strip()}


json_block = arrow(_block, _BLOCK)
described_names = arrow(lambda t: J.described_names(J.load_tools(t)), "array<string>")
all_names = arrow(lambda t: J.all_names(J.load_tools(t)), "array<string>")
function_names = arrow(lambda t: J.function_names(J.load_tools(t)), "array<string>")
loose_names = arrow(lambda t: [J.loose_name(x) for x in J.load_tools(t) if isinstance(x, dict)], "array<string>")
tool_parameters = arrow(lambda t: J.tool_index(J.load_tools(t)), "map<string,array<string>>")


def html_tools(c: Column) -> Column:
    """Cleaned rows of HTML tables whose first cell names something."""
    rows = F.regexp_extract_all(c, F.lit("(?is)<tr>(.*?)</tr>"), 1)
    first = lambda r: clean_markup(F.get(F.regexp_extract_all(r, F.lit("(?is)<td>(.*?)</td>"), 1), F.lit(0)))
    return F.transform(F.filter(rows, lambda r: ~F.lower(F.coalesce(first(r), F.lit(""))).isin("", "tool_name")), clean_markup)


def xml_tools(c: Column) -> Column:
    return fragments(c, "(?is)<tool_name>(.*?)</tool_name>")


def latex_tools(c: Column) -> Column:
    """Cleaned rows of LaTeX tables whose first cell is longer than a character."""
    rows = F.filter(F.split(c, r"\\\\\s*(?:\\hline)?", -1), lambda r: r.contains("&"))
    first = lambda r: clean_markup(F.get(F.split(r, "&", -1), F.lit(0)))
    named = F.filter(rows, lambda r: (F.length(first(r)) > 1) & (F.lower(first(r)) != "tool_name"))
    return F.when(c.contains("\\begin{tabular}"), F.transform(named, clean_markup)).otherwise(F.expr("cast(array() as array<string>)"))


def name_block_tools(c: Column) -> Column:
    return fragments(c, r"(?imd)^(?:[-*]\s*)?(?:\*\*)?tool_name(?:\*\*)?\s*:\s*(.+?)\s*$")


def written_tools(c: Column) -> Column:
    """The tools of the first notation that yields any: HTML, XML, LaTeX, name blocks."""
    some = lambda a: F.when(F.size(a) > 0, a)
    return F.coalesce(some(html_tools(c)), some(xml_tools(c)), some(latex_tools(c)), some(name_block_tools(c)), F.expr("cast(array() as array<string>)"))


json_list = arrow(lambda xs: None if xs is None else J.dump(list(xs)), "string")


def parse_system(df: DataFrame, column: str = "system") -> DataFrame:
    """Replaces `column` by the prompt without its tools and adds tools (JSON text), tool_count, tool_type and extract_failed.

    Texts without a bracket reach the UDF as nulls, and so do rows without written tools the second one. A null prompt is
    empty, which is a failure.
    """
    text = strip(F.coalesce(F.col(column), F.lit("")))
    df = df.withColumn(column, text)
    block = json_block(F.when(F.col(column).rlike(r"[\[{]"), F.col(column)))
    df = df.withColumn("block_", block).withColumn("written_", F.when(F.col("block_").isNull(), written_tools(F.col(column))).otherwise(F.expr("cast(array() as array<string>)")))
    is_json = F.col("block_").isNotNull()
    count = F.when(is_json, F.coalesce(F.json_array_length("block_.tools"), F.lit(0))).otherwise(F.size("written_"))
    return df.withColumns({
        "tools": F.when(is_json, F.col("block_.tools")).otherwise(F.coalesce(json_list(F.when(F.size("written_") > 0, F.col("written_"))), F.lit("[]"))),
        "tool_count": count.cast("int"),
        "tool_type": F.when(is_json, "json").otherwise("non_json"),
        "extract_failed": ~is_json & (F.size("written_") == 0),
        column: F.when(is_json, F.col("block_.rest")).otherwise(F.col(column)),
    }).drop("block_", "written_")
