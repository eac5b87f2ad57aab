"""The engine's functions under SQL names: scalar ones, and table functions for use with LATERAL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import jsontext as J
from .text import SECTION_MARKERS, SPACE


def register(spark: SparkSession) -> list[str]:
    """Makes the JSON functions callable from spark.sql; returns their names."""
    known = {
        "tool_names": (lambda t: J.function_names(J.load_tools(t)), "array<string>"),
        "described_parameters": (lambda t: J.described_names(J.load_tools(t)), "array<string>"),
        "all_parameters": (lambda t: J.all_names(J.load_tools(t)), "array<string>"),
        "indented_tools": (lambda t: J.dump(J.load_tools(t), indent=2), "string"),
        "has_tool_block": (lambda t: J.tool_block(t or "") is not None, "boolean"),
    }
    for name, (f, returns) in known.items():
        spark.udf.register(name, F.udf(f, returns, useArrow=True))
    return list(known)


# ---- table functions, in SQL themselves, so that Catalyst sees through them ----


def _clean(x: str) -> str:
    tags = r"r'<[^>]+>|\\(?:hline|begin\{[^}]+\}|end\{[^}]+\})'"
    return f"btrim(regexp_replace(translate(replace(regexp_replace({x}, {tags}, ' '), '**', ''), char(92), ' '), r'{SPACE}+', ' '), ' |')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, r'^{SPACE}+|{SPACE}+$', '')"


def _fragments(pattern: str) -> str:
    hits, ends = f"regexp_extract_all(txt, r'{pattern}', 0)", "|".join(SECTION_MARKERS)
    gap = f"CASE WHEN i = size({hits}) - 1 THEN get(split(x.`2`, '\\n(?:{ends})', 2), 0) ELSE x.`2` END"
    rows = f"arrays_zip({hits}, regexp_extract_all(txt, r'{pattern}', 1), slice(split(txt, r'{pattern}', -1), 2, size({hits})))"
    named = f"transform({rows}, (x, i) -> named_struct('t', {_strip(f'concat(x.`0`, {gap})')}, 'n', {_clean('x.`1`')}))"
    return f"transform(filter({named}, x -> x.n <> ''), x -> x.t)"


def _first(cells: str) -> str:
    return f"coalesce({_clean(f'get({cells}, 0)')}, '')"


_cell, _cells, _rows = "get(split(r, '&', -1), 0)", r"regexp_extract_all(r, r'(?is)<td>(.*?)</td>', 1)", r"filter(split(txt, r'\\\\\s*(?:\\hline)?', -1), r -> contains(r, '&'))"
#: (parameter txt) as arrays: the tools that a prompt writes in one notation.
WRITTEN = {
    "html_tools": f"transform(filter(regexp_extract_all(txt, r'(?is)<tr>(.*?)</tr>', 1), r -> lower({_first(_cells)}) NOT IN ('', 'tool_name')), r -> {_clean('r')})",
    "xml_tools": _fragments("(?is)<tool_name>(.*?)</tool_name>"),
    "latex_tools": f"CASE WHEN contains(txt, concat(char(92), 'begin{{tabular}}')) THEN transform(filter({_rows}, r -> length({_clean(_cell)}) > 1 AND lower({_clean(_cell)}) <> 'tool_name'), r -> {_clean('r')}) END",
    "name_block_tools": _fragments(r"(?imd)^(?:[-*]\s*)?(?:\*\*)?tool_name(?:\*\*)?\s*:\s*(.+?)\s*$"),
}


def register_tables(spark: SparkSession) -> list[str]:
    """Temporary table functions (text) -> (position, tool), as in SELECT t.id, x.tool FROM t, LATERAL html_tools(t.system) x; returns their names."""
    for name, rows in WRITTEN.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(txt STRING) RETURNS TABLE(position INT, tool STRING) RETURN SELECT posexplode({rows})")
    return list(WRITTEN)
