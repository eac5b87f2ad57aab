"""Renaming and reordering schemas with their answers. Seeds come from a stable key, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..functions.text import arrow, quoted
from . import extract

#: Names and shares of the modes.
TRAIN_MODES = {"parameter_only": 0.15, "function_only": 0.10, "parameter_and_function": 0.05}
TEACHER_MODES = {"original_refusal": 0.60, "param_only": 0.20, "function_only": 0.10, "param_and_function": 0.10}
EVAL_SHARE = 0.5
_OUT = "tools string, assistant string, parameter_mapping string, function_mapping string, applied boolean"


def perturb_row(tools: str | None, assistant: str | None, parameters: bool, functions: bool, reorder: bool, seed: int, strict: bool = False) -> dict:
    """A row's tools and answer with new names and a new order; mappings as JSON texts. Without anything to rename nothing changes.
    `strict`: of the answer only what stands before `=` or `:`."""
    value, answer = J.load_tools(tools) if parameters or functions else [], assistant or ""
    names = J.fresh_names(J.described_names(value), "param", seed) if parameters else {}
    calls = J.fresh_names(J.function_names(value), "func", seed) if functions else {}
    applied = bool(names or calls)
    if applied:
        if parameters or reorder:
            value = J.permuted(J.rename_described(value, names), seed)
        if calls:
            value = J.rename_functions(value, calls)
        answer = J.rename_calls(J.rename_assignments(answer, names, strict=strict), calls)
    return {"tools": J.dump(value) if applied else tools, "assistant": answer if applied else assistant, "parameter_mapping": J.dump(names), "function_mapping": J.dump(calls), "applied": applied}


_perturb = arrow(perturb_row, _OUT)


def row_seed(key: Column, seed: int) -> Column:
    """A seed of its own for every row, from its key."""
    return F.xxhash64(F.lit(seed), key.cast("string"))


def perturb(df: DataFrame, key: str, seed: int, *, mode: str = "mode", none: str = "none", always_reorder: bool = True, strict: bool = False) -> DataFrame:
    """Rewrites tools and assistant of the rows whose mode isn't `none`; adds parameter_mapping, function_mapping and applied.

    One pass over the table: rows whose mode is `none` or null reach the UDF as nulls, which it has nothing to do with, and keep
    what they have.
    """
    spelled = F.col(mode)
    touched = F.coalesce(spelled != none, F.lit(False))
    only = lambda c: F.when(touched, c)
    call = _perturb(only(F.col("tools")), only(F.col("assistant")), touched & spelled.contains("param"), touched & spelled.contains("func"), F.lit(always_reorder), row_seed(F.col(key), seed), F.lit(strict))
    new = {c: F.when(touched, F.col(f"p_.{c}")).otherwise(old) for c, old in {"tools": F.col("tools"), "assistant": F.col("assistant"), "parameter_mapping": F.lit("{}"), "function_mapping": F.lit("{}"), "applied": F.lit(False)}.items()}
    return df.withColumn("p_", call).withColumns(new).drop("p_")


def rename_with(column: Column, names: Column, kind: str = "parameters") -> Column:
    """A text with the names of a map<string,string> column replaced, the longest first; natively, a fold over the map."""
    rows = F.array_sort(F.map_entries(names), lambda a, b: F.length(b["key"]) - F.length(a["key"]))

    def step(text: Column, x: Column) -> Column:
        old, new = quoted(x["key"]), F.replace(F.replace(x["value"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        if kind == "functions":
            return F.regexp_replace(text, F.concat(F.lit("(?<![A-Za-z0-9_.])"), old, F.lit(r"(?=\s*\()")), new)
        mark = F.lit(r"(?=\s*[=:/|~])")
        text = F.regexp_replace(text, F.concat(F.lit("(?<=([\"']))"), old, F.lit(r"(?=\1\s*[=:/|~])")), new)
        return F.regexp_replace(text, F.concat(F.lit("(?<![A-Za-z0-9_])"), old, F.lit("(?![A-Za-z0-9_])"), mark), new)

    return F.aggregate(rows, column, step)


def parameter_eligible(df: DataFrame) -> DataFrame:
    """Answered JSON rows with a described parameter; the cheap conditions come first and reach the scan."""
    return df.where("tool_type = 'json' and tool_count >= 1 and refusal = 0").where(F.size(extract.described_names("tools")) > 0)


def mode_eligible(df: DataFrame) -> DataFrame:
    """As parameter_eligible, with a named function too."""
    return parameter_eligible(df).where(F.size(extract.function_names("tools")) > 0)


def teacher_eligible(df: DataFrame) -> DataFrame:
    """Refused JSON rows with a described parameter."""
    return df.where("refusal = 1 and tool_count > 0 and tool_type = 'json'").where(F.size(extract.described_names("tools")) > 0)


def _shuffle_prompt(text: str | None, seed: int) -> dict:
    found = J.prompt_tools(text or "")
    if found is None:
        return {"text": text, "changed": False}
    start, end, tools = found
    return {"text": text[:start] + J.dump([J.permuted(t, seed, forced=True, path=(i,)) for i, t in enumerate(tools)]) + text[end:], "changed": True}


shuffle_prompt = arrow(_shuffle_prompt, "text string, changed boolean")
has_prompt_tools = arrow(lambda t: J.prompt_tools(t or "") is not None, "boolean")
