"""Native text expressions: stripping, markup cleaning, fragments between matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() removes, as a Java class.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: Lines that end a section of tool descriptions.
SECTION_MARKERS = ("Please use the following format", "Do not include parameters", "When invoking tools", "Should you decide")


def arrow(f: Callable, returns: str) -> Callable[..., Column]:
    """An Arrow UDF, made where it is used: modules must load in workers too, where there is no session."""

    def call(*columns: Column | str) -> Column:
        return F.udf(f, returns, useArrow=True)(*columns)

    return call


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    """The stripped text, or null if nothing is left of it."""
    return F.nullif(strip(c), F.lit(""))


def clean_markup(c: Column) -> Column:
    """Tags and table commands become spaces, bold marks go, backslashes become spaces; white space is collapsed, then spaces and bars at the ends go."""
    c = F.regexp_replace(c, r"<[^>]+>|\\(?:hline|begin\{[^}]+\}|end\{[^}]+\})", " ")
    c = F.translate(F.replace(c, F.lit("**"), F.lit("")), "\\", " ")
    return F.btrim(F.regexp_replace(c, f"{SPACE}+", " "), F.lit(" |"))


def before_section_end(c: Column) -> Column:
    return F.get(F.split(c, "\n(?:" + "|".join(SECTION_MARKERS) + ")", 2), 0)


def fragments(text: Column, pattern: str) -> Column:
    """Stripped texts from each match of `pattern` up to the next one, the last up to the section's end; only those whose group 1 is more than markup."""
    hits, names, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), 1), F.split(text, pattern, -1)
    after = F.slice(gaps, 2, F.size(hits))
    rows = F.arrays_zip(hits.alias("hit"), names.alias("name"), after.alias("gap"))
    whole = F.transform(rows, lambda x, i: F.struct(strip(F.concat(x["hit"], F.when(i == F.size(hits) - 1, before_section_end(x["gap"])).otherwise(x["gap"]))).alias("text"), clean_markup(x["name"]).alias("name")))
    return F.transform(F.filter(whole, lambda x: x["name"] != ""), lambda x: x["text"])


def quoted(c: Column) -> Column:
    """A text as a literal inside a Java pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
