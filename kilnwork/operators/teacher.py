"""Annotations from an outside model: repair, validation, routing and resuming, on typed rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsontext as J
from ..functions.text import blank_to_null, strip
from .classify import calls_any, first_old_name
from .endpoint import Clients, Limits, asked

SUCCESS = "array<struct<request:string,tool:string,call:string>>"
FAILED = "array<struct<request:string,tool:string,reason:string,missing_parameters:array<string>,provided_arguments:map<string,string>,description:string>>"
ANNOTATION = f"struct<success:{SUCCESS},failed:{FAILED},description:string>"
#: Fixed values.
REASONS = ("miss_param", "no_suitable_tool")
STATUSES = ("valid", "invalid_schema", "failed_parse_or_request", "dry_run")


def bracketed(call: Column) -> Column:
    """A call in the brackets it should have: those there are kept, missing ones are added if it ends like a call."""
    bare = strip(call)
    return F.when(bare.startswith("[") & bare.endswith("]"), bare).when(bare.contains("(") & bare.endswith(")"), F.concat(F.lit("["), bare, F.lit("]"))).otherwise(call)


def renamed_call(call: Column, tool: Column, names: Column) -> Column:
    """A call that uses no known tool gets the name of the item's own tool, if that is a known one."""
    bare = strip(call)
    inner = F.when(bare.startswith("[") & bare.endswith("]"), strip(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)
    at = F.instr(inner, "(")
    fixed = F.concat(F.lit("["), tool, F.substring(inner, at, F.length(inner)), F.lit("]"))
    fit = F.array_contains(names, tool) & ~calls_any(call, names) & (at > 0) & inner.endswith(")")
    return F.when(F.coalesce(fit, F.lit(False)), fixed).otherwise(call)


def normalized(success: Column, names: Column) -> Column:
    """Successes with their calls bracketed, then renamed."""
    return F.transform(success, lambda x: x.withField("call", renamed_call(bracketed(x["call"]), x["tool"], names)))


def errors(success: Column, failed: Column, description: Column, names: Column, old: Column) -> Column:
    """array<string>: error codes in order. `names`: known tools; `old`: parameter names that must not be left."""
    say = lambda cond, text: F.when(F.coalesce(cond, F.lit(True)), text)
    text = lambda kind, i, *rest: F.concat(F.lit(f"{kind}_"), i.cast("string"), *[F.lit(r) if isinstance(r, str) else r for r in rest])
    none = lambda c: blank_to_null(c).isNull()
    shown = lambda c: F.coalesce(c, F.lit("None"))
    top = F.array(
        say(success.isNull(), F.lit("success_not_list")), say(failed.isNull(), F.lit("failed_not_list")), say(none(description), F.lit("description_missing")),
        say((F.coalesce(F.size(success), F.lit(0)) <= 0) & (F.coalesce(F.size(failed), F.lit(0)) <= 0), F.lit("empty_success_and_failed")),
    )

    def of_success(x: Column, i: Column) -> Column:
        bare, left = strip(x["call"]), first_old_name(x["call"], old)
        call = (
            F.when(none(x["call"]), text("success", i, "_call_missing")).when(~(bare.startswith("[") & bare.endswith("]")), text("success", i, "_call_not_bfcl_list"))
            .when(~calls_any(x["call"], names), text("success", i, "_call_unknown_tool")).when(left.isNotNull(), text("success", i, "_old_parameter_name_left:", left))
        )
        rows = F.array(say(none(x["request"]), text("success", i, "_request_missing")), say(~F.array_contains(names, x["tool"]), text("success", i, "_unknown_tool:", shown(x["tool"]))), call)
        return F.when(x.isNull(), F.array(text("success", i, "_not_dict"))).otherwise(rows)

    def of_failed(x: Column, i: Column) -> Column:
        missing, provided = x["missing_parameters"], F.map_keys(x["provided_arguments"])
        filled = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
        rows = F.array(
            say(none(x["request"]), text("failed", i, "_request_missing")), say(~x["reason"].isin(*REASONS), text("failed", i, "_invalid_reason:", shown(x["reason"]))),
            say(missing.isNull(), text("failed", i, "_missing_parameters_not_list")), say(x["provided_arguments"].isNull(), text("failed", i, "_provided_arguments_not_dict")), say(none(x["description"]), text("failed", i, "_description_missing")),
        )
        prefix = "_no_suitable_tool_requires"
        no_tool = F.array(F.when(x["tool"].isNotNull(), text("failed", i, f"{prefix}_null_tool")), F.when(filled(missing), text("failed", i, f"{prefix}_empty_missing")), F.when(filled(provided), text("failed", i, f"{prefix}_empty_provided")))
        kept = lambda a, code: F.transform(F.filter(F.coalesce(a, F.expr("cast(array() as array<string>)")), lambda n: F.array_contains(old, n)), lambda n: text("failed", i, code, n))
        known = F.array_contains(names, x["tool"])
        lacking = F.when(F.coalesce(known, F.lit(False)), F.concat(F.array(F.when(~filled(missing), text("failed", i, "_miss_param_requires_missing"))), kept(missing, "_old_missing_name:"), kept(provided, "_old_provided_argument:"))).otherwise(F.array(text("failed", i, "_unknown_tool:", shown(x["tool"]))))
        more = F.when(x["reason"] == "no_suitable_tool", no_tool).when(x["reason"] == "miss_param", lacking).otherwise(F.expr("cast(array() as array<string>)"))
        return F.when(x.isNull(), F.array(text("failed", i, "_not_dict"))).otherwise(F.concat(rows, more))

    empty = F.expr("cast(array() as array<string>)")
    items = lambda a, f: F.coalesce(F.flatten(F.transform(a, f)), empty)
    return F.filter(F.concat(top, items(success, of_success), items(failed, of_failed)), lambda e: e.isNotNull())


def status(codes: Column) -> Column:
    return F.when(F.size(codes) > 0, "invalid_schema").otherwise("valid")


def check_annotations(df: DataFrame) -> DataFrame:
    """Repairs teacher_success and adds validation_errors and status; needs tool_names and old_names (array<string>)."""
    df = df.withColumn("teacher_success", normalized(F.col("teacher_success"), F.col("tool_names")))
    codes = errors(*(F.col(c) for c in ("teacher_success", "teacher_failed", "teacher_description", "tool_names", "old_names")))
    return df.withColumn("validation_errors", codes).withColumn("status", status(F.col("validation_errors")))


def refreshed(df: DataFrame) -> DataFrame:
    """Stored results, repaired and validated anew where they hold the annotation itself (teacher_json); others stay as they are."""
    held, of = F.col("teacher_json").isNotNull(), lambda c: F.col(f"teacher_json.{c}")
    names = {"teacher_success": "success", "teacher_failed": "failed", "teacher_description": "description"}
    old = {c: F.col(c) for c in (*names, "validation_errors", "status")}
    kept = df.withColumn("stored_", F.struct(*(c.alias(n) for n, c in old.items())))
    checked = check_annotations(kept.withColumns({c: of(inner) for c, inner in names.items()}))
    back = checked.withColumns({c: F.when(held, F.col(c)).otherwise(F.col(f"stored_.{c}")) for c in old}).drop("stored_")
    return back.withColumn("teacher_json", F.when(held, F.struct(*(F.col(c).alias(inner) for c, inner in names.items()))))


def repaired(valid: DataFrame, invalid: DataFrame) -> DataFrame:
    """Stored results as a resumed run takes them up, with their bucket and whether they came over: those from the valid bucket stay
    there whatever their new status, invalid ones that now validate join them."""
    both = refreshed(valid.withColumn("bucket", F.lit("valid")).unionByName(invalid.withColumn("bucket", F.lit("invalid")), allowMissingColumns=True))
    over = (F.col("bucket") == "invalid") & (F.col("status") == "valid")
    return both.withColumn("came_over", over).withColumn("bucket", F.when(F.col("came_over"), "valid").otherwise(F.col("bucket")))


def description_of(df: DataFrame) -> Column:
    """teacher_description, or teacher_json's, or that in an answer that is a JSON object, or an answer that is no JSON; else empty."""
    parsed = F.try_parse_json("assistant")
    from_answer = F.try_variant_get(parsed, "$.description", "string")
    has = lambda c: c in df.columns
    options = [blank_to_null(F.col("teacher_description"))] if has("teacher_description") else []
    options += [blank_to_null(F.get_json_object("teacher_json", "$.description"))] if has("teacher_json") else []
    return F.coalesce(*options, blank_to_null(from_answer), F.when(parsed.isNull(), blank_to_null(F.col("assistant"))), F.lit(""))


def pending(planned: DataFrame, done: DataFrame, key: str = "source_index") -> DataFrame:
    """What was planned and has no result."""
    return planned.join(done.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def canonical(results: DataFrame, planned: DataFrame, key: str = "source_index", mode: str = "ablation_mode") -> tuple[DataFrame, DataFrame]:
    """Valid results whose stored mode is still the planned one, and the stale rest."""
    plan = planned.select(F.col(key).alias("k_"), F.col(mode).alias("m_")).distinct()
    same = (F.col(key) == F.col("k_")) & (F.col(mode) == F.col("m_"))
    return results.join(plan, same, "left_semi"), results.join(plan, same, "left_anti")


def dry_run(plan: DataFrame) -> DataFrame:
    """Records of planned rows without asking: an empty annotation and the status dry_run."""
    empty = lambda kind: F.expr(f"cast(array() as {kind})")
    return plan.withColumns({
        "teacher_success": empty(SUCCESS), "teacher_failed": empty(FAILED), "teacher_description": F.lit(""),
        "validation_errors": empty("array<string>"), "error": F.lit(None).cast("string"), "status": F.lit("dry_run"),
    })


def dataset(records: DataFrame) -> DataFrame:
    """The thirteen columns that are kept of annotated rows, nested ones as JSON text."""
    nested = lambda c: F.to_json(c).alias(c) if isinstance(records.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c)
    return records.select("system", "user", "assistant", "tools", "tool_count", "tool_type", "refusal", "ablation_mode", *map(nested, ("parameter_mapping", "function_mapping", "teacher_success", "teacher_failed")), "teacher_description")


#: Results that are passed on together at most; a batch of a few rows costs as much as one of hundreds.
MOST = 1000
RESULT = f"raw string, success {SUCCESS}, failed {FAILED}, description string, error string"


def _parsed(raw: str) -> dict:
    """A reply as typed fields; values that aren't texts become JSON text, what isn't a list or an object becomes null."""
    value = J.lenient_object(raw)
    text = lambda v: v if v is None or isinstance(v, str) else J.dump(v)
    listed = lambda v, f: [f(x) if isinstance(x, dict) else None for x in v] if isinstance(v, list) else None
    names = lambda v: [text(x) for x in v] if isinstance(v, list) else None
    given = lambda v: {str(k): text(x) for k, x in v.items()} if isinstance(v, dict) else None
    return {
        "success": listed(value.get("success", []), lambda x: {k: text(x.get(k)) for k in ("request", "tool", "call")}),
        "failed": listed(value.get("failed", []), lambda x: {k: text(x.get(k)) for k in ("request", "tool", "reason", "description")} | {"missing_parameters": names(x.get("missing_parameters")), "provided_arguments": given(x.get("provided_arguments"))}),
        "description": text(value.get("description", "")),
    }


def annotate(df: DataFrame, make_client: Callable[[], Callable[[list[dict]], str]], threads: int = 4, limits: Limits | None = None) -> DataFrame:
    """Asks for an annotation of every row (source_index, teacher_prompt): source_index, raw, success, failed, description, error.

    A task keeps `threads` requests going (or as `limits` says), each by a client of its own, over batches of rows alike, and passes
    results on as they come. A row whose request or reply still fails on the last try has its error instead; a reply that is no JSON is
    asked for again. Tokens are counted as a quarter of the messages' characters. Write the result before using it twice: each evaluation asks again.
    """
    limits = limits or Limits(in_flight=threads, tries=1)
    fields = ["source_index", "raw", "success", "failed", "description", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients = Clients(make_client)
        heard: dict = {}

        def ask(request: tuple) -> dict:
            place, messages = request
            raw = heard[place] = clients(messages)
            return {"raw": raw} | _parsed(raw)

        def requests() -> Iterator[tuple]:
            place = 0
            for pdf in batches:
                for key, messages in zip(pdf["source_index"], pdf["teacher_prompt"]):
                    place += 1
                    yield (key, place), (place, [{"role": m["role"], "content": m["content"]} for m in messages])

        size = lambda request: sum(len(m["content"] or "") for m in request[1]) / 4 + 1
        out: list[dict] = []
        passed = time.monotonic()
        for (key, place), answer, error, _ in asked(requests(), ask, limits, cost=size):
            raw = heard.pop(place, None)
            out.append(dict.fromkeys(fields) | {"source_index": key} | (answer if error is None else {"raw": raw, "error": f"{type(error).__name__}: {error}"}))
            if len(out) >= MOST or (len(out) >= limits.every and time.monotonic() - passed >= 1):
                yield pd.DataFrame(out, columns=fields)
                out, passed = [], time.monotonic()
        if out:
            yield pd.DataFrame(out, columns=fields)

    rows = df.select("source_index", "teacher_prompt")
    rows = rows.repartition(limits.tasks) if limits.tasks else rows
    return rows.mapInPandas(run, f"source_index {df.schema['source_index'].dataType.simpleString()}, {RESULT}")
