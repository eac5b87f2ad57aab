"""The pipelines: structuring, two perturbation sets, refusal analysis, annotation, and two repairs of rendered prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.turns import first_turns
from ..operators import classify, extract, perturb, report, sample, teacher, tokens
from ..operators.endpoint import Limits
from ..operators.prompt import EOT, add_prompt, header, render_prompt, teacher_messages
from ..sources import io
from ..sources.ledger import Ledger

COLUMNS = ("system", "user", "assistant", "tools", "tool_count", "tool_type", "refusal")
MAX_TOKENS = 1024
# Names of the refusal rows' modes and sources.
DESCRIBED, WITHOUT_TOOLS = "teacher_refusal_description", "toolace_zero_tool_refusal"


def structure(raw: DataFrame, *, tokenizer: tokens.Tokenizer = tokens.default_tokenizer) -> DataFrame:
    """raw (key, system, conversations) to key, the seven columns, prompt_token_length and extract_failed; nothing is filtered yet."""
    df = extract.parse_system(raw.withColumn("turn_", first_turns(F.col("conversations"))))
    df = df.withColumns({"user": F.col("turn_.user"), "assistant": F.col("turn_.assistant")}).drop("turn_", "conversations")
    df = df.withColumn("refusal", (~classify.is_function_call(F.col("assistant"))).cast("int"))
    return df.withColumn("prompt_token_length", tokens.token_length(render_prompt(F.col("system"), F.col("user"), F.col("assistant"), F.col("tools")), tokenizer))


def within(df: DataFrame, most: int = MAX_TOKENS, column: str = "prompt_token_length") -> DataFrame:
    return df.where(F.col(column) <= most)


def perturbed_parameters(processed: DataFrame, key: str, *, train: float = 0.20, test: float = 0.50, seed: int = 42) -> DataFrame:
    """Split, then a share of each split's eligible rows renamed and reordered; a share of 0 leaves all as it was. Adds split, ablation_applied, parameter_mapping, text."""
    split = sample.train_test(processed, key, seed=seed)
    ranked = sample.global_rank(perturb.parameter_eligible(split).select(key, "split"), key, seed + 1, by=["split"], name="rank_", total="of_")
    most = F.when(F.col("split") == "train", sample.part_of("of_", train)).otherwise(sample.part_of("of_", test))
    chosen = ranked.where(F.col("rank_") <= most).select(F.col(key).alias("k_"))
    marked = split.join(chosen.withColumn("mode", F.lit("parameter_only")).hint("merge"), F.col(key) == F.col("k_"), "left").drop("k_").withColumn("mode", F.coalesce("mode", F.lit("none")))
    done = perturb.perturb(marked, key, seed + 3)
    return add_prompt(done.withColumnRenamed("applied", "ablation_applied").drop("mode", "function_mapping"))


def refusal_union(processed: DataFrame, annotated: DataFrame) -> DataFrame:
    """Answered JSON rows, annotated refusals with their description as the answer, and refusals without tools, by one set of columns."""
    common = lambda df, source, mode, refusal: df.withColumns({"ablation_mode": F.lit(mode), "parameter_mapping": F.lit("{}"), "function_mapping": F.lit("{}"), "source_dataset": F.lit(source), "refusal": F.lit(refusal)}).select("key", *COLUMNS, "ablation_mode", "parameter_mapping", "function_mapping", "source_dataset")
    answered = common(processed.where("refusal = 0 and tool_type = 'json'"), "non_refusal", "none", 0)
    described = annotated.withColumn("assistant", teacher.description_of(annotated)).where("assistant <> ''")
    bare = common(processed.where("refusal = 1 and tool_count = 0"), WITHOUT_TOOLS, WITHOUT_TOOLS, 1)
    return answered.unionByName(common(described, DESCRIBED, DESCRIBED, 1)).unionByName(bare)


def perturbed_modes(union: DataFrame, key: str, *, seed: int = 42) -> DataFrame:
    """Split; in train three bands of modes among eligible answered rows, in test one half perturbed both ways. Adds split, applied, text."""
    split = sample.train_test(union, key, seed=seed)
    eligible = perturb.mode_eligible(split)
    train = sample.bands(eligible.where("split = 'train'"), key, perturb.TRAIN_MODES, seed + 4, rest="none", name="band")
    test = sample.bands(eligible.where("split = 'test'"), key, {"parameter_and_function": perturb.EVAL_SHARE}, seed + 5, rest="none", name="band")
    plan = train.select(F.col(key).alias("k_"), "band").unionByName(test.select(F.col(key).alias("k_"), "band")).where("band <> 'none'")
    joined = split.join(plan.hint("merge"), F.col(key) == F.col("k_"), "left").drop("k_", "parameter_mapping", "function_mapping")
    marked = joined.withColumn("ablation_mode", F.coalesce("band", "ablation_mode")).withColumn("band", F.coalesce("band", F.lit("none")))
    return add_prompt(perturb.perturb(marked, key, seed + 6, mode="band").drop("band"))


def refusal_analysis(processed: DataFrame, key: str = "key") -> DataFrame:
    """Refusals with tools, with their class, tool bucket, described names and feasibility."""
    rows = processed.where("refusal = 1 and tool_count > 0").withColumn("names", extract.described_names("tools"))
    return rows.withColumns({
        "refusal_type": classify.refusal_class(F.col("assistant")), "tool_bucket": classify.tool_bucket(F.col("tool_count")),
        "feasibility": classify.feasibility(F.col("tool_type"), F.col("names"), F.col("assistant")),
    })


def annotation_plan(processed: DataFrame, key: str = "key", *, seed: int = 42, limit: int | None = None) -> DataFrame:
    """Eligible refusals by key, each with its mode, perturbed tools, mappings and the annotator's messages. A number in the order of
    keys would need all rows in one place, so source_index is the key itself, of whatever type."""
    rows = perturb.teacher_eligible(processed)
    rows = rows.orderBy(key).limit(limit) if limit else rows
    ranked = sample.bands(rows, key, perturb.TEACHER_MODES, seed + 7, name="ablation_mode")
    done = perturb.perturb(ranked, key, seed, mode="ablation_mode", none="original_refusal", always_reorder=False)
    return done.withColumn("source_index", F.col(key)).withColumn("teacher_prompt", teacher_messages(F.col("user"), F.col("tools")))


def annotate(plan: DataFrame, done: DataFrame, make_client: Callable, limits: Limits | None = None) -> DataFrame:
    """Asks for what has no result yet, repairs and validates it. The caller writes the result once, then counts. teacher_json holds the
    annotation as it came, so that a later run can repair and validate it anew."""
    todo = teacher.pending(plan, done)
    got = teacher.annotate(todo, make_client, limits=limits).withColumnsRenamed({"success": "teacher_success", "failed": "teacher_failed", "description": "teacher_description"})
    names = plan.withColumns({"tool_names": extract.function_names("tools"), "old_names": F.coalesce(F.map_keys(F.from_json("parameter_mapping", "map<string,string>")), F.array())})
    held = F.when(F.col("error").isNull(), F.struct(F.col("teacher_success").alias("success"), F.col("teacher_failed").alias("failed"), F.col("teacher_description").alias("description")))
    checked = teacher.check_annotations(got.withColumn("teacher_json", held).join(names.hint("merge"), "source_index"))
    return checked.withColumn("status", F.when(F.col("error").isNotNull(), "failed_parse_or_request").otherwise(F.col("status")))


#: Statuses that a resumed run of the tool asks for again.
RETRIED = ("invalid_schema", "failed_parse_or_request")
#: What a stored record has beside the plan's columns.
RECORD = f"raw string, status string, tool_names array<string>, old_names array<string>, teacher_json {teacher.ANNOTATION}, teacher_success {teacher.SUCCESS}, teacher_failed {teacher.FAILED}, teacher_description string, validation_errors array<string>, error string"


#: Jobs of a run at most. One that has more parts asks for several in a job, since a job for each would take most of the time.
WAVES = 20


def record_schema(plan: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema) + f", {RECORD}"


def taken_up(plan: DataFrame, ledger: Ledger) -> DataFrame:
    """Stored records under the plan's modes, repaired and validated anew, each in the bucket of its new status; `changed` where that is another."""
    again = teacher.refreshed(ledger.of_plan(plan, record_schema(plan)).withColumn("was_", F.col("status")))
    failed = F.col("error").isNotNull()
    again = again.withColumn("status", F.when(failed, F.col("was_")).otherwise(F.col("status")))
    return io.with_bucket(again.withColumn("changed", ~F.col("status").eqNullSafe(F.col("was_")))).drop("was_")


def annotate_in_parts(plan: DataFrame, make_client: Callable, folder: str, *, every: int = 10_000, retry: tuple[str, ...] = (), limits: Limits | None = None) -> int:
    """Annotates what of a plan has no record in `folder` under its planned mode, in parts of about `every` rows, each committed by itself.
    Up to WAVES parts are asked for one by one; of more, a WAVES-th at a time, which is what a run that breaks off may lose.

    The plan is evaluated once. Stored records are repaired and validated first; those whose status changes are appended anew, so
    the log tells what is valid now. Of `retry` statuses (RETRIED as the tool does it) records are asked for again. Which rows are pending is an anti join with the log, so a
    run that broke off goes on behind its last part whatever has become of the plan, and rows of other modes are stale. A key that the plan
    repeats is asked for once. Returns how many parts were asked for; `Ledger.of_plan` has the records that count.
    """
    spark = plan.sparkSession
    ledger, at = Ledger(spark, folder, key=plan.schema["source_index"].dataType.simpleString()), io.scratch(spark, "plan")
    ledger.sweep()
    plan = io.written(plan.dropDuplicates(["source_index"]), f"{at}/all")
    if ledger.parts():
        changed = io.written(taken_up(plan, ledger).where("changed").drop("part", "bucket", "changed"), f"{at}/changed")
        if not changed.isEmpty():
            ledger.append(changed)
    pending, counts = report.counting(ledger.pending(plan, retry))
    todo = io.written(pending, f"{at}/pending")
    parts = -(-counts()["rows"] // every)
    # a folder for each part, so that none reads another's rows
    mine = todo.withColumn("part_", F.pmod(F.xxhash64("source_index"), F.lit(max(parts, 1))).cast("int"))
    mine.repartition("part_").write.partitionBy("part_").parquet(f"{at}/parts")
    wave = -(-parts // WAVES)
    for i in range(0, parts, max(wave, 1)):
        here = [p for p in (f"{at}/parts/part_={j}" for j in range(i, min(i + wave, parts))) if io.exists(spark, p)]
        if here:
            rows = spark.read.schema(mine.schema).option("basePath", f"{at}/parts").parquet(*here)
            rows = rows.repartition(spark.sparkContext.defaultParallelism)  # as many tasks ask as there are cores, unless limits say otherwise
            ledger.append_parts(annotate(rows, rows.select("source_index").limit(0), make_client, limits), "part_")
    io.delete(spark, at)
    return parts


def shuffled_prompts(df: DataFrame, key: str, *, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Of rendered prompts (text) round(all * ratio) of those with a tool list get its keys in another order; adds changed."""
    able = df.where(F.col("text").contains("[") & perturb.has_prompt_tools("text"))
    chosen = sample.sample_of_total(able, key, df.count(), ratio, seed).select(F.col(key).alias("k_"))
    marked = df.join(chosen.hint("merge"), F.col(key) == F.col("k_"), "left")  # a share of all keys is nothing to collect
    done = marked.where("k_ is not null").withColumn("s_", perturb.shuffle_prompt("text", perturb.row_seed(F.col(key), seed + 1)))
    done = done.withColumn("text", F.col("s_.text")).withColumn("changed", F.col("s_.changed")).drop("s_", "k_")
    return done.unionByName(marked.where("k_ is null").drop("k_").withColumn("changed", F.lit(False)))


def retokenized(df: DataFrame, *, most: int = MAX_TOKENS, pad: int = 0, tokenizer: tokens.Tokenizer = tokens.default_tokenizer) -> DataFrame:
    """Prompts (text) that fit, as padded tensors with answer labels."""
    fit = df.where(tokens.token_length(F.col("text"), tokenizer) <= most)
    return tokens.add_tensors(fit, "text", length=most, pad=pad, head=tokenizer(header("assistant")), end=tokenizer(EOT), tokenizer=tokenizer)


def count_values(df: DataFrame, column: str | Column) -> DataFrame:
    return report.frequency(df, column).select("value", "n", "ratio")
