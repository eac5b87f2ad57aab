"""The pipelines from a command line: python -m kilnwork COMMAND --help. Tables are Parquet, or Arrow folders where a path ends in .arrow.

    structure   raw conversations to the seven columns, those that fit, and a report
    perturb     parameters renamed and reordered in a share of the answered rows
    annotate    refusals annotated by an outside model, in parts that a later run takes up
    shuffle     the tool lists of a share of rendered prompts in another order
    retokenize  prompts that fit as padded tensors with answer labels
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import report, teacher, tokens
from .operators.endpoint import Limits, chat_client
from .plans import pipelines
from .session import session
from .sources import io
from .sources.arrow import read_arrow
from .sources.ledger import Ledger


def read(spark: SparkSession, path: str) -> DataFrame:
    return read_arrow(spark, path) if path.rstrip("/").endswith(".arrow") else io.read_dataset(spark, path)


def tokenizer_of(args: argparse.Namespace) -> tokens.Tokenizer:
    return tokens.file_tokenizer(args.tokenizer, special=args.special_tokens) if args.tokenizer else tokens.default_tokenizer


def must_be_free(spark: SparkSession, path: str) -> None:
    """Before anything is computed."""
    if io.exists(spark, path):
        raise SystemExit(f"{path} exists already")


def structure(spark: SparkSession, args: argparse.Namespace) -> dict:
    all_ = pipelines.structure(read(spark, args.source), tokenizer=tokenizer_of(args))
    at = io.scratch(spark, "structured")
    all_ = io.written(all_, at)  # for the report and for the rows that stay
    kept = pipelines.within(all_, args.max_seq_length)
    io.save_dataset(kept, f"{args.output}/train")
    io.save_readable(kept, f"{args.output}/readable")
    got = report.dataset_report(all_, kept, "prompt_token_length")
    io.delete(spark, at)
    return got


def perturb(spark: SparkSession, args: argparse.Namespace) -> dict:
    done = pipelines.perturbed_parameters(read(spark, args.source), args.key, train=args.train_share, test=args.test_share, seed=args.seed)
    at = io.scratch(spark, "perturbed")
    done = io.written(done, at)
    frames = {s: done.where(F.col("split") == s) for s in ("train", "test")}
    got = report.write_all(frames, {s: f"{args.output}/{s}" for s in frames}, lambda df, path: io.save_dataset(df, path), {s: "ablation_applied" for s in frames})
    io.delete(spark, at)
    return got


def annotate(spark: SparkSession, args: argparse.Namespace) -> dict:
    plan = pipelines.annotation_plan(read(spark, args.source), args.key, seed=args.seed, limit=args.limit or None)
    ledger = Ledger(spark, args.output, key=plan.schema["source_index"].dataType.simpleString())
    if ledger.parts() and not args.resume:
        raise SystemExit(f"{args.output} holds results of an earlier run; pass --resume to go on from them")
    if args.dry_run:
        ledger.append(teacher.dry_run(plan))
    else:
        if not args.base_url or not args.model:
            raise SystemExit("an endpoint and a model are needed: --base-url and --model, or --dry-run")
        key, url, model, options = os.environ.get(args.key_variable) if args.key_variable else None, args.base_url, args.model, {"temperature": args.temperature, "max_tokens": args.max_tokens, "timeout": args.timeout}
        limits = Limits(in_flight=args.workers, timeout=args.timeout, tries=args.tries, tokens_per_minute=args.tokens_per_minute, tasks=args.tasks)
        pipelines.annotate_in_parts(plan, lambda: chat_client(url, model, key, **options), args.output, every=args.flush_every, retry=pipelines.RETRIED, limits=limits)
    kept = io.with_bucket(ledger.of_plan(plan, pipelines.record_schema(plan)))
    valid = kept.where("bucket = 'valid'")
    if not valid.isEmpty():
        io.save_dataset(teacher.dataset(valid), f"{args.output}/dataset")
    return {"parts": len(ledger.parts()), "planned": plan.count(), "buckets": {r.bucket: r["count"] for r in kept.groupBy("bucket").count().collect()}}


def shuffle(spark: SparkSession, args: argparse.Namespace) -> dict:
    must_be_free(spark, args.output)
    done = pipelines.shuffled_prompts(read(spark, args.source), args.key, ratio=args.ratio, seed=args.seed)
    return report.write_all({"rows": done}, {"rows": args.output}, lambda df, path: io.save_dataset(df, path, overwrite=False), {"rows": "changed"})


def retokenize(spark: SparkSession, args: argparse.Namespace) -> dict:
    must_be_free(spark, args.output)
    done = pipelines.retokenized(read(spark, args.source), most=args.max_seq_length, tokenizer=tokenizer_of(args))
    return report.write_all({"rows": done}, {"rows": args.output}, lambda df, path: io.save_dataset(df, path, overwrite=False))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("kilnwork", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def add(f, *options: tuple[str, dict]) -> None:
        p = commands.add_parser(f.__name__)
        p.set_defaults(run=f)
        for name in ("--source", "--output"):
            p.add_argument(name, required=True)
        p.add_argument("--metadata", help="a file for the report that is printed")
        p.add_argument("--config", help="a configuration file; its section of this command's name sets defaults")
        for name, how in options:
            p.add_argument(name, **how)

    key, seed, most = ("--key", {"default": "key"}), ("--seed", {"type": int, "default": 42}), ("--max-seq-length", {"type": int, "default": pipelines.MAX_TOKENS})
    reading = ("--tokenizer", {"help": "a tokenizer's file"}), ("--special-tokens", {"action": "store_true"})
    share = lambda x: {"type": float, "default": x}
    number = lambda x: {"type": int, "default": x}
    add(structure, most, *reading)
    add(perturb, key, seed, ("--train-share", share(0.20)), ("--test-share", share(0.50)))
    add(
        annotate, key, seed, ("--limit", number(0)), ("--dry-run", {"action": "store_true"}), ("--resume", {"action": "store_true"}), ("--model", {}), ("--base-url", {}), ("--key-variable", {"help": "the environment variable that holds the endpoint's key"}),
        ("--temperature", share(0.0)), ("--max-tokens", number(2048)), ("--timeout", share(120.0)), ("--workers", number(4)), ("--tries", number(3)), ("--tokens-per-minute", {"type": float}), ("--tasks", {"type": int}), ("--flush-every", number(10_000)),
    )
    add(shuffle, key, seed, ("--ratio", share(0.2)))
    add(retokenize, most, *reading)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    if args.config:
        given = config.with_profile(config.load(args.config)).get(args.command, {})
        top = parser()
        next(a for a in top._actions if isinstance(a, argparse._SubParsersAction)).choices[args.command].set_defaults(**{k.replace("-", "_"): v for k, v in given.items()})
        args = top.parse_args(argv)
    got = args.run(spark or session(), args)
    if args.metadata:
        report.save_json(got, args.metadata)
    print(json.dumps(got, ensure_ascii=False))
    return got


if __name__ == "__main__":
    main(sys.argv[1:])
