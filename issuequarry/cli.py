"""Command line: archives, preparation, checks, samples, bundles, training and evaluation runs. Results are printed as JSON."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from issuequarry.session import get_session, shared_dir


RUNS = ("train-tfidf", "train-stage1", "evaluate-stage1", "train-stage2", "train-stage3", "train-dapt", "evaluate-hierarchy")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="issuequarry")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("inspect-archive")
    a.add_argument("archive")
    a = sub.add_parser("prepare")
    a.add_argument("--train-archive", required=True), a.add_argument("--test-archive", required=True), a.add_argument("--output-dir", default="data"), a.add_argument("--sample-dir")
    a.add_argument("--validation-fraction", type=float, default=0.15), a.add_argument("--sample-size", type=int, default=20_000), a.add_argument("--seed", type=int, default=42)
    a = sub.add_parser("validate-data")
    a.add_argument("path")
    a = sub.add_parser("create-sample")
    a.add_argument("--input", required=True), a.add_argument("--output", required=True), a.add_argument("--size", type=int, default=20_000), a.add_argument("--seed", type=int, default=42)
    a = sub.add_parser("bundle")
    a.add_argument("directory"), a.add_argument("destination")
    a = sub.add_parser("benchmark-tokens")
    a.add_argument("--input", required=True), a.add_argument("--mode", choices=("native", "python"), default="native"), a.add_argument("--max-length", type=int, default=256)
    sub.add_parser("version")
    for name in RUNS:
        a = sub.add_parser(name)
        for flag in ("config", "data-dir", "train", "validation", "test", "model-path", "checkpoint"):
            a.add_argument(f"--{flag}")
        a.add_argument("--output-dir", default="outputs"), a.add_argument("--threshold", type=float, default=0.0)
        for flag in ("max-train-samples", "max-eval-samples", "max-steps"):
            a.add_argument(f"--{flag}", type=int)
    return p


def run(args: argparse.Namespace, spark) -> object:
    """The command's result, ready for JSON."""
    from issuequarry import monitor
    from issuequarry.operators import data as D
    from issuequarry.operators import sampling as S
    from issuequarry.plans import models, prepare, training
    from issuequarry.sources import archive, tables

    splits = {"data_dir": getattr(args, "data_dir", None), "train": getattr(args, "train", None), "validation": getattr(args, "validation", None), "config": getattr(args, "config", None)}
    match args.command:
        case "inspect-archive":
            return archive.inspect_archive(spark, args.archive, f"{shared_dir(spark)}/staging")
        case "prepare":
            return prepare.prepare(spark, args.train_archive, args.test_archive, args.output_dir, f"{shared_dir(spark)}/staging", args.sample_dir, args.validation_fraction, args.sample_size, args.seed)
        case "validate-data":
            whole = (Path(args.path) / "test.parquet").exists()
            return prepare.validate_variants(spark, args.path) if whole else {"rows": D.validate(spark.read.parquet(args.path))}
        case "create-sample":
            source = spark.read.parquet(args.input)
            D.validate(source)
            tables.write_table(S.balanced_sample(source, args.size, seed=args.seed), args.output, 1)
            return {"output": args.output, "rows": spark.read.parquet(args.output).count()}
        case "bundle":
            return tables.bundle(args.directory, args.destination)
        case "benchmark-tokens":
            return monitor.token_benchmark(spark, args.input, args.mode, args.max_length)
        case "train-tfidf":
            return training.run_tfidf(spark, args.output_dir, **splits, max_train_samples=args.max_train_samples, max_eval_samples=args.max_eval_samples)
        case "train-stage1" | "train-stage2" | "train-stage3":
            return training.run_stage(spark, args.command[6:], args.output_dir, **splits, max_train_samples=args.max_train_samples, max_eval_samples=args.max_eval_samples, max_steps=args.max_steps)
        case "train-dapt":
            return training.run_pretraining(spark, args.train, args.output_dir, args.config)
        case "evaluate-stage1":
            if not args.model_path or not args.test:
                raise ValueError("--model-path and --test are needed")
            scored = models.LinearTextModel.load(spark, args.model_path).predict(models.require_model_text(spark.read.parquet(args.test)))
            return models.evaluate(scored, "canonical_label", args.output_dir)
        case "evaluate-hierarchy":
            if not args.test:
                raise ValueError("--test is needed")
            return models.evaluate_hierarchy(tables.read_columns(spark, args.test, ["final_label", "prediction"]), args.output_dir)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    if args.command == "version":
        from issuequarry.monitor import versions

        out: object = versions()
    else:
        out = run(args, get_session("issuequarry-cli"))
    print(json.dumps(out, indent=2, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
