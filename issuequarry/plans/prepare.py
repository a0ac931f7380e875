"""The preparation plan: archives to five split tables, a development sample and a manifest."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuequarry.operators import data as D
from issuequarry.operators import sampling as S
from issuequarry.session import Scratch
from issuequarry.sources import archive as A
from issuequarry.sources import tables as IO


SPLITS = ("train_benchmark", "validation", "train_clean", "validation_clean", "test")


def prepare_frames(train: DataFrame, test: DataFrame, share: float = 0.15, seed: int = 42) -> tuple[dict[str, DataFrame], dict]:
    """The split tables and their facts. train and test are harmonised, with the ordinal row_id; test is never changed."""
    scratch = Scratch(train.sparkSession, "prepare")
    kept = scratch.keep(D.unique_ids(D.keep_first(train)))
    clean = scratch.keep(D.without_overlap(kept, test))
    bench, how = S.make_validation_split(kept, share, seed, issue="issue_id")
    bench = scratch.keep(bench)
    parts, how_clean = S.make_validation_split(clean, share, seed, issue="issue_id")
    parts = scratch.keep(parts)
    out = {
        "train_benchmark": bench.filter("split = 'train'").drop("split"), "validation": bench.filter("split = 'validation'").drop("split"),
        "train_clean": parts.filter("split = 'train'").drop("split"), "validation_clean": parts.filter("split = 'validation'").drop("split"), "test": test,
    }
    before, after, cleaned = train.count(), kept.count(), clean.count()
    facts = {
        "train_rows": before, "duplicates_removed": before - after, "train_rows_removed_for_test_overlap": after - cleaned, "test_rows_overlapping": D.overlap(kept, test).count(),
        "test_rows_overlapping_after_cleaning": D.overlap(out["train_clean"], test).count(),
        "split_strategy": how, "clean_split_strategy": how_clean, "rows_with_shared_source_id": D.shared_ids(D.keep_first(train)).first()[0],
    }
    return out, facts


def table_statistics(df: DataFrame) -> dict:
    """Rows, sorted class counts, and distinct repositories and repeated hashes where there are such columns."""
    have = {c: c in df.columns for c in ("repository", "text_hash")}
    r = D.statistics(df.withColumns({c: F.lit(None).cast("string") for c, there in have.items() if not there})).first()
    return {
        "rows": r.rows, "class_counts": {x.canonical_label: x.n for x in D.sorted_class_counts(df).collect()},
        "repositories": r.repositories if have["repository"] else None, "duplicate_hashes": r.duplicate_hashes if have["text_hash"] else None,
    }


def checksums(spark: SparkSession, output: str, names: tuple[str, ...]) -> dict[str, str]:
    """SHA-256 of each file, or of a table folder over the sorted digests of its parts, which are computed where the parts are."""
    out = {}
    for n in names:
        p = Path(output) / n
        if p.is_dir():
            parts = IO.sha256_of_table(spark, str(p)).filter(F.col("path").endswith(".parquet")).agg(F.array_join(F.array_sort(F.collect_list("digest")), "").alias("x"))
            out[n] = parts.select(F.sha2("x", 256)).first()[0]
        else:
            out[n] = IO.sha256_of(p)
    return out


def prepare(spark: SparkSession, train_archive: str, test_archive: str, output: str, staging: str, sample: str | None = None, share: float = 0.15, sample_size: int = 20_000, seed: int = 42) -> dict:
    """Five split tables, each checked before it is written, the overlap with the test as a table, label_mapping.json, dataset_statistics.json and data_manifest.json."""
    train, found_train = A.read_archive(spark, train_archive, staging)
    test, found_test = A.read_archive(spark, test_archive, staging)
    scratch = Scratch(spark, "prepare-in")
    train, test = scratch.keep(train), scratch.keep(test)
    splits, facts = prepare_frames(train, test, share, seed)
    stats = {}
    D.checked_apart(splits["train_clean"], test)
    for name, df in splits.items():
        D.validate(df)
        IO.write_table(df, Path(output) / f"{name}.parquet")
        stats[name] = table_statistics(spark.read.parquet(str(Path(output) / f"{name}.parquet")))
    both = D.overlap(train, test).select("issue_id", "text_hash")
    IO.write_table(both, Path(output) / "test_overlap.parquet")  # may be large, so it isn't part of the manifest
    if sample:
        IO.write_table(S.balanced_sample(spark.read.parquet(str(Path(output) / "train_clean.parquet")), sample_size, seed=seed), Path(sample) / "development.parquet", 1)
    labels = {r[0].lower(): r[0] for r in D.union_outer(splits["train_benchmark"], splits["validation"]).select("canonical_label").distinct().filter(F.col("canonical_label").isNotNull()).collect()}
    IO.write_json(Path(output) / "label_mapping.json", labels)
    IO.write_json(Path(output) / "dataset_statistics.json", {**stats, **facts})
    files = (*[f"{n}.parquet" for n in SPLITS], "test_overlap.parquet", "label_mapping.json", "dataset_statistics.json")
    manifest = {
        "archives": {a: IO.sha256_of(a) for a in (train_archive, test_archive)}, "files": checksums(spark, output, files), "discovery": {"train": found_train, "test": found_test},
        "rows": {n: s["rows"] for n, s in stats.items()}, "seed": seed, "overlap": "test_overlap.parquet", **facts,
    }
    IO.write_json(Path(output) / "data_manifest.json", manifest)
    return manifest


def validate_variants(spark: SparkSession, directory: str) -> dict[str, int]:
    """Raises if a split is invalid or splits share hashes or ids they must not share."""
    d = {n: spark.read.parquet(str(Path(directory) / f"{n}.parquet")) for n in SPLITS}
    bad = [r.check for r in D.variant_checks(d).filter("violations > 0").collect()]
    bad += [r.check for r in D.variant_checks({"train_clean": d["train_benchmark"], "validation_clean": d["validation"], "test": d["validation"].limit(0)}).filter("violations > 0 AND check LIKE '%issue_id'").collect()]
    if bad:
        raise ValueError(f"splits overlap: {bad}")
    return {n: D.validate(x) for n, x in d.items()}
