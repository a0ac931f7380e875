"""What a run used: versions, memory of the driver, and a benchmark of the two ways to make tokens. Figures that a system doesn't give are None."""

from __future__ import annotations

import logging
import sys
import time
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)


def versions() -> dict[str, str]:
    from issuequarry import __version__
    from issuequarry.plans.training import version_of

    return {"python": sys.version.split()[0], "issuequarry": __version__, **{p: version_of(p) for p in ("pyspark", "pyarrow", "pandas", "numpy")}}


def memory() -> dict[str, int | None]:
    """Bytes of this process: resident now, resident at most, and held by Arrow."""
    out: dict[str, int | None] = dict.fromkeys(("rss", "peak_rss", "arrow"))
    try:
        with open("/proc/self/status", encoding="ascii", errors="replace") as f:
            for line in f:
                for name, key in (("VmRSS:", "rss"), ("VmHWM:", "peak_rss")):
                    if line.startswith(name):
                        out[key] = int(line.split()[1]) * 1024
    except OSError:
        pass
    try:
        import pyarrow as pa

        out["arrow"] = pa.total_allocated_bytes()
    except ImportError:
        pass
    return out


def log_memory(stage: str, **rows: int) -> dict[str, Any]:
    """Logs and returns the memory at a stage of a run, with the row counts that are known there."""
    m = memory()
    shown = ", ".join(f"{k} {'unknown' if v is None else f'{v / 2**30:.3f} GiB'}" for k, v in m.items())
    LOG.info("%s: %s%s", stage, shown, "".join(f", {k} {v}" for k, v in rows.items()))
    return {"stage": stage, **m, **rows}


def token_benchmark(spark: SparkSession, path: str, mode: str = "native", max_length: int = 256) -> dict[str, Any]:
    """Seconds and memory of making the benchmark tokens of a table's texts, by JVM expressions or in Python batches; nothing is kept."""
    import zlib

    from issuequarry.operators import tokens as K
    from issuequarry.sources.tables import read_columns

    df = read_columns(spark, path, ["text"]).withColumn("row_id", F.monotonically_increasing_id()).withColumn("label", F.lit("x")).filter("trim(text) <> ''")

    def make():
        return lambda texts: [[1, *(3 + zlib.crc32(w.encode()) % 30000 for w in t.split()[: max_length - 2]), 2] for t in texts]

    began = time.time()
    out = K.tokenized(df, "row_id", {"x": 0}, max_length, make if mode == "python" else None, label="label")
    r = out.agg(F.count("*").alias("rows"), F.sum(F.size("input_ids")).alias("tokens")).first()
    return {"mode": mode, "rows": r.rows, "tokens": r.tokens, "elapsed_seconds": round(time.time() - began, 3), **memory()}
