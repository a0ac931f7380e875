"""Column functions of issue texts and labels. All stay in the JVM, but for the exact case folding of the text hash."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space of the text model, label names, and the cells that count as missing in CSV input.
SPACE = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
STAGE1 = ("BUG", "ENHANCEMENT", "QUESTION", "DOCUMENTATION")
STAGE2 = ("BOH", "MAN")
STAGE3 = ("ARB", "NAM")
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def clean_text(c: Column) -> Column:
    """Null is empty; runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"{SPACE}+", " "))


def issue_text(title: Column, body: Column) -> Column:
    return F.concat(F.lit("[TITLE]\n"), title, F.lit("\n\n[DESCRIPTION]\n"), body)


def inference_text(title: Column, description: Column) -> Column:
    """As issue_text, but the parts are only stripped: inner white space stays."""
    return issue_text(strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(description, F.lit(""))))


def canonical_label(c: Column) -> Column:
    x = F.lower(clean_text(c))
    return (
        F.when((x == "bug") | x.startswith("bug,") | x.contains(" bug"), "BUG")
        .when(x.contains("feature") | x.contains("enhancement"), "ENHANCEMENT")
        .when(x.contains("question"), "QUESTION")
        .when(x.contains("doc"), "DOCUMENTATION")
    )


def binary_label(c: Column) -> Column:
    return F.when(c == "BUG", "BUG").otherwise("NON_BUG")


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


def text_hash(c: Column) -> Column:
    """SHA-256 of the case-folded, space-collapsed text."""
    return F.sha2(casefold(clean_text(c)), 256)


def internal_id(source_id: Column, digest: Column) -> Column:
    return F.concat(source_id, F.lit(":"), F.substring(digest, 1, 16))


def fold_stage2(c: Column) -> Column:
    return F.when(c.isin(*STAGE3), "MAN").otherwise(c)


def safe_name(c: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "-"), "^[-.]+|[-.]+$", "")
    return F.when(x != "", x).otherwise("split")


def abstain(label: Column, probabilities: Column, threshold: float) -> Column:
    if not 0 <= threshold < 1:
        raise ValueError("threshold must be in [0, 1)")
    return F.when(F.array_max(probabilities) >= threshold, label).otherwise("ABSTAIN")


def argmax_label(scores: Column, labels: list[str]) -> Column:
    """The label of the first greatest score."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(scores, F.array_max(scores)).cast("int"))


def final_label(stage1: Column, stage2: Column, stage3: Column) -> Column:
    return F.coalesce(F.nullif(stage3, F.lit("")), F.nullif(stage2, F.lit("")), stage1)


def route(stage1: Column, stage2: Column, stage3: Column) -> Column:
    """The label of the hierarchy, or an error for a combination that it doesn't allow."""
    def bad(what: str, c: Column) -> Column:
        return F.raise_error(F.concat(F.lit(what), F.coalesce(c, F.lit("null")))).cast("string")

    deep = F.when(stage3.isin(*STAGE3), stage3).otherwise(bad("illegal stage 3 label: ", stage3))
    middle = F.when(stage2 == "BOH", F.lit("BOH")).when(stage2 == "MAN", deep).otherwise(bad("illegal stage 2 label: ", stage2))
    known = stage1.isin(*STAGE1)
    return F.when(stage1 == "BUG", middle).when(known, stage1).otherwise(bad("illegal stage 1 label: ", stage1))


def crc_tokens(c: Column, max_length: int) -> Column:
    """Start mark 1, a code for each piece between white space, end mark 2; at most max_length in all."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), f"{SPACE}+"), lambda x: x != "")
    ids = F.transform(F.slice(words, 1, max(0, max_length - 2)), lambda x: (F.crc32(F.encode(x, "UTF-8")) % 30000 + 3).cast("int"))
    return F.concat(F.array(F.lit(1)), ids, F.array(F.lit(2)))
