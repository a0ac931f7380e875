"""Clean names: surrounding white space removed, lower case; null and blank names are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def clean_name(c: Column) -> Column:
    x = F.lower(trimmed(c))
    return F.when(x != "", x)


def digest_bits(c: Column, digits: int = 15) -> Column:
    """The first hexadecimal digits of md5 as a whole number (4 bits each, at most 60): a random order that other systems can reproduce."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, digits), 16, 10).cast("bigint")
