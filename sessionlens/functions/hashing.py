"""Numbers from hashes: the same under any partitioning, in any engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Leading hexadecimal digits of the hash that make the uniform number (52 bits: exact in a double).
HASH_DIGITS = 13


def hash_uniform(*cols: Column) -> Column:
    """Deterministic uniform [0, 1) from the MD5 of the columns' texts, joined by colons."""
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double") / F.lit(float(16 ** HASH_DIGITS))
