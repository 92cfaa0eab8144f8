"""Stable, engine-independent hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_bucket(c: str | Column, n: int) -> Column:
    """First 32 bits of md5(text of c), as an unsigned number, modulo ``n``.
    Equal in any engine that has md5: ('0x' || substr(md5(x), 1, 8))::BIGINT % n."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")
            % F.lit(n)).cast("bigint")


def md5_key(c: str | Column, seed: str | int) -> Column:
    """md5 of '<c>:<seed>' — a reproducible pseudo-random sort key."""
    c = F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))
