"""Deterministic pseudo-random keys that other engines can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*columns: Column | str, seed: str = "") -> Column:
    """MD5 hex of the columns' text, used where an arbitrary but stable order is wanted."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    text = F.concat(F.lit(seed), *[p.cast("string") for p in parts])
    return F.md5(text)


def digest_id(*columns: Column | str) -> Column:
    """A 60-bit row id from the digest: the same on every run and every retry."""
    return F.conv(F.substring(digest(*columns), 1, 15), 16, 10).cast("bigint")
