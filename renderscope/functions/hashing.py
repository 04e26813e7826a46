"""Seeded pseudo-random keys that any SQL engine reproduces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int | str, *parts: Column) -> Column:
    """60-bit integer from the md5 of ``seed:part:..``; the order of a shuffle."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
