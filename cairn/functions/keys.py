"""Seeded order keys and uniforms from md5, equal on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(*parts) -> Column:
    """32 hex digits of the parts joined by colons; sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def uniform(*parts) -> Column:
    """A double in [0, 1): the first 52 bits of order_key."""
    return F.conv(F.substring(order_key(*parts), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
