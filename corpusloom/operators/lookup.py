"""Joins of a wide table with a dimension, whatever share of the rows asks for one entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries up to which a dimension is broadcast, and copies of a larger one.
ENTRIES, SALTS = 200_000, 32


def lookup(wide: DataFrame, entries: DataFrame, on: str, how: str = "left", most: int = ENTRIES) -> DataFrame:
    """``wide`` joined with at most one entry per row by ``on``.

    The entries are counted first. Up to ``most`` they are broadcast and ``wide`` is not shuffled;
    beyond, both sides are shuffled by key and salt, so that rows with one key (or none) are dealt
    over SALTS partitions. ``how``: left or inner.
    """
    if entries.limit(most + 1).count() <= most:
        return wide.join(F.broadcast(entries), on, how)
    copies = entries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # any salt finds the same entry, so a task that is run again may draw others
    salted = wide.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")
