"""Regex rewriting with a column expression per match, kept inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.bind import bind


def rewrite(c: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``change(match)``.

    The text between matches and the matches themselves are two arrays that are zipped back
    together; rows without a match skip both.
    """

    def joined(text: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: change(m))
        found = F.concat(matches, F.array(F.lit("")))
        pairs = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.concat(gap, m))
        return F.when(text.rlike(pattern), F.array_join(pairs, "")).otherwise(text)

    return bind(c, joined)
