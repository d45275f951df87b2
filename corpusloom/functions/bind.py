"""Name an intermediate value inside an expression; running values of an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used twice in an expression, or inside a lambda over array elements, is evaluated
    once per use; a lambda variable is not. The value is therefore passed as the only element
    of an array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over the first elements up to each, for an associative ``op``. Each round doubles how far
    an element has looked back, so n elements take log n rounds and nothing is copied per element."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1)

    def doubled(acc: Column, k: Column) -> Column:
        return bind(F.pow(F.lit(2), k).cast("int"), lambda far: F.transform(acc, lambda x, i: F.when(i >= far, op(F.get(acc, i - far), x)).otherwise(x)))

    return F.aggregate(rounds, values, doubled)


#: Elements that ``prefixes`` goes through one after the other.
BLOCK = 64


def prefixes(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """As ``running``, for an ``op`` that is exact in any grouping (whole numbers, least, greatest).

    Elements are combined one after the other within blocks of BLOCK, the blocks' last values by
    ``running``: some n steps for n elements, and an element is copied within its block only."""

    def within(part: Column) -> Column:
        rest = F.slice(part, F.lit(2), F.lit(BLOCK))
        return F.aggregate(rest, F.slice(part, 1, 1), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def joined(parts: Column) -> Column:
        lasts = running(F.transform(parts, lambda p: F.element_at(p, -1)), op)
        onto = lambda p, before: F.transform(p, lambda x: op(before, x))
        moved = lambda far: F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(bind(F.get(far, k - 1), lambda b: onto(p, b))))
        return F.when(F.size(parts) == 1, parts[0]).otherwise(F.flatten(bind(lasts, moved)))

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        parts = F.transform(starts, lambda b: bind(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), within))
        return F.when(F.size(v) == 0, v).otherwise(bind(parts, joined))

    return bind(values, blocks)
