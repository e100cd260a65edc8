"""Array expressions that stay linear on long arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.transform(F.array(value), use)[0]


def running_sum(values: Column) -> Column:
    """Inclusive running sums of an array of longs, in chunks so that long arrays take nearly linear time."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def over(chunks: Column) -> Column:
        start = F.array(F.lit(0).cast("long"))
        offsets = F.aggregate(chunks, start, lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + total(c))))
        within = lambda o: F.flatten(F.transform(chunks, lambda c, k: F.transform(c, lambda _, i: o[k] + total(F.slice(c, F.lit(1), i + 1)))))
        return let(offsets, within)

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))

    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), over)).otherwise(F.array().cast("array<bigint>")))
