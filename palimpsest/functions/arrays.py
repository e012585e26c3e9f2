"""Sums along arrays, in columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def running_sums(sizes: Column) -> Column:
    """Sums of all sizes up to each place.

    An append copies the array, so sums run within blocks of the square root of the number of
    places, and blocks are then moved by the sums before them.
    """
    none = F.array().cast("array<int>")

    def append(sums: Column, x: Column) -> Column:
        return F.concat(sums, F.array(F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0)) + x))

    def over(own: Column, n: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: F.slice(own, b * width + 1, width))
        return let(F.transform(blocks, lambda block: F.aggregate(block, none, append)), moved)

    def moved(within: Column) -> Column:
        totals = F.transform(within, lambda sums: F.get(sums, F.size(sums) - 1))
        before = F.aggregate(F.slice(totals, 1, F.size(totals) - 1), F.array(F.lit(0)), append)
        return F.flatten(F.zip_with(within, before, lambda sums, more: F.transform(sums, lambda x: x + more)))

    return let(sizes, lambda own: F.when(F.size(own) > 0, over(own, F.size(own), F.ceil(F.sqrt(F.size(own))).cast("int"))).otherwise(none))
