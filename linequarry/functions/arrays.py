"""Sequential passes over an array column that stay linear in its length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that are put in line together.
RUN = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once."""
    return F.transform(F.array(value), use)[0]


def prefix_sums(sizes: Column) -> Column:
    """For each number of an array<int> the sum of those before it. Arrays are appended to in runs of RUN items only."""
    none = F.array().cast("array<int>")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    runs = lambda some: F.transform(F.sequence(F.lit(0), F.floor((F.size(some) - 1) / RUN).cast("int")), lambda k: F.slice(some, k * RUN + 1, RUN))

    def inside(run: Column, at: Column) -> Column:
        return F.aggregate(run, state(at, none), lambda s, n: state(s["at"] + n, F.concat(s["out"], F.array(s["at"]))))["out"]

    def whole(cut: Column) -> Column:
        return F.flatten(F.zip_with(cut, inside(F.transform(cut, lambda run: F.aggregate(run, F.lit(0), lambda a, n: a + n)), F.lit(0)), inside))

    return let(sizes, lambda some: F.when(F.size(some) == 0, none).when(F.size(some) <= RUN, inside(some, F.lit(0))).otherwise(let(runs(some), whole)))
