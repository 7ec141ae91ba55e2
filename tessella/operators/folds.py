"""A state carried over the items of an array, item by item, inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items folded at once: a fold copies what it has gathered, so long arrays are folded run by run.
RUN = 256


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], run: int = RUN) -> Column:
    """The state after every item: ``step(state, item)`` from ``zero`` on; null items give a null array."""

    def along(states: Column, part: Column) -> Column:
        return F.aggregate(part, states, lambda gathered, item: F.concat(gathered, F.array(step(F.element_at(gathered, -1), item))))

    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(run)))
    parts = F.transform(starts, lambda i: F.slice(items, i, run))
    runs = F.aggregate(parts, F.array(F.array(zero)), lambda done, part: F.concat(done, F.array(along(F.array(F.element_at(F.element_at(done, -1), -1)), part))))
    states = F.flatten(F.transform(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), lambda r: F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))))
    return F.when(items.isNotNull(), F.coalesce(states, F.slice(F.array(zero), 1, 0)))
