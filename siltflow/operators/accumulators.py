"""Typed accumulators as aggregates: number, average, min-max, set, map, buffer, boolean, bit mask, trigger.

Each gives Columns for groupBy().agg(), or, with running=True, over a window: the state after
each record.  Sets, maps and buffers hold what their meaning asks, a key's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def number(delta: Column) -> Column:
    """Running total of increments (negative to decrement); 0 when empty."""
    return F.coalesce(F.sum(delta), F.lit(0))


def average(x: Column) -> Column:
    """0.0 when empty."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def min_max(x: Column) -> Column:
    return F.struct(F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("count"))


def set_of(x: Column, deleted: Column | None = None, order: Column | None = None) -> Column:
    """Sorted distinct values; with `deleted`, those whose last record in order didn't delete them."""
    if deleted is None:
        return F.sort_array(F.collect_set(x))
    return F.array_sort(F.map_keys(F.map_filter(_last(x, ~deleted, order), lambda _, keep: keep)))


def map_of(key: Column, value: Column, order: Column, deleted: Column | None = None) -> Column:
    """The last value of each key in order; without those that were deleted last."""
    if deleted is None:
        return _last(key, value, order)
    marked = _last(key, F.struct(value.alias("v"), deleted.alias("d")), order)
    return F.transform_values(F.map_filter(marked, lambda _, x: ~x["d"]), lambda _, x: x["v"])


def _last(key: Column, value: Column, order: Column) -> Column:
    items = F.sort_array(F.collect_list(F.struct(order.alias("o"), key.alias("k"), value.alias("v"))))
    keys = F.array_distinct(F.transform(items, lambda x: x["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(items, lambda x: x["k"] == k), F.lit(-1))["v"]))


def buffer(x: Column, limit: int, order: Column) -> Column:
    """The last `limit` values in order."""
    items = F.sort_array(F.collect_list(F.struct(order.alias("o"), x.alias("x"))))
    return F.transform(F.slice(items, F.greatest(F.size(items) - limit + 1, F.lit(1)), limit), lambda i: i["x"])


def running_buffer(x: Column, limit: int, by: Sequence[str], order: Sequence[str]) -> Column:
    """The last `limit` values at each record: a bounded frame."""
    return F.collect_list(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(limit - 1), 0))


def boolean(value: Column, order: Column) -> Column:
    """The last value that was set; false when none was."""
    return F.coalesce(F.max_by(value, order), F.lit(False))


def toggled(times: Column) -> Column:
    """A flag that begins false and is toggled `times` times by each record."""
    return F.coalesce(F.sum(times), F.lit(0)) % 2 == 1


class BitMask:
    """Named bits; unknown names are errors."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)

    def bits(self, name: Column) -> list[Column]:
        """A flag for each name that a record set."""
        return [F.coalesce(F.bool_or(name == x), F.lit(False)).alias(x) for x in self.names]

    def all(self, *names: str) -> Column:
        return self._fold(names, lambda a, b: a & b)

    def any(self, *names: str) -> Column:
        return self._fold(names, lambda a, b: a | b)

    def _fold(self, names: Sequence[str], op) -> Column:
        chosen = list(names) or self.names
        for x in chosen:
            if x not in self.names:
                raise KeyError(f"unknown bit {x!r}")
        out = F.col(chosen[0])
        for x in chosen[1:]:
            out = op(out, F.col(x))
        return out


def trigger(state: DataFrame, condition: Column) -> DataFrame:
    """The groups whose state meets a condition."""
    return state.where(condition)


def running(agg: Column, spec: WindowSpec) -> Column:
    """An aggregate's state after each record of a window's order."""
    return agg.over(spec.rowsBetween(Window.unboundedPreceding, 0))


class Registry:
    """Names of accumulators and their kinds: a name has one kind."""

    def __init__(self) -> None:
        self.kinds: dict[str, str] = {}

    def claim(self, name: str, kind: str) -> None:
        if self.kinds.setdefault(name, kind) != kind:
            raise TypeError(f"{name!r} is a {self.kinds[name]}, not a {kind}")
