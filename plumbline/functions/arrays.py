"""Expressions over arrays of numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pick(values, index: Column) -> Column:
    """``values[index]`` with a zero-based index column."""
    return F.element_at(literal_array(values), (index + 1).cast("int"))


def argmax(values: Column) -> Column:
    """Zero-based position of the largest entry; the first one wins ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def argmin(values: Column) -> Column:
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    An outer column used inside a lambda may be inlined by the optimizer and would then be computed again
    for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def l2_normalize(values: Column) -> Column:
    """Unit length; a zero vector is returned unchanged."""
    return let(
        doubles(values),
        lambda v: let(F.sqrt(dot(v, v)), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)),
    )


def ratio(top: Column, bottom: Column, default: float = 0.0) -> Column:
    """``top / bottom``, or the default where the bottom is zero or null."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(default))
