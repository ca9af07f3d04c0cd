"""Functions of vectors, as expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row. Where a lambda names an expression, Spark computes it again for each element,
    so a norm in it costs a pass for each component, and one of a mean in it a pass for each pair of them."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def variance(v: Column) -> Column:
    """Of the population."""
    return let(mean(v), lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v))


def scale_255(v: Column) -> Column:
    return F.transform(v, lambda x: x / 255.0)


def contrast_normalised(v: Column, unit: float = 55.0, tiny: float = 1e-10) -> Column:
    """v / 255, less its mean, over its norm divided by ``unit``; a norm below ``tiny`` counts as 1."""

    def over_norm(b: Column) -> Column:
        return let(norm(b) / unit, lambda n: let(F.when(n < tiny, 1.0).otherwise(n), lambda n: F.transform(b, lambda x: x / n)))

    return let(scale_255(v), lambda a: let(mean(a), lambda m: let(F.transform(a, lambda x: x - m), over_norm)))


def l2(v: Column) -> Column:
    """Over its norm; a zero vector stays."""
    return let(v, lambda v: let(norm(v), lambda n: let(F.when(n == 0, 1.0).otherwise(n), lambda n: F.transform(v, lambda x: x / n))))


def power_normalised(v: Column) -> Column:
    """Signed square roots over their norm."""
    return l2(F.transform(v, lambda x: F.signum(x) * F.sqrt(F.abs(x))))


def by_width(v: Column) -> Column:
    """Over the square root of the number of components."""
    return F.transform(v, lambda x: x / F.sqrt(F.size(v).cast("double")))


def sift_normalised(v: Column, clip: float = 0.2) -> Column:
    """Over its norm (1 at least), clipped, and where the norm was above 1 over its norm again."""

    def clipped(v: Column, n: Column) -> Column:
        a = let(F.greatest(n, F.lit(1.0)), lambda least: F.transform(v, lambda x: F.least(x / least, F.lit(clip))))
        return let(a, lambda a: F.when(n > 1, l2(a)).otherwise(a))

    return let(v, lambda v: let(norm(v), lambda n: clipped(v, n)))


def two_sided_relu(x: Column, bias: float) -> tuple[Column, Column]:
    return F.greatest(x - bias, F.lit(0.0)), F.greatest(-x - bias, F.lit(0.0))


def grey_to_rgb(v: Column) -> Column:
    return F.concat(v, v, v)


def chw_to_hwc(v: Column, c: int, h: int, w: int) -> Column:
    """The flat pixels of channels, rows, columns as rows, columns, channels."""
    return F.transform(F.sequence(F.lit(0), F.lit(c * h * w - 1)), lambda k: F.element_at(v, ((k % c) * (h * w) + F.floor(k / c).cast("int") + 1).cast("int")))


def hwc_to_chw(v: Column, c: int, h: int, w: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(c * h * w - 1)), lambda k: F.element_at(v, ((k % (h * w)) * c + F.floor(k / (h * w)).cast("int") + 1).cast("int")))


def flatten_json(text: Column, schema: str) -> Column:
    """A nested JSON object as one map; of equal keys the last wins."""
    return F.from_json(text, schema)
