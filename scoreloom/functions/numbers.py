"""Guarded arithmetic: ANSI mode raises where these give the defined value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAITS = ("content", "organization", "expression")
#: Step and number of levels of each trait's label grid, from 1.0 up (fixed values).
GRIDS = {"content": (0.1, 41), "organization": (0.25, 17), "expression": (0.25, 17)}


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: the optimizer does not copy it into each use."""
    return F.get(F.transform(F.array(value), body), 0)


def solid(value: Column) -> Column:
    """value as one step of its own."""
    return let(value, lambda x: x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clip(x: str | Column, lo: float = 1.0, hi: float = 5.0) -> Column:
    return F.least(F.greatest(col(x), F.lit(lo)), F.lit(hi))


def finite(x: str | Column) -> Column:
    x = col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def valid_score(x: str | Column) -> Column:
    return finite(x) & col(x).between(1.0, 5.0)


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, constant: Column) -> Column:
    """Pearson correlation from sums; 0 for fewer than two rows or a constant side."""
    cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
    raw = F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))
    return F.when((n < 2) | constant, F.lit(0.0)).otherwise(F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)), F.lit(0.0)))


def sample_sd(n: Column, s: Column, ss: Column) -> Column:
    """Sample standard deviation from sums; 0 for one row."""
    return F.when(n > 1, F.sqrt(F.greatest(ss - s * s / n, F.lit(0.0)) / F.greatest(n - 1, F.lit(1)))).otherwise(F.lit(0.0))


def grid(trait: str) -> Column:
    """The levels of a trait as an array."""
    step, levels = GRIDS[trait]
    if trait == "content":
        return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.round(1 + i * F.lit(step), 1))
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: 1 + i * F.lit(step))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array of doubles, shifted by its maximum."""
    def shifted(v: Column) -> Column:
        return let(F.array_max(v), lambda top: F.transform(v, lambda y: F.exp((y - top) / F.lit(temperature))))

    return let(let(x, shifted), lambda e: let(total(e), lambda s: F.transform(e, lambda y: y / s)))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """a over its length; a zero vector is an error."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.raise_error(F.lit("zero norm")).cast("array<double>"))


def expected(p: Column, levels: Column) -> Column:
    """Expectation of the levels under probabilities p."""
    return dot(p, levels)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def huber(x: Column, beta: float) -> Column:
    a = F.abs(x)
    return F.when(a < beta, x * x * 0.5 / beta).otherwise(a - 0.5 * beta)
