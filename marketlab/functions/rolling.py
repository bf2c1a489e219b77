"""Window frames with the min_periods rule: a frame shorter than asked for gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_asset(*order: str) -> WindowSpec:
    return Window.partitionBy("asset").orderBy(*(order or ("seq",)))


def frame(w: WindowSpec, n: int, lag: int = 0) -> WindowSpec:
    """The n rows that end ``lag`` rows before this one."""
    return w.rowsBetween(-(n - 1) - lag, -lag)


def full(value: Column, counted: Column, w: WindowSpec, n: int, lag: int = 0) -> Column:
    """value (an aggregate over the frame), where the frame holds n values of counted."""
    return F.when(F.count(counted).over(frame(w, n, lag)) == n, value)


def rolling(agg: Callable[[Column], Column], c: Column, w: WindowSpec, n: int, lag: int = 0) -> Column:
    return full(agg(c).over(frame(w, n, lag)), c, w, n, lag)


def forward_fill(c: Column, w: WindowSpec, limit: int) -> Column:
    """The last value that is not null, at most ``limit`` rows back."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate over rows where both are known; null, not an error, if either is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))
