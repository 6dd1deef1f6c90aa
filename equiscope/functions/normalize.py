"""Cross-sectional normalization as window expressions over one date's rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from equiscope.functions.scalar import clip, not_nan


_shared: ContextVar[dict[str, tuple[str, Column]] | None] = ContextVar("_shared", default=None)


def by_date() -> WindowSpec:
    return Window.partitionBy("as_of")


@contextmanager
def shared() -> Iterator[dict[str, tuple[str, Column]]]:
    """What `over` is asked for inside, by its text: (name, column) of each different one. Spark works out every window expression that it
    meets, equal ones too, and a component asks for the same low and high several times."""
    made: dict[str, tuple[str, Column]] = {}
    token = _shared.set(made)
    try:
        yield made
    finally:
        _shared.reset(token)


def over(x: Column, w: WindowSpec) -> Column:
    """An aggregate over a window; inside `shared`, the column that it will be in."""
    made, x = _shared.get(), x.over(w)
    return x if made is None else F.col(made.setdefault(str(x), (f"_over_{len(made)}", x))[0])


def minmax(x: Column, w: WindowSpec | None = None) -> Column:
    """To [0, 1] within the window; 0.5 where all are equal."""
    w = w or by_date()
    low, high = over(F.min(x), w), over(F.max(x), w)
    return F.when(low.isNull() | (low == high), F.lit(0.5)).otherwise((x - low) / (high - low))


def component(name: str, *, invert: bool = False, bounds: tuple[float, float] | None = None, fill: float = 0.0, w: WindowSpec | None = None) -> Column:
    x = F.coalesce(not_nan(F.col(name).cast("double")), F.lit(float(fill)))
    m = minmax(clip(x, *bounds) if bounds else x, w)
    return 1 - m if invert else m


def present(name: str, w: WindowSpec | None = None) -> Column:
    """Whether the date's rows hold any value of the column: an all-null column counts as absent."""
    return over(F.count(F.col(name)), w or by_date()) > 0


def mean_of(parts: list[tuple[Column, Column]]) -> Column:
    """The mean of the components whose columns are present; 0.5 if none is."""
    total = sum((F.when(there, c).otherwise(F.lit(0.0)) for there, c in parts), F.lit(0.0))
    n = sum((F.when(there, F.lit(1.0)).otherwise(F.lit(0.0)) for there, _ in parts), F.lit(0.0))
    return F.coalesce(F.try_divide(total, n), F.lit(0.5))


def winsorize(x: Column, n_std: float = 3.0, w: WindowSpec | None = None) -> Column:
    """Within n_std sample deviations of the mean; NaN becomes null first, and a constant or single row stays."""
    x, w = not_nan(x), w or by_date()
    mean, std = over(F.avg(x), w), over(F.stddev_samp(x), w)
    return F.when(std.isNull() | (std == 0), x).otherwise(clip(x, mean - n_std * std, mean + n_std * std))


def zscores(df: DataFrame, signals: dict[str, bool], w: WindowSpec | None = None) -> DataFrame:
    """For each raw signal column its z_<name>: winsorized, standardized again, flipped if lower is better, null as 0."""
    w = w or by_date()
    with shared() as made:
        cut = {f"_w_{s}": winsorize(F.col(s), w=w) for s in signals}
    df = with_shared(df, made, cut)
    scores = {}
    with shared() as made:
        for s, higher in signals.items():
            x = F.col(f"_w_{s}")
            std = over(F.stddev_samp(x), w)
            z = F.when(std.isNull() | (std == 0), F.lit(0.0)).otherwise((x - over(F.avg(x), w)) / std)
            scores[f"z_{s}"] = F.coalesce(z if higher else -z, F.lit(0.0))
    return with_shared(df, made, scores).drop(*cut)


def with_shared(df: DataFrame, made: dict[str, tuple[str, Column]], cols: dict[str, Column]) -> DataFrame:
    """df with columns that were built inside `shared`."""
    return df.withColumns(dict(made.values())).withColumns(cols).drop(*(name for name, _ in made.values()))


def composite(weights: dict[str, float]) -> Column:
    return sum((F.col(f"z_{s}") * F.lit(float(v)) for s, v in weights.items()), F.lit(0.0))
