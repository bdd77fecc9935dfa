"""Fit methods by name: whatever is registered here takes part in contests and training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators import fit, holt_winters
from tidecast.operators.series import SEGMENT

#: From (series, keys) to models as fit.models() has them, with `path` where a method fits the days to come.
FitMethod = Callable[[DataFrame, tuple[str, ...]], DataFrame]
METHODS: dict[str, FitMethod] = {}
#: What a key has that no contest has settled; ties go to it as well.
DEFAULT = "empirical"


def fit_method(name: str) -> Callable[[FitMethod], FitMethod]:
    """Register a function as the fit method of that name."""

    def add(f: FitMethod) -> FitMethod:
        METHODS[name] = f
        return f

    return add


@fit_method(DEFAULT)
def empirical(series: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    return fit.models(series, keys)


def _with_path(series: DataFrame, keys: tuple[str, ...], optimise: bool) -> DataFrame:
    """Keys with too few days for a path keep the empirical fit."""
    found = holt_winters.fit(series, keys, optimise).select(*keys, "path", F.col("pool").alias("own_pool"))
    both = fit.models(series, keys).join(found, list(keys), "left")
    return both.withColumn("pool", F.coalesce("own_pool", "pool")).drop("own_pool")


@fit_method("holt_winters")
def smoothed(series: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    return _with_path(series, keys, True)


def smoothed_fixed(series: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Holt-Winters with fixed weights: the fallback tier, and one that SQL can say."""
    return _with_path(series, keys, False)


#: A contest whose fits don't search, so that SQL can hold it to account.
FIXED_METHODS: dict[str, FitMethod] = {DEFAULT: empirical, "holt_winters_fixed": smoothed_fixed}


def fitted_by(series: DataFrame, wanted: DataFrame, keys: tuple[str, ...], methods: dict[str, FitMethod] | None = None) -> DataFrame:
    """Models of keys by the methods wanted for them. wanted: (keys, method), a key as often as it has methods."""
    out = None
    for name, method in (methods or METHODS).items():
        own = series.join(wanted.where(F.col("method") == name).select(*keys), list(keys), "left_semi")
        found = method(own, keys).withColumn("method", F.lit(name))
        if "path" not in found.columns:
            found = found.withColumn("path", F.lit(None).cast("array<double>"))
        out = found if out is None else out.unionByName(found)
    return out
