"""Additive Holt-Winters fits of the trend window, a key at a time.

A key is one row of at most one trend window (120 days), whatever the table's size."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.operators.fit import window_of
from tidecast.operators.series import SEGMENT

SEASON, AHEAD, LEAST = 7, 120, 14
FIXED = (0.3, 0.05, 0.2)


def fixed_start(y: np.ndarray) -> np.ndarray:
    """Level, slope and seasons from the first two seasons, in one array."""
    level = y[:SEASON].mean()
    return np.array([level, (y[SEASON : 2 * SEASON].mean() - level) / SEASON, *(y[:SEASON] - level)])


def run(y: np.ndarray, weights: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Level, trend, seasons at the end and one-step fits, for rows of weights and of starts
    at once. y: one series, or one a row."""
    a, b, g = weights.T
    level, slope, season = start[:, 0].copy(), start[:, 1].copy(), start[:, 2:].copy()
    y = np.broadcast_to(y, (len(weights), y.shape[-1]))
    fits = np.empty(y.shape)
    for t in range(y.shape[1]):
        v, s = y[:, t], season[:, t % SEASON]
        fits[:, t] = level + slope + s
        new = a * (v - s) + (1 - a) * (level + slope)
        slope = b * (new - level) + (1 - b) * slope
        season[:, t % SEASON] = g * (v - new) + (1 - g) * s
        level = new
    return level, slope, season, fits


def best_starts(y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row of weights, the start of least squared one-step error.

    For fixed weights the fits are linear in the start, so it solves least squares: what the
    series leaves of a start of zeros, on the fits of a zero series from each unit start. The
    last season is held at minus the others' sum, as level and seasons can trade a constant."""
    units = np.zeros((SEASON + 1, SEASON + 2))
    units[0, 0] = units[1, 1] = 1
    for k in range(SEASON - 1):
        units[2 + k, 2 + k], units[2 + k, -1] = 1, -1
    n, m = len(weights), len(units)
    each = np.concatenate([np.zeros((1, SEASON + 2)), units])
    rows = np.concatenate([y[None, :], np.zeros((m, len(y)))])
    fits = run(np.tile(rows, (n, 1)), np.repeat(weights, m + 1, 0), np.tile(each, (n, 1)))[3].reshape(n, m + 1, len(y))
    basis, left = fits[:, 1:].transpose(0, 2, 1), y - fits[:, 0]
    return np.einsum("nij,nj->ni", np.linalg.pinv(basis), left) @ units


def best(y: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and start of least squared one-step error: a grid of weights, then ever closer
    neighbours, each with its best start. The best weights of a fixed start are among them,
    so no fixed start does better."""

    def search(start_of, grid, step=0.1):
        for _ in range(rounds):
            start = start_of(grid)
            error = ((run(y, grid, start)[3] - y) ** 2).sum(1)
            top = error.argmin()
            kept, weights = start[top], grid[top]
            grid = np.clip([weights, *(weights + step * np.array(d) for d in product((-1, 0, 1), repeat=3) if any(d))], 0.001, 0.999)
            step /= 2
        return weights, kept

    grid = np.array([FIXED, *product((0.05, 0.2, 0.4, 0.7), (0.01, 0.1, 0.3), (0.05, 0.2, 0.4))])
    simple, _ = search(lambda w: np.tile(fixed_start(y), (len(w), 1)), grid)
    return search(lambda w: best_starts(y, w), np.concatenate([simple[None, :], grid]))


def fit(series: DataFrame, keys: tuple[str, ...] = SEGMENT, optimise: bool = True) -> DataFrame:
    """(keys, alpha, beta, gamma, path, pool): the next AHEAD days, not below 0, and the
    residuals of unclipped revenue. Weights and start are estimated, or fixed. Keys with under
    two seasons have no row."""
    names = list(keys)
    window = window_of(series, keys)
    # a key is one row of at most TREND_DAYS days; keys are dealt to tasks by number, as fits take long and rows are few
    spark = series.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    days = window.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("x", "y", "revenue"))).alias("days"))
    base = days.where(F.size("days") >= LEAST).select(*names, F.col("days.y").alias("y"), F.col("days.revenue").alias("revenue")).repartition(parts, *names)
    schema = T.StructType([*base.select(*names).schema.fields, *T._parse_datatype_string("alpha double, beta double, gamma double, path array<double>, pool array<double>").fields])

    def fitted(batches):
        ahead = np.arange(1, AHEAD + 1)
        for batch in batches:
            rows = []
            for y, revenue in zip(batch.column("y"), batch.column("revenue"), strict=True):
                y, revenue = (v.values.to_numpy(zero_copy_only=False).astype(float) for v in (y, revenue))
                w, start = best(y) if optimise else (np.array(FIXED), fixed_start(y))
                level, slope, season, fits = run(y, w[None, :], start[None, :])
                path = np.maximum(0, level[0] + slope[0] * ahead + season[0][(len(y) + ahead - 1) % SEASON])
                rows.append([*map(float, w), path.tolist(), (revenue - fits[0]).tolist()])
            told = [pa.array([r[k] for r in rows], pa.float64() if k < 3 else pa.list_(pa.float64())) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *told], schema.names)

    return base.mapInArrow(fitted, schema)
