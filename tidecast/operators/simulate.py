"""Monte Carlo forecasts by keyed block bootstrap.

Draws depend on key, simulation and block only, so baseline, scenarios and all
horizons share them (common random numbers), and any partitioning gives the same
result. The horizons of a simulation are nested: one path of days each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.expressions import BLOCK, CHANNEL_INFLATION, HORIZONS, N_SIMS, SEED, drawn, is_holiday, key_text, response, rounded, streams

ROLLUP = ("channel", "campaign_type", "campaign_id")


def inflation(channel: Column) -> Column:
    out = F.lit(1.0)
    for name, value in CHANNEL_INFLATION.items():
        out = F.when(channel == name, value).otherwise(out)
    return out


def path_of_points(models: DataFrame, days: int) -> Column:
    """Days 1 to `days` after training: trend, not below 0, times weekday and holiday factors."""

    def point(k: Column) -> Column:
        date = F.date_add("last_train_date", k)
        season = F.get("dow", F.weekday(date)) * F.when(is_holiday(date), F.col("holiday_factor")).otherwise(1.0)
        trend = F.greatest(F.lit(0.0), F.col("level_at_end") + F.col("slope") * k) * season
        if "path" in models.columns:  # a fitted path goes before the trend
            fitted = F.greatest(F.lit(0.0), F.get("path", F.least(k, F.size("path")) - 1))
            return F.when(F.size("path") > 0, fitted).otherwise(trend)  # greatest() passes over nulls
        return trend

    return F.transform(F.sequence(F.lit(1), F.lit(days)), point)


#: Simulations of a key that are made at a time, where all of its own aren't needed together.
SIM_BLOCK = 250
PERCENT = (0.1, 0.5, 0.9)


def _paths(begin: np.ndarray, pool: np.ndarray, days: int) -> np.ndarray:
    """The residuals of each simulation's days. Pools over BLOCK long give runs of BLOCK days,
    shorter ones single days, empty ones 0."""
    if not len(pool):
        return np.zeros((len(begin), days))
    step = BLOCK if len(pool) > BLOCK else 1
    n = -(-days // step)
    starts = drawn(begin[:, None], np.arange(n)) % (len(pool) - (step - 1))
    return pool[(starts[:, :, None] + np.arange(step)).reshape(len(begin), n * step)[:, :days]]


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a key, or a key and block, spread over the tasks; with its pool and points
    each is under 2 KB, and no simulation is ever joined to them."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys)


def _values(column: pa.Array, row: int) -> np.ndarray:
    values = column[row].values
    return np.zeros(0) if values is None else values.to_numpy(zero_copy_only=False).astype(float)


def draws(models: DataFrame, keys: tuple[str, ...], days: int, n_sims: int = N_SIMS, seed: int = SEED) -> DataFrame:
    """(keys, sim, k, residual) for days k from 1."""
    names = list(keys)
    base = _dealt(models.select(*names, "pool", key_text(*keys).alias("key_")), *names)
    schema = T.StructType([*base.select(*names).schema.fields, *T._parse_datatype_string("sim int, residuals array<double>").fields])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                begin = streams(batch.column("key_")[i].as_py(), range(n_sims), "simulate", seed)
                paths = _paths(begin, _values(batch.column("pool"), i), days)
                lists = pa.ListArray.from_arrays(np.arange(0, paths.size + 1, days, dtype=np.int32), pa.array(paths.ravel()))
                same = pa.array(np.full(n_sims, i, np.int32))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(same) for c in names], pa.array(np.arange(n_sims, dtype=np.int32)), lists], schema.names)

    each = base.mapInArrow(run, schema).select(*names, "sim", F.posexplode("residuals").alias("at", "residual"))
    return each.select(*names, "sim", (F.col("at") + 1).alias("k"), "residual")


def _ready(models: DataFrame, keys: tuple[str, ...], days: int, spread: Column | None, by: tuple[str, ...]) -> DataFrame:
    """What the simulations of a key need. by: the columns that key its draws."""
    points = path_of_points(models, days).alias("points_")
    return models.select(*keys, F.col("pool").alias("pool_"), points, (inflation(F.col("channel")) if spread is None else spread).alias("spread_"), key_text(*by).alias("key_"))


def simulate(models: DataFrame, keys: tuple[str, ...], horizons: tuple[int, ...] = HORIZONS, n_sims: int = N_SIMS, spread: Column | None = None, seed: int = SEED) -> DataFrame:
    """(keys, sim, horizon_days, revenue): summed days, each not below 0, for sums over keys."""
    days, names = max(horizons), list(keys)
    blocks = _ready(models, keys, days, spread, keys).withColumn("first_", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1), F.lit(SIM_BLOCK))))
    base = _dealt(blocks, *names, "first_")
    schema = T.StructType([*base.select(*names).schema.fields, *T._parse_datatype_string("sim int, horizon_days int, revenue double").fields])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                first = batch.column("first_")[i].as_py()
                sims = range(first, min(n_sims, first + SIM_BLOCK))
                begin = streams(batch.column("key_")[i].as_py(), sims, "simulate", seed)
                value = np.maximum(0.0, _values(batch.column("points_"), i) + _paths(begin, _values(batch.column("pool_"), i), days) * batch.column("spread_")[i].as_py())
                n = len(sims) * len(horizons)
                same = pa.array(np.full(n, i, np.int32))
                sums = np.concatenate([value[:, :h].sum(1) for h in horizons])
                told = [pa.array(np.tile(np.array(sims, np.int32), len(horizons))), pa.array(np.repeat(np.array(horizons, np.int32), len(sims))), pa.array(sums)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(same) for c in names], *told], schema.names)

    return base.mapInArrow(run, schema)


def simulated_percentiles(models: DataFrame, keys: tuple[str, ...], horizons: tuple[int, ...] = HORIZONS, n_sims: int = N_SIMS, spread: Column | None = None, scales: tuple[float, ...] = (1.0,), by: tuple[str, ...] | None = None, seed: int = SEED) -> DataFrame:
    """(keys, scale, horizon_days, p): percentiles of a key's own simulations, taken where they are
    made: nothing is shuffled after them. Scales multiply the draws, which they share, before
    days are held at 0. by: the columns that key the draws, where keys that differ share them."""
    days, names = max(horizons), list(keys)
    base = _dealt(_ready(models, keys, days, spread, by or keys), *names)
    schema = T.StructType([*base.select(*names).schema.fields, *T._parse_datatype_string("scale double, horizon_days int, p array<double>").fields])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                begin = streams(batch.column("key_")[i].as_py(), range(n_sims), "simulate", seed)
                noise = _paths(begin, _values(batch.column("pool_"), i), days) * batch.column("spread_")[i].as_py()
                points, rows = _values(batch.column("points_"), i), []
                for scale in scales:
                    value = np.maximum(0.0, points + noise * scale)
                    rows += [(scale, h, np.quantile(value[:, :h].sum(1), PERCENT).tolist()) for h in horizons]
                scale, horizon, p = zip(*rows, strict=True)
                same = pa.array(np.full(len(rows), i, np.int32))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(same) for c in names], pa.array(scale, pa.float64()), pa.array(horizon, pa.int32()), pa.array(p, pa.list_(pa.float64()))], schema.names)

    return base.mapInArrow(run, schema)


def multiples(models: DataFrame, channel: dict[str, float] | None = None, segment: dict[tuple[str, str], float] | None = None) -> Column:
    """A segment's own multiple of spend, else its channel's, else 1."""
    out = F.lit(1.0)
    for name, m in (channel or {}).items():
        out = F.when(F.col("channel") == name, float(m)).otherwise(out)
    for (name, kind), m in (segment or {}).items():
        out = F.when((F.col("channel") == name) & (F.col("campaign_type") == kind), float(m)).otherwise(out)
    return out


ORDER = ["channel", "campaign_type", "campaign_id", "horizon_days", "metric", "p10", "p50", "p90"]


def scenario_beta(models: DataFrame) -> str:
    """The slope of scenarios: 1 for low confidence, where slopes have confidence limits."""
    return "beta_for_scenario" if "beta_for_scenario" in models.columns else "beta"


def _told(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of revenue and, where money is spent, return on it from (keys, horizon_days, r, spend)."""
    revenue = F.struct(F.lit("revenue").alias("metric"), *[F.col("r")[i].alias(n) for i, n in enumerate(ORDER[-3:])])
    roas = F.when(F.col("spend") > 0, F.struct(F.lit("roas").alias("metric"), *[(F.col("r")[i] / F.col("spend")).alias(n) for i, n in enumerate(ORDER[-3:])]))
    each = rows.select(*keys, "horizon_days", F.inline(F.array_compact(F.array(revenue, roas))))
    return each.select(*keys, "horizon_days", "metric", *[F.round(p, 4).alias(p) for p in ORDER[-3:]])


def percentiles(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of revenue and return from (keys, horizon_days, sim, revenue, spend)."""
    cut = paths.groupBy(*keys, "horizon_days").agg(F.percentile("revenue", F.array(*map(F.lit, PERCENT))).alias("r"), F.max("spend").alias("spend"))
    return _told(cut, keys)


def scaled(models: DataFrame, sims: DataFrame, multiple: Column, keys: tuple[str, ...]) -> DataFrame:
    """Simulated revenue and spend under multiples of spend."""
    told = models.select(*keys, "avg_spend", F.col(scenario_beta(models)).alias("beta"), multiple.alias("m"))
    told = told.select(*keys, response(F.col("m"), F.col("beta")).alias("scale"), (F.col("avg_spend") * F.col("m")).alias("daily"))
    both = sims.join(told, list(keys))
    return both.withColumn("revenue", F.col("revenue") * F.col("scale")).withColumn("spend", F.col("daily") * F.col("horizon_days"))


def forecast(models: DataFrame, sims: DataFrame, multiple: Column, rollup: bool = True) -> DataFrame:
    """Percentiles of revenue and return at segment, channel and blended grain. models:
    (channel, campaign_type, avg_spend, beta), and beta_for_scenario, which goes before
    beta, if slopes have confidence limits; sims as from simulate()."""
    moved = scaled(models, sims, multiple, ("channel", "campaign_type"))
    if rollup:
        grains = [["channel", "campaign_type", "horizon_days", "sim"], ["channel", "horizon_days", "sim"], ["horizon_days", "sim"]]
        sums = moved.groupingSets(grains, "channel", "campaign_type", "horizon_days", "sim")
    else:
        sums = moved.groupBy("channel", "campaign_type", "horizon_days", "sim")
    paths = sums.agg(F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"))
    named = paths.withColumn("channel", F.coalesce("channel", F.lit("blended"))).withColumn("campaign_type", F.coalesce("campaign_type", F.lit("")))
    return percentiles(named.withColumn("campaign_id", F.lit("")), ORDER[:3]).select(ORDER)


def forecast_campaigns(models: DataFrame, multiple: Column, horizons: tuple[int, ...] = HORIZONS, n_sims: int = N_SIMS, spread: Column | None = None) -> DataFrame:
    """The same of campaigns, which are in no sum: segments hold their revenue already. A
    multiple of spend scales all simulations of a key alike, so percentiles are scaled."""
    limits = simulated_percentiles(models, ROLLUP, horizons, n_sims, spread)
    told = models.select(*ROLLUP, response(multiple, F.col(scenario_beta(models))).alias("factor"), (F.col("avg_spend") * multiple).alias("daily"))
    both = limits.join(told, list(ROLLUP)).select(*ROLLUP, "horizon_days", F.transform("p", lambda v: v * F.col("factor")).alias("r"), (F.col("daily") * F.col("horizon_days")).alias("spend"))
    return _told(both, ORDER[:3]).select(ORDER)


def moved(base: DataFrame, scenario: DataFrame) -> DataFrame:
    """(horizon_days, metric, baseline, scenario, change_pct): blended medians of two forecasts."""
    blended = lambda df, name: df.where("channel = 'blended'").select("horizon_days", "metric", F.col("p50").alias(name))
    both = blended(base, "baseline").join(blended(scenario, "scenario"), ["horizon_days", "metric"])
    return both.withColumn("change_pct", F.when(F.col("baseline") > 0, rounded((F.col("scenario") - F.col("baseline")) / F.col("baseline") * 100, 2)))
