"""Trend and season fits, elasticities, and models of short campaigns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.expressions import (
    CLIP_PERCENTILE, ELASTICITY_BOOTSTRAPS, ELASTICITY_CI_WIDTH, ELASTICITY_MIN_PAIRS, ELASTICITY_MOST, MIN_CAMPAIGN_DAYS, MIN_SHRINKAGE_DAYS, RUN_RATE_DAYS, SEED, TEST_DAYS, TREND_DAYS, drawn, finite, is_holiday, key_text, streams,
)
from tidecast.operators.series import SEGMENT, daily, last_days


def window_of(series: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The trend window with `y`, revenue clipped to [0, its 97th percentile]."""
    rows = last_days(series, keys, TREND_DAYS)
    top = rows.groupBy(*keys).agg(F.percentile("revenue", F.lit(CLIP_PERCENTILE)).alias("top"))
    y = F.when(F.col("top") > 0, F.least(F.greatest("revenue", F.lit(0.0)), "top")).otherwise(F.col("revenue"))
    return rows.join(top, list(keys)).withColumn("y", y)


def trend(series: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    rows = window_of(series, keys)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("y").alias("sd"), F.avg("y").alias("mean"), F.regr_slope("y", F.col("x").cast("double")).alias("a"), F.regr_intercept("y", F.col("x").cast("double")).alias("b"), F.max("date").alias("last_train_date"))
    moves = (F.col("n") >= 2) & (F.col("sd") > 0)
    slope, start = F.when(moves, F.col("a")).otherwise(0.0), F.when(moves, F.col("b")).otherwise(F.col("mean"))
    return sums.select(*keys, slope.alias("slope"), start.alias("start"), (slope * (F.col("n") - 1) + start).alias("level_at_end"), "n", "last_train_date")


def weekday_factors(series: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Seven rows a key: mean of a weekday (0 Monday) over the mean of all days."""
    overall = series.groupBy(*keys).agg(F.avg("revenue").alias("overall"))
    days = overall.withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6))))
    own = series.groupBy(*keys, F.weekday("date").alias("dow")).agg(F.avg("revenue").alias("mean"))
    ratio = F.when(F.col("overall") > 0, F.col("mean") / F.col("overall"))
    return days.join(own, [*keys, "dow"], "left").select(*keys, "dow", F.when(finite(ratio) & (ratio > 0), ratio).otherwise(1.0).alias("factor"))


def holiday_factor(series: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    on, off = F.avg(F.when(is_holiday(F.col("date")), F.col("revenue"))), F.avg(F.when(~is_holiday(F.col("date")), F.col("revenue")))
    means = series.groupBy(*keys).agg(on.alias("on"), off.alias("off"))
    ratio = F.when(F.col("off") > 0, F.col("on") / F.col("off"))
    return means.select(*keys, F.when(finite(ratio) & (ratio > 0), ratio).otherwise(1.0).alias("holiday_factor"))


def residuals(series: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    """What revenue (not clipped) leaves of trend, weekday and holiday over the window."""
    rows = last_days(series, keys, TREND_DAYS).withColumn("dow", F.weekday("date"))
    joined = rows.join(trend(series, keys), list(keys)).join(weekday_factors(series, keys), [*keys, "dow"]).join(holiday_factor(series, keys), list(keys))
    season = F.col("factor") * F.when(is_holiday(F.col("date")), F.col("holiday_factor")).otherwise(1.0)
    return joined.select(*keys, "date", "x", (F.col("revenue") - (F.col("start") + F.col("slope") * F.col("x")) * season).alias("residual"))


def models(series: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    """One row a key: trend, weekday factors, holiday factor, ordered residuals, averages.
    The series is dealt by key once; all parts are sums, windows and joins by the same keys."""
    series = series.repartition(*keys)
    pool = residuals(series, keys).where(finite(F.col("residual"))).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "residual"))), lambda s: s["residual"]).alias("pool"))  # TREND_DAYS at most
    dow = weekday_factors(series, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dow", "factor"))), lambda s: s["factor"]).alias("dow"))
    recent = last_days(series, keys, RUN_RATE_DAYS).groupBy(*keys).agg(F.avg("spend").alias("avg_spend"), F.avg("revenue").alias("avg_revenue"))
    out = trend(series, keys)
    for part in (dow, holiday_factor(series, keys), pool, recent):
        out = out.join(part, list(keys), "left")
    return out


def elasticity(series: DataFrame, keys: tuple[str, ...] = SEGMENT, resamples: int = 0) -> DataFrame:
    """Slope of log revenue on log spend over days with both, from 0 to 2; with
    resamples, its P10 and P90 over keyed resamples. Too few pairs: 1, low confidence."""
    pairs = series.select(*keys, "date", F.when((F.col("spend") > 0) & (F.col("revenue") > 0), F.struct(F.ln("spend").alias("s"), F.ln("revenue").alias("r"))).alias("pair"))
    point = pairs.groupBy(*keys).agg(F.count("pair").alias("n_obs"), F.regr_slope("pair.r", "pair.s").alias("b"), F.regr_intercept("pair.r", "pair.s").alias("a"))
    enough = (F.col("n_obs") >= ELASTICITY_MIN_PAIRS) & F.col("b").isNotNull()
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(ELASTICITY_MOST))
    out = point.select(*keys, "n_obs", F.when(enough, clip(F.col("b"))).otherwise(1.0).alias("beta"), F.when(enough, F.col("a")).otherwise(0.0).alias("alpha"), enough.alias("fitted"))
    if not resamples:
        return out
    # a key is one row with its pairs, of which it has one a day at most
    lists = F.transform(F.array_sort(F.collect_list(F.struct("date", "pair"))), lambda x: x["pair"])
    held = pairs.where("pair is not null").join(out.where("fitted").select(*keys), list(keys), "left_semi").groupBy(*keys).agg(lists.alias("pairs"))
    marked = held.select(*keys, "pairs", F.array(F.struct(key_text(*keys).alias("key"), F.size("pairs").alias("n"))).alias("marks"))
    limits = _resampled(marked, keys, resamples).select(*keys, F.col("limits")[0]["ci"].alias("ci"))
    joined = out.join(limits, list(keys), "left").withColumn("ci_low", F.coalesce(F.col("ci")[0], F.lit(1.0))).withColumn("ci_high", F.coalesce(F.col("ci")[1], F.lit(1.0)))
    low = ~F.col("fitted") | (F.col("ci_high") - F.col("ci_low") > ELASTICITY_CI_WIDTH)
    return joined.select(*keys, "n_obs", "beta", "alpha", "ci_low", "ci_high", low.alias("low_confidence"), F.when(low, 1.0).otherwise(F.col("beta")).alias("beta_for_scenario"))


#: Resamples of a key that are drawn at a time.
RESAMPLE_BLOCK = 50


def _resampled(marked: DataFrame, keys: tuple[str, ...], resamples: int) -> DataFrame:
    """(keys, limits): P10 and P90 of the slopes of keyed resamples of a key's first pairs, for
    each of its marks. marked: (keys, pairs, marks), pairs by date and marks of (key, n): draws
    are keyed by `key`, among the first n pairs. Resamples are drawn, fitted and cut to
    percentiles where the key's row is, and never shuffled."""
    spark = marked.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = list(keys)
    base = marked.select(*names, F.col("pairs.s").alias("s"), F.col("pairs.r").alias("r"), "marks").repartition(parts, *names)
    schema = T.StructType([*base.select(*names).schema.fields, *T._parse_datatype_string("limits array<struct<key: string, ci: array<double>>>").fields])

    def limits(s: np.ndarray, r: np.ndarray, key: str) -> list[float] | None:
        begin = streams(key, range(resamples), "elasticity", SEED)
        b = np.concatenate([_slopes(s, r, begin[k : k + RESAMPLE_BLOCK]) for k in range(0, resamples, RESAMPLE_BLOCK)])
        b = np.clip(b[~np.isnan(b)], 0.0, ELASTICITY_MOST)
        return np.quantile(b, (0.1, 0.9)).tolist() if len(b) else None

    def run(batches):
        for batch in batches:
            told = []
            for i in range(batch.num_rows):
                s, r = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("s", "r"))
                told.append([{"key": m["key"], "ci": limits(s[: m["n"]], r[: m["n"]], m["key"])} for m in batch.column("marks")[i].as_py()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(told, pa.list_(pa.struct([("key", pa.string()), ("ci", pa.list_(pa.float64()))])))], schema.names)

    return base.mapInArrow(run, schema)


def _slopes(s: np.ndarray, r: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The slopes of r on s over as many drawn pairs, a resample each; nan if all have one s."""
    at = drawn(begin[:, None], np.arange(len(s))) % len(s)
    x, y = s[at], r[at]
    same = x.min(1) == x.max(1)
    x = x - x.mean(1, keepdims=True)
    y = y - y.mean(1, keepdims=True)
    return np.where(same, np.nan, (x * y).sum(1) / np.where(same, 1.0, (x * x).sum(1)))


def elasticity_at(series: DataFrame, offsets: tuple[int, ...], last: DataFrame, keys: tuple[str, ...] = SEGMENT, resamples: int = ELASTICITY_BOOTSTRAPS, ahead: int = TEST_DAYS) -> DataFrame:
    """What was known of each key at each cutoff, and what came after: (cutoff, keys, n_days, n_obs,
    beta, ci_low, ci_high, low_confidence, avg_spend, roas_after). last: one row with `b`, the day
    from which cutoffs lie `offsets` back.

    Sums of regression run along each dense series, so a cutoff is a lookup of one of its days
    and the series is never repeated; resamples draw among the first pairs of one array."""
    both = (F.col("spend") > 0) & (F.col("revenue") > 0)
    s, r = F.when(both, F.ln("spend")), F.when(both, F.ln("revenue"))
    ordered = Window.partitionBy(*keys).orderBy("date")
    so_far, next_days = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(1, ahead)
    sums = {"n": F.count(s), "x": F.sum(s), "y": F.sum(r), "xx": F.sum(s * s), "xy": F.sum(s * r)}
    days = series.select(
        *keys, "date", F.row_number().over(ordered).alias("n_days"), *[v.over(so_far).alias(f"{k}_") for k, v in sums.items()],
        F.avg("spend").over(ordered.rowsBetween(1 - RUN_RATE_DAYS, 0)).alias("avg_spend"), F.sum("spend").over(next_days).alias("s_after"), F.sum("revenue").over(next_days).alias("r_after"),
    )
    span = series.groupBy(*keys).agg(F.min("date").alias("first"), F.max("date").alias("end")).crossJoin(F.broadcast(last))  # one row
    marks = span.withColumn("cutoff", F.explode(F.array(*[F.date_sub("b", o) for o in offsets]))).where("cutoff >= first").select(*keys, "cutoff", "end", F.least("cutoff", "end").alias("date"))
    at = marks.join(days, [*keys, "date"])
    spread, n = F.col("n_") * F.col("xx_") - F.col("x_") * F.col("x_"), F.col("n_")
    slope = F.when(spread > 1e-9 * n * F.col("xx_"), (n * F.col("xy_") - F.col("x_") * F.col("y_")) / spread)
    fitted = (n >= ELASTICITY_MIN_PAIRS) & slope.isNotNull()
    # days after the cutoff are those after the looked-up one, where the series goes on beyond it
    after = F.when((F.col("end") > F.col("cutoff")) & (F.col("s_after") > 0), F.col("r_after") / F.col("s_after"))
    point = at.select("cutoff", *keys, "n_days", n.alias("n_obs"), F.when(fitted, F.least(F.greatest(slope, F.lit(0.0)), F.lit(ELASTICITY_MOST))).otherwise(1.0).alias("beta"), fitted.alias("fitted"), "avg_spend", after.alias("roas_after"), key_text("cutoff", *keys).alias("key"))
    lists = F.transform(F.array_sort(F.collect_list(F.when(both, F.struct("date", s.alias("s"), r.alias("r"))))), lambda v: F.struct(v["s"].alias("s"), v["r"].alias("r")))
    held = series.groupBy(*keys).agg(lists.alias("pairs"))
    wanted = point.where("fitted").groupBy(*keys).agg(F.collect_list(F.struct("key", F.col("n_obs").cast("int").alias("n"))).alias("marks"))
    limits = _resampled(held.join(wanted, list(keys)), keys, resamples).select(F.inline("limits"))
    told = point.join(limits, "key", "left").withColumns({"ci_low": F.coalesce(F.col("ci")[0], F.lit(1.0)), "ci_high": F.coalesce(F.col("ci")[1], F.lit(1.0))})
    low = ~F.col("fitted") | (F.col("ci_high") - F.col("ci_low") > ELASTICITY_CI_WIDTH)
    return told.select("cutoff", *keys, "n_days", "n_obs", "beta", "ci_low", "ci_high", low.alias("low_confidence"), "avg_spend", "roas_after")


def campaign_tiers(features: DataFrame) -> DataFrame:
    """Each campaign of a segment by the days from its first to its last: skip, shrinkage, own."""
    span = features.dropna(subset=["channel", "campaign_id", "date"]).groupBy("channel", "campaign_id").agg((F.datediff(F.max("date"), F.min("date")) + 1).alias("n_days"))
    owners = features.select(*SEGMENT, "campaign_id").dropna().distinct()
    tier = F.when(F.col("n_days") < MIN_SHRINKAGE_DAYS, "skip").when(F.col("n_days") < MIN_CAMPAIGN_DAYS, "shrinkage").otherwise("own")
    return owners.join(span, ["channel", "campaign_id"]).select(*SEGMENT, "campaign_id", "n_days", tier.alias("tier"))


def shrinkage(features: DataFrame, parents: DataFrame) -> DataFrame:
    """Campaigns of 3 to 29 days as their segment's model, scaled by the ratio of mean levels;
    their own mean revenue and spend. parents: models of segments, best written before, with
    method and path if they were chosen; else the empirical ones."""
    for name, kind in (("method", "string"), ("path", "array<double>")):
        if name not in parents.columns:
            parents = parents.withColumn(name, F.lit("empirical" if name == "method" else None).cast(kind))
    own = daily(features, ("channel", "campaign_id")).groupBy("channel", "campaign_id").agg(F.avg("revenue").alias("level"), F.avg("spend").alias("own_spend"), F.max("date").alias("own_last"))
    shape = parents.select(*SEGMENT, "method", "slope", "level_at_end", "pool", "path", "dow", "holiday_factor", F.col("avg_revenue").alias("parent_level"))
    short = campaign_tiers(features).where("tier = 'shrinkage'").join(own, ["channel", "campaign_id"]).join(shape, list(SEGMENT))
    scaled = short.withColumn("scale", F.when(F.col("parent_level") > 0, F.col("level") / F.col("parent_level")).otherwise(0.0))
    times = lambda c: F.transform(c, lambda r: r * F.col("scale")).alias(c)
    return scaled.select(
        *SEGMENT, "campaign_id", "method", "n_days", "level", "scale", (F.col("slope") * F.col("scale")).alias("slope"), (F.col("level_at_end") * F.col("scale")).alias("level_at_end"),
        times("pool"), times("path"), "dow", "holiday_factor", F.col("own_last").alias("last_train_date"), F.col("own_spend").alias("avg_spend"), F.col("level").alias("avg_revenue"),
    )
