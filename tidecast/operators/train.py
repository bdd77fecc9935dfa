"""Training: the methods' contest, calibrated spread, and models of segments and campaigns.

A run goes through stage tables: series, contest, calibration, elasticities, models. Each is
written and read back, so that no stage plans or runs what went before it a second time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.expressions import ELASTICITY_BOOTSTRAPS, HORIZONS, N_SIMS
from tidecast.operators import backtest, fit
from tidecast.operators.methods import DEFAULT, FitMethod, fitted_by
from tidecast.operators.series import CAMPAIGN, SEGMENT, daily
from tidecast.operators.simulate import ROLLUP, forecast, forecast_campaigns, inflation, multiples, simulate
from tidecast.sources.store import Stages


@dataclass(frozen=True)
class Trained:
    """Written tables of a run: the contest's winners, models of segments and of campaigns."""

    contest: DataFrame
    segments: DataFrame
    campaigns: DataFrame


def by_day(features: DataFrame) -> DataFrame:
    """Revenue and spend of each campaign of a segment and day, nulls as groups of their own: what training
    reads of a fact table. It grows with campaigns and days, not with rows."""
    return features.groupBy(*ROLLUP, "date").agg(F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"))


def train(features: DataFrame, stages: Stages, n_sims: int = N_SIMS, resamples: int = ELASTICITY_BOOTSTRAPS, methods: dict[str, FitMethod] | None = None) -> Trained:
    """Models of all segments and campaigns of a fact table."""
    features = stages.keep("by-day", by_day(features))  # stages below read it eight times
    series = stages.keep("segment-series", daily(features))
    contest = stages.keep("contest", backtest.select_method(series, n_sims, methods))
    parents = stages.keep("segments", segments(series, contest, stages, n_sims, resamples, methods))
    return Trained(contest, parents, stages.keep("campaigns", campaigns(features, parents, stages, resamples, methods)))


def segments(series: DataFrame, contest: DataFrame, stages: Stages, n_sims: int = N_SIMS, resamples: int = ELASTICITY_BOOTSTRAPS, methods: dict[str, FitMethod] | None = None) -> DataFrame:
    """Models of all segments: winning method, calibrated spread, elasticity with limits."""
    chosen = contest.select(*SEGMENT, "method")
    scale = backtest.calibrate(series, n_sims, chosen, methods).select(*SEGMENT, F.col("scale").alias("calibration_scale"), F.col("coverage").alias("held_out_coverage"), "tuned")
    scale = stages.keep("calibration", scale)
    elastic = stages.keep("segment-elasticity", fit.elasticity(series, resamples=resamples))
    own = fitted_by(series, chosen, SEGMENT, methods).join(elastic, list(SEGMENT))
    told = own.join(scale, list(SEGMENT), "left").withColumn("calibration_scale", F.coalesce("calibration_scale", F.lit(1.0)))
    return told.withColumn("spread", inflation(F.col("channel")) * F.col("calibration_scale"))


def campaigns(features: DataFrame, parents: DataFrame, stages: Stages, resamples: int = ELASTICITY_BOOTSTRAPS, methods: dict[str, FitMethod] | None = None) -> DataFrame:
    """Models of campaigns of three days or more: an own fit by the segment's method from 30
    days on, else the segment's model, scaled. parents: from segments(). Their spread is the
    channel's alone, not calibrated. An id in two segments has one series: it is fitted once by
    either one's method, and its elasticity holds in both."""
    tiers = stages.keep("tiers", fit.campaign_tiers(features).where("tier <> 'skip'"))
    series = stages.keep("campaign-series", daily(features, CAMPAIGN))
    elastic = stages.keep("campaign-elasticity", fit.elasticity(series, CAMPAIGN, resamples))
    owned = tiers.where("tier = 'own'").join(parents.select(*SEGMENT, "method"), list(SEGMENT), "left").withColumn("method", F.coalesce("method", F.lit(DEFAULT)))
    fits = stages.keep("campaign-fits", fitted_by(series, owned.select(*CAMPAIGN, "method").distinct(), CAMPAIGN, methods))
    own = owned.join(fits, [*CAMPAIGN, "method"])
    shrunk = fit.shrinkage(features, parents).drop("level", "scale")
    names = [*ROLLUP, "method", "n_days", "slope", "level_at_end", "dow", "holiday_factor", "pool", "path", "last_train_date", "avg_spend", "avg_revenue"]
    both = own.select(*names, F.lit(False).alias("is_shrinkage")).unionByName(shrunk.select(*names, F.lit(True).alias("is_shrinkage")))
    return both.join(elastic, list(CAMPAIGN)).withColumn("spread", inflation(F.col("channel")))


MODEL = [*ROLLUP, "method", "is_shrinkage", "slope", "level_at_end", "holiday_factor", "avg_spend", "avg_revenue", "beta", "beta_for_scenario", "low_confidence", "spread"]


def one_table(trained: Trained) -> DataFrame:
    """All models, a segment's with campaign_id ''."""
    parents = trained.segments.withColumn("campaign_id", F.lit("")).withColumn("is_shrinkage", F.lit(False))
    return parents.select(MODEL).unionByName(trained.campaigns.select(MODEL))


def trained_forecast(trained: Trained, horizons: tuple[int, ...] = HORIZONS, n_sims: int = N_SIMS, **multiple) -> DataFrame:
    """Forecasts at segment, channel, blended and campaign grain."""
    spread, models, own = F.col("spread"), trained.segments, trained.campaigns
    out = forecast(models, simulate(models, SEGMENT, horizons, n_sims, spread), multiples(models, **multiple))
    return out.unionByName(forecast_campaigns(own, multiples(own, **multiple), horizons, n_sims, spread))
