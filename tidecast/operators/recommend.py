"""Moves of budget between segments, priced on shared simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.expressions import MIN_DONOR_SPEND, MOST_RECEIVER, N_SIMS, POOL, SEARCH_SIMS, SHIFT, TOP, response, rounded
from tidecast.operators import fit
from tidecast.operators.series import SEGMENT, daily
from tidecast.operators.simulate import scenario_beta


def eligible(models: DataFrame) -> DataFrame:
    return models.where(~F.coalesce("low_confidence", F.lit(True)) & (F.col("avg_spend") >= MIN_DONOR_SPEND))


def pairs(models: DataFrame) -> DataFrame:
    """The three of least response to the three of most, at most nine rows."""
    own = eligible(models).select(*SEGMENT, "avg_spend", "beta")
    side = lambda order, prefix: own.orderBy(order, *SEGMENT).limit(POOL).select(*[F.col(c).alias(f"{prefix}_{n}") for c, n in zip(own.columns, ("channel", "type", "spend", "beta"), strict=True)])
    both = side(F.asc("beta"), "donor").crossJoin(side(F.desc("beta"), "receiver"))  # POOL rows each
    apart = both.where((F.col("donor_channel") != F.col("receiver_channel")) | (F.col("donor_type") != F.col("receiver_type")))
    shift = F.col("donor_spend") * SHIFT
    multiple = F.when(F.col("receiver_spend") > 0, F.least((F.col("receiver_spend") + shift) / F.col("receiver_spend"), F.lit(MOST_RECEIVER))).otherwise(1.0)
    return apart.select("*", shift.alias("shift"), F.lit(1 - SHIFT).alias("donor_multiple"), multiple.alias("receiver_multiple"), (multiple < MOST_RECEIVER).alias("spend_conserved"))


MULTIPLES = ("donor_multiple", "receiver_multiple")
PAIR = ("donor_channel", "donor_type", "receiver_channel", "receiver_type")


def priced(models: DataFrame, candidates: DataFrame, sims: DataFrame, horizon: int = 90, n_sims: int = SEARCH_SIMS) -> DataFrame:
    """Median blended revenue and return of each candidate against no change, all from
    the same simulations: a scenario is the baseline's sums times a factor."""
    own = models.select(*SEGMENT, "avg_spend", F.col(scenario_beta(models)).alias("beta"))
    each = F.broadcast(candidates).crossJoin(own)  # nine candidates at most
    donor = (F.col("donor_channel") == F.col("channel")) & (F.col("donor_type") == F.col("campaign_type"))
    receiver = (F.col("receiver_channel") == F.col("channel")) & (F.col("receiver_type") == F.col("campaign_type"))
    multiple = F.when(donor, F.col("donor_multiple")).when(receiver, F.col("receiver_multiple")).otherwise(1.0)
    told = each.withColumn("m", multiple).withColumn("scale", response(F.col("m"), F.col("beta")))
    used = sims.where((F.col("horizon_days") == horizon) & (F.col("sim") < n_sims))
    sums = [F.sum("revenue").alias("base"), F.sum(F.col("revenue") * F.col("scale")).alias("moved"), F.sum(F.col("avg_spend") * horizon).alias("spend"), F.sum(F.col("avg_spend") * F.col("m") * horizon).alias("moved_spend")]
    paths = told.select(*PAIR, *SEGMENT, "avg_spend", "m", "scale").join(used, list(SEGMENT)).groupBy(*PAIR, "sim").agg(*sums)
    middle = paths.groupBy(*PAIR).agg(F.percentile("base", F.lit(0.5)).alias("base"), F.percentile("moved", F.lit(0.5)).alias("moved"), F.max("spend").alias("spend"), F.max("moved_spend").alias("moved_spend"))
    roas = lambda r, s: F.when(F.col(s) > 0, F.col(r) / F.col(s))
    delta = F.col("moved") - F.col("base")
    return middle.select(*PAIR, "base", "moved", delta.alias("revenue_delta"), F.when(F.col("base") > 0, delta / F.col("base") * 100).alias("delta_pct"), roas("base", "spend").alias("base_roas"), roas("moved", "moved_spend").alias("moved_roas"))


def top(candidates: DataFrame, most: int = TOP) -> DataFrame:
    return candidates.orderBy(F.desc_nulls_last("revenue_delta"), *PAIR).limit(most)


def finalists(models: DataFrame, candidates: DataFrame, sims: DataFrame, horizon: int = 90, most: int = TOP) -> DataFrame:
    """The best few of the search, priced again on all simulations; `place` is that of the search.
    candidates: from pairs(), sims: of N_SIMS simulations, of which the search uses the first ones."""
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("revenue_delta"), *PAIR))  # nine rows at most
    found = priced(models, candidates, sims, horizon).select(*PAIR, place.alias("place")).where(F.col("place") <= most)
    chosen = candidates.join(F.broadcast(found), list(PAIR))
    again = priced(models, chosen, sims, horizon, N_SIMS)
    slopes = models.select(*SEGMENT, "beta", "ci_low", "ci_high")
    side = lambda p: slopes.select(F.col("channel").alias(f"{p}_channel"), F.col("campaign_type").alias(f"{p}_type"), *[F.round(c, 2).alias(f"{p}_{c}") for c in ("beta", "ci_low", "ci_high")])
    told = again.join(chosen.select(*PAIR, "place", F.round("shift", 2).alias("shift_daily"), *MULTIPLES), list(PAIR)).join(side("donor"), list(PAIR[:2])).join(side("receiver"), list(PAIR[2:]))
    return told.select(
        "place", *PAIR, "shift_daily", *[f"{p}_{c}" for p in ("donor", "receiver") for c in ("beta", "ci_low", "ci_high")], F.lit(horizon).alias("horizon_days"), F.round("base", 2).alias("base"), F.round("moved", 2).alias("moved"),
        rounded(F.col("revenue_delta"), 2).alias("revenue_delta"), rounded(F.col("delta_pct"), 1).alias("delta_pct"), F.round("base_roas", 2).alias("base_roas"), F.round("moved_roas", 2).alias("moved_roas"), F.lit("high").alias("confidence"), *MULTIPLES,
    )


def confirmed(pairs: DataFrame) -> DataFrame:
    """Of retrospective pairs, how many were scored and confirmed: of all, and of each cutoff's first one."""
    rates = lambda rows, name: rows.where("confirmed is not null").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("n_confirmed")).select(F.lit(name).alias("part"), "n", "n_confirmed", F.when(F.col("n") > 0, F.round(F.col("n_confirmed") / F.col("n") * 100, 1)).alias("rate_pct"))
    order = F.row_number().over(Window.partitionBy("cutoff").orderBy("donor_rank", "receiver_rank"))
    return rates(pairs, "grid").unionByName(rates(pairs.withColumn("first_", order).where("first_ = 1"), "top_pick"))


def retrospective(features: DataFrame, offsets: tuple[int, ...], least_days: int, resamples: int) -> DataFrame:
    """At past cutoffs, whether receivers went on to return more than donors."""
    last = features.agg(F.max("date").alias("b"))
    own = eligible(fit.elasticity_at(daily(features), offsets, last, SEGMENT, resamples).where(F.col("n_days") >= least_days))
    place = lambda order: F.row_number().over(Window.partitionBy("cutoff").orderBy(order, *SEGMENT))
    ranked = own.withColumns({"low": place(F.asc("beta")), "high": place(F.desc("beta"))})
    side = lambda p, rank: ranked.where(F.col(rank) <= POOL).select("cutoff", F.col("channel").alias(f"{p}_channel"), F.col("campaign_type").alias(f"{p}_type"), F.col("roas_after").alias(f"{p}_roas"), F.col(rank).alias(f"{p}_rank"))
    both = side("donor", "low").join(side("receiver", "high"), "cutoff").where((F.col("donor_channel") != F.col("receiver_channel")) | (F.col("donor_type") != F.col("receiver_type")))
    return both.withColumn("confirmed", F.col("receiver_roas") > F.col("donor_roas"))
