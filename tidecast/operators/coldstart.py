"""Forecasts without a trained model: the run rate, carried on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.expressions import COLD_RESIDUAL, HORIZONS, RUN_RATE_DAYS
from tidecast.operators.series import SEGMENT, run_rates

#: Means of amounts in cents often end on a 5; this lifts them over the rounding tie
#: whatever the order of summation was.
TIE = 1e-7
FORECAST = ["channel", "campaign_type", "campaign_id", "horizon_days", "metric", "p10", "p50", "p90"]


#: What levels follow from: sums and counts of a key's rows, of all and (late_) of the recent ones.
SUMS = ("revenue", "n_revenue", "spend", "n_spend", "n_rows")
STATE_KEYS = (*SEGMENT, "campaign_id")


def levels(features: DataFrame, grain: str = "row") -> DataFrame:
    """Daily revenue and spend of segments (campaign_id '') and campaigns. A campaign's
    run rate doesn't depend on its type, so one id in two types shares a level.
    By rows, one aggregate by segment and campaign serves all grains."""
    if grain == "row":
        origin = features.agg(F.max("date").alias("origin"))  # one row
        late = F.coalesce(F.col("date") > F.date_sub("origin", RUN_RATE_DAYS), F.lit(False))
        rows = features.crossJoin(F.broadcast(origin)).withColumn("late", late)
        of = {"": F.lit(True), "late_": F.col("late")}
        sums = [x for p, w in of.items() for x in (*(y for c in ("revenue", "spend") for y in (F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0.0)).alias(p + c), F.count(F.when(w, F.col(c))).alias(f"{p}n_{c}"))), F.count_if(w).alias(f"{p}n_rows"))]
        return levels_of(rows.groupBy(*STATE_KEYS).agg(*sums))
    segments = run_rates(features, SEGMENT, RUN_RATE_DAYS, grain).select(*SEGMENT, F.lit("").alias("campaign_id"), "revenue", "spend", "is_stale")
    rates = run_rates(features, ("channel", "campaign_id"), RUN_RATE_DAYS, grain)
    owners = features.select(*SEGMENT, "campaign_id").dropna().distinct()
    campaigns = owners.join(rates, ["channel", "campaign_id"]).select(*SEGMENT, "campaign_id", "revenue", "spend", "is_stale")
    return segments.unionByName(campaigns)


def levels_of(sums: DataFrame) -> DataFrame:
    """levels() by rows, from rows of sums that add up: (STATE_KEYS, SUMS, late_ SUMS)."""

    def rates(*keys: str, **more) -> DataFrame:
        total = [F.sum(p + c).alias(p + c) for p in ("", "late_") for c in SUMS]
        every = sums.dropna(subset=list(keys)).groupBy(*keys).agg(*total, *[v.alias(k) for k, v in more.items()])
        mean = lambda c: F.coalesce(F.try_divide(f"late_{c}", f"late_n_{c}"), F.try_divide(c, f"n_{c}"), F.lit(0.0)).alias(c)
        return every.select(*keys, *more, mean("revenue"), mean("spend"), (F.col("late_n_rows") == 0).alias("is_stale"))

    campaigns = rates("channel", "campaign_id", types=F.collect_set("campaign_type")).withColumn("campaign_type", F.explode("types"))
    names = [*STATE_KEYS, "revenue", "spend", "is_stale"]
    return rates(*SEGMENT).withColumn("campaign_id", F.lit("")).select(names).unionByName(campaigns.select(names))


def expected_day(level: F.Column, parent: F.Column | None = None) -> F.Column:
    """Revenue of a simulated day: the level and the one residual that a cold model has.
    A campaign's residual is its parent's, scaled by their levels."""
    own = F.when(level > 0, level * COLD_RESIDUAL).otherwise(F.lit(1.0))
    if parent is None:
        return F.greatest(F.lit(0.0), F.greatest(level, F.lit(0.0)) + own)
    residual = F.when(parent > 0, parent * COLD_RESIDUAL).otherwise(F.lit(1.0))
    scale = F.when(level / F.when(parent == 0, F.lit(1.0)).otherwise(parent) < 0, F.lit(1.0)).otherwise(level / F.when(parent == 0, F.lit(1.0)).otherwise(parent))
    return F.greatest(F.lit(0.0), F.greatest(level, F.lit(0.0)) + residual * scale)


def daily_levels(features: DataFrame, grain: str = "row") -> DataFrame:
    every = levels(features, grain)
    parents = every.where("campaign_id = ''").select(*SEGMENT, F.col("revenue").alias("parent"))
    joined = every.join(parents, list(SEGMENT), "left")
    day = F.when(F.col("campaign_id") == "", expected_day(F.col("revenue"))).otherwise(expected_day(F.col("revenue"), F.col("parent")))
    return joined.select(*SEGMENT, "campaign_id", day.alias("day"), "spend")


def forecast(features: DataFrame, rollup: bool = True, horizons: tuple[int, ...] = HORIZONS, grain: str = "row") -> DataFrame:
    """Revenue and return on spend at segment and campaign grain, and (rollup) summed
    over segments by channel and in all. All percentiles are the same number."""
    own = daily_levels(features, grain)
    if rollup:
        segments = own.where("campaign_id = ''")
        sums = [F.sum("day").alias("day"), F.sum("spend").alias("spend")]
        channels = segments.groupBy("channel").agg(*sums).select("channel", F.lit("").alias("campaign_type"), F.lit("").alias("campaign_id"), "day", "spend")
        total = segments.agg(*sums).where("day is not null").select(F.lit("blended").alias("channel"), F.lit("").alias("campaign_type"), F.lit("").alias("campaign_id"), "day", "spend")
        own = own.unionByName(channels).unionByName(total)
    each = own.withColumn("horizon_days", F.explode(F.array(*map(F.lit, horizons))))
    revenue = F.struct(F.lit("revenue").alias("metric"), (F.col("day") * F.col("horizon_days")).alias("value"))
    roas = F.when(F.col("spend") > 0, F.struct(F.lit("roas").alias("metric"), (F.col("day") / F.col("spend")).alias("value")))
    rows = each.select("channel", "campaign_type", "campaign_id", "horizon_days", F.inline(F.array_compact(F.array(revenue, roas))))
    value = F.round(F.col("value") + TIE, 4)
    return rows.select("channel", "campaign_type", "campaign_id", "horizon_days", "metric", value.alias("p10"), value.alias("p50"), value.alias("p90"))


def upsert(models: DataFrame, features: DataFrame, grain: str = "row") -> DataFrame:
    """Models with their levels refreshed from features: known keys keep slope, factors
    and residuals, new keys start cold, keys without rows stay as they are.
    models: channel, campaign_type, campaign_id, method, slope, level."""
    return refreshed(models, levels(features, grain))


def refreshed(models: DataFrame, now: DataFrame) -> DataFrame:
    """Models with the levels `now` (from levels(): keys and revenue)."""
    keys = [*SEGMENT, "campaign_id"]
    both = models.join(now.select(*keys, F.col("revenue").alias("now")), keys, "full")
    keeps = (F.col("method") == "holt_winters") | F.col("now").isNull()
    return both.select(*keys, F.coalesce("method", F.lit("empirical")).alias("method"), F.coalesce("slope", F.lit(0.0)).alias("slope"), F.when(keeps, F.col("level")).otherwise(F.col("now")).alias("level"))


def day_sums(features: DataFrame) -> DataFrame:
    """(keys, date, sums): the rows of a batch, added up. Keys and dates may be null."""
    money = [x for c in ("revenue", "spend") for x in (F.coalesce(F.sum(c), F.lit(0.0)).alias(c), F.count(c).alias(f"n_{c}"))]
    return features.groupBy(*STATE_KEYS, "date").agg(*money, F.count("*").alias("n_rows"))


def added(state: DataFrame | None, more: DataFrame, *keys: str) -> DataFrame:
    """Sums by key of what is held and what has come."""
    both = more.select(*keys, *SUMS) if state is None else state.unionByName(more.select(*keys, *SUMS))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def state_sums(totals: DataFrame, recent: DataFrame) -> DataFrame:
    """What levels_of() reads, from totals (STATE_KEYS, SUMS) of all time and recent (STATE_KEYS, date,
    SUMS) of the last RUN_RATE_DAYS days alone."""
    none = {c: F.lit(0).cast("double" if c in ("revenue", "spend") else "long") for c in SUMS}
    ever = totals.select(*STATE_KEYS, *SUMS, *[v.alias(f"late_{c}") for c, v in none.items()])
    return ever.unionByName(recent.select(*STATE_KEYS, *[v.alias(c) for c, v in none.items()], *[F.col(c).alias(f"late_{c}") for c in SUMS]))
