"""Statistics behind the narrative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds of the narrative.
PERIOD, Z, LOOKBACK, ZERO_SHARE, MIN_PEERS = 30, 2.0, 60, 0.25, 3


def _origin(features: DataFrame) -> DataFrame:
    return F.broadcast(features.agg(F.max("date").alias("origin")))  # one row


def period_deltas(features: DataFrame) -> DataFrame:
    """Revenue and spend by channel of the last 30 days against the 30 before."""
    rows = features.crossJoin(_origin(features))
    now = F.col("date") > F.date_sub("origin", PERIOD)
    then = (F.col("date") > F.date_sub("origin", 2 * PERIOD)) & ~now
    sums = rows.groupBy("channel").agg(*[F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0.0)).alias(f"{n}_{c}") for c in ("revenue", "spend") for n, w in (("now", now), ("then", then))])
    change = lambda c: F.when(F.col(f"then_{c}") > 0, (F.col(f"now_{c}") - F.col(f"then_{c}")) / F.col(f"then_{c}") * 100)
    money = [F.round(c, 4).alias(c) for c in ("now_revenue", "then_revenue", "now_spend", "then_spend")]
    return sums.select("channel", *money, *[F.round(change(c), 4).alias(f"{c}_change_pct") for c in ("revenue", "spend")])


def structural_risk(features: DataFrame, least: float = ZERO_SHARE) -> DataFrame:
    """Channels of which a quarter or more of the spending campaigns earned nothing."""
    sums = features.groupBy("channel", "campaign_id", "campaign_name").agg(F.sum("spend").alias("spend"), F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"))
    shares = sums.where("spend > 0").groupBy("channel").agg(F.count("*").alias("n_campaigns"), F.count_if(F.col("revenue") == 0).alias("n_zero"), F.coalesce(F.sum(F.when(F.col("revenue") == 0, F.col("spend"))), F.lit(0.0)).alias("wasted"))
    return shares.withColumn("share", F.col("n_zero") / F.col("n_campaigns")).where(F.col("share") >= least).select("channel", "n_campaigns", "n_zero", F.round("wasted", 4).alias("wasted_spend"), F.round("share", 6).alias("zero_share"))


def roas_anomalies(features: DataFrame, least: float = Z, most: int = 10) -> DataFrame:
    """Campaigns whose return lies far from that of their channel's others."""
    rows = features.crossJoin(_origin(features)).where(F.col("date") > F.date_sub("origin", LOOKBACK))
    sums = rows.groupBy("channel", "campaign_id", "campaign_name").agg(F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue")).where("spend > 0").withColumn("roas", F.col("revenue") / F.col("spend"))
    # a channel's campaigns are added up in parts; no task sees them all
    peers = sums.groupBy("channel").agg(F.avg("roas").alias("mean"), F.stddev_samp("roas").alias("sd"), F.count("*").alias("n"))
    told = sums.join(peers.where((F.col("n") >= MIN_PEERS) & (F.col("sd") > 0)), "channel")
    z = told.withColumn("z", (F.col("roas") - F.col("mean")) / F.col("sd")).where(F.abs("z") > least)
    return z.orderBy(F.abs("z").desc(), "campaign_id", "campaign_name").limit(most).select("channel", "campaign_id", "campaign_name", F.round("roas", 4).alias("roas"), F.round("z", 4).alias("z_score"))
