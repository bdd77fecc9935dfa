"""Dense daily series of segments and campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT, CAMPAIGN = ("channel", "campaign_type"), ("channel", "campaign_id")


def daily(features: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Revenue and spend of each day from a key's first to its last, 0 where it has
    no rows. Rows without a key are left out, as are null amounts from sums."""
    known = features.dropna(subset=[*keys, "date"])
    sums = known.groupBy(*keys, "date").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("revenue", "spend")])
    span = sums.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    calendar = span.select(*keys, F.explode(F.sequence("a", "b")).alias("date"))
    return calendar.join(sums, [*keys, "date"], "left").fillna(0.0, ["revenue", "spend"])


def last_days(series: DataFrame, keys: tuple[str, ...], days: int) -> DataFrame:
    """The last rows of each series, with position `x` from 0."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    kept = series.withColumn("newest", newest).where(F.col("newest") <= days).drop("newest")
    return kept.withColumn("x", F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1)


def run_rates(features: DataFrame, keys: tuple[str, ...], days: int, grain: str = "row") -> DataFrame:
    """Mean revenue and spend of the last days before the table's last date; of all
    days where a key has none. grain: `row`, mean of rows, or `daily`, of daily totals."""
    known = features.dropna(subset=list(keys))
    if grain == "daily":
        known = daily(known, keys)
    origin = features.agg(F.max("date").alias("origin"))  # one row
    recent = F.col("date") > F.date_sub("origin", days)
    rates = [F.coalesce(F.avg(F.when(recent, F.col(c))), F.avg(c), F.lit(0.0)).alias(c) for c in ("revenue", "spend")]
    return known.crossJoin(F.broadcast(origin)).groupBy(*keys, "origin").agg(*rates, (F.count(F.when(recent, 1)) == 0).alias("is_stale"))
