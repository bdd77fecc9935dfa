"""The fact table over the tables of a test scale, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.expressions import funnel_stage
from tidecast.sources.channels import RAW


def features(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_brand", "p_name", "p_retailprice")
    # parts grow with the tables and unpack to many times their files' size: never broadcast
    joined = lines.join(parts.hint("shuffle_hash"), lines["l_partkey"] == parts["p_partkey"])
    channel = F.when(F.col("l_returnflag") == "A", "bing").when(F.col("l_returnflag") == "N", "google").otherwise("meta")
    name = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("remarketing_"), "p_name")).otherwise(F.col("p_name"))
    more = [(F.col("l_quantity") * 3).cast("int").alias("clicks"), F.col("p_retailprice").alias("daily_budget"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") * 30).cast("int").alias("impressions")] if extra else []
    rows = joined.select(
        F.to_date("l_shipdate").alias("date"), channel.alias("channel"), F.concat_ws("_", "p_type", "p_brand").alias("campaign_id"), name.alias("campaign_name"), F.col("p_type").alias("campaign_type"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("spend"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("double")).alias("conversions"), F.lit(False).alias("revenue_is_imputed"), *more,
    )
    return rows.withColumn("funnel_stage", funnel_stage(F.col("campaign_name")))


def faulty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with faults that checks must find: more conversions than clicks, refunds and
    negative spend, and campaigns that earn nothing."""
    rows = features(spark, sf_dir, extra=True)
    idle = F.substring("campaign_id", -1, 1).isin("1", "2", "5")
    refund, back = (F.col("line") == 5) & (F.col("clicks") % 30 == 0), (F.col("line") == 6) & (F.col("clicks") % 10 == 0)
    return rows.withColumns({
        "conversions": F.when(F.col("line") == 7, F.col("conversions") + F.col("clicks")).otherwise(F.col("conversions")),
        "revenue": F.when(idle, F.lit(0.0)).when(refund, -F.col("revenue")).otherwise(F.col("revenue")),
        "spend": F.when(back, -F.col("spend")).otherwise(F.col("spend")),
    })


def _exported(rows: DataFrame, channel: str) -> DataFrame:
    rows = rows.where(F.col("channel") == channel).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    if channel == "google":
        rows = rows.withColumn("spend", F.round(F.col("spend") * 1e6).cast("long"))
    return rows.withColumns({c: F.col(c).cast("string") for c in RAW[channel]})


def platform_rows(spark: SparkSession, sf_dir: str, channel: str) -> DataFrame:
    """A channel's facts as its platform exports them: its names, all text, Google's money in millionths."""
    rows = _exported(features(spark, sf_dir, extra=True), channel)
    return rows.select(*[F.col(ours).alias(theirs) for ours, theirs in RAW[channel].items()])


def platform_lines(spark: SparkSession, sf_dir: str, channel: str) -> tuple[list[str], DataFrame]:
    """The header and the lines (value) of a channel's CSV, with faulty rows; some lines are broken: a
    number that is none, or a field too few."""
    rows = _exported(faulty_features(spark, sf_dir).withColumn("hurt", (F.col("line") == 4) & (F.col("clicks") % 30 == 0)), channel)
    rows = rows.withColumn("spend", F.when(F.col("hurt") & (F.col("clicks") % 60 == 0), "n/a").otherwise(F.col("spend")))
    line = F.to_csv(F.struct(*[F.col(ours).alias(theirs) for ours, theirs in RAW[channel].items()]))
    short = F.col("hurt") & (F.col("clicks").cast("int") % 60 != 0)
    return list(RAW[channel].values()), rows.select(F.when(short, F.regexp_replace(line, ",[^,]*$", "")).otherwise(line).alias("value"))


def short_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second fact table, of short histories: users as campaigns of event types."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    spend = F.when(F.col("event_id") % 2 == 0, F.col("value") / 4).otherwise(0.0)
    return events.select(
        F.to_date("ts").alias("date"), F.col("event_type").alias("channel"), F.col("user_id").cast("string").alias("campaign_id"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("campaign_name"), F.col("event_type").alias("campaign_type"),
        spend.alias("spend"), F.col("value").alias("revenue"), F.lit(None).cast("double").alias("conversions"), F.lit(False).alias("revenue_is_imputed"), F.lit("prospecting").alias("funnel_stage"),
    )


SHORT_SQL = """features AS (SELECT CAST(ts AS DATE) AS date, event_type AS channel, CAST(user_id AS VARCHAR) AS campaign_id, 'user_' || CAST(user_id AS VARCHAR) AS campaign_name, event_type AS campaign_type,
 CASE WHEN event_id % 2 = 0 THEN value / 4 ELSE 0 END AS spend, value AS revenue FROM events)"""
FEATURES_SQL = """features AS (SELECT CAST(l_shipdate AS DATE) AS date, CASE l_returnflag WHEN 'A' THEN 'bing' WHEN 'N' THEN 'google' ELSE 'meta' END AS channel,
 p_type || '_' || p_brand AS campaign_id, CASE WHEN l_linestatus = 'F' THEN 'remarketing_' || p_name ELSE p_name END AS campaign_name, p_type AS campaign_type,
 l_extendedprice * l_tax AS spend, l_extendedprice * (1 - l_discount) AS revenue, CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS DOUBLE) END AS conversions, false AS revenue_is_imputed,
 CASE WHEN l_linestatus = 'F' OR contains(lower(p_name), 'remarketing') OR contains(lower(p_name), 'retarget') OR contains(lower(p_name), '_tm_') THEN 'high_intent' ELSE 'prospecting' END AS funnel_stage,
 CAST(l_quantity * 3 AS INTEGER) AS clicks, p_retailprice AS daily_budget, l_linenumber AS line, CAST(l_quantity * 30 AS INTEGER) AS impressions FROM lineitem JOIN part ON l_partkey = p_partkey)"""
FAULTY_SQL = FEATURES_SQL.replace("features AS (", "clean AS (", 1) + """, features AS (SELECT * REPLACE (CASE WHEN line = 7 THEN conversions + clicks ELSE conversions END AS conversions,
 CASE WHEN right(campaign_id, 1) IN ('1', '2', '5') THEN 0 WHEN line = 5 AND clicks % 30 = 0 THEN -revenue ELSE revenue END AS revenue, CASE WHEN line = 6 AND clicks % 10 = 0 THEN -spend ELSE spend END AS spend) FROM clean)"""
RAW_SQL = FEATURES_SQL + """
SELECT date, channel, campaign_id, campaign_name, CASE WHEN channel = 'meta' THEN regexp_replace(campaign_name, '_Campaign_[0-9]+$', '') ELSE campaign_type END AS campaign_type,
 round(CASE WHEN channel = 'google' THEN round(spend * 1e6) / 1e6 ELSE spend END, 6) AS spend, round(revenue, 6) AS revenue, conversions, revenue_is_imputed, funnel_stage,
 CAST(clicks AS DOUBLE) AS clicks, CAST(impressions AS DOUBLE) AS impressions, CAST(daily_budget AS DOUBLE) AS daily_budget FROM features"""
