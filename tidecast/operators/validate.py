"""Consistency checks of raw campaign rows; each gives rows of (channel, check, campaign, number)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.expressions import GAP_DAYS, OVERSPEND

CAMPAIGN = ("channel", "campaign_id")
CHECKS = ("unstable_campaign_name", "unstable_campaign_type", "date_coverage_gap", "spend_exceeds_daily_budget", "conversions_exceed_clicks", "negative_spend", "negative__spend_derived", "negative_revenue", "negative_clicks", "negative_conversions", "negative_impressions", "zero_revenue_with_spend")
AMOUNTS = ("spend", "revenue", "clicks", "conversions", "impressions")


def unstable(raw: DataFrame, column: str) -> DataFrame:
    found = raw.dropna(subset=["campaign_id"]).groupBy(*CAMPAIGN).agg(F.count_distinct(column).alias("n"))
    return found.where("n > 1").select(*CAMPAIGN, F.lit(f"unstable_{column}").alias("issue"), F.col("n").cast("double").alias("amount"))


def unstable_values(raw: DataFrame, column: str) -> DataFrame:
    """unstable(), with the values themselves, in the order of their first day (then by name)."""
    first = raw.dropna(subset=["campaign_id", column]).groupBy(*CAMPAIGN, column).agg(F.min("date").alias("first"))
    found = first.groupBy(*CAMPAIGN).agg(F.array_sort(F.collect_list(F.struct(F.col("first").isNull().alias("undated"), "first", F.col(column).alias("value")))).alias("seen")).where(F.size("seen") > 1)
    return found.select(*CAMPAIGN, F.lit(f"unstable_{column}").alias("issue"), F.size("seen").cast("double").alias("amount"), F.col("seen.value").alias("values"))


def date_gaps(raw: DataFrame) -> DataFrame:
    days = raw.dropna(subset=["campaign_id", "date"]).select(*CAMPAIGN, "date").distinct()
    gap = days.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy(*CAMPAIGN).orderBy("date"))))
    found = gap.groupBy(*CAMPAIGN).agg(F.max("gap").alias("gap")).where(F.col("gap") > GAP_DAYS)
    return found.select(*CAMPAIGN, F.lit("date_coverage_gap").alias("issue"), F.col("gap").cast("double").alias("amount"))


def over_budget(raw: DataFrame) -> DataFrame:
    rows = raw.where((F.col("daily_budget") > 0) & (F.col("spend") > F.col("daily_budget") * OVERSPEND))
    found = rows.groupBy(*CAMPAIGN).agg(F.count("*").alias("n"), F.max((F.col("spend") - F.col("daily_budget")) / F.col("daily_budget") * 100).alias("most"))
    return found.select(*CAMPAIGN, F.lit("spend_exceeds_daily_budget").alias("issue"), F.col("n").cast("double").alias("amount"), F.round("most", 1).alias("max_overspend_pct"))


def conversions_over_clicks(raw: DataFrame) -> DataFrame:
    """Not for meta, which gives no conversions."""
    found = raw.where((F.col("channel") != "meta") & (F.col("conversions") > F.col("clicks"))).groupBy(*CAMPAIGN).agg(F.count("*").alias("n"))
    return found.select(*CAMPAIGN, F.lit("conversions_exceed_clicks").alias("issue"), F.col("n").cast("double").alias("amount"))


def negative(raw: DataFrame, columns: tuple[str, ...] = AMOUNTS) -> DataFrame:
    """Of the columns that there are. Google's spend is derived from millionths, and named so."""
    known = [c for c in columns if c in raw.columns]
    each = raw.select(*CAMPAIGN, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in known])))
    name = F.when((F.col("channel") == "google") & (F.col("column") == "spend"), "_spend_derived").otherwise(F.col("column"))
    found = each.where("value < 0").groupBy(*CAMPAIGN, name.alias("column")).agg(F.count("*").alias("n"))
    return found.select(*CAMPAIGN, F.concat(F.lit("negative_"), "column").alias("issue"), F.col("n").cast("double").alias("amount"))


def zero_revenue(raw: DataFrame) -> DataFrame:
    sums = raw.groupBy(*CAMPAIGN, "campaign_name").agg(F.sum("spend").alias("spend"), F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"))
    return sums.where("spend > 0 and revenue = 0").select(*CAMPAIGN, F.lit("zero_revenue_with_spend").alias("issue"), F.round("spend", 4).alias("amount"))


def issues(raw: DataFrame) -> DataFrame:
    parts = [unstable(raw, "campaign_name"), unstable(raw, "campaign_type"), date_gaps(raw), over_budget(raw).drop("max_overspend_pct"), conversions_over_clicks(raw), negative(raw), zero_revenue(raw)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(raw: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Issues by check, zeros included. found: issues(raw), where they are written already."""
    names = raw.sparkSession.createDataFrame([(c,) for c in CHECKS], "issue string")
    return names.join((issues(raw) if found is None else found).groupBy("issue").count(), "issue", "left").select("issue", F.coalesce("count", F.lit(0)).alias("n_issues"))


def channels(raw: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Each channel's campaigns, rows and issues."""
    sizes = raw.groupBy("channel").agg(F.count_distinct("campaign_id").alias("n_campaigns"), F.count("*").alias("n_rows"))
    counts = (issues(raw) if found is None else found).groupBy("channel").agg(F.count("*").alias("n"))
    return sizes.join(counts, "channel", "left").select("channel", "n_campaigns", "n_rows", F.coalesce("n", F.lit(0)).alias("n_issues"))


def report(every: DataFrame) -> DataFrame:
    """(channel, n_campaigns, n_rows, n_rejects, issue, n_issues): each platform's raw rows and what the checks
    find in those that could be read; one row with a null issue where they find nothing. every: checked()
    rows of all platforms, written before, as each check reads them. A platform without campaign types
    isn't checked for them."""
    read = every.where("not reject")
    sizes = every.groupBy("channel").agg(F.count_distinct(F.when(~F.col("reject"), F.col("campaign_id"))).alias("n_campaigns"), F.count_if(~F.col("reject")).alias("n_rows"), F.count_if("reject").alias("n_rejects"))
    found = issues(read).where("channel <> 'meta' or issue <> 'unstable_campaign_type'").groupBy("channel", "issue").agg(F.count("*").alias("n_issues"))
    return sizes.join(found, "channel", "left")


def examples(raw: DataFrame, most: int = 5, found: DataFrame | None = None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("channel", "issue").orderBy("campaign_id", "amount"))
    return (issues(raw) if found is None else found).withColumn("place", place).where(F.col("place") <= most)
