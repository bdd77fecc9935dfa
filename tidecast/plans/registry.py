"""All queries of the forecast engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions import expressions as X
from tidecast.operators import backtest, coldstart, fit, holt_winters, methods, narrative, recommend, reports, requests, series, simulate, stats, train, validate
from tidecast.plans import sql as S
from tidecast.sources import channels
from tidecast.sources.adaptors import FAULTY_SQL, FEATURES_SQL, RAW_SQL, SHORT_SQL, faulty_features, features, platform_lines, platform_rows, short_features
from tidecast.sources.channels import RAW, normalised
from tidecast.sources.store import Stages

SIMS, RESAMPLES = X.N_SIMS, X.ELASTICITY_BOOTSTRAPS
SEG = series.SEGMENT
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coldstart_rollup(spark, sf_dir)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense series, a row a segment and day: written, as fits read it several times."""
    return Stages(spark).keep("series", series.daily(features(spark, sf_dir)))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table with clicks and budgets: written, as each check reads it."""
    return Stages(spark).keep("facts", features(spark, sf_dir, extra=True))


NORMAL = "channel, campaign_id, campaign_name, campaign_type, conversions, revenue_is_imputed, funnel_stage, round(spend, 4) AS spend, round(revenue, 4) AS revenue"


@query(S.with_() + f"SELECT date, {NORMAL} FROM features")
def features_normalized(spark, sf_dir):
    return features(spark, sf_dir).withColumn("spend", F.round("spend", 4)).withColumn("revenue", F.round("revenue", 4))


@query(S.with_() + "SELECT channel, funnel_stage, count(*) AS n, count(DISTINCT campaign_name) AS n_names FROM features GROUP BY ALL")
def funnel_stage(spark, sf_dir):
    return features(spark, sf_dir).groupBy("channel", "funnel_stage").agg(F.count("*").alias("n"), F.count_distinct("campaign_name").alias("n_names"))


@query("SELECT regexp_replace(p_name || '_Campaign_' || p_partkey, '_Campaign_[0-9]+$', '') AS campaign_type, count(*) AS n FROM part GROUP BY 1")
def campaign_type_suffix(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    named = F.concat("p_name", F.lit("_Campaign_"), F.col("p_partkey").cast("string"))
    return parts.select(X.type_of_name(named).alias("campaign_type")).groupBy("campaign_type").agg(F.count("*").alias("n"))


@query(S.with_() + "SELECT channel, count(*) AS n, round(sum(spend), 4) AS spend, round(sum(revenue), 4) AS revenue FROM features GROUP BY ALL")
def channel_union(spark, sf_dir):
    rows = features(spark, sf_dir)
    parts = [rows.where(F.col("channel") == c) for c in ("bing", "google", "meta")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum("spend"), 4).alias("spend"), F.round(F.sum("revenue"), 4).alias("revenue"))


@query(S.with_(S.DAILY) + "SELECT channel, campaign_type, date, round(revenue, 4) AS revenue, round(spend, 4) AS spend FROM seg")
def daily_segment_series(spark, sf_dir):
    return _segments(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("revenue", "spend")})


@query(S.with_(S.daily("camp", "channel, campaign_id")) + "SELECT channel, campaign_id, count(*) AS n_days, round(sum(revenue), 4) AS revenue, round(sum(spend), 4) AS spend, count(*) FILTER (revenue = 0) AS n_zero FROM camp GROUP BY ALL")
def daily_campaign_series(spark, sf_dir):
    rows = series.daily(features(spark, sf_dir), series.CAMPAIGN)
    return rows.groupBy(*series.CAMPAIGN).agg(F.count("*").alias("n_days"), F.round(F.sum("revenue"), 4).alias("revenue"), F.round(F.sum("spend"), 4).alias("spend"), F.count_if(F.col("revenue") == 0).alias("n_zero"))


@query(S.cold(False, "campaign_id = ''"))
def coldstart_segment(spark, sf_dir):
    return coldstart.forecast(features(spark, sf_dir), rollup=False).where("campaign_id = ''")


@query(S.cold(False, "campaign_id <> ''"))
def coldstart_campaign(spark, sf_dir):
    return coldstart.forecast(features(spark, sf_dir), rollup=False).where("campaign_id <> ''")


@query(S.cold(True))
def coldstart_rollup(spark, sf_dir):
    return coldstart.forecast(features(spark, sf_dir))


@query(S.with_(S.LEVELS) + """, models AS (SELECT channel, campaign_type, campaign_id, CASE WHEN campaign_type < 'M' THEN 'holt_winters' ELSE 'empirical' END AS method, 2.0 AS slope, 7.0 AS level FROM lev WHERE campaign_id = '' UNION ALL SELECT 'other', 'gone', '', 'empirical', 1.0, 5.0)
SELECT coalesce(m.channel, l.channel) AS channel, coalesce(m.campaign_type, l.campaign_type) AS campaign_type, coalesce(m.campaign_id, l.campaign_id) AS campaign_id, coalesce(method, 'empirical') AS method, CAST(coalesce(slope, 0) AS DOUBLE) AS slope,
 round(CAST(CASE WHEN method = 'holt_winters' OR l.channel IS NULL THEN level ELSE l.revenue END AS DOUBLE) + 1e-7, 4) AS level FROM models m FULL JOIN lev l ON m.channel = l.channel AND m.campaign_type = l.campaign_type AND m.campaign_id = l.campaign_id""")
def runrate_upsert(spark, sf_dir):
    rows = features(spark, sf_dir)
    known = coldstart.levels(rows).where("campaign_id = ''").select(*SEG, "campaign_id", F.when(F.col("campaign_type") < "M", "holt_winters").otherwise("empirical").alias("method"), F.lit(2.0).alias("slope"), F.lit(7.0).alias("level"))
    gone = spark.sql("SELECT 'other' AS channel, 'gone' AS campaign_type, '' AS campaign_id, 'empirical' AS method, 1.0D AS slope, 5.0D AS level")
    return coldstart.upsert(known.unionByName(gone), rows).withColumn("level", F.round(F.col("level") + coldstart.TIE, 4))


@query(S.with_(S.DAILY, S.WINDOW, S.TREND) + "SELECT channel, campaign_type, round(slope, 6) AS slope, round(start + slope * (n - 1), 4) AS level_at_end, n, last_train_date FROM trend")
def trend_fit(spark, sf_dir):
    return fit.trend(_segments(spark, sf_dir)).select(*SEG, F.round("slope", 6).alias("slope"), F.round("level_at_end", 4).alias("level_at_end"), "n", "last_train_date")


@query(S.with_(S.DAILY, S.WINDOW) + "SELECT channel, campaign_type, round(max(top), 4) AS top, count(*) FILTER (y < revenue) AS n_clipped FROM win JOIN clip USING (channel, campaign_type) GROUP BY ALL")
def clip_percentile(spark, sf_dir):
    return fit.window_of(_segments(spark, sf_dir), SEG).groupBy(*SEG).agg(F.round(F.max("top"), 4).alias("top"), F.count_if(F.col("y") < F.col("revenue")).alias("n_clipped"))


@query(S.with_(S.DAILY, S.DOW) + "SELECT channel, campaign_type, dow, round(factor, 6) AS factor FROM dows")
def dow_factors(spark, sf_dir):
    return fit.weekday_factors(_segments(spark, sf_dir)).withColumn("factor", F.round("factor", 6))


@query(S.with_(S.DAILY, S.HOLIDAY) + "SELECT channel, campaign_type, round(holiday_factor, 6) AS holiday_factor FROM holiday")
def holiday_factor(spark, sf_dir):
    return fit.holiday_factor(_segments(spark, sf_dir)).withColumn("holiday_factor", F.round("holiday_factor", 6))


@query(S.with_(S.DAILY, S.WINDOW, S.TREND, S.DOW, S.HOLIDAY, S.RESIDUAL) + "SELECT channel, campaign_type, date, round(residual, 4) AS residual FROM resid")
def residual_pool(spark, sf_dir):
    return fit.residuals(_segments(spark, sf_dir)).select(*SEG, "date", F.round("residual", 4).alias("residual"))


@query(S.with_(S.DAILY, S.ELASTIC) + "SELECT channel, campaign_type, n_obs, round(beta, 6) AS beta, round(alpha, 6) AS alpha FROM elastic")
def elasticity_point(spark, sf_dir):
    return fit.elasticity(_segments(spark, sf_dir)).select(*SEG, "n_obs", F.round("beta", 6).alias("beta"), F.round("alpha", 6).alias("alpha"))


@query("""SELECT l_quantity / 10 AS multiple, l_discount * 10 AS beta, round(CASE WHEN m <= 0 THEN 0 WHEN m = 1 THEN 1 WHEN m < 1 THEN pow(m, b) ELSE 1 + (pow(m, b) - 1) / (1 + 0.5 * (pow(m, b) - 1)) END, 6) AS scale
FROM (SELECT DISTINCT l_quantity, l_discount, CAST(l_quantity AS DOUBLE) / 10 AS m, CAST(l_discount AS DOUBLE) * 10 AS b FROM lineitem)""")
def elasticity_scale(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") / 10).alias("multiple"), (F.col("l_discount") * 10).alias("beta")).distinct()
    return rows.withColumn("scale", F.round(X.response(F.col("multiple"), F.col("beta")), 6))


BOOT = S.with_(S.DAILY, S.ELASTIC) + ", " + S.boot(RESAMPLES)


@query(BOOT + "\nSELECT channel, campaign_type, n_obs, round(beta, 6) AS beta, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, low_confidence FROM boot")
def elasticity_bootstrap_ci(spark, sf_dir):
    found = fit.elasticity(_segments(spark, sf_dir), resamples=RESAMPLES)
    return found.select(*SEG, "n_obs", *[F.round(c, 6).alias(c) for c in ("beta", "ci_low", "ci_high")], "low_confidence")


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.models(_segments(spark, sf_dir))


def _forecast(spark: SparkSession, sf_dir: str, **multiples) -> DataFrame:
    models = _confident(spark, sf_dir)
    return simulate.forecast(models, simulate.simulate(models, SEG, n_sims=SIMS), simulate.multiples(models, **multiples))


@query(S.with_(S.DAILY, S.WINDOW, S.TREND, S.DOW, S.HOLIDAY, S.RESIDUAL, S.paths(20)) + "SELECT channel, campaign_type, CAST(sim AS INTEGER) AS sim, CAST(k AS INTEGER) AS k, round(residual, 4) AS residual FROM drawn")
def block_bootstrap_draws(spark, sf_dir):
    return simulate.draws(_models(spark, sf_dir), SEG, 90, 20).withColumn("residual", F.round("residual", 4))


@query(S.forecast(SIMS, RESAMPLES, where="campaign_type <> ''"))
def forecast_segment(spark, sf_dir):
    return _forecast(spark, sf_dir).where("campaign_type <> ''")


@query(S.forecast(SIMS, RESAMPLES, where="campaign_type = ''"))
def forecast_rollup(spark, sf_dir):
    return _forecast(spark, sf_dir).where("campaign_type = ''")


@query(S.forecast(SIMS, RESAMPLES, "CASE r.channel WHEN 'meta' THEN 2.0 WHEN 'google' THEN 1.2 ELSE 1 END"))
def forecast_scenario_channel(spark, sf_dir):
    return _forecast(spark, sf_dir, channel={"meta": 2.0, "google": 1.2})


@query(S.forecast(SIMS, RESAMPLES, "CASE WHEN r.channel = 'meta' AND r.campaign_type = 'ECONOMY' THEN 0.5 WHEN r.channel = 'meta' THEN 1.5 ELSE 1 END"))
def forecast_scenario_segment(spark, sf_dir):
    return _forecast(spark, sf_dir, channel={"meta": 1.5}, segment={("meta", "ECONOMY"): 0.5})


@query(S.with_() + """SELECT o.channel, o.campaign_type, o.campaign_id, CAST(n_days AS INTEGER) AS n_days, CASE WHEN n_days < 3 THEN 'skip' WHEN n_days < 30 THEN 'shrinkage' ELSE 'own' END AS tier
FROM (SELECT DISTINCT channel, campaign_type, campaign_id FROM features) o JOIN (SELECT channel, campaign_id, max(date) - min(date) + 1 AS n_days FROM features GROUP BY ALL) s ON s.channel = o.channel AND s.campaign_id = o.campaign_id""")
def campaign_tiers(spark, sf_dir):
    return fit.campaign_tiers(features(spark, sf_dir))


def _issue(name: str, check: Callable[[DataFrame], DataFrame], where: str, faults: bool = True) -> None:
    """faults: over rows with faults, which the plain ones don't have."""

    def run(spark, sf_dir):
        rows = faulty_features(spark, sf_dir) if faults else features(spark, sf_dir, extra=True)
        return check(rows).select("channel", "campaign_id", "issue", "amount")

    run.__name__ = name
    start = f"WITH {FAULTY_SQL},\n{S.ISSUES}\n" if faults else S.with_(S.ISSUES)
    query(start + f"SELECT channel, campaign_id, issue, amount FROM iss WHERE {where}")(run)


_issue("val_date_gaps", validate.date_gaps, "issue = 'date_coverage_gap'", faults=False)
_issue("val_budget_exceeded", validate.over_budget, "issue = 'spend_exceeds_daily_budget'", faults=False)
_issue("val_conv_gt_clicks", validate.conversions_over_clicks, "issue = 'conversions_exceed_clicks'")
_issue("val_negative", validate.negative, "issue LIKE 'negative%'")
_issue("val_zero_revenue", validate.zero_revenue, "issue = 'zero_revenue_with_spend'")


@query(S.with_() + """, s AS (SELECT channel, campaign_id, campaign_name, min(date) AS first FROM features GROUP BY ALL)
SELECT channel, campaign_id, 'unstable_campaign_name' AS issue, CAST(count(*) AS DOUBLE) AS amount, string_agg(campaign_name, ' | ' ORDER BY first, campaign_name) AS names FROM s GROUP BY channel, campaign_id HAVING count(*) > 1""")
def val_name_stability(spark, sf_dir):
    """Campaigns of several names, with these, in the order of their first day."""
    found = validate.unstable_values(features(spark, sf_dir, extra=True), "campaign_name")
    return found.select("channel", "campaign_id", "issue", "amount", F.array_join("values", " | ").alias("names"))


@query(f"""WITH {FAULTY_SQL.replace("features AS (SELECT * REPLACE", "lines AS (SELECT * REPLACE", 1)}, told AS (SELECT *, line = 4 AND clicks % 30 = 0 AS reject FROM lines),
features AS (SELECT * FROM told WHERE NOT reject), {S.ISSUES},
r AS (SELECT channel, count(DISTINCT campaign_id) FILTER (NOT reject) AS n_campaigns, count(*) FILTER (NOT reject) AS n_rows, count(*) FILTER (reject) AS n_rejects FROM told GROUP BY channel)
SELECT r.channel, n_campaigns, n_rows, n_rejects, issue, count(*) AS n_issues FROM r JOIN iss ON iss.channel = r.channel WHERE r.channel <> 'meta' OR issue <> 'unstable_campaign_type' GROUP BY ALL""")
def val_raw_report(spark, sf_dir):
    """Text lines as platforms export them, some of them broken, to the report of each channel."""
    lines = {c: platform_lines(spark, sf_dir, c) for c in RAW}
    rows = channels.together([channels.parsed(rows, c, header) for c, (header, rows) in lines.items()])
    return validate.report(Stages(spark).keep("raw", rows))


@query(S.with_(S.ISSUES) + f"SELECT k.issue, count(iss.issue) AS n_issues FROM (SELECT unnest({list(validate.CHECKS)}) AS issue) k LEFT JOIN iss ON iss.issue = k.issue GROUP BY ALL")
def val_summary(spark, sf_dir):
    return validate.summary(_facts(spark, sf_dir))


@query(S.with_(S.ISSUES) + "SELECT channel, campaign_id, issue, amount, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY channel, issue ORDER BY campaign_id, amount) AS place FROM iss) WHERE place <= 5")
def issue_examples(spark, sf_dir):
    return validate.examples(_facts(spark, sf_dir))


@query(S.with_() + """, o AS (SELECT max(date) AS origin FROM features),
s AS (SELECT channel, coalesce(sum(revenue) FILTER (date > origin - 30), 0) AS a, coalesce(sum(revenue) FILTER (date > origin - 60 AND date <= origin - 30), 0) AS b, coalesce(sum(spend) FILTER (date > origin - 30), 0) AS c, coalesce(sum(spend) FILTER (date > origin - 60 AND date <= origin - 30), 0) AS d FROM features, o GROUP BY channel)
SELECT channel, round(a, 4) AS now_revenue, round(b, 4) AS then_revenue, round(c, 4) AS now_spend, round(d, 4) AS then_spend, round(CASE WHEN b > 0 THEN (a - b) / b * 100 END, 4) AS revenue_change_pct, round(CASE WHEN d > 0 THEN (c - d) / d * 100 END, 4) AS spend_change_pct FROM s""")
def period_deltas(spark, sf_dir):
    return stats.period_deltas(features(spark, sf_dir))


RISK = S.with_() + """, s AS (SELECT channel, campaign_id, campaign_name, sum(spend) AS spend, coalesce(sum(revenue), 0) AS revenue FROM features GROUP BY ALL HAVING sum(spend) > 0),
t AS (SELECT channel, count(*) AS n, count(*) FILTER (revenue = 0) AS z, coalesce(sum(spend) FILTER (revenue = 0), 0) AS w FROM s GROUP BY ALL)
SELECT channel, n AS n_campaigns, z AS n_zero, round(w, 4) AS wasted_spend, round(z / n, 6) AS zero_share FROM t WHERE z / n >= {}"""


@query(RISK.format(0.0))
def zero_revenue_shares(spark, sf_dir):
    """Every channel's share."""
    return stats.structural_risk(features(spark, sf_dir), least=0.0)


@query(RISK.format(stats.ZERO_SHARE).replace(S.with_().rstrip(), "WITH " + FAULTY_SQL, 1))
def structural_risk(spark, sf_dir):
    return stats.structural_risk(faulty_features(spark, sf_dir))


@query(S.with_() + """, o AS (SELECT max(date) AS origin FROM features), s AS (SELECT channel, campaign_id, campaign_name, sum(revenue) / sum(spend) AS roas FROM features, o WHERE date > origin - 60 GROUP BY ALL HAVING sum(spend) > 0),
z AS (SELECT *, (roas - avg(roas) OVER w) / nullif(stddev_samp(roas) OVER w, 0) AS z, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY channel))
SELECT channel, campaign_id, campaign_name, round(roas, 4) AS roas, round(z, 4) AS z_score FROM z WHERE n >= 3 AND abs(z) > 2 ORDER BY abs(z) DESC, campaign_id, campaign_name LIMIT 10""")
def roas_anomalies(spark, sf_dir):
    return stats.roas_anomalies(features(spark, sf_dir))


@query(S.with_(S.DAILY) + """SELECT channel, campaign_type, CAST(b - CAST(i * 30 AS INTEGER) AS DATE) AS cutoff FROM (SELECT channel, campaign_type, min(date) AS a, max(date) AS b FROM seg GROUP BY ALL), (SELECT unnest(range(1, 4)) AS i)
WHERE (b - CAST(i * 30 AS INTEGER)) - a + 1 >= 45""")
def cutoffs_valid(spark, sf_dir):
    return backtest.cutoffs(_segments(spark, sf_dir))


@query("SELECT l_quantity, l_tax, round(greatest(0.1 * (l_quantity - l_tax * 500), (0.1 - 1) * (l_quantity - l_tax * 500)), 4) AS p10, round(greatest(0.9 * (l_quantity - l_tax * 500), (0.9 - 1) * (l_quantity - l_tax * 500)), 4) AS p90 FROM (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem)")
def pinball(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").cast("double"), F.col("l_tax").cast("double")).distinct()
    return rows.withColumns({n: F.round(X.pinball(F.col("l_quantity"), F.col("l_tax") * 500, t), 4) for n, t in (("p10", 0.1), ("p90", 0.9))})


SCORED = "n_folds, round(ape, 4) AS ape, round(pinball, 4) AS pinball, round(coverage, 4) AS coverage"


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("p10", "p50", "p90", "actual", "ape", "pinball", "coverage") if c in df.columns})


def _backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    return backtest.fold_scores(rows, backtest.cutoffs(rows).withColumn("method", F.lit(methods.DEFAULT)), SIMS)


@query(S.scores(SIMS) + "\nSELECT channel, campaign_type, cutoff, method, scale, round(actual, 4) AS actual, round(p10, 4) AS p10, round(p50, 4) AS p50, round(p90, 4) AS p90, round(ape, 4) AS ape, round(pinball, 4) AS pinball, covered FROM score")
def backtest_empirical(spark, sf_dir):
    return _scored(_backtest(spark, sf_dir))


@query(S.scores(SIMS) + "\nSELECT count(*) AS n_segments, round(avg(ape), 4) AS mean_ape, round(quantile_cont(ape, 0.5), 4) AS median_ape, round(avg(pinball), 4) AS pinball, round(avg(coverage), 4) AS coverage FROM bysum")
def backtest_summary(spark, sf_dir):
    return _scored(backtest.portfolio(_backtest(spark, sf_dir))).withColumns({c: F.round(c, 4) for c in ("mean_ape", "median_ape")})


@query()
def method_selection(spark, sf_dir):
    return _scored(backtest.select_method(_segments(spark, sf_dir), SIMS))


@query()
def method_comparison(spark, sf_dir):
    return _scored(backtest.compare(_segments(spark, sf_dir), SIMS))


@query(S.contest(SIMS, holt_winters.FIXED) + """
SELECT channel, campaign_type, method, coalesce(n_folds, 0) AS n_folds, round(ape, 4) AS ape, round(pinball, 4) AS pinball, round(coverage, 4) AS coverage, winner FROM ranked""")
def contest_fixed(spark, sf_dir):
    """The empirical method against Holt-Winters of fixed weights, on the same folds."""
    return _scored(backtest.compare(_segments(spark, sf_dir), SIMS, methods.FIXED_METHODS))


CALIBRATED = "\nSELECT channel, campaign_type, method, scale, tuned, n_folds, ape, pinball, coverage FROM calibration"
TUNING = (X.MIN_SPLIT_CUTOFFS, X.SCALE_COVERAGE)
WINNERS = S.calibrated_winners(SIMS, holt_winters.FIXED, X.MORE_CUTOFFS, list(X.SCALES), *TUNING)


@query(S.scores(SIMS, X.MORE_CUTOFFS, list(X.SCALES)) + ",\n" + S.calibrated("score", *TUNING) + CALIBRATED)
def calibration_scale(spark, sf_dir):
    return _scored(backtest.calibrate(_segments(spark, sf_dir), SIMS))


@query(WINNERS + CALIBRATED)
def calibration_chosen(spark, sf_dir):
    """Each segment is calibrated by the method that won its contest."""
    rows, run = _segments(spark, sf_dir), Stages(spark)
    won = run.keep("contest", backtest.select_method(rows, SIMS, methods.FIXED_METHODS))
    return _scored(backtest.calibrate(rows, SIMS, won, methods.FIXED_METHODS))


def _trained_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments trained by contest and calibration, of the two methods that SQL can say."""
    rows, run = _segments(spark, sf_dir), Stages(spark)
    won = run.keep("contest", backtest.select_method(rows, SIMS, methods.FIXED_METHODS))
    return run.keep("segments", train.segments(rows, won, run, SIMS, RESAMPLES, methods.FIXED_METHODS))


TRAINED = S.trained(WINNERS, holt_winters.FIXED, RESAMPLES)
TRAINED_ROUNDED = ("slope", "level_at_end", "holiday_factor", "avg_spend", "avg_revenue", "beta")
TRAINED_PLAIN = ("method", "low_confidence", "calibration_scale", "tuned", "held_out_coverage", "spread")


@query(TRAINED + "\nSELECT channel, campaign_type, " + ", ".join((*TRAINED_PLAIN[:4], "round(held_out_coverage, 4) AS held_out_coverage", "round(spread, 4) AS spread", *(f"round({c}, 4) AS {c}" for c in TRAINED_ROUNDED))) + " FROM model")
def trained_segments(spark, sf_dir):
    rounded = {c: F.round(c, 4) for c in ("held_out_coverage", "spread", *TRAINED_ROUNDED)}
    return _trained_segments(spark, sf_dir).withColumns(rounded).select(*SEG, *TRAINED_PLAIN, *TRAINED_ROUNDED)


@query(S.trained_rollup(TRAINED, SIMS))
def trained_rollup(spark, sf_dir):
    """Trained segments, channels and all: the winning method's path, the calibrated spread."""
    models = _trained_segments(spark, sf_dir)
    sims = simulate.simulate(models, SEG, X.HORIZONS, SIMS, F.col("spread"))
    return simulate.forecast(models, sims, simulate.multiples(models))


@query(S.holt_winters(holt_winters.FIXED))
def holt_winters_fixed(spark, sf_dir):
    found = holt_winters.fit(_segments(spark, sf_dir), optimise=False)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 2)
    return found.select(*SEG, "alpha", "beta", "gamma", *[F.round(F.get("path", F.lit(k - 1)), 2).alias(f"day_{k}") for k in (1, 30, 120)], total("path").alias("path_sum"), total("pool").alias("pool_sum"))


@query()
def holt_winters_optimised(spark, sf_dir):
    return holt_winters.fit(_segments(spark, sf_dir))


def _tiers_sql(source: str) -> str:
    return f"""WITH {source} SELECT o.channel, o.campaign_type, o.campaign_id, CAST(n_days AS INTEGER) AS n_days, CASE WHEN n_days < 3 THEN 'skip' WHEN n_days < 30 THEN 'shrinkage' ELSE 'own' END AS tier
FROM (SELECT DISTINCT channel, campaign_type, campaign_id FROM features) o JOIN (SELECT channel, campaign_id, max(date) - min(date) + 1 AS n_days FROM features GROUP BY ALL) s ON s.channel = o.channel AND s.campaign_id = o.campaign_id"""


@query(_tiers_sql(SHORT_SQL))
def campaign_tiers_short(spark, sf_dir):
    return fit.campaign_tiers(short_features(spark, sf_dir))


MODEL = "round(slope{0}, 6) AS slope, round((start + slope * (n - 1)){0}, 4) AS level_at_end, round(holiday_factor, 6) AS holiday_factor, len(pool) AS pool_size, round(list_sum(pool){0}, 2) AS pool_sum"


def _model_columns(df: DataFrame, *more) -> DataFrame:
    total = F.aggregate("pool", F.lit(0.0), lambda s, v: s + v)
    return df.select(*more, F.round("slope", 6).alias("slope"), F.round("level_at_end", 4).alias("level_at_end"), F.round("holiday_factor", 6).alias("holiday_factor"), F.size("pool").cast("long").alias("pool_size"), F.round(total, 2).alias("pool_sum"))


@query(f"""WITH {SHORT_SQL},
{S.DAILY}, {S.daily("camp", "channel, campaign_id")}, {S.fitted("s", "channel, campaign_type", "seg")},
tiers AS ({_tiers_sql(SHORT_SQL).split(SHORT_SQL)[1]}),
recent AS (SELECT channel, campaign_type, avg(revenue) AS parent_level FROM s_last WHERE newest <= 28 GROUP BY ALL),
own AS (SELECT channel, campaign_id, avg(revenue) AS level, avg(spend) AS own_spend FROM camp GROUP BY ALL),
short AS (SELECT *, CASE WHEN parent_level > 0 THEN level / parent_level ELSE 0 END AS scale FROM (SELECT * FROM tiers WHERE tier = 'shrinkage') t JOIN own USING (channel, campaign_id) JOIN recent USING (channel, campaign_type) JOIN s_trend USING (channel, campaign_type) JOIN s_holiday USING (channel, campaign_type) JOIN s_pools USING (channel, campaign_type))
SELECT channel, campaign_type, campaign_id, n_days, round(level + 1e-7, 4) AS level, round(own_spend + 1e-7, 4) AS avg_spend, round(scale, 6) AS scale, {MODEL.format(" * scale")} FROM short""")
def shrinkage_models(spark, sf_dir):
    rows, stages = short_features(spark, sf_dir), Stages(spark)
    parents = stages.keep("models", fit.models(stages.keep("series", series.daily(rows))))
    found = fit.shrinkage(rows, parents)
    return _model_columns(found, *SEG, "campaign_id", "n_days", *[F.round(F.col(c) + coldstart.TIE, 4).alias(c) for c in ("level", "avg_spend")], F.round("scale", 6).alias("scale"))


CAMPAIGNS = f"""{S.daily("camp", "channel, campaign_id")},
owned AS (SELECT DISTINCT channel, campaign_type, campaign_id FROM features),
long AS (SELECT channel, campaign_type, campaign_id, date, revenue, spend FROM camp JOIN owned USING (channel, campaign_id) JOIN (SELECT channel, campaign_id, count(*) AS n_days FROM camp GROUP BY ALL HAVING count(*) >= {X.MIN_CAMPAIGN_DAYS}) USING (channel, campaign_id)),
{S.fitted("c", "channel, campaign_type, campaign_id", "long")}"""


def _own_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    owners = fit.campaign_tiers(rows).where("tier = 'own'").select(*SEG, "campaign_id")
    return owners.join(fit.models(Stages(spark).keep("series", series.daily(rows, series.CAMPAIGN)), series.CAMPAIGN), list(series.CAMPAIGN))


@query(S.with_(CAMPAIGNS) + f"SELECT channel, campaign_type, campaign_id, {MODEL.format('')} FROM c_trend JOIN c_holiday USING (channel, campaign_type, campaign_id) JOIN c_pools USING (channel, campaign_type, campaign_id)")
def campaign_models(spark, sf_dir):
    return _model_columns(_own_campaigns(spark, sf_dir), *SEG, "campaign_id")


@query()
def forecast_campaign(spark, sf_dir):
    """Campaigns with an own fit, by the empirical method."""
    models = _own_campaigns(spark, sf_dir).withColumn("beta", F.lit(1.0))
    return simulate.forecast_campaigns(models, F.lit(1.0), n_sims=SIMS)


@query()
def trained_models(spark, sf_dir):
    """Segments and campaigns in one table, campaigns of short histories too."""
    return train.one_table(train.train(features(spark, sf_dir), Stages(spark), SIMS, RESAMPLES))


@query()
def trained_forecast(spark, sf_dir):
    """Trained models of segments and of campaigns, at all four grains."""
    return train.trained_forecast(train.train(features(spark, sf_dir), Stages(spark), SIMS, RESAMPLES), n_sims=SIMS)


def _confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of the segments, a row each: written, as forecasts read them several times."""
    rows = _segments(spark, sf_dir)
    return Stages(spark).keep("models", fit.models(rows).join(fit.elasticity(rows, resamples=RESAMPLES), list(SEG)))


ELIGIBLE = BOOT + ",\n" + S.RECENT + ",\nelig AS (SELECT b.channel, b.campaign_type, avg_spend, beta FROM boot b JOIN recent r ON r.channel = b.channel AND r.campaign_type = b.campaign_type WHERE NOT low_confidence AND avg_spend >= 5)"


@query(ELIGIBLE + "\nSELECT channel, campaign_type, round(avg_spend, 4) AS avg_spend, round(beta, 6) AS beta FROM elig")
def reco_eligible(spark, sf_dir):
    return recommend.eligible(_confident(spark, sf_dir)).select(*SEG, F.round("avg_spend", 4).alias("avg_spend"), F.round("beta", 6).alias("beta"))


@query(ELIGIBLE + """, lo AS (SELECT * FROM elig ORDER BY beta, channel, campaign_type LIMIT 3), hi AS (SELECT * FROM elig ORDER BY beta DESC, channel, campaign_type LIMIT 3)
SELECT lo.channel AS donor_channel, lo.campaign_type AS donor_type, hi.channel AS receiver_channel, hi.campaign_type AS receiver_type, round(lo.avg_spend * 0.2, 4) AS shift,
 round(CASE WHEN hi.avg_spend > 0 THEN least((hi.avg_spend + lo.avg_spend * 0.2) / hi.avg_spend, 2.5) ELSE 1 END, 6) AS receiver_multiple FROM lo, hi WHERE lo.channel <> hi.channel OR lo.campaign_type <> hi.campaign_type""")
def reco_pairs(spark, sf_dir):
    found = recommend.pairs(_confident(spark, sf_dir))
    return found.select("donor_channel", "donor_type", "receiver_channel", "receiver_type", F.round("shift", 4).alias("shift"), F.round("receiver_multiple", 6).alias("receiver_multiple"))


PRICED = S.priced(SIMS, RESAMPLES)
PAIR_SQL = "donor_channel, donor_type, receiver_channel, receiver_type"


def _sims(models: DataFrame) -> DataFrame:
    return Stages(models.sparkSession).keep("simulations", simulate.simulate(models, SEG, n_sims=SIMS))


@query(PRICED + f"\nSELECT {PAIR_SQL}, round(base, 4) AS base, round(moved, 4) AS moved, round(moved - base, 4) AS revenue_delta, round(CASE WHEN base > 0 THEN (moved - base) / base * 100 END, 6) AS delta_pct, round(base / spend, 6) AS base_roas, round(moved / moved_spend, 6) AS moved_roas FROM search")
def reco_priced(spark, sf_dir):
    """All pairs, at the search's number of simulations."""
    models = _confident(spark, sf_dir)
    found = recommend.priced(models, recommend.pairs(models), _sims(models))
    return found.withColumns({c: F.round(c, 4) for c in ("base", "moved", "revenue_delta")} | {c: F.round(c, 6) for c in ("delta_pct", "base_roas", "moved_roas")})


@query(PRICED + f"""
SELECT CAST(place AS INTEGER) AS place, {PAIR_SQL}, round(shift, 2) AS shift_daily, round(d_beta, 2) AS donor_beta, round(d_lo, 2) AS donor_ci_low, round(d_hi, 2) AS donor_ci_high, round(r_beta, 2) AS receiver_beta, round(r_lo, 2) AS receiver_ci_low, round(r_hi, 2) AS receiver_ci_high, 90 AS horizon_days,
 round(f.base, 2) AS base, round(f.moved, 2) AS moved, round(f.moved - f.base, 2) AS revenue_delta, round(CASE WHEN f.base > 0 THEN (f.moved - f.base) / f.base * 100 END, 1) AS delta_pct, round(f.base / f.spend, 2) AS base_roas, round(f.moved / f.moved_spend, 2) AS moved_roas, 'high' AS confidence
FROM final f JOIN placed USING ({PAIR_SQL}) JOIN pairs USING ({PAIR_SQL}) WHERE place <= {X.TOP}""")
def reco_top(spark, sf_dir):
    """The best few of the search, priced again on all simulations."""
    models = _confident(spark, sf_dir)
    return recommend.finalists(models, recommend.pairs(models), _sims(models)).drop(*recommend.MULTIPLES)


RETRO = S.retro(list(X.RETRO_OFFSETS), X.RETRO_MIN_TRAIN, RESAMPLES)


@query(RETRO + "\nSELECT cutoff, donor_channel, donor_type, round(donor_roas, 4) AS donor_roas, CAST(donor_rank AS INTEGER) AS donor_rank, receiver_channel, receiver_type, round(receiver_roas, 4) AS receiver_roas, CAST(receiver_rank AS INTEGER) AS receiver_rank, confirmed FROM retro")
def retro_pairs(spark, sf_dir):
    found = recommend.retrospective(features(spark, sf_dir), X.RETRO_OFFSETS, X.RETRO_MIN_TRAIN, RESAMPLES)
    return found.withColumns({c: F.round(c, 4) for c in ("donor_roas", "receiver_roas")})


@query(RETRO + """, first AS (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY donor_rank, receiver_rank) AS place FROM retro)
SELECT 'grid' AS part, count(*) AS n, count(*) FILTER (confirmed) AS n_confirmed, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (confirmed) / count(*) * 100 END, 1) AS rate_pct FROM retro WHERE confirmed IS NOT NULL
UNION ALL SELECT 'top_pick', count(*), count(*) FILTER (confirmed), round(CASE WHEN count(*) > 0 THEN count(*) FILTER (confirmed) / count(*) * 100 END, 1) FROM first WHERE place = 1 AND confirmed IS NOT NULL""")
def retro_summary(spark, sf_dir):
    found = recommend.retrospective(features(spark, sf_dir), X.RETRO_OFFSETS, X.RETRO_MIN_TRAIN, RESAMPLES)
    return recommend.confirmed(Stages(spark).keep("pairs", found))


@query(S.with_(S.LEVELS) + ", t AS (SELECT channel, campaign_type, campaign_id, round(day * 90 + 1e-7, 4) AS p50 FROM lev WHERE campaign_id <> '') SELECT * FROM t ORDER BY p50 DESC, channel, campaign_type, campaign_id LIMIT 15")
def top_campaigns(spark, sf_dir):
    rows = coldstart.forecast(features(spark, sf_dir), rollup=False, horizons=(90,)).where("campaign_id <> '' and metric = 'revenue'")
    return rows.select(*SEG, "campaign_id", "p50").orderBy(F.desc("p50"), *SEG, "campaign_id").limit(15)


@query(S.with_(S.LEVELS) + "SELECT channel, campaign_type, round(day * 30 + 1e-7, 4) AS p50_30, round(day * 60 + 1e-7, 4) AS p50_60, round(day * 90 + 1e-7, 4) AS p50_90 FROM lev WHERE campaign_id = ''")
def segment_pivot(spark, sf_dir):
    rows = coldstart_segment(spark, sf_dir).where("metric = 'revenue'").groupBy(*SEG).pivot("horizon_days", [30, 60, 90]).agg(F.first("p50"))
    return rows.select(*SEG, *[F.col(str(h)).alias(f"p50_{h}") for h in (30, 60, 90)])


@query(BOOT + "\nSELECT channel, campaign_type, round(beta, 2) AS beta, round(ci_low, 2) AS ci_low, round(ci_high, 2) AS ci_high, n_obs, low_confidence FROM boot")
def elasticity_summary(spark, sf_dir):
    found = fit.elasticity(_segments(spark, sf_dir), resamples=RESAMPLES)
    return found.select(*SEG, *[F.round(c, 2).alias(c) for c in ("beta", "ci_low", "ci_high")], "n_obs", "low_confidence").orderBy("beta", *SEG)


MOVED = "CASE r.channel WHEN 'meta' THEN 2.0 WHEN 'google' THEN 1.2 ELSE 1 END"
def _moved(models: DataFrame, sims: DataFrame) -> DataFrame:
    """What the scenario of MOVED changes, both runs of the same simulations."""
    run = lambda **m: simulate.forecast(models, sims, simulate.multiples(models, **m))
    return simulate.moved(run(), run(channel={"meta": 2.0, "google": 1.2}))


BOTH = f"base_ AS ({S.forecast(SIMS, RESAMPLES)}), moved_ AS ({S.forecast(SIMS, RESAMPLES, MOVED)})"


@query(f"""WITH {BOTH} SELECT b.horizon_days, b.metric, b.p50 AS baseline, m.p50 AS scenario, round(CASE WHEN b.p50 > 0 THEN (m.p50 - b.p50) / b.p50 * 100 END, 2) AS change_pct
FROM base_ b JOIN moved_ m ON m.horizon_days = b.horizon_days AND m.metric = b.metric AND m.channel = 'blended' WHERE b.channel = 'blended'""")
def scenario_deltas(spark, sf_dir):
    models = _confident(spark, sf_dir)
    return _moved(models, _sims(models))


@query(f"WITH {BOTH} SELECT 'baseline' AS run, * FROM base_ WHERE campaign_type = '' UNION ALL SELECT 'scenario', * FROM moved_ WHERE campaign_type = ''")
def scenario_table(spark, sf_dir):
    """Baseline and scenario below each other, with a label."""
    models = _confident(spark, sf_dir)
    sims = _sims(models)
    run = lambda name, **m: simulate.forecast(models, sims, simulate.multiples(models, **m)).where("campaign_type = ''").select(F.lit(name).alias("run"), "*")
    return run("baseline").unionByName(run("scenario", channel={"meta": 2.0, "google": 1.2}))


@query(S.scores(SIMS) + "\nSELECT channel, campaign_type, method, round(ape, 1) AS ape, round(coverage, 1) AS coverage, coverage < 40 OR ape > 150 AS low_reliability FROM bysum")
def reliability(spark, sf_dir):
    return backtest.reliability(_backtest(spark, sf_dir))


@query(S.scores(SIMS) + "\nSELECT round(avg(round(coverage, 1)), 4) AS coverage FROM bysum")
def coverage_mean(spark, sf_dir):
    return reliability(spark, sf_dir).agg(F.round(F.avg("coverage"), 4).alias("coverage"))


@query(S.with_(S.ISSUES) + """, c AS (SELECT channel, count(DISTINCT campaign_id) AS n_campaigns, count(*) AS n_rows FROM features GROUP BY channel)
SELECT c.channel, n_campaigns, n_rows, count(iss.issue) AS n_issues FROM c LEFT JOIN iss ON iss.channel = c.channel GROUP BY ALL""")
def val_channels(spark, sf_dir):
    return validate.channels(_facts(spark, sf_dir))


@query(S.with_() + "SELECT channel, campaign_id, count(*) AS n_days_over, round(max((spend - daily_budget) / daily_budget * 100), 1) AS max_overspend_pct FROM features WHERE daily_budget > 0 AND spend > daily_budget * 1.05 GROUP BY ALL")
def val_overspend(spark, sf_dir):
    """How often and how far campaigns spend more than their daily budget."""
    found = validate.over_budget(features(spark, sf_dir, extra=True))
    return found.select("channel", "campaign_id", F.col("amount").cast("long").alias("n_days_over"), "max_overspend_pct")


@query("WITH " + RAW_SQL)
def platform_union(spark, sf_dir):
    """Rows as each platform exports them, in the columns of the fact table, with clicks and budgets."""
    more = ("clicks", "impressions", "daily_budget")
    frames = [normalised(platform_rows(spark, sf_dir, c), c, more) for c in RAW]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).withColumns({c: F.round(c, 6) for c in ("spend", "revenue")})


@query(f"WITH {BOTH} SELECT 'baseline' AS run, * FROM base_ WHERE channel = 'google' AND horizon_days <= 60 UNION ALL SELECT 'scenario', * FROM moved_ WHERE channel = 'google' AND horizon_days <= 60")
def request_forecast(spark, sf_dir):
    """A request for one channel and two horizons, with budgets moved."""
    models = _confident(spark, sf_dir)
    return requests.forecast(models, _sims(models), channel="google", horizons=(30, 60), budgets={"meta": 2.0, "google": 1.2})


SIDE = "r.channel = (SELECT {0}_channel FROM pick) AND r.campaign_type = (SELECT {0}_type FROM pick)"
ADVISED = f"CASE WHEN {SIDE.format('donor')} THEN 0.8 WHEN {SIDE.format('receiver')} THEN (SELECT receiver_multiple FROM pick) ELSE 1 END"


@query(f"""WITH pick AS ({PRICED} SELECT {PAIR_SQL}, receiver_multiple FROM placed JOIN pairs USING ({PAIR_SQL}) WHERE place = 1),
base_ AS ({S.forecast(SIMS, RESAMPLES)}), moved_ AS ({S.forecast(SIMS, RESAMPLES, ADVISED)})
SELECT 'baseline' AS run, * FROM base_ WHERE channel = 'blended' AND EXISTS (FROM pick) UNION ALL SELECT 'scenario', * FROM moved_ WHERE channel = 'blended' AND EXISTS (FROM pick)""")
def top_recommendation_forecast(spark, sf_dir):
    """Blended forecasts before and after the best recommendation."""
    models = _confident(spark, sf_dir)
    sims = _sims(models)
    return requests.top_recommendation(models, sims, recommend.finalists(models, recommend.pairs(models), sims))


MONEY = "'$' || format('{{:,}}', CAST(round_even({}, 0) AS BIGINT))"
NARRATIVE = S.with_(S.ISSUES) + f""", o AS (SELECT max(date) AS origin FROM features),
d AS (SELECT channel, coalesce(sum(revenue) FILTER (date > origin - 30), 0) AS a, coalesce(sum(revenue) FILTER (date > origin - 60 AND date <= origin - 30), 0) AS b FROM features, o GROUP BY channel),
e AS (SELECT channel, round(a, 4) AS a, round(b, 4) AS b, round((a - b) / b * 100, 4) AS pct FROM d WHERE b > 0),
r AS (SELECT channel, campaign_id, campaign_name, sum(revenue) / sum(spend) AS roas FROM features, o WHERE date > origin - 60 GROUP BY ALL HAVING sum(spend) > 0),
q AS (SELECT *, (roas - avg(roas) OVER w) / nullif(stddev_samp(roas) OVER w, 0) AS z, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY channel)),
y AS (SELECT channel, campaign_id, campaign_name, round(roas, 4) AS roas, round(z, 4) AS z FROM q WHERE n >= 3 AND abs(z) > 2),
yy AS (SELECT *, row_number() OVER (ORDER BY abs(z) DESC, channel, campaign_id, campaign_name) AS place FROM y),
k AS (SELECT issue, count(*) AS n FROM iss GROUP BY issue),
kk AS (SELECT sum(n) AS n, string_agg(issue || ' ' || n, ', ' ORDER BY n DESC, issue || ' ' || n) AS names FROM k),
told AS (SELECT 1 AS part, row_number() OVER (ORDER BY pct DESC, channel) AS place, channel || ': revenue ' || CASE WHEN pct >= 0 THEN 'rose' ELSE 'fell' END || ' ' || printf('%.1f', abs(pct)) || ' % in the last 30 days, to ' || {MONEY.format("a")} || ' from ' || {MONEY.format("b")} || '.' AS statement,
 CASE WHEN pct < -15 THEN 'Revenue of ' || channel || ' fell by more than 15 % against the period before.' END AS risk FROM e
UNION ALL SELECT 4, place, 'Campaign ' || campaign_name || ' returns ' || printf('%.2f', roas) || ', far ' || CASE WHEN z > 0 THEN 'above' ELSE 'below' END || ' the others of ' || channel || ' (z ' || printf('%.2f', z) || ').', CASE WHEN z < -2 THEN 'Campaign ' || campaign_name || ' returns far too little.' END FROM yy WHERE place <= 5
UNION ALL SELECT 7, 1, 'Checks of ' || (SELECT count(*) FROM (SELECT DISTINCT channel, campaign_id FROM features)) || ' campaigns found ' || n || ' issues: ' || names || '. A daily budget is an average, so that single days may pass it.', NULL FROM kk WHERE n > 0)"""
TOLD = "\nSELECT part, CAST(place AS INTEGER) AS place, statement, risk FROM told"


@query(NARRATIVE + TOLD)
def narrative_statements(spark, sf_dir):
    """What can be said of the facts alone; forecasts add their own statements."""
    facts = _facts(spark, sf_dir)
    return narrative.tell(spark, narrative.gather(facts))


MOVE = "donor_channel || '/' || donor_type || ' to ' || receiver_channel || '/' || receiver_type"
CHANGE = "printf('%+.1f', round({}, 1)) || ' %'"
REPORT = NARRATIVE + f""",
el AS ({BOOT} SELECT channel || '/' || campaign_type AS name, channel, campaign_type, round(beta, 2) AS shown, beta, low_confidence FROM boot),
up AS (SELECT * FROM el WHERE NOT low_confidence AND beta >= 0.8 ORDER BY beta DESC, channel, campaign_type LIMIT 1),
down AS (SELECT * FROM el WHERE NOT low_confidence AND beta < 0.5 ORDER BY beta, channel, campaign_type LIMIT 1),
unsure AS (SELECT count(*) AS n FROM el WHERE low_confidence),
low AS ({S.scores(SIMS)} SELECT channel || '/' || campaign_type AS name, coalesce(round(coverage, 1), 999) AS c FROM bysum WHERE coverage < 40 OR ape > 150),
lows AS (SELECT count(*) AS n, array_to_string(list_slice(list(name ORDER BY c, name), 1, 5), ', ') AS names FROM low),
idle AS (SELECT *, row_number() OVER (ORDER BY zero_share DESC, channel) AS place FROM ({RISK.format(stats.ZERO_SHARE)})),
rec AS ({SQL["reco_top"]}),
recs AS (SELECT * REPLACE (row_number() OVER (ORDER BY revenue_delta DESC NULLS LAST, place) AS place) FROM rec),
moves AS ({SQL["scenario_deltas"]}),
more AS (SELECT 2 AS part, 1 AS place, 'More money goes furthest in ' || name || ' (slope ' || printf('%.2f', shown) || ').' AS statement, NULL AS risk FROM up
UNION ALL SELECT 2, 2, 'More money earns ever less in ' || name || ' (slope ' || printf('%.2f', shown) || ').', NULL FROM down
UNION ALL SELECT 3, 1, NULL, n || ' segments have no sure slope; how they respond to a budget is a guess.' FROM unsure WHERE n > 0
UNION ALL SELECT 5, 1, 'Past forecasts missed in ' || n || ' segments, so their ranges are rough: ' || names || '.', n || ' segments failed their backtest: ' || names || '.' FROM lows WHERE n > 0
UNION ALL SELECT 6, place, channel || ': ' || n_zero || ' of ' || n_campaigns || ' campaigns with spend (' || printf('%.1f', zero_share * 100) || ' %) never earned, for ' || {MONEY.format("wasted_spend")} || '.',
 'Trust forecasts of ' || channel || ' only once its campaigns without revenue are explained.' FROM idle
UNION ALL SELECT 8, place, CASE WHEN place > 1 THEN 'Or from ' || {MOVE} || ' (' || {CHANGE.format("delta_pct")} || ').' ELSE 'Move ' || {MONEY.format("shift_daily")} || ' a day from ' || {MOVE} || ': revenue of ' || horizon_days || ' days ' || {CHANGE.format("delta_pct")}
 || ' (' || {MONEY.format("base")} || ' to ' || {MONEY.format("moved")} || '), return ' || printf('%.2f', base_roas) || ' to ' || printf('%.2f', moved_roas) || ', confidence ' || confidence || '.' END, NULL FROM recs WHERE place <= 4
UNION ALL SELECT 9, row_number() OVER (ORDER BY horizon_days), 'In the scenario, revenue of ' || horizon_days || ' days changes by ' || {CHANGE.format("change_pct")} || ' (' || {MONEY.format("baseline")} || ' to ' || {MONEY.format("scenario")} || ').', NULL
 FROM moves WHERE metric = 'revenue' AND change_pct IS NOT NULL)
SELECT part, CAST(place AS INTEGER) AS place, statement, risk FROM (FROM told UNION ALL FROM more)"""


def _report(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """Facts, series, models and simulations are written once, below all nine parts."""
    stages = Stages(spark)
    facts = stages.keep("facts", facts)
    rows = stages.keep("series", series.daily(facts))
    slopes = stages.keep("slopes", fit.elasticity(rows, resamples=RESAMPLES))
    models = stages.keep("models", fit.models(rows).join(slopes, list(SEG)))
    sims = stages.keep("simulations", simulate.simulate(models, SEG, n_sims=SIMS))
    scores = backtest.fold_scores(rows, backtest.cutoffs(rows).withColumn("method", F.lit(methods.DEFAULT)), SIMS)
    advised = recommend.finalists(models, recommend.pairs(models), sims)
    found = narrative.gather(facts, slopes=slopes, unreliable=stages.keep("reliability", backtest.reliability(scores)), advice=advised, scenarios=_moved(models, sims))
    return stages.keep("report", narrative.tell(spark, found))


@query(REPORT)
def narrative_report(spark, sf_dir):
    """The whole report."""
    return _report(spark, features(spark, sf_dir, extra=True))


@query(REPORT.replace(FEATURES_SQL, FAULTY_SQL))
def narrative_faulty(spark, sf_dir):
    """The whole report of facts with faults, of which more parts have something to tell."""
    return _report(spark, faulty_features(spark, sf_dir))


VALIDATION = S.with_(S.ISSUES) + """, c AS (SELECT channel, count(DISTINCT campaign_id) AS n_campaigns, count(*) AS n_rows FROM features GROUP BY channel),
cc AS (SELECT c.channel, n_campaigns, n_rows, count(iss.issue) AS n_issues FROM c LEFT JOIN iss ON iss.channel = c.channel GROUP BY ALL),
k AS (SELECT k.issue, count(iss.issue) AS n_issues FROM (SELECT unnest({checks}) AS issue) k LEFT JOIN iss ON iss.issue = k.issue GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY channel, issue ORDER BY campaign_id, amount) AS place FROM iss)
SELECT CAST((SELECT sum(n_campaigns) FROM cc) AS BIGINT) AS total_campaigns, CAST((SELECT sum(n_issues) FROM cc) AS BIGINT) AS total_issues,
 (SELECT CAST(to_json(list({{'channel': channel, 'n_campaigns': n_campaigns, 'n_rows': n_rows, 'n_issues': n_issues}} ORDER BY channel)) AS VARCHAR) FROM cc) AS channels,
 (SELECT CAST(to_json(list({{'issue': issue, 'n_issues': n_issues}} ORDER BY n_issues DESC, issue)) AS VARCHAR) FROM k) AS checks,
 (SELECT CAST(to_json(list({{'channel': channel, 'issue': issue, 'place': place, 'campaign_id': campaign_id}} ORDER BY channel, issue, place)) AS VARCHAR) FROM x WHERE place <= 5) AS examples"""


@query(VALIDATION.format(checks=list(validate.CHECKS)).replace(FEATURES_SQL, FAULTY_SQL))
def validation_report(spark, sf_dir):
    """The validation report of facts with faults as one object; its lists are JSON texts."""
    stages = Stages(spark)
    facts = stages.keep("facts", faulty_features(spark, sf_dir))
    found = reports.validation(facts, stages.keep("issues", validate.issues(facts)))
    lists = [F.to_json(c).alias(c) for c in ("channels", "checks")]
    shown = F.transform("examples", lambda x: F.struct(*[x[c].alias(c) for c in ("channel", "issue", "place", "campaign_id")]))
    return found.select("total_campaigns", "total_issues", *lists, F.to_json(shown).alias("examples"))


SLOPES = f"""WITH el AS ({BOOT} SELECT channel || '/' || campaign_type AS name, channel, campaign_type, beta, low_confidence FROM boot),
up AS (SELECT * FROM el WHERE NOT low_confidence AND beta >= 0.8 ORDER BY beta DESC, channel, campaign_type LIMIT 1),
down AS (SELECT * FROM el WHERE NOT low_confidence AND beta < 0.5 ORDER BY beta, channel, campaign_type LIMIT 1),
unsure AS (SELECT count(*) AS n FROM el WHERE low_confidence)
SELECT 2 AS part, 1 AS place, 'More money goes furthest in ' || name || ' (slope ' || printf('%.2f', round(beta, 2)) || ').' AS statement, CAST(NULL AS VARCHAR) AS risk FROM up
UNION ALL SELECT 2, 2, 'More money earns ever less in ' || name || ' (slope ' || printf('%.2f', round(beta, 2)) || ').', NULL FROM down
UNION ALL SELECT 3, 1, NULL, n || ' segments have no sure slope; how they respond to a budget is a guess.' FROM unsure WHERE n > 0"""


@query(SLOPES.replace(FEATURES_SQL, SHORT_SQL))
def narrative_slopes(spark, sf_dir):
    """What slopes tell where series are short, so that they differ and many are unsure."""
    rows = Stages(spark).keep("series", series.daily(short_features(spark, sf_dir)))
    return narrative.slopes(Stages(spark).keep("slopes", fit.elasticity(rows, resamples=RESAMPLES)))
