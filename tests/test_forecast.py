"""The forecast engine on small inputs whose results can be worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidecast.functions import expressions as X
from tidecast.operators import coldstart, fit, series, simulate, validate
from tidecast.plans import registry
from tidecast.sources import channels


def rows(spark, days, start, channel, campaign, name, kind, spend, revenue):
    first = dt.date.fromisoformat(start)
    data = [(first + dt.timedelta(i), channel, campaign, name, kind, float(spend), float(revenue), None, False, "prospecting") for i in range(days)]
    return spark.createDataFrame(data, channels.FEATURES)


def test_response_curve(spark):
    got = spark.range(1).select(*[X.response(F.lit(float(m)), F.lit(float(b))).alias(f"c{i}") for i, (m, b) in enumerate([(0, 1), (1, 0.8), (0.5, 0.8), (2, 1.5)])]).first()
    assert got[0] == 0 and got[1] == 1 and got[2] == pytest.approx(0.5**0.8)
    assert 1 < got[3] < 2**1.5


def test_funnel_stage(spark):
    names = ["Search_TM_Branded", "Remarketing_Retarget_Audience", "Prospecting_Generic_Keyword", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(X.funnel_stage(F.col("name"))).collect()] == ["high_intent", "high_intent", "prospecting", "prospecting"]


def test_cold_start_of_one_segment(spark):
    got = coldstart.forecast(rows(spark, 10, "2026-07-01", "google", "101", "Search_TM_101", "SEARCH", 10, 50), horizons=(30,)).collect()
    assert {r["channel"] for r in got} == {"google", "blended"} and len(got) == 8
    for r in got:
        assert r["p10"] == r["p50"] == r["p90"] == pytest.approx(1575.0 if r["metric"] == "revenue" else 5.25)


def test_empty_features_give_an_empty_forecast(spark):
    assert coldstart.forecast(spark.createDataFrame([], channels.FEATURES)).count() == 0


def test_forecast_rows_and_order_of_percentiles(spark):
    table = rows(spark, 200, "2025-06-01", "bing", "b1", "x", "Search", 20, 80).withColumn("revenue", F.col("revenue") + F.day("date"))
    daily = series.daily(table)
    models = fit.models(daily).join(fit.elasticity(daily), list(series.SEGMENT))
    sims = simulate.simulate(models, series.SEGMENT, n_sims=50)
    base = simulate.forecast(models, sims, simulate.multiples(models))
    assert base.columns == coldstart.FORECAST
    assert base.where("p10 > p50 or p50 > p90").count() == 0
    same = simulate.forecast(models, sims, simulate.multiples(models, channel={"bing": 1.0}))
    assert sorted(base.collect()) == sorted(same.collect())


def test_blocks_are_runs_of_the_pool(spark):
    models = spark.createDataFrame([("a", [float(i) for i in range(100)])], "channel string, pool array<double>")
    got = simulate.draws(models, ("channel",), 30, 10).orderBy("sim", "k").collect()
    assert len(got) == 300
    first = [r["residual"] for r in got if r["sim"] == 0][:7]
    assert [b - a for a, b in zip(first, first[1:])] == [1.0] * 6


def test_short_and_empty_pools(spark):
    models = spark.createDataFrame([("a", [5.0]), ("b", []), ("c", [1.0, 2.0])], "channel string, pool array<double>")
    got = simulate.draws(models, ("channel",), 9, 4).groupBy("channel").agg(F.min("residual"), F.max("residual"), F.count("*")).orderBy("channel").collect()
    assert [tuple(r) for r in got] == [("a", 5.0, 5.0, 36), ("b", 0.0, 0.0, 36), ("c", 1.0, 2.0, 36)]


def test_meta_value_is_revenue(spark):
    raw = spark.createDataFrame([("2026-01-01", "1", "Prospecting_Campaign_123", 5.0, 40.99)], "date_start string, campaign_id string, campaign_name string, spend double, conversion double")
    got = channels.normalised(raw, "meta").first()
    assert (got["revenue"], got["campaign_type"], got["conversions"]) == (40.99, "Prospecting", None)
    with pytest.raises(ValueError, match="campaign_id"):
        channels.normalised(raw.drop("campaign_id"), "meta")


def test_files_are_found_by_part_of_the_name(spark, tmp_path):
    (tmp_path / "Google_Ads_campaign_stats.csv").write_text("a\n1\n")
    assert channels.find_file(spark, str(tmp_path), "google_ads").endswith("Google_Ads_campaign_stats.csv")
    with pytest.raises(FileNotFoundError):
        channels.find_file(spark, str(tmp_path), "bing")


def test_elasticity_of_few_pairs(spark):
    table = rows(spark, 9, "2026-01-01", "bing", "1", "x", "S", 10, 50)
    got = fit.elasticity(series.daily(table), resamples=5).first()
    assert (got["beta"], got["ci_low"], got["ci_high"], got["low_confidence"]) == (1.0, 1.0, 1.0, True)


def test_gaps_and_budget(spark):
    table = rows(spark, 1, "2026-01-01", "bing", "1", "x", "S", 10.5, 0).unionByName(rows(spark, 1, "2026-01-16", "bing", "1", "y", "S", 21, 0)).withColumns({"clicks": F.lit(1), "daily_budget": F.lit(10.0)})
    found = {r["issue"]: r["n_issues"] for r in validate.summary(table).collect()}
    assert found["date_coverage_gap"] == 1 and found["spend_exceeds_daily_budget"] == 1 and found["unstable_campaign_name"] == 1 and found["zero_revenue_with_spend"] == 2
    assert math.isclose(validate.over_budget(table).first()["max_overspend_pct"], 110.0)


def test_queries_have_names_of_their_own():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_scenarios_do_not_use_slopes_of_low_confidence(spark):
    models = spark.sql("SELECT 'meta' AS channel, 'a' AS campaign_type, 10.0D AS avg_spend, 0.2D AS beta, 1.0D AS beta_for_scenario")
    sims = spark.sql("SELECT 'meta' AS channel, 'a' AS campaign_type, 0 AS sim, 30 AS horizon_days, 100.0D AS revenue")
    rows = simulate.forecast(models, sims, F.lit(0.5), rollup=False).where("metric = 'revenue'").collect()
    assert [r["p50"] for r in rows] == [50.0]
