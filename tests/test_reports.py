"""Statements, streams, sinks and requests on small inputs."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidecast.functions.expressions import rounded
from tidecast.operators import coldstart, narrative, reports, requests, simulate, validate
from tidecast.plans import registry
from tidecast.sources import adaptors, channels
from tidecast.sources.store import Snapshots
from tidecast.streaming import live


def facts(spark, first, days, revenue, kind="SEARCH", channel="google"):
    start = dt.date.fromisoformat(first)
    data = [(start + dt.timedelta(i), channel, "c1", "n", kind, 10.0, float(revenue), None, False, "prospecting") for i in range(days)]
    return spark.createDataFrame(data, channels.FEATURES)


def test_changes_are_told_from_the_largest_rise(spark):
    deltas = spark.sql("SELECT * FROM VALUES ('meta', 700.0D, 1000.0D, -30.0D), ('bing', 1500.0D, 1000.0D, 50.0D), ('google', 5.0D, 0.0D, NULL) AS t(channel, now_revenue, then_revenue, revenue_change_pct)")
    got = narrative.changes(deltas).orderBy("place").collect()
    assert [r["statement"] for r in got] == ["bing: revenue rose 50.0 % in the last 30 days, to $1,500 from $1,000.", "meta: revenue fell 30.0 % in the last 30 days, to $700 from $1,000."]
    assert [r["risk"] is None for r in got] == [True, False]


def test_slopes(spark):
    found = spark.sql("SELECT * FROM VALUES ('meta', 'a', 0.9D, false), ('meta', 'b', 1.1D, false), ('bing', 'c', 0.2D, false), ('bing', 'd', 3.0D, true), ('bing', 'e', 0.4D, false) AS t(channel, campaign_type, beta, low_confidence)")
    got = narrative.slopes(found).orderBy("part", "place").collect()
    assert [(r["part"], r["place"]) for r in got] == [(2, 1), (2, 2), (3, 1)]
    assert "meta/b" in got[0]["statement"] and "bing/c" in got[1]["statement"] and got[2]["risk"].startswith("1 segments")


def test_outliers_ties_and_nulls(spark):
    found = spark.sql("SELECT * FROM VALUES ('bing', '2', 'y', 1.0D, 2.5D), ('bing', '1', CAST(NULL AS STRING), 0.1D, -2.5D) AS t(channel, campaign_id, campaign_name, roas, z_score)")
    got = narrative.outliers(found).orderBy("place").collect()
    assert "Campaign ?" in got[0]["statement"] and got[0]["risk"] and not got[1]["risk"]


def test_other_parts(spark):
    low = spark.sql("SELECT * FROM VALUES ('a', 'x', 10.0D, true), ('a', 'y', 5.0D, true), ('b', 'z', 90.0D, false) AS t(channel, campaign_type, coverage, low_reliability)")
    assert narrative.unreliable(low).first()["statement"].endswith("a/y, a/x.")
    idle = spark.sql("SELECT 'bing' AS channel, 4 AS n_campaigns, 1 AS n_zero, 1234.0D AS wasted_spend, 0.25D AS zero_share")
    assert "1 of 4 campaigns with spend (25.0 %)" in narrative.idle_money(idle).first()["statement"]
    found = spark.sql("SELECT * FROM VALUES ('gap', 2L), ('zero', 5L), ('none', 0L) AS t(issue, n_issues)")
    assert "7 issues: zero 5, gap 2." in narrative.checks(found, spark.sql("SELECT 9L AS n_campaigns")).first()["statement"]
    moved = spark.sql("SELECT * FROM VALUES (30, 'revenue', 100.0D, 110.0D, 10.0D), (30, 'roas', 1.0D, 2.0D, 100.0D), (60, 'revenue', 0.0D, 1.0D, NULL) AS t(horizon_days, metric, baseline, scenario, change_pct)")
    assert [r["statement"] for r in narrative.scenarios(moved).collect()] == ["In the scenario, revenue of 30 days changes by +10.0 % ($100 to $110)."]
    one = "SELECT {} AS place, 'a' AS donor_channel, 'x' AS donor_type, 'b' AS receiver_channel, 'y' AS receiver_type, 12.4D AS shift_daily, 90 AS horizon_days, 100.0D AS base, 120.0D AS moved, {}D AS revenue_delta, 20.0D AS delta_pct, 1.0D AS base_roas, 1.2D AS moved_roas, 'high' AS confidence"
    recs = spark.sql(" UNION ALL ".join(one.format(i, 20.0 - i) for i in range(1, 6)))
    got = narrative.advice(recs).orderBy("place").collect()
    assert len(got) == 4 and got[0]["statement"].startswith("Move $12 a day from a/x to b/y: revenue of 90 days +20.0 %") and got[3]["statement"] == "Or from a/x to b/y (+20.0 %)."


def test_numbers_are_written_as_sql_writes_them(spark):
    """Halves of exact values go to even, and a small loss keeps its sign when it rounds to zero."""
    idle = spark.sql("SELECT 'bing' AS channel, 16 AS n_campaigns, 5 AS n_zero, 1234.0D AS wasted_spend, 0.3125D AS zero_share")
    assert "(31.2 %)" in narrative.idle_money(idle).first()["statement"]
    found = spark.sql("SELECT 'bing' AS channel, '2' AS campaign_id, 'y' AS campaign_name, 1234.125D AS roas, 2.5D AS z_score")
    assert "returns 1234.12," in narrative.outliers(found).first()["statement"]
    forecast = lambda p50: spark.sql(f"SELECT 'blended' AS channel, 30 AS horizon_days, 'revenue' AS metric, {p50}D AS p50")
    moved = simulate.moved(forecast(1000000.0), forecast(999990.0))
    assert str(moved.first()["change_pct"]) == "-0.0"
    assert "changes by -0.0 % (" in narrative.scenarios(moved).first()["statement"]
    told = spark.sql("SELECT -0.03D AS loss, 0.03D AS gain, -0.25D AS half").select(*[rounded(F.col(c), 1) for c in ("loss", "gain", "half")]).first()
    assert [str(v) for v in told] == ["-0.0", "0.0", "-0.3"]


def test_parts_are_not_broadcast(spark):
    """They grow with the tables, and all queries of facts join them; each check would hold them on the driver anew."""
    plan = adaptors.features(spark, "/root/testdata/sf0.001", extra=True)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
    plan = registry.val_channels(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan  # facts are joined once, not by each check


def test_report_and_its_writers(spark):
    empty = narrative.statements(spark)
    assert narrative.report(empty)["text"].startswith("There is too little history")
    told = spark.createDataFrame([(1, 1, "One.", None), (1, 2, "Two.", "Mind.")], narrative.STATEMENT)
    assert narrative.report(narrative.statements(spark, told)) == {"text": "One. Two.", "risk_flags": ["Mind."], "source": "template"}
    assert narrative.report(told, lambda rows: ("New.", []))["source"] == "llm"
    failed = narrative.report(told, lambda rows: 1 / 0)
    assert failed["source"] == "template_fallback" and failed["risk_flags"] == ["Mind."] and failed["text"].startswith("One. Two. [")


def test_gather_and_tell(spark):
    rows = facts(spark, "2026-01-01", 60, 50).withColumns({"clicks": F.lit(5), "impressions": F.lit(50), "daily_budget": F.lit(2.0)})
    slopes = spark.sql("SELECT 'google' AS channel, 'SEARCH' AS campaign_type, 0.9D AS beta, false AS low_confidence")
    found = narrative.gather(rows, slopes=slopes)
    told = narrative.tell(spark, found).orderBy("part", "place").collect()
    assert [r["part"] for r in told] == [1, 2, 7] and told[0]["statement"].startswith("google: revenue rose 0.0 %")
    assert told[2]["statement"].startswith("Checks of 1 campaigns found ")
    nothing = narrative.tell(spark, narrative.gather(rows.limit(0)))
    assert [r["part"] for r in nothing.collect()] == [10]
    with pytest.raises(ValueError, match="weather"):
        narrative.gather(rows, weather=slopes)


def object_of(rows, path):
    channels.write_json(rows, path)
    (only,) = [line for p in Path(path).glob("*.json") for line in p.read_text().splitlines()]
    return json.loads(only)


def test_the_five_reports(spark, tmp_path):
    at = iter(str(tmp_path / str(i)) for i in range(9))
    score = "SELECT * FROM VALUES ('bing', 'b', 'x', 3L, 9.0D, 2.0D, 80.0D, true), ('bing', 'b', 'y', 3L, 8.0D, 3.0D, 70.0D, false), ('bing', 'a', 'x', 0L, NULL, NULL, NULL, true), ('bing', 'a', 'y', 0L, NULL, NULL, NULL, false) AS t(channel, campaign_type, method, n_folds, ape, pinball, coverage, winner)"
    got = object_of(reports.backtested(spark.sql(score)), next(at))
    assert [(s["campaign_type"], s["winner"], len(s["methods"])) for s in got["segments"]] == [("a", "x", 2), ("b", "x", 2)]
    assert got["wins"] == [{"method": "x", "n_segments": 2}, {"method": "y", "n_segments": 0}]

    scaled = spark.sql("SELECT * FROM VALUES ('meta', 'b', 'x', 1.2D, true, 10.0D, 80.0D), ('bing', 'c', 'x', 1.0D, false, 20.0D, 90.0D) AS t(channel, campaign_type, method, scale, tuned, ape, coverage)")
    got = object_of(reports.trained(scaled), next(at))
    assert (got["n_segments"], got["n_tuned"], got["mean_ape"], got["mean_coverage"]) == (2, 1, 15.0, 85.0) and got["segments"][0]["channel"] == "bing"
    assert object_of(reports.trained(scaled.limit(0)), next(at))["segments"] == []

    rows = facts(spark, "2026-01-01", 60, 50).withColumns({"clicks": F.lit(5), "impressions": F.lit(50), "daily_budget": F.lit(2.0)})
    both = rows.unionByName(facts(spark, "2026-01-01", 3, -1, channel="bing").withColumns({"clicks": F.lit(5), "impressions": F.lit(50), "daily_budget": F.lit(99.0)}))
    got = object_of(reports.validation(both, validate.issues(both)), next(at))
    assert got["total_campaigns"] == 2 and got["total_issues"] == sum(c["n_issues"] for c in got["checks"]) == sum(c["n_issues"] for c in got["channels"]) > 0
    counts = [(-c["n_issues"], c["issue"]) for c in got["checks"]]
    assert counts == sorted(counts) and {c["issue"] for c in got["checks"]} == set(validate.CHECKS) and got["examples"][0]["channel"] == "bing"

    pair = "SELECT * FROM VALUES (DATE'2026-02-01', 2, 1, false), (DATE'2026-02-01', 1, 1, true), (DATE'2026-01-01', 1, 1, CAST(NULL AS BOOLEAN)) AS t(cutoff, donor_rank, receiver_rank, confirmed)"
    pairs = spark.sql(pair).withColumns({f"{p}_{c}": F.lit(v) for p in ("donor", "receiver") for c, v in (("channel", "bing"), ("type", "a"), ("roas", 1.0))})
    got = object_of(reports.in_retrospect(pairs), next(at))
    assert [c["cutoff"] for c in got["cutoffs"]] == ["2026-01-01", "2026-02-01"] and [p["donor_rank"] for p in got["cutoffs"][1]["pairs"]] == [1, 2]
    assert [(s["part"], s["n"], s["n_confirmed"]) for s in got["summary"]] == [("grid", 2, 1), ("top_pick", 1, 1)]

    got = object_of(reports.insights(narrative.gather(rows)), next(at))
    assert got["source"] == "template" and got["text"].startswith("google: revenue rose") and got["changes"][0]["channel"] == "google" and got["campaigns"] == [{"n_campaigns": 1}]


def test_streams_sum_as_batches_do(spark, tmp_path):
    folder = str(tmp_path / "facts")
    rows = facts(spark, "2026-01-01", 40, 50).unionByName(facts(spark, "2026-01-01", 5, 7)).unionByName(facts(spark, "2026-01-03", 1, 9, None))
    rows.coalesce(1).write.parquet(folder)
    stream = live.read(spark, folder)
    got = {r["date"]: r["revenue"] for r in spark.table(live.view(live.daily_sums(stream))).collect()}
    want = rows.dropna(subset=["campaign_type"]).groupBy("date").agg(F.sum("revenue").alias("v")).collect()
    assert got == {r["date"]: r["v"] for r in want}
    rates = {r["date"]: r["revenue"] for r in spark.table(live.view(live.sliding_rates(stream))).collect()}
    assert rates[dt.date(2026, 2, 9)] == 50.0 and rates[dt.date(2026, 1, 1)] == pytest.approx(28.5)


def test_stream_keeps_models_fresh(spark, tmp_path):
    """Batches are added to the state and equal the whole table's result: late rows, new keys, null keys,
    and days that leave the window as the newest day moves on."""
    folder, state = (str(tmp_path / n) for n in ("facts", "state"))
    gone = tmp_path / "gone"
    batches = [
        facts(spark, "2026-01-01", 10, 50),
        facts(spark, "2026-03-01", 10, 80).unionByName(facts(spark, "2026-01-05", 2, 20)),  # late ones too
        facts(spark, "2026-03-20", 3, 11).withColumns({"campaign_id": F.lit("c2"), "campaign_type": F.lit("VIDEO")}).unionByName(facts(spark, "2026-03-21", 1, 5, None)),
        facts(spark, "2026-04-12", 1, 7).withColumn("revenue", F.lit(None).cast("double")).unionByName(facts(spark, "2026-02-01", 1, 9).withColumn("date", F.lit(None).cast("date"))),
    ]
    every = None
    for number, rows in enumerate(batches):
        rows.coalesce(1).write.mode("append").parquet(folder)
        live.upserts(live.read(spark, folder), state).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        every = rows if every is None else every.unionByName(rows)
        want = coldstart.upsert(spark.createDataFrame([], live.MODELS), every)
        take = lambda df: sorted(((r["channel"], r["campaign_type"], r["campaign_id"], round(r["level"], 9)) for r in df.collect()))
        assert take(live.current(spark, state)) == take(want), number
        # the rows of a batch are never read again
        for f in (tmp_path / "facts").glob("*.parquet"):
            gone.mkdir(exist_ok=True)
            f.rename(gone / f"{number}-{f.name}")
        assert not list((tmp_path / "state").glob("batch=*"))
    recent = spark.read.parquet(f"{state}/version=3/recent")
    assert recent.agg(F.min("date")).first()[0] > dt.date(2026, 4, 12) - dt.timedelta(28)
    assert live.current(spark, state, before=0).isEmpty()


def test_raw_files_become_a_report(spark, tmp_path):
    (tmp_path / "bing_stats.csv").write_text("TimePeriod,CampaignId,CampaignName,CampaignType,Spend,Revenue,Clicks,Conversions,Impressions,DailyBudget\n2026-01-01,1,a,Search,20,0,3,5,9,10\n2026-01-02,1,b,Search,1,0,3,1,9,10\nno date,1,b,Search,1,0,3,1,9,10\n2026-01-03,1,b,Search,x,0,3,1,9,10\n2026-01-04,1,b\n2026-01-05,1,b,Search,1,0,3,1,9,10,extra\n")
    (tmp_path / "google_ads.csv").write_text("more,segments_date,campaign_id,campaign_name,campaign_advertising_channel_type,metrics_cost_micros,metrics_conversions_value,metrics_clicks,metrics_conversions,metrics_impressions,campaign_budget_amount\nm,2026-01-01,007,g,SEARCH,-2000000,5,1,1,2,\n")
    (tmp_path / "meta_ads.csv").write_text("date_start,campaign_id,campaign_name,spend,conversion\n2026-01-01,9,Prospecting_Campaign_1,5,6\n")
    found = channels.load_raw(spark, str(tmp_path))
    told = {(r["channel"], r["issue"]): (r["n_campaigns"], r["n_rows"], r["n_rejects"], r["n_issues"]) for r in validate.report(found).collect()}
    assert told == {("bing", "unstable_campaign_name"): (1, 2, 4, 1), ("bing", "spend_exceeds_daily_budget"): (1, 2, 4, 1), ("bing", "conversions_exceed_clicks"): (1, 2, 4, 1), ("bing", "zero_revenue_with_spend"): (1, 2, 4, 2), ("google", "negative__spend_derived"): (1, 1, 0, 1), ("meta", None): (1, 1, 0, None)}
    google = found.where("channel = 'google'").first()
    assert google["campaign_id"] == "007" and google["spend"] == -2.0 and google["daily_budget"] is None and google["clicks"] == 1.0
    values = validate.unstable_values(found.where("channel = 'bing'"), "campaign_name").first()
    assert values["values"] == ["a", "b"] and values["amount"] == 2.0
    with pytest.raises(ValueError, match="conversion"):
        (tmp_path / "meta_ads.csv").write_text("date_start,campaign_id,campaign_name,spend\n")
        channels.load_raw(spark, str(tmp_path))


def test_tables_are_written_and_read(spark, tmp_path):
    rows = facts(spark, "2026-01-01", 3, 50)
    channels.write_features(rows, str(tmp_path / "facts"))
    assert sorted(channels.read_features(spark, str(tmp_path / "facts")).collect()) == sorted(rows.collect())
    channels.write_features(rows.limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no rows"):
        channels.read_features(spark, str(tmp_path / "none"))
    channels.write_forecast(coldstart.forecast(rows), str(tmp_path / "csv"))
    (one,) = (tmp_path / "csv").glob("part-*.csv")
    lines = one.read_text().splitlines()
    assert lines[0] == ",".join(coldstart.FORECAST) and len(lines) == 1 + coldstart.forecast(rows).count()


def test_models_and_reports_are_written(spark, tmp_path):
    models = coldstart.upsert(spark.createDataFrame([], live.MODELS), facts(spark, "2026-01-01", 10, 50))
    path = str(tmp_path / "models")
    channels.write_models(models, path)
    assert sorted(channels.read_models(spark, path, live.MODELS).collect()) == sorted(models.collect())
    assert channels.read_models(spark, str(tmp_path / "absent"), live.MODELS).isEmpty()
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("no parquet")
    assert channels.read_models(spark, str(broken), live.MODELS).isEmpty()
    channels.write_models_json(models, str(tmp_path / "json"))
    lines = [json.loads(x) for f in Path(tmp_path / "json").glob("part-*") for x in f.read_text().splitlines()]
    assert {x["key"] for x in lines} == {"google/SEARCH", "google/SEARCH/c1"}
    channels.write_report(spark, str(tmp_path / "report"), {"models": models, "none": models.limit(0)}, {"n": 2})
    (one,) = [json.loads(x) for f in Path(tmp_path / "report").glob("part-*") for x in f.read_text().splitlines()]
    assert one["n"] == 2 and one["none"] == [] and len(one["models"]) == 2
    channels.write_text(spark, "One.\nTwo.", str(tmp_path / "text"))
    assert "".join(f.read_text() for f in Path(tmp_path / "text").glob("part-*")) == "One.\nTwo.\n"


def test_requests(spark):
    models = spark.sql("SELECT 'meta' AS channel, 'a' AS campaign_type, 10.0D AS avg_spend, 0.5D AS beta, 0.5D AS beta_for_scenario UNION ALL SELECT 'bing', 'b', 10.0D, 1.0D, 1.0D")
    sims = spark.sql("SELECT channel, campaign_type, sim, h AS horizon_days, 100.0D AS revenue FROM VALUES ('meta', 'a'), ('bing', 'b') AS t(channel, campaign_type) LATERAL VIEW explode(array(0, 1)) AS sim LATERAL VIEW explode(array(30, 60)) AS h")
    assert requests.health(models).first().asDict() == {"status": "ok", "n_segments": 2}
    alone = requests.forecast(models, sims, channel="meta", horizons=(30,))
    assert {r["run"] for r in alone.collect()} == {"baseline"} and {r["horizon_days"] for r in alone.collect()} == {30} and {r["channel"] for r in alone.collect()} == {"meta"}
    assert requests.forecast(models, sims, budgets={"meta": 1.0}).where("run = 'scenario'").isEmpty()
    both = requests.forecast(models, sims, budgets={"meta": 0.25})
    assert [r["p50"] for r in both.where("run = 'scenario' and channel = 'meta' and campaign_type = 'a' and metric = 'revenue' and horizon_days = 30").collect()] == [50.0]
    assert requests.deltas(both).where("metric = 'revenue' and horizon_days = 30").first()["change_pct"] == -25.0
    top = spark.sql("SELECT 1 AS place, 'meta' AS donor_channel, 'a' AS donor_type, 'bing' AS receiver_channel, 'b' AS receiver_type, 2.0D AS shift_daily, 0.25D AS donor_multiple, 2.5D AS receiver_multiple")
    moved = requests.top_recommendation(models, sims, top)
    assert {r["channel"] for r in moved.collect()} == {"blended"} and {r["run"] for r in moved.collect()} == {"baseline", "scenario"}
    # half of meta's 100 is left (0.25 to the power 0.5); 2.5 of bing's saturate: 1 + 1.5 / (1 + 0.5 * 1.5)
    assert moved.where("run = 'scenario' and metric = 'revenue' and horizon_days = 30").first()["p50"] == pytest.approx(50 + 100 * (1 + 1.5 / 1.75), abs=1e-3)
    assert requests.top_recommendation(models, sims, top.limit(0)).isEmpty()


def test_requests_read_the_newest_version(spark, tmp_path):
    held = Snapshots(spark, str(tmp_path / "service"))
    with pytest.raises(LookupError):
        requests.answer(held)
    row = "SELECT 'meta' AS channel, 'a' AS campaign_type, 10.0D AS avg_spend, 1.0D AS beta, array(0.0D) AS pool, {}D AS level_at_end, 0.0D AS slope, array_repeat(1.0D, 7) AS dow, 1.0D AS holiday_factor, date'2026-02-01' AS last_train_date"
    first = requests.refresh(held, spark.sql(row.format("5.0")), 4)
    asked = requests.answer(held, channel="meta", horizons=(30,)).where("metric = 'revenue' and campaign_type = 'a'")
    assert asked.first()["p50"] == 150.0
    assert requests.refresh(held, spark.sql(row.format("6.0")), 4) == first + 1
    assert requests.answer(held, channel="meta", horizons=(30,)).where("metric = 'revenue' and campaign_type = 'a'").first()["p50"] == 180.0
    assert asked.first()["p50"] == 150.0  # a request under way keeps its version
    with pytest.raises(LookupError):
        requests.answer(held, most_seconds=-1)
    held.expire()
    assert held.versions() == [first + 1] and spark.sparkContext._jsc.getPersistentRDDs().size() == 0
