"""Contests, training through stage tables, estimated starts and snapshots."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import expressions as X
from tidecast.operators import backtest, fit, holt_winters, methods, series, simulate, train
from tidecast.sources import channels
from tidecast.sources.store import Snapshots, Stages

SEGMENTS = [("bing", "S"), ("google", "S"), ("google", "V"), ("meta", "D")]


def facts(spark, days=220, short=9):
    """Four segments of two campaigns each, one of them short in every second segment."""
    rng = np.random.default_rng(3)
    first, data = dt.date(2025, 1, 1), []
    for i, (channel, kind) in enumerate(SEGMENTS):
        for c in range(2):
            n = short + i if c and i % 2 else days
            for d in range(days - n, days):
                spend = float(rng.uniform(5, 20))
                revenue = float(max(0.0, 3 * spend + 10 * np.sin(2 * np.pi * d / 7) + rng.normal(0, 6) + 0.05 * i * d))
                data.append((first + dt.timedelta(d), channel, f"{kind}{c}", f"{kind}{c} name", kind, spend, revenue, None, False, "prospecting"))
    return spark.createDataFrame(data, channels.FEATURES)


def plain_contest(daily, n_sims):
    """Each fold by loops: fixed smoothing or trend, draws by key, plain percentiles."""
    out = {}
    for seg in SEGMENTS:
        rows = sorted((r["date"], r["revenue"]) for r in daily if (r["channel"], r["campaign_type"]) == seg)
        for back in range(1, X.CUTOFFS + 1):
            n = len(rows) - back * X.TEST_DAYS
            if n < X.MIN_TRAIN_DAYS:
                continue
            cutoff, past, actual = rows[n - 1][0], rows[:n], sum(v for _, v in rows[n : n + X.TEST_DAYS])
            revenue = np.array([v for _, v in past])
            last = revenue[-X.TREND_DAYS :]
            y = np.clip(last, 0, np.quantile(last, X.CLIP_PERCENTILE))
            x = np.arange(len(y))
            slope, start = np.polyfit(x, y, 1)
            dow = {w: np.mean([v for d, v in past if d.weekday() == w]) / revenue.mean() for w in range(7)}
            dates = [d for d, _ in past][-X.TREND_DAYS :]
            ahead = [cutoff + dt.timedelta(k) for k in range(1, X.TEST_DAYS + 1)]
            trend = [max(0, start + slope * (len(y) - 1) + slope * k) * dow[d.weekday()] for k, d in enumerate(ahead, 1)]
            w = np.array(holt_winters.FIXED)
            level, tilt, season, fits = holt_winters.run(y, w[None], holt_winters.fixed_start(y)[None])
            path = [max(0, level[0] + tilt[0] * k + season[0][(len(y) + k - 1) % 7]) for k in range(1, X.TEST_DAYS + 1)]
            pools = {"empirical": last - (start + slope * x) * np.array([dow[d.weekday()] for d in dates]), "fixed": last - fits[0]}
            for name, points in (("empirical", trend), ("fixed", path)):
                sums = []
                for sim in range(n_sims):
                    begin = X.streams(f"{seg[0]}|{seg[1]}|{cutoff}", [sim], "simulate", X.SEED)
                    at = X.drawn(begin, np.arange(-(-X.TEST_DAYS // X.BLOCK))) % (len(last) - X.BLOCK + 1)
                    noise = np.concatenate([pools[name][a : a + X.BLOCK] for a in at])[: X.TEST_DAYS]
                    sums.append(np.maximum(0, np.array(points) + noise * X.CHANNEL_INFLATION.get(seg[0], 1.0)).sum())
                p = np.quantile(sums, simulate.PERCENT)
                loss = np.mean([max(t * (actual - q), (t - 1) * (actual - q)) for q, t in zip(p, simulate.PERCENT)])
                out.setdefault((*seg, name), []).append((loss, p[0] <= actual <= p[2]))
    return {k: (np.mean([a for a, _ in v]), 100 * np.mean([b for _, b in v])) for k, v in out.items()}


def test_contest_against_loops(spark):
    daily = series.daily(facts(spark))
    both = {"empirical": methods.empirical, "fixed": methods.smoothed_fixed}
    got = {(r["channel"], r["campaign_type"], r["method"]): (r["pinball"], r["coverage"], r["winner"]) for r in backtest.compare(daily, 60, both).collect()}
    want = plain_contest(daily.collect(), 60)
    assert got.keys() == want.keys()
    for k, (loss, coverage) in want.items():
        assert got[k][0] == pytest.approx(loss, rel=1e-6) and got[k][1] == pytest.approx(coverage)
        other = (*k[:2], "fixed" if k[2] == "empirical" else "empirical")
        assert got[k][2] == (loss < want[other][0] or (loss == want[other][0] and k[2] == "empirical"))


def test_a_third_method_takes_part_and_wins(spark):
    daily = series.daily(facts(spark))
    truth = daily.groupBy(*series.SEGMENT).agg(F.map_from_arrays(F.collect_list("date"), F.collect_list("revenue")).alias("known"))

    def oracle(rows, keys):
        found = fit.models(rows, keys).join(truth, list(series.SEGMENT))
        days = F.transform(F.sequence(F.lit(1), F.lit(120)), lambda k: F.coalesce(F.element_at("known", F.date_add("last_train_date", k)), F.lit(0.0)))
        return found.withColumn("path", days).withColumn("pool", F.array(F.lit(0.0))).drop("known")

    three = {**methods.METHODS, "oracle": oracle}
    won = backtest.select_method(daily, 20, three).collect()
    assert {r["method"] for r in won} == {"oracle"} and all(r["pinball"] == pytest.approx(0.0) for r in won)
    assert {r["method"] for r in backtest.calibrate(daily, 20, spark.createDataFrame(won).select(*series.SEGMENT, "method"), three).collect()} == {"oracle"}


def test_training_reads_its_facts_once(spark, tmp_path):
    """All stages go on from sums by day, which don't grow with the rows of a fact table."""
    rows, read = facts(spark), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    trained = train.train(rows.mapInArrow(counted, rows.schema), Stages(spark, str(tmp_path / "run")), n_sims=10, resamples=5, methods={methods.DEFAULT: methods.empirical})
    assert read.value == rows.count()
    assert trained.campaigns.count() == 8


def test_training_run(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "run"))
    trained = train.train(facts(spark), stages, n_sims=40, resamples=20)
    rows = train.one_table(trained).collect()
    assert len([r for r in rows if r["campaign_id"] == ""]) == 4
    assert {(r["channel"], r["campaign_id"]): r["is_shrinkage"] for r in rows if r["campaign_id"]} == {(c, f"{k}{i}"): i == 1 and (c, k) in SEGMENTS[1::2] for c, k in SEGMENTS for i in range(2)}
    won = {(r["channel"], r["campaign_type"]): r["method"] for r in trained.contest.collect()}
    for r in rows:
        assert r["method"] == won[r["channel"], r["campaign_type"]]  # of their segment
        if r["campaign_id"]:
            assert r["spread"] == X.CHANNEL_INFLATION.get(r["channel"], 1.0)
    told = train.trained_forecast(trained, (30, 90), 40)
    assert told.where("p10 > p50 or p50 > p90").count() == 0
    assert told.groupBy("channel", "campaign_type", "campaign_id", "horizon_days").count().count() == 2 * (4 + 3 + 1 + 8)
    plan = told.where("campaign_id <> ''")._jdf.queryExecution().toString()
    assert "segment-series" not in plan  # planned from the stage tables
    stages.release()
    assert not (tmp_path / "run").exists()


def test_keys_without_a_path_keep_their_trend(spark):
    models = spark.sql("SELECT 'bing' AS channel, 'S' AS campaign_type, array(1.0D) AS pool, cast(null AS array<double>) AS path, 10.0D AS level_at_end, 0.0D AS slope, array_repeat(1.0D, 7) AS dow, 1.0D AS holiday_factor, date'2025-03-01' AS last_train_date")
    for rows in (models, models.withColumn("path", F.array().cast("array<double>"))):
        assert [r["revenue"] for r in simulate.simulate(rows, series.SEGMENT, (2,), 3).collect()] == [22.0] * 3
        assert simulate.simulated_percentiles(rows, series.SEGMENT, (2,), 3).first()["p"] == [22.0] * 3


def test_local_percentiles_are_those_of_the_simulations(spark):
    daily = series.daily(facts(spark))
    models = fit.models(daily)
    sims = simulate.simulate(models, series.SEGMENT, (30, 90), 333)
    want = {(r["channel"], r["campaign_type"], r["horizon_days"]): r["p"] for r in sims.groupBy(*series.SEGMENT, "horizon_days").agg(F.percentile("revenue", F.array(*map(F.lit, simulate.PERCENT))).alias("p")).collect()}
    local = simulate.simulated_percentiles(models, series.SEGMENT, (30, 90), 333)
    assert {(r["channel"], r["campaign_type"], r["horizon_days"]): pytest.approx(r["p"]) for r in local.collect()} == want
    after = local._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in after


def test_estimated_start_is_the_least_squares_one():
    rng = np.random.default_rng(5)
    for n in (14, 15, 40, 120) * 5:
        y = np.abs(rng.normal(100, 30, n) + np.arange(n) * rng.normal())
        w, start = holt_winters.best(y)
        error = lambda s: ((holt_winters.run(y, w[None], s[None])[3] - y) ** 2).sum()  # noqa: E731, B023
        # a plain solver: the fits are linear in the start
        base = holt_winters.run(y, w[None], np.zeros((1, 9)))[3][0]
        columns = np.stack([holt_winters.run(np.zeros(n), w[None], np.eye(9)[k][None])[3][0] for k in range(9)], 1)
        solved = np.linalg.lstsq(columns, y - base, rcond=None)[0]
        assert error(start) == pytest.approx(error(solved), rel=1e-6, abs=1e-6)
        assert error(start) <= error(holt_winters.fixed_start(y)) + 1e-9


def test_snapshots(spark, tmp_path):
    held = Snapshots(spark, str(tmp_path / "models"))
    with pytest.raises(LookupError):
        held.read("models")
    assert held.publish(models=spark.range(3), sims=spark.range(1)) == 1
    before = held.read("models")
    (tmp_path / "models" / "v=2" / "models").mkdir(parents=True)  # a publisher that was lost
    assert held.versions() == [1] and held.publish(models=spark.range(5)) == 3
    assert held.read("models").count() == 5 and before.count() == 3 and held.read("models", 1).count() == 3
    assert held.read("models", most_seconds=3600).count() == 5
    with pytest.raises(LookupError):
        held.read("models", most_seconds=-1)
    assert held.expire(after_seconds=3600) == [] and held.expire() == [1]
    assert held.versions() == [3] and not (tmp_path / "models" / "v=2").exists()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_elasticities_at_cutoffs_are_those_of_what_was_known(spark):
    """Against fits of each shortened series; cutoffs before, within and after a series."""
    daily = series.daily(facts(spark)).withColumn("date", F.when(F.col("channel") == "meta", F.date_sub("date", 40)).otherwise(F.col("date")))
    stages = Stages(spark)
    daily = stages.keep("series", daily)
    last = daily.agg(F.max("date").alias("b"))
    offsets = (10, 60, 205, 240)
    got = {(r["cutoff"], r["channel"], r["campaign_type"]): r for r in fit.elasticity_at(daily, offsets, last, resamples=12).collect()}
    end = last.first()["b"]
    seen = set()
    for back in offsets:
        cutoff = end - dt.timedelta(back)
        known = daily.where(F.col("date") <= F.lit(cutoff)).withColumn("cutoff", F.lit(cutoff))
        for r in fit.elasticity(known, ("cutoff", *series.SEGMENT), 12).collect():
            k = (cutoff, r["channel"], r["campaign_type"])
            seen.add(k)
            assert got[k]["n_obs"] == r["n_obs"] and got[k]["low_confidence"] == r["low_confidence"], k
            for c in ("beta", "ci_low", "ci_high"):
                assert got[k][c] == pytest.approx(r[c], abs=1e-8), (k, c)
        for r in daily.where((F.col("date") > F.lit(cutoff)) & (F.col("date") <= F.date_add(F.lit(cutoff), 30))).groupBy(*series.SEGMENT).agg((F.sum("revenue") / F.sum("spend")).alias("roas")).collect():
            k = (cutoff, r["channel"], r["campaign_type"])
            assert k not in got or got[k]["roas_after"] == pytest.approx(r["roas"])
        for r in known.groupBy(*series.SEGMENT).agg(F.count("*").alias("n")).collect():
            assert got[cutoff, r["channel"], r["campaign_type"]]["n_days"] == r["n"]
    assert got.keys() == seen and any(r["roas_after"] is None for r in got.values())
    stages.release()


def test_trained_segments_forecast_by_their_winners(spark, tmp_path):
    """Against loops: the winner's path and residuals, spread by the calibrated scale."""
    stages, n_sims = Stages(spark, str(tmp_path / "run")), 50
    daily = stages.keep("series", series.daily(facts(spark)))
    won = stages.keep("contest", backtest.select_method(daily, n_sims, methods.FIXED_METHODS))
    models = stages.keep("segments", train.segments(daily, won, stages, n_sims, 20, methods.FIXED_METHODS))
    scales = {(r["channel"], r["campaign_type"]): r["scale"] for r in backtest.calibrate(daily, n_sims, won, methods.FIXED_METHODS).collect()}
    by_method = {name: {(r["channel"], r["campaign_type"]): r for r in fitted(daily).collect()} for name, fitted in methods.FIXED_METHODS.items()}
    sims = simulate.simulate(models, series.SEGMENT, (30,), n_sims, F.col("spread"))
    told = {(r["channel"], r["campaign_type"]): r for r in simulate.forecast(models, sims, simulate.multiples(models)).where("metric = 'revenue'").collect()}
    chosen = {(r["channel"], r["campaign_type"]): r["method"] for r in won.collect()}
    assert len(chosen) == 4 and set(scales.values()) <= set(X.SCALES)
    total = np.zeros(n_sims)
    for key, name in chosen.items():
        row = by_method[name][key]
        ahead = [row["last_train_date"] + dt.timedelta(k) for k in range(1, 31)]
        trend = [max(0, row["level_at_end"] + row["slope"] * k) * row["dow"][d.weekday()] * (row["holiday_factor"] if (11, 20) <= (d.month, d.day) <= (12, 31) else 1) for k, d in enumerate(ahead, 1)]
        points, pool = np.array(trend if name == "empirical" else row["path"][:30]), np.array(row["pool"])
        sums = np.zeros(n_sims)
        for sim in range(n_sims):
            begin = X.streams("|".join(key), [sim], "simulate", X.SEED)
            at = X.drawn(begin, np.arange(-(-30 // X.BLOCK))) % (len(pool) - X.BLOCK + 1)
            noise = np.concatenate([pool[a : a + X.BLOCK] for a in at])[:30]
            sums[sim] = np.maximum(0, points + noise * scales[key] * X.CHANNEL_INFLATION.get(key[0], 1.0)).sum()
        total += sums
        assert [told[key][p] for p in ("p10", "p50", "p90")] == pytest.approx(np.quantile(sums, simulate.PERCENT).tolist(), abs=1e-3)
    assert [told["blended", ""][p] for p in ("p10", "p50", "p90")] == pytest.approx(np.quantile(total, simulate.PERCENT).tolist(), abs=1e-3)
    stages.release()
