"""What a service answers, as frames: health, forecasts on request, the best recommendation.

models and sims are as in simulate.forecast(): written tables, or those of the newest
version in a store of snapshots, which refresh() adds to and answer() reads. A filter that no
row meets gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.expressions import N_SIMS
from tidecast.operators import simulate
from tidecast.operators.series import SEGMENT
from tidecast.sources.store import Snapshots


def health(models: DataFrame) -> DataFrame:
    return models.agg(F.lit("ok").alias("status"), F.count("*").alias("n_segments"))


def _run(name: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(name).alias("run"), "*")


def forecast(models: DataFrame, sims: DataFrame, channel: str | None = None, campaign_type: str | None = None, horizons: tuple[int, ...] | None = None, budgets: dict[str, float] | None = None) -> DataFrame:
    """The baseline, and a scenario below it if any channel's budget changes, labelled by `run`."""
    if horizons is not None:
        sims = sims.where(F.col("horizon_days").isin(*horizons))
    rows = _run("baseline", simulate.forecast(models, sims, F.lit(1.0)))
    if any(m != 1.0 for m in (budgets or {}).values()):
        moved = simulate.forecast(models, sims, simulate.multiples(models, channel=budgets))
        rows = rows.unionByName(_run("scenario", moved))
    for name, value in (("channel", channel), ("campaign_type", campaign_type)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def deltas(rows: DataFrame) -> DataFrame:
    """How the scenario's blended medians differ from the baseline's, the largest change first."""
    blended = rows.where("channel = 'blended'")
    of = lambda run: blended.where(F.col("run") == run).select("horizon_days", "metric", F.col("p50").alias(run))
    both = of("baseline").join(of("scenario"), ["horizon_days", "metric"])
    change = F.when(F.col("baseline") > 0, F.round((F.col("scenario") - F.col("baseline")) / F.col("baseline") * 100, 2))
    return both.withColumn("change_pct", change).orderBy(F.coalesce("change_pct", F.lit(0.0)).desc(), "horizon_days", "metric")


def top_recommendation(models: DataFrame, sims: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Blended rows before and after the first recommendation, by the multiples of spend that it was
    priced with; no row at all where there is none. recommendations: the pair's columns, place,
    donor_multiple and receiver_multiple."""
    best = recommendations.orderBy("place").limit(1)
    sides = best.select(F.inline(F.array(*[F.struct(F.col(f"{p}_channel").alias("channel"), F.col(f"{p}_type").alias("campaign_type"), F.col(f"{p}_multiple").alias("multiple")) for p in ("donor", "receiver")])))
    told = models.join(F.broadcast(sides), list(SEGMENT), "left")  # two rows at most
    moved = simulate.forecast(told, sims, F.coalesce("multiple", F.lit(1.0)))
    rows = _run("baseline", simulate.forecast(models, sims, F.lit(1.0))).unionByName(_run("scenario", moved)).where("channel = 'blended'")
    return rows.crossJoin(F.broadcast(best.select(F.lit(True).alias("available")))).drop("available")  # one row or none


def refresh(snapshots: Snapshots, models: DataFrame, n_sims: int = N_SIMS) -> int:
    """Publish models and their simulations as a new version, which requests read from then on."""
    spread = {"spread": F.col("spread")} if "spread" in models.columns else {}
    return snapshots.publish(models=models, simulations=simulate.simulate(models, SEGMENT, n_sims=n_sims, **spread))


def answer(snapshots: Snapshots, most_seconds: float | None = None, **asked) -> DataFrame:
    """forecast() from the newest version; LookupError where it is older than most_seconds, or there is
    none. Both tables are of one version, and nothing is held between requests."""
    found = snapshots.versions()
    version = found[-1] if found else None
    models = snapshots.read("models", version, most_seconds)
    return forecast(models, snapshots.read("simulations", version), **asked)
