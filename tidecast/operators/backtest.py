"""Walk-forward tests: segments, cutoffs, methods and scales are columns of one job each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.expressions import CUTOFFS, MIN_SPLIT_CUTOFFS, MIN_TRAIN_DAYS, MORE_CUTOFFS, N_SIMS, SCALE_COVERAGE, SCALES, TEST_DAYS, pinball
from tidecast.operators.methods import DEFAULT, METHODS, FitMethod, fitted_by
from tidecast.operators.series import SEGMENT
from tidecast.operators.simulate import simulated_percentiles

FOLD = (*SEGMENT, "cutoff")


def cutoffs(series: DataFrame, count: int = CUTOFFS) -> DataFrame:
    """(segment, cutoff) with enough days before and after, oldest first by date."""
    span = series.groupBy(*SEGMENT).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    each = span.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn("cutoff", F.expr(f"date_sub(b, i * {TEST_DAYS})"))
    # series are dense, so days are rows
    enough = (F.datediff("cutoff", "a") + 1 >= MIN_TRAIN_DAYS) & (F.least(F.datediff("b", "cutoff"), F.lit(TEST_DAYS)) >= TEST_DAYS)
    return each.where(enough).select(*SEGMENT, "cutoff")


def all_methods(keys: DataFrame, methods: dict[str, FitMethod] | None = None) -> DataFrame:
    """Each row of keys with each method's name."""
    return keys.withColumn("method", F.explode(F.array(*map(F.lit, methods or METHODS))))


def fold_scores(series: DataFrame, folds: DataFrame, n_sims: int = N_SIMS, scales: tuple[float, ...] = (1.0,), methods: dict[str, FitMethod] | None = None) -> DataFrame:
    """(segment, cutoff, method, scale, actual, p10, p50, p90, ape, pinball, covered).

    folds: (segment, cutoff, method), one job for any number of methods. Methods and scales
    share a fold's draws; percentiles are taken where the draws are made."""
    wide = series.join(folds.select(*FOLD).distinct(), list(SEGMENT)).where(F.datediff("date", "cutoff") <= TEST_DAYS)
    train = wide.where(F.col("date") <= F.col("cutoff")).select(*FOLD, "date", "revenue", "spend")
    found = fitted_by(train, folds, FOLD, methods)
    limits = simulated_percentiles(found, (*FOLD, "method"), (TEST_DAYS,), n_sims, scales=scales, by=FOLD)
    after = wide.where(F.col("date") > F.col("cutoff"))
    actual = after.groupBy(*FOLD).agg(F.sum("revenue").alias("actual"))
    p = [F.col("p")[i] for i in range(3)]
    loss: Column = sum((pinball(F.col("actual"), q, t) for q, t in zip(p, (0.1, 0.5, 0.9), strict=True)), F.lit(0.0)) / 3
    ape = F.abs(F.col("actual") - p[1]) / F.greatest("actual", F.lit(1.0)) * 100
    percent = [x.alias(n) for x, n in zip(p, ("p10", "p50", "p90"), strict=True)]
    return limits.join(actual, list(FOLD)).select(*FOLD, "method", "scale", "actual", *percent, ape.alias("ape"), loss.alias("pinball"), F.col("actual").between(p[0], p[2]).alias("covered"))


def summary(scores: DataFrame, *more: str) -> DataFrame:
    return scores.groupBy(*SEGMENT, "method", "scale", *more).agg(F.count("*").alias("n_folds"), F.avg("ape").alias("ape"), F.avg("pinball").alias("pinball"), (F.avg(F.col("covered").cast("int")) * 100).alias("coverage"))


LOW_COVERAGE, HIGH_APE = 40, 150  # fixed values: forecasts beyond them aren't relied on


def reliability(scores: DataFrame) -> DataFrame:
    """(segment, method, ape, coverage, low_reliability) of tested segments, the worst covered first."""
    low = (F.col("coverage") < LOW_COVERAGE) | (F.col("ape") > HIGH_APE)
    told = summary(scores).select(*SEGMENT, "method", F.round("ape", 1).alias("ape"), F.round("coverage", 1).alias("coverage"), low.alias("low_reliability"))
    return told.orderBy(F.coalesce("coverage", F.lit(999.0)), *SEGMENT)


def compare(series: DataFrame, n_sims: int = N_SIMS, methods: dict[str, FitMethod] | None = None) -> DataFrame:
    """All methods on the same folds, one row a segment and method; segments that can't be tested have nulls."""
    scored = summary(fold_scores(series, all_methods(cutoffs(series), methods), n_sims, methods=methods))
    every = all_methods(series.select(*SEGMENT).distinct(), methods)
    order = [F.col("pinball").isNull(), F.col("pinball"), F.col("method") != DEFAULT, F.col("method")]
    rank = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy(*order))
    told = every.join(scored, [*SEGMENT, "method"], "left").withColumn("winner", rank == 1)
    return told.select(*SEGMENT, "method", F.coalesce("n_folds", F.lit(0)).alias("n_folds"), "ape", "pinball", "coverage", "winner")


def select_method(series: DataFrame, n_sims: int = N_SIMS, methods: dict[str, FitMethod] | None = None) -> DataFrame:
    """The method of least loss for each segment; equal or untested, the default one."""
    return compare(series, n_sims, methods).where("winner").drop("winner")


def calibrate(series: DataFrame, n_sims: int = N_SIMS, chosen_methods: DataFrame | None = None, methods: dict[str, FitMethod] | None = None) -> DataFrame:
    """Scale of the residuals: tuned on the older half of the cutoffs, reported on the newer.
    With chosen_methods (segment, method) each segment is scored by its own method. A segment
    with too few cutoffs isn't tuned: its scale is 1, reported on all it has."""
    folds = cutoffs(series, MORE_CUTOFFS)
    place = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("cutoff"))
    total = F.count("*").over(Window.partitionBy(*SEGMENT))
    split = folds.select(*FOLD, place.alias("place"), total.alias("total")).withColumn("older", F.col("place") <= F.floor(F.col("total") / 2))
    own = folds.withColumn("method", F.lit(DEFAULT)) if chosen_methods is None else folds.join(chosen_methods.select(*SEGMENT, "method"), list(SEGMENT))
    scores = fold_scores(series, own, n_sims, SCALES, methods)
    scored = scores.join(split, list(FOLD)).withColumn("tuned", F.col("total") >= MIN_SPLIT_CUTOFFS)
    # both halves in one pass, as the scores come from a long plan; then a row for each scale of a segment
    tuning, held = F.col("tuned") & F.col("older"), ~F.col("tuned") | ~F.col("older")
    share = lambda which: F.avg(F.when(which, F.col("covered").cast("int"))) * 100
    means = [F.count_if(held).alias("n_folds"), *[F.avg(F.when(held, F.col(c))).alias(c) for c in ("ape", "pinball")], share(held).alias("coverage")]
    halves = scored.groupBy(*SEGMENT, "method", "scale", "tuned").agg(share(tuning).alias("older_coverage"), *means)
    fits = F.min(F.when(F.col("older_coverage") >= SCALE_COVERAGE, F.col("scale"))).alias("fits")
    widest = F.max(F.when(F.col("older_coverage").isNotNull(), F.struct("older_coverage", (-F.col("scale")).alias("s")))).alias("widest")
    row = ["method", "scale", "tuned", "n_folds", "ape", "pinball", "coverage"]
    told = halves.groupBy(*SEGMENT).agg(fits, widest, F.collect_list(F.struct(*row)).alias("scales"))
    chosen = F.coalesce("fits", -F.col("widest.s"), F.lit(1.0))
    own = told.select(*SEGMENT, F.inline(F.filter("scales", lambda r: (r["scale"] == chosen) & (r["n_folds"] > 0))))
    return own.select(*SEGMENT, *row)


def portfolio(scores: DataFrame) -> DataFrame:
    """One row over segments that were tested, each weighing the same."""
    return summary(scores).agg(F.count("*").alias("n_segments"), F.avg("ape").alias("mean_ape"), F.percentile("ape", F.lit(0.5)).alias("median_ape"), F.avg("pinball").alias("pinball"), F.avg("coverage").alias("coverage"))
