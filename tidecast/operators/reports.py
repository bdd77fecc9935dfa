"""The reports of the engine's runs: backtest, training, validation, recommendations in
retrospect, and insights. Each is one row: numbers, and lists of rows in a stated order,
which `channels.write_json` writes as one object.

Lists are bounded by segments, cutoffs or checks. Validation lists a few issues of each
channel and check beside the counts of all; the whole list is a table, `validate.issues`.

Defined results: without any rows, lists are empty and totals 0; ties go by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.operators import backtest, narrative, recommend, validate
from tidecast.operators.series import SEGMENT


def listed(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """One row: the rows as a list, in that order."""
    key = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]).alias("key")
    each = rows.select(F.struct(key, F.struct("*").alias("row")).alias("each"))
    return each.agg(F.transform(F.array_sort(F.collect_list("each")), lambda x: x["row"]).alias(name))


def beside(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Tables of one row each, as one row."""
    for one in more:
        first = first.crossJoin(F.broadcast(one))
    return first


def backtested(compared: DataFrame) -> DataFrame:
    """(segments, wins). compared: from backtest.compare, a row a segment and method; segments by name,
    each with its winner and its methods' scores."""
    scores = F.struct("method", "n_folds", "ape", "pinball", "coverage")
    own = compared.groupBy(*SEGMENT).agg(F.max(F.when(F.col("winner"), F.col("method"))).alias("winner"), F.array_sort(F.collect_list(scores)).alias("methods"))
    wins = compared.groupBy("method").agg(F.count_if("winner").alias("n_segments"))
    return beside(listed(own, "segments", *SEGMENT), listed(wins, "wins", -F.col("n_segments"), "method"))


def trained(calibrated: DataFrame) -> DataFrame:
    """(n_segments, n_tuned, mean_ape, mean_coverage, segments). calibrated: from backtest.calibrate."""
    means = calibrated.agg(F.count("*").alias("n_segments"), F.count_if("tuned").alias("n_tuned"), F.avg("ape").alias("mean_ape"), F.avg("coverage").alias("mean_coverage"))
    return beside(means, listed(calibrated, "segments", *SEGMENT))


def validation(facts: DataFrame, found: DataFrame, most: int = 5) -> DataFrame:
    """(total_campaigns, total_issues, channels, checks, examples): checks by count, the most frequent first.
    found: validate.issues(facts), written before, as it is read for each list."""
    sizes = validate.channels(facts, found)
    totals = sizes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n_campaigns", "total_campaigns"), ("n_issues", "total_issues"))])
    checks = listed(validate.summary(facts, found), "checks", -F.col("n_issues"), "issue")
    return beside(totals, listed(sizes, "channels", "channel"), checks, listed(validate.examples(facts, most, found), "examples", "channel", "issue", "place"))


def in_retrospect(pairs: DataFrame) -> DataFrame:
    """(summary, cutoffs). pairs: from recommend.retrospective; cutoffs from the oldest, each with its pairs by rank."""
    own = pairs.select("cutoff", F.struct("donor_rank", "receiver_rank", "donor_channel", "donor_type", "donor_roas", "receiver_channel", "receiver_type", "receiver_roas", "confirmed").alias("pair"))
    cutoffs = own.groupBy("cutoff").agg(F.count("*").alias("n_pairs"), F.array_sort(F.collect_list("pair")).alias("pairs"))
    return beside(listed(recommend.confirmed(pairs), "summary", "part"), listed(cutoffs, "cutoffs", "cutoff"))


def insights(found: dict[str, DataFrame], writer: Callable | None = None) -> DataFrame:
    """(text, risk_flags, source, a list for each statistic). found: from narrative.gather."""
    spark = found["checks"].sparkSession
    told = narrative.report(narrative.tell(spark, found), writer)
    words = spark.createDataFrame([(told["text"], told["risk_flags"], told["source"])], "text string, risk_flags array<string>, source string")
    return beside(words, *[listed(rows, name, rows.columns[0]) for name, rows in found.items()])
