"""A report in words over the statistics: each statement is a row, made by expressions.

Statements come in parts, in this order: changes by channel, slopes, unsure slopes,
outlying campaigns, unreliable forecasts, channels with idle money, checks,
recommendations, scenarios. A statement may carry a risk.

Defined results: a null change, or a null ratio, makes no statement; null names are
written as `?`; ties go by name. Without any statement there is one that says so.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.functions.expressions import rounded
from tidecast.operators import stats, validate
from tidecast.operators.stats import PERIOD, Z

# Thresholds of the statements.
DECLINE, SCALABLE, DIMINISHING, MOST_CAMPAIGNS, MOST_OTHERS = -15.0, 0.8, 0.5, 5, 3
STATEMENT = "part int, place int, statement string, risk string"


def _name(*columns: str) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns])


def _money(column: str) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.col(column), 0))


def _fixed(x: Column, digits: int) -> Column:
    """As printf writes it: of the number's exact value, halves to even (31.25: 31.2), and with the sign of what
    rounds to zero. format_string rounds the number's shortest text instead (31.3)."""
    return F.translate(F.format_number(x.cast("double"), digits), ",", "")


def _number(column: str, digits: int) -> Column:
    return _fixed(F.col(column), digits)


def _change(column: str) -> Column:
    text = _fixed(rounded(F.col(column), 1), 1)
    return F.concat(F.when(text.startswith("-"), "").otherwise("+"), text, F.lit(" %"))


def _rows(df: DataFrame, part: int, order: list[Column], statement: Column, risk: Column | None = None) -> DataFrame:
    place = F.row_number().over(Window.orderBy(*order)) if order else F.lit(1)
    told = df.select(F.lit(part).alias("part"), place.cast("int").alias("place"), statement.alias("statement"), (F.lit(None).cast("string") if risk is None else risk).alias("risk"))
    return told.where("statement is not null or risk is not null")


def changes(deltas: DataFrame) -> DataFrame:
    """deltas: as from stats.period_deltas; the largest rise first."""
    pct = F.col("revenue_change_pct")
    way = F.when(pct >= 0, "rose").otherwise("fell")
    said = F.concat(_name("channel"), F.lit(": revenue "), way, F.lit(" "), _fixed(F.abs(pct), 1), F.lit(f" % in the last {PERIOD} days, to "), _money("now_revenue"), F.lit(" from "), _money("then_revenue"), F.lit("."))
    risk = F.when(pct < DECLINE, F.concat(F.lit("Revenue of "), _name("channel"), F.lit(f" fell by more than {-DECLINE:.0f} % against the period before.")))
    return _rows(deltas.where(pct.isNotNull()), 1, [F.coalesce(pct, F.lit(0.0)).desc(), F.col("channel")], said, risk)


def slopes(elasticity: DataFrame) -> DataFrame:
    """The steepest segment that scales, the flattest that doesn't, and how many can't be told."""
    sure = elasticity.where("not low_confidence")
    beta, name = F.col("beta"), ["channel", "campaign_type"]
    best = sure.where(beta >= SCALABLE).orderBy(beta.desc(), *name).limit(1)
    least = sure.where(beta < DIMINISHING).orderBy(beta, *name).limit(1)
    up = _rows(best, 2, [], F.concat(F.lit("More money goes furthest in "), _name(*name), F.lit(" (slope "), _number("beta", 2), F.lit(").")))
    down = _rows(least, 2, [], F.concat(F.lit("More money earns ever less in "), _name(*name), F.lit(" (slope "), _number("beta", 2), F.lit(")."))).withColumn("place", F.lit(2))
    unsure = elasticity.where("low_confidence").agg(F.count("*").alias("n")).where("n > 0")
    risk = F.concat(F.col("n").cast("string"), F.lit(" segments have no sure slope; how they respond to a budget is a guess."))
    return up.unionByName(down).unionByName(_rows(unsure, 3, [], F.lit(None).cast("string"), risk))


def outliers(anomalies: DataFrame) -> DataFrame:
    z = F.col("z_score")
    few = anomalies.orderBy(F.abs(z).desc(), "channel", "campaign_id", "campaign_name").limit(MOST_CAMPAIGNS)
    way = F.when(z > 0, "above").otherwise("below")
    said = F.concat(F.lit("Campaign "), _name("campaign_name"), F.lit(" returns "), _number("roas", 2), F.lit(", far "), way, F.lit(" the others of "), _name("channel"), F.lit(" (z "), _number("z_score", 2), F.lit(")."))
    risk = F.when(z < -Z, F.concat(F.lit("Campaign "), _name("campaign_name"), F.lit(" returns far too little.")))
    return _rows(few, 4, [F.abs(z).desc(), *map(F.col, ("channel", "campaign_id", "campaign_name"))], said, risk)


def unreliable(reliability: DataFrame) -> DataFrame:
    """reliability: (channel, campaign_type, coverage, low_reliability); the worst are named."""
    low = reliability.where("low_reliability").select(F.struct(F.coalesce("coverage", F.lit(999.0)).alias("c"), _name("channel", "campaign_type").alias("name")).alias("s"))
    told = low.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("s")).alias("s")).where("n > 0")  # a row for each segment at most
    names = F.array_join(F.slice(F.col("s.name"), 1, MOST_CAMPAIGNS), ", ")
    said = F.concat(F.lit("Past forecasts missed in "), F.col("n").cast("string"), F.lit(" segments, so their ranges are rough: "), names, F.lit("."))
    return _rows(told, 5, [], said, F.concat(F.col("n").cast("string"), F.lit(" segments failed their backtest: "), names, F.lit(".")))


def idle_money(risk: DataFrame) -> DataFrame:
    share = _fixed(F.col("zero_share") * 100, 1)
    said = F.concat(_name("channel"), F.lit(": "), F.col("n_zero").cast("string"), F.lit(" of "), F.col("n_campaigns").cast("string"), F.lit(" campaigns with spend ("), share, F.lit(" %) never earned, for "), _money("wasted_spend"), F.lit("."))
    return _rows(risk, 6, [F.col("zero_share").desc(), F.col("channel")], said, F.concat(F.lit("Trust forecasts of "), _name("channel"), F.lit(" only once its campaigns without revenue are explained.")))


def checks(summary: DataFrame, campaigns: DataFrame) -> DataFrame:
    """summary: (issue, n_issues), as from validate.summary; campaigns: one row, (n_campaigns)."""
    found = summary.where("n_issues > 0").select(F.struct((-F.col("n_issues")).alias("order"), F.concat("issue", F.lit(" "), F.col("n_issues").cast("string")).alias("name")).alias("s"), "n_issues")
    told = found.agg(F.sum("n_issues").alias("n"), F.array_sort(F.collect_list("s")).alias("s")).where("n > 0").crossJoin(F.broadcast(campaigns))  # one row
    return _rows(told, 7, [], F.concat(F.lit("Checks of "), F.col("n_campaigns").cast("string"), F.lit(" campaigns found "), F.col("n").cast("string"), F.lit(" issues: "), F.array_join(F.col("s.name"), ", "), F.lit(". A daily budget is an average, so that single days may pass it.")))


def advice(recommendations: DataFrame) -> DataFrame:
    """recommendations: as from recommend.finalists; the first in full, the next three in short."""
    placed = recommendations.withColumn("at", F.row_number().over(Window.orderBy(F.desc_nulls_last("revenue_delta"), "place")))
    change = _change("delta_pct")
    move = F.concat(_name("donor_channel", "donor_type"), F.lit(" to "), _name("receiver_channel", "receiver_type"))
    first = F.concat(F.lit("Move "), _money("shift_daily"), F.lit(" a day from "), move, F.lit(": revenue of "), F.col("horizon_days").cast("string"), F.lit(" days "), change, F.lit(" ("), _money("base"), F.lit(" to "), _money("moved"), F.lit("), return "), _number("base_roas", 2), F.lit(" to "), _number("moved_roas", 2), F.lit(", confidence "), F.col("confidence"), F.lit("."))
    other = F.concat(F.lit("Or from "), move, F.lit(" ("), change, F.lit(")."))
    return _rows(placed.where(F.col("at") <= 1 + MOST_OTHERS), 8, [F.col("at")], F.when(F.col("at") == 1, first).otherwise(other))


def scenarios(moved: DataFrame) -> DataFrame:
    """moved: (horizon_days, metric, baseline, scenario, change_pct); revenue is told."""
    said = F.concat(F.lit("In the scenario, revenue of "), F.col("horizon_days").cast("string"), F.lit(" days changes by "), _change("change_pct"), F.lit(" ("), _money("baseline"), F.lit(" to "), _money("scenario"), F.lit(")."))
    return _rows(moved.where("metric = 'revenue' and change_pct is not null"), 9, [F.col("horizon_days")], said)


def statements(spark: SparkSession, *parts: DataFrame) -> DataFrame:
    """All parts below each other, or the one statement that there is nothing to say."""
    every = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], STATEMENT))
    none = every.agg(F.count("statement").alias("n")).where("n = 0")
    return every.unionByName(_rows(none, 10, [], F.lit("There is too little history to tell changes or outliers.")))


def gather(facts: DataFrame, **forecasts: DataFrame) -> dict[str, DataFrame]:
    """Every statistic behind a report, by name, in one call.

    Those of the facts are made here, each of which reads facts, so give a written table.
    Those of forecasts come from the caller, as many as there are: slopes (fit.elasticity),
    unreliable (backtest.reliability), advice (recommend.finalists), scenarios (simulate.moved)."""
    unknown = set(forecasts) - set(TELLERS)
    if unknown:
        raise ValueError(f"no part of a report: {', '.join(sorted(unknown))}")
    campaigns = facts.select("channel", "campaign_id").distinct().agg(F.count("*").alias("n_campaigns"))
    own = {"changes": stats.period_deltas(facts), "outliers": stats.roas_anomalies(facts), "idle_money": stats.structural_risk(facts)}
    return own | forecasts | {"checks": validate.summary(facts), "campaigns": campaigns}


TELLERS = {"changes": changes, "slopes": slopes, "outliers": outliers, "unreliable": unreliable, "idle_money": idle_money, "advice": advice, "scenarios": scenarios}


def tell(spark: SparkSession, found: dict[str, DataFrame]) -> DataFrame:
    """The statements of all that was gathered."""
    parts = [TELLERS[name](rows) for name, rows in found.items() if name in TELLERS]
    return statements(spark, *parts, checks(found["checks"], found["campaigns"]))


def report(told: DataFrame, writer: Callable[[list[dict]], tuple[str, list[str]]] | None = None) -> dict:
    """Text, risks and where they come from. A report is a few dozen rows. `writer` makes them of the
    statements, a language model's client for instance; if it fails, the statements stand as they are."""
    rows = [r.asDict() for r in told.orderBy("part", "place").collect()]
    text, risks = " ".join(r["statement"] for r in rows if r["statement"]), [r["risk"] for r in rows if r["risk"]]
    if writer is None:
        return {"text": text, "risk_flags": risks, "source": "template"}
    try:
        text_of, risks_of = writer(rows)
    except Exception as error:  # noqa: BLE001  whatever fails, there is a report
        return {"text": f"{text} [not rewritten: {error}]", "risk_flags": risks, "source": "template_fallback"}
    return {"text": text_of, "risk_flags": risks_of, "source": "llm"}
