"""Campaign tables of three advertising platforms, as one fact table, and sinks."""

from __future__ import annotations

import sys

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.expressions import funnel_stage, type_of_name

FEATURES = "date date, channel string, campaign_id string, campaign_name string, campaign_type string, spend double, revenue double, conversions double, revenue_is_imputed boolean, funnel_stage string"

# The platforms' column names, by what they become.
RAW = {
    "bing": {"date": "TimePeriod", "campaign_id": "CampaignId", "campaign_name": "CampaignName", "campaign_type": "CampaignType", "spend": "Spend", "revenue": "Revenue", "conversions": "Conversions", "clicks": "Clicks", "impressions": "Impressions", "daily_budget": "DailyBudget"},
    "google": {"date": "segments_date", "campaign_id": "campaign_id", "campaign_name": "campaign_name", "campaign_type": "campaign_advertising_channel_type", "spend": "metrics_cost_micros", "revenue": "metrics_conversions_value", "conversions": "metrics_conversions", "clicks": "metrics_clicks", "impressions": "metrics_impressions", "daily_budget": "campaign_budget_amount"},
    "meta": {"date": "date_start", "campaign_id": "campaign_id", "campaign_name": "campaign_name", "spend": "spend", "revenue": "conversion", "clicks": "clicks", "impressions": "impressions", "daily_budget": "daily_budget"},
}
NEEDED = ("date", "campaign_id", "campaign_name", "campaign_type", "spend", "revenue", "conversions")


def find_file(spark: SparkSession, folder: str, needle: str) -> str:
    """The first CSV in the folder, by name, whose name holds `needle` in any case."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted(x.getPath().toString() for x in found)
    hits = [n for n in names if n.lower().endswith(".csv") and needle.lower() in n.rsplit("/", 1)[-1].lower()]
    if not hits:
        raise FileNotFoundError(f"no CSV with {needle!r} in its name in {folder}")
    if len(hits) > 1:
        print(f"several files match {needle!r}; using {hits[0]}", file=sys.stderr)
    return hits[0]


def require(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{source}: columns {missing} are missing; there are {sorted(df.columns)}")
    return df


def normalised(raw: DataFrame, channel: str, extra: tuple[str, ...] = (), kept: tuple[str, ...] = ()) -> DataFrame:
    """The platform's rows in the columns of the fact table; `extra` keeps clicks and the like as
    numbers, `kept` further columns as they are."""
    names = RAW[channel]
    require(raw, [names[c] for c in (*NEEDED, *extra) if c in names], channel)
    number = {c: F.nanvl(F.col(names[c]).cast("double"), F.lit(None)) for c in ("spend", "revenue", "conversions", *extra) if c in names}
    if channel == "google":
        number["spend"] = number["spend"] / 1e6
    name = F.col(names["campaign_name"]).cast("string")
    kind = F.col(names["campaign_type"]).cast("string") if "campaign_type" in names else type_of_name(name)
    return raw.select(
        F.to_date(F.col(names["date"])).alias("date"), F.lit(channel).alias("channel"), F.col(names["campaign_id"]).cast("string").alias("campaign_id"), name.alias("campaign_name"), kind.alias("campaign_type"),
        number["spend"].alias("spend"), number["revenue"].alias("revenue"), number.get("conversions", F.lit(None).cast("double")).alias("conversions"), F.lit(False).alias("revenue_is_imputed"), funnel_stage(name).alias("funnel_stage"), *[number[c].alias(c) for c in extra], *kept,
    )


#: What raw checks need beside the columns of the fact table.
MORE = ("clicks", "impressions", "daily_budget")
BROKEN = "_broken_line"


def checked(raw: DataFrame, channel: str) -> DataFrame:
    """Raw rows of text, with BROKEN, in the columns of the fact table and MORE, and `reject`: a line
    with a field too many or too few, or a number or date that is none. A channel without a column of MORE has nulls there."""
    names = RAW[channel]
    there = tuple(c for c in MORE if names.get(c) in raw.columns)
    numbers = [names[c] for c in ("spend", "revenue", "conversions", *there) if c in names]
    wrong = F.col(BROKEN).isNotNull()
    for c in numbers:
        wrong |= F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()
    wrong |= F.col(names["date"]).isNotNull() & F.try_to_date(F.col(names["date"])).isNull()
    safe = raw.withColumn("reject", wrong).withColumns({c: F.col(c).try_cast("double") for c in numbers}).withColumn(names["date"], F.try_to_date(F.col(names["date"])))
    rows = normalised(safe, channel, there, ("reject",))
    return rows.withColumns({c: F.lit(None).cast("double") for c in MORE if c not in there})


def parsed(lines: DataFrame, channel: str, header: list[str]) -> DataFrame:
    """checked() rows of CSV lines (value) without their header."""
    schema = ", ".join(f"`{c}` string" for c in (*header, BROKEN))
    return checked(lines.select(F.from_csv("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("row")).select("row.*"), channel)


def load_raw(spark: SparkSession, folder: str) -> DataFrame:
    """All three platforms' CSV files of a folder as checked() rows, each read by its own header."""
    found = []
    # a pruned read would not notice that a line has too few fields or too many
    reader = spark.read.options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN, columnPruning=False)
    for channel in RAW:
        path = find_file(spark, folder, channel)
        header = spark.read.csv(path, header=True).columns
        require(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in header)), [v for k, v in RAW[channel].items() if k in NEEDED], channel)
        schema = ", ".join(f"`{c}` string" for c in (*header, BROKEN))
        found.append(checked(reader.schema(schema).csv(path), channel))
    return together(found)


def together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def load(spark: SparkSession, folder: str) -> DataFrame:
    """All three platforms' CSV files of a folder. Ids are read as text."""
    frames = [normalised(spark.read.csv(find_file(spark, folder, c), header=True), c) for c in RAW]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def write_features(features: DataFrame, path: str) -> None:
    features.sort("channel", "campaign_id", "date").write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    features = spark.read.parquet(path)
    if features.isEmpty():
        raise ValueError(f"{path} has no rows")
    return features


def write_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def read_models(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written models table, or an empty one where there is none or its files are no Parquet:
    forecasts then start cold. Footers are read here, so that a broken file is found now."""
    try:
        spark.read.parquet(path)
    except AnalysisException:  # no such path, or no schema to be found
        return spark.createDataFrame([], schema)
    except Py4JJavaError as error:
        if "FAILED_READ_FILE" not in str(error) and "CANNOT_READ_FILE_FOOTER" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_models_json(models: DataFrame, path: str) -> None:
    """A line for each model, with its key as one text."""
    names = ("channel", "campaign_type", "campaign_id")
    key = F.concat_ws("/", *[F.nullif(F.col(c), F.lit("")) for c in names if c in models.columns])
    models.select(key.alias("key"), *[c for c in models.columns if c not in names]).write.mode("overwrite").json(path)


def write_forecast(forecast: DataFrame, path: str) -> None:
    """A forecast is a few hundred rows; one CSV file holds it."""
    forecast.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(spark: SparkSession, path: str, parts: dict[str, DataFrame], values: dict[str, object] | None = None) -> None:
    """One JSON object of named numbers or texts and lists of rows. For reports of a few hundred rows:
    each part becomes one value."""
    whole = spark.range(1).select(*[F.lit(v).alias(k) for k, v in (values or {}).items()])
    for name, rows in parts.items():
        whole = whole.crossJoin(F.broadcast(rows.agg(F.collect_list(F.struct("*")).alias(name))))  # one row
    whole.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
