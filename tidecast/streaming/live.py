"""The fact table as a stream: daily sums, sliding run rates, models kept fresh.

A stream has the columns of the fact table; `date` is its event time. Rows later than
`delay` behind the newest date are left out, as the watermark says. Null amounts count
as 0 in sums and not at all in rates; rows without a date or a key are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidecast.functions.expressions import RUN_RATE_DAYS
from tidecast.operators import coldstart
from tidecast.operators.series import SEGMENT
from tidecast.sources.channels import FEATURES
from tidecast.sources.store import Stages

DELAY = "2 days"
MODELS = "channel string, campaign_type string, campaign_id string, method string, slope double, level double"


def read(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Parquet files of the fact table, as they come into a folder."""
    return spark.readStream.schema(FEATURES).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def _timed(stream: DataFrame, keys: tuple[str, ...], delay: str) -> DataFrame:
    known = stream.dropna(subset=[*keys, "date"]).withColumn("at", F.col("date").cast("timestamp"))
    return known.withWatermark("at", delay)


def daily_sums(stream: DataFrame, keys: tuple[str, ...] = SEGMENT, delay: str = DELAY) -> DataFrame:
    """Revenue and spend of each key and day; a day ends once the watermark has passed it."""
    sums = _timed(stream, keys, delay).groupBy(F.window("at", "1 day").alias("day"), *keys)
    total = sums.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("revenue", "spend")])
    return total.select(*keys, F.col("day.start").cast("date").alias("date"), "revenue", "spend")


def sliding_rates(stream: DataFrame, days: int = 28, keys: tuple[str, ...] = SEGMENT, delay: str = DELAY) -> DataFrame:
    """Mean revenue and spend of a row over the `days` that end with `date`, for each such day."""
    rates = _timed(stream, keys, delay).groupBy(F.window("at", f"{days} days", "1 day").alias("span"), *keys)
    mean = rates.agg(F.avg("revenue").alias("revenue"), F.avg("spend").alias("spend"))
    return mean.select(*keys, F.date_sub(F.col("span.end").cast("date"), 1).alias("date"), "revenue", "spend")


def upserts(stream: DataFrame, state: str) -> DataStreamWriter:
    """Each batch is added to the state, and models are refreshed from the state alone.

    A version of the state is a row a key with sums of all time, and a row a key and day of the
    last RUN_RATE_DAYS days. A batch reads its own rows and the version before it, never the rows
    of other batches. Rows of any day count, late ones too: of an old day they only add to the sums of all time. Version n comes
    from version n - 1 or the newest before it, so that a batch that is run again counts once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = _newest(spark, state, number)
        held = {n: spark.read.parquet(f"{state}/version={before}/{n}") if before is not None else None for n in ("totals", "recent")}
        run = Stages(spark, f"{state}/batch={number}")
        fresh = run.keep("sums", coldstart.day_sums(rows))
        totals = run.keep("totals", coldstart.added(held["totals"], fresh, *coldstart.STATE_KEYS))
        days = run.keep("days", coldstart.added(held["recent"], fresh.where("date is not null"), *coldstart.STATE_KEYS, "date"))
        origin = days.agg(F.max("date").alias("origin"))  # one row
        recent = run.keep("recent", days.crossJoin(F.broadcast(origin)).where(F.col("date") > F.date_sub("origin", RUN_RATE_DAYS)).drop("origin"))
        models = coldstart.refreshed(current(spark, state, number), coldstart.levels_of(coldstart.state_sums(totals, recent)))
        at = f"{state}/version={number}"
        for name, df in (("totals", totals), ("recent", recent), ("models", models)):
            df.write.mode("overwrite").parquet(f"{at}/{name}")
        run.release()

    return stream.writeStream.foreachBatch(batch)


def _newest(spark: SparkSession, state: str, before: int | None) -> int | None:
    """The newest version whose last table is finished (of those before a number)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/version=*/models/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    versions = [int(x.getPath().getParent().getParent().getName().split("=")[1]) for x in found]
    return max((v for v in versions if before is None or v < before), default=None)


def current(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """The models of the newest finished version (of those before a number), or none."""
    version = _newest(spark, state, before)
    return spark.createDataFrame([], MODELS) if version is None else spark.read.schema(MODELS).parquet(f"{state}/version={version}/models")


def view(stream: DataFrame, name: str | None = None) -> str:
    """All of a finite stream's windows as a table in memory; its name. For tests and small looks."""
    name = name or f"live_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return name
