"""Counts and means for dashboards and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import DONE, IN_REVIEW, STATUSES


def status_dimension(spark, statuses=STATUSES) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, statuses))).alias("place", "status"))


def dimension_zero_fill(counts: DataFrame, statuses=STATUSES) -> DataFrame:
    """status, n for every status, in order of statuses; 0 where counts (status, n) has none."""
    filled = F.broadcast(status_dimension(counts.sparkSession, statuses)).join(counts, "status", "left")
    return filled.select("place", "status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def status_counts(df: DataFrame) -> DataFrame:
    """status, n, total."""
    counts = dimension_zero_fill(df.groupBy("status").agg(F.count("*").alias("n")))
    return counts.select("status", "n", F.sum("n").over(Window.partitionBy()).alias("total"))


def _of(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def _today(now: Column) -> Column:
    day = F.date_trunc("day", now)
    return F.count_if((F.col("updated_at") >= day) & F.col("status").isin(*DONE))


def _seconds() -> Column:
    spent = (F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    return F.round(F.coalesce(F.avg(F.when(F.col("status") != "UPLOADED", spent)), F.lit(0.0)), 2)


def processed_today(df: DataFrame, now: Column) -> DataFrame:
    return df.agg(_today(now).alias("processed_today"))


def avg_processing_seconds(df: DataFrame) -> DataFrame:
    return df.agg(_seconds().alias("avg_processing_seconds"))


def dashboard(df: DataFrame, now: Column) -> DataFrame:
    """All figures of the dashboard in one pass and one row."""
    return df.agg(F.count("*").alias("total"), *(_of(s).alias(s.lower()) for s in STATUSES), _today(now).alias("processed_today"), _seconds().alias("avg_processing_seconds"))


def batch_distribution(df: DataFrame) -> DataFrame:
    """batch_id, status, n, percent (1 decimal); no status counts as UPLOADED."""
    counts = df.groupBy("batch_id", F.coalesce("status", F.lit("UPLOADED")).alias("status")).agg(F.count("*").alias("n"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("batch_id")), 1)
    return counts.withColumn("percent", share).orderBy("batch_id", F.desc("n"), "status")


def batches_of(df: DataFrame) -> DataFrame:
    """batch_id, created_at (its first invoice's), target_count, processed."""
    done = F.count_if(~F.coalesce("status", F.lit("UPLOADED")).isin("UPLOADED", "PROCESSING"))
    return df.groupBy("batch_id").agg(F.min("created_at").alias("created_at"), F.count("*").alias("target_count"), done.alias("processed"))


def latest_batch(batches: DataFrame, chosen: int | None = None, keep: int = 50) -> DataFrame:
    """The chosen batch if it is among the newest `keep`, or else the newest."""
    newest = batches.orderBy(F.desc("created_at"), F.desc("batch_id")).limit(keep)
    wanted = F.coalesce(F.col("batch_id") == F.lit(chosen), F.lit(False))
    return newest.orderBy(wanted.desc(), F.desc("created_at"), F.desc("batch_id")).limit(1)


def batch_history(batches: DataFrame, keep: int = 50) -> DataFrame:
    """The newest batches with their progress, and which of them is the latest."""
    newest = batches.orderBy(F.desc("created_at"), F.desc("batch_id")).limit(keep)
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("batch_id")))  # of `keep` rows
    return newest.withColumn("is_latest", place == 1)


def queue_counts(df: DataFrame) -> DataFrame:
    return df.agg(*(_of(s).alias(s.lower()) for s in IN_REVIEW), F.count_if(F.col("status").isin(*IN_REVIEW)).alias("total"))


def amount_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("currency").agg(F.count("*").alias("n"), F.sum("total_amount").cast("decimal(24,2)").alias("total_amount"))


def daily_counts(df: DataFrame, end: Column, days: int = 7) -> DataFrame:
    """day, n for the days up to end, empty ones too."""
    last = F.to_date(end)
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    # The bounds are on the column itself, so that files can be passed over by them.
    when = F.col("created_at")
    recent = df.filter((when >= F.date_sub(last, days - 1).cast("timestamp_ntz")) & (when < F.date_add(last, 1).cast("timestamp_ntz")))
    counts = recent.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return F.broadcast(spine).join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def append_batch(df: DataFrame, new: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """df (batch_id, place, ...) with the rows of new behind those of their batches, in order of their
    own place. Rows of a batch that is not among batches (batch_id), or in df if there are none, are
    left out, as nothing can be added to a batch that was not started."""
    started = df if batches is None else batches
    known = new.join(started.select("batch_id").distinct(), "batch_id", "left_semi")
    last = df.groupBy("batch_id").agg((F.max("place") + 1).alias("_next"))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("place")) - 1 + F.coalesce("_next", F.lit(0))
    added = known.join(last, "batch_id", "left").withColumn("place", place.cast("long")).drop("_next")
    return df.unionByName(added.select(df.columns))


def clear_batches(df: DataFrame) -> DataFrame:
    """df without any row; what is stored goes when this is."""
    return df.limit(0)


def replace_batch(df: DataFrame, new: DataFrame) -> DataFrame:
    """df with the batches of new replaced as wholes."""
    return df.join(new.select("batch_id").distinct(), "batch_id", "left_anti").unionByName(new)


def dataset_counts(examples: DataFrame, retrain_at: int = 200) -> DataFrame:
    """source, n, retrain: whether so many corrections are waiting."""
    counts = examples.groupBy("source").agg(F.count("*").alias("n"))
    return counts.withColumn("retrain", (F.col("source") == "human_correction") & (F.col("n") >= retrain_at))
