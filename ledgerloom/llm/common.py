"""What the operators of this package share: tables, the shared folder, words, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Keys with more rows than one in so many are hot, if they have so many rows at all.
HOT_KEYS, LEAST_HOT = 10_000, 1000
#: Lookups of narrow rows are broadcast up to this many.
BROADCAST_ROWS = 200_000
#: Rows that go to Python at once where whole texts do, one stage after the other in one session.
BATCH_ROWS = 1000
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Have Arrow batches of BATCH_ROWS rows at most from here on. A batch is held by the executor's JVM
    and by Python at once, outside of the heap, in each of its tasks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share, which spark.checkpoint.dir names.

    A session on one machine that has no such setting, as in tests, gets a folder of its own; on a
    cluster that would be a folder which others do not see, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_and(df: DataFrame, *figures: Column) -> tuple[DataFrame, tuple]:
    """stored(df), and aggregates of it that are taken while it is written."""
    seen = Observation()
    table = stored(df.observe(seen, *(f.alias(f"_{k}") for k, f in enumerate(figures))))
    return table, tuple(seen.get.get(f"_{k}") for k in range(len(figures)))


def join_spread(rows: DataFrame, lookup: DataFrame, keys: list[str], matches: str, total: int) -> DataFrame:
    """rows inner-joined with lookup, in which keys are unique and `matches` says how many of the
    `total` rows have them; that column is dropped.

    Entries that a large share of rows match are broadcast, so that their rows stay where they are
    instead of meeting in one task. There are less than HOT_KEYS of these, however long the table.
    Of up to BROADCAST_ROWS rows, which have no more entries than that, all entries are.
    """
    if total <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lookup.drop(matches)), keys)
    least = max(LEAST_HOT, total // HOT_KEYS + 1)
    hot = F.broadcast(lookup.filter(F.col(matches) >= least).drop(matches))
    cold = lookup.filter(F.col(matches) < least).drop(matches)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unit_hash(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key alone (52 bits of SHA-256)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def global_rank(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in a total order, without one task seeing all rows.

    Rows are dealt by range and stored with their range's number; only the row counts of the
    ranges, one number for each, come to the driver.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    offsets, total = [], 0
    for k in range(max(counts, default=0) + 1):
        offsets.append(total)
        total += counts.get(k, 0)
    before = F.element_at(F.array(*map(F.lit, offsets)), F.col("_range") + 1)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn(name, (place + before).cast("long")).drop("_range")
