"""Stored tables that are searched without being read whole: by place in a sorted list, and by text."""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .storage import Folder, new_path

_RANGE, _CHUNK = "_range", "_chunk"


def _write_rows(dealt: DataFrame, path: str, column: str) -> DataFrame:
    """Rows in a folder for each value of a column, with their schema, which no file has if there are none."""
    dealt.write.partitionBy(column).parquet(f"{path}/rows")
    Folder(dealt.sparkSession, path).publish("schema.json", dealt.schema.json())
    return _read_rows(dealt.sparkSession, path)


def _read_rows(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(Folder(spark, path).read("schema.json")))
    return spark.read.schema(schema).parquet(f"{path}/rows")


class SortedIndex:
    """Rows in ranges of a sort order, and how many each range has.

    A page is read from the range or ranges that hold it, so that a late page costs what the first
    does. Only the counts, a number for each range, come to the driver.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[Column]):
        self.rows = _read_rows(spark, path)
        self.order = order
        counts = {r[_RANGE]: r["n"] for r in spark.read.parquet(f"{path}/counts").collect()}
        self._ranges = sorted(counts)
        self._ends = list(accumulate(counts[k] for k in self._ranges))

    @classmethod
    def build(cls, df: DataFrame, path: str, order: list[Column], ranges: int | None = None) -> SortedIndex:
        """Sort df into so many ranges (spark.sql.shuffle.partitions by default), below path. The
        order has to be total, as one that ends in a key is."""
        spark = df.sparkSession
        n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(n, *order).withColumn(_RANGE, F.spark_partition_id())
        # Counted from the stored rows: ranges are cut anew at each run.
        rows = _write_rows(dealt.sortWithinPartitions(*order), path, _RANGE)
        rows.groupBy(_RANGE).agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/counts")
        return cls(spark, path, order)

    def count(self) -> int:
        return self._ends[-1] if self._ends else 0

    def ranges_of(self, first: int, size: int) -> tuple[list[int], int]:
        """The ranges that hold `size` rows from place `first` (from 0) on, and the place in the first of them."""
        begins = [0, *self._ends[:-1]]
        held = [k for k, (b, e) in enumerate(zip(begins, self._ends, strict=False)) if b < first + size and e > first]
        return [self._ranges[k] for k in held], first - begins[held[0]] if held else 0

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        """A page of the list, by number from 1; none beyond the last."""
        ranges, skip = self.ranges_of(max(0, (number - 1) * size), size)
        mine = self.rows.filter(F.col(_RANGE).isin(ranges)) if ranges else self.rows.limit(0)
        return mine.orderBy(*self.order).offset(skip).limit(size).drop(_RANGE)


def _trigrams(text: Column) -> Column:
    places = F.when(F.char_length(text) >= 3, F.sequence(F.lit(1), F.char_length(text) - 2))
    return F.array_distinct(F.transform(places, lambda k: F.substr(text, k, F.lit(3))))


def literals(pattern: str) -> list[str]:
    """The parts of a LIKE pattern between its wildcards, lower-cased."""
    parts, part, at = [], "", 0
    while at < len(pattern):
        if pattern[at] in "%_":
            parts.append(part)
            part = ""
        else:
            at += pattern[at] == "\\" and at + 1 < len(pattern)
            part += pattern[at]
        at += 1
    return [p.lower() for p in (*parts, part) if p]


class TextIndex:
    """Rows in chunks, and for each three-character run of a text the chunks that have it.

    A search looks up the runs of its pattern's literal parts, reads only the chunks that have all
    of them, and tests the pattern there, so its rows are those of `ilike`. The postings are cut into
    buckets by their run: a lookup reads the buckets of its runs. Numbers of chunks come to the driver.
    """

    BUCKETS = 32

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = _read_rows(spark, path)
        self.chunks = sorted(r[0] for r in spark.read.parquet(f"{path}/chunks").collect())

    @classmethod
    def _bucket(cls, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(cls.BUCKETS)).cast("int")

    @classmethod
    def build(cls, df: DataFrame, path: str, columns: tuple[str, ...], chunks: int, near: list[Column]) -> TextIndex:
        """Store df below path in so many chunks of rows that are neighbours by `near`, and index the
        text columns. Chunks are files of their own; the fewer of them have a run, the less is read."""
        spark = df.sparkSession
        dealt = df.repartitionByRange(chunks, *near).withColumn(_CHUNK, F.spark_partition_id())
        rows = _write_rows(dealt, path, _CHUNK)
        rows.select(_CHUNK).distinct().coalesce(1).write.parquet(f"{path}/chunks")
        grams = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lower(F.col(c)).alias("text")) for c in columns))).alias("v")
        found = rows.select(_CHUNK, grams).select(_CHUNK, "v.column", F.explode(_trigrams(F.col("v.text"))).alias("gram")).distinct()
        found = found.withColumn("_bucket", cls._bucket(F.col("gram"))).repartition("_bucket")
        found.write.partitionBy("_bucket").parquet(f"{path}/postings")
        return cls(spark, path)

    def holders(self, column: str, text: str) -> list[int]:
        """The chunks that may have `text` in a column: those with all runs of its literal parts."""
        grams = sorted({p[k : k + 3] for p in literals(text) for k in range(len(p) - 2)})
        if not grams:
            return self.chunks
        wanted = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        buckets = [r[0] for r in wanted.select(self._bucket(F.col("gram"))).distinct().collect()]
        postings = self.spark.read.schema(f"{_CHUNK} int, column string, gram string, _bucket int").parquet(f"{self.path}/postings").filter(F.col("_bucket").isin(buckets))
        hits = postings.filter((F.col("column") == column) & F.col("gram").isin(grams))
        full = hits.groupBy(_CHUNK).count().filter(F.col("count") == len(grams))
        return sorted(r[0] for r in full.select(_CHUNK).collect())

    def contains(self, columns: tuple[str, ...], text: str) -> tuple[DataFrame, float]:
        """The rows of which a column contains `text` (% and _ are wildcards, case does not count),
        and the share of chunks that are read for them."""
        chunks = sorted({k for c in columns for k in self.holders(c, text)})
        mine = self.rows.filter(F.col(_CHUNK).isin(chunks)) if chunks else self.rows.limit(0)
        tests = [F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in columns]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        return mine.filter(hit).drop(_CHUNK), len(chunks) / len(self.chunks) if self.chunks else 0.0


def numbered_chunks(df: DataFrame, key: str, order: list[Column], size: int, ranges: int | None = None) -> DataFrame:
    """df with part (from 0): rows of a key by `order`, `size` to a part.

    Rows are dealt by ranges of key and order, stored, and counted by range; the place of a row is
    its place in its range and what other ranges have of its key before. So a key with a large share
    of all rows is in as many tasks as it has ranges. order has to be total within a key.
    """
    spark = df.sparkSession
    n, path = ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark)
    by = [F.col(key).asc_nulls_first(), *order]
    df.repartitionByRange(n, *by).withColumn(_RANGE, F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy(F.col(key).alias("_key"), F.col(_RANGE).alias("_at")).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    # Of a key there are at most as many counts as ranges; only keys in several ranges have any before.
    before = counts.select("_key", "_at", F.coalesce(earlier, F.lit(0)).alias("_before")).filter("_before > 0")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(_RANGE) == F.col("_at"))
    place = F.row_number().over(Window.partitionBy(_RANGE, key).orderBy(*order)) - 1
    placed = rows.withColumn("_place", place).join(before, same, "left")
    part = F.floor((F.col("_place") + F.coalesce("_before", F.lit(0))) / size).cast("int")
    return placed.withColumn("part", part).select(*df.columns, "part")
