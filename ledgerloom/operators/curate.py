"""Choosing and mixing training examples. Draws are by a hash of the id, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import uncertainty
from ..storage import new_path


def draw(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def top_k_uncertain(df: DataFrame, k: int, strategy: str = "entropy") -> DataFrame:
    """doc_id, score: the k most unsure rows of (doc_id, confidences), by id on ties."""
    scored = df.select("doc_id", uncertainty(F.col("confidences"), strategy).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(max(0, k))


def _last_of(rows: DataFrame, k: int) -> tuple:
    """The k-th of rows (hash, key) in order, k from 1, without one task seeing all rows or k of them:
    rows are dealt by range and stored, and only the counts of the ranges come to the driver."""
    spark = rows.sparkSession
    path = new_path(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, *rows.columns).withColumn("range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    for part, count in sorted(tuple(r) for r in ranged.groupBy("range").count().collect()):
        if k <= count:
            place = F.row_number().over(Window.partitionBy("range").orderBy(*rows.columns))
            return tuple(ranged.filter(F.col("range") == part).withColumn("place", place).filter(F.col("place") == k).select(*rows.columns).first())
        k -= count
    raise ValueError("fewer rows than k")


def _is_drawn(df: DataFrame, k: int, seed: int, key: str) -> Column:
    """Whether a row is one of the first k, 1 at least, by the hash of its key."""
    hashed = F.coalesce(draw(F.col(key), seed), F.lit(""))
    last, last_key = _last_of(df.select(hashed.alias("hash"), F.col(key).alias("key")), k)
    before = F.lit(last_key is None) | F.coalesce(F.col(key) <= F.lit(last_key), F.lit(True))
    return (hashed < last) | ((hashed == last) & before)


def sample_pool(df: DataFrame, k: int, seed: int, key: str = "doc_id") -> DataFrame:
    """k rows, or all if there are fewer, without replacement. Rows that repeat the last key drawn are
    all taken."""
    if k <= 0:
        return df.limit(0)
    return df.filter(_is_drawn(df, k, seed, key)) if df.count() > k else df


def train_eval_split(df: DataFrame, ratio: float = 0.1, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """df with split: exactly max(1, n * ratio) rows are 'eval', none if there is one row or none.

    Rows that repeat the last key drawn are all 'eval'.
    """
    n = df.count()
    if n <= 1:
        return df.withColumn("split", F.lit("train"))
    held = _is_drawn(df, max(1, int(n * ratio)), seed, key)
    return df.withColumn("split", F.when(held, "eval").otherwise("train"))


def finetune_mix(new: DataFrame, pool: DataFrame, k: int, seed: int) -> DataFrame:
    """All new examples and k of the pool, with prefixed image names. Both: doc_id, image."""
    named = lambda df, prefix: df.select("doc_id", F.concat(F.lit(prefix), F.col("image")).alias("image"))
    return named(new, "new_").unionByName(named(sample_pool(pool, k, seed), "pool_"))
