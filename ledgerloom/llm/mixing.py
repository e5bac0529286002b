"""Mixing sources to target weights.

Tokens are summed per source, each source gets a share of the total by weight, and every document
is emitted floor(rate) times, plus one more copy with probability equal to the rate's fraction,
drawn from a hash of its id. Nothing but one row of sums per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = "mix-1"
#: A source's words are repeated at most so many times.
MAX_RATE = 3


def cycling_weights(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... by a source's place in code point order."""
    return rank % 3 + 1


def source_targets(sizes: DataFrame, weight=cycling_weights, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Every source is given total * weight / sum of weights. A target that exceeds max_rate times its
    source's size stops there, and the excess goes to the others by weight, until none exceeds it.
    Sources are in code point order, null last. If nothing has a size, all targets are 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = common.global_rank(totals, [F.col("source").asc_nulls_last()], "_rank")
    weighed = common.stored(ranked.withColumn("_weight", weight(F.col("_rank")).cast("long")))
    total, cap = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], F.col("source_size") * max_rate
    level = 0.0
    while True:
        # A source that stops at one level stops at every higher one, so levels only rise.
        free = F.col("_weight") * F.lit(level) <= cap
        sums = weighed.agg(
            F.coalesce(F.sum(F.when(free, F.col("_weight"))), F.lit(0)).alias("weight"),
            F.coalesce(F.sum(F.when(~free, cap)), F.lit(0)).alias("stopped"),
        ).first()
        higher = (total - sums["stopped"]) / sums["weight"] if sums["weight"] else level
        if higher <= level:
            break
        level = higher
    target = F.least(F.col("_weight") * F.lit(level), cap.cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, weight=cycling_weights, max_rate: int = MAX_RATE, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each document.

    docs needs `key`, source and text; a column named like an added one is replaced. Null text has
    size 0; a document of a source without words is never taken. Rows that repeat a key share their
    draw. An empty table gives an empty result.
    """
    added = ("size", "source_size", "target", "copies")
    docs = docs.drop(*added)
    sizes = common.stored(docs.select(key, "source", common.n_words(F.col("text")).alias("size")))
    targets = source_targets(sizes, weight, max_rate)
    return _rated(docs.withColumn("size", common.n_words(F.col("text"))), targets, seed, key)


def _rated(sized: DataFrame, targets: DataFrame, seed: str, key: str) -> DataFrame:
    own = targets.select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = common.unit_hash(seed, F.col(key)) < rate - F.floor(rate)
    copies = F.floor(rate).cast("int") + drawn.cast("int")
    return sized.join(own, sized["source"].eqNullSafe(own["_source"])).withColumn("copies", copies).drop("_source")


def taken_sizes(docs: DataFrame, weight=cycling_weights, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The same without texts: doc_id, size, source_size, target, taken. Texts are read once."""
    sizes = common.stored(docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size")))
    rated = _rated(sizes, source_targets(sizes, weight, max_rate), seed, "doc_id")
    return rated.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weight=cycling_weights, max_rate: int = MAX_RATE, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with docs' own columns."""
    rated = with_copies(docs, weight, max_rate, seed, key).filter("copies > 0")
    repeated = rated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*docs.columns)


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return taken_sizes(common.table(spark, sf_dir, "documents"))


OP8_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{common.WORD}')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM sized GROUP BY source),
-- Sources stop in order of 3 * size / weight; k of them have stopped at the first level at which the next one does not.
stops AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) - 1 AS k,
    (SELECT sum(source_size) FROM sources) AS total,
    coalesce(sum(3 * source_size) OVER w, 0) AS stopped,
    (SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER w, 0) AS free_weight
  FROM sources
  WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT min_by(CAST(CAST(total - stopped AS BIGINT) AS DOUBLE) / CAST(CAST(free_weight AS BIGINT) AS DOUBLE), k) AS level
  FROM stops
  WHERE weight * (CAST(CAST(total - stopped AS BIGINT) AS DOUBLE) / CAST(CAST(free_weight AS BIGINT) AS DOUBLE)) <= 3 * source_size),
targets AS (
  SELECT source, source_size,
    least(CAST(weight AS DOUBLE) * coalesce((SELECT level FROM level), 0.0), CAST(3 * source_size AS DOUBLE)) AS target FROM sources),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
