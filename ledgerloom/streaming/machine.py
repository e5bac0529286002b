"""The status machine as a composition of maps.

A request is a map of the statuses to themselves: those that may go over to its target do, others
stay. Maps compose associatively, so the requests of one id need not be taken one after the other:
they are cut into blocks of seq, each block is folded to one map, a scan over an id's blocks gives
the status that each begins with, and then all blocks give out their rows. An id that has a third of
all requests is spread over a third of the tasks.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import STATUSES, TRANSITIONS

FIRST = "UPLOADED"
_AT = {s: k for k, s in enumerate(STATUSES)}
_SAME = "".join(str(k) for k in range(len(STATUSES)))
#: For each target, the digit that each status goes over to.
_STEP = {t: "".join(str(_AT[t] if t in TRANSITIONS[s] else k) for s, k in _AT.items()) for t in STATUSES}
_CHANGES = "id long, seq long, current string, target string, accepted boolean, posted_at timestamp"


def no_statuses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long, status string, posted_at timestamp")


def in_blocks(requests: DataFrame, blocks: int | None = None) -> DataFrame:
    """requests with _block: seq cut at its quantiles, so that no block has many more rows than
    another. As many numbers as there are blocks come to the driver."""
    n = blocks or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = requests.approxQuantile("seq", [k / n for k in range(1, n)], 0.2 / n)
    below = F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c <= F.col("seq")) if cuts else F.array()
    return requests.withColumn("_block", F.when(F.col("seq").isNull(), 0).otherwise(F.size(below)))


def _folded(batches):
    """(id, _block, map) of rows that come sorted by id and block, each map after all of its rows."""
    key, now = None, ""
    for batch in batches:
        done = []
        columns = (batch.column(c).to_pylist() for c in ("id", "_block", "target"))
        for i, block, target in zip(*columns, strict=True):
            if (i, block) != key:
                if key is not None:
                    done.append((*key, now))
                key, now = (i, block), _SAME
            step = _STEP.get(target, _SAME)
            now = "".join([step[int(d)] for d in now])
        yield _maps(done)
    if key is not None:
        yield _maps([(*key, now)])


def _maps(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["id", "_block", "map"])


def _replayed(batches):
    """Rows of changes, of requests that come sorted by id, block and seq with the status that their
    block begins with."""
    key, now = None, ""
    for batch in batches:
        current, accepted = [], []
        columns = (batch.column(c).to_pylist() for c in ("id", "_block", "_start", "target"))
        for i, block, start, target in zip(*columns, strict=True):
            if (i, block) != key:
                key, now = (i, block), start
            current.append(now)
            accepted.append(target in TRANSITIONS[now])
            now = target if accepted[-1] else now
        own = pa.array(accepted, pa.bool_())
        posted = pa.array([ok and t == "POSTED" for ok, t in zip(accepted, batch.column("target").to_pylist(), strict=True)])
        at = pc.if_else(posted, batch.column("at"), pa.scalar(None, batch.column("at").type))
        columns = [batch.column("id"), batch.column("seq"), pa.array(current, pa.string()), batch.column("target"), own, at]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "seq", "current", "target", "accepted", "posted_at"])


def changes(requests: DataFrame, statuses: DataFrame, blocks: int | None = None) -> DataFrame:
    """id, seq, current, target, accepted, posted_at of requests (id, seq, target, at).

    Requests of an id are taken by seq, then target, nulls first; ids without a row in statuses (id,
    status, posted_at) start as UPLOADED. A request that is not allowed, or whose target is no status
    or null, leaves the status alone. posted_at is the request's time where it is accepted and posts.
    """
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = requests.select(F.col("id").cast("long").alias("id"), F.col("seq").cast("long").alias("seq"), "target", F.col("at").cast("timestamp").alias("at"))
    dealt = in_blocks(asked, blocks).repartition(n, "id", "_block")
    order = ("id", "_block", "seq", "target")
    maps = dealt.sortWithinPartitions(*order).select("id", "_block", "target").mapInArrow(_folded, "id long, _block int, map string")
    earlier = F.collect_list("map").over(Window.partitionBy("id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    digit = F.element_at(F.create_map(*(F.lit(x) for s, k in _AT.items() for x in (s, str(k)))), F.coalesce("status", F.lit(FIRST)))
    begun = maps.select("id", "_block", earlier.alias("_maps")).join(statuses.select("id", "status"), "id", "left")
    reached = F.aggregate("_maps", digit, lambda at, m: F.substr(m, at.cast("int") + 1, F.lit(1)))
    starts = begun.select("id", "_block", F.element_at(F.array(*map(F.lit, STATUSES)), reached.cast("int") + 1).alias("_start"))
    ready = dealt.join(starts, ["id", "_block"]).sortWithinPartitions(*order)
    return ready.select("id", "_block", "_start", "seq", "target", "at").mapInArrow(_replayed, _CHANGES)


def statuses(made: DataFrame, before: DataFrame) -> DataFrame:
    """id, status, posted_at of the ids in changes: by the last request of each, or as before."""
    after = F.when(F.col("accepted"), F.col("target")).otherwise(F.col("current"))
    last = made.groupBy("id").agg(F.max_by(after, F.struct("seq", "target")).alias("status"), F.max("posted_at").alias("_posted"))
    kept = before.select("id", F.col("posted_at").alias("_before"))
    return last.join(kept, "id", "left").select("id", "status", F.coalesce("_posted", "_before").alias("posted_at"))
