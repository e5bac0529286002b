"""When to train again: a count of corrections since the last training, kept over restarts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import Store, stored
from .machine import in_blocks

THRESHOLD = 200
COUNTER = "corrections"


def _summed(batches):
    """(_block, before, after, trained) of rows that come sorted by block and seq: corrections before
    the block's first training (all, if there is none), after its last, and whether there is one."""
    block, before, after, trained = None, 0, 0, False
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_())

    def out(rows):
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["_block", "before", "after", "trained"])

    for batch in batches:
        done = []
        for b, kind in zip(batch.column("_block").to_pylist(), batch.column("kind").to_pylist(), strict=True):
            if b != block:
                if block is not None:
                    done.append((block, before, after, trained))
                block, before, after, trained = b, 0, 0, False
            if kind == "training":
                after, trained = 0, True
            elif trained:
                after += 1
            else:
                before += 1
        yield out(done)
    if block is not None:
        yield out([(block, before, after, trained)])


def flags(events: DataFrame, pending: int, threshold: int = THRESHOLD, blocks: int | None = None) -> tuple[DataFrame, int]:
    """(rows, pending): the events (seq, kind, at) at which the count reaches the threshold, as seq and
    at, and the count after all of them. kind is correction or training.

    The count starts with `pending`; at the threshold and at a training it starts anew. Events go by
    seq, then kind, nulls first; other kinds are ignored. They are cut into blocks of seq, whose
    figures (three numbers each) come to the driver; each block then counts from its own beginning.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = events.filter(F.col("kind").isin("correction", "training")).select(F.col("seq").cast("long").alias("seq"), "kind", F.col("at").cast("timestamp").alias("at"))
    dealt = in_blocks(known, blocks).repartition(n, "_block").sortWithinPartitions("_block", "seq", "kind")
    sums = dealt.select("_block", "kind").mapInArrow(_summed, "_block int, before long, after long, trained boolean")
    begins = {}
    for block, before, after, trained in sorted(tuple(r) for r in sums.collect()):
        begins[block] = pending
        pending = (after if trained else pending + before) % threshold

    def counted(batches):
        block, count = None, 0
        for batch in batches:
            hit = []
            for b, kind in zip(batch.column("_block").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                if b != block:
                    block, count = b, begins[b]
                count = 0 if kind == "training" else count + 1
                hit.append(count == threshold)
                count %= threshold
            found = batch.filter(pa.array(hit, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column("seq"), found.column("at")], names=["seq", "at"])

    return dealt.select("_block", "kind", "seq", "at").mapInArrow(counted, "seq long, at timestamp"), pending


def stream_retrain(events: DataFrame, path: str, checkpoint: str, threshold: int = THRESHOLD, trigger: dict | None = None) -> StreamingQuery:
    """Flags of events (seq, kind, at), which come in order of seq from micro-batch to micro-batch.

    Each micro-batch is one commit of the store at path: its table `flags` gets the events at which
    training is due, `pending` has the count since. One that comes again changes nothing.
    """

    def count(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path, 1, "counter")
        if str(number) in store.manifest()["batches"]:
            return
        held = store.read("pending").first() if store.manifest()["tables"] else None
        rows, pending = flags(batch, held["pending"] if held else 0, threshold)
        made = stored(rows).withColumn("counter", F.lit(COUNTER))
        state = batch.sparkSession.createDataFrame([(COUNTER, pending)], "counter string, pending long")
        store.commit(str(number), {"pending": state}, state, {"flags": made})

    return events.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
