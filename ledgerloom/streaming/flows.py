"""Ingest, status changes, retries, posting, audit and figures as streams.

Functions take a streaming DataFrame and a checkpoint path and start a query; each takes the trigger
that runs through what is there (availableNow) unless another is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.workflow import content_key, ingest_gate
from ..schemas import POSTABLE
from ..storage import Store, stored
from . import machine

NOW = {"availableNow": True}


def _to_table(df: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def ingested(uploads: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Accepted uploads (filename, size_bytes, content), each content once.

    Content is remembered for all time, since a duplicate may come at any time; with a watermark
    (column, delay) it is remembered for that long, and state stays bounded.
    """
    keyed = content_key(ingest_gate(uploads).filter("reject_reason IS NULL"))
    if watermark:
        return keyed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["file_hash"])
    return keyed.dropDuplicates(["file_hash"])


def stream_ingest(uploads: DataFrame, path: str, checkpoint: str, watermark=None, trigger=NOW) -> StreamingQuery:
    return _to_table(ingested(uploads, watermark), path, checkpoint, trigger)


def stream_status_machine(requests: DataFrame, path: str, checkpoint: str, trigger=NOW) -> StreamingQuery:
    """Status changes of requests (id, seq, target, and `at`, when it was made, or else now).

    Each micro-batch is one commit of a store at path: its table `changes` has what each request led
    to (see machine.changes) and `statuses` the present status and posted_at of each id. Statuses are
    kept by bucket, of which a micro-batch reads and writes those of its ids. Both are replaced at
    once, and a micro-batch that comes again changes nothing.
    """

    def fold(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path, key="id")
        asked = batch.withColumn("at", F.current_timestamp()) if "at" not in batch.columns else batch
        asked = asked.select("id", "seq", "target", "at").filter("id IS NOT NULL")
        if str(number) in store.manifest()["batches"]:
            return
        known = store.manifest()["tables"]
        before = store.read("statuses", buckets=store.touched(asked)) if known else machine.no_statuses(batch.sparkSession)
        made = stored(machine.changes(asked, before))
        store.commit(str(number), {"statuses": machine.statuses(made, before)}, asked, {"changes": made})

    return requests.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def routed(failures: DataFrame, max_retries: int = 3) -> DataFrame:
    """failures (id, attempt, ...) with route: retry after delay_s, or dead_letter beyond max_retries."""
    over = F.col("attempt") > max_retries
    return failures.withColumns({"route": F.when(over, "dead_letter").otherwise("retry"), "delay_s": F.when(~over, F.least(F.lit(60.0), F.pow(F.lit(2.0), F.col("attempt"))))})


def stream_retry_dlq(failures: DataFrame, path: str, checkpoint: str, max_retries: int = 3, trigger=NOW) -> StreamingQuery:
    """Both routes in one table, partitioned by route."""
    writer = routed(failures, max_retries).writeStream.format("parquet").partitionBy("route")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_auto_post(approved: DataFrame, path: str, checkpoint: str, trigger=NOW) -> StreamingQuery:
    """Post approved invoices (invoice_id, status, and `at`, when it was approved, or else now) once.

    AUTO_APPROVED and APPROVED ones are posted, others are not. Each micro-batch is a commit to the
    store at path, whose table `posted` has invoice_id, approved_as, status (POSTED) and posted_at; of
    several approvals in a micro-batch the earliest counts. Posted ids are kept by bucket: a
    micro-batch reads the buckets of its own ids, and adds to them. One that comes again adds nothing.
    """

    def post(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path)
        at = F.col("at") if "at" in batch.columns else F.current_timestamp()
        first = F.min(F.struct(at.alias("at"), F.col("status").alias("status"))).alias("first")
        ready = batch.filter(F.col("status").isin(*POSTABLE)).groupBy("invoice_id").agg(first)
        new = ready.select("invoice_id", F.col("first.status").alias("approved_as"), F.lit("POSTED").alias("status"), F.col("first.at").alias("posted_at"))
        if store.manifest()["tables"]:
            posted = store.read("posted", buckets=store.touched(new)).select("invoice_id")
            new = new.join(posted, "invoice_id", "left_anti")
        store.commit(str(number), {}, new, {"posted": new})

    return approved.writeStream.foreachBatch(post).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_audit(logs: DataFrame, path: str, checkpoint: str, trigger=NOW) -> StreamingQuery:
    return _to_table(logs, path, checkpoint, trigger)


def stream_dashboard(changes: DataFrame, path: str, checkpoint: str, column: str = "status", trigger=NOW) -> StreamingQuery:
    """Keep a small table of counts by status up to date. Each micro-batch writes a version of its own,
    again if it is replayed, so readers never meet a half-written one; latest_dashboard reads the last."""
    counts = changes.groupBy(column).count()

    def publish(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={number}")

    return counts.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest_dashboard(spark: SparkSession, path: str) -> DataFrame:
    """status, count of the last version; earlier ones may be removed at any time."""
    versions = spark.read.parquet(path)
    last = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == last).drop("version")


def stream_feedback(corrections: DataFrame, words: DataFrame, path: str, checkpoint: str, trigger=NOW) -> StreamingQuery:
    """Add the labelled words of each correction (doc_id, field, value) to the training set, in a
    partition for each micro-batch: one that is replayed after a failure replaces what it wrote."""
    from ..sources.annotations import append_feedback

    def add(batch: DataFrame, number: int) -> None:
        mine = words.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        append_feedback(mine, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return corrections.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()
