"""Models of one's own, and the whole pipeline over a batch of documents."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions.scalars import mean_confidence
from ..schemas import DEFAULTS, Thresholds
from ..storage import key_buckets, stored_by_key
from . import decide as D
from .parse import parse_lines
from .workflow import with_reference_data


def safe_apply(agent: str, call: Callable) -> Callable[[str], tuple]:
    """call with a uniform result: success, output, agent, duration_ms, error; nothing is raised."""

    def run(value: str) -> tuple:
        began = time.perf_counter()
        try:
            output, error = call(value), None
        except Exception as e:
            output, error = None, f"{type(e).__name__}: {e}"[:2000]
        return error is None, output, agent, int((time.perf_counter() - began) * 1000), error

    return run


RESULT = "success boolean, output {}, agent string, duration_ms int, error string"


def apply_extractor(docs: DataFrame, agent: str, factory: Callable[[], Callable], column: str = "text", key: str = "doc_id", output: str = "string") -> DataFrame:
    """key, success, output, agent, duration_ms and error for every document.

    factory() loads a model once in each task. output is the type of what it returns for a text: a
    string, or a type of the caller's, such as struct<total:double,lines:array<string>> for a model
    that returns dicts. A value that is none of that type is an error of its document.
    """
    kind = docs.schema[key].dataType.simpleString()
    held = to_arrow_type(DataType.fromDDL(output))

    def typed(model):
        def call(value):
            found = model(value)
            pa.array([found], held)  # raises if it is of another type
            return found

        return call

    def run(frames):
        call = safe_apply(agent, typed(factory()))
        for frame in frames:
            rows = [(k, *call(v)) for k, v in zip(frame["k"], frame["v"], strict=True)]
            yield pd.DataFrame(rows, columns=["k", "success", "output", "agent", "duration_ms", "error"])

    return docs.select(F.col(key).alias("k"), F.col(column).alias("v")).mapInPandas(run, f"k {kind}, {RESULT.format(output)}").withColumnRenamed("k", key)


#: Fields that recognized lines give a confidence for, all the same one.
LINE_FIELDS = ("vendor_name", "invoice_number", "total_amount", "subtotal", "tax_amount")


def challenger_of(lines: DataFrame) -> DataFrame:
    """The challenger's extractions: fields parsed from recognized lines (doc_id, line, text,
    confidence), with a confidence for each of LINE_FIELDS and the raw result (JSON)."""
    parsed = parse_lines(lines).withColumnRenamed("doc_id", D.KEY)
    scores = F.create_map(*(x for n in LINE_FIELDS for x in (F.lit(n), F.col("confidence"))))
    raw = F.to_json(F.struct(F.lit("lines").alias("engine"), "line_count"))
    return parsed.withColumns({"confidence_scores": scores, "raw": raw}).drop("confidence", "line_count")


def run_pipeline_batch(
    uploads: DataFrame,
    champ: DataFrame,
    lines: DataFrame,
    items: DataFrame,
    vendors: DataFrame,
    orders: DataFrame,
    cfg: Thresholds = DEFAULTS,
    durations: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(invoices, items, logs) of a batch of uploads (invoice_id): a champ's extractions and items
    against fields parsed from recognized lines.

    invoices have the merged fields, confidence (4 decimals), status, the report as JSON and what is
    known of the vendor; an upload that neither engine read is FAILED. items are those of invoices
    that were read. logs have a row per upload and stage that ran, with agent, level, message, extra
    (the report) and duration_ms: after both engines failed nothing else runs, and what is not known
    of a vendor is a warning. durations (invoice_id, agent, duration_ms), which models give, are put
    beside their agent's row; other stages run for all uploads at once and have none.

    Engines are paired and compared once, in one frame that is stored by invoice, and looked up in short
    rows, stored likewise; invoices and logs are cut from both without a shuffle. What is made of a
    comparison is neither shuffled nor stored, and reports become JSON where they are read.
    """
    ids = uploads.select(D.KEY).distinct()
    parsed = challenger_of(lines)
    challenger = parsed.withColumn("conf_lines", mean_confidence(F.col("confidence_scores"))).drop("confidence_scores")
    pairs = D.with_sums(D.pair_uploads(ids, champ, challenger), items)
    took = F.lit(None).cast("array<struct<agent:string,ms:int>>").alias("_took")
    if durations is None:
        pairs = pairs.select("*", took)
    else:
        one = F.struct("agent", F.col("duration_ms").cast("int").alias("ms"))
        pairs = pairs.join(durations.groupBy(D.KEY).agg(F.collect_list(one).alias("_took")), D.KEY, "left")
    frame = stored_by_key(D.compared(pairs, cfg).withColumn("_row", F.monotonically_increasing_id()))
    # What is looked up takes short rows there and back; those of the comparison stay. An id that an engine
    # has several rows of has as many here, told apart by a condition that no row is dealt by.
    merged = [F.coalesce(F.col(f"champ.{n}"), F.col(f"challenger.{n}")).alias(n) for n in ("vendor_name", "purchase_order")]
    known = with_reference_data(frame.select(D.KEY, "_row", *merged), vendors, orders)
    known = known.select(F.col(D.KEY).alias("_id"), F.col("_row").alias("_own"), "vendor_id", "vendor_valid", "po_valid", F.col("message").alias("vendor_message"))
    known = stored_by_key(known.repartition(key_buckets(frame.sparkSession), "_id"), "_id")
    same = (F.col(D.KEY) == F.col("_id")) & (F.col("_row") - F.col("_own") == 0)
    frame = frame.join(known.hint("shuffle_hash"), same, "left").drop("_row", "_id", "_own")
    read = F.col("champ").isNotNull() | F.col("challenger").isNotNull()
    given = lambda name, c=None: F.when(read, F.col(name) if c is None else c).alias(name)
    found = [given(c) for c in ("vendor_id", "vendor_valid", "po_valid", "vendor_message")]
    judged = D.reported(frame, cfg).select(
        D.KEY, *D.merged_columns(frame), given("status", F.col("decision")), given("confidence"), given("report", F.to_json("report")), *found,
        F.col("champ").isNotNull().alias("_a"), F.col("challenger").isNotNull().alias("_b"), "_took",
    )
    invoices = judged.drop("_a", "_b", "_took").withColumn("status", F.coalesce("status", F.lit("FAILED")))
    kept = items.join(ids, D.KEY, "left_semi")

    a, b, some = F.col("_a"), F.col("_b"), F.col("status").isNotNull()
    said = lambda name, ok: F.when(ok, f"{name} OCR ok").otherwise(f"{name} OCR failed: no extraction")
    decided = F.coalesce(F.concat(F.lit("Validation decision: "), "status"), F.lit("Validation failed: no engine gave an extraction"))
    vendor = F.concat(F.lit("vendor_valid="), F.col("vendor_valid").cast("string"), F.lit(", po_valid="), F.col("po_valid").cast("string"))
    # Stages by number: agent, whether it went well, what it is if not, and its message. They are told apart
    # after rows are laid out, so that a report that is not asked for is not made.
    stages = [("champ", a, "ERROR", said("Champ", a)), ("challenger", b, "ERROR", said("Challenger", b)), ("validation", some, "ERROR", decided), ("vendor_check", F.col("vendor_valid"), "WARNING", vendor)]
    step = F.col("step")
    each = lambda values: reduce(lambda made, kv: made.when(step == kv[0], kv[1]), enumerate(values), F)
    ran = judged.withColumn("step", F.explode(F.when(some, F.array(*map(F.lit, range(4)))).otherwise(F.array(*map(F.lit, range(3))))))
    logs = ran.select(
        D.KEY, "step", each([F.lit(s[0]) for s in stages]).alias("agent"), each([F.when(s[1], "INFO").otherwise(s[2]) for s in stages]).alias("level"),
        each([s[3] for s in stages]).alias("message"), F.when(step == 2, F.col("report")).alias("extra"), "_took",
    )
    # A stage that was timed more than once has a row for each time.
    times = F.transform(F.filter("_took", lambda t: t["agent"] == F.col("agent")), lambda t: t["ms"])
    timed = F.when(F.size(times) > 0, times).otherwise(F.array(F.lit(None).cast("int")))
    return invoices, kept, logs.withColumn("duration_ms", F.explode_outer(timed)).drop("_took")
