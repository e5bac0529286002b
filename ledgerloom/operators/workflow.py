"""Uploads, status changes, review actions, reference data and posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ACTIONS, EXTENSIONS, MAX_BYTES, POSTABLE, TRANSITIONS

KEY = "invoice_id"


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot, empty without one."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def ingest_gate(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (filename, size_bytes, ...) with reject_reason: null if accepted; size goes first."""
    known = extension(F.col("filename")).isin(*EXTENSIONS)
    reason = F.when(F.col("size_bytes") > max_bytes, "FILE_TOO_LARGE").when(~known, "UNSUPPORTED_FILE_TYPE")
    return files.withColumn("reject_reason", reason)


def content_key(files: DataFrame) -> DataFrame:
    """files with file_hash, storage key and mime_type (a default for none)."""
    digest = F.sha2("content", 256)
    kind = F.coalesce("mime_type", F.lit("application/octet-stream")) if "mime_type" in files.columns else F.lit("application/octet-stream")
    return files.withColumns({"file_hash": digest, "storage_key": F.concat(F.lit("invoices/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit("_"), F.col("filename")), "mime_type": kind})


def dedup_first_wins(uploads: DataFrame, order: str = "doc_id") -> DataFrame:
    """uploads with duplicate: whether an earlier one has the same hash.

    The first of each hash is found by a partial aggregate, so a file that is uploaded over and over
    does not gather in a task.
    """
    first = uploads.groupBy("file_hash").agg(F.min(order).alias("_first"))
    return uploads.join(first, "file_hash").withColumn("duplicate", F.col(order) > F.col("_first")).drop("_first")


def reject_known_hash(new: DataFrame, existing: DataFrame) -> DataFrame:
    return new.join(existing.select("file_hash"), "file_hash", "left_anti")


def transitions(spark) -> DataFrame:
    pairs = [F.struct(F.lit(a).alias("current"), F.lit(b).alias("target")) for a, then in TRANSITIONS.items() for b in then]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def check_transitions(df: DataFrame) -> DataFrame:
    """df (current, target, ...) with legal."""
    allowed = transitions(df.sparkSession).withColumn("_legal", F.lit(True))
    return df.join(F.broadcast(allowed), ["current", "target"], "left").withColumn("legal", F.coalesce("_legal", F.lit(False))).drop("_legal")


def _action_target() -> Column:
    target = F.lit(None).cast("string")
    for action, status in ACTIONS.items():
        target = F.when(F.col("action") == action, status).otherwise(target)
    return target


# What a reviewer may set.
EDITABLE = ("vendor_name", "invoice_number", "invoice_date", "due_date", "currency", "subtotal", "tax_amount", "total_amount", "purchase_order")


def apply_review(invoices: DataFrame, actions: DataFrame) -> DataFrame:
    """invoices with their editable columns, status, reviewer_id, review_notes and conflicts after review.

    actions: invoice_id, seq, action, set_fields (names), edits (a struct of new values), reviewer_id,
    notes; an invoice's actions are taken by seq. An action first edits the fields that it sets, to
    null too, and edits stay whatever comes of the action. Then it moves the status if that is legal;
    if not, that is counted in conflicts. Who edits or moves is the reviewer, else the earlier one
    stays; notes count with a move, unless blank. Items are replaced by replace_items.
    """
    kinds = {"status": "string", "reviewer_id": "bigint", "review_notes": "string"}
    fields = [f for f in EDITABLE if f in invoices.columns]
    edited = [f for f in fields if f in actions.schema["edits"].dataType.names]
    one = F.struct("seq", _action_target().alias("target"), "set_fields", "edits", "reviewer_id", "notes")
    steps = actions.groupBy(KEY).agg(F.array_sort(F.collect_list(one)).alias("_steps"))
    own = {n: F.col(n).cast(k) if n in invoices.columns else F.lit(None).cast(k) for n, k in kinds.items()}
    start = F.struct(*fields, *(c.alias(n) for n, c in own.items()), F.lit(0).alias("conflicts"))
    allowed = F.create_map(*(x for a, then in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, then)).cast("array<string>"))))

    def step(s: Column, a: Column) -> Column:
        sets = lambda f: F.coalesce(F.array_contains(a["set_fields"], f), F.lit(False))
        legal = F.coalesce(F.array_contains(F.try_element_at(allowed, s["status"]), a["target"]), F.lit(False))
        acts = legal | (F.coalesce(F.size(a["set_fields"]), F.lit(0)) > 0)
        said = legal & F.coalesce(a["notes"] != "", F.lit(False))
        return F.struct(
            *(F.when(sets(f), a["edits"][f]).otherwise(s[f]).alias(f) if f in edited else s[f].alias(f) for f in fields),
            F.when(legal, a["target"]).otherwise(s["status"]).alias("status"),
            F.when(acts, a["reviewer_id"].cast("bigint")).otherwise(s["reviewer_id"]).alias("reviewer_id"),
            F.when(said, a["notes"]).otherwise(s["review_notes"]).alias("review_notes"),
            (s["conflicts"] + F.when(legal, 0).otherwise(1)).alias("conflicts"),
        )

    joined = invoices.join(steps, KEY, "left")
    done = F.when(F.col("_steps").isNull(), start).otherwise(F.aggregate("_steps", start, step))
    names = [*fields, *kinds, "conflicts"]
    others = [c for c in invoices.columns if c not in names]
    return joined.select(*others, done.alias("_done")).select(*others, *(F.col(f"_done.{n}").alias(n) for n in names))


def replace_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """items with those of every invoice in new replaced by new's."""
    return items.join(new.select(KEY).distinct(), KEY, "left_anti").unionByName(new)


def _vendor_ids(vendors: DataFrame) -> DataFrame:
    """vendor_name, vendor_id: of a name that is listed again, the smallest id."""
    return vendors.groupBy("vendor_name").agg(F.min("vendor_id").alias("vendor_id"))


def with_reference_data(df: DataFrame, vendors: DataFrame, orders: DataFrame) -> DataFrame:
    """df (with vendor_name, purchase_order) with vendor_id, vendor_valid, po_valid and message."""
    known = orders.select("purchase_order").distinct().withColumn("_known", F.lit(True))
    joined = df.join(_vendor_ids(vendors), "vendor_name", "left").join(known, "purchase_order", "left")
    vendor_ok = F.col("vendor_id").isNotNull()
    po_ok = F.col("purchase_order").isNull() | F.coalesce("_known", F.lit(False))
    message = F.when(vendor_ok & po_ok, "ok").otherwise("partial")
    return joined.select(*df.columns, "vendor_id", vendor_ok.alias("vendor_valid"), po_ok.alias("po_valid"), message.alias("message"))


def reference_data_check(invoices: DataFrame, vendors: DataFrame, orders: DataFrame) -> DataFrame:
    """invoice_id, vendor_id, vendor_valid, po_valid, message; no purchase order is a valid one."""
    own = invoices.select(KEY, "vendor_name", "purchase_order")
    return with_reference_data(own, vendors, orders).drop("vendor_name", "purchase_order")


def posting_payload(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """A row per invoice: what would be posted, or why it is skipped."""
    joined = invoices.join(_vendor_ids(vendors), "vendor_name", "left")
    ok = F.col("status").isin(*POSTABLE)
    shown = lambda c, name: F.when(ok, c).alias(name)
    return joined.select(
        KEY,
        shown(F.col("vendor_id"), "vendor_id"),
        shown(F.col("invoice_number"), "invoice_number"),
        shown(F.col("total_amount").cast("string"), "total"),
        shown(F.coalesce("currency", F.lit("USD")), "currency"),
        shown(F.date_format("invoice_date", "yyyy-MM-dd"), "invoice_date"),
        F.when(~ok, F.concat(F.lit("bad status: "), F.col("status"))).alias("skipped"),
    )


def item_constraints(items: DataFrame) -> DataFrame:
    """items with violations: the names of the rules that a row breaks, in order."""
    size = F.char_length("description")
    rules = {
        "line_number": F.col("line_number") >= 1,
        "description": size.between(1, 1024),
        "quantity": F.col("quantity") >= 0,
        "unit_price": F.col("unit_price") >= 0,
        "amount": F.col("amount") >= 0,
        "tax_rate": F.col("tax_rate").isNull() | F.col("tax_rate").between(0, 100),
    }
    broken = [F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]
    return items.withColumn("violations", F.array_compact(F.array(*broken)))

