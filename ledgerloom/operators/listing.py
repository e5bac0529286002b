"""Filters, lists, pages and details of invoices."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..indexes import SortedIndex, TextIndex, numbered_chunks
from ..schemas import FINALIZED, GROUPS, IN_REVIEW, STATUSES

KEY = "invoice_id"
SEARCHED = ("vendor_name", "invoice_number", "original_filename", "purchase_order")
SORTABLE = ("created_at", "invoice_date", "vendor_name", "total_amount", "status")


@dataclass(frozen=True)
class Filters:
    """What a list is restricted to; None or blank text means no restriction."""

    status: str | None = None
    vendor: str | None = None
    number: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    search: str | None = None


def _contains(column: str, text: str) -> Column:
    # Wildcards of the user stay wildcards.
    return F.col(column).ilike(f"%{text}%")


def filter_status(df: DataFrame, status: str | None) -> DataFrame:
    return df if not status else df.filter(F.col("status") == status)


def filter_vendor(df: DataFrame, text: str | None) -> DataFrame:
    return df if not text else df.filter(_contains("vendor_name", text))


def filter_number(df: DataFrame, text: str | None) -> DataFrame:
    return df if not text else df.filter(_contains("invoice_number", text))


def filter_date_range(df: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Invoices dated from first to last, both included; undated ones drop out of either bound."""
    df = df if not first else df.filter(F.col("invoice_date") >= F.lit(first).cast("date"))
    return df if not last else df.filter(F.col("invoice_date") <= F.lit(last).cast("date"))


def search_any(df: DataFrame, text: str | None) -> DataFrame:
    if not text:
        return df
    return df.filter(reduce(Column.__or__, (F.coalesce(_contains(c, text), F.lit(False)) for c in SEARCHED)))


def apply_filters(df: DataFrame, filters: Filters) -> DataFrame:
    trimmed = lambda t: t.strip() if t else None
    df = filter_status(df, filters.status)
    df = filter_vendor(df, trimmed(filters.vendor))
    df = filter_number(df, trimmed(filters.number))
    df = filter_date_range(df, filters.date_from, filters.date_to)
    return search_any(df, trimmed(filters.search))


def view_finalized(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status").isin(*FINALIZED))


def view_review_queue(df: DataFrame, status: str | None = None) -> DataFrame:
    return df.filter(F.col("status").isin(*([status] if status else IN_REVIEW)) & F.col("status").isin(*IN_REVIEW))


def lookup(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """The rows whose key is among keys."""
    return df.join(keys.select(key), key, "left_semi")


def title(number: str = "invoice_number", filename: str = "original_filename") -> Column:
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(blank(number), blank(filename), F.col(KEY).cast("string"))


def batch_slice(df: DataFrame, batch: int, status: str) -> DataFrame:
    return df.filter((F.col("batch_id") == batch) & (F.col("status") == status)).select(KEY, title().alias("title"), "vendor_name", "total_amount")


def review_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"can_review": F.col("status").isin("REVIEW_REQUIRED", "FAILED"), "locked": F.col("status") == "REJECTED"})


def dirty_flag(df: DataFrame, edited: DataFrame, columns=("vendor_name", "invoice_number", "invoice_date", "total_amount")) -> DataFrame:
    """invoice_id, dirty: whether an edit differs from what is stored, null being an empty text."""
    shown = lambda t, c: F.coalesce(F.col(f"{t}.{c}").cast("string"), F.lit(""))
    pairs = df.alias("a").join(edited.alias("b"), KEY)
    return pairs.select(KEY, reduce(Column.__or__, (shown("a", c) != shown("b", c) for c in columns)).alias("dirty"))


def field_groups(df: DataFrame) -> DataFrame:
    """invoice_id, group, field, value in long form, for the fields of groups that df has."""
    pairs = [(g, f) for g, names in GROUPS.items() for f in names if f in df.columns]
    rows = F.array(*(F.struct(F.lit(g).alias("group"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for g, f in pairs))
    return df.select(KEY, F.inline(rows))


def _order(column: str, descending: bool) -> Column:
    by = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")) if column == "status" else F.col(column)
    by = F.when(F.col("status").isNotNull(), by) if column == "status" else by
    return by.desc_nulls_first() if descending else by.asc_nulls_last()


def sorted_list(df: DataFrame, sort_by: str = "created_at", sort_dir: str = "desc") -> DataFrame:
    """By a sortable column, else by created_at; statuses by their own order; ids break ties.

    Nulls come first when descending and last when ascending.
    """
    column = sort_by if sort_by in SORTABLE else "created_at"
    return df.orderBy(_order(column, sort_dir == "desc"), F.col(KEY))


def page(df: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """A page of a sorted list; only that many rows are kept by each task."""
    return df.offset(max(0, (number - 1) * size)).limit(size)


def sorted_index(df: DataFrame, path: str, sort_by: str = "created_at", sort_dir: str = "desc") -> SortedIndex:
    """sorted_list stored below path, of which any page is read alone."""
    column = sort_by if sort_by in SORTABLE else "created_at"
    return SortedIndex.build(df, path, [_order(column, sort_dir == "desc"), F.col(KEY)])


def search_index(df: DataFrame, path: str, chunks: int = 200) -> TextIndex:
    """df stored below path with an index for filter_vendor, filter_number and search_any: neighbours
    by invoice number are together."""
    return TextIndex.build(df, path, SEARCHED, chunks, [F.col("invoice_number"), F.col(KEY)])


def serial_number(paged: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Serial numbers on a page, which holds few rows."""
    return paged.withColumn("serial", F.row_number().over(Window.orderBy(*order)) + (number - 1) * size)


def filtered_total_pages(df: DataFrame, filters: Filters, size: int) -> DataFrame:
    return apply_filters(df, filters).agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / size)).alias("pages"))


def items_in_order(items: DataFrame) -> DataFrame:
    """invoice_id and its items as an array by line number."""
    item = F.struct("line_number", "description", "quantity", "unit_price", "amount")
    return items.groupBy(KEY).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _entry(logs: DataFrame) -> Column:
    return F.struct("created_at", "log_id", "agent", "level", "duration_ms", *(c for c in ("message", "extra") if c in logs.columns))


def audit_trail(logs: DataFrame) -> DataFrame:
    """invoice_id and its log as an array by time, with messages if there are any."""
    return logs.groupBy(KEY).agg(F.array_sort(F.collect_list(_entry(logs))).alias("logs"))


def audit_parts(logs: DataFrame, size: int = 1000) -> DataFrame:
    """invoice_id, part and logs: the audit trail in parts of `size` entries, numbered from 0 by time,
    so that an invoice with very many entries is in no single row or task. Entries of one time go by
    log_id, which has to be unique."""
    dealt = numbered_chunks(logs, KEY, [F.col("created_at").asc_nulls_first(), F.col("log_id")], size)
    return dealt.groupBy(KEY, "part").agg(F.array_sort(F.collect_list(_entry(logs))).alias("logs"))


def detail_parts(invoices: DataFrame, items: DataFrame, logs: DataFrame, size: int = 1000) -> DataFrame:
    """Each invoice with its items, and its log in parts of `size`: a row for each part, at least one.
    part is null where there is no log; items are in the first row alone."""
    parts = invoices.join(audit_parts(logs, size), KEY, "left").join(items_in_order(items), KEY, "left")
    held = F.when(F.coalesce("part", F.lit(0)) == 0, F.coalesce("items", F.array()))
    return parts.withColumns({"items": held, "logs": F.coalesce("logs", F.array())})


def invoice_detail(invoices: DataFrame, items: DataFrame, logs: DataFrame) -> DataFrame:
    """Each invoice with its items and log. Both are gathered before they are joined, so that one
    does not multiply the other."""
    empty = lambda c: F.coalesce(F.col(c), F.array())
    joined = invoices.join(items_in_order(items), KEY, "left").join(audit_trail(logs), KEY, "left")
    return joined.withColumns({"items": empty("items"), "logs": empty("logs")})


def rebuild_extracted(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """invoice_id and the extraction struct that was stored in columns and items."""
    joined = invoices.join(items_in_order(items), KEY, "left")
    fields = ("vendor_name", "invoice_number", "invoice_date", "currency", "subtotal", "tax_amount", "total_amount", "purchase_order")
    return joined.select(KEY, F.struct(*fields, F.coalesce("items", F.array()).alias("items")).alias("extracted"))
