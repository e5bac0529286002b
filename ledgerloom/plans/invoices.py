"""Queries over invoices, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixtures import load, oracle
from ..operators import decide as D
from ..operators import ensemble as E
from ..operators import listing as L
from ..operators import stats as S
from ..operators import workflow as W
from ..schemas import COMPARED, LABELS, MONEY, STATUSES, TRANSITIONS
from ..storage import new_path

NOW = "1997-06-15 12:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return add


def _pairs(spark, sf):
    return D.pair_engines(load(spark, sf, "fx_champ"), load(spark, sf, "fx_challenger"))


def _decisions(spark, sf):
    return D.decide(load(spark, sf, "fx_champ"), load(spark, sf, "fx_challenger"), load(spark, sf, "fx_items"))


# ---- two extractions ----

_MATCH = {
    name: f"CASE WHEN a.{name} IS NULL AND b.{name} IS NULL THEN true WHEN a.{name} IS NULL OR b.{name} IS NULL THEN false ELSE "
    + (
        f"abs(a.{name} - b.{name}) <= CAST(0.01 AS DECIMAL(5,4)) * greatest(abs(a.{name}), abs(b.{name}), CAST(1 AS DECIMAL(14,2)))"
        if name in MONEY
        else f"lower(trim(CAST(a.{name} AS VARCHAR))) = lower(trim(CAST(b.{name} AS VARCHAR)))"
    )
    + " END"
    for name in COMPARED
}
# Of texts that differ here, one begins with the other: its length is what matches.
_LIKE = {
    name: f"round(CASE WHEN a.{name} IS NULL AND b.{name} IS NULL THEN 1.0::DOUBLE WHEN a.{name} IS NULL OR b.{name} IS NULL THEN 0.0::DOUBLE WHEN {_MATCH[name]} THEN 1.0::DOUBLE ELSE "
    + (
        f"1 - CAST(abs(a.{name} - b.{name}) AS DOUBLE) / CAST(greatest(abs(a.{name}) + abs(b.{name}), 1) AS DOUBLE)"
        if name in MONEY
        else f"CASE WHEN starts_with(lower(CAST(b.{name} AS VARCHAR)), lower(CAST(a.{name} AS VARCHAR))) THEN 2.0::DOUBLE * length(CAST(a.{name} AS VARCHAR)) / (length(CAST(a.{name} AS VARCHAR)) + length(CAST(b.{name} AS VARCHAR))) END"
    )
    + " END, 3)"
    for name in COMPARED
}
_LONG = " UNION ALL ".join(
    f"SELECT a.invoice_id, '{n}' AS field, CAST(a.{n} AS VARCHAR) AS champ, CAST(b.{n} AS VARCHAR) AS challenger, {m} AS match, {_LIKE[n]} AS similarity FROM fx_champ a JOIN fx_challenger b USING (invoice_id)" for n, m in _MATCH.items()
)
# In these views unequal texts are far below the similarity that would make them match.
_DECIDED = f"""compared AS ({_LONG}),
agreed AS (SELECT invoice_id, CAST(sum(CASE WHEN match THEN 1 ELSE 0 END) AS BIGINT) AS matches, sum(CASE WHEN match THEN 1 ELSE 0 END) / 7.0::DOUBLE AS agreement FROM compared GROUP BY invoice_id),
sums AS (SELECT invoice_id, CAST(sum(amount) AS DECIMAL(14,2)) AS line_sum FROM fx_items GROUP BY invoice_id),
math AS (SELECT c.invoice_id, line_sum IS NULL OR total_amount IS NULL AS skipped, line_sum, coalesce(tax_amount, 0) AS tax,
    CAST(line_sum + coalesce(tax_amount, 0) AS DECIMAL(14,2)) AS computed, total_amount AS declared,
    abs(line_sum + coalesce(tax_amount, 0) - total_amount) <= CAST(0.01 AS DECIMAL(5,4)) * greatest(total_amount, 1) AS ok
  FROM fx_champ c LEFT JOIN sums USING (invoice_id)),
checked AS (SELECT invoice_id, skipped, coalesce(skipped OR ok, true) AS math_ok, CASE WHEN NOT skipped THEN line_sum END AS line_sum, CASE WHEN NOT skipped THEN tax END AS tax,
    CASE WHEN NOT skipped THEN computed END AS computed_total, CASE WHEN NOT skipped THEN declared END AS declared_total FROM math),
decided AS (SELECT coalesce(a.invoice_id, b.invoice_id) AS invoice_id, a.invoice_id IS NOT NULL AND b.invoice_id IS NOT NULL AS two, a.invoice_id IS NOT NULL AS has_champ,
    (0.0 + a.conf_vendor + a.conf_total) / 2 AS ca, (0.0 + b.conf_vendor + b.conf_total) / 2 AS cb, g.agreement, m.math_ok, m.computed_total, m.declared_total
  FROM fx_champ a FULL JOIN fx_challenger b ON a.invoice_id = b.invoice_id LEFT JOIN agreed g ON g.invoice_id = a.invoice_id LEFT JOIN checked m ON m.invoice_id = a.invoice_id)"""
_WEIGHTED = "0.65::DOUBLE * ca + 0.35::DOUBLE * cb"
_REASONS = f"""CASE WHEN NOT two THEN CASE WHEN has_champ THEN ['Challenger OCR unavailable'] ELSE ['Champ OCR unavailable'] END ELSE
  (SELECT CASE WHEN len(r) = 0 THEN ['All checks passed'] ELSE r END FROM (SELECT list_filter([CASE WHEN NOT ({_WEIGHTED} >= 0.85) THEN 'Confidence below threshold' END,
   CASE WHEN NOT (agreement >= 0.9) THEN 'Field agreement below threshold' END,
   CASE WHEN NOT math_ok THEN 'Total mismatch: computed=' || computed_total || ' declared=' || declared_total END], lambda x: x IS NOT NULL) AS r)) END"""


@query("pair_engines", "SELECT coalesce(a.invoice_id, b.invoice_id) AS invoice_id, a.invoice_id IS NOT NULL AS has_champ, b.invoice_id IS NOT NULL AS has_challenger, a.total_amount AS champ_total, b.total_amount AS challenger_total FROM fx_champ a FULL JOIN fx_challenger b ON a.invoice_id = b.invoice_id")
def _(spark, sf):
    return _pairs(spark, sf).select("invoice_id", F.col("champ").isNotNull().alias("has_champ"), F.col("challenger").isNotNull().alias("has_challenger"), F.col("champ.total_amount").alias("champ_total"), F.col("challenger.total_amount").alias("challenger_total"))


@query("compare_fields", f"WITH {_DECIDED} SELECT invoice_id, field, champ, challenger, match, similarity FROM compared")
def _(spark, sf):
    return D.compare_fields(_pairs(spark, sf))


@query("field_similarity", f"WITH {_DECIDED} SELECT invoice_id, field, similarity FROM compared")
def _(spark, sf):
    return D.compare_fields(_pairs(spark, sf)).select("invoice_id", "field", "similarity")


@query("agreement_ratio", f"WITH {_DECIDED} SELECT invoice_id, matches, agreement FROM agreed")
def _(spark, sf):
    return D.agreement_ratio(_pairs(spark, sf))


@query("line_item_sum", "SELECT invoice_id, CAST(sum(amount) AS DECIMAL(14,2)) AS line_sum, count(*) AS n_items FROM fx_items GROUP BY invoice_id")
def _(spark, sf):
    return D.line_item_sum(load(spark, sf, "fx_items"))


@query("math_check", f"WITH {_DECIDED} SELECT * FROM checked")
def _(spark, sf):
    return D.math_check(load(spark, sf, "fx_champ"), load(spark, sf, "fx_items"))


_DUE = "CAST(CASE WHEN invoice_id % 3 <> 0 THEN invoice_date + {0} END AS DATE)"
_RAW = "CASE WHEN invoice_id % 4 <> 0 THEN '{{\"engine\":\"{0}\",\"id\":' || invoice_id || '}}' END"
_BOTH_RAW = "'{\"champ\":' || coalesce(a.raw, 'null') || ',\"challenger\":' || coalesce(b.raw, 'null') || '}'"


@query("merge_extractions", f"""WITH a AS (SELECT *, {_DUE.format(30)} AS due_date, {_RAW.format('a')} AS raw FROM fx_champ), b AS (SELECT *, CAST(invoice_date + 45 AS DATE) AS due_date, {_RAW.format('b')} AS raw FROM fx_challenger)
SELECT coalesce(a.invoice_id, b.invoice_id) AS invoice_id, {", ".join(f"coalesce(a.{n}, b.{n}) AS {n}" for n in (*COMPARED, "currency", "due_date"))},
  CASE WHEN a.invoice_id IS NOT NULL AND b.invoice_id IS NOT NULL THEN {_BOTH_RAW} ELSE coalesce(a.raw, b.raw) END AS raw FROM a FULL JOIN b ON a.invoice_id = b.invoice_id""")
def _(spark, sf):
    later = lambda days: F.date_add("invoice_date", days)
    raw = lambda name: F.when(F.col("invoice_id") % 4 != 0, F.to_json(F.struct(F.lit(name).alias("engine"), F.col("invoice_id").alias("id"))))
    champ = load(spark, sf, "fx_champ").withColumns({"due_date": F.when(F.col("invoice_id") % 3 != 0, later(30)), "raw": raw("a")})
    challenger = load(spark, sf, "fx_challenger").withColumns({"due_date": later(45), "raw": raw("b")})
    return D.merge_extractions(D.pair_engines(champ, challenger))


@query("merge_items", "WITH a AS (SELECT * FROM fx_items WHERE invoice_id % 3 <> 0) SELECT invoice_id, line_number, description, amount FROM a UNION ALL SELECT invoice_id, 1, 'Whole order', CAST(sum(amount) AS DECIMAL(14,2)) FROM fx_items WHERE invoice_id NOT IN (SELECT invoice_id FROM a) GROUP BY invoice_id")
def _(spark, sf):
    items = load(spark, sf, "fx_items").select("invoice_id", "line_number", "description", "amount")
    whole = items.groupBy("invoice_id").agg(F.sum("amount").cast("decimal(14,2)").alias("amount"))
    other = whole.select("invoice_id", F.lit(1).alias("line_number"), F.lit("Whole order").alias("description"), "amount")
    return D.merge_items(items.filter("invoice_id % 3 <> 0"), other)


@query("decide", f"WITH {_DECIDED} SELECT invoice_id, CASE WHEN two AND {_WEIGHTED} >= 0.85 AND agreement >= 0.9 AND math_ok THEN 'AUTO_APPROVED' ELSE 'REVIEW_REQUIRED' END AS decision, CAST(round(CAST(CASE WHEN two THEN {_WEIGHTED} WHEN has_champ THEN ca ELSE cb END AS DECIMAL(12,8)), 4) AS DOUBLE) AS confidence, CASE WHEN two THEN agreement END AS agreement, CASE WHEN two THEN math_ok END AS math_ok, array_to_string({_REASONS}, '; ') AS reasons FROM decided")
def _(spark, sf):
    return _decisions(spark, sf).withColumn("reasons", F.array_join("reasons", "; "))


@query("decision_reasons", f"WITH {_DECIDED} SELECT reason, count(*) AS n FROM (SELECT unnest({_REASONS}) AS reason FROM decided) GROUP BY reason")
def _(spark, sf):
    return _decisions(spark, sf).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("overall_status", f"WITH {_DECIDED} SELECT i.invoice_id, CASE WHEN d.invoice_id IS NULL THEN 'FAILED' WHEN two AND {_WEIGHTED} >= 0.85 AND agreement >= 0.9 AND math_ok THEN 'AUTO_APPROVED' ELSE 'REVIEW_REQUIRED' END AS status FROM fx_invoices i LEFT JOIN decided d USING (invoice_id)")
def _(spark, sf):
    return D.overall_status(load(spark, sf, "fx_invoices"), _decisions(spark, sf))


def _reports(spark, sf):
    return D.validation_report(load(spark, sf, "fx_champ"), load(spark, sf, "fx_challenger"), load(spark, sf, "fx_items"))


_THIRD = "CAST(round(CAST({0} AS DECIMAL(12,8)), 3) AS DOUBLE)"
_REPORTED = f"""SELECT d.invoice_id, CASE WHEN two AND {_WEIGHTED} >= 0.85 AND agreement >= 0.9 AND math_ok THEN 'AUTO_APPROVED' ELSE 'REVIEW_REQUIRED' END AS decision,
  CASE WHEN two THEN round(d.agreement, 3) END AS agreement_ratio, CASE WHEN two THEN {_THIRD.format(_WEIGHTED)} END AS weighted_confidence,
  CASE WHEN two THEN {_THIRD.format('ca')} END AS champ_confidence, CASE WHEN two THEN {_THIRD.format('cb')} END AS challenger_confidence,
  CASE WHEN two THEN '0.85 0.9 0.01' END AS thresholds, CASE WHEN two THEN c.skipped END AS skipped, CASE WHEN two AND c.skipped THEN 'insufficient data' END AS skip_reason,
  CASE WHEN two THEN CAST(c.line_sum AS VARCHAR) END AS line_sum, CASE WHEN two THEN CAST(CAST(c.tax AS DECIMAL(14,2)) AS VARCHAR) END AS tax, CASE WHEN two THEN CAST(d.computed_total AS VARCHAR) END AS computed_total,
  CASE WHEN two THEN CAST(d.declared_total AS VARCHAR) END AS declared_total, CASE WHEN two AND NOT c.skipped THEN d.math_ok END AS within_tolerance, fields, array_to_string({_REASONS}, '; ') AS reasons
FROM decided d LEFT JOIN (SELECT invoice_id, skipped, line_sum, tax FROM checked) c ON c.invoice_id = d.invoice_id
LEFT JOIN (SELECT invoice_id, string_agg(field || '=' || coalesce(champ, '') || '|' || coalesce(challenger, '') || '|' || match || '|' || CAST(similarity * 1000 AS INT), ';' ORDER BY field) AS fields FROM compared GROUP BY invoice_id) f ON f.invoice_id = d.invoice_id"""


@query("validation_report", f"WITH {_DECIDED} {_REPORTED}")
def _(spark, sf):
    r = lambda path: F.col(f"report.{path}")
    text = lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"]["champ"], F.lit("")), F.lit("|"), F.coalesce(e["value"]["challenger"], F.lit("")),
        F.lit("|"), e["value"]["match"].cast("string"), F.lit("|"), F.round(e["value"]["similarity"] * 1000).cast("int").cast("string"),
    )
    math = ("skipped", "line_sum", "tax", "computed_total", "declared_total", "within_tolerance")
    limits = F.concat_ws(" ", *(r(f"thresholds.{n}").cast("string") for n in ("confidence", "field_match", "amount_tolerance")))
    return _reports(spark, sf).select(
        "invoice_id", r("decision"), r("agreement_ratio"), r("weighted_confidence"), r("confidence_by_engine.champ").alias("champ_confidence"), r("confidence_by_engine.challenger").alias("challenger_confidence"),
        F.when(r("thresholds").isNotNull(), limits).alias("thresholds"), *(r(f"math_check.{n}") for n in math), r("math_check.reason").alias("skip_reason"),
        F.array_join(F.array_sort(F.transform(F.map_entries("report.fields"), text)), ";").alias("fields"), F.array_join("report.reasons", "; ").alias("reasons"),
    )


@query("mismatch_flags", f"WITH {_DECIDED} SELECT d.invoice_id, coalesce(m, '') AS mismatches FROM decided d LEFT JOIN (SELECT invoice_id, string_agg(field, ',' ORDER BY field) AS m FROM compared WHERE NOT match GROUP BY invoice_id) USING (invoice_id)")
def _(spark, sf):
    return D.mismatch_flags(_reports(spark, sf)).select("invoice_id", F.array_join("mismatches", ",").alias("mismatches"))


def _fields(df):
    """An extraction as the toolkit's field map."""
    names = (*COMPARED, "currency")
    entries = F.array(*(F.struct(F.lit(n), F.col(n).cast("string")) for n in names))
    return df.select(F.col("invoice_id").alias("doc_id"), F.map_filter(F.map_from_entries(entries), lambda _, v: v.isNotNull()).alias("fields"), ((F.col("conf_vendor") + F.col("conf_total")) / 2).alias("mean_confidence"))


_KEYS = " UNION ALL ".join(f"SELECT coalesce(a.invoice_id, b.invoice_id) AS doc_id, '{n}' AS field, CAST(a.{n} AS VARCHAR) AS champ, CAST(b.{n} AS VARCHAR) AS challenger FROM fx_champ a FULL JOIN fx_challenger b ON a.invoice_id = b.invoice_id WHERE a.{n} IS NOT NULL OR b.{n} IS NOT NULL" for n in (*COMPARED, "currency"))
_TRIGRAMS = "list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))"
_NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_ENSEMBLE = f"""keys AS ({_KEYS}),
norm AS (SELECT *, {_NORM.format("champ")} AS x, {_NORM.format("challenger")} AS y FROM keys),
agree AS (SELECT doc_id, field, champ, challenger, CASE WHEN champ IS NULL OR challenger IS NULL THEN false
    WHEN field IN ('subtotal', 'tax_amount', 'total_amount') THEN CAST(champ AS DECIMAL(16,2)) = CAST(challenger AS DECIMAL(16,2))
    WHEN field = 'vendor_name' THEN (SELECT len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q)))::DOUBLE >= 0.7
      FROM (SELECT (SELECT {_TRIGRAMS} FROM (SELECT '  ' || x || '  ' AS t)) AS p, (SELECT {_TRIGRAMS} FROM (SELECT '  ' || y || '  ' AS t)) AS q))
    ELSE x = y END AS ok FROM norm),
conf AS (SELECT coalesce(a.invoice_id, b.invoice_id) AS doc_id, coalesce((a.conf_vendor + a.conf_total) / 2, 0) AS ca, coalesce((b.conf_vendor + b.conf_total) / 2, 0) AS cb
  FROM fx_champ a FULL JOIN fx_challenger b ON a.invoice_id = b.invoice_id)"""


@query("field_key_union", f"WITH {_ENSEMBLE} SELECT * FROM keys")
def _(spark, sf):
    return E.field_key_union(_fields(load(spark, sf, "fx_champ")), _fields(load(spark, sf, "fx_challenger")))


@query("fields_agree", f"WITH {_ENSEMBLE} SELECT doc_id, field, ok FROM agree")
def _(spark, sf):
    from ..functions.scalars import fields_agree

    keys = E.field_key_union(_fields(load(spark, sf, "fx_champ")), _fields(load(spark, sf, "fx_challenger")))
    return keys.select("doc_id", "field", fields_agree(F.col("field"), F.col("champ"), F.col("challenger")).alias("ok"))


@query("ensemble_decide", f"WITH {_ENSEMBLE}, whole AS (SELECT doc_id, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)::DOUBLE AS agreement, coalesce(string_agg(CASE WHEN NOT ok THEN field END, ',' ORDER BY field), '') AS mismatches FROM agree GROUP BY doc_id) SELECT doc_id, CASE WHEN agreement >= 0.9 AND (ca + cb) / 2 >= 0.75 THEN 'AUTO_APPROVE' ELSE 'REVIEW_REQUIRED' END AS decision, mismatches, agreement, (ca + cb) / 2 AS confidence FROM whole JOIN conf USING (doc_id)")
def _(spark, sf):
    made = E.ensemble_decide(_fields(load(spark, sf, "fx_champ")), _fields(load(spark, sf, "fx_challenger")))
    return made.select("doc_id", "decision", F.array_join("mismatches", ",").alias("mismatches"), "agreement", "confidence")


@query("ensemble_fields", f"WITH {_ENSEMBLE} SELECT doc_id, field, coalesce(CASE WHEN ok THEN coalesce(nullif(champ, ''), challenger) WHEN ca >= cb THEN champ ELSE challenger END, '') AS value FROM agree JOIN conf USING (doc_id)")
def _(spark, sf):
    made = E.ensemble_decide(_fields(load(spark, sf, "fx_champ")), _fields(load(spark, sf, "fx_challenger")))
    # An outer generator: for an inner one Spark would compare a second time, to filter by.
    return made.select("doc_id", F.explode_outer("fields").alias("field", "value")).filter("field IS NOT NULL")


# ---- lists ----

_SHOWN = "invoice_id, vendor_name, invoice_number, invoice_date, status, total_amount"
_COLS = _SHOWN.split(", ")


def _list(name: str, where: str, f):
    @query(name, f"SELECT {_SHOWN} FROM fx_invoices WHERE {where}")
    def _(spark, sf):
        return f(load(spark, sf, "fx_invoices")).select(*_COLS)


_list("filter_status", "status = 'POSTED'", lambda df: L.filter_status(df, "POSTED"))
_list("filter_vendor", "vendor_name ILIKE '%r#0000001%'", lambda df: L.filter_vendor(df, "R#0000001"))
_list("filter_number", "invoice_number ILIKE '%inv-1_7%'", lambda df: L.filter_number(df, "inv-1_7"))
_list("filter_date_range", "invoice_date >= DATE '1995-01-01' AND invoice_date <= DATE '1995-06-30'", lambda df: L.filter_date_range(df, "1995-01-01", "1995-06-30"))
_list("search_any", "vendor_name ILIKE '%77%' OR invoice_number ILIKE '%77%' OR original_filename ILIKE '%77%' OR purchase_order ILIKE '%77%'", lambda df: L.search_any(df, "77"))
_COMBINED = L.Filters(status="POSTED", vendor=" 1 ", number="", date_from="1993-01-01", search="INV")
_COMBINED_SQL = "status = 'POSTED' AND vendor_name ILIKE '%1%' AND invoice_date >= DATE '1993-01-01' AND (vendor_name ILIKE '%INV%' OR invoice_number ILIKE '%INV%' OR original_filename ILIKE '%INV%' OR purchase_order ILIKE '%INV%')"
_list("filter_combined", _COMBINED_SQL, lambda df: L.apply_filters(df, _COMBINED))
_list("view_finalized", "status IN ('APPROVED', 'POSTED')", L.view_finalized)
_list("view_review_queue", "status IN ('PROCESSING', 'REVIEW_REQUIRED', 'FAILED', 'REJECTED')", L.view_review_queue)


@query("lookup", f"SELECT {_SHOWN} FROM fx_invoices WHERE file_hash IN (SELECT sha256(CAST(c_custkey AS VARCHAR)) FROM customer)")
def _(spark, sf):
    keys = load(spark, sf, "customer").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("file_hash"))
    return L.lookup(load(spark, sf, "fx_invoices"), keys, "file_hash").select(*_COLS)


@query("batch_slice", "SELECT invoice_id, invoice_number AS title, vendor_name, total_amount FROM fx_invoices WHERE batch_id = 3 AND status = 'APPROVED'")
def _(spark, sf):
    return L.batch_slice(load(spark, sf, "fx_invoices"), 3, "APPROVED")


@query("review_flags", "SELECT invoice_id, status IN ('REVIEW_REQUIRED', 'FAILED') AS can_review, status = 'REJECTED' AS locked FROM fx_invoices")
def _(spark, sf):
    return L.review_flags(load(spark, sf, "fx_invoices")).select("invoice_id", "can_review", "locked")


@query("dirty_flag", "SELECT invoice_id, coalesce(a.vendor_name, '') <> coalesce(b.vendor_name, '') OR a.invoice_number <> b.invoice_number OR coalesce(CAST(a.total_amount AS VARCHAR), '') <> coalesce(CAST(b.total_amount AS VARCHAR), '') AS dirty FROM fx_invoices a JOIN fx_challenger b USING (invoice_id)")
def _(spark, sf):
    return L.dirty_flag(load(spark, sf, "fx_invoices"), load(spark, sf, "fx_challenger"))


_IN_GROUPS = {"A. Basic Information": ("invoice_number", "invoice_date", "purchase_order"), "B. Vendor Details": ("vendor_name",), "C. Financial Details": ("total_amount",)}


@query("field_groups", " UNION ALL ".join(f"SELECT invoice_id, '{g}' AS \"group\", '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM fx_invoices" for g, fs in _IN_GROUPS.items() for f in fs))
def _(spark, sf):
    return L.field_groups(load(spark, sf, "fx_invoices"))


def _order_sql(column: str, way: str) -> str:
    by = f"list_position({list(STATUSES)}, status)" if column == "status" else column
    return f"{by} {'DESC NULLS FIRST' if way == 'desc' else 'ASC NULLS LAST'}, invoice_id"


def _page(name: str, sort: str, way: str, number: int, size: int):
    shown = f"{_SHOWN}, row_number() OVER (ORDER BY {_order_sql(sort, way)}) AS serial"

    @query(name, f"SELECT {shown} FROM fx_invoices ORDER BY {_order_sql(sort, way)} LIMIT {size} OFFSET {(number - 1) * size}")
    def _(spark, sf):
        listed = L.page(L.sorted_list(load(spark, sf, "fx_invoices"), sort, way), number, size)
        return L.serial_number(listed, number, size, L._order(sort, way == "desc"), F.col("invoice_id")).select(*_COLS, F.col("serial").cast("long").alias("serial"))


_page("page", "created_at", "desc", 3, 50)
_page("serial_number", "total_amount", "desc", 2, 25)
_page("sorted_list_by_status", "status", "asc", 1, 200)


@query("page_of_index", f"SELECT {_SHOWN} FROM fx_invoices ORDER BY {_order_sql('total_amount', 'asc')} LIMIT 20 OFFSET 1160")
def _(spark, sf):
    return L.sorted_index(load(spark, sf, "fx_invoices"), new_path(spark), "total_amount", "asc").page(59, 20).select(*_COLS)


_FOUND_SQL = "vendor_name ILIKE '%{0}%' OR invoice_number ILIKE '%{0}%' OR original_filename ILIKE '%{0}%' OR purchase_order ILIKE '%{0}%'"


@query("search_index", " UNION ALL ".join(f"SELECT '{t}' AS search, {_SHOWN} FROM fx_invoices WHERE {_FOUND_SQL.format(t)}" for t in ("INV-1_77", "o-10%7", "7", "no such")))
def _(spark, sf):
    index = L.search_index(load(spark, sf, "fx_invoices"), new_path(spark), 40)
    found = [index.contains(L.SEARCHED, t)[0].select(F.lit(t).alias("search"), *_COLS) for t in ("INV-1_77", "o-10%7", "7", "no such")]
    return reduce(DataFrame.unionAll, found)


@query("sorted_list", f"SELECT {_SHOWN} FROM fx_invoices ORDER BY {_order_sql('total_amount', 'asc')}")
def _(spark, sf):
    return L.sorted_list(load(spark, sf, "fx_invoices"), "total_amount", "asc").select(*_COLS)


@query("filtered_total_pages", f"SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM fx_invoices WHERE {_COMBINED_SQL}")
def _(spark, sf):
    return L.filtered_total_pages(load(spark, sf, "fx_invoices"), _COMBINED, 20)


_ITEMS = "string_agg(line_number || ':' || amount, ',' ORDER BY line_number)"


@query("items_in_order", f"SELECT invoice_id, {_ITEMS} AS items FROM fx_items GROUP BY invoice_id")
def _(spark, sf):
    return L.items_in_order(load(spark, sf, "fx_items")).select("invoice_id", F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["line_number"], i["amount"])), ",").alias("items"))


_TRAIL = "string_agg(log_id || ':' || agent || ':' || level, ',' ORDER BY created_at, log_id)"
_trail = lambda: F.array_join(F.transform("logs", lambda e: F.concat_ws(":", e["log_id"], e["agent"], e["level"])), ",").alias("logs")


@query("audit_trail", f"SELECT invoice_id, {_TRAIL} AS logs FROM fx_logs GROUP BY invoice_id")
def _(spark, sf):
    return L.audit_trail(load(spark, sf, "fx_logs")).select("invoice_id", _trail())


@query("audit_parts", f"""SELECT invoice_id, CAST(part AS INTEGER) AS part, {_TRAIL} AS logs
FROM (SELECT *, (row_number() OVER (PARTITION BY invoice_id ORDER BY created_at NULLS FIRST, log_id) - 1) // 7 AS part FROM fx_logs) GROUP BY ALL""")
def _(spark, sf):
    return L.audit_parts(load(spark, sf, "fx_logs"), 7).select("invoice_id", "part", _trail())


@query("invoice_detail", f"SELECT invoice_id, vendor_name, coalesce(items, '') AS items, coalesce(logs, '') AS logs FROM fx_invoices LEFT JOIN (SELECT invoice_id, {_ITEMS} AS items FROM fx_items GROUP BY 1) USING (invoice_id) LEFT JOIN (SELECT invoice_id, {_TRAIL} AS logs FROM fx_logs GROUP BY 1) USING (invoice_id)")
def _(spark, sf):
    made = L.invoice_detail(load(spark, sf, "fx_invoices"), load(spark, sf, "fx_items"), load(spark, sf, "fx_logs"))
    return made.select("invoice_id", "vendor_name", F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["line_number"], i["amount"])), ",").alias("items"), _trail())


_WHOLE_ITEMS = "string_agg(line_number || ':' || description || ':' || quantity || ':' || unit_price || ':' || amount, ',' ORDER BY line_number)"
_EXTRACTED = ("vendor_name", "invoice_number", "invoice_date", "currency", "subtotal", "tax_amount", "total_amount", "purchase_order")


@query("rebuild_extracted", f"SELECT invoice_id, {', '.join(_EXTRACTED)}, coalesce(items, '') AS items FROM fx_invoices LEFT JOIN (SELECT invoice_id, {_WHOLE_ITEMS} AS items FROM fx_items GROUP BY 1) USING (invoice_id)")
def _(spark, sf):
    made = L.rebuild_extracted(load(spark, sf, "fx_invoices"), load(spark, sf, "fx_items"))
    item = lambda i: F.concat_ws(":", *(i[n] for n in ("line_number", "description", "quantity", "unit_price", "amount")))
    return made.select("invoice_id", *(f"extracted.{n}" for n in _EXTRACTED), F.array_join(F.transform("extracted.items", item), ",").alias("items"))


# ---- figures ----


@query("status_counts", f"SELECT d.status, count(i.invoice_id) AS n, (SELECT count(*) FROM fx_invoices) AS total FROM (SELECT unnest({list(STATUSES)}) AS status) d LEFT JOIN fx_invoices i USING (status) GROUP BY d.status")
def _(spark, sf):
    return S.status_counts(load(spark, sf, "fx_invoices"))


@query("dimension_zero_fill", f"SELECT CAST(list_position({list(STATUSES)}, d.status) - 1 AS INT) AS place, d.status, count(i.invoice_id) AS n FROM (SELECT unnest({list(STATUSES)}) AS status) d LEFT JOIN (SELECT * FROM fx_invoices WHERE total_amount > 1000000) i USING (status) GROUP BY d.status")
def _(spark, sf):
    some = load(spark, sf, "fx_invoices").filter("total_amount > 1000000").groupBy("status").agg(F.count("*").alias("n"))
    return S.dimension_zero_fill(some)


_TODAY = f"count(*) FILTER (WHERE updated_at >= date_trunc('day', TIMESTAMP '{NOW}') AND status IN ('AUTO_APPROVED', 'APPROVED', 'POSTED'))"
_AVG = "round(coalesce(avg(CASE WHEN status <> 'UPLOADED' THEN (epoch_us(updated_at) - epoch_us(created_at)) / 1e6 END), 0), 2)"
_now = lambda: F.lit(NOW).cast("timestamp_ntz")


@query("processed_today", f"SELECT {_TODAY} AS processed_today FROM fx_invoices")
def _(spark, sf):
    return S.processed_today(load(spark, sf, "fx_invoices"), _now())


@query("avg_processing_seconds", f"SELECT {_AVG} AS avg_processing_seconds FROM fx_invoices")
def _(spark, sf):
    return S.avg_processing_seconds(load(spark, sf, "fx_invoices"))


@query("dashboard", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in STATUSES) + f", {_TODAY} AS processed_today, {_AVG} AS avg_processing_seconds FROM fx_invoices")
def _(spark, sf):
    return S.dashboard(load(spark, sf, "fx_invoices"), _now())


@query("batch_distribution", "SELECT batch_id, status, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY batch_id), 1) AS percent FROM fx_invoices GROUP BY batch_id, status")
def _(spark, sf):
    return S.batch_distribution(load(spark, sf, "fx_invoices"))


_BATCHES = "SELECT batch_id, min(created_at) AS created_at, count(*) AS target_count, count(*) FILTER (WHERE status NOT IN ('UPLOADED', 'PROCESSING')) AS processed FROM fx_invoices GROUP BY batch_id"


@query("batch_history", f"SELECT *, row_number() OVER (ORDER BY created_at DESC, batch_id DESC) = 1 AS is_latest FROM ({_BATCHES}) ORDER BY created_at DESC, batch_id DESC LIMIT 50")
def _(spark, sf):
    return S.batch_history(S.batches_of(load(spark, sf, "fx_invoices")))


@query("latest_batch", f"SELECT * FROM ({_BATCHES}) ORDER BY created_at DESC, batch_id DESC LIMIT 1")
def _(spark, sf):
    return S.latest_batch(S.batches_of(load(spark, sf, "fx_invoices")), chosen=-5)


@query("queue_counts", "SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ("PROCESSING", "REVIEW_REQUIRED", "FAILED", "REJECTED")) + ", count(*) FILTER (WHERE status IN ('PROCESSING', 'REVIEW_REQUIRED', 'FAILED', 'REJECTED')) AS total FROM fx_invoices")
def _(spark, sf):
    return S.queue_counts(load(spark, sf, "fx_invoices"))


@query("amount_summary", "SELECT currency, count(*) AS n, CAST(sum(total_amount) AS DECIMAL(24,2)) AS total_amount FROM fx_invoices GROUP BY currency")
def _(spark, sf):
    return S.amount_summary(load(spark, sf, "fx_invoices"))


@query("daily_counts", f"SELECT CAST(day AS DATE) AS day, count(i.invoice_id) AS n FROM (SELECT unnest(generate_series(DATE '1997-06-09', DATE '1997-06-15', INTERVAL 1 DAY)) AS day) LEFT JOIN fx_invoices i ON CAST(i.created_at AS DATE) = day GROUP BY day")
def _(spark, sf):
    return S.daily_counts(load(spark, sf, "fx_invoices"), _now())


@query("append_batch", """WITH p AS (SELECT invoice_id, batch_id, row_number() OVER (PARTITION BY batch_id, invoice_id % 3 = 0 ORDER BY invoice_id) - 1 AS place, invoice_id % 3 = 0 AS new FROM fx_invoices),
n AS (SELECT batch_id, count(*) FILTER (NOT new) AS old FROM p GROUP BY batch_id)
SELECT invoice_id, batch_id, CASE WHEN new THEN old + place ELSE place END AS place FROM p JOIN n USING (batch_id) WHERE NOT new OR batch_id % 5 <> 1""")
def _(spark, sf):
    # Every third invoice comes later; batches of a fifth were cleared before.
    own = load(spark, sf, "fx_invoices").select("invoice_id", "batch_id")
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("invoice_id")).cast("long") - 1
    old, new = (own.filter(c).withColumn("place", place) for c in ("invoice_id % 3 <> 0", "invoice_id % 3 = 0"))
    return S.append_batch(old, new, own.filter("batch_id % 5 <> 1"))


@query("batch_membership", "SELECT invoice_id, batch_id, status FROM fx_invoices WHERE batch_id % 7 <> 2 UNION ALL SELECT invoice_id, batch_id, 'PROCESSING' FROM fx_invoices WHERE batch_id % 7 = 2 AND status = 'FAILED'")
def _(spark, sf):
    df = load(spark, sf, "fx_invoices").select("invoice_id", "batch_id", "status")
    again = df.filter("batch_id % 7 = 2 AND status = 'FAILED'").withColumn("status", F.lit("PROCESSING"))
    # Batches in which nothing failed are emptied first.
    return S.replace_batch(df.filter("batch_id % 7 <> 2 OR status = 'FAILED'"), again)


@query("dataset_counts", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'human_correction' ELSE source END AS source, count(*) AS n, CASE WHEN doc_id % 3 = 0 THEN 'human_correction' ELSE source END = 'human_correction' AND count(*) >= 200 AS retrain FROM documents GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, CASE WHEN doc_id % 3 = 0 THEN 'human_correction' ELSE source END"))
def _(spark, sf):
    docs = load(spark, sf, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "human_correction").otherwise(F.col("source")))
    return S.dataset_counts(docs)


# ---- work ----

_LEGAL = " OR ".join(f"(current = '{a}' AND target IN ({', '.join(map(repr, b))}))" for a, b in TRANSITIONS.items() if b)
_ASKED = "SELECT invoice_id, status AS current, CASE action WHEN 'APPROVE' THEN 'APPROVED' WHEN 'REJECT' THEN 'REJECTED' ELSE 'PROCESSING' END AS target, a.* EXCLUDE (invoice_id) FROM fx_invoices JOIN fx_actions a USING (invoice_id)"


@query("check_transitions", f"SELECT invoice_id, current, target, {_LEGAL} AS legal FROM ({_ASKED})")
def _(spark, sf):
    asked = load(spark, sf, "fx_invoices").join(load(spark, sf, "fx_actions"), "invoice_id").select("invoice_id", F.col("status").alias("current"), W._action_target().alias("target"))
    return W.check_transitions(asked).select("invoice_id", "current", "target", "legal")


# Reviews of invoices: the view's action first, and for some a second one. What is set and to what:
_EDITS = {
    "vendor_name": ("sets_vendor", "new_vendor"),
    "total_amount": ("invoice_id % 7 = 0", "CAST(invoice_id % 1000 AS DECIMAL(14,2))"),
    "purchase_order": ("invoice_id % 9 = 0", "NULL"),
    "invoice_date": ("invoice_id % 11 = 0", "DATE '2024-02-29'"),
}
_STEP = """SELECT i.* REPLACE ({edits}, CASE WHEN ok THEN target ELSE status END AS status, CASE WHEN ok OR edited THEN a.reviewer_id ELSE i.reviewer_id END AS reviewer_id,
  CASE WHEN ok AND a.notes <> '' THEN a.notes ELSE review_notes END AS review_notes, conflicts + CASE WHEN ok THEN 0 WHEN a.invoice_id IS NULL THEN 0 ELSE 1 END AS conflicts)
FROM {before} i LEFT JOIN (SELECT x.*, {legal} AS ok FROM (SELECT a.*, status AS current FROM {actions} a JOIN {before} USING (invoice_id)) x) a ON a.invoice_id = i.invoice_id"""
_SET = ", ".join(f"CASE WHEN sets_{n} THEN new_{n} ELSE i.{n} END AS {n}" for n in _EDITS)
_FIRST_ACTIONS = "SELECT invoice_id, CASE action WHEN 'APPROVE' THEN 'APPROVED' WHEN 'REJECT' THEN 'REJECTED' ELSE 'PROCESSING' END AS target, reviewer_id, notes, " + ", ".join(f"{on} AS sets_{n}, {to} AS new_{n}" for n, (on, to) in _EDITS.items()) + f", {' OR '.join(on for on, _ in _EDITS.values())} AS edited FROM fx_actions"
_SECOND_ACTIONS = "SELECT invoice_id, 'REJECTED' AS target, 99 AS reviewer_id, 'twice' AS notes, " + ", ".join(f"{'true' if n == 'vendor_name' else 'false'} AS sets_{n}, {chr(39) + 'Second' + chr(39) if n == 'vendor_name' else 'NULL'} AS new_{n}" for n in _EDITS) + ", true AS edited FROM fx_actions WHERE invoice_id % 5 = 1"
_STATE = f"SELECT invoice_id, {', '.join(_EDITS)}, status, CASE WHEN invoice_id % 3 = 0 THEN CAST(77 AS BIGINT) END AS reviewer_id, CAST(NULL AS VARCHAR) AS review_notes, 0 AS conflicts FROM fx_invoices"
_REVIEWED = f"""WITH first AS ({_FIRST_ACTIONS}), second AS ({_SECOND_ACTIONS}), s0 AS ({_STATE}),
s1 AS ({_STEP.format(edits=_SET, before='s0', actions='first', legal=_LEGAL)}), s2 AS ({_STEP.format(edits=_SET, before='s1', actions='second', legal=_LEGAL)})
SELECT invoice_id, {', '.join(_EDITS)}, status, reviewer_id, review_notes, conflicts FROM s2"""


@query("apply_review", _REVIEWED)
def _(spark, sf):
    invoices = load(spark, sf, "fx_invoices").withColumn("reviewer_id", F.when(F.col("invoice_id") % 3 == 0, F.lit(77).cast("long")))
    actions = load(spark, sf, "fx_actions")
    shape = "struct<" + ",".join(f"{n}:{invoices.schema[n].dataType.simpleString()}" for n in _EDITS) + ">"
    edits = F.struct(*(F.expr(to).alias(n) for n, (_, to) in _EDITS.items())).cast(shape)
    names = F.array_compact(F.array(*(F.when(F.expr(on), n) for n, (on, _) in _EDITS.items())))
    first = actions.select("invoice_id", F.lit(1).alias("seq"), "action", names.alias("set_fields"), edits.alias("edits"), "reviewer_id", "notes")
    again = F.struct(*(F.lit("Second" if n == "vendor_name" else None).alias(n) for n in _EDITS)).cast(shape)
    second = actions.filter("invoice_id % 5 = 1").select(
        "invoice_id", F.lit(2).alias("seq"), F.lit("REJECT").alias("action"), F.array(F.lit("vendor_name")).alias("set_fields"), again.alias("edits"), F.lit(99).cast("long").alias("reviewer_id"), F.lit("twice").alias("notes")
    )
    reviewed = W.apply_review(invoices, first.unionByName(second))
    return reviewed.select("invoice_id", *_EDITS, "status", "reviewer_id", "review_notes", "conflicts")


@query("replace_items", "SELECT invoice_id, line_number, description, amount FROM fx_items WHERE invoice_id % 5 <> 0 UNION ALL SELECT invoice_id, 1, 'Whole order', CAST(sum(amount) AS DECIMAL(14,2)) FROM fx_items WHERE invoice_id % 5 = 0 GROUP BY invoice_id")
def _(spark, sf):
    items = load(spark, sf, "fx_items").select("invoice_id", "line_number", "description", "amount")
    new = items.filter("invoice_id % 5 = 0").groupBy("invoice_id").agg(F.sum("amount").cast("decimal(14,2)").alias("amount")).select("invoice_id", F.lit(1).alias("line_number"), F.lit("Whole order").alias("description"), "amount")
    return W.replace_items(items, new)


def _vendors(spark, sf):
    """The vendors, some of them listed twice: the smaller id counts."""
    once = load(spark, sf, "fx_vendors")
    twice = once.filter("vendor_id LIKE '%7'").withColumn("vendor_id", F.concat("vendor_id", F.lit("-old")))
    return once.unionByName(twice)


@query("reference_data_check", "SELECT invoice_id, v.vendor_id, v.vendor_id IS NOT NULL AS vendor_valid, i.purchase_order IS NULL OR p.purchase_order IS NOT NULL AS po_valid, CASE WHEN v.vendor_id IS NOT NULL AND (i.purchase_order IS NULL OR p.purchase_order IS NOT NULL) THEN 'ok' ELSE 'partial' END AS message FROM fx_invoices i LEFT JOIN fx_vendors v USING (vendor_name) LEFT JOIN fx_purchase_orders p ON p.purchase_order = i.purchase_order")
def _(spark, sf):
    return W.reference_data_check(load(spark, sf, "fx_invoices"), _vendors(spark, sf), load(spark, sf, "fx_purchase_orders"))


@query("posting_payload", "SELECT invoice_id, CASE WHEN ok THEN vendor_id END AS vendor_id, CASE WHEN ok THEN invoice_number END AS invoice_number, CASE WHEN ok THEN CAST(total_amount AS VARCHAR) END AS total, CASE WHEN ok THEN currency END AS currency, CASE WHEN ok THEN strftime(invoice_date, '%Y-%m-%d') END AS invoice_date, CASE WHEN NOT ok THEN 'bad status: ' || status END AS skipped FROM (SELECT *, status IN ('AUTO_APPROVED', 'APPROVED') AS ok FROM fx_invoices LEFT JOIN fx_vendors USING (vendor_name))")
def _(spark, sf):
    return W.posting_payload(load(spark, sf, "fx_invoices"), _vendors(spark, sf))


@query("item_constraints", "SELECT invoice_id, line_number, CASE WHEN line_number - 2 < 1 THEN 'line_number,' ELSE '' END || CASE WHEN amount - 500 < 0 THEN 'amount' ELSE '' END AS violations FROM fx_items")
def _(spark, sf):
    items = load(spark, sf, "fx_items").withColumns({"_n": F.col("line_number"), "line_number": F.col("line_number") - 2, "amount": F.col("amount") - 500})
    made = W.item_constraints(items)
    both = F.concat(F.when(F.array_contains("violations", "line_number"), "line_number,").otherwise(""), F.when(F.array_contains("violations", "amount"), "amount").otherwise(""))
    return made.select("invoice_id", F.col("_n").alias("line_number"), both.alias("violations"))


_EXT = "CASE WHEN contains(filename, '.') THEN lower(regexp_extract(filename, '[^.]*$')) ELSE '' END"


@query("ingest_gate", f"SELECT doc_id, filename, CASE WHEN size_bytes > 26214400 THEN 'FILE_TOO_LARGE' WHEN {_EXT} NOT IN ('pdf', 'png', 'jpg', 'jpeg', 'tiff', 'tif') THEN 'UNSUPPORTED_FILE_TYPE' END AS reject_reason FROM fx_uploads")
def _(spark, sf):
    return W.ingest_gate(load(spark, sf, "fx_uploads")).select("doc_id", "filename", "reject_reason")


@query("content_key", "SELECT doc_id, file_hash, 'invoices/' || substr(file_hash, 1, 2) || '/' || file_hash || '_' || filename AS storage_key, 'application/octet-stream' AS mime_type FROM fx_uploads")
def _(spark, sf):
    return W.content_key(load(spark, sf, "fx_uploads")).select("doc_id", "file_hash", "storage_key", "mime_type")


@query("dedup_first_wins", "SELECT doc_id, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY doc_id) > 1 AS duplicate FROM fx_uploads")
def _(spark, sf):
    return W.dedup_first_wins(load(spark, sf, "fx_uploads")).select("doc_id", "file_hash", "duplicate")


@query("reject_known_hash", "SELECT doc_id, file_hash FROM fx_uploads WHERE doc_id % 2 = 1 AND file_hash NOT IN (SELECT file_hash FROM fx_uploads WHERE doc_id % 2 = 0)")
def _(spark, sf):
    uploads = load(spark, sf, "fx_uploads").select("doc_id", "file_hash")
    return W.reject_known_hash(uploads.filter("doc_id % 2 = 1"), uploads.filter("doc_id % 2 = 0"))
