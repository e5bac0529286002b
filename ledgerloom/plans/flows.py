"""Queries over annotation files, streams and extensions, from data derived from the tables."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..fixtures import load, load_pages, oracle, sql, store_view
from ..operators import extend
from ..operators.tokens import _sizes, _slices
from ..schemas import TRANSITIONS
from ..sources import annotations as A
from ..storage import Store, key_buckets, new_path, write_tables
from ..streaming import flows as S
from ..streaming.retrain import stream_retrain
from .invoices import _MATCH
from .pages import _LOOSE, PARSED_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return add


def _pages(spark, sf, columns, entry):
    """(stem, list) of a document's words, each made by entry from these columns of a word."""
    pages = load_pages(spark, sf, *columns.split(", "))
    return pages.select(F.col("doc_id").cast("string").alias("stem"), F.explode_outer(F.array(F.transform("words", entry))).alias("list"))


def _json_pages(spark, sf, outer, inner, at, confidence=False):
    """(stem, value): a document as JSON of an outer list with one inner list of its words, each as text,
    its confidence if asked for, and what at(pos) gives. That is made once for a place, not for each word."""
    scores = pa.array([f'"confidence":{k / 1000},' if confidence else "" for k in range(1000)])

    def quoted(words):
        if pc.any(pc.match_substring_regex(words, r"[\x00-\x1f]")).as_py():
            return pa.array([json.dumps(w, ensure_ascii=False) for w in words.to_pylist()], pa.string())
        plain = pc.replace_substring(pc.replace_substring(words, "\\", "\\\\"), '"', '\\"')
        return pc.binary_join_element_wise('"', plain, '"', "")

    def run(batches):
        places = pa.array([], pa.string())
        for batch in batches:
            for part in _slices(batch, _sizes(batch.column("words"))):
                n = _sizes(part.column("words"))
                ends = np.concatenate([[0], np.cumsum(n)])
                pos = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
                if n.max() > len(places):
                    places = pa.array([json.dumps(at(k), separators=(",", ":"))[1:] for k in range(n.max())])
                number = (np.repeat(part.column("doc_id").to_numpy(), n) * 17 + pos * 29) % 1000
                words = pc.binary_join_element_wise('{"text":', quoted(part.column("words").flatten()), ",", scores.take(pa.array(number)), places.take(pa.array(pos)), "")
                lists = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), ",")
                values = pc.binary_join_element_wise(f'{{"{outer}":[{{"{inner}":[', lists, "]}]}", "")
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), values], names=["stem", "value"])

    pages = load_pages(spark, sf, "word").select("doc_id", F.col("words.word").alias("words"))
    return pages.mapInArrow(run, "stem string, value string")


_BOX = "x0, y0, x1, y1"
_WORD = f"word, {_BOX}"


def _box_at(k):
    """The box of a document's k-th word, as fx_labels has it."""
    return [k % 10 * 100, k // 10 * 20, k % 10 * 100 + 80, k // 10 * 20 + 15]


def _box(w):
    return F.array(*(w[c] for c in _BOX.split(", ")))


@query("read_funsd", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, pos, word, {_BOX}, 'O' AS label FROM fx_labels")
def _(spark, sf):
    return A.read_funsd(_json_pages(spark, sf, "form", "words", lambda k: {"box": _box_at(k)}))


_CATEGORY = "CASE pos % 4 WHEN 0 THEN 'menu.nm' WHEN 1 THEN 'menu.price' WHEN 2 THEN 'total.tax_price' ELSE 'void' END"


@query("read_cord", f"WITH f AS (SELECT doc_id, pos, word, {_BOX}, CASE CAST(floor(pos / 2.0) AS BIGINT) % 4 WHEN 0 THEN 'line_item_description' WHEN 1 THEN 'line_item_amount' WHEN 2 THEN 'tax_amount' END AS field FROM fx_labels) SELECT CAST(doc_id AS VARCHAR) AS doc_id, pos, word, {_BOX}, CASE WHEN field IS NULL THEN 'O' WHEN lag(field) OVER (PARTITION BY doc_id ORDER BY pos) = field THEN 'I-' || upper(field) ELSE 'B-' || upper(field) END AS label FROM f")
def _(spark, sf):
    quad = lambda w: F.struct(*(w[c].alias(n) for n, c in (("x1", "x0"), ("y1", "y0"), ("x2", "x1"), ("y2", "y0"), ("x3", "x1"), ("y3", "y1"), ("x4", "x0"), ("y4", "y1"))))
    kind = lambda w: F.element_at(F.array(*map(F.lit, ("menu.nm", "menu.price", "total.tax_price", "void"))), (F.floor(w["pos"] / 2) % 4 + 1).cast("int"))
    line = lambda w: F.struct(kind(w).alias("category"), F.array(F.struct(w["word"].alias("text"), quad(w).alias("quad"))).alias("words"))
    pages = _pages(spark, sf, f"pos, {_WORD}", line).select("stem", F.to_json(F.struct(F.col("list").alias("valid_line"))).alias("value"))
    return A.read_cord(pages)


def _sroie(spark, sf):
    pages = _pages(spark, sf, _WORD, lambda w: F.concat_ws(",", *(w[c] for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1", "word"))))
    boxes = pages.select("stem", F.concat(F.array_join("list", "\n"), F.lit("\nbroken,line\n1,2,3,4,5,6,7,8, ")).alias("value"))
    entity = F.to_json(F.create_map(F.lit("company"), F.substring_index(F.get("list", F.lit(2)), ",", -1), F.lit("other"), F.lit("x")))
    return pages, boxes, pages.select("stem", entity.alias("value"))


_ENTITY = "regexp_replace(word, '^.*,', '')"


@query("read_sroie", f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, pos, word, {_BOX}, CASE WHEN t = known THEN 'B-VENDOR_NAME' ELSE 'O' END AS label
FROM (SELECT *, {_LOOSE.format('word')} AS t, max(CASE WHEN pos = 2 AND {_ENTITY} <> '' THEN {_LOOSE.format(_ENTITY)} END) OVER (PARTITION BY doc_id) AS known FROM fx_labels)""")
def _(spark, sf):
    _, boxes, entities = _sroie(spark, sf)
    return A.read_sroie(boxes, entities)


@query("stem_join", f"""SELECT CAST(doc_id AS VARCHAR) AS stem, count(*) + 2 AS lines, coalesce(max(CASE WHEN pos = 2 THEN {_ENTITY} END), '') AS company FROM fx_words
WHERE doc_id % 3 = 0 AND doc_id % 2 = 0 GROUP BY 1""")
def _(spark, sf):
    pages, boxes, entities = _sroie(spark, sf)
    joined = A.stem_join(pages.filter("CAST(stem AS INT) % 3 = 0"), boxes.filter("CAST(stem AS INT) % 2 = 0"), entities)
    company = F.coalesce(F.get_json_object("entities", "$.company"), F.lit(""))
    return joined.select("stem", F.size(F.split("boxes", "\n")).cast("long").alias("lines"), company.alias("company"))


_ALL_WORDS = "string_agg(word, ' ' ORDER BY pos)"


@query("require_image", f"SELECT CAST(doc_id AS VARCHAR) AS stem, count(*) AS n, sha256({_ALL_WORDS}) AS words FROM fx_words WHERE doc_id % 3 = 0 GROUP BY doc_id")
def _(spark, sf):
    pages = _pages(spark, sf, "word", lambda w: w["word"])
    images = load(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("stem"))
    kept = A.require_image(pages, images)
    return kept.select("stem", F.size("list").cast("long").alias("n"), _digest(F.col("list")).alias("words"))


def _digest(words):
    return F.sha2(F.array_join(words, " "), 256)


@query("import_labeling_results", """WITH w AS (SELECT *, (x0 + x1) / 2.0 BETWEEN -25 AND 225 AND (y0 + y1) / 2.0 BETWEEN -3.75 AND 33.75 AS hit FROM fx_labels)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, pos, word, CASE WHEN NOT hit THEN 'O' WHEN row_number() OVER (PARTITION BY doc_id, hit ORDER BY pos) = 1 THEN 'B-VENDOR_NAME' ELSE 'I-VENDOR_NAME' END AS label FROM w""")
def _(spark, sf):
    pages = _pages(spark, sf, _WORD, lambda w: F.struct(w["word"].alias("word"), _box(w).alias("box")))
    data = F.struct(F.lit("i.png").alias("image"), F.transform("list", lambda w: w["word"]).alias("words"), F.transform("list", lambda w: w["box"]).alias("bboxes"))
    shape = lambda name: F.expr(f"named_struct('original_width', 1000.0D, 'original_height', 500.0D, 'value', named_struct('x', 0.0D, 'y', 0.0D, 'width', 20.0D, 'height', 6.0D, 'rectanglelabels', array('{name}')))")
    task = F.struct(data.alias("data"), F.array(F.struct(F.array(shape("VENDOR_NAME"), shape("NOT_A_FIELD")).alias("result"))).alias("annotations"))
    return A.import_labeling_results(pages.select("stem", F.to_json(task).alias("value")))


def _examples(spark, sf):
    pages = _pages(spark, sf, _WORD, lambda w: F.struct(w["word"].alias("word"), _box(w).cast("array<int>").alias("box")))
    part = lambda name: F.transform("list", lambda w: w[name])
    labels = F.array_repeat(F.when(F.col("stem").cast("int") % 4 == 0, "B-OTHER").otherwise("O"), F.size("list"))
    return pages.select("stem", F.concat("stem", F.lit(".png")).alias("image"), part("word").alias("words"), part("box").alias("bboxes"), labels.alias("labels"), F.array(F.lit(1000), F.lit(500)).alias("image_size"))


_WRITTEN = """SELECT CAST(doc_id AS VARCHAR) AS stem, count(*) AS n, sha256(string_agg(word, ' ' ORDER BY pos)) AS words,
sum(x0 + 3 * y0 + 5 * x1 + 7 * y1) AS boxes, 'O' AS labels FROM fx_labels WHERE doc_id % 4 <> 0 GROUP BY doc_id"""


def _summary(df):
    """What an example holds, in columns that SQL can make too."""
    boxes = F.aggregate("bboxes", F.lit(0).cast("long"), lambda a, b: a + b[0] + 3 * b[1] + 5 * b[2] + 7 * b[3])
    labels = F.array_join(F.array_distinct("labels"), ",")
    return df.select("stem", F.size("words").cast("long").alias("n"), _digest(F.col("words")).alias("words"), boxes.alias("boxes"), labels.alias("labels"))


@query("write_examples", _WRITTEN)
def _(spark, sf):
    path = new_path(spark)
    A.write_examples(_examples(spark, sf), path)
    return _summary(spark.read.schema("stem string, words array<string>, bboxes array<array<int>>, labels array<string>").json(path))


@query("read_examples", _WRITTEN + " HAVING doc_id % 3 <> 0")
def _(spark, sf):
    # Written without a check, so that the reader meets bad examples; images of some are missing.
    path = new_path(spark)
    made = _examples(spark, sf)
    one = F.to_json(F.struct("image", "words", "bboxes", "labels", "image_size"))
    made.select(one.alias("value")).write.text(path)
    images = load(spark, sf, "documents").filter("doc_id % 3 <> 0").select(F.concat(F.lit("in/"), "doc_id", F.lit(".png")).alias("path"))
    stems = A.stem(F.get_json_object("value", "$.image"))
    good, _ = A.parse_examples(spark.read.text(path).select(stems.alias("stem"), F.lit("in/").alias("folder"), "value"), images)
    return _summary(good)


@query("export_labeling_tasks", "SELECT '/data/' || doc_id || '.png' AS image, CAST(doc_id AS VARCHAR) AS source_file, count(*) AS n, sha256(string_agg(word, ' ' ORDER BY pos)) AS words, CASE WHEN doc_id % 4 = 0 THEN 'B-OTHER' ELSE 'O' END AS labels FROM fx_words GROUP BY doc_id")
def _(spark, sf):
    tasks = A.export_labeling_tasks(_examples(spark, sf), "/data/")
    return tasks.select("data.image", "meta.source_file", F.size("data.words").cast("long").alias("n"), _digest(F.col("data.words")).alias("words"), F.array_join(F.array_distinct("data.suggested_labels"), ",").alias("labels"))


def _first_equal(place: int) -> str:
    """Words that loosely equal the word at a place of their document, as labels."""
    return f"""SELECT doc_id, pos, word, CASE WHEN t = known THEN 'B-VENDOR_NAME' ELSE 'O' END AS label
FROM (SELECT *, max(CASE WHEN pos = {place} THEN t END) OVER (PARTITION BY doc_id) AS known FROM (SELECT *, {_LOOSE.format('word')} AS t FROM fx_words))"""


_FEEDBACK = f"SELECT *, 'human_correction' AS source FROM ({_first_equal(5)})"


@query("append_feedback", _FEEDBACK)
def _(spark, sf):
    words = load(spark, sf, "fx_words")
    values = words.filter("pos = 5").select("doc_id", F.lit("vendor_name").alias("field"), F.col("word").alias("value"))
    return A.append_feedback(words, values).select("doc_id", "pos", "word", "label", "source")


@query("feedback_manifest", """SELECT CAST(doc_id AS VARCHAR) AS sample_id, doc_id || '.json' AS json,
  'invoice_number=' || coalesce(max(CASE WHEN pos = 7 THEN word END), '-') || ';vendor_name=' || max(CASE WHEN pos = 5 THEN word END) AS fields
FROM fx_words GROUP BY doc_id HAVING max(pos) >= 5""")
def _(spark, sf):
    words = load(spark, sf, "fx_words")
    names = F.when(F.col("pos") == 5, "vendor_name").otherwise("invoice_number")
    values = words.filter("pos IN (5, 7)").select("doc_id", names.alias("field"), F.col("word").alias("value"))
    made = A.feedback_manifest(words, values.unionAll(values))
    shown = [F.concat(F.lit(f"{n}="), F.coalesce(F.col("fields")[n], F.lit("-"))) for n in ("invoice_number", "vendor_name")]
    return made.select("sample_id", "json", F.concat_ws(";", *shown).alias("fields"))


# Analyses as the cloud service writes them. By id: values are objects, numbers, texts or missing, some
# of a wrong type, some without a confidence; items lack fields.
_MONEY_JSON = """CASE {id} % 7 WHEN 0 THEN concat('{{"value": ', {c}, ', "content": "x"') WHEN 1 THEN concat('{{"value": "', {c}, '"')
  WHEN 2 THEN concat('{{"value": null, "content": "', {c}, '"') WHEN 3 THEN '{{"value": [1], "content": "5"'
  ELSE concat('{{"value": {{"amount": ', {c}, ', "code": "', currency, '"}}, "content": "x"') END"""


def _money(column: str, shift: int, confidence: str) -> str:
    """JSON of a field of money, or null where the column is null."""
    leaf = _MONEY_JSON.format(id=f"(invoice_id + {shift})", c=f"CAST({column} AS STRING)")
    return f"""concat('"', '{confidence}', '": ', CASE WHEN {column} IS NULL THEN 'null' ELSE concat({leaf}, CASE WHEN invoice_id % 5 = 0 THEN '}}' ELSE ', "confidence": 0.9}}' END) END)"""


_ANALYSES = f"""SELECT CAST(invoice_id AS STRING) AS stem, CASE WHEN invoice_id % 13 = 0 THEN '{{"documents": []}}' WHEN invoice_id % 13 = 1 THEN '{{broken' ELSE
concat('{{"documents": [{{"fields": {{', concat_ws(', ',
  concat('"VendorName": {{"value": ', CASE WHEN invoice_id % 3 = 0 THEN 'null' WHEN invoice_id % 3 = 1 THEN '7' ELSE concat('"', vendor_name, '"') END, ', "content": "', upper(vendor_name), '", "confidence": 0.8}}'),
  concat('"InvoiceId": {{"content": "', invoice_number, '"}}'),
  concat('"InvoiceDate": {{"value": "', CASE WHEN invoice_id % 4 = 0 THEN 'soon' ELSE CAST(invoice_date AS STRING) END, '", "confidence": 0.7}}'),
  concat('"DueDate": {{"value": ', CASE WHEN invoice_id % 4 = 1 THEN '20' ELSE concat('"', CAST(date_add(invoice_date, 30) AS STRING), '"') END, '}}'),
  concat('"Currency": {{"value": "', currency, '"}}'),
  CASE WHEN purchase_order IS NOT NULL THEN concat('"PurchaseOrder": {{"value": ', CASE WHEN invoice_id % 2 = 0 THEN concat('"', purchase_order, '"') ELSE substr(purchase_order, 4) END, '}}') END,
  {_money("total_amount", 0, "InvoiceTotal")}, {_money("subtotal", 2, "SubTotal")}, {_money("tax_amount", 5, "TotalTax")},
  concat('"Items": {{"value": [', coalesce(items, ''), ']}}')), '}}}}, {{"fields": {{}}}}]}}') END AS value
FROM fx_invoices LEFT JOIN (SELECT invoice_id, array_join(transform(array_sort(collect_list(struct(line_number, line))), x -> x.line), ', ') AS items
  FROM (SELECT invoice_id, line_number, concat('{{"value": {{', concat_ws(', ',
    CASE WHEN line_number % 3 > 0 THEN concat('"Description": {{"value": "', description, '"}}') END,
    CASE WHEN line_number % 4 > 0 THEN concat('"Quantity": {{"value": ', CAST(quantity AS STRING), '}}') END,
    CASE WHEN line_number % 5 > 0 THEN concat('"UnitPrice": {{"value": {{"amount": ', CAST(unit_price AS STRING), '}}}}') END,
    CASE WHEN line_number % 2 > 0 THEN concat('"Amount": {{"value": ', CAST(amount AS STRING), '}}') END), '}}}}') AS line FROM fx_items) GROUP BY 1) USING (invoice_id)"""


def _money_sql(column: str, shift: int) -> str:
    return f"CASE WHEN (invoice_id + {shift}) % 7 <> 3 THEN {column} END"


def _score(column: str, score: str = "0.9") -> str:
    return f"CASE WHEN {column} IS NOT NULL AND invoice_id % 5 <> 0 THEN {score} ELSE 0 END"


_READ_LINES = """string_agg(line_number || ':' || CASE WHEN line_number % 3 > 0 THEN description ELSE 'N/A' END || ':' || CASE WHEN line_number % 4 > 0 THEN quantity ELSE 1 END
  || ':' || CASE WHEN line_number % 5 > 0 THEN unit_price ELSE 0 END || ':' || CASE WHEN line_number % 2 > 0 THEN amount ELSE 0 END, ',' ORDER BY line_number)"""
_ANALYSED = f"""WITH read AS (SELECT *, true AS found FROM fx_invoices WHERE invoice_id % 13 > 1),
lines AS (SELECT invoice_id, {_READ_LINES} AS items FROM fx_items WHERE invoice_id % 13 > 1 GROUP BY 1)
SELECT CAST(invoice_id AS VARCHAR) AS doc_id, CASE invoice_id % 3 WHEN 0 THEN upper(vendor_name) WHEN 2 THEN vendor_name END AS vendor_name, invoice_number,
  CASE WHEN invoice_id % 4 <> 0 THEN invoice_date END AS invoice_date, CASE WHEN invoice_id % 4 <> 1 THEN invoice_date + 30 END AS due_date,
  CASE WHEN found IS NULL THEN 'USD' ELSE currency END AS currency,
  {_money_sql("subtotal", 2)} AS subtotal, {_money_sql("tax_amount", 5)} AS tax_amount, {_money_sql("total_amount", 0)} AS total_amount,
  CASE WHEN invoice_id % 2 = 0 THEN purchase_order ELSE substr(purchase_order, 4) END AS purchase_order,
  CAST(CASE WHEN found IS NULL THEN 0 ELSE 0.8 END AS DOUBLE) AS c_vendor, CAST(0 AS DOUBLE) AS c_number, CAST(CASE WHEN found IS NULL THEN 0 ELSE 0.7 END AS DOUBLE) AS c_date,
  CAST({_score("total_amount")} AS DOUBLE) AS c_total, CAST({_score("subtotal")} AS DOUBLE) AS c_subtotal, CAST({_score("tax_amount")} AS DOUBLE) AS c_tax,
  coalesce(items, '') AS items, CASE WHEN found IS NULL THEN 'no document' END AS error
FROM (SELECT invoice_id FROM fx_invoices) LEFT JOIN read USING (invoice_id) LEFT JOIN lines USING (invoice_id)"""


@query("flatten_analysis_result", _ANALYSED)
def _(spark, sf):
    made = A.flatten_analysis_result(sql(spark, sf, _ANALYSES))
    line = lambda i: F.concat_ws(":", i["line_number"], i["description"], i["quantity"], i["unit_price"], i["amount"])
    scores = {"c_vendor": "vendor_name", "c_number": "invoice_number", "c_date": "invoice_date", "c_total": "total_amount", "c_subtotal": "subtotal", "c_tax": "tax_amount"}
    return made.select(
        "doc_id", "vendor_name", "invoice_number", "invoice_date", "due_date", "currency", "subtotal", "tax_amount", "total_amount", "purchase_order",
        *(F.col("confidence_scores")[f].alias(c) for c, f in scores.items()), F.array_join(F.transform("items", line), ",").alias("items"), "error",
    )


@query("flatten_ocr_pages", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, pos AS line, word AS text, confidence, {_BOX} FROM fx_labels")
def _(spark, sf):
    def at(k):
        x0, y0, x1, y1 = (v + d for v, d in zip(_box_at(k), (0.4, 0.4, -0.4, -0.4), strict=True))
        return {"polygon": [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]}

    return A.flatten_ocr_pages(_json_pages(spark, sf, "pages", "lines", at, confidence=True))


# ---- streams: each runs through the table and gives what it wrote ----


def _stream(spark, sf, name):
    schema = load(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


def _finished(start, spark):
    path = new_path(spark)
    start(path, f"{path}-checkpoint").awaitTermination()
    return spark.read.parquet(path)


def _uploads(docs):
    ends = F.array(*map(F.lit, (".pdf", ".PNG", ".jpg", ".jpeg", ".tiff", ".tif", ".exe", "")))
    return docs.select("doc_id", F.concat(F.lit("doc_"), "doc_id", F.element_at(ends, (F.col("doc_id") % 8 + 1).cast("int"))).alias("filename"), F.col("text").alias("content"), (F.octet_length("text") * 1024).alias("size_bytes"))


@query("stream_ingest", "SELECT DISTINCT file_hash FROM fx_uploads WHERE size_bytes <= 26214400 AND doc_id % 8 < 6")
def _(spark, sf):
    uploads = _uploads(_stream(spark, sf, "documents"))
    return _finished(lambda p, c: S.stream_ingest(uploads, p, c), spark).select("file_hash")


_TARGETS = ("PROCESSING", "REVIEW_REQUIRED", "APPROVED", "POSTED", "FAILED")
_LEGAL = " OR ".join(f"({{0}} = '{a}' AND {{1}} IN ({', '.join(map(repr, b))}))" for a, b in TRANSITIONS.items() if b)
_ASKED = f"""SELECT user_id AS id, event_id AS seq, ts, list_extract({list(_TARGETS)}, CAST(event_id % 5 + 1 AS BIGINT)) AS target,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events"""
_STEPS = f"""WITH RECURSIVE asked AS MATERIALIZED ({_ASKED}),
steps AS (SELECT id, seq, k, ts, 'UPLOADED' AS current, target, {_LEGAL.format("'UPLOADED'", "target")} AS accepted FROM asked WHERE k = 1
  UNION ALL SELECT id, seq, k, ts, current, target, {_LEGAL.format("current", "target")} FROM (
    SELECT a.id, a.seq, a.k, a.ts, CASE WHEN s.accepted THEN s.target ELSE s.current END AS current, a.target FROM steps s JOIN asked a ON a.id = s.id AND a.k = s.k + 1))"""


def _machine(spark, sf) -> Store:
    """The store of a stream through all events."""
    path = new_path(spark)
    target = F.element_at(F.array(*map(F.lit, _TARGETS)), (F.col("event_id") % 5 + 1).cast("int"))
    asked = _stream(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), target.alias("target"), F.col("ts").alias("at"))
    S.stream_status_machine(asked, path, f"{path}-checkpoint").awaitTermination()
    return Store(spark, path, key="id")


@query("stream_status_machine", f"{_STEPS} SELECT id, seq, current, target, accepted, CASE WHEN accepted AND target = 'POSTED' THEN ts END AS posted_at FROM steps")
def _(spark, sf):
    return _machine(spark, sf).read("changes")


@query("stream_statuses", f"""{_STEPS} SELECT id, arg_max(CASE WHEN accepted THEN target ELSE current END, k) AS status,
  max(CASE WHEN accepted AND target = 'POSTED' THEN ts END) AS posted_at FROM steps GROUP BY id""")
def _(spark, sf):
    return _machine(spark, sf).read("statuses")


@query("stream_retrain", """WITH e AS (SELECT event_id, ts, event_id % 350 = 0 AS trained FROM events),
s AS (SELECT *, sum(CASE WHEN trained THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS segment FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY segment, trained ORDER BY event_id) AS k FROM s)
SELECT event_id AS seq, ts AS at FROM c WHERE NOT trained AND k % 200 = 0""")
def _(spark, sf):
    kind = F.when(F.col("event_id") % 350 == 0, "training").otherwise("correction")
    path, events = new_path(spark), _stream(spark, sf, "events").select(F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").alias("at"))
    stream_retrain(events, path, f"{path}-checkpoint").awaitTermination()
    return Store(spark, path, key="counter").read("flags").select("seq", "at")


@query("stream_retry_dlq", "SELECT event_id AS id, event_id % 6 AS attempt, CASE WHEN event_id % 6 > 3 THEN 'dead_letter' ELSE 'retry' END AS route, CASE WHEN event_id % 6 <= 3 THEN least(60.0, pow(2, event_id % 6)) END AS delay_s FROM events WHERE event_type = 'error'")
def _(spark, sf):
    failed = _stream(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), (F.col("event_id") % 6).alias("attempt"))
    return _finished(lambda p, c: S.stream_retry_dlq(failed, p, c), spark).select("id", "attempt", "route", "delay_s")


@query("stream_auto_post", """SELECT invoice_id, arg_min(approved_as, (o_orderdate, approved_as)) AS approved_as, 'POSTED' AS status, min(o_orderdate) AS posted_at
FROM (SELECT o_custkey AS invoice_id, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN 'AUTO_APPROVED' ELSE 'APPROVED' END AS approved_as FROM orders WHERE o_orderkey % 3 < 2) GROUP BY 1""")
def _(spark, sf):
    path, status = new_path(spark), F.element_at(F.array(*map(F.lit, ("AUTO_APPROVED", "APPROVED", "FAILED"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    approved = _stream(spark, sf, "orders").select(F.col("o_custkey").alias("invoice_id"), status.alias("status"), F.col("o_orderdate").alias("at"))
    S.stream_auto_post(approved, path, f"{path}-checkpoint").awaitTermination()
    return Store(spark, path).read("posted")


@query("stream_audit", "SELECT log_id, invoice_id, agent FROM fx_logs")
def _(spark, sf):
    logs = _stream(spark, sf, "events").select(F.col("event_id").alias("log_id"), F.col("user_id").alias("invoice_id"), F.col("event_type").alias("agent"))
    return _finished(lambda p, c: S.stream_audit(logs, p, c), spark)


@query("stream_dashboard", "SELECT event_type AS status, count(*) AS count FROM events GROUP BY 1")
def _(spark, sf):
    changes, path = _stream(spark, sf, "events").select(F.col("event_type").alias("status")), new_path(spark)
    S.stream_dashboard(changes, path, f"{path}-checkpoint").awaitTermination()
    return S.latest_dashboard(spark, path)


@query("stream_feedback", _first_equal(0))
def _(spark, sf):
    first = F.regexp_extract("text", r"^\s*(\S+)", 1)
    corrections = _stream(spark, sf, "documents").select("doc_id", F.lit("vendor_name").alias("field"), first.alias("value"))
    made = _finished(lambda p, c: S.stream_feedback(corrections, load(spark, sf, "fx_words"), p, c), spark)
    return made.select("doc_id", "pos", "word", "label")


# ---- models of one's own ----


def _opening():
    def call(text):
        if len(text) < 100:
            raise ValueError("too short")
        return f"{len(text)} {text[:10]}"

    return call


_NONE = "TypeError: object of type ''NoneType'' has no len()"


@query("apply_extractor", f"SELECT doc_id, coalesce(length(text) >= 100, false) AS success, CASE WHEN length(text) >= 100 THEN length(text) || ' ' || substr(text, 1, 10) END AS output, 'opening' AS agent, CASE WHEN text IS NULL THEN '{_NONE}' WHEN length(text) < 100 THEN 'ValueError: too short' END AS error FROM documents")
def _(spark, sf):
    return extend.apply_extractor(load(spark, sf, "documents"), "opening", _opening).drop("duration_ms")


def _batch(spark, sf, made=None):
    # All but the items are made from the view of invoices, so that is worked out once.
    made = store_view(spark, sf, "fx_invoices", made, _FIELDS)
    views = {n: load(spark, sf, f"fx_{n}", made) for n in ("invoices", "champ", "text", "items", "vendors", "purchase_orders")}
    lines = views["text"].filter("invoice_id % 41 <> 0").select(F.col("invoice_id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"), F.lit(0.95).alias("confidence"))
    uploads = views["invoices"].select("invoice_id")
    # Laid out within a row, so that rows stay dealt by id.
    took = lambda agent, n: F.struct(F.lit(agent).alias("agent"), (F.col("invoice_id") % n).alias("duration_ms"))
    durations = uploads.select("invoice_id", F.inline(F.array(took("champ", 977), took("challenger", 577))))
    return extend.run_pipeline_batch(uploads, views["champ"], lines, views["items"], views["vendors"], views["purchase_orders"], durations=durations)


# What the challenger reads equals the champ's fields, but for a total that is the subtotal's (its
# caption ends in the same word), so that engines disagree on the total where tax is more than the tolerance.
_RAN = f"""a AS (SELECT * FROM fx_champ), b AS (SELECT * FROM fx_parsed WHERE doc_id % 41 <> 0),
sums AS (SELECT invoice_id, CAST(sum(amount) AS DECIMAL(14,2)) AS line_sum FROM fx_items GROUP BY invoice_id),
paired AS (SELECT i.invoice_id, a.invoice_id IS NOT NULL AS has_a, b.doc_id IS NOT NULL AS has_b, coalesce(a.vendor_name, b.vendor_name) AS vendor_name, coalesce(a.invoice_number, b.invoice_number) AS invoice_number,
    coalesce(a.invoice_date, b.invoice_date) AS invoice_date, coalesce(a.currency, b.currency) AS currency, coalesce(a.subtotal, b.subtotal) AS subtotal, coalesce(a.tax_amount, b.tax_amount) AS tax_amount,
    coalesce(a.total_amount, b.total_amount) AS total_amount, coalesce(a.purchase_order, b.purchase_order) AS purchase_order, (0.0 + a.conf_vendor + a.conf_total) / 2 AS ca, CASE WHEN b.doc_id IS NOT NULL THEN 0.95::DOUBLE END AS cb,
    {" + ".join(f"CASE WHEN {m} THEN 1 ELSE 0 END" for m in _MATCH.values())} AS hits,
    line_sum IS NULL OR a.total_amount IS NULL OR abs(line_sum + coalesce(a.tax_amount, 0) - a.total_amount) <= CAST(0.01 AS DECIMAL(5,4)) * greatest(a.total_amount, 1) AS math_ok
  FROM fx_invoices i LEFT JOIN a ON a.invoice_id = i.invoice_id LEFT JOIN b ON b.doc_id = i.invoice_id LEFT JOIN sums s ON s.invoice_id = i.invoice_id),
made AS (SELECT r.*, CASE WHEN has_a AND has_b THEN 0.65::DOUBLE * ca + 0.35::DOUBLE * cb ELSE coalesce(ca, cb) END AS c, v.vendor_id, (has_a OR has_b) AND (r.purchase_order IS NULL OR p.purchase_order IS NOT NULL) AS po_valid
  FROM paired r LEFT JOIN fx_vendors v ON v.vendor_name = r.vendor_name LEFT JOIN fx_purchase_orders p ON p.purchase_order = r.purchase_order)"""
_STATUS = "CASE WHEN NOT has_a AND NOT has_b THEN 'FAILED' WHEN has_a AND has_b AND c >= 0.85 AND hits / 7.0 >= 0.9 AND math_ok THEN 'AUTO_APPROVED' ELSE 'REVIEW_REQUIRED' END"
_FIELDS = "invoice_id, vendor_name, invoice_number, invoice_date, currency, subtotal, tax_amount, total_amount, purchase_order"


def _parsed_view(sql: str) -> str:
    """sql with the view of fields parsed from texts, which is that of parse_lines."""
    return f"WITH fx_parsed AS ({PARSED_SQL}), {sql}"


@query("run_pipeline_batch", _parsed_view(f"{_RAN} SELECT {_FIELDS}, CAST(round(CAST(c AS DECIMAL(12,8)), 4) AS DOUBLE) AS confidence, {_STATUS} AS status, vendor_id, CASE WHEN has_a OR has_b THEN po_valid END AS po_valid, has_a OR has_b AS has_report FROM made"))
def _(spark, sf):
    invoices, _, _ = _batch(spark, sf)
    return invoices.select(*_FIELDS.split(", "), "confidence", "status", "vendor_id", "po_valid", F.col("report").isNotNull().alias("has_report"))


_LOGS = _parsed_view(f"""{_RAN}, s AS (SELECT unnest(['champ', 'challenger', 'validation', 'vendor_check']) AS agent)
SELECT invoice_id, agent, CASE agent WHEN 'champ' THEN CASE WHEN has_a THEN 'INFO' ELSE 'ERROR' END WHEN 'challenger' THEN CASE WHEN has_b THEN 'INFO' ELSE 'ERROR' END
    WHEN 'validation' THEN CASE WHEN has_a OR has_b THEN 'INFO' ELSE 'ERROR' END ELSE CASE WHEN vendor_id IS NOT NULL THEN 'INFO' ELSE 'WARNING' END END AS level,
  CASE agent WHEN 'champ' THEN CASE WHEN has_a THEN 'Champ OCR ok' ELSE 'Champ OCR failed: no extraction' END
    WHEN 'challenger' THEN CASE WHEN has_b THEN 'Challenger OCR ok' ELSE 'Challenger OCR failed: no extraction' END
    WHEN 'validation' THEN CASE WHEN has_a OR has_b THEN 'Validation decision: ' || {_STATUS} ELSE 'Validation failed: no engine gave an extraction' END
    ELSE 'vendor_valid=' || (vendor_id IS NOT NULL) || ', po_valid=' || po_valid END AS message,
  CAST(CASE agent WHEN 'champ' THEN invoice_id % 977 WHEN 'challenger' THEN invoice_id % 577 END AS INTEGER) AS duration_ms
FROM made, s WHERE agent <> 'vendor_check' OR has_a OR has_b""")


@query("pipeline_logs", _LOGS)
def _(spark, sf):
    return _batch(spark, sf)[2].select("invoice_id", "agent", "level", "message", "duration_ms")


# Items of two of four invoices are replaced by their first lines, in a batch that has one of them anew.
_STORED = f"""SELECT 'invoices' AS name, count(*) AS n, sum(invoice_id) AS ids FROM fx_invoices
UNION ALL SELECT 'items', count(*), sum(invoice_id) FROM fx_items WHERE invoice_id % 4 NOT IN (1, 2) OR line_number = 1
UNION ALL SELECT 'logs', sum(k), sum(k * invoice_id) FROM (SELECT *, CASE WHEN invoice_id % 4 = 1 THEN 2 ELSE 1 END AS k FROM ({_LOGS}))"""


@query("write_tables", _STORED)
def _(spark, sf):
    """Three batches, of which the second has a third of the first's invoices again; then the first once more."""
    # The batch's frames are stored in as many buckets as the store has, so that no row is shuffled into it.
    path, buckets = new_path(spark), key_buckets(spark)
    invoices, items, logs = _batch(spark, sf, store_view(spark, sf, "fx_items"))
    for batch, rest, lines in (("a", (0, 1), 99), ("b", (1, 2), 1), ("c", (3,), 99), ("a", (0, 1), 99)):
        mine = F.col("invoice_id") % 4
        parts = (df.filter(mine.isin(*rest)) for df in (invoices, items.filter(F.col("line_number") <= lines), logs))
        write_tables(spark, path, batch, *parts, buckets=buckets, in_place=True)
    store = Store(spark, path)

    def count(name):
        return store.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("invoice_id").alias("ids"))

    return count("invoices").unionAll(count("items")).unionAll(count("logs"))
