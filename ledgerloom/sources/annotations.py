"""Annotated pages in other tools' formats, as rows of words with boxes and labels.

Readers take rows of (stem, value), a file's name without extension and its whole text, which
whole_files() makes from a folder. Lines or entries that cannot be read are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import let, stripped
from ..operators.tokens import _sizes, bio_label, page_words_in_rectangles, validate_example, weak_label, weak_label_pages
from ..schemas import EXAMPLE, FIELDS
from .json_pages import entries_of_pages

# Receipt categories and entities, and the fields they stand for.
CORD_FIELDS = {
    "menu.nm": "line_item_description",
    "menu.cnt": "line_item_quantity",
    "menu.price": "line_item_amount",
    "menu.unitprice": "line_item_unit_price",
    "total.total_price": "total_amount",
    "total.subtotal_price": "subtotal",
    "total.tax_price": "tax_amount",
    "sub_total.subtotal_price": "subtotal",
    "sub_total.tax_price": "tax_amount",
}
SROIE_FIELDS = {"company": "vendor_name", "address": "vendor_address", "date": "invoice_date", "total": "total_amount"}


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(stem, value) of the files below path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(stem(F.col("_metadata.file_path")).alias("stem"), "value")


def image_stems(spark: SparkSession, path: str) -> DataFrame:
    """The stems of files below path, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(stem(F.col("path")).alias("stem")).distinct()


def require_image(examples: DataFrame, images: DataFrame) -> DataFrame:
    return examples.join(images, "stem", "left_semi")


def stem_join(images: DataFrame, boxes: DataFrame, entities: DataFrame) -> DataFrame:
    """stem, boxes, entities of files that have all three."""
    a, b = boxes.select("stem", F.col("value").alias("boxes")), entities.select("stem", F.col("value").alias("entities"))
    return a.join(b, "stem").join(images.select("stem").distinct(), "stem", "left_semi")


def parse_examples(rows: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) labelled examples of rows (stem, folder, value: JSON).

    Bad ones are not valid, or their image is not among images (path: its folder and name).
    """
    # Rows meet the images as texts, which are shorter than what is read from them, and a hash table of
    # the images' paths spares a sort of them.
    name = F.get(F.array(F.from_json("value", "image string")["image"]), F.lit(0))
    there = images.select("path").distinct().withColumn("_there", F.lit(True)).hint("shuffle_hash")
    raw = rows.select("stem", "folder", "value", F.concat("folder", name).alias("path")).join(there, "path", "left").drop("path")
    read = raw.select("stem", "folder", "value", "_there", F.from_json("value", EXAMPLE).alias("e")).select("stem", "folder", "value", "_there", "e.*")
    found = validate_example(read)
    lost = F.array(F.concat(F.lit("image not found: "), F.coalesce("image", F.lit("null"))))
    checked = found.withColumn("errors", F.when((F.size("errors") == 0) & F.col("_there").isNull(), lost).otherwise(F.col("errors")))
    good = F.size("errors") == 0
    names = [c for c in read.columns if c not in ("folder", "value", "_there")]
    return checked.filter(good).select(*names), checked.filter(~good).select("stem", "value", "errors")


def read_examples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) labelled examples of the JSON files below path. Images are looked for in the folder
    of their example; they are listed, not read."""
    own, files = F.col("_metadata.file_path"), {"recursiveFileLookup": True}
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", **files)
    images = spark.read.format("binaryFile").options(**files).load(path).select(own.alias("path"))
    return parse_examples(texts.select(stem(own).alias("stem"), F.regexp_replace(own, r"[^/]*$", "").alias("folder"), "value"), images)


def write_examples(examples: DataFrame, path: str) -> DataFrame:
    """Write the valid ones as JSON lines; the others are returned with their errors."""
    checked = validate_example(examples)
    checked.filter(F.size("errors") == 0).drop("errors").write.mode("append").json(path)
    return checked.filter(F.size("errors") > 0)


def _words(rows: DataFrame, words: Column) -> DataFrame:
    # An outer generator: for an inner one Spark would parse a page a second time, to filter by.
    laid = rows.select("stem", F.posexplode_outer(words).alias("pos", "w")).filter("pos IS NOT NULL")
    return laid.select(F.col("stem").alias("doc_id"), F.col("pos").cast("long").alias("pos"), "w.*")


def _box(xs: Column, ys: Column) -> dict[str, Column]:
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def read_sroie(boxes: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, pos, word, x0..y1, label of receipts: text boxes by line, and the entities' values,
    with which words are labelled in the order of the entities' file. Words of a line share its box;
    coordinates may have decimals, which are cut off."""
    names = F.create_map(*(F.lit(x) for pair in SROIE_FIELDS.items() for x in pair))
    known = entities.select(F.col("stem").alias("doc_id"), F.posexplode(F.from_json("value", "map<string,string>")).alias("rank", "entity", "value"))
    values = known.select("doc_id", "rank", F.try_element_at(names, F.col("entity")).alias("field"), "value").filter("field IS NOT NULL AND value <> ''")
    parts = lambda text: F.split(text, ",", 9)
    number = lambda p, k: F.try_element_at(p, F.lit(k + 1)).try_cast("double").try_cast("int")

    def read(p: Column) -> Column:
        sides = (F.array(*(number(p, k) for k in ks)) for ks in ((0, 2, 4, 6), (1, 3, 5, 7)))
        return F.struct(stripped(F.try_element_at(p, F.lit(9))).alias("text"), *(c.alias(n) for c, n in zip(sides, ("xs", "ys"), strict=True)))

    def boxed(line: Column) -> Column:
        box = F.struct(*(c.alias(n) for n, c in _box(line["xs"], line["ys"]).items()))
        tokens = F.filter(F.split(line["text"], r"(?U)\s+"), lambda w: w != "")
        return let(box, lambda b: F.transform(tokens, lambda w: F.struct(w.alias("word"), *(b[n].alias(n) for n in ("x0", "y0", "x1", "y1")))))

    lines = F.transform(F.split("value", "\r?\n"), lambda text: let(parts(text), read))
    whole = F.filter(lines, lambda x: (x["text"] != "") & ~F.exists(x["xs"], lambda v: v.isNull()) & ~F.exists(x["ys"], lambda v: v.isNull()))
    # Files meet the entities as texts, which are shorter than what is read from them.
    return weak_label_pages(boxes.select(F.col("stem").alias("doc_id"), "value"), values, F.flatten(F.transform(whole, boxed)))


FUNSD = "form array<struct<words:array<struct<text:string,box:array<int>>>>>"


#: What (?U)\s matches.
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SIDES = ("x0", "y0", "x1", "y1")


def _funsd_words(entries: pa.StructArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Which words of forms stay, and their texts and boxes."""
    text, box = pc.utf8_trim(pc.struct_field(entries, "text"), _WHITE), pc.struct_field(entries, "box")
    some = pc.fill_null(pc.not_equal(text, ""), False).to_numpy(zero_copy_only=False)
    kept = some & (_sizes(box) == 4)
    held = pa.array(kept)
    numbers = box.filter(held).flatten()
    return kept, [text.filter(held), *(numbers[k:].take(pa.array(np.arange(0, len(numbers) - k, 4))) for k in range(4))]


def funsd_words(text: Column) -> Column:
    """The words of a form, by from_json."""
    words = F.flatten(F.transform(F.from_json(text, FUNSD)["form"], lambda f: f["words"]))
    good = F.filter(words, lambda w: (stripped(w["text"]) != "") & (F.size(w["box"]) == 4))
    return F.transform(good, lambda w: F.struct(stripped(w["text"]).alias("word"), *(F.get(w["box"], F.lit(k)).alias(n) for k, n in enumerate(_SIDES))))


def read_funsd(files: DataFrame) -> DataFrame:
    """doc_id, pos, word, x0..y1, label (always O) of forms."""
    columns = f"word string, {', '.join(f'{n} int' for n in _SIDES)}"
    return entries_of_pages(files, FUNSD, _funsd_words, columns, funsd_words(F.col("_raw"))).withColumn("label", F.lit("O"))


_QUAD = ",".join(f"{a}{k}:int" for k in range(1, 5) for a in "xy")
CORD = f"valid_line array<struct<category:string,words:array<struct<text:string,quad:struct<{_QUAD}>>>>>"


def read_cord(files: DataFrame) -> DataFrame:
    """doc_id, pos, word, x0..y1, label of receipts whose lines have categories."""
    names = F.create_map(*(F.lit(x) for pair in CORD_FIELDS.items() for x in pair))

    def of_line(line: Column) -> Column:
        corner = lambda w, a: F.array(*(w["quad"][f"{a}{k}"] for k in range(1, 5)))
        field = F.try_element_at(names, line["category"])
        return F.transform(line["words"], lambda w: F.struct(stripped(w["text"]).alias("word"), *(c.alias(n) for n, c in _box(corner(w, "x"), corner(w, "y")).items()), field.alias("field")))

    words = F.flatten(F.transform(F.from_json("value", CORD)["valid_line"], of_line))

    def labelled(ws: Column) -> Column:
        """cord_bio within the page's row."""
        label = lambda w, i: bio_label(w["field"], F.get(ws, i - 1)["field"])
        return F.transform(ws, lambda w, i: F.struct(*(w[n].alias(n) for n in ("word", "x0", "y0", "x1", "y1")), label(w, i).alias("label")))

    return _words(files, let(F.filter(words, lambda w: w["word"] != ""), labelled))


def export_labeling_tasks(examples: DataFrame, prefix: str) -> DataFrame:
    """One task per example with an image and words: data and meta structs, to be written as JSON."""
    data = F.struct(F.concat(F.lit(prefix), F.col("image")).alias("image"), "words", "bboxes", F.col("labels").alias("suggested_labels"))
    some = examples.filter((F.col("image") != "") & (F.size("words") > 0))
    return some.select(data.alias("data"), F.struct(F.col("stem").alias("source_file")).alias("meta"))


TASK = """data struct<image:string,words:array<string>,bboxes:array<array<int>>>,
annotations array<struct<result:array<struct<original_width:double,original_height:double,value:struct<x:double,y:double,width:double,height:double,rectanglelabels:array<string>>>>>>"""


def import_labeling_results(tasks: DataFrame) -> DataFrame:
    """doc_id, pos, word, label of tasks (stem, value: JSON) by their first annotation's rectangles,
    which are in per cent of the page. Labels that are no field are ignored."""
    read = tasks.select("stem", F.from_json("value", TASK.replace("\n", "")).alias("t"))
    v, px = (lambda r: r["value"]), (lambda r, c, side: r["value"][c] / 100 * r[f"original_{side}"])
    left, top = (lambda r: px(r, "x", "width")), (lambda r: px(r, "y", "height"))
    right, bottom = (lambda r: left(r) + px(r, "width", "width")), (lambda r: top(r) + px(r, "height", "height"))
    field = lambda r: F.lower(F.get(v(r)["rectanglelabels"], F.lit(0)))
    rect = lambda r: F.struct(field(r).alias("field"), left(r).alias("rx0"), top(r).alias("ry0"), right(r).alias("rx1"), bottom(r).alias("ry1"))
    rects = F.filter(F.transform(F.get("t.annotations", F.lit(0))["result"], rect), lambda r: r["field"].isin(*FIELDS))
    corner = lambda w: (F.get(w["box"], F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1")))
    words = F.transform(F.arrays_zip(F.col("t.data.words").alias("word"), F.col("t.data.bboxes").alias("box")), lambda w: F.struct(w["word"].alias("word"), *corner(w)))
    # Columns that others use several times are made first, or they would be made at each use.
    pages = read.select("stem", words.alias("words"), rects.alias("rects"))
    return _words(pages.select("stem", page_words_in_rectangles(F.col("words"), F.col("rects")).alias("words")), F.col("words"))


def append_feedback(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """Words labelled by a reviewer's values, marked as human_correction; samples without words have no rows."""
    return weak_label(words, corrections, list(FIELDS)).withColumn("source", F.lit("human_correction"))


def feedback_manifest(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """sample_id, json, fields: an entry for each corrected sample that has words, as a manifest of the
    training set keeps it. fields is a map of field to value; of a field that comes twice, the last by
    its text. Samples without corrections have no entry."""
    one = corrections.groupBy("doc_id", "field").agg(F.max("value").alias("value"))
    held = one.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    known = held.join(words.select("doc_id").distinct(), "doc_id", "left_semi")
    return known.select(F.col("doc_id").cast("string").alias("sample_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("json"), "fields")


#: Columns of an analysis that have a confidence, and the field each is read from.
SCORED = {
    "vendor_name": "VendorName",
    "invoice_number": "InvoiceId",
    "invoice_date": "InvoiceDate",
    "total_amount": "InvoiceTotal",
    "subtotal": "SubTotal",
    "tax_amount": "TotalTax",
}


_LEAF = "struct<value:variant,content:variant,confidence:double>"
_LINE = ",".join(f"{n}:{_LEAF}" for n in ("Description", "Quantity", "UnitPrice", "Amount"))
#: What is read of an analysis' fields; what is of another shape is null.
ANALYSIS = f"struct<{','.join(f'{n}:{_LEAF}' for n in (*SCORED.values(), 'DueDate', 'Currency', 'PurchaseOrder'))},Items:struct<value:array<struct<value:struct<{_LINE}>>>>>"


def flatten_analysis_result(results: DataFrame) -> DataFrame:
    """Header fields, items and confidences of cloud analyses (stem, value: JSON), by their first document.

    Gives doc_id, vendor_name, invoice_number, invoice_date, due_date, currency, subtotal, tax_amount,
    total_amount, purchase_order, items, confidence_scores and error. A field's `value` may be a text,
    a number, a date (an ISO text) or an object of amount and code, as the service pleases, so the
    JSON is read as a variant. Where it is missing or null, `content` stands in. A value of a wrong
    type is null, and so is what cannot be read as a number or date. items is an array of
    (line_number, description, quantity, unit_price, amount), numbered from 1, with N/A, 1, 0 and 0 for
    what is missing. The currency is the total's code, then the Currency field, then USD.
    confidence_scores is a map of SCORED's columns, 0.0 where a field has none. JSON that is broken or
    has no document gives an error and no fields.
    """
    doc = F.try_variant_get(F.try_parse_json("value"), "$.documents[0]", "variant")

    def given(leaf: Column) -> Column:
        """The value, or else the content; a JSON null is no value."""
        return F.when(leaf["value"].isNull() | F.is_variant_null(leaf["value"]), leaf["content"]).otherwise(leaf["value"])

    def is_text(value: Column) -> Column:
        return F.schema_of_variant(value) == "STRING"

    def text(value: Column) -> Column:
        return F.when(is_text(value), F.try_variant_get(value, "$", "string"))

    def number(value: Column, kind: str) -> Column:
        """A number, a text of one, or an object's amount."""
        return F.coalesce(F.try_variant_get(value, "$.amount", kind), F.try_variant_get(value, "$", kind))

    def date(value: Column) -> Column:
        return F.when(is_text(value), F.try_variant_get(value, "$", "date"))

    def item(x: Column, k: Column) -> Column:
        part = lambda name: given(x["value"][name])
        or_else = lambda name, kind, default: F.coalesce(let(part(name), lambda v: number(v, kind)), F.lit(default).cast(kind))
        return F.struct(
            (k + 1).alias("line_number"),
            F.coalesce(F.nullif(let(part("Description"), text), F.lit("")), F.lit("N/A")).alias("description"),
            or_else("Quantity", "decimal(14,4)", 1).alias("quantity"),
            or_else("UnitPrice", "decimal(14,4)", 0).alias("unit_price"),
            or_else("Amount", "decimal(14,2)", 0).alias("amount"),
        )

    # A document is walked once for all fields. Values that several columns use are made first, or they
    # would be worked out again at each use.
    given_ones = ("VendorName", "InvoiceId", "Currency", "PurchaseOrder", "InvoiceTotal", "SubTotal", "TotalTax")
    read = results.select(F.col("stem").alias("doc_id"), doc.alias("_doc")).withColumn("_f", F.try_variant_get("_doc", "$.fields", ANALYSIS))
    held = read.withColumns({f"_{n}": given(F.col(f"_f.{n}")) for n in given_ones})
    v = lambda name: F.col(f"_{name}")
    code = F.try_variant_get(v("InvoiceTotal"), "$.code", "string")
    currency = F.when(F.schema_of_variant(v("InvoiceTotal")).startswith("OBJECT"), code).otherwise(text(v("Currency")))
    scores = (x for c, n in SCORED.items() for x in (F.lit(c), F.coalesce(F.col(f"_f.{n}.confidence"), F.lit(0.0))))
    scalar = F.when(~F.schema_of_variant(v("PurchaseOrder")).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(v("PurchaseOrder"), "$", "string"))
    return held.select(
        "doc_id",
        text(v("VendorName")).alias("vendor_name"),
        text(v("InvoiceId")).alias("invoice_number"),
        date(F.col("_f.InvoiceDate.value")).alias("invoice_date"),
        date(F.col("_f.DueDate.value")).alias("due_date"),
        F.coalesce(F.nullif(currency, F.lit("")), F.lit("USD")).alias("currency"),
        *(number(v(n), "decimal(14,2)").alias(c) for c, n in (("subtotal", "SubTotal"), ("tax_amount", "TotalTax"), ("total_amount", "InvoiceTotal"))),
        F.nullif(scalar, F.lit("")).alias("purchase_order"),
        F.coalesce(F.transform("_f.Items.value", item), F.array()).alias("items"),
        F.create_map(*scores).alias("confidence_scores"),
        F.when(F.col("_doc").isNull(), "no document").alias("error"),
    )


PAGES = "pages array<struct<lines:array<struct<text:string,confidence:double,polygon:array<array<double>>>>>>"


def _whole_numbers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as longs; those out of range become the nearest long."""
    out = np.clip(values, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    out[values >= 2.0**63] = np.iinfo(np.int64).max
    return out


def _ocr_lines(entries: pa.StructArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Which recognized lines stay, and their texts, confidences and the boxes around their polygons."""
    text = pc.struct_field(entries, "text")
    kept = pc.fill_null(pc.not_equal(text, ""), False).to_numpy(zero_copy_only=False)
    held = pa.array(kept)
    polygons = pc.struct_field(entries, "polygon").filter(held)
    points, corners = polygons.flatten(), _sizes(polygons)
    values, width = points.flatten().to_numpy(zero_copy_only=False), _sizes(points)
    first = np.cumsum(width) - width
    some = np.flatnonzero(corners)
    begin = (np.cumsum(corners) - corners)[some]

    def side(k: int, low: bool) -> pa.Array:
        there = width > k
        v = np.full(len(width), np.nan)
        v[there] = values[first[there] + k]
        out, known = np.zeros(len(corners)), np.zeros(len(corners), bool)
        if len(some):
            # A missing coordinate, which is nan, is not looked at.
            out[some] = np.fmin.reduceat(v, begin) if low else np.fmax.reduceat(v, begin)
            known[some] = ~np.isnan(out[some])
        out = np.where(known, np.floor(out) if low else np.ceil(out), 0.0)
        return pa.array(_whole_numbers(out), mask=~known)

    confidence = pc.fill_null(pc.struct_field(entries, "confidence").filter(held), 0.0)
    return kept, [text.filter(held), confidence, side(0, True), side(1, True), side(0, False), side(1, False)]


def ocr_lines(text: Column) -> Column:
    """The lines of a document's recognized pages, by from_json."""
    lines = F.flatten(F.transform(F.from_json(text, PAGES)["pages"], lambda p: p["lines"]))
    some = F.filter(lines, lambda x: F.coalesce(x["text"], F.lit("")) != "")
    low, high = (lambda a: F.floor(F.array_min(a)).cast("long")), (lambda a: F.ceil(F.array_max(a)).cast("long"))
    side = lambda w, k: F.transform(w["polygon"], lambda p: F.get(p, F.lit(k)))
    boxed = lambda w: (f(side(w, k)).alias(n) for n, (f, k) in zip(_SIDES, ((low, 0), (low, 1), (high, 0), (high, 1)), strict=True))
    return F.transform(some, lambda w: F.struct(w["text"].alias("text"), F.coalesce(w["confidence"], F.lit(0.0)).alias("confidence"), *boxed(w)))


def flatten_ocr_pages(results: DataFrame) -> DataFrame:
    """doc_id, line, text, confidence, x0..y1 of recognized pages (stem, value: JSON), without empty
    texts. Polygons become the whole-pixel boxes around them."""
    columns = f"text string, confidence double, {', '.join(f'{n} bigint' for n in _SIDES)}"
    return entries_of_pages(results, PAGES, _ocr_lines, columns, ocr_lines(F.col("_raw"))).withColumnRenamed("pos", "line")
