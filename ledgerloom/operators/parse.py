"""Fields out of recognized text and words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bare_word, find_sequence

# Patterns of fields in text, and of dates and their formats.
NUMBER = r"(?iU)(?:invoice|inv)[#:\s\-]*([A-Z0-9\-]{4,})"
ORDER = r"(?iU)(?:p\.?o\.?|purchase\s*order)[#:\s\-]*([A-Z0-9\-]{3,})"
TOTAL = r"(?iU)total[\s:]*\$?([\d,]+\.\d{2})"
SUBTOTAL = r"(?iU)sub[\s-]?total[\s:]*\$?([\d,]+\.\d{2})"
TAX = r"(?iU)\btax[\s:]*\$?([\d,]+\.\d{2})"
DATE = r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-[A-Za-z]{3}-\d{2,4}|[A-Za-z]+\s\d{1,2},\s\d{4})\b"
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "d-MMM-yyyy", "MMMM d, yyyy")
# Patterns of single words.
EMAIL = r"^[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}$"
PHONE = r"^\+\d{10,13}$"
TAX_ID = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"
SHORT_DATE = r"^\d{1,2}-[A-Za-z]{3}-\d{2,4}$"
AMOUNT = r"^\d{1,3}(?:,\d{3})*(?:\.\d+)?$"
INVOICE_WORD = r"^[A-Z]{2,}/[A-Z0-9/\-]+$"
ORDER_WORD = r"^[A-Z]{2,}/[A-Z0-9/\-]+[,]?$"
DATE_WORD = r"^\d{1,2}-[A-Za-z]{3}-\d{2,4}[,]?$"
MAIL_WORD = r"^[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
MAIL_HEAD = r"^[\w.+-]+\.$"
MAIL_TAIL = r"^[\w.+-]+@"
PHONE_WORD = r"^(\+\d{10,13}|[6-9]\d{9})$"
# Captions that rules are anchored on, and words that end a run.
TAX_CAPTIONS = ("GSTIN/UIN:", "GSTIN/UIN")
VENDOR_CAPTION = ["Tax", "Invoice"]
NUMBER_CAPTION = ["Invoice", "No."]
ORDER_CAPTION = ["Buyer's", "Order", "No."]
TERMS_CAPTION = ["Mode/Terms", "of", "Payment"]
SERVICE_CAPTION = ["Service", "Call", "Charge"]
VENDOR_STOPS = ("MiQB", "Plot")
TERMS_STOPS = ("Other", "References", "Dispatched", "Dated", "Delivery")


def first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def extract_invoice_number(text: Column) -> Column:
    return first_match(text, NUMBER)


def extract_purchase_order(text: Column) -> Column:
    return first_match(text, ORDER)


def parse_decimal(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(14,2)")


def extract_total(text: Column, bounded: bool = False) -> Column:
    """The first total, which may be the end of a subtotal's name unless bounded."""
    return parse_decimal(first_match(text, TOTAL.replace("total", r"(?<![A-Za-z-])total", 1) if bounded else TOTAL))


def extract_subtotal(text: Column) -> Column:
    return parse_decimal(first_match(text, SUBTOTAL))


def extract_tax(text: Column) -> Column:
    return parse_decimal(first_match(text, TAX))


def extract_vendor(lines: Column) -> Column:
    """The first line of more than two characters that does not begin with a digit."""
    return F.get(F.filter(lines, lambda x: (F.char_length(x) > 2) & ~x.rlike(r"^\p{Nd}")), F.lit(0))


def extract_date(text: Column) -> Column:
    """The first token that looks like a date, by the first format that reads it."""
    token = first_match(text, DATE)
    return F.coalesce(*(F.try_to_timestamp(token, F.lit(f)) for f in DATE_FORMATS)).cast("date")


def parse_lines(lines: DataFrame) -> DataFrame:
    """One row of fields per document of recognized lines (doc_id, line, text, confidence)."""
    row = F.struct("line", "text")
    pages = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["text"]).alias("_lines"), F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"), F.count("*").alias("line_count"))
    text = F.array_join("_lines", "\n")
    return pages.select(
        "doc_id", extract_vendor(F.col("_lines")).alias("vendor_name"), extract_invoice_number(text).alias("invoice_number"), extract_date(text).alias("invoice_date"), F.lit("USD").alias("currency"),
        extract_subtotal(text).alias("subtotal"), extract_tax(text).alias("tax_amount"), extract_total(text).alias("total_amount"), extract_purchase_order(text).alias("purchase_order"), "confidence", "line_count",
    )


def page_words(words: DataFrame) -> DataFrame:
    """doc_id and its words as an array, in order."""
    return words.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]).alias("words"))


def _first(words: Column, ok) -> Column:
    return F.get(F.filter(words, ok), F.lit(0))


def _places(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once; inside a lambda a bare expression is at every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grand_total(words: Column) -> Column:
    """The amount after the last "Total" before "Amount Chargeable" (or the end), or else the largest
    amount among the 30 words before it."""
    at = lambda i: F.get(words, i)
    places = _places(words)
    chargeable = lambda i: (at(i) == "Amount") & F.coalesce(at(i + 1) == "Chargeable", F.lit(False))
    number = lambda w: F.replace(w, F.lit(","), F.lit("")).cast("double")

    def before(end: Column) -> Column:
        totals = F.filter(places, lambda i: (i > 0) & (i < end) & (at(i) == "Total") & F.coalesce(at(i + 1).rlike(AMOUNT), F.lit(False)))
        near = F.filter(F.slice(words, F.greatest(end - 30, F.lit(0)) + 1, F.least(end, F.lit(30))), lambda w: w.rlike(AMOUNT))
        largest = F.aggregate(near, F.lit(None).cast("string"), lambda a, w: F.when(a.isNull() | (number(w) > number(a)), w).otherwise(a))
        return F.coalesce(at(F.array_max(totals) + 1), largest)

    return _let(F.coalesce(F.get(F.filter(places, chargeable), F.lit(0)), F.size(words)), before)


def _amount_after(words: Column, name: str) -> Column:
    """The first amount within three words after a tag that has name and "@"."""
    at = lambda i: F.get(words, i)
    tags = F.filter(_places(words), lambda i: F.upper(at(i)).contains(name) & at(i).contains("@"))
    amounts = F.transform(tags, lambda i: _first(F.slice(words, i + 2, 3), lambda w: w.rlike(AMOUNT)))
    return F.get(F.array_compact(amounts), F.lit(0))


def postprocess_fields(fields: Column, words: Column) -> Column:
    """A field map with missing fields filled from the page's words by rules.

    A split e-mail address is joined. The grand total replaces a total that is missing or that
    equals one of the tax amounts.
    """
    at = lambda i: F.get(words, i)
    own = lambda name: F.try_element_at(fields, F.lit(name))
    has = lambda name: F.map_contains_key(fields, name)
    places = _places(words)

    def mail(i: Column) -> Column:
        joined = F.concat(at(i), at(i + 1))
        split = at(i).endswith(".") & F.coalesce(at(i + 1).contains("@"), F.lit(False)) & F.coalesce(joined.rlike(EMAIL), F.lit(False))
        return F.when(at(i).rlike(EMAIL), at(i)).when(split, joined)

    mails = F.get(F.array_compact(F.transform(places, mail)), F.lit(0))
    counted = F.filter(places, lambda i: (at(i + 1) == "Service") & (at(i + 2) == "Call") & (at(i + 3) == "Charge") & at(i).rlike(r"^\p{Nd}+$"))
    filled = {
        "vendor_email": F.when(has("vendor_email"), F.trim(F.regexp_replace(own("vendor_email"), r"\.\s+", "."))).otherwise(mails),
        "vendor_phone": F.when(has("vendor_phone"), own("vendor_phone")).otherwise(_first(words, lambda w: w.rlike(PHONE))),
        "vendor_tax_id": F.when(has("vendor_tax_id"), own("vendor_tax_id")).otherwise(_first(words, lambda w: w.rlike(TAX_ID))),
        "cgst": F.when(has("cgst"), own("cgst")).otherwise(_amount_after(words, "CGST")),
        "gst": F.when(has("gst"), own("gst")).otherwise(_amount_after(words, "SGST")),
        "igst": F.when(has("igst"), own("igst")).otherwise(_amount_after(words, "IGST")),
        "invoice_date": F.when(has("invoice_date"), own("invoice_date")).otherwise(_first(words, lambda w: w.rlike(SHORT_DATE))),
        "total_quantity": F.when(has("total_quantity"), own("total_quantity")).otherwise(at(F.get(counted, F.lit(0)))),
    }
    taxes = [filled[t] for t in ("cgst", "gst", "igst")]
    is_tax = reduce(Column.__or__, (F.coalesce(own("total_amount") == t, F.lit(False)) for t in taxes))
    filled["total_amount"] = F.when(~has("total_amount") | is_tax, F.coalesce(grand_total(words), own("total_amount"))).otherwise(own("total_amount"))
    others = F.map_filter(fields, lambda k, _: ~k.isin(*filled))
    made = F.map_filter(F.create_map(*(x for k, v in filled.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    return F.map_concat(others, made)


#: What a word has that any rule for single words may take.
_TELLING = r"[\p{Nd}@]"


def _laid(entries: Column, n: Column) -> Column:
    """n labels: those of entries (place, order, label), sorted, the last one of each place; else O.
    Work is in proportion to words and entries together."""
    last = F.filter(entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["p"] != e["p"], F.lit(True)))
    label = lambda e: F.array(e["label"])

    def filled(places: Column) -> Column:
        gap = lambda i: F.array_repeat(F.lit("O"), F.get(places, i)["p"] - F.coalesce(F.get(places, i - 1)["p"], F.lit(-1)) - 1)
        pieces = F.transform(places, lambda e, i: F.concat(gap(i), label(e)))
        end = F.array_repeat(F.lit("O"), n - 1 - F.coalesce(F.get(places, F.size(places) - 1)["p"], F.lit(-1)))
        return F.concat(F.flatten(pieces), end)

    return _let(last, filled)


def auto_label(pages: DataFrame) -> DataFrame:
    """pages (doc_id, words) with labels, one per word, by rules anchored on printed captions.

    Each rule yields runs (first word, length, field); later rules go over earlier ones, some only
    where a word is still O. Runs become entries of single words, which are laid over the page once,
    sorted. Two passes over a page find its telling words (with a digit or "@") and the words that may
    begin a caption; rules look at these alone.
    """
    words = F.col("words")
    at = lambda i: F.get(words, i)
    is_like = lambda i, pattern: F.coalesce(at(i).rlike(pattern), F.lit(False))
    tax_anchor = lambda i: at(i).isin(*TAX_CAPTIONS) | at(i).rlike(TAX_ID)
    telling = lambda ok: F.filter("_telling", ok)

    captions = {"_vendor": VENDOR_CAPTION, "_number": NUMBER_CAPTION, "_order": ORDER_CAPTION, "_terms": TERMS_CAPTION, "_service": SERVICE_CAPTION}
    heads = sorted({c[0].lower().rstrip(":,.") for c in captions.values()})
    found = pages.withColumns({"_n": F.size(words), "_places": _places(words)}).withColumns(
        {"_telling": F.filter("_places", lambda i: at(i).rlike(_TELLING)), "_heads": F.filter("_places", lambda i: bare_word(at(i)).isin(*heads))}
    )
    found = found.withColumns({name: find_sequence(words, caption, among=F.col("_heads")) for name, caption in captions.items()})

    start = lambda name, size: F.when(F.col(name) >= 0, F.col(name) + size)

    def until(begin: Column, stop, most: int) -> Column:
        """The first place from begin on where stop holds, or the page's end, but `most` words at most."""
        end = F.least(begin + most, F.col("_n"))
        near = F.when(begin < end, F.sequence(begin, end - 1))
        return F.when(begin.isNotNull(), F.coalesce(F.get(F.filter(near, stop), F.lit(0)), end))

    found = found.withColumns({"_v": start("_vendor", 2), "_o": start("_order", 3), "_t": start("_terms", 3)})
    found = found.withColumns(
        {
            "_v1": until(F.col("_v"), lambda i: at(i).isin(*VENDOR_STOPS) | tax_anchor(i) | at(i).rlike(r"^\p{Nd}"), 8),
            "_o1": until(F.col("_o"), lambda i: ~at(i).rlike(ORDER_WORD), 8),
            "_t1": until(F.col("_t"), lambda i: at(i).isin(*TERMS_STOPS), 4),
        }
    ).withColumn("_a1", until(F.col("_v1"), tax_anchor, 21))

    kind = "array<struct<p:int,o:int,label:string>>"
    entry = lambda p, order, label: F.struct(p.cast("int").alias("p"), F.lit(order).alias("o"), label.alias("label"))
    none = F.array().cast(kind)

    def run(order: int, begin: Column, size: Column | int, name: str) -> Column:
        """Entries of a run; none if its beginning or size is null, or the size is not positive."""
        size = F.lit(size) if isinstance(size, int) else size
        label = lambda k: F.concat(F.when(k == 0, "B-").otherwise("I-"), F.lit(name))
        made = F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda k: entry(begin + k, order, label(k)))
        return F.when(size > 0, F.when(begin.isNotNull(), made)).otherwise(none).cast(kind)

    def ones(order: int, places: Column, label) -> Column:
        return F.transform(places, lambda i: entry(i, order, label(i))).cast(kind)

    always = lambda *runs: F.concat(*(F.coalesce(r, none) for r in runs))
    span = lambda order, begin, end, name: run(order, F.col(begin), F.col(end) - F.col(begin), name)
    first = lambda places: F.get(places, F.lit(0))
    places_of = lambda entries: F.transform(entries, lambda e: e["p"])
    tagged = lambda name: lambda _: F.lit(f"B-{name}")

    def tax_name(i: Column) -> Column:
        w = F.upper(at(i - 1))
        return F.when(at(i - 1).contains("@"), F.when(w.contains("CGST"), "B-CGST").when(w.contains("IGST"), "B-IGST").when(w.contains("SGST"), "B-GST"))

    split = lambda i: (i > 0) & at(i).rlike(MAIL_TAIL) & is_like(i - 1, MAIL_HEAD)
    number = F.when((F.col("_number") >= 0) & is_like(F.col("_number") + 2, INVOICE_WORD), F.col("_number") + 2)
    quantity = F.when((F.col("_service") >= 1) & is_like(F.col("_service") - 1, r"^\p{Nd}+$"), F.col("_service") - 1)
    found = found.withColumns(
        {
            "_fixed": always(
                span(0, "_v", "_v1", "VENDOR_NAME"),
                F.when(F.col("_v1") > F.col("_v"), span(1, "_v1", "_a1", "VENDOR_ADDRESS")),
                run(2, first(telling(lambda i: at(i).rlike(TAX_ID))), 1, "VENDOR_TAX_ID"),
                run(3, number, 1, "INVOICE_NUMBER"),
                span(4, "_o", "_o1", "PURCHASE_ORDER"),
                run(5, first(telling(lambda i: at(i).rlike(DATE_WORD))), 1, "INVOICE_DATE"),
            ),
            "_amounts": telling(lambda i: (i > 0) & at(i).rlike(AMOUNT)),
        }
    )
    # A rule of single words takes places that are free by then.
    taxed = F.array_except(F.filter("_amounts", lambda i: tax_name(i).isNotNull()), places_of("_fixed"))
    found = found.withColumn("_taken", F.concat("_fixed", ones(6, taxed, tax_name)))
    total = F.slice(F.array_except(F.filter("_amounts", lambda i: at(i - 1) == "Total"), places_of("_taken")), 1, 1)
    heads_of = telling(split)
    found = found.withColumn(
        "_taken",
        F.concat("_taken", ones(7, total, tagged("TOTAL_AMOUNT")), F.flatten(F.transform(heads_of, lambda i: F.array(entry(i - 1, 8, F.lit("B-VENDOR_EMAIL")), entry(i, 8, F.lit("I-VENDOR_EMAIL"))))).cast(kind)),
    )
    mails = F.array_except(telling(lambda i: at(i).rlike(MAIL_WORD)), places_of("_taken"))
    phones = telling(lambda i: at(i).rlike(PHONE_WORD))
    found = found.withColumn(
        "_taken",
        F.concat("_taken", ones(9, mails, tagged("VENDOR_EMAIL")), ones(10, phones, tagged("VENDOR_PHONE")), always(span(11, "_t", "_t1", "TERMS_AND_CONDITIONS"))),
    )
    counted = F.when(~F.array_contains(places_of("_taken"), quantity), quantity)
    found = found.withColumn("_taken", F.array_sort(F.concat("_taken", always(run(12, counted, 1, "TOTAL_QUANTITY")))))
    return found.select(*pages.columns, _laid(F.col("_taken"), F.col("_n")).alias("labels"))
