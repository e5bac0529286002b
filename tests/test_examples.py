"""The small examples that fix the operators' meaning."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as C
from ledgerloom.operators import curate, decide, ensemble, evaluate, listing, parse, stats, tokens, workflow
from ledgerloom.schemas import LABELS

EXTRACTION = "invoice_id long, vendor_name string, invoice_number string, invoice_date date, currency string, subtotal decimal(14,2), tax_amount decimal(14,2), total_amount decimal(14,2), purchase_order string, conf_vendor double, conf_total double"
ITEMS = "invoice_id long, line_number int, amount decimal(14,2)"
D = Decimal


def extraction(spark, key=1, **changes):
    row = {"vendor_name": "Acme Supplies Ltd", "invoice_number": "INV-12345", "invoice_date": datetime.date(2026, 4, 1), "currency": "USD", "subtotal": D("100.00"), "tax_amount": D("8.00"), "total_amount": D("108.00"), "purchase_order": "PO-9", "conf_vendor": 0.95, "conf_total": 0.97} | changes
    return spark.createDataFrame([(key, *row.values())], EXTRACTION)


def items(spark, *amounts, key=1):
    return spark.createDataFrame([(key, k + 1, D(a)) for k, a in enumerate(amounts)], ITEMS)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_engines_that_agree_are_approved(spark):
    got = one(decide.decide(extraction(spark), extraction(spark), items(spark, "50.00", "50.00")))
    assert got["decision"] == "AUTO_APPROVED" and got["reasons"] == ["All checks passed"] and got["agreement"] == 1.0


def test_a_different_total_goes_to_review(spark):
    got = one(decide.decide(extraction(spark), extraction(spark, total_amount=D("999.00")), items(spark, "100.00")))
    assert got["decision"] == "REVIEW_REQUIRED" and got["reasons"] == ["Field agreement below threshold"]


def test_one_engine_goes_to_review(spark):
    got = one(decide.decide(extraction(spark), extraction(spark).limit(0), items(spark, "100.00")))
    assert (got["decision"], got["confidence"], got["reasons"]) == ("REVIEW_REQUIRED", 0.96, ["Challenger OCR unavailable"])


def test_a_wrong_sum_goes_to_review(spark):
    wrong = {"total_amount": D("500.00")}
    got = one(decide.decide(extraction(spark, **wrong), extraction(spark, **wrong), items(spark, "50.00", "50.00")))
    assert got["decision"] == "REVIEW_REQUIRED" and got["reasons"] == ["Total mismatch: computed=108.00 declared=500.00"]


def test_no_items_skip_the_sum(spark):
    got = one(decide.math_check(extraction(spark, total_amount=D("500.00")), items(spark)))
    assert got["math_ok"] and got["skipped"] and got["computed_total"] is None


def test_comparison_of_unlike_texts(spark):
    pairs = decide.pair_engines(extraction(spark, vendor_name="Acme Corporation", purchase_order=None), extraction(spark, vendor_name="Acme Corporatlon", purchase_order=None, total_amount=D("109.00")))
    got = {r["field"]: (r["match"], r["similarity"]) for r in decide.compare_fields(pairs).collect()}
    assert got["vendor_name"] == (True, 0.938) and got["purchase_order"] == (True, 1.0) and got["total_amount"] == (True, 1.0)


def test_similarity_depends_on_order(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(C.sequence_ratio(F.col("a"), F.col("b"))).collect()] == [0.25, 0.5, None]


def field_map(spark, fields, confidence):
    return spark.createDataFrame([(1, fields, confidence)], "doc_id long, fields map<string,string>, mean_confidence double")


@pytest.mark.parametrize(
    "a,b,ca,cb,want",
    [
        ({"total_amount": "$1,234.50"}, {"total_amount": "1234.50"}, 0.9, 0.9, "AUTO_APPROVE"),
        ({"invoice_number": "INV-001"}, {"invoice_number": "inv-001"}, 0.9, 0.9, "AUTO_APPROVE"),
        ({"vendor_name": "Acme Corporation"}, {"vendor_name": "Acme Corporatlon"}, 0.9, 0.9, "AUTO_APPROVE"),
        ({"total_amount": "100.00"}, {"total_amount": "999.99"}, 0.9, 0.9, "REVIEW_REQUIRED"),
        ({"total_amount": "100.00"}, {"total_amount": "100"}, 0.35, 0.35, "REVIEW_REQUIRED"),
        ({"total_amount": "n/a"}, {"total_amount": "none"}, 0.9, 0.9, "REVIEW_REQUIRED"),
        ({}, {}, 0.9, 0.9, "REVIEW_REQUIRED"),
    ],
)
def test_ensemble(spark, a, b, ca, cb, want):
    assert one(ensemble.ensemble_decide(field_map(spark, a, ca), field_map(spark, b, cb)))["decision"] == want


def test_ensemble_reasons_and_values(spark):
    a, b = {"x": "1", "y": "same", "z": "p", "w": "k"}, {"x": "2", "y": "same", "z": "p", "w": "k"}
    got = one(ensemble.ensemble_decide(field_map(spark, a, 0.6), field_map(spark, b, 0.7)))
    assert got["fields"]["x"] == "2" and got["mismatches"] == ["x"] and got["reasons"] == ["Low confidence: 0.65", "Mismatches on: x"]


def test_statuses(spark):
    df = spark.createDataFrame([("POSTED", "UPLOADED"), ("UPLOADED", "PROCESSING"), ("FAILED", "PROCESSING"), ("nope", "FAILED")], "current string, target string")
    assert {(r["current"], r["target"]): r["legal"] for r in workflow.check_transitions(df).collect()} == {("POSTED", "UPLOADED"): False, ("UPLOADED", "PROCESSING"): True, ("FAILED", "PROCESSING"): True, ("nope", "FAILED"): False}


def test_uploads(spark):
    df = spark.createDataFrame([(1, "a.PDF", 10, "h1"), (2, "b", 10, "h1"), (3, "c.exe", 30 << 20, "h2"), (4, "d.tar.png", 25 << 20, "h3")], "doc_id long, filename string, size_bytes long, file_hash string")
    assert [r["reject_reason"] for r in workflow.ingest_gate(df).orderBy("doc_id").collect()] == [None, "UNSUPPORTED_FILE_TYPE", "FILE_TOO_LARGE", None]
    assert {r["doc_id"]: r["duplicate"] for r in workflow.dedup_first_wins(df).collect()} == {1: False, 2: True, 3: False, 4: False}


ACTIONS = "invoice_id long, seq int, action string, set_fields array<string>, edits struct<vendor_name:string>, reviewer_id long, notes string"


def test_review_actions(spark):
    """Edits stay whatever comes of the action; each action sees what the one before left."""
    invoices = spark.createDataFrame([(1, "A", "REVIEW_REQUIRED", 5), (2, "B", "POSTED", 5), (3, "C", "UPLOADED", 5), (4, "D", "REVIEW_REQUIRED", 5), (5, "E", "POSTED", 5)], "invoice_id long, vendor_name string, status string, reviewer_id long")
    actions = [(1, 1, "APPROVE", ["vendor_name"], (None,), 7, ""), (2, 1, "REJECT", ["vendor_name"], ("X",), 8, "n"), (4, 2, "APPROVE", [], ("no",), 9, "second"), (4, 1, "REPROCESS", None, None, 7, "first"), (5, 1, "REJECT", None, None, 8, "n")]
    got = {r["invoice_id"]: tuple(r)[1:] for r in workflow.apply_review(invoices, spark.createDataFrame(actions, ACTIONS)).collect()}
    assert got == {
        1: (None, "APPROVED", 7, None, 0),
        2: ("X", "POSTED", 8, None, 1),
        3: ("C", "UPLOADED", 5, None, 0),
        4: ("D", "PROCESSING", 7, "first", 1),
        5: ("E", "POSTED", 5, None, 1),
    }


def test_repeated_vendors_do_not_multiply_invoices(spark):
    invoices = spark.createDataFrame([(1, "A", None)], "invoice_id long, vendor_name string, purchase_order string")
    vendors = spark.createDataFrame([("A", "V2"), ("A", "V1")], "vendor_name string, vendor_id string")
    orders = spark.createDataFrame([], "purchase_order string")
    assert tuple(one(workflow.reference_data_check(invoices, vendors, orders))) == (1, "V1", True, True, "ok")


def test_bound_of_similarity(spark):
    """What the JVM rejects, the sequence similarity would reject too."""
    import difflib
    import random

    r = random.Random(3)
    rows = [tuple("".join(r.choice("abcd -1") for _ in range(r.randrange(1, 12))) for _ in "ab") for _ in range(300)] + [("inv-1", "inv-1x"), ("a", "b")]
    df = spark.createDataFrame(rows, "a string, b string")
    for x in df.select("a", "b", decide._ratio_bound(F.col("a"), F.col("b")).alias("m")).collect():
        assert difflib.SequenceMatcher(None, x["a"], x["b"]).ratio() <= x["m"] + 1e-12


def test_reports_and_merges_of_one_engine(spark):
    report = one(decide.validation_report(extraction(spark), extraction(spark).limit(0), items(spark, "100.00")))["report"]
    assert report["decision"] == "REVIEW_REQUIRED" and report["reasons"] == ["Challenger OCR unavailable"] and report["thresholds"] is None and report["fields"] is None
    both = one(decide.validation_report(extraction(spark), extraction(spark), items(spark)))["report"]
    assert both["math_check"]["skipped"] and both["math_check"]["reason"] == "insufficient data" and both["confidence_by_engine"]["champ"] == 0.96
    raw = extraction(spark).withColumn("raw", F.lit("{}"))
    assert one(decide.merge_extractions(decide.pair_engines(raw, raw.limit(0))))["raw"] == "{}"
    assert one(decide.merge_extractions(decide.pair_engines(raw, raw)))["raw"] == '{"champ":{},"challenger":{}}'


WORDS = "doc_id long, pos long, word string, label string"


def words(spark, text, labels):
    return spark.createDataFrame([(1, k, w, x) for k, (w, x) in enumerate(zip(text.split(), labels.split()))], WORDS)


def test_spans(spark):
    page = words(spark, "Inv 7 Acme Ltd x Acme Inc Co", "B-NO I-NO I-VENDOR I-VENDOR O B-VENDOR I-VENDOR B-VENDOR")
    got = sorted((r["start"], r["end"], r["field"], r["text"]) for r in tokens.bio_spans(page).collect())
    assert got == [(0, 1, "NO", "Inv 7"), (2, 3, "VENDOR", "Acme Ltd"), (5, 6, "VENDOR", "Acme Inc"), (7, 7, "VENDOR", "Co")]
    assert {r["field"]: r["value"] for r in tokens.fields_first_span(page).collect()} == {"no": "Inv 7", "vendor": "Acme Ltd"}
    assert {r["field"]: r["value"] for r in tokens.gold_fields(page).collect()} == {"no": "Inv 7", "vendor": "Acme Ltd Inc"}


def test_weak_labels(spark):
    page = words(spark, "INV-1 Acme Ltd, total 5 acme ltd Acme", "O O O O O O O O").drop("label")
    values = spark.createDataFrame([(1, "vendor_name", "Acme Ltd"), (1, "invoice_number", "inv-1"), (1, "currency", "")], "doc_id long, field string, value string")
    got = [r["label"] for r in tokens.weak_label(page, values, ["vendor_name", "invoice_number"]).orderBy("pos").collect()]
    assert got == ["B-INVOICE_NUMBER", "B-VENDOR_NAME", "I-VENDOR_NAME", "O", "O", "B-VENDOR_NAME", "I-VENDOR_NAME", "O"]
    assert {r["label"] for r in tokens.weak_label(page, values.limit(0), ["vendor_name"]).collect()} == {"O"}


def test_weak_labels_do_not_overlap_themselves(spark):
    page = words(spark, "a a a a a", "O O O O O").drop("label")
    values = spark.createDataFrame([(1, "vendor_name", "a a"), (1, "currency", "a")], "doc_id long, field string, value string")
    got = [r["label"] for r in tokens.weak_label(page, values, ["vendor_name", "currency"]).orderBy("pos").collect()]
    assert got == ["B-VENDOR_NAME", "I-VENDOR_NAME", "B-VENDOR_NAME", "I-VENDOR_NAME", "B-CURRENCY"]


def test_uncertainty(spark):
    df = spark.createDataFrame([(1, []), (2, [0.99, 0.99]), (3, [0.5, 0.5]), (4, [0.7]), (5, None)], "doc_id long, confidences array<double>")
    for strategy in ("entropy", "margin", "min_conf"):
        got = {r["doc_id"]: r["s"] for r in df.select("doc_id", C.uncertainty(F.col("confidences"), strategy).alias("s")).collect()}
        assert got[1] == got[5] == 1.0 and got[2] < got[4] < got[3]
    few = df.filter("doc_id IN (2, 3, 4)")
    assert [r["doc_id"] for r in curate.top_k_uncertain(few, 2).collect()] == [3, 4] and curate.top_k_uncertain(few, -1).count() == 0


def test_boxes(spark):
    df = spark.createDataFrame([([0, 0, 100, 100], 200, 200), ([100, 100, 200, 200], 200, 200), ([5, 5, 9, 9], 0, 10), ([-3, 0, 500, 10], 200, 200)], "b array<int>, w int, h int")
    got = [r[0] for r in df.select(C.normalize_bbox(F.col("b"), F.col("w"), F.col("h"))).collect()]
    assert got == [[0, 0, 500, 500], [500, 500, 1000, 1000], [0, 0, 0, 0], [0, 0, 1000, 50]]


def test_labels(spark):
    assert len(LABELS) == 45 and LABELS[0] == "O"
    df = spark.createDataFrame([("B-VENDOR_NAME",), ("B-NONE",), (None,)], "x string")
    assert [r[0] for r in df.select(C.label_id(F.col("x"))).collect()] == [1, 0, 0]


def test_invalid_examples(spark):
    rows = [(1, ["a"], [[0, 0, 1, 1]], ["O"]), (2, ["a", "b"], [[0, 0, 1, 1]], ["O"]), (3, ["a"], [[0, 0, 1]], ["X"]), (4, None, None, ["O"]), (5, [], [], [])]
    df = spark.createDataFrame(rows, "id int, words array<string>, bboxes array<array<int>>, labels array<string>")
    assert {r["id"]: r["errors"] for r in tokens.validate_example(df).collect()} == {1: [], 2: ["length mismatch"], 3: ["invalid bbox at 0", "unknown label: X"], 4: ["missing keys: words, bboxes"], 5: []}


@pytest.mark.parametrize("text,want", [("2026-04-01", "2026-04-01"), ("on 4/1/2026.", "2026-04-01"), ("31/12/2025", "2025-12-31"), ("3-Mar-2024", "2024-03-03"), ("March 3, 2024", "2024-03-03"), ("3-Mar-24", None), ("none", None)])
def test_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parse.extract_date(F.col("t")).cast("string")).first()[0]
    assert got == want


def test_quirks_of_patterns(spark):
    df = spark.createDataFrame([("Subtotal: 100.00\nTotal: 108.00",), ("Invoice Number 5",), ("position",)], "t string")
    got = df.select(parse.extract_total(F.col("t")).cast("string"), parse.extract_total(F.col("t"), bounded=True).cast("string"), parse.extract_invoice_number(F.col("t")), parse.extract_purchase_order(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("100.00", "108.00", None, None), (None, None, "Number", None), (None, None, None, "sition")]


def test_grand_total_falls_back_to_the_largest(spark):
    df = spark.createDataFrame([("a 10.00 2,000.00 b 30.00 Amount Chargeable 9,999.00".split(),), ("Total 5.00 Total 7.00 x".split(),), ([],), (["Total", "5.00"],)], "w array<string>")
    assert [r[0] for r in df.select(parse.grand_total(F.col("w"))).collect()] == ["2,000.00", "7.00", None, "5.00"]


def test_exact_split(spark):
    df = spark.range(25).withColumnRenamed("id", "doc_id")
    split = curate.train_eval_split(df, 0.2).collect()
    assert sum(r["split"] == "eval" for r in split) == 5 and len(split) == 25
    again = {r["doc_id"]: r["split"] for r in curate.train_eval_split(df.repartition(7), 0.2).collect()}
    assert again == {r["doc_id"]: r["split"] for r in split}
    assert [r["split"] for r in curate.train_eval_split(df.limit(1)).collect()] == ["train"]


def test_lists(spark):
    df = spark.createDataFrame([(1, "b", "POSTED", None), (2, None, "UPLOADED", D("5.00")), (3, "a", "FAILED", D("7.00")), (4, "a", None, D("7.00"))], "invoice_id long, vendor_name string, status string, total_amount decimal(14,2)")
    order = lambda by, way: [r["invoice_id"] for r in listing.sorted_list(df, by, way).collect()]
    assert order("total_amount", "desc") == [1, 3, 4, 2] and order("vendor_name", "asc") == [3, 4, 1, 2]
    assert order("status", "asc") == [2, 1, 3, 4] and order("status", "desc") == [4, 3, 1, 2]
    assert [r["invoice_id"] for r in listing.page(listing.sorted_list(df, "vendor_name", "asc"), 2, 3).collect()] == [2]
    assert listing.filter_status(df, None).count() == 4 and listing.filter_status(df, "POSTED").count() == 1


def test_empty_figures(spark):
    none = spark.createDataFrame([], "status string, created_at timestamp, updated_at timestamp")
    got = one(stats.dashboard(none, F.lit("2026-01-01").cast("timestamp")))
    assert got["total"] == 0 and got["avg_processing_seconds"] == 0.0
    assert [r["n"] for r in stats.status_counts(none).collect()] == [0] * 8


def test_perfect_and_empty_scores(spark):
    page = words(spark, "a b c", "B-X I-X O")
    got = one(evaluate.entity_prf(page, page))
    assert (got["precision"], got["recall"], got["f1"]) == (1.0, 1.0, 1.0)
    got = one(evaluate.entity_prf(page.limit(0), page.limit(0)))
    assert (got["tp"], got["f1"]) == (0, 0.0)


def test_money(spark):
    df = spark.createDataFrame([("1234.5", "EUR", "JPY"), ("x", "USD", "USD"), (None, "USD", "EUR"), ("10", "XXX", "USD")], "a string, s string, t string")
    got = [r[0] for r in df.select(C.format_money(F.col("a"), F.col("s"), F.col("t"))).collect()]
    assert got == ["¥205,117", "—", "—", "$10.00"]
