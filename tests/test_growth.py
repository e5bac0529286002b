"""Plans of queries whose shuffles grew faster than their input: words of a page are not shuffled."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")

#: Queries on words of pages that shuffle the texts once, and nothing else.
IN_ROWS = [
    "import_labeling_results",
    "flatten_ocr_pages",
    "export_labeling_tasks",
    "read_funsd",
    "read_cord",
    "validate_example",
    "scale_page_words",
    "split_word_boxes",
    "subword_to_word",
    "gold_vs_predicted",
]


def plan(spark, name):
    return entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", IN_ROWS)
def test_words_stay_in_their_rows(spark, name):
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in text
    assert not any(word in text for word in ("Sort", "Join", "Window", "Aggregate"))


def test_texts_are_normalized_once_for_a_comparison(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions.scalars import fuzzy_equal

    df = spark.createDataFrame([("Acme  Ltd", "acme ltd"), ("acme ltd", "acme ltb"), ("", "x"), (None, " "), ("ab", "xyz")], "a string, b string")
    made = df.select(fuzzy_equal(F.col("a"), F.col("b")).alias("ok"))
    assert [r.ok for r in made.collect()] == [True, False, False, True, False]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2


def test_fields_are_not_compared_again_to_filter(spark):
    assert plan(spark, "ensemble_fields").count("generate explode") == 0 and "Filter (size(" not in plan(spark, "ensemble_fields")


def test_amounts_written_alike_are_compared_as_texts(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions import scalars

    texts = ["0.00", "-0.00", "12.30", "12.3", "012.30", "$12.30", "12.304", "1234567890123.45", "12345678901234567.00", "12.30\n", "x", "", "-5.10", "5.10"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    slow = F.coalesce(scalars.normalize_numeric(F.col("a")) == scalars.normalize_numeric(F.col("b")), F.lit(False))
    made = df.select("a", "b", scalars.fields_agree(F.lit("total_amount"), F.col("a"), F.col("b")).alias("ok"), slow.alias("slow"))
    assert [r for r in made.collect() if r.ok != r.slow] == []
    assert scalars._CENTS in made._jdf.queryExecution().optimizedPlan().toString()


def test_a_decision_alone_makes_no_fields(spark):
    assert "map_from_entries(transform(_judged" not in plan(spark, "ensemble_decide")


@pytest.mark.parametrize("name", ["read_sroie", "read_examples"])
def test_pages_meet_their_other_file_without_a_sort(spark, name):
    text = plan(spark, name)
    assert "ShuffledHashJoin" in text and "Sort" not in text and "SortMergeJoin" not in text


def test_written_examples_are_not_gathered_by_a_shuffle(spark):
    from ledgerloom.plans.flows import _examples

    text = _examples(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Aggregate" not in text


def test_an_analysis_is_walked_once_for_all_fields(spark):
    text = plan(spark, "flatten_analysis_result")
    assert text.count("try_variant_get(_doc") == 1


def test_figures_of_fields_shuffle_texts_and_counts_alone(spark):
    text = plan(spark, "field_prf")
    assert text.count("Exchange hashpartitioning") == 2 and not any(word in text for word in ("Sort", "Join", "Window"))


#: Labels of pages with odd ones: nulls, no prefix, names that differ in case, spans that go on.
ODD = [
    (1, ["a", "b", "c", "d", "e", "f"], ["B-X", "I-X", "I-x", "O", "I-X", "I-X"], [None, "I-X", "I-X", "B-X", None, "I-Y"]),
    (2, ["a", "b", "c", "d", "e"], ["Q-X", "B-X", "Q-X", "I-X", "O"], ["O", "O", "O", "O", "O"]),
    (3, [], [], []),
    (4, None, None, None),
    (None, ["z"], ["B-"], ["I-Z"]),
    (5, ["a", "b", "c", "d", "e"], ["B-X", "B-X", "I-X", "B-x", "I-x"], ["B-X", "B-x", "I-x", "B-Y", "O"]),
]


def test_fields_of_pages_are_those_of_their_words(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators import evaluate, tokens

    pages = spark.createDataFrame(ODD, "doc_id long, words array<string>, gold array<string>, predicted array<string>")
    words = pages.filter("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.arrays_zip(F.col("words").alias("word"), "gold", "predicted")).alias("pos", "w")).select("doc_id", "pos", "w.*")
    expected = evaluate.gold_vs_predicted(tokens.gold_fields(words, "gold"), tokens.fields_first_span(words, "predicted"))
    found = tokens.fields_of_pages(pages).collect()
    assert sorted(map(str, (r for r in found if r.doc_id))) == sorted(map(str, expected.collect()))
    assert [(r.field, r.gold, r.predicted) for r in found if r.doc_id is None] in ([("", "z", None), ("z", None, "z")], [("z", None, "z"), ("", "z", None)])


def test_subwords_of_pages_are_those_of_their_words(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators import tokens

    rows = [
        (1, ["a", "b", "c"], [2, 0, 0, 7, None, 2], [5, 1, 0, 2, 3, 4], ["I-X", "I-Y", None, "B-Z", "B-Q", "B-X"], [0.5, 0.25, None, 1.0, 1.0, 0.1]),
        (2, ["a"], [0], [None], ["B-X"], [0.5]),
        (3, ["a", None], [], [], [], []),
        (4, [], [0], [0], ["B-X"], [1.0]),
        (5, None, None, None, None, None),
    ]
    kind = "doc_id long, words array<string>, pos array<long>, sub array<long>, label array<string>, confidence array<double>"
    pages = spark.createDataFrame(rows, kind)
    words = pages.select("doc_id", F.posexplode("words").alias("pos", "word"))
    subs = pages.select("doc_id", F.inline(F.arrays_zip("pos", "sub", "label", "confidence")))
    expected = tokens.subword_to_word(subs, words)
    assert sorted(map(str, tokens.subwords_of_pages(pages).collect())) == sorted(map(str, expected.collect()))


def test_reports_are_made_only_if_asked_for(spark):
    text = plan(spark, "pipeline_logs").lower()
    assert "to_json" not in text and "structstojson" not in text and "map(" not in text


def test_pairs_are_compared_after_all_joins(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators import decide

    amounts = {n: F.col("id").cast("decimal(14,2)") for n in ("total_amount", "subtotal", "tax_amount")}
    texts = {n: F.col("id").cast("string") for n in ("vendor_name", "invoice_number", "purchase_order")}
    side = spark.range(9).withColumns(amounts | texts | {"invoice_date": F.current_date(), "conf_a": F.lit(0.5)}).withColumnRenamed("id", "invoice_id")
    items = side.select("invoice_id", F.col("subtotal").alias("amount"))
    lines = decide.validation_report(side, side, items)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    python = next(k for k, line in enumerate(lines) if "ArrowEvalPython" in line)
    assert not any("Join" in line for line in lines[:python]) and sum("Join" in line for line in lines[python:]) == 2


def test_a_batch_is_cut_from_its_frame_without_a_shuffle(spark):
    from ledgerloom.fixtures import store_view
    from ledgerloom.plans.flows import _batch

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in _batch(spark, DATA, store_view(spark, DATA, "fx_items")):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_an_id_read_twice_has_two_invoices(spark):
    from ledgerloom.operators import extend

    fields = "invoice_id long, vendor_name string, invoice_number string, invoice_date date, currency string, subtotal decimal(14,2), tax_amount decimal(14,2), total_amount decimal(14,2), purchase_order string, conf_a double"
    champ = spark.createDataFrame([(k, v, "X-1", None, "USD", None, None, None, p, 0.9) for k, v, p in ((1, "A", None), (1, "B", "PO-1"), (1, "B", "PO-2"), (2, "A", "PO-2"))], fields)
    lines = spark.createDataFrame([], "doc_id long, line int, text string, confidence double")
    vendors, orders = spark.createDataFrame([("A", "V")], "vendor_name string, vendor_id string"), spark.createDataFrame([("PO-1",)], "purchase_order string")
    items = spark.createDataFrame([], "invoice_id long, description string, amount decimal(14,2)")
    invoices, _, logs = extend.run_pipeline_batch(spark.createDataFrame([(1,), (2,), (None,)], "invoice_id long"), champ, lines, items, vendors, orders)
    found = sorted((r.invoice_id or 0, r.vendor_name or "", r.purchase_order or "", r.vendor_id or "", r.po_valid, r.status) for r in invoices.collect())
    seen = "REVIEW_REQUIRED"
    assert found == [(0, "", "", "", None, "FAILED"), (1, "A", "", "V", True, seen), (1, "B", "PO-1", "", True, seen), (1, "B", "PO-2", "", False, seen), (2, "A", "PO-2", "V", False, seen)]
    assert logs.count() == 4 * 4 + 3


def test_a_stage_timed_twice_has_two_rows(spark):
    from ledgerloom.operators import extend

    key, none = "invoice_id long", "description string, amount decimal(14,2)"
    fields = "vendor_name string, invoice_number string, invoice_date date, currency string, subtotal decimal(14,2), tax_amount decimal(14,2), total_amount decimal(14,2), purchase_order string, conf_a double"
    champ = spark.createDataFrame([(1, "A", "X-1", None, "USD", None, None, None, None, 0.9)], f"{key}, {fields}")
    lines = spark.createDataFrame([], "doc_id long, line int, text string, confidence double")
    vendors, orders = spark.createDataFrame([("A", "V")], "vendor_name string, vendor_id string"), spark.createDataFrame([], "purchase_order string")
    took = spark.createDataFrame([(1, "champ", 5), (1, "champ", 6), (2, "challenger", 7), (3, "champ", 8)], f"{key}, agent string, duration_ms int")
    uploads = spark.createDataFrame([(1,), (2,), (2,)], key)
    invoices, _, logs = extend.run_pipeline_batch(uploads, champ, lines, spark.createDataFrame([], f"{key}, {none}"), vendors, orders, durations=took)
    rows = sorted((r.invoice_id, r.step, r.level, r.message, r.duration_ms or 0) for r in logs.collect())
    failed = "OCR failed: no extraction"
    assert rows == [
        (1, 0, "INFO", "Champ OCR ok", 5), (1, 0, "INFO", "Champ OCR ok", 6), (1, 1, "ERROR", f"Challenger {failed}", 0),
        (1, 2, "INFO", "Validation decision: REVIEW_REQUIRED", 0), (1, 3, "INFO", "vendor_valid=true, po_valid=true", 0),
        (2, 0, "ERROR", f"Champ {failed}", 0), (2, 1, "ERROR", f"Challenger {failed}", 7), (2, 2, "ERROR", "Validation failed: no engine gave an extraction", 0),
    ]
    made = {r.invoice_id: r for r in invoices.collect()}
    assert made[2].status == "FAILED" and made[2].report is None and made[2].po_valid is None and made[1].report.startswith('{"decision":"REVIEW')


def test_white_space_goes_without_a_regular_expression(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions import scalars

    texts = [f"{w}a{w} b{w}{w}" for w in (*scalars.WHITE, "​", "\x1c", "\r\n", "x")] + ["", " ", "\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.trimmed(F.col("t")).alias("a"), scalars.stripped(F.col("t")).alias("b")).collect()
    assert [r for r in rows if r.a != r.b] == []
