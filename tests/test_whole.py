"""Queries go through whole texts, not their beginnings: against plain versions."""

import os
import re

import pytest

import __spark_entry__ as entry
from ledgerloom.fixtures import load
from ledgerloom.functions.scalars import loose_token
from ledgerloom.operators import curate, parse, tokens
from ledgerloom.plans import pages

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


def texts(spark):
    """doc_id -> all words, by the same rule for white space as the view."""
    return {r["doc_id"]: [w for w in re.split(r"\s+", r["text"] or "", flags=re.ASCII) if w] for r in load(spark, DATA, "documents").collect()}


@needs_data
def test_views_hold_whole_texts(spark):
    want = {k: len(ws) for k, ws in texts(spark).items() if ws}
    assert max(want.values()) > 200
    for view in ("fx_words", "fx_labels"):
        assert {r["doc_id"]: r["count"] for r in load(spark, DATA, view).groupBy("doc_id").count().collect()} == want


@needs_data
def test_a_sequence_after_word_200_is_found(spark):
    want = {}
    for k, ws in texts(spark).items():
        bare = [w.lower().rstrip(":,.") for w in ws]
        want[k] = next((i for i in range(len(bare) - 1) if bare[i : i + 2] == ["of", "the"]), -1)
    got = {r["doc_id"]: r["place"] for r in entry.queries()["find_sequence"](spark, DATA).collect()}
    assert got == {k: p for k, p in want.items() if k in got} and set(want) - set(got) == {k for k, ws in texts(spark).items() if not ws}


def greedy(words, values, order):
    """labels of a document's loose tokens; values: (field, tokens)."""
    labels = ["O"] * len(words)
    for field in order:
        runs = sorted((i, len(v)) for f, v in values if f == field and v for i in range(len(words) - len(v) + 1) if words[i : i + len(v)] == v)
        end = 0
        for i, n in runs:
            if labels[i] == "O" and i >= end:
                labels[i : i + n] = [f"B-{field.upper()}"] + [f"I-{field.upper()}"] * (n - 1)
                end = i + n
    return labels


@needs_data
def test_weak_labels_of_whole_texts(spark):
    loose = {}
    for r in load(spark, DATA, "fx_words").select("doc_id", "pos", loose_token("word").alias("w")).orderBy("doc_id", "pos").collect():
        loose.setdefault(r["doc_id"], []).append(r["w"])
    got = {}
    for r in entry.queries()["weak_label"](spark, DATA).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["label"])
    assert set(got) == set(loose)
    for k, ws in loose.items():
        assert got[k] == greedy(ws, [("vendor_name", ws[3:5]), ("invoice_number", ws[7:8])], ["vendor_name", "invoice_number"]), k


def test_weak_labels_of_a_long_text_with_many_runs(spark):
    ws = [("a", "b", "a", "a", "c")[k * k % 5] for k in range(20_000)]
    page = spark.createDataFrame([(1, k, w) for k, w in enumerate(ws)], "doc_id long, pos long, word string")
    values = spark.createDataFrame([(1, "vendor_name", "a a"), (1, "vendor_name", "b"), (1, "currency", "a")], "doc_id long, field string, value string")
    got = [r["label"] for r in tokens.weak_label(page, values, ["vendor_name", "currency"]).orderBy("pos").collect()]
    assert got == greedy(ws, [("vendor_name", ["a", "a"]), ("vendor_name", ["b"]), ("currency", ["a"])], ["vendor_name", "currency"])


@pytest.fixture(scope="module")
def captioned(spark):
    return {r["doc_id"]: r["words"] for r in pages._captioned(spark, DATA).collect()}


def run_of(words, caption):
    """The first place of caption, or -1."""
    bare = [w.lower().rstrip(":,.") for w in words]
    want = [w.lower().rstrip(":,.") for w in caption]
    return next((i for i in range(len(bare) - len(want) + 1) if bare[i : i + len(want)] == want), -1)


def is_like(words, i, pattern):
    return 0 <= i < len(words) and re.search(pattern, words[i], re.ASCII) is not None


def labelled(ws):
    """The labels of auto_label, rule by rule."""
    n, labels = len(ws), ["O"] * len(ws)

    def put(i, size, field):
        for k in range(i, min(i + size, n)):
            labels[k] = ("I-" if k > i else "B-") + field

    def until(start, stop, most):
        return min(next((i for i in range(start, n) if stop(i)), n), start + most, n)

    anchor = lambda i: ws[i] in parse.TAX_CAPTIONS or is_like(ws, i, parse.TAX_ID)
    if (v := run_of(ws, parse.VENDOR_CAPTION)) >= 0:
        v += 2
        v1 = until(v, lambda i: ws[i] in parse.VENDOR_STOPS or anchor(i) or ws[i][:1].isdecimal(), 8)
        put(v, v1 - v, "VENDOR_NAME")
        if v1 > v:
            put(v1, until(v1, anchor, 21) - v1, "VENDOR_ADDRESS")
    if (i := next((i for i in range(n) if is_like(ws, i, parse.TAX_ID)), None)) is not None:
        put(i, 1, "VENDOR_TAX_ID")
    if (i := run_of(ws, parse.NUMBER_CAPTION)) >= 0 and is_like(ws, i + 2, parse.INVOICE_WORD):
        put(i + 2, 1, "INVOICE_NUMBER")
    if (o := run_of(ws, parse.ORDER_CAPTION)) >= 0:
        put(o + 3, until(o + 3, lambda i: not is_like(ws, i, parse.ORDER_WORD), 8) - o - 3, "PURCHASE_ORDER")
    if (i := next((i for i in range(n) if is_like(ws, i, parse.DATE_WORD)), None)) is not None:
        put(i, 1, "INVOICE_DATE")
    for i in range(n):
        name = next((f for k, f in (("CGST", "CGST"), ("IGST", "IGST"), ("SGST", "GST")) if k in ws[i].upper()), None)
        if name and "@" in ws[i] and is_like(ws, i + 1, parse.AMOUNT) and labels[i + 1] == "O":
            put(i + 1, 1, name)
    if (i := next((i for i in range(n) if ws[i] == "Total" and is_like(ws, i + 1, parse.AMOUNT) and labels[i + 1] == "O"), None)) is not None:
        put(i + 1, 1, "TOTAL_AMOUNT")
    for i in range(n):
        if is_like(ws, i, parse.MAIL_HEAD) and is_like(ws, i + 1, parse.MAIL_TAIL):
            put(i, 2, "VENDOR_EMAIL")
    for i in range(n):
        if is_like(ws, i, parse.MAIL_WORD) and labels[i] == "O":
            put(i, 1, "VENDOR_EMAIL")
    for i in range(n):
        if is_like(ws, i, parse.PHONE_WORD):
            put(i, 1, "VENDOR_PHONE")
    if (t := run_of(ws, parse.TERMS_CAPTION)) >= 0:
        put(t + 3, until(t + 3, lambda i: ws[i] in parse.TERMS_STOPS, 4) - t - 3, "TERMS_AND_CONDITIONS")
    if (i := run_of(ws, parse.SERVICE_CAPTION)) >= 1 and ws[i - 1].isdecimal() and labels[i - 1] == "O":
        put(i - 1, 1, "TOTAL_QUANTITY")
    return labels


@needs_data
def test_captions_stand_around_whole_texts(spark, captioned):
    assert {k: len(ws) for k, ws in captioned.items()} == {k: len(ws) + 30 for k, ws in texts(spark).items() if ws}


@needs_data
def test_auto_labels_of_whole_texts(spark, captioned):
    got = {}
    for r in entry.queries()["auto_label"](spark, DATA).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["label"])
    assert set(got) == set(captioned)
    for k, ws in captioned.items():
        assert got[k] == labelled(ws), k


@needs_data
def test_mail_addresses_of_whole_texts(spark, captioned):
    want = {}
    for k, ws in captioned.items():
        for i in range(len(ws)):
            pair = "".join(ws[i : i + 2])
            if is_like(ws, i, parse.EMAIL) or ws[i].endswith(".") and "@" in "".join(ws[i + 1 : i + 2]) and re.search(parse.EMAIL, pair, re.ASCII):
                want[k] = ws[i] if is_like(ws, i, parse.EMAIL) else pair
                break
    got = {r["doc_id"]: r["value"] for r in entry.queries()["postprocess_fields"](spark, DATA).filter("field = 'vendor_email'").collect()}
    assert got == want


@needs_data
def test_extractor_meets_every_language(spark):
    want = {}
    for r in load(spark, DATA, "documents").collect():
        text = r["text"]
        error = "TypeError" if text is None else "ValueError: too short" if len(text) < 100 else None
        want[r["doc_id"]] = (error is None, None if error else f"{len(text)} {text[:10]}", error)
    assert load(spark, DATA, "documents").select("lang").distinct().count() > 1
    got = {r["doc_id"]: (r["success"], r["output"], r["error"] and r["error"].split(":")[0] if r["error"] and r["error"].startswith("TypeError") else r["error"]) for r in entry.queries()["apply_extractor"](spark, DATA).collect()}
    assert got == want


@needs_data
def test_money_of_every_currency(spark):
    shown = {r["shown"][:1] for r in entry.queries()["format_money"](spark, DATA).collect()}
    assert {"$", "€", "¥", "₹"} <= shown


@needs_data
def test_ids_of_the_whole_vocabulary(spark):
    assert {r["id"] for r in entry.queries()["label_id"](spark, DATA).collect()} == set(range(45))


def test_split_draws_without_a_top_k_in_one_task(spark):
    import hashlib

    rows = spark.range(1000).withColumnRenamed("id", "doc_id")
    made = curate.train_eval_split(rows)
    assert "Limit" not in made._jdf.queryExecution().toString() and "TakeOrdered" not in made._jdf.queryExecution().toString()
    want = sorted(range(1000), key=lambda k: hashlib.sha256(f"42:{k}".encode()).hexdigest())[:100]
    assert {r["doc_id"] for r in made.filter("split = 'eval'").collect()} == set(want)


def test_split_keeps_repeated_and_null_keys(spark):
    rows = spark.createDataFrame([(k % 20 or None,) for k in range(200)], "doc_id long")
    got = curate.train_eval_split(rows).collect()
    assert len(got) == 200 and sum(r["split"] == "eval" for r in got) >= 20
