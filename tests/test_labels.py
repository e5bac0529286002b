"""Labels by both sides in one pass, and labels by captions, against plain Python."""

from __future__ import annotations

import random
import re

from ledgerloom.operators import evaluate, parse, tokens


def _spans(labels: list[str]) -> set[tuple[str, int, int]]:
    found, name, begin = set(), None, 0
    for k, label in enumerate([*labels, "O"]):
        new = None if label == "O" else label[2:]
        if new is None or label.startswith("B-") or new != name:
            if name is not None:
                found.add((name, begin, k - 1))
            begin = k
        name = new
    return found


def test_entities_of_words_with_both_labels(spark):
    rnd = random.Random(3)
    kinds = ["O", "O", "B-A", "I-A", "B-B", "I-B"]
    rows, hits, n_gold, n_predicted = [], 0, 0, 0
    for doc in range(40):
        gold = [rnd.choice(kinds) for _ in range(rnd.randint(0, 30))]
        predicted = [g if rnd.random() < 0.7 else rnd.choice(kinds) for g in gold]
        rows += [(doc, k, "w", g, p) for k, (g, p) in enumerate(zip(gold, predicted))]
        rows += [(doc, 100, "pad", None, "B-A"), (doc, 101, "pad", "B-A", None)]
        a, b = _spans(gold), _spans(predicted)
        hits, n_gold, n_predicted = hits + len(a & b), n_gold + len(a), n_predicted + len(b)
    words = spark.createDataFrame(rows, "doc_id int, pos long, word string, gold string, predicted string").repartition(5)
    r = evaluate.entity_prf_of_words(words).first()
    assert (r["tp"], r["n_gold"], r["n_predicted"]) == (hits, n_gold, n_predicted) and 0 < hits < n_gold
    kept = words.filter("word = 'w'")
    sides = [kept.withColumn("label", kept[c]) for c in ("gold", "predicted")]
    assert evaluate.entity_prf(*sides).collect() == evaluate.entity_prf_of_words(kept).collect()


def test_entities_of_no_words(spark):
    none = spark.createDataFrame([], "doc_id int, pos long, word string, gold string, predicted string")
    assert evaluate.entity_prf_of_words(none).collect() == [(0, 0, 0, 0.0, 0.0, 0.0)]
    assert evaluate.label_summary(none.withColumnRenamed("gold", "label")).collect() == []


def test_label_summary_counts_every_word_once(spark):
    rows = [(1, 0, "B-A"), (1, 1, "I-A"), (1, 2, "O"), (2, 0, "B-A"), (2, 1, "B-B"), (2, 2, None)]
    words = spark.createDataFrame(rows, "doc_id int, pos long, label string")
    got = {r["field"]: tuple(r)[1:] for r in evaluate.label_summary(words).collect()}
    assert got == {"a": (2, 6, 4, 66.7), "b": (1, 6, 4, 66.7)}


def test_marks_of_several_labels_are_those_of_each_alone(spark):
    rows = [(1, k, "w", g, p) for k, (g, p) in enumerate(zip(["B-A", "I-A", "I-B", "O", "I-B"], ["O", "I-A", "B-A", "B-A", "O"]))]
    words = spark.createDataFrame(rows, "doc_id int, pos long, word string, gold string, predicted string")
    marked = tokens.marked_by_both(words).orderBy("pos").collect()
    assert [r["span_g"] for r in marked] == [1, 1, 2, 2, 3] and [r["span_p"] for r in marked] == [0, 1, 2, 3, 3]
    assert [r["name_p"] for r in marked] == [None, "A", "A", "A", None]


WORDS = [
    "Tax", "tax:", "Invoice", "No.", "Buyer's", "Order", "Mode/Terms", "of", "Payment", "Service", "Call", "Charge", "Plot", "GSTIN/UIN:", "12ABCDE1234F1Z5",
    "1-Jan-24", "CGST@9%", "SGST@", "IGST@18", "Total", "1,234.50", "12", "jo.", "x@y.com", "+911234567890", "AB/12-3", "Other", "word", "", "٣٤", None,
]


def _plain_labels(words: list[str | None]) -> list[str]:
    """The rules one after another, each over a list of labels."""
    n, labels = len(words), ["O"] * len(words)
    like = lambda i, p: 0 <= i < n and words[i] is not None and re.search(p.replace(r"\p{Nd}", r"\d"), words[i], 0 if r"\p" in p else re.ASCII) is not None
    bare = [None if w is None else w.rstrip(":,.").lower() for w in words]

    def caption(c):
        want = [w.rstrip(":,.").lower() for w in c]
        return next((k for k in range(n - len(c) + 1) if bare[k : k + len(c)] == want), None)

    def put(begin, end, name, free=False):
        if not free or labels[begin] == "O":
            labels[begin:end] = ["B-" + name] + ["I-" + name] * (end - begin - 1)

    def until(begin, most, stop):
        return next((k for k in range(begin, min(begin + most, n)) if stop(k)), min(begin + most, n))

    anchor = lambda k: words[k] in parse.TAX_CAPTIONS or like(k, parse.TAX_ID)
    if (v := caption(parse.VENDOR_CAPTION)) is not None:
        v1 = until(v + 2, 8, lambda k: words[k] in parse.VENDOR_STOPS or anchor(k) or like(k, r"^\p{Nd}"))
        if v1 > v + 2:
            put(v + 2, v1, "VENDOR_NAME")
            if (a1 := until(v1, 21, anchor)) > v1:
                put(v1, a1, "VENDOR_ADDRESS")
    for k in [k for k in range(n) if like(k, parse.TAX_ID)][:1]:
        put(k, k + 1, "VENDOR_TAX_ID")
    if (k := caption(parse.NUMBER_CAPTION)) is not None and like(k + 2, parse.INVOICE_WORD):
        put(k + 2, k + 3, "INVOICE_NUMBER")
    if (k := caption(parse.ORDER_CAPTION)) is not None and (end := until(k + 3, 8, lambda i: words[i] is not None and not like(i, parse.ORDER_WORD))) > k + 3:
        put(k + 3, end, "PURCHASE_ORDER")
    for k in [k for k in range(n) if like(k, parse.DATE_WORD)][:1]:
        put(k, k + 1, "INVOICE_DATE")
    names = [("CGST", "CGST"), ("IGST", "IGST"), ("SGST", "GST")]
    for k in range(n - 1):
        name = next((f for c, f in names if words[k] and "@" in words[k] and c in words[k].upper()), None)
        if name and like(k + 1, parse.AMOUNT):
            put(k + 1, k + 2, name, free=True)
    for k in [k for k in range(1, n) if words[k - 1] == "Total" and like(k, parse.AMOUNT) and labels[k] == "O"][:1]:
        put(k, k + 1, "TOTAL_AMOUNT")
    for k in range(n - 1):
        if like(k, parse.MAIL_HEAD) and like(k + 1, parse.MAIL_TAIL):
            put(k, k + 2, "VENDOR_EMAIL")
    for k in range(n):
        if like(k, parse.MAIL_WORD):
            put(k, k + 1, "VENDOR_EMAIL", free=True)
    for k in range(n):
        if like(k, parse.PHONE_WORD):
            put(k, k + 1, "VENDOR_PHONE")
    if (k := caption(parse.TERMS_CAPTION)) is not None and (end := until(k + 3, 4, lambda i: words[i] in parse.TERMS_STOPS)) > k + 3:
        put(k + 3, end, "TERMS_AND_CONDITIONS")
    if (k := caption(parse.SERVICE_CAPTION)) and like(k - 1, r"^\p{Nd}+$"):
        put(k - 1, k, "TOTAL_QUANTITY", free=True)
    return labels


def test_automatic_labels_of_random_pages(spark):
    rnd = random.Random(8)
    runs = [["Tax", "Invoice"], ["Invoice", "No.", "AB/1"], ["Buyer's", "Order", "No.", "AB/12", "VZ/9,"], ["Mode/Terms", "of", "Payment", "Net"], ["12", "Service", "Call", "Charge"], ["CGST@9", "12.50"], ["Total", "100"], ["jo.", "x@y.com"]]
    pages = [[], ["Tax", "Invoice"], ["o"] * 20 + ["1-Jan-24"]]
    pages += [[w for _ in range(rnd.randint(0, 25)) for w in (rnd.choice(runs) if rnd.random() < 0.3 else [rnd.choice(WORDS)])] for _ in range(600)]
    table = spark.createDataFrame([(k, p) for k, p in enumerate(pages)] + [(-1, None)], "doc_id int, words array<string>").repartition(4)
    got = {r["doc_id"]: r["labels"] for r in parse.auto_label(table).collect()}
    assert got.pop(-1) is None
    assert got == {k: _plain_labels(p) for k, p in enumerate(pages)}
