"""Batches replace what is there by invoice, and readers see whole versions."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.annotations import flatten_analysis_result
from ledgerloom.storage import Store, freed, key_buckets, stored_by_key, write_tables

INVOICES, ITEMS, LOGS = "invoice_id long, total long", "invoice_id long, line long", "invoice_id long, message string"


def batch(spark, ids, total, lines):
    invoices = spark.createDataFrame([(i, total) for i in ids], INVOICES)
    items = spark.createDataFrame([(i, k) for i in ids for k in range(lines)], ITEMS)
    return invoices, items, spark.createDataFrame([(i, f"read {total}") for i in ids], LOGS)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_batches_and_a_replay(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert write_tables(spark, path, "a", *batch(spark, range(0, 6), 1, 2), buckets=3) == 1
    assert write_tables(spark, path, "b", *batch(spark, range(4, 8), 2, 0), buckets=3) == 2  # items of 4 and 5 go
    assert write_tables(spark, path, "a", *batch(spark, range(0, 6), 1, 2), buckets=3) == 2  # changes nothing
    store = Store(spark, path)
    assert rows(store.read("invoices")) == [(i, 1 if i < 4 else 2) for i in range(8)]
    assert rows(store.read("items")) == [(i, k) for i in range(4) for k in range(2)]
    assert store.read("logs").count() == 10
    assert rows(store.read("invoices", version=1)) == [(i, 1) for i in range(6)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/store"
    write_tables(spark, path, "a", *batch(spark, range(100), 1, 1), buckets=16)
    before = Store(spark, path).manifest()["tables"]["invoices"]["folders"]
    write_tables(spark, path, "b", *batch(spark, [7], 2, 1))
    after = Store(spark, path).manifest()["tables"]["invoices"]["folders"]
    assert len(before) == len(after) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert Store(spark, path).read("invoices").filter("total = 1").count() == 99


def test_buckets_without_the_keys_are_not_written_anew(spark, tmp_path):
    path = f"{tmp_path}/store"
    write_tables(spark, path, "a", *batch(spark, range(100), 1, 1), buckets=4)
    before = Store(spark, path).manifest()["tables"]
    write_tables(spark, path, "b", *batch(spark, [7, *range(100, 200)], 2, 1))
    after = Store(spark, path).manifest()["tables"]
    for name in ("invoices", "items"):
        kept = [b for b, f in before[name]["folders"].items() if set(f) <= set(after[name]["folders"][b])]
        assert len(kept) == 3
    assert rows(Store(spark, path).read("invoices")) == [(i, 2 if i == 7 or i >= 100 else 1) for i in range(200)]
    assert Store(spark, path).read("items").count() == 200


def test_a_reader_and_a_failed_writer_see_one_version(spark, tmp_path):
    path = f"{tmp_path}/store"
    write_tables(spark, path, "a", *batch(spark, range(6), 1, 2), buckets=2)
    reading = Store(spark, path).read("items")
    invoices, items, logs = batch(spark, range(6), 2, 1)
    with pytest.raises(Exception, match="broken"):
        write_tables(spark, path, "b", invoices, items, logs.withColumn("message", F.raise_error(F.lit("broken")).cast("string")))
    assert rows(Store(spark, path).read("invoices")) == [(i, 1) for i in range(6)]
    write_tables(spark, path, "b", invoices, items, logs)
    assert reading.count() == 12 and Store(spark, path).read("items").count() == 6
    assert Store(spark, path).vacuum() > 0
    assert rows(Store(spark, path).read("invoices")) == [(i, 2) for i in range(6)]


def test_two_writers_of_one_version(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", 2)
    store._manifests.publish("0000000001.json", "{}")
    with pytest.raises(FileExistsError):
        store._manifests.publish("0000000001.json", "{}")
    assert store._manifests.names() == ["0000000001.json"]


def test_other_columns_and_empty_batches(spark, tmp_path):
    path = f"{tmp_path}/store"
    write_tables(spark, path, "none", *(df.limit(0) for df in batch(spark, [1], 1, 1)), buckets=2)
    assert Store(spark, path).read("invoices").count() == 0
    write_tables(spark, path, "a", *batch(spark, [1], 1, 1))
    invoices, items, logs = batch(spark, [2], 1, 1)
    with pytest.raises(ValueError, match="columns of invoices"):
        write_tables(spark, path, "b", invoices.withColumn("more", F.lit(1)), items, logs)


def test_cloud_results_of_all_shapes(spark):
    fields = """{"VendorName": {"value": null, "content": "Acme"}, "InvoiceId": {"value": 12}, "InvoiceDate": {"content": "2024-01-02"},
    "DueDate": {"value": "2024-02-30", "confidence": 0.5}, "SubTotal": {"value": "abc"}, "TotalTax": {"value": {"amount": "1.005"}},
    "InvoiceTotal": {"value": {"amount": 12.5, "code": null}, "confidence": "0.75"}, "Currency": {"value": "EUR"}, "PurchaseOrder": {"value": 77},
    "Items": {"value": [{"value": {"Description": {"value": ""}, "Quantity": {"value": "two"}}}, {}, 5, {"value": {"Amount": {"value": {"amount": 3}}}}]}}"""
    found = {"a": f'{{"documents": [{{"fields": {fields}}}]}}', "b": '{"documents": []}', "c": "{", "d": None, "e": '{"documents": [{}]}', "f": '{"documents": {"x": 1}}'}
    rows = {r.doc_id: r for r in flatten_analysis_result(spark.createDataFrame(list(found.items()), "stem string, value string")).collect()}
    a = rows["a"]
    assert (a.vendor_name, a.invoice_number, a.invoice_date, a.due_date, a.subtotal, str(a.tax_amount), str(a.total_amount)) == ("Acme", None, None, None, None, "1.01", "12.50")
    assert (a.currency, a.purchase_order, a.error) == ("USD", "77", None)
    assert a.confidence_scores["total_amount"] == 0.75 and a.confidence_scores["vendor_name"] == 0.0
    assert [(i.line_number, i.description, int(i.quantity), int(i.unit_price), int(i.amount)) for i in a["items"]] == [(1, "N/A", 1, 0, 0), (2, "N/A", 1, 0, 0), (3, "N/A", 1, 0, 0), (4, "N/A", 1, 0, 3)]
    for k in "bcdf":
        assert rows[k].error == "no document" and rows[k]["items"] == [] and rows[k].currency == "USD"
    assert rows["e"].error is None and rows["e"].vendor_name is None


def by_key(spark, parts):
    """Frames that are stored by key, in as many buckets as shuffles have partitions."""
    return [stored_by_key(df.repartition(key_buckets(spark), "invoice_id")) for df in parts]


def test_frames_stored_by_key_are_written_in_place(spark, tmp_path):
    dealt, placed = f"{tmp_path}/dealt", f"{tmp_path}/placed"
    for name, ids, total, lines in (("a", range(60), 1, 2), ("b", range(40, 80), 2, 1), ("c", range(70, 75), 3, 0)):
        parts = batch(spark, ids, total, lines)
        write_tables(spark, dealt, name, *parts, buckets=key_buckets(spark))
        write_tables(spark, placed, name, *by_key(spark, parts), buckets=key_buckets(spark), in_place=True)
        if name == "a":
            files = [p for p in Path(placed).rglob("*.parquet")]
            assert len(files) == 3 * key_buckets(spark) and len({p.parent for p in files}) == len(files)
    for table in ("invoices", "items", "logs"):
        assert rows(Store(spark, placed).read(table)) == rows(Store(spark, dealt).read(table))
    first, last = (Store(spark, placed).read("invoices", version=v) for v in (1, 3))
    assert first.count() == 60 and last.count() == 80


def test_frames_stored_by_key_meet_without_a_shuffle(spark):
    a, b, c = by_key(spark, batch(spark, range(50), 1, 2))
    made = a.join(b.groupBy("invoice_id").count().hint("merge"), "invoice_id").join(c.hint("shuffle_hash"), "invoice_id", "left_semi")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 50 and made.filter("count = 2").count() == 50
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("by_key_")]


def test_a_store_of_before_keeps_its_hash(spark, tmp_path):
    path = f"{tmp_path}/store"
    store = Store(spark, path, 4)
    del store._new["by"]
    parts = batch(spark, range(20), 1, 1)
    store.commit("a", {"invoices": parts[0], "items": parts[1]}, parts[0], {"logs": parts[2]})
    write_tables(spark, path, "b", *batch(spark, range(10, 30), 2, 1))
    found = Store(spark, path)
    assert "by" not in found.manifest() and rows(found.read("invoices")) == [(i, 1 if i < 10 else 2) for i in range(30)]
    old = found.touched(spark.createDataFrame([(i,) for i in range(30)], "invoice_id long"))
    assert all(rows(found.read("invoices", buckets=[b])) == rows(found.read("invoices").filter(F.pmod(F.xxhash64("invoice_id"), F.lit(4)) == b)) for b in old)


def test_shuffles_of_a_write_are_freed(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with freed(spark):
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
        held = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().filter("count > 0")
        assert held.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    assert held.count() == 7 and sum(r["count"] for r in held.collect() + held.collect()) == 2000
