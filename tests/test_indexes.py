"""Pages, searches and parts of stored tables equal those of whole ones, and read less."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.indexes import SortedIndex, TextIndex, literals, numbered_chunks
from ledgerloom.operators import listing


def table(spark, n=500):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, *range(40)]), f"INV-{k * 7 % 1000:04d}", rng.choice([None, "Acme_Co", "ACME 50%", "Öl & Söhne", "x"])) for k in range(n)]
    return spark.createDataFrame(rows, "invoice_id long, total_amount long, invoice_number string, vendor_name string")


@pytest.mark.parametrize("way", ["asc", "desc"])
def test_pages(spark, tmp_path, way):
    df = table(spark)
    index = listing.sorted_index(df, f"{tmp_path}/{way}", "total_amount", way)
    whole = [tuple(r) for r in listing.sorted_list(df, "total_amount", way).collect()]
    assert index.count() == len(whole)
    for number, size in ((1, 20), (7, 20), (25, 20), (26, 20), (2, 300), (3, 170), (9, 1)):
        assert [tuple(r) for r in index.page(number, size).collect()] == whole[(number - 1) * size : number * size]


def test_a_late_page_reads_one_range(spark, tmp_path):
    df = table(spark)
    index = SortedIndex.build(df, f"{tmp_path}/x", [F.col("invoice_id")], 25)
    assert len(index.ranges_of(480, 5)[0]) <= 2 and len(index._ranges) > 20
    plan = index.page(97, 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*_range", plan)
    assert [r.invoice_id for r in index.page(97, 5).collect()] == list(range(480, 485))


def test_pages_of_an_empty_list(spark, tmp_path):
    index = SortedIndex.build(table(spark).limit(0), f"{tmp_path}/x", [F.col("invoice_id")], 4)
    assert index.count() == 0 and index.page(3, 20).count() == 0
    search = TextIndex.build(table(spark).limit(0), f"{tmp_path}/y", ("vendor_name",), 4, [F.col("invoice_id")])
    assert search.contains(("vendor_name",), "acme")[0].count() == 0


@pytest.mark.parametrize("text", ["inv-00", "0_7", "acme%0", "ACME_CO", "öl", "söhne", "x", "%", "no such text", "50\\%", "INV-0007"])
def test_searches(spark, tmp_path, text):
    df = table(spark).coalesce(2)
    index = TextIndex.build(df, f"{tmp_path}/x", ("invoice_number", "vendor_name"), 16, [F.col("invoice_number")])
    found, share = index.contains(("invoice_number", "vendor_name"), text)
    hit = F.coalesce(F.col("invoice_number").ilike(f"%{text}%"), F.lit(False)) | F.coalesce(F.col("vendor_name").ilike(f"%{text}%"), F.lit(False))
    assert sorted(r.invoice_id for r in found.collect()) == sorted(r.invoice_id for r in df.filter(hit).collect())
    assert 0 <= share <= 1 and (share < 0.2 if text in ("INV-0007", "no such text") else True)


def test_literals():
    assert literals("aB_c%%de\\%f") == ["ab", "c", "de%f"] and literals("%_") == [] and literals("a\\") == ["a\\"]


def test_parts_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(50), k) for k in range(900)]
    df = spark.createDataFrame(rows, "invoice_id long, at long, log_id long")
    found = numbered_chunks(df, "invoice_id", [F.col("at"), F.col("log_id")], 50, 12).collect()
    expected, places = [], {}
    for key, at, log in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        places[key] = places.get(key, -1) + 1
        expected.append((key, at, log, places[key] // 50))
    assert sorted(map(tuple, found), key=lambda r: r[2]) == sorted(expected, key=lambda r: r[2])
    assert numbered_chunks(df.limit(0), "invoice_id", [F.col("at")], 50).count() == 0


def test_details_in_parts(spark):
    logs = spark.createDataFrame([(1, k, k, "a", "INFO", 1, f"said {k}") for k in range(25)], "invoice_id long, created_at long, log_id long, agent string, level string, duration_ms int, message string")
    invoices = spark.createDataFrame([(1,), (2,)], "invoice_id long")
    items = spark.createDataFrame([(1, 1, "x", 1, 1, 1)], "invoice_id long, line_number int, description string, quantity int, unit_price int, amount int")
    rows = {(r.invoice_id, r.part): r for r in listing.detail_parts(invoices, items, logs, 10).collect()}
    assert sorted(rows, key=str) == [(1, 0), (1, 1), (1, 2), (2, None)]
    assert [len(rows[1, k].logs) for k in range(3)] == [10, 10, 5] and rows[1, 2].logs[-1].message == "said 24"
    assert len(rows[1, 0]["items"]) == 1 and rows[1, 1]["items"] is None and rows[2, None].logs == []
