"""Pages read a slice at a time are as from_json reads each of them."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import annotations as A

WORD = '{"text": "a", "confidence": 0.5, "polygon": [[1.5, 2.5], [9, -3.25]]}'
OCR = [
    f'{{"pages": [{{"lines": [{WORD}, {WORD}]}}, {{"lines": []}}, {{"lines": [{WORD}]}}]}}',
    '{"pages": [{"lines": [{"text": ""}, {"text": "b\\"\\u00e9"}, null, {"confidence": 1}, {"text": "c", "polygon": []}]}], "other": [1]}',
    '{"pages": [{"lines": [{"text": "d", "polygon": [[], [1], [null, 7.5], null, [1e300, -1e300]]}]}]}',
    '{"pages": [{"lines": [{"text": 7, "confidence": 1}]}]}',
    "{\"pages\": [{\"lines\": [{'text': 'single'}]}]}",
    '{"pages": [{"lines": [{"text": "e", "confidence": "high"}]}]}',
    '{"pages": [{"lines": [{"text": "lost"}]}, null]}',
    '{"pages": [{"lines": [{"text": "lost"}]}, {}]}',
    '{"pages": null}', '{}', "[]", "", " ", "broken", "null", None,
    f'{{"pages":\n[{{"lines": [{WORD}]}}]}}',
    f'{{"pages": [{{"lines": [{WORD}]}}]}} {{"pages": []}}',
    f'{{"pages": [{{"lines": [{WORD}]}}]}} null', "{}null", "5", '"x"', "true", '{"pages": [{"lines": [{"text": "} null"}]}]}',
]
FORMS = [
    '{"form": [{"words": [{"text": "\\u2003 a b\\n", "box": [1, 2, 3, 4]}, {"text": " ", "box": [1, 2, 3, 4]}, {"text": "c", "box": [1, 2, 3]}]}]}',
    '{"form": [{"words": [{"text": "\\u001fd", "box": [1, null, 3, 4]}, {"text": "e"}, {"box": [1, 2, 3, 4]}, null]}, {"words": []}]}',
    '{"form": [{"words": [{"text": "f", "box": [1.5, 2, 3, 4]}, {"text": "g", "box": [1, 2, 3, 4]}]}]}',
    '{"form": [{"words": [{"text": "h", "box": [1, 2, 3, 4]}]}, {"words": null}]}',
    "broken", "", None,
]


@pytest.mark.parametrize(("read", "plain", "texts"), [(A.flatten_ocr_pages, A.ocr_lines, OCR), (A.read_funsd, A.funsd_words, FORMS)])
def test_odd_pages_are_read_as_from_json_reads_them(spark, read, plain, texts):
    pages = spark.createDataFrame(list(enumerate(texts)), "k int, value string").select(F.col("k").cast("string").alias("stem"), "value").coalesce(1)
    rows = pages.select("stem", F.posexplode(plain(F.col("value"))).alias("pos", "w")).select("stem", "pos", "w.*")
    found = sorted(str(tuple(r)[: len(rows.columns)]) for r in read(pages).collect())
    assert found == sorted(str(tuple(r)) for r in rows.collect()) and len(found) >= 3
    alone = sorted(str(tuple(r)[: len(rows.columns)]) for r in read(pages.filter("stem = '0'")).collect())
    assert alone and alone == [r for r in found if r.startswith("('0'")]


@pytest.mark.parametrize("name", ["flatten_ocr_pages", "read_funsd"])
def test_pages_are_read_by_slices(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "from_json(StructField" not in plan.split("MapInArrow")[-1] and plan.count("MapInArrow") == 2
