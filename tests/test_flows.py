"""Streams give what a batch gives, and extractors never fail a job."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, extend
from ledgerloom.schemas import STATUSES, TRANSITIONS
from ledgerloom.sources import annotations
from ledgerloom.storage import Store
from ledgerloom.streaming import flows, machine, retrain


def plain_machine(asked):
    """(changes, statuses) of requests (id, seq, target, at), one after the other."""
    status, made, posted = {}, [], {}
    for i, seq, target, at in sorted(asked, key=lambda r: (r[0], r[1], r[2])):
        now = status.get(i, "UPLOADED")
        ok = target in TRANSITIONS[now]
        made.append((i, seq, now, target, ok, at if ok and target == "POSTED" else None))
        status[i] = target if ok else now
        posted[i] = made[-1][5] or posted.get(i)
    return made, sorted((i, s, posted[i]) for i, s in status.items())


REQUESTS = "id long, seq long, target string, at timestamp"


def requests(n, seed):
    """A third of all are id 1's."""
    rng, day = random.Random(seed), datetime(2024, 1, 1)
    targets = [*STATUSES, "PROCESSING", "AUTO_APPROVED", "POSTED", "unknown"]
    return [(1 if rng.random() < 0.33 else rng.randrange(2, 40), seq, rng.choice(targets), day + timedelta(hours=seq)) for seq in range(n)]


def test_status_machine_over_batches(spark, tmp_path):
    asked = requests(900, 1)
    for k in range(0, len(asked), 300):
        spark.createDataFrame(asked[k : k + 300], REQUESTS).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(REQUESTS).parquet(f"{tmp_path}/in")
        flows.stream_status_machine(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    made, statuses = plain_machine(asked)
    store = Store(spark, f"{tmp_path}/out", key="id")
    assert len(store.versions()) == 3
    assert sorted(map(tuple, store.read("changes").collect()), key=lambda r: r[1]) == sorted(made, key=lambda r: r[1])
    assert sorted(map(tuple, store.read("statuses").collect())) == statuses


def test_a_hot_id_is_cut_into_blocks(spark):
    asked = requests(6000, 2)
    df = spark.createDataFrame(asked, REQUESTS)
    sizes = sorted(r["count"] for r in machine.in_blocks(df, 30).groupBy("_block").count().collect())
    assert len(sizes) == 30 and sizes[-1] < 2 * sizes[15]
    found = sorted(map(tuple, machine.changes(df, machine.no_statuses(spark), 30).collect()))
    assert found == sorted(plain_machine(asked)[0])


def test_status_machine_of_odd_requests(spark):
    odd = [(1, None, "PROCESSING", None), (1, 5, None, None), (1, 5, "AUTO_APPROVED", None), (2, None, None, None)]
    before = spark.createDataFrame([(2, "APPROVED", None)], "id long, status string, posted_at timestamp")
    found = sorted(machine.changes(spark.createDataFrame(odd, REQUESTS), before).select("id", "current", "accepted").collect())
    assert list(map(tuple, found)) == [(1, "PROCESSING", False), (1, "PROCESSING", True), (1, "UPLOADED", True), (2, "APPROVED", False)]
    assert machine.changes(spark.createDataFrame([], REQUESTS), before).count() == 0


def test_posting_is_idempotent(spark, tmp_path):
    schema, day = "invoice_id long, status string, at timestamp", datetime(2024, 1, 1)
    batches = [[(1, "AUTO_APPROVED"), (2, "FAILED"), (4, "APPROVED"), (4, "AUTO_APPROVED")], [(1, "AUTO_APPROVED"), (3, "APPROVED"), (2, "APPROVED")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r, day + timedelta(days=k)) for r in rows], schema).write.mode("append").parquet(f"{tmp_path}/in")
        flows.stream_auto_post(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    found = sorted(map(tuple, Store(spark, f"{tmp_path}/out").read("posted").collect()))
    later = day + timedelta(days=1)
    assert found == [(1, "AUTO_APPROVED", "POSTED", day), (2, "APPROVED", "POSTED", later), (3, "APPROVED", "POSTED", later), (4, "APPROVED", "POSTED", day)]


def test_training_is_due_once_at_each_threshold(spark, tmp_path):
    """650 corrections with two trainings, a stream that stops after each file."""
    day, schema = datetime(2024, 1, 1), "seq long, kind string, at timestamp"
    kinds = ["correction"] * 250 + ["training"] + ["correction"] * 230 + ["training"] + ["correction"] * 170
    rows = [(k, kind, day + timedelta(minutes=k)) for k, kind in enumerate(kinds)]
    due, count = [], 0
    for k, kind, _ in rows:
        count = 0 if kind == "training" else count + 1
        if count == 200:
            due.append(k)
            count = 0
    cuts = [0, 130, 131, 420, len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[a:b], schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        retrain.stream_retrain(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    store = Store(spark, f"{tmp_path}/out", key="counter")
    assert len(store.versions()) == 4 and sorted(r.seq for r in store.read("flags").collect()) == due == [199, 450]
    assert store.read("pending").first().pending == count == 170
    found, pending = retrain.flags(spark.createDataFrame(rows, schema), 0, blocks=9)
    assert sorted(r.seq for r in found.collect()) == due and pending == 170


def test_manifest_and_evaluated_documents(spark):
    words = spark.createDataFrame([(1,), (1,), (2,)], "doc_id long")
    values = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", None), (3, "a", "z")], "doc_id long, field string, value string")
    found = annotations.feedback_manifest(words, values).collect()
    assert [(r.sample_id, r.json, r.fields) for r in found] == [("1", "1.json", {"a": "y", "b": None})]
    gold = spark.createDataFrame([(1, "f", " X"), (2, "f", "y"), (3, "f", "z")], "doc_id long, field string, value string")
    guess = spark.createDataFrame([(1, "f", "x"), (2, "f", "q"), (4, "f", "z")], "doc_id long, field string, value string")
    assert tuple(evaluate.evaluated_documents(gold, guess).first()) == (4, 3, 3, 1)
    assert tuple(evaluate.evaluated_documents(gold, guess, words).first()) == (2, 2, 2, 1)


def test_extractor_errors_become_rows(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["success"], r["output"], r["error"]) for r in extend.apply_extractor(df, "int", lambda: lambda t: str(int(t) + 1)).collect()}
    assert got[1] == (True, "6", None) and not got[2][0] and got[2][2].startswith("ValueError") and got[3][2].startswith("TypeError")


def test_extractors_give_the_callers_type(spark):
    def model(text):
        return {"total": float(text), "lines": [text, text]} if text != "odd" else {"total": "no number"}

    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, "odd")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in extend.apply_extractor(df, "m", lambda: model, output="struct<total:double,lines:array<string>>").collect()}
    assert got[1].output.total == 5.0 and got[1].output.lines == ["5", "5"] and got[1].success
    assert [got[k].success for k in (2, 3)] == [False, False] and got[2].output is None and got[3].error.startswith("Arrow")


def test_example_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('{"image": "a.png", "words": ["x"], "bboxes": [[0, 0, 1, 1]], "labels": ["O"]}')
    (tmp_path / "sub/b.json").write_text('{"words": ["x", "y"],\n "bboxes": [[0, 0, 1, 1]], "labels": ["O"]}')
    (tmp_path / "sub/c.json").write_text("not json")
    (tmp_path / "sub/d.json").write_text('{"image": "a.png", "words": ["x"], "bboxes": [[0, 0, 1, 1]], "labels": ["O"]}')
    (tmp_path / "a.png").write_bytes(b"1")
    good, bad = annotations.read_examples(spark, str(tmp_path))
    assert [r["stem"] for r in good.collect()] == ["a"]
    assert {r["stem"]: r["errors"] for r in bad.collect()} == {"b": ["length mismatch"], "c": ["missing keys: words, bboxes, labels"], "d": ["image not found: a.png"]}
    images = spark.createDataFrame([("a",)], "stem string")
    assert annotations.require_image(good, images).count() == 1 and annotations.require_image(good, images.limit(0)).count() == 0
    left = annotations.write_examples(bad.select("stem", F.array(F.lit("q")).alias("words"), F.array(F.array(F.lit(1))).alias("bboxes"), F.array(F.lit("O")).alias("labels")), f"{tmp_path}/out")
    assert left.count() == 3


def test_receipt_lines(spark):
    boxes = spark.createDataFrame([("r", "1,2,9,2,9,5,1,5,Acme, Ltd\nbad\n1,2,3,x,5,6,7,8,no\n0,0,4,0,4,1,0,1, ")], "stem string, value string")
    entities = spark.createDataFrame([("r", '{"company": "ACME, Ltd", "total": ""}')], "stem string, value string")
    got = [(r["word"], r["x0"], r["y0"], r["x1"], r["y1"], r["label"]) for r in annotations.read_sroie(boxes, entities).orderBy("pos").collect()]
    assert got == [("Acme,", 1, 2, 9, 5, "B-VENDOR_NAME"), ("Ltd", 1, 2, 9, 5, "I-VENDOR_NAME")]
