"""Predictions against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import stripped
from .tokens import bio_spans, marked_by_both


def gold_vs_predicted(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc_id, field, gold, predicted over the fields of either side (doc_id, field, value)."""
    a = gold.select("doc_id", "field", F.col("value").alias("gold"))
    b = predicted.select("doc_id", "field", F.col("value").alias("predicted"))
    return a.join(b, ["doc_id", "field"], "full_outer")


def field_prf(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """field, tp, fp, fn, precision, recall, f1. A wrong value counts as both false ones."""
    return field_prf_of_pairs(gold_vs_predicted(gold, predicted))


def field_prf_of_pairs(pairs: DataFrame) -> DataFrame:
    """field_prf of what gold_vs_predicted gives."""
    plain = lambda c: F.lower(stripped(F.col(c)))
    hit = F.coalesce(plain("gold") == plain("predicted"), F.lit(False))
    wrong = lambda side: F.count_if(~hit & F.col(side).isNotNull())
    counts = pairs.groupBy("field").agg(F.count_if(hit).alias("tp"), wrong("predicted").alias("fp"), wrong("gold").alias("fn"))
    over = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(a) + F.col(b))
    rated = counts.withColumns({"precision": over("tp", "fp"), "recall": over("tp", "fn")})
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", 2 * p * r / F.greatest(F.lit(1e-9), p + r))


def evaluated_documents(gold: DataFrame, predicted: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """documents, with_gold, with_predicted, exact: how many documents the figures of field_prf stand
    for. gold and predicted are words (doc_id, ...) or fields of all documents that were evaluated;
    with images (doc_id) only those count that have one. exact is how many have equal fields on both
    sides, where these have field and value."""
    a, b = (df.select("doc_id").distinct().withColumn(n, F.lit(True)) for df, n in ((gold, "_g"), (predicted, "_p")))
    both = a.join(b, "doc_id", "full_outer")
    if {"field", "value"} <= set(gold.columns) & set(predicted.columns):
        pairs = gold_vs_predicted(gold, predicted)
        plain = lambda c: F.lower(stripped(F.col(c)))
        same = pairs.groupBy("doc_id").agg(F.bool_and(F.coalesce(plain("gold") == plain("predicted"), F.lit(False))).alias("_same"))
        both = both.join(same, "doc_id", "left")
    else:
        both = both.withColumn("_same", F.lit(None).cast("boolean"))
    if images is not None:
        both = both.join(images.select("doc_id").distinct(), "doc_id", "left_semi")
    return both.agg(F.count("*").alias("documents"), F.count("_g").alias("with_gold"), F.count("_p").alias("with_predicted"), F.count_if("_same").alias("exact"))


def entity_prf(gold: DataFrame, predicted: DataFrame, label: str = "label") -> DataFrame:
    """tp, n_gold, n_predicted, precision, recall, f1 over entities (field, start, end), all fields
    together; 0 where there is nothing to divide by. Padded words have a null label."""
    keys = ["doc_id", "field", "start", "end"]
    spans = lambda df, side: bio_spans(df.filter(F.col(label).isNotNull()), label).select(*keys, F.lit(1).alias(side))
    both = spans(gold, "g").join(spans(predicted, "p"), keys, "full_outer")
    hit = F.col("g").isNotNull() & F.col("p").isNotNull()
    return _rated_entities(both.agg(F.count_if(hit).alias("tp"), F.count("g").alias("n_gold"), F.count("p").alias("n_predicted")))


def entity_prf_of_words(words: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """entity_prf of words that have both labels, in one pass over them: an entity is found if a word
    ends one of either label that has the same name and began at the same word."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    marked = marked_by_both(words, gold, predicted)
    here = {}
    for tag in ("_g", "_p"):
        name, starts = F.col(f"name{tag}"), F.col(f"starts{tag}")
        goes_on = F.lead(name.isNotNull() & ~starts).over(order)
        here[f"ends{tag}"] = name.isNotNull() & ~F.coalesce(goes_on, F.lit(False))
        here[f"begin{tag}"] = F.last(F.when(starts, F.col("pos")), ignorenulls=True).over(order)
    same = (F.col("name_g") == F.col("name_p")) & (F.col("begin_g") == F.col("begin_p"))
    hit = F.col("ends_g") & F.col("ends_p") & same
    counts = marked.withColumns(here).agg(F.count_if(hit).alias("tp"), F.count_if("starts_g").alias("n_gold"), F.count_if("starts_p").alias("n_predicted"))
    return _rated_entities(counts)


def _rated_entities(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = (ratio(F.col("tp"), F.col(n)) for n in ("n_predicted", "n_gold"))
    rated = counts.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def label_summary(words: DataFrame, label: str = "label") -> DataFrame:
    """field, n, words, labelled, percent: spans per field, beside the totals of all documents. Words
    are read once: the totals are sums over the few rows that are left of the labels."""
    field = F.when(F.col(label).startswith("B-"), F.lower(F.substring(label, 3, 1_000_000)))
    per = words.groupBy(field.alias("field")).agg(F.count("*").alias("n"), F.count_if(F.col(label) != "O").alias("_labelled"))
    every = Window.partitionBy(F.lit(0))
    totals = per.withColumns({"words": F.sum("n").over(every), "labelled": F.sum("_labelled").over(every)})
    percent = F.round(100.0 * F.col("labelled") / F.greatest(F.lit(1), F.col("words")), 1)
    return totals.filter("field IS NOT NULL").select("field", "n", "words", "labelled", percent.alias("percent"))


def document_labels(words: DataFrame, label: str = "label") -> DataFrame:
    return words.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if(F.col(label) != "O").alias("labelled"))


def line_confidence(lines: DataFrame) -> DataFrame:
    """doc_id, confidence: mean of the positive confidences of a page's lines, else 0."""
    return lines.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"))


def uncertain_documents(words: DataFrame, strategy: Column) -> DataFrame:
    return words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "confidence"))).alias("_c")).select("doc_id", F.transform("_c", lambda c: c["confidence"]).alias("confidences"))
