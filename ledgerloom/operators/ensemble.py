"""The training toolkit's comparison of two field maps, and promotion of a better model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fields_agree


def _zipped(champ: DataFrame, challenger: DataFrame) -> DataFrame:
    """doc_id, _a and _b (mean confidences) and _pairs: (field, champ, challenger) over all fields that
    either side has, by name. One join; fields are paired within a row."""
    side = lambda df, f, c: df.select("doc_id", F.col("fields").alias(f), F.col("mean_confidence").alias(c))
    rows = side(champ, "_fa", "_a").join(side(challenger, "_fb", "_b"), "doc_id", "full_outer")
    none = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(F.coalesce("_fa", none), F.coalesce("_fb", none), lambda _, x, y: F.struct(x.alias("champ"), y.alias("challenger")))
    pair = lambda e: F.struct(e["key"].alias("field"), e["value"]["champ"].alias("champ"), e["value"]["challenger"].alias("challenger"))
    return rows.select("doc_id", "_a", "_b", F.array_sort(F.transform(F.map_entries(both), pair)).alias("_pairs"))


def field_key_union(champ: DataFrame, challenger: DataFrame) -> DataFrame:
    """doc_id, field, champ, challenger over all fields that either side has.

    Sides have doc_id (once each), fields (map<string,string>) and mean_confidence.
    """
    return _zipped(champ, challenger).select("doc_id", F.inline_outer("_pairs")).filter("field IS NOT NULL")


def ensemble_decide(champ: DataFrame, challenger: DataFrame, auto: float = 0.9, min_conf: float = 0.75) -> DataFrame:
    """doc_id, decision, fields, mismatches, agreement, confidence, reasons.

    A field that agrees keeps the champ's value, or else the challenger's; one that does not gets
    the value of the more confident side, the champ's on a tie, and '' for a null.
    """
    a, b = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    better = lambda p: F.when(a >= b, p["champ"]).otherwise(p["challenger"])
    kept = lambda p: F.when(p["ok"], F.coalesce(F.nullif(p["champ"], F.lit("")), p["challenger"])).otherwise(better(p))
    agreed = F.transform("_pairs", lambda p: F.struct(p["field"].alias("field"), p["champ"].alias("champ"), p["challenger"].alias("challenger"), fields_agree(p["field"], p["champ"], p["challenger"]).alias("ok")))
    judged = _zipped(champ, challenger).withColumn("_judged", agreed)
    wrong = F.transform(F.filter("_judged", lambda p: ~p["ok"]), lambda p: p["field"])
    rows = judged.withColumns({"_n": F.size("_judged"), "mismatches": wrong, "confidence": (a + b) / 2})
    rows = rows.withColumn("fields", F.when(F.col("_n") > 0, F.map_from_entries(F.transform("_judged", lambda p: F.struct(p["field"], F.coalesce(kept(p), F.lit("")))))))
    rows = rows.withColumn("agreement", F.when(F.col("_n") > 0, (F.col("_n") - F.size("mismatches")) / F.col("_n")).otherwise(0.0))
    # By the number of pairs, so that a query without fields need not make them.
    none = F.col("_n") == 0
    auto_ok = ~none & (F.col("agreement") >= auto) & (F.col("confidence") >= min_conf)
    low = F.format_string("Low agreement: %.0f%%", F.col("agreement") * 100)
    unsure = F.when(F.col("confidence") < min_conf, F.format_string("Low confidence: %.2f", F.col("confidence")))
    others = F.array_compact(F.array(unsure, F.when(F.size("mismatches") > 0, F.concat(F.lit("Mismatches on: "), F.array_join("mismatches", ", ")))))
    empty = F.array().cast("array<string>")
    reasons = F.when(none, F.array(F.lit("Both engines returned no fields."))).when(auto_ok, empty).when(F.col("agreement") < 0.5, F.array(low)).otherwise(others)
    decision = F.when(auto_ok, "AUTO_APPROVE").otherwise("REVIEW_REQUIRED")
    return rows.select("doc_id", decision.alias("decision"), "fields", "mismatches", "agreement", "confidence", reasons.alias("reasons"))


def promote_challenger(prf_by_model: DataFrame) -> DataFrame:
    """The model to use: the challenger if its f1 is better than the champ's. Rows: model, f1."""
    best = prf_by_model.groupBy().pivot("model", ["champ", "challenger"]).agg(F.max("f1"))
    return best.select(F.when(F.coalesce("challenger", F.lit(-1.0)) > F.coalesce("champ", F.lit(-1.0)), "challenger").otherwise("champ").alias("promoted"), F.col("champ").alias("champ_f1"), F.col("challenger").alias("challenger_f1"))
