"""Two extractions of an invoice are paired, compared, merged and decided on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_exchange_text, mean_confidence, sequence_ratios, trimmed
from ..schemas import COMPARED, DEFAULTS, MONEY, Thresholds

KEY = "invoice_id"


def pair_engines(champ: DataFrame, challenger: DataFrame) -> DataFrame:
    """invoice_id, champ and challenger as structs, either null if that engine has no row."""
    a = champ.select(KEY, F.struct(*(c for c in champ.columns if c != KEY)).alias("champ"))
    b = challenger.select(KEY, F.struct(*(c for c in challenger.columns if c != KEY)).alias("challenger"))
    return a.join(b, KEY, "full_outer")


def _amounts_match(a: Column, b: Column, tolerance: str) -> Column:
    one = F.lit(1).cast("decimal(14,2)")
    return F.abs(a - b) <= F.lit(tolerance).cast("decimal(5,4)") * F.greatest(F.abs(a), F.abs(b), one)


def _ratio_bound(a: Column, b: Column) -> Column:
    """What the sequence similarity of two texts cannot exceed: only characters that the other text
    has can match, and no more than the shorter text has."""
    left, right = F.char_length(a), F.char_length(b)
    of_other = lambda x, n, y: n - F.char_length(F.call_function("translate", x, y, F.lit("")))
    return 2.0 * F.least(left, right, of_other(a, left, b), of_other(b, right, a)) / (left + right)


def pair_uploads(ids: DataFrame, champ: DataFrame, challenger: DataFrame) -> DataFrame:
    """pair_engines of these ids (once each), with a row for those that no engine has either. Rows stay
    dealt by id, which they are not after a full join."""
    side = lambda df, name: df.select(KEY, F.struct(*(c for c in df.columns if c != KEY)).alias(name))
    return ids.join(side(champ, "champ"), KEY, "left").join(side(challenger, "challenger"), KEY, "left")


def _both() -> Column:
    return F.col("champ").isNotNull() & F.col("challenger").isNotNull()


def _compared(pairs: DataFrame, cfg: Thresholds, exact: bool = True) -> DataFrame:
    """pairs with _match_ and _like_ of each compared field, of use only where both engines are there.
    Nothing is joined or exploded; Python sees only texts that differ, and unless similarities have to
    be exact only those that may match. Else a similarity may be a bound."""
    texts = [n for n in COMPARED if n not in MONEY]
    plain = lambda side, n: F.lower(trimmed(as_exchange_text(F.col(f"{side}.{n}"))))
    # Columns that several others use are made first: inside of one expression they would be worked
    # out again at each use.
    laid = pairs.withColumns({f"_{side}_{n}": plain(side, n) for side in ("champ", "challenger") for n in texts})
    if not exact:
        laid = laid.withColumns({f"_bound_{n}": _ratio_bound(F.col(f"_champ_{n}"), F.col(f"_challenger_{n}")) for n in texts})
    known, sure = {}, {}
    for name in COMPARED:
        a, b = F.col(f"champ.{name}"), F.col(f"challenger.{name}")
        one, both = a.isNull() | b.isNull(), a.isNull() & b.isNull()
        if name in MONEY:
            near = _amounts_match(a, b, cfg.amount_tolerance)
            apart = 1 - (F.abs(a - b) / F.greatest(F.abs(a) + F.abs(b), F.lit(1).cast("decimal(14,2)"))).cast("double")
            likeness = F.when(near, 1.0).otherwise(apart)
        else:
            near = F.col(f"_champ_{name}") == F.col(f"_challenger_{name}")
            likeness = F.when(near, 1.0)
            if not exact:
                likeness = likeness.when(F.col(f"_bound_{name}") < cfg.similarity, F.col(f"_bound_{name}"))
        known[name] = F.when(both, True).when(one, False).otherwise(near)
        sure[name] = F.when(both, 1.0).when(one, 0.0).otherwise(likeness)
    made = {f"_known_{n}": c for n, c in known.items()} | {f"_sure_{n}": c for n, c in sure.items()}
    laid = laid.withColumns(made)
    # Pairs without an open field cost Python no more than a null.
    is_open = _both() & reduce(Column.__or__, (F.col(f"_sure_{n}").isNull() for n in texts))
    opened = lambda side: F.array(*(F.when(F.col(f"_sure_{n}").isNull(), F.col(f"_{side}_{n}")) for n in texts))
    laid = laid.withColumns({"_a": F.when(is_open, opened("champ")), "_b": F.when(is_open, opened("challenger"))})
    rated = laid.select(*pairs.columns, *made, sequence_ratios(F.col("_a"), F.col("_b")).alias("_r"))

    def judged(name: str) -> dict[str, Column]:
        own, is_known = F.col(f"_sure_{name}"), F.col(f"_known_{name}")
        if name in MONEY:
            return {f"_match_{name}": is_known, f"_like_{name}": F.round(own, 3)}
        ratio = F.get("_r", F.lit(texts.index(name)))
        return {f"_match_{name}": F.when(own.isNull(), ratio >= cfg.similarity).otherwise(is_known), f"_like_{name}": F.round(F.coalesce(own, ratio), 3)}

    return rated.select(*pairs.columns, *(c.alias(n) for name in COMPARED for n, c in judged(name).items()))


def _entry(name: str) -> list[Column]:
    """champ, challenger, match and similarity of a field."""
    values = [as_exchange_text(F.col(f"{side}.{name}")).alias(side) for side in ("champ", "challenger")]
    return [*values, F.col(f"_match_{name}").alias("match"), F.col(f"_like_{name}").alias("similarity")]


def compare_fields(pairs: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """invoice_id, field, champ, challenger, match, similarity (3 decimals), a row per compared field.

    Only pairs with both engines are compared. Two nulls match. Amounts match within the tolerance
    of the larger one; other values as stripped, lower-cased texts, exactly or by a similarity.
    """
    # An outer generator: for an inner one Spark would compare a second time, to filter by.
    fields = F.array(*(F.struct(F.lit(n).alias("field"), *_entry(n)) for n in COMPARED))
    return _compared(pairs, cfg).select(KEY, F.inline_outer(F.when(_both(), fields))).filter("field IS NOT NULL")


def _matches() -> Column:
    """How many fields match, null unless both engines are there."""
    return F.when(_both(), sum((F.when(F.col(f"_match_{n}"), 1).otherwise(0) for n in COMPARED), F.lit(0)))


def agreement_ratio(pairs: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """invoice_id, matches, agreement."""
    rows = _compared(pairs, cfg, exact=False).filter(_both())
    return rows.select(KEY, _matches().cast("long").alias("matches"), (_matches() / len(COMPARED)).alias("agreement"))


def line_item_sum(items: DataFrame) -> DataFrame:
    return items.groupBy(KEY).agg(F.sum("amount").cast("decimal(14,2)").alias("line_sum"), F.count("*").alias("n_items"))


def _math(total: Column, tax: Column, cfg: Thresholds) -> dict[str, Column]:
    """The check of one record's total, beside its line_sum and n_items."""
    skipped = F.col("n_items").isNull() | total.isNull()
    tax = F.coalesce(tax, F.lit(0).cast("decimal(14,2)"))
    computed, declared = F.bround(F.col("line_sum") + tax, 2).cast("decimal(14,2)"), F.bround(total, 2).cast("decimal(14,2)")
    limit = F.lit(cfg.amount_tolerance).cast("decimal(5,4)") * F.greatest(declared, F.lit(1).cast("decimal(14,2)"))
    shown = lambda c: F.when(~skipped, c)
    ok = F.when(skipped, True).otherwise(F.abs(computed - declared) <= limit)
    return {"math_ok": ok, "skipped": skipped, "line_sum": shown(F.col("line_sum")), "tax": shown(tax), "computed_total": shown(computed), "declared_total": shown(declared)}


def math_check(champ: DataFrame, items: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """invoice_id, math_ok, skipped, line_sum, tax, computed_total, declared_total.

    The champ's items and tax have to add up to its total. Without items or a total there is nothing
    to check, and that passes. Cents are rounded half to even.
    """
    rows = champ.select(KEY, "total_amount", "tax_amount").join(line_item_sum(items), KEY, "left")
    return rows.select(KEY, *(c.alias(n) for n, c in _math(F.col("total_amount"), F.col("tax_amount"), cfg).items()))


def _has(pairs: DataFrame, side: str, name: str) -> bool:
    return name in pairs.schema[side].dataType.names


def merged_columns(pairs: DataFrame) -> list[Column]:
    """The columns of merge_extractions but the id."""
    held = lambda n: [F.col(f"{s}.{n}") for s in ("champ", "challenger") if _has(pairs, s, n)]
    names = [n for n in (*COMPARED, "currency", "due_date") if held(n)]
    merged = [F.coalesce(*held(n)).alias(n) for n in names]
    if held("raw"):
        raw = lambda s: F.coalesce(F.col(f"{s}.raw") if _has(pairs, s, "raw") else F.lit(None), F.lit("null"))
        both = F.concat(F.lit('{"champ":'), raw("champ"), F.lit(',"challenger":'), raw("challenger"), F.lit("}"))
        two = F.col("champ").isNotNull() & F.col("challenger").isNotNull()
        merged.append(F.when(two, both).otherwise(F.coalesce(*held("raw"))).alias("raw"))
    return merged


def merge_extractions(pairs: DataFrame) -> DataFrame:
    """invoice_id and the compared fields, currency and due_date: the champ's value, or else the
    challenger's. raw (JSON) has both engines' raw results, or that of the only one.

    Fields that neither side has are left out.
    """
    return pairs.select(KEY, *merged_columns(pairs))


def merge_items(champ_items: DataFrame, challenger_items: DataFrame) -> DataFrame:
    """The champ's items; the challenger's for invoices of which the champ has none."""
    return champ_items.unionByName(challenger_items.join(champ_items.select(KEY).distinct(), KEY, "left_anti"))


def engine_confidence(pairs: DataFrame, side: str) -> Column:
    """Mean of an engine's confidences that are not null, 0 if it has none: those of its map
    confidence_scores, or of its columns conf_*."""
    if _has(pairs, side, "confidence_scores"):
        return mean_confidence(F.col(f"{side}.confidence_scores"))
    scores = [F.col(f"{side}.{n}") for n in pairs.schema[side].dataType.names if n.startswith("conf_")]
    n = sum((s.isNotNull().cast("int") for s in scores), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(s, F.lit(0.0)) for s in scores), F.lit(0.0)) / n).otherwise(0.0)


def with_sums(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs with line_sum and n_items. Before they are compared, since rows are longer then, and no
    longer dealt by id after Python."""
    return pairs.join(line_item_sum(items), KEY, "left")


def compared(pairs: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """pairs with sums, compared: all that a report is made from, in short columns that may be stored."""
    return _compared(pairs, cfg)


def _judged(pairs: DataFrame, cfg: Thresholds) -> DataFrame:
    """Compared pairs with agreement, the check of the total, and decision, confidence (not rounded),
    champ_confidence, challenger_confidence, reasons."""
    rows = pairs.withColumn("agreement", _matches() / len(COMPARED))
    rows = rows.withColumns(_math(F.col("champ.total_amount"), F.col("champ.tax_amount"), cfg))
    both = _both()
    a, b = engine_confidence(pairs, "champ"), engine_confidence(pairs, "challenger")
    weighted = cfg.champ_weight * a + cfg.challenger_weight * b
    confidence = F.when(both, weighted).when(F.col("champ").isNotNull(), a).otherwise(b)
    sure, alike = weighted >= cfg.confidence, F.col("agreement") >= cfg.field_match
    decision = F.when(both & sure & alike & F.col("math_ok"), "AUTO_APPROVED").otherwise("REVIEW_REQUIRED")
    return rows.withColumns(
        {
            "_both": both,
            "decision": decision,
            "confidence": confidence,
            "champ_confidence": F.when(F.col("champ").isNotNull(), a),
            "challenger_confidence": F.when(F.col("challenger").isNotNull(), b),
            "reasons": decision_reasons(both, sure, alike),
        }
    )


def decide(champ: DataFrame, challenger: DataFrame, items: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """invoice_id, decision, confidence (4 decimals), agreement, math_ok, reasons.

    Both engines: AUTO_APPROVED if weighted confidence, agreement and the sum of items all pass, or
    else REVIEW_REQUIRED. One engine: REVIEW_REQUIRED with its own confidence.
    """
    rows = _judged(_compared(with_sums(pair_engines(champ, challenger), items), cfg, exact=False), cfg)
    two = lambda c: F.when(F.col("_both"), F.col(c)).alias(c)
    return rows.select(KEY, "decision", _rounded("confidence", 4).alias("confidence"), two("agreement"), two("math_ok"), "reasons")


def decision_reasons(both: Column, sure: Column, alike: Column) -> Column:
    """Why an invoice was not approved, in order; one text if all passed or an engine is missing."""
    shown = lambda c: F.col(c).cast("string")
    mismatch = F.concat(F.lit("Total mismatch: computed="), shown("computed_total"), F.lit(" declared="), shown("declared_total"))
    found = F.array_compact(
        F.array(
            F.when(~sure, "Confidence below threshold"),
            F.when(~alike, "Field agreement below threshold"),
            F.when(~F.col("math_ok"), mismatch),
        )
    )
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("All checks passed")))
    alone = lambda name: F.array(F.lit(f"{name} OCR unavailable"))
    return F.when(both, found).when(F.col("champ").isNull(), alone("Champ")).otherwise(alone("Challenger"))


def overall_status(invoices: DataFrame, decisions: DataFrame) -> DataFrame:
    """invoice_id, status: the decision, or FAILED where neither engine gave anything."""
    return invoices.select(KEY).join(decisions, KEY, "left").select(KEY, F.coalesce("decision", F.lit("FAILED")).alias("status"))


def _rounded(name: str, digits: int) -> Column:
    return F.round(F.col(name).cast("decimal(12,8)"), digits).cast("double")


def validation_report(champ: DataFrame, challenger: DataFrame, items: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """invoice_id, decision, confidence (4 decimals) and report: decision, agreement_ratio, weighted_confidence, confidence_by_engine,
    thresholds, math_check, a map of fields, and reasons. With one engine only decision and reasons
    are there. One pass over the pairs: nothing is regrouped."""
    return reported(compared(with_sums(pair_engines(champ, challenger), items), cfg), cfg).select(KEY, "decision", "confidence", "report")


def reported(pairs: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Compared pairs with decision, confidence and report, as validation_report has them."""
    rows = _judged(pairs, cfg)
    fields = F.create_map(*(x for n in COMPARED for x in (F.lit(n), F.struct(*_entry(n)))))
    text = lambda c: F.when(~F.col("skipped"), F.col(c).cast("string")).alias(c)
    math = F.struct(
        F.col("skipped"), F.when(F.col("skipped"), "insufficient data").alias("reason"), *map(text, ("line_sum", "tax", "computed_total", "declared_total")),
        F.when(~F.col("skipped"), F.col("math_ok")).alias("within_tolerance"),
    )
    limits = {"confidence": F.lit(cfg.confidence), "field_match": F.lit(cfg.field_match), "amount_tolerance": F.lit(float(cfg.amount_tolerance))}
    engines = F.struct(*(_rounded(f"{s}_confidence", 3).alias(s) for s in ("champ", "challenger")))
    two = lambda c: F.when(F.col("_both"), c)
    report = F.struct(
        F.col("decision"),
        two(F.round("agreement", 3)).alias("agreement_ratio"),
        two(_rounded("confidence", 3)).alias("weighted_confidence"),
        two(engines).alias("confidence_by_engine"),
        two(F.struct(*(v.alias(k) for k, v in limits.items()))).alias("thresholds"),
        two(math).alias("math_check"),
        two(fields).alias("fields"),
        F.col("reasons"),
    )
    return rows.select(*pairs.columns, "decision", _rounded("confidence", 4).alias("confidence"), report.alias("report"))


def mismatch_flags(reports: DataFrame) -> DataFrame:
    """invoice_id and the names of fields that do not match, sorted."""
    wrong = F.map_keys(F.map_filter("report.fields", lambda _, v: ~v["match"]))
    return reports.select(KEY, F.array_sort(F.coalesce(wrong, F.array().cast("array<string>"))).alias("mismatches"))
