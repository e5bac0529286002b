"""Quality rules: a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed
rule. A policy is a set of bits with a version. Verdicts and ablations read the ledger's bits only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .flat import Flat, grams, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_bangs")

#: name -> the document fails. A rule's bit is its place here; new rules are added at the end.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "n_dup_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines",
    "capitals": "100 * n_capitals > 50 * n_letters",
    "bangs": "100 * n_bangs > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}

#: Policies by version. base-1 holds the rules that every policy holds.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "strict-1": tuple(RULES),
}


def policy_mask(version: str) -> int:
    return sum(BITS[name] for name in POLICIES[version])


_SYMBOLS, _LETTERS, _CAPITALS, _BANGS, _STARTS = (np.zeros(256, bool) for _ in range(5))
_SYMBOLS[list(b"#*$%&|<>")] = True
_CAPITALS[65:91] = True
_LETTERS[65:91] = _LETTERS[97:123] = True
_BANGS[ord("!")] = True
_STARTS[:128] = _STARTS[192:] = True  # the first byte of each code point
_STARTS[[0x20, *range(0x09, 0x0E)]] = False


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    flat = Flat(texts)
    begin, end, text = flat.words()
    count = lambda x: np.bincount(x, minlength=flat.n).astype(np.int64)
    hashes = flat.hashes(begin, end)
    three, first = grams(hashes, text, 3)
    twice = first[_repeats(three + text[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))] if len(three) else first
    marked = np.zeros(len(begin) + 2, bool)
    for k in range(3):
        marked[twice + k] = True
    l_begin, l_end, l_text = flat.runs(flat.data == 10)
    with_word = np.searchsorted(begin, l_end) > np.searchsorted(begin, l_begin)
    l_begin, l_end, l_text = l_begin[with_word], l_end[with_word], l_text[with_word]
    l_keys = flat.hashes(l_begin, l_end) + l_text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    _, distinct = np.unique(l_keys, return_index=True)
    values = (
        count(text), flat.per_text(_STARTS[flat.data]), flat.per_text(_SYMBOLS[flat.data]), count(l_text) - count(l_text[distinct]), count(text[marked[: len(begin)]]),
        count(l_text), flat.per_text(_LETTERS[flat.data]), flat.per_text(_CAPITALS[flat.data]), flat.per_text(_BANGS[flat.data]),
    )
    return dict(zip(MEASURES, values, strict=True))


def _entries(docs: DataFrame, own: list[str]) -> DataFrame:
    """_own (a struct of docs' columns), the measurements and failed_bits, a row per row of docs."""
    source = docs.select(F.struct(*own).alias("_own"), F.col("text").alias("_text"))
    if "text" in own:  # it goes to Python once
        source = source.drop("_text")
    schema = T.StructType([source.schema["_own"], *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def measure(batches):
        for batch in batches:
            texts = batch.column("_own").field("text") if "text" in own else batch.column("_text")
            for begin, end in slices(texts):
                part = measured(texts[begin:end])
                yield pa.RecordBatch.from_arrays([batch.column("_own")[begin:end], *(pa.array(part[m], pa.int64()) for m in MEASURES)], names=["_own", *MEASURES])

    return source.mapInArrow(measure, schema).withColumn("failed_bits", failed_bits())


def ledger(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, the measurements and failed_bits, a row per row of docs (key, text).

    Texts are measured whole. Null and empty texts measure 0 everywhere and fail few_words. Lines
    count if they hold a word; a line repeats if an earlier one of the text equals it. Other columns
    of docs are ignored, so their names cannot clash; an empty table gives an empty ledger. Rows do
    not depend on each other, so repeated rows get equal entries.
    """
    return _entries(docs, [key]).select(f"_own.{key}", *MEASURES, "failed_bits")


def failed_bits() -> Column:
    bits = F.lit(0).cast("long")
    for name, fails in RULES.items():
        bits = bits + F.when(F.expr(fails), BITS[name]).otherwise(0)
    return bits


def passes(version: str) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0


def ablations(entries: DataFrame, version: str) -> DataFrame:
    """(rule, documents, words): what the policy would keep besides, if it lacked the rule.

    Entries are first counted by bits, of which there are few, and rules are tried on the counts.
    """
    mask = policy_mask(version)
    counted = entries.groupBy("failed_bits").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[version]))
    tried = counted.select("*", F.explode(rules).alias("_r")).select("*", "_r.*")
    saved = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) == F.col("bit")
    sums = (F.coalesce(F.sum(F.when(saved, F.col(c))), F.lit(0)).alias(a) for c, a in (("n", "documents"), ("w", "words")))
    return tried.groupBy("rule").agg(*sums)


def keep_good(docs: DataFrame, version: str = "strict-1") -> DataFrame:
    """The rows of docs, with all their columns, that the policy passes."""
    return _entries(docs, docs.columns).filter(passes(version)).select("_own.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    entries = ledger(common.table(spark, sf_dir, "documents"))
    return entries.select("doc_id", *MEASURES[:5], (~passes("base-1")).alias("base_failed"), passes("strict-1").alias("kept"), "failed_bits")


_COUNTS = {"n_symbols": r"[^#*$%&|<>]", "n_letters": "[^A-Za-z]", "n_capitals": "[^A-Z]", "n_bangs": "[^!]"}
OP4_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '{common.WORD}') AS ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{common.WORD}')) AS ls FROM texts),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM split),
grams AS (SELECT doc_id, pos, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
counted AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM grams WHERE w3 IS NOT NULL),
repeated AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM counted, range(3) t(k) WHERE n > 1 GROUP BY doc_id),
measured AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  {", ".join(f"CAST(length(regexp_replace(text, '{p}', '', 'g')) AS BIGINT) AS {c}" for c, p in _COUNTS.items())},
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ls) AS BIGINT) AS n_lines FROM split LEFT JOIN repeated USING (doc_id)),
bits AS (SELECT *, CAST({" + ".join(f"CASE WHEN {r} THEN {BITS[n]} ELSE 0 END" for n, r in RULES.items())} AS BIGINT) AS failed_bits FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & {policy_mask("base-1")}) <> 0 AS base_failed, (failed_bits & {policy_mask("strict-1")}) = 0 AS kept, failed_bits FROM bits
"""
