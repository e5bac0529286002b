"""Scalar functions, Column to Column."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FUZZY_FIELDS, LABELS, NUMERIC_FIELDS, RATES, SYMBOLS
from . import sequences


def _lookup(values: dict, key: Column, default) -> Column:
    made = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(made, key), F.lit(default))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: inside of a lambda Spark would do so at each use and element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(value: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


#: What (?U)\\s matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(value: Column) -> Column:
    """The same as stripped, without a regular expression; most values have no white space to take off."""
    return F.trim(value, F.lit(WHITE))


def normalize_text(value: Column) -> Column:
    """One space for each run of white space, none at the ends, lower case."""
    return F.lower(stripped(F.regexp_replace(value, r"(?U)\s+", " ")))


def normalize_numeric(value: Column) -> Column:
    """The number in a text to two decimals, as text; null if its digits, dots and signs are none."""
    number = F.regexp_replace(value, r"[^0-9.\-]", "").try_cast("double")
    return F.when(number.isNotNull(), F.format_string("%.2f", number))


#: A number that normalize_numeric leaves as it is: two decimals, and no more digits than a double holds.
_CENTS = r"^-?(?:0|[1-9][0-9]{0,12})\.[0-9]{2}\z"


def _numbers_equal(a: Column, b: Column) -> Column:
    """Equal by normalize_numeric, which most amounts, that are written alike, need not go through."""
    plain = a.rlike(_CENTS) & b.rlike(_CENTS)
    return F.when(plain, a == b).otherwise(F.coalesce(normalize_numeric(a) == normalize_numeric(b), F.lit(False)))


def loose_token(value: Column) -> Column:
    """Lower case, without outer white space and then punctuation."""
    return F.regexp_replace(F.lower(stripped(value)), r"^[,.:;()\[\]{}]+|[,.:;()\[\]{}]+$", "")


def bare_word(word: Column) -> Column:
    """A word in lower case, without trailing ":,."."""
    return F.lower(F.rtrim(word, F.lit(":,.")))


def find_sequence(words: Column, sequence: list[str], start: int = 0, among: Column | None = None) -> Column:
    """The 0-based place from which words equal sequence, but for case and trailing ":,."; else -1.
    Only places of `among` are looked at, if that is given."""
    want = [s.lower().rstrip(":,.") for s in sequence]
    n = F.size(words) - len(want) + 1
    same = lambda i: reduce(Column.__and__, (bare_word(F.get(words, i + k)) == w for k, w in enumerate(want)))
    if among is None:
        among = F.when(n > start, F.sequence(F.lit(start), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(among, lambda i: (i >= start) & same(i)), F.lit(0)), F.lit(-1))


def error_text(value: Column) -> Column:
    return F.substring(value, 1, 2000)


def storage_key(uri: Column) -> Column:
    """The path of a stored object below its container, without scheme or leading slashes."""
    return F.regexp_replace(F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"^/+", "")


def file_stem(name: Column) -> Column:
    """A file's name without its last extension, with spaces and dots as underscores."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.translate(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), " .", "__")


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(sequences.ratios(a.tolist(), b.tolist()), dtype="float64")


def _array_ratios(pairs: pa.Array) -> pa.Array:
    """All elements of a batch at once."""
    there = pairs.is_valid().to_numpy(zero_copy_only=False)
    held = [json.loads(p) for p in pairs.drop_null().to_pylist()]
    found = sequences.ratios(*([v for h in held for v in h[side]] for side in ("a", "b")))
    sizes = np.zeros(len(pairs), np.int64)
    sizes[there] = [len(h["a"]) for h in held]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, mask=np.isnan(found)), mask=pa.array(~there))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity, which depends on the order of its arguments.

    Spark has no such function, so this is the one scalar that leaves the JVM, in Arrow batches whose
    pairs are worked on together; callers give it only pairs that differ.
    """
    return F.pandas_udf(_ratios, "double")(a, b)


def sequence_ratios(a: Column, b: Column) -> Column:
    """The same for two arrays of texts, element by element; a null on either side gives null. Both go to
    Python as one text, which costs rows that have none least."""
    both = F.when(a.isNotNull() & b.isNotNull(), F.to_json(F.struct(a.alias("a"), b.alias("b"))))
    return F.arrow_udf(_array_ratios, "array<double>")(both)


def trigrams(value: Column) -> Column:
    """The set of three-character runs of a text with two spaces at each end."""
    runs = lambda padded: F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.array_distinct(let(F.concat(F.lit("  "), value, F.lit("  ")), runs))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigram sets."""
    both = F.struct(trigrams(a).alias("x"), trigrams(b).alias("y"))
    return let(both, lambda t: F.size(F.array_intersect(t["x"], t["y"])) / F.size(F.array_union(t["x"], t["y"])))


def fuzzy_equal(a: Column, b: Column, least: float = 0.7) -> Column:
    """Loosely equal normalized texts; an empty one equals only an empty one."""
    both = F.struct(*(normalize_text(F.coalesce(c, F.lit(""))).alias(n) for c, n in ((a, "x"), (b, "y"))))
    # Equal texts have equal trigrams.
    return let(both, lambda t: F.when((t["x"] == "") | (t["y"] == "") | (t["x"] == t["y"]), t["x"] == t["y"]).otherwise(trigram_similarity(t["x"], t["y"]) >= least))


def fields_agree(field: Column, a: Column, b: Column) -> Column:
    """Whether two values of a field agree, by the field's kind; two nulls do, two texts without a number don't."""
    numbers = _numbers_equal(a, b)
    texts = normalize_text(F.coalesce(a, F.lit(""))) == normalize_text(F.coalesce(b, F.lit("")))
    numeric = F.coalesce(field.isin(*NUMERIC_FIELDS), F.lit(False))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).when(numeric, numbers).when(a == b, True).when(field.isin(*FUZZY_FIELDS), fuzzy_equal(a, b)).otherwise(texts)


def convert_currency(amount: Column, source: Column, target: Column) -> Column:
    """amount, which may be text, from one currency to another; unknown ones count as dollars."""
    return amount.try_cast("double") * _lookup(RATES, source, 1.0) / _lookup(RATES, target, 1.0)


def format_money(amount: Column, source: Column, target: Column) -> Column:
    """The converted amount with symbol and thousands separators; "—" if there is none."""
    value = convert_currency(amount, source, target)
    digits = F.when(target == "JPY", F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    return F.coalesce(F.concat(_lookup(SYMBOLS, target, ""), digits), F.lit("—"))


def uncertainty(confidences: Column, strategy: str = "entropy") -> Column:
    """How unsure an array of confidences is; an empty or null one is fully unsure (1)."""
    p = F.transform(confidences, lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c)))
    n = F.size(p)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
    made = {
        "entropy": mean(F.transform(p, lambda c: -c * F.log(c) - (1 - c) * F.log(1 - c))),
        "margin": 1 - mean(p),
        "min_conf": 1 - F.array_min(p),
    }[strategy]
    return F.when(F.coalesce(F.size(confidences), F.lit(0)) <= 0, 1.0).otherwise(made)


def retry_delay(retries: Column) -> Column:
    """Seconds before the next attempt: two to the power of its number, 60 at most."""
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), retries + 1))


def normalize_bbox(box: Column, width: Column, height: Column, size: int = 1000) -> Column:
    """A box in pixels on a page, as whole numbers from 0 to size; zeros on a page without extent."""
    scaled = lambda k, extent: F.greatest(F.lit(0), F.least(F.lit(size), (F.get(box, F.lit(k)) / extent * size).cast("int")))
    made = F.array(*(scaled(k, width if k % 2 == 0 else height) for k in range(4)))
    return F.when((width <= 0) | (height <= 0), F.array(*[F.lit(0)] * 4)).otherwise(made)


def needs_normalizing(boxes: Column, width: Column, height: Column, size: int = 1000) -> Column:
    """Whether a page's boxes are pixels: the page is larger than size or a coordinate lies outside."""
    return (width > size) | (height > size) | F.exists(F.flatten(boxes), lambda c: (c < 0) | (c > size))


def ordered_bbox(box: Column) -> Column:
    """The box with swapped corners put right."""
    x0, y0, x1, y1 = (F.get(box, F.lit(k)) for k in range(4))
    return F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def label_id(label: Column) -> Column:
    return _lookup({x: k for k, x in enumerate(LABELS)}, label, 0)


def id_label(number: Column) -> Column:
    return _lookup(dict(enumerate(LABELS)), number, "O")


def word_size(box: Column) -> Column:
    """(width, height), not below 0."""
    x0, y0, x1, y1 = (F.get(box, F.lit(k)) for k in range(4))
    return F.struct(F.greatest(x1 - x0, F.lit(0)).alias("width"), F.greatest(y1 - y0, F.lit(0)).alias("height"))


def utc_day_start(moment: Column) -> Column:
    return F.date_trunc("day", moment)


def as_exchange_text(value: Column) -> Column:
    """A decimal or date as text, as reports hold them."""
    return value.cast("string")


def mean_confidence(scores: Column) -> Column:
    """Mean of the values of a map that are not null; 0 if there are none."""
    values = F.filter(F.map_values(scores), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, total / F.size(values)).otherwise(0.0)


def mean_confidence_of_keys(scores: Column) -> Column:
    """The same with nulls as 0, divided by the number of keys."""
    values = F.map_values(scores)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, total / F.size(values)).otherwise(0.0)
