"""Word labels, spans, fields and boxes of recognized pages, in long form (doc_id, pos, word, ...)."""

from __future__ import annotations

from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import let, loose_token


RECTS = "array<struct<field:string,rx0:double,ry0:double,rx1:double,ry1:double>>"


def _in_doc() -> Window:
    return Window.partitionBy("doc_id").orderBy("pos")


def _marked(words: DataFrame, **labels: str) -> DataFrame:
    """words with name (null outside spans), starts and span, a number per span of a document, by each
    label: its keyword ends these columns' names. All come from one shuffle, one sort and two windows.

    A span starts at B-, or at I- after O or after another name.
    """
    names = {f"name{t}": F.when(F.col(label) != "O", F.substring(label, 3, 1_000_000)) for t, label in labels.items()}
    named = words.withColumns(names)
    named = named.withColumns({f"_before{t}": F.lag(f"name{t}").over(_in_doc()) for t in labels})

    def begins(tag: str, label: str) -> Column:
        name, before = F.col(f"name{tag}"), F.col(f"_before{tag}")
        return F.coalesce(name.isNotNull() & (F.col(label).startswith("B-") | before.isNull() | (before != name)), F.lit(False))

    started = named.withColumns({f"starts{t}": begins(t, label) for t, label in labels.items()}).drop(*(f"_before{t}" for t in labels))
    return started.withColumns({f"span{t}": F.sum(F.col(f"starts{t}").cast("int")).over(_in_doc()) for t in labels})


def marked_by_both(words: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """words with both labels, with name_g, starts_g, span_g of the one and name_p, ... of the other.
    Padded words, where a label is null, are left out."""
    both = words.filter(F.col(gold).isNotNull() & F.col(predicted).isNotNull())
    return _marked(both, _g=gold, _p=predicted)


def bio_spans(words: DataFrame, label: str = "label") -> DataFrame:
    """doc_id, field, start, end (inclusive), text of each span of labelled words."""
    marked = _marked(words, _l=label).filter("name_l IS NOT NULL")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ")
    spans = marked.groupBy("doc_id", "span_l").agg(F.first("name_l").alias("field"), F.min("pos").alias("start"), F.max("pos").alias("end"), texts.alias("text"))
    return spans.drop("span_l")


def fields_first_span(words: DataFrame, label: str = "label") -> DataFrame:
    """doc_id, field (lower case), value: the first span of each field."""
    return bio_spans(words, label).groupBy("doc_id", F.lower("field").alias("field")).agg(F.min_by("text", "start").alias("value"))


def gold_fields(words: DataFrame, label: str = "label") -> DataFrame:
    """doc_id, field, value: the first span of each field, and every I- word of its later spans."""
    marked = _marked(words, _l=label).filter("name_l IS NOT NULL")
    first = F.min("span_l").over(Window.partitionBy("doc_id", "name_l"))
    kept = marked.withColumn("_first", first).filter(~F.col("starts_l") | (F.col("span_l") == F.col("_first")))
    kept = kept.filter((F.col("span_l") == F.col("_first")) | F.col(label).startswith("I-"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ")
    return kept.groupBy("doc_id", F.lower("name_l").alias("field")).agg(texts.alias("value"))


def _spans(labels: list[str | None]) -> list[tuple[str, int, int]]:
    """(name, first word, end) of the spans of a page's labels, as _marked has them."""
    found, name, begin = [], None, 0
    for k, label in enumerate(labels):
        here = None if label is None or label == "O" else label[2:]
        if here is not None and here == name and not label.startswith("B-"):
            continue
        if name is not None:
            found.append((name, begin, k))
        name, begin = here, k
    return found if name is None else [*found, (name, begin, len(labels))]


def _first_spans(words: list[str], labels: list[str | None]) -> dict[str, str]:
    """fields_first_span of a page."""
    out: dict[str, str] = {}
    for name, a, b in _spans(labels):
        if name.lower() not in out:
            out[name.lower()] = " ".join(words[a:b])
    return out


def _gold(words: list[str], labels: list[str | None]) -> dict[str, str]:
    """gold_fields of a page."""
    held: dict[str, list[str]] = {}
    known = set()
    for name, a, b in _spans(labels):
        if name not in known:
            known.add(name)
            held.setdefault(name.lower(), []).extend(words[a:b])
        else:
            more = [words[k] for k in range(a + 1, b) if labels[k].startswith("I-")]
            if more:
                held.setdefault(name.lower(), []).extend(more)
    return {field: " ".join(texts) for field, texts in held.items()}


#: Words of pages that are worked on at once in a task.
_SLICE = 200_000


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int = _SLICE):
    """Parts of batch of about `most` words each, one page at least; sizes has the pages' words."""
    ends, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _sizes(lists: pa.Array) -> np.ndarray:
    """How many elements each has, 0 for a null."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def fields_of_pages(pages: DataFrame) -> DataFrame:
    """doc_id, field, gold, predicted over the fields of either label, a page at a time and without a
    shuffle: gold as gold_fields, predicted as fields_first_span has them. pages: doc_id and the
    arrays words, gold, predicted."""

    names = ("words", "gold", "predicted")

    def run(batches):
        for batch in batches:
            for part in _slices(batch, _sizes(batch.column("words"))):
                ends = np.cumsum(_sizes(part.column("words"))).tolist()
                flat = [part.column(n).flatten().to_numpy(zero_copy_only=False).tolist() for n in names]
                rows, owners, begin = [], [], 0
                for k, end in enumerate(ends):
                    words, gold, predicted = (x[begin:end] for x in flat)
                    a, b, begin = _gold(words, gold), _first_spans(words, predicted), end
                    rows += [(field, a.get(field), b.get(field)) for field in a | b]
                    owners += [k] * (len(rows) - len(owners))
                made = [pa.array(list(x), pa.string()) for x in zip(*rows, strict=True)] or [pa.array([], pa.string())] * 3
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owners, pa.int64())), *made], names=["doc_id", "field", "gold", "predicted"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", *names).mapInArrow(run, f"doc_id {kind}, field string, gold string, predicted string")


def cord_bio(words: DataFrame, field: str = "field") -> DataFrame:
    """words with label: B- at a field's start, I- while the word before has the same field, else O."""
    return words.withColumn("label", bio_label(F.col(field), F.lag(field).over(_in_doc())))


def bio_label(field: Column, before: Column) -> Column:
    """A word's label by its field and that of the word before."""
    same = F.coalesce(before == field, F.lit(False))
    tag = F.concat(F.when(same, "I-").otherwise("B-"), F.upper(field))
    return F.coalesce(tag, F.lit("O"))


def split_word_boxes(lines: DataFrame) -> DataFrame:
    """doc_id, line, k, word, x0, y0, x1, y1 of the words of lines (doc_id, line, text, x0..y1).

    A word is as wide as its share of the line's characters, one pixel at least, and ends no further
    right than the line.
    """
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    chars = F.aggregate(words, F.lit(0), lambda a, w: a + F.char_length(w))
    laid = lines.withColumns({"_words": words, "_chars": chars})
    share = lambda w: F.greatest(F.lit(1), F.floor((F.col("x1") - F.col("x0")) * F.char_length(w) / F.col("_chars"))).cast("long")
    # Where each word begins, and the last one ends, within the line's row.
    after = lambda at, w: F.concat(at, F.array(F.element_at(at, -1) + share(w)))
    edges = F.aggregate("_words", F.array(F.col("x0").cast("long")), after)
    rows = laid.withColumn("_edges", edges).select("*", F.posexplode_outer("_words").alias("k", "word")).filter("k IS NOT NULL")
    left, right = F.get("_edges", F.col("k")), F.get("_edges", F.col("k") + 1)
    return rows.select("doc_id", "line", "k", "word", left.alias("x0"), "y0", F.least("x1", right).alias("x1"), "y1")


def first_nonempty_per_page(df: DataFrame) -> DataFrame:
    """doc_id, field, value: by page, the first value that is not empty. df: doc_id, page, field, value."""
    return df.filter("value IS NOT NULL AND value <> ''").groupBy("doc_id", "field").agg(F.min_by("value", "page").alias("value"))


def subword_to_word(subwords: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, pos, word, label, confidence: a word takes its first subword's label and the mean of
    their confidences; a word without subwords is O with 0. subwords: doc_id, pos, sub, label, confidence."""
    whole = subwords.groupBy("doc_id", "pos").agg(F.min_by("label", "sub").alias("label"), F.avg("confidence").alias("confidence"))
    joined = words.select("doc_id", "pos", "word").join(whole, ["doc_id", "pos"], "left")
    return joined.select("doc_id", "pos", "word", F.coalesce("label", F.lit("O")).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def subwords_of_pages(pages: DataFrame) -> DataFrame:
    """subword_to_word of pages that are a row each, without a shuffle. pages: doc_id, words and the
    arrays pos, sub, label, confidence of their subwords, in any order."""

    def whole(part):
        words, n = part.column("words"), _sizes(part.column("words"))
        base, total = np.cumsum(n) - n, int(n.sum())
        page = np.repeat(np.arange(len(n)), _sizes(part.column("pos")))
        numbers = lambda c: part.column(c).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        pos, sub, confidence = numbers("pos"), numbers("sub"), numbers("confidence")
        known = (pos >= 0) & (pos < n[page])
        slot = np.where(known, base[page] + np.where(known, pos, 0), 0).astype(np.int64)
        rated, ranked = np.flatnonzero(known & ~np.isnan(confidence)), np.flatnonzero(known & ~np.isnan(sub))
        count = np.bincount(slot[rated], minlength=total)
        mean = np.bincount(slot[rated], confidence[rated], total) / np.maximum(count, 1)
        ranked = ranked[np.lexsort((sub[ranked], slot[ranked]))]
        at, first = np.unique(slot[ranked], return_index=True)
        taken = np.full(total, -1)
        taken[at] = ranked[first]
        label = part.column("label").flatten().take(pa.array(taken, pa.int64(), mask=taken < 0)).fill_null("O")
        owner = np.repeat(np.arange(len(n)), n)
        return [part.column("doc_id").take(pa.array(owner)), pa.array(np.arange(total) - base[owner]), words.flatten(), label, pa.array(mean)]

    def run(batches):
        for batch in batches:
            for part in _slices(batch, _sizes(batch.column("words"))):
                yield pa.RecordBatch.from_arrays(whole(part), names=["doc_id", "pos", "word", "label", "confidence"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    own = pages.select("doc_id", "words", "pos", "sub", "label", "confidence")
    return own.mapInArrow(run, f"doc_id {kind}, pos bigint, word string, label string, confidence double")


def words_in_rectangles(words: DataFrame, rects: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """doc_id, pos, word, label: words whose centre lies in a rectangle grown by a quarter of the
    tolerance on each side. The first word of a rectangle is B-; later rectangles go over earlier
    ones. words: x0..y1; rects: rect_idx, field, rx0..ry1."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    grow = tolerance * 0.25
    dx, dy = grow * (F.col("rx1") - F.col("rx0")), grow * (F.col("ry1") - F.col("ry0"))
    joined = words.join(rects, "doc_id").filter(cx.between(F.col("rx0") - dx, F.col("rx1") + dx) & cy.between(F.col("ry0") - dy, F.col("ry1") + dy))
    place = F.row_number().over(Window.partitionBy("doc_id", "rect_idx").orderBy("pos"))
    tagged = joined.withColumn("_label", F.concat(F.when(place == 1, "B-").otherwise("I-"), F.upper("field")))
    last = tagged.groupBy("doc_id", "pos").agg(F.max_by("_label", "rect_idx").alias("_label"))
    return words.select("doc_id", "pos", "word").join(last, ["doc_id", "pos"], "left").select("doc_id", "pos", "word", F.coalesce("_label", F.lit("O")).alias("label"))


def page_words_in_rectangles(words: Column, rects: Column, tolerance: float = 0.5) -> Column:
    """An array of (word, label) of a page's words, labelled as words_in_rectangles does, within the
    page's row. words: array of (word, x0..y1); rects: array of (field, rx0..ry1), later ones going
    over earlier ones; null is as none."""
    grow = tolerance * 0.25

    def inside(w: Column, r: Column) -> Column:
        cx, cy = (w["x0"] + w["x1"]) / 2, (w["y0"] + w["y1"]) / 2
        dx, dy = grow * (r["rx1"] - r["rx0"]), grow * (r["ry1"] - r["ry0"])
        return F.coalesce(cx.between(r["rx0"] - dx, r["rx1"] + dx) & cy.between(r["ry0"] - dy, r["ry1"] + dy), F.lit(False))

    # Each word gets the number of the last rectangle around it; a rectangle begins at its first word,
    # which may have got a later rectangle's number.
    places = lambda ws, r: F.transform(ws, lambda w, i: F.when(inside(w, r), i))
    known = lambda r: F.struct(*(r[n].alias(n) for n in ("field", "rx0", "ry0", "rx1", "ry1")), F.array_min(places(words, r)).alias("first"))
    begun = F.filter(F.transform(F.coalesce(rects, F.array().cast(RECTS)), known), lambda r: r["first"].isNotNull())

    def laid(rs: Column) -> Column:
        label = lambda r, i: F.concat(F.when(r["first"] == i, "B-").otherwise("I-"), F.upper(r["field"]))
        last = lambda w: F.try_element_at(F.filter(rs, lambda r: inside(w, r)), F.lit(-1))
        return F.transform(words, lambda w, i: F.struct(w["word"].alias("word"), F.coalesce(let(last(w), lambda r: label(r, i)), F.lit("O")).alias("label")))

    return let(begun, laid)


#: Stands between tokens, and what is written for it inside of one.
_BETWEEN, _MARK = "\x1f", "\x1e"


def _laid(tokens: list[str]) -> list[str]:
    """Tokens without the character that stands between them, different ones staying different."""
    return [t.replace(_MARK, _MARK + "0").replace(_BETWEEN, _MARK + "1") for t in tokens]


def find_runs(tokens: list[str], values: list[tuple[int, str, list[str]]]) -> list[tuple[int, int, int, str]]:
    """(rank, start, n, field), sorted, of all runs of tokens that equal those of a value (rank, field,
    tokens). One automaton of all values goes over the page once, however many they are."""
    known: dict[str, list[tuple[int, str]]] = {}
    sizes = {}
    for rank, field, wanted in values:
        text = _BETWEEN.join(["", *_laid(wanted), ""])
        known.setdefault(text, []).append((rank, field))
        sizes[text] = len(wanted)
    automaton = ahocorasick.Automaton()
    for text in known:
        automaton.add_word(text, text)
    if not known or not tokens:
        return []
    automaton.make_automaton()
    tokens = _laid(tokens)
    ends = list(accumulate((len(t) + 1 for t in tokens), initial=0))
    place = {end: k for k, end in enumerate(ends)}
    found = []
    for last, text in automaton.iter(_BETWEEN.join(["", *tokens, ""])):
        start, n = place[last + 1 - len(text)], sizes[text]
        found += [(rank, start, n, field) for rank, field in known[text]]
    return sorted(found)


def _held(values: DataFrame) -> DataFrame:
    """doc_id and _values: (rank, field, tokens) of a page's values."""
    tokens = F.transform(F.filter(F.split("value", r"(?U)\s+"), lambda w: w != ""), loose_token)
    wanted = values.select("doc_id", F.col("rank").cast("long").alias("rank"), "field", tokens.alias("tokens"))
    wanted = wanted.filter((F.size("tokens") > 0) & F.col("rank").isNotNull())
    return wanted.groupBy("doc_id").agg(F.collect_list(F.struct("rank", "field", "tokens")).alias("_values"))


def _pages_and_values(words: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, _words (structs by pos), _tokens (their loose tokens) and _values: (rank, field, tokens).

    values: doc_id, field, value, rank. A page's words and its values are gathered once each, so a
    word is shuffled once however many values its page has.
    """
    row = F.struct("pos", *(c for c in words.columns if c not in ("doc_id", "pos", "label")))
    pages = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("_words"))
    joined = pages.join(_held(values), "doc_id", "left")
    return joined.withColumn("_tokens", F.transform("_words", lambda w: F.coalesce(loose_token(w["word"]), F.lit(""))))


def _plain(values) -> list[tuple[int, str, list[str]]]:
    return [(v["rank"], v["field"], list(v["tokens"])) for v in values] if values is not None else []


def value_ngram_match(words: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, field, start, n: runs of words that equal a field's value, token by loose token.

    values: doc_id, field, value. Each page's values make an automaton, which leaves the JVM with the
    page's tokens; pages without values stay.
    """
    pages = _pages_and_values(words, values.select("doc_id", "field", "value", F.lit(0).alias("rank")))

    @F.udf("array<struct<field:string,start:bigint,n:int>>", useArrow=True)
    def runs(tokens, wanted):
        return [{"field": f, "start": s, "n": n} for _, s, n, f in find_runs(list(tokens), _plain(wanted))]

    found = pages.filter("_values IS NOT NULL").select("doc_id", runs("_tokens", "_values").alias("_runs"))
    # An outer generator: for an inner one Spark would look for the runs a second time, to filter by.
    return found.select("doc_id", F.inline_outer("_runs")).filter("n IS NOT NULL").select("doc_id", "field", "start", "n")


def weak_label(words: DataFrame, values: DataFrame, order: list[str] | None = None) -> DataFrame:
    """words with label from field values, found as runs of equal tokens.

    Fields go in `order`, or by the rank that each row of values (doc_id, field, value) has; a value
    without either is ignored. A field's runs are taken greedily from the left without overlap; a run
    may start only on a word that is O by then, but may go over labels further on. Only matching and
    the greedy pass leave the JVM, with a page's tokens.
    """
    if order is not None:
        place = F.array_position(F.array(*map(F.lit, order)), F.col("field"))
        values = values.withColumn("rank", F.when(place > 0, place))
    labelled = _pages_and_values(words, values).withColumn("_labels", _greedy()("_tokens", "_values"))
    rows = labelled.select("doc_id", F.explode_outer(F.arrays_zip(F.col("_words").alias("w"), F.col("_labels").alias("label"))).alias("r"))
    columns = [c for c in words.columns if c != "label"]
    return rows.select(*("doc_id" if c == "doc_id" else F.col(f"r.w.{c}").alias(c) for c in columns), "r.label")


def weak_label_pages(pages: DataFrame, values: DataFrame, words: Column) -> DataFrame:
    """doc_id, pos, the columns of words, label: weak_label of pages that are a row each. words, an array
    of structs with a word, is made of the columns of pages after these met the values by doc_id; a hash
    table of the values spares a sort of pages."""
    joined = pages.join(_held(values).hint("shuffle_hash"), "doc_id", "left")
    # An array of one is exploded, or Spark would make the words anew for each use of them.
    laid = joined.select("doc_id", "_values", F.explode_outer(F.array(words)).alias("_words"))
    tokens = F.transform("_words", lambda w: F.coalesce(loose_token(w["word"]), F.lit("")))
    labelled = laid.select("doc_id", "_words", _greedy()(tokens, F.col("_values")).alias("_labels"))
    rows = labelled.select("doc_id", F.posexplode_outer(F.arrays_zip(F.col("_words").alias("w"), F.col("_labels").alias("label"))).alias("pos", "r"))
    return rows.filter("pos IS NOT NULL").select("doc_id", F.col("pos").cast("long").alias("pos"), "r.w.*", "r.label")


def _greedy():
    """The greedy pass of weak_label over a page's tokens and values."""

    @F.udf("array<string>", useArrow=True)
    def greedy(tokens, wanted):
        if tokens is None:
            return None
        labels = ["O"] * len(tokens)
        for _, begin, n, field in find_runs(list(tokens), _plain(wanted)):
            name = field.upper()
            if labels[begin] == "O":
                labels[begin : begin + n] = ["B-" + name] + ["I-" + name] * (n - 1)
        return labels

    return greedy


def scale_page_words(pages: DataFrame, dpi: Column) -> DataFrame:
    """pages (doc_id, width, height, words: text, x0..y1 in points) with words in pixels, blanks
    dropped, and labels all O."""
    px = lambda v, most: F.greatest(F.lit(0), F.least(most, (v * dpi / 72).cast("int")))
    w, h = F.col("width"), F.col("height")
    scaled = F.transform("words", lambda x: F.struct(F.trim(x["text"]).alias("text"), px(x["x0"], w).alias("x0"), px(x["y0"], h).alias("y0"), px(x["x1"], w).alias("x1"), px(x["y1"], h).alias("y1")))
    kept = F.filter(scaled, lambda x: x["text"] != "")
    return pages.select("doc_id", kept.alias("words"), F.array_repeat(F.lit("O"), F.size(kept)).alias("labels"))


def validate_example(examples: DataFrame) -> DataFrame:
    """examples with errors, in order: missing keys (and nothing else then), unequal lengths, the
    first bad box, the first unknown label."""
    from ..schemas import LABELS

    parts = ("words", "bboxes", "labels")
    missing = F.array_compact(F.array(*(F.when(F.col(p).isNull(), p) for p in parts)))
    unequal = (F.size("words") != F.size("bboxes")) | (F.size("words") != F.size("labels"))
    bad_box = lambda b: F.coalesce(F.size(b), F.lit(-1)) != 4
    boxes = F.filter(F.transform("bboxes", lambda b, i: F.when(bad_box(b), i)), lambda i: i.isNotNull())
    unknown = F.filter("labels", lambda x: x.isNull() | ~x.isin(*LABELS))
    found = F.array_compact(
        F.array(
            F.when(unequal, "length mismatch"),
            F.when(F.size(boxes) > 0, F.concat(F.lit("invalid bbox at "), F.get(boxes, F.lit(0)).cast("string"))),
            F.when(F.size(unknown) > 0, F.concat(F.lit("unknown label: "), F.coalesce(F.get(unknown, F.lit(0)), F.lit("null")))),
        )
    )
    return examples.withColumn("errors", F.when(F.size(missing) > 0, F.array(F.concat(F.lit("missing keys: "), F.array_join(missing, ", ")))).otherwise(found))
