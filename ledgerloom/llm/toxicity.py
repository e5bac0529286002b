"""Toxicity: bags of subword embeddings, averaged, under a linear softmax.

A window of words is the mean of the vectors of its words and their character n-grams, hashed to
buckets; a softmax over it says how likely the window is toxic. Vectors and softmax are trained
jointly in numpy on a bounded sample of labelled documents. A document is as toxic as its most toxic
window; since only the label of a whole document is known, training looks for that window anew in
each round. Unseen misspellings share n-grams, and so vectors, with the words they come from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .flat import Flat, slices

GRAMS = (3, 4, 5)
BUCKET_BITS = 18
DIMENSIONS = 12
#: Words in a window.
WINDOW = 3
#: Labelled documents of each class that are learnt from, and the longest of them in bytes.
SAMPLE, LONGEST = 3000, 60_000
ROUNDS, EPOCHS, BATCH, RATE = 4, 3, 256, 0.3
THRESHOLD = 0.3
#: Bytes of text that are learnt from, and scored, at once.
LEARN_SLICE, SCORE_SLICE = 400_000, 1_000_000
#: Word scores are whole multiples of this, so that sums do not depend on how texts are batched.
UNIT = 2.0**-16

_STANDINS = "0134567@aeiou*xz"
_MIX = np.random.Generator(np.random.PCG64(9)).integers(1, 2**32, 1 << 16, dtype=np.uint32)


def _codes(data: np.ndarray) -> np.ndarray:
    """A number for each code point."""
    return _MIX[data & np.uint32(0xFFFF)] ^ ((data >> np.uint32(16)) * np.uint32(0x9E3779B1))


def _buckets(data: np.ndarray):
    """(starts, bucket) of the valid n-grams of each length over code points with a space at both ends.

    An n-gram may begin and end with one space, as a word's edge, and holds none between. Whole
    words with their edges follow as one more kind.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    data = np.where(space, np.uint32(32), data)
    place = np.arange(len(data), dtype=np.int64)
    ahead = np.where(space, place, len(data))
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]
    following = np.append(ahead[1:], len(data))
    codes = _codes(data)
    value = codes.copy()
    shift = np.uint32(32 - BUCKET_BITS)
    for n in range(2, max(GRAMS) + 1):
        if len(data) < n:
            return
        value = value[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(following[: len(value)] >= place[: len(value)] + n - 1)
            mixed = value[at] * np.uint32(0x9E3779B1)
            yield at, ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) + np.uint32(n)) >> shift
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(codes * (np.uint32(2654435761) * (place - np.maximum.accumulate(np.where(space, place, 0))).astype(np.uint32) + np.uint32(1)), dtype=np.uint32)])
    first = np.flatnonzero(space[:-1] & ~space[1:])
    word = sums[following[first]] - sums[first + 1]
    mixed = (word ^ (word >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    yield first, (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> shift


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the byte that each begins at."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    ahead = np.concatenate([data, np.zeros(3, np.uint8)])
    lead, second, third, fourth = (ahead[at + k].astype(np.uint32) for k in range(4))
    second, third, fourth = second & 0x3F, third & 0x3F, fourth & 0x3F
    two = (lead & 0x1F) << 6 | second
    three = (lead & 0x0F) << 12 | second << 6 | third
    four = (lead & 0x07) << 18 | second << 12 | third << 6 | fourth
    return np.where(lead < 0x80, lead, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))), at


def _spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points, A-Z lower-cased, with a space before, after and between texts; where each begins."""
    flat = Flat(texts, lower=True)
    points, at = _points(flat.data)
    begins = np.searchsorted(at, flat.at)
    space = np.full(1, 32, np.uint32)
    data = np.concatenate([space, np.insert(points, begins[1:-1], np.uint32(32)), space]) if flat.n else space
    return data, begins[:-1] + np.arange(flat.n) + 1


def _word_scores(texts: pa.Array, values: np.ndarray):
    """(text, sum of values, n-grams, begin, end) of each word."""
    data, at = _spaced(texts)
    sums, counts = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    for start, bucket in _buckets(data):
        sums[start + 1] += values[bucket]
        counts[start + 1] += 1
    np.cumsum(sums, out=sums)
    np.cumsum(counts, out=counts)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    text = np.searchsorted(at, begin, side="right") - 1
    return text, sums[end] - sums[begin - 1], counts[end] - counts[begin - 1], begin, end, data


def _window_scores(text: np.ndarray, sums: np.ndarray, counts: np.ndarray, n: int):
    """(text, first word, last word + 1, mean value) of each window; a short text is one window."""
    words = np.bincount(text, minlength=n)
    opening = np.concatenate([[0], np.cumsum(words)])[:-1]
    windows = np.where(words > 0, np.maximum(words - WINDOW + 1, 1), 0)
    owner = np.repeat(np.arange(n), windows)
    first = np.repeat(opening - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    last = np.minimum(first + WINDOW, opening[owner] + words[owner])
    s, c = (np.concatenate([[0], np.cumsum(x)]) for x in (sums, counts))
    return owner, first, last, (s[last] - s[first]) * UNIT / np.maximum(c[last] - c[first], 1)


def _text_scores(texts: pa.Array, values: np.ndarray) -> np.ndarray:
    """The value of each text's highest window; NaN for a text without words."""
    text, sums, counts, *_ = _word_scores(texts, values)
    owner, _, _, mean = _window_scores(text, sums, counts, len(texts))
    out = np.full(len(texts), np.nan)
    if len(owner):
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[heads]] = np.maximum.reduceat(mean, heads)
    return out


@dataclass
class Model:
    """values: what an n-gram's bucket adds to a window's sum. A text's score is
    1 / (1 + exp(-(slope * its highest window + offset))), and `empty` if it has no words."""

    values: np.ndarray
    slope: float
    offset: float
    empty: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.concatenate([_text_scores(texts[a:b], self.values) for a, b in slices(texts, SCORE_SLICE)] or [np.zeros(0)])
        logit = np.clip(self.slope * out + self.offset, -30, 30)
        return np.where(np.isnan(out), self.empty, 1 / (1 + np.exp(-logit)))


def _selected(texts: pa.Array, toxic: np.ndarray, values: np.ndarray, rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Windows to learn from: the highest of every text, and two more of those not toxic."""
    windows, labels = [], []
    for a, b in slices(texts, LEARN_SLICE):
        text, sums, counts, begin, end, data = _word_scores(texts[a:b], values)
        owner, first, last, mean = _window_scores(text, sums, counts, b - a)
        cuts = np.searchsorted(owner, np.arange(b - a + 1))
        for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if x == y:
                continue
            best = x + int(np.argmax(mean[x:y]))
            for w in {best} if toxic[a + k] else {best, *rng.integers(x, y, 2).tolist()}:
                points = data[begin[first[w]] : end[last[w] - 1]]
                windows.append(points.astype("<u4").tobytes().decode("utf-32-le", "replace"))
                labels.append(int(toxic[a + k]))
    return windows, labels


def _misspelt(window: str, rng: np.random.Generator) -> str:
    """A copy in which some words have a letter doubled, dropped, swapped with the next or replaced."""
    words = []
    for w in window.split():
        if len(w) > 3 and rng.random() < 0.5:
            k, how = int(rng.integers(1, len(w) - 1)), rng.integers(4)
            middle = (w[k] * 2, "", w[k + 1] + w[k], _STANDINS[rng.integers(len(_STANDINS))])[how]
            w = w[:k] + middle + w[k + 1 + (how == 2) :]
        words.append(w)
    return " ".join(words)


def _first_values(texts: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Log odds of each bucket by the documents that hold it, to find windows before the first round."""
    held = np.zeros((2, 1 << BUCKET_BITS))
    for a, b in slices(texts, LEARN_SLICE):
        data, at = _spaced(texts[a:b])
        pairs = [(np.searchsorted(at, s + 1, side="right") - 1) << BUCKET_BITS | g for s, g in _buckets(data)]
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        for label in (0, 1):
            mine = pairs[toxic[a + (pairs >> BUCKET_BITS)] == label]
            held[label] += np.bincount(mine & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
    n = np.bincount(toxic, minlength=2)[:, None] + 1
    odds = np.log((held[1] + 0.5) / n[1]) - np.log((held[0] + 0.5) / n[0])
    return np.round(np.where(held.sum(0) > 2, odds, 0) / UNIT).astype(np.int64)


@dataclass
class _Learner:
    """Vectors and softmax, and the sums of squares that steps are scaled by."""

    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    v_seen: np.ndarray
    s_seen: np.ndarray

    @classmethod
    def new(cls, rng: np.random.Generator, buckets: int = 1 << BUCKET_BITS) -> _Learner:
        vectors = rng.uniform(-1, 1, (buckets, DIMENSIONS)).astype(np.float32) / DIMENSIONS
        softmax = rng.uniform(-1, 1, (2, DIMENSIONS)).astype(np.float32)
        return cls(vectors, softmax, np.zeros(2, np.float32), np.full(buckets, 1e-4, np.float32), np.full((2, DIMENSIONS), 1e-4, np.float32))

    def step(self, used: np.ndarray, sizes: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> None:
        """One step down the weighted log loss of a batch of bags: used has the buckets of one bag
        after another, of which there are sizes."""
        heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(self.vectors[used], heads) / sizes[:, None]
        logits = mean @ self.softmax.T + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(sizes)), goal] -= 1
        p *= weight[:, None] / len(sizes)
        down = np.repeat(p @ self.softmax / sizes[:, None], sizes, axis=0).astype(np.float32)
        seen, back = np.unique(used, return_inverse=True)
        g = np.stack([np.bincount(back, down[:, d], len(seen)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
        self.v_seen[seen] += (g * g).mean(1)
        self.vectors[seen] -= RATE * g / np.sqrt(self.v_seen[seen])[:, None]
        turn = p.T @ mean
        self.s_seen += turn * turn
        self.softmax -= RATE * 0.2 * turn / np.sqrt(self.s_seen)
        self.bias -= RATE * p.sum(0)

    def values(self) -> np.ndarray:
        """What each bucket adds to a window's log odds, in UNITs."""
        return np.round(self.vectors.astype(np.float64) @ (self.softmax[1] - self.softmax[0]).astype(np.float64) / UNIT).astype(np.int64)


def train(texts: pa.Array | list[str], toxic: list[int], share: float | None = None, seed: int = 1) -> Model:
    """Learn from whole texts and their labels; share is that of toxic documents where they come from.

    Four in five texts train vectors and softmax, the rest turn window values into probabilities. If
    a class is missing, every score is the share of the other.
    """
    share = share if share is not None else float(np.mean(toxic)) if len(toxic) else 0.0
    labels = np.asarray(toxic, np.int64)
    learn = np.arange(len(texts)) % 5 != 4
    if len({*labels[learn]}) < 2:
        return Model(np.zeros(1 << BUCKET_BITS, np.int64), 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), share)
    rng = np.random.Generator(np.random.PCG64(seed))
    all_texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    own, mine = all_texts.filter(pa.array(learn)), labels[learn]
    learner = _Learner.new(rng)
    values = _first_values(own, mine)
    for _ in range(ROUNDS):
        windows, targets = _selected(own, mine, values, rng)
        windows, targets = windows + [_misspelt(w, rng) for w in windows], targets * 2
        data, at = _spaced(pa.array(windows, pa.large_string()))
        parts = [(np.searchsorted(at, s + 1, side="right") - 1, g) for s, g in _buckets(data)]
        bag, gram = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(bag, kind="stable")
        bag, gram = bag[order], gram[order]
        cuts = np.searchsorted(bag, np.arange(len(windows) + 1))
        goal = np.asarray(targets)
        weight = np.where(goal == 1, len(goal) / 2 / max(1, goal.sum()), len(goal) / 2 / max(1, (goal == 0).sum())).astype(np.float32)
        for _ in range(EPOCHS):
            shuffled = rng.permutation(len(windows))
            for k in range(0, len(shuffled), BATCH):
                batch = shuffled[k : k + BATCH]
                batch = batch[cuts[batch + 1] > cuts[batch]]
                sizes = cuts[batch + 1] - cuts[batch]
                heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                used = gram[np.repeat(cuts[batch] - heads, sizes) + np.arange(sizes.sum())]
                learner.step(used, sizes, goal[batch], weight[batch])
        values = learner.values()
    rest = np.flatnonzero(~learn) if len({*labels[~learn]}) == 2 else np.arange(len(texts))
    return _calibrated(values, all_texts.take(pa.array(rest)), labels[rest], share)


def _calibrated(values: np.ndarray, texts: pa.Array, labels: np.ndarray, share: float) -> Model:
    """A logistic curve from window values to labels, with smoothed targets, classes weighed by share."""
    x = np.concatenate([_text_scores(texts[a:b], values) for a, b in slices(texts, LEARN_SLICE)])
    some = ~np.isnan(x)
    x, y = x[some], labels[some]
    n1, n0 = max(1, y.sum()), max(1, (y == 0).sum())
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    middle, width = (np.median(x[y == 1]) + np.median(x[y == 0])) / 2, max(1e-6, x.std())
    z = (x - middle) / width
    a, b = 1.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = weight * (p - goal), weight * p * (1 - p) + 1e-9
        g = np.array([(d * z).sum() + 0.01 * a, d.sum()])
        hess = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    slope, offset = float(a / width), float(b - a * middle / width)
    low = float(1 / (1 + np.exp(-np.clip(slope * x.min() + offset, -30, 30))))
    return Model(values, slope, offset, min(low, share))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Train on docs (doc_id, text) with labels (doc_id, toxic), of each class `sample` at most.

    Documents are drawn by a hash of their id. Longer ones than `longest` bytes are not learnt from;
    unlabelled and null rows are ignored. Only the sample comes to the driver.
    """
    known = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = common.unit_hash("toxicity", F.col("doc_id"))
    drawn = [known.filter(F.col("toxic") == k).dropDuplicates(["doc_id"]).withColumn("_at", draw).orderBy("_at", "doc_id").limit(sample) for k in (0, 1)]
    chosen = common.stored(drawn[0].unionAll(drawn[1]))
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_at").alias("_at"), F.first("toxic").alias("toxic"))
    # A partition of the sample at a time, so that the driver never has it twice in Spark's form.
    held, toxic = [], []
    for row in one.orderBy("_at", "doc_id").select("text", "toxic").toLocalIterator():
        held.append(row["text"])
        toxic.append(row["toxic"])
    return train(pa.array(held, pa.large_string()), toxic, n.get(1, 0) / max(1, sum(n.values())))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """columns of docs, or all, with score and predicted (replaced if there are such), from whole
    texts alone.

    Null, empty and wordless texts get the score of an empty text, which is low. Rows do not depend
    on each other. A text goes to Python once, and comes back only if it is among the columns.
    """
    own = [c for c in columns or docs.columns if c not in ("score", "predicted")]
    with_text = "text" in own
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*own).alias("_row"), *([] if with_text else [F.col("text").alias("_text")]))
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, score double"

    def run(batches):
        for batch in batches:
            texts = batch.column("_row").field("text") if with_text else batch.column("_text")
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(shared.value.scores(texts))], names=["_row", "score"])

    scored = rows.mapInArrow(run, schema).select("_row.*", "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def may_learn(doc_id) -> Column:
    """Rows whose labels may be used; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, that are not predicted toxic."""
    found = score(docs, fit(docs, labels.filter(may_learn(F.col("doc_id")))), threshold)
    return found.filter("predicted = 0").select(*docs.columns)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(may_learn(F.col("doc_id"))))
    found = score(docs, model, columns=["doc_id"])
    held_out = F.coalesce(~may_learn(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
