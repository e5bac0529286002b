"""Document fingerprints by winnowing.

Hashes of all K-grams of code points; of every window of W consecutive hashes the least is chosen,
the rightmost of equal ones. Any passage of K + W - 1 code points that two texts share gives them a
common fingerprint, and positions say where.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .flat import mixed

K, W = 24, 77
#: Code points that are worked on at once; a longer text is worked on alone.
SLICE = 1_500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)
_LOW = np.uint64(2**32 - 1)


def _rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of the k codes from each place on.

    Spans of 1, 2, 4, ... codes are made by joining neighbours, and k is put together from them.
    """
    power = lambda n: np.uint64(pow(int(_BASE), n, 2**64))
    whole, have, span, size = None, 0, codes, 1
    while True:
        if k & size:
            whole = span if whole is None else whole[: len(span) - have] * power(size) + span[have : have + len(whole)]
            have += size
        if have == k:
            return whole
        span = span[:-size] * power(size) + span[size:]
        size *= 2


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each place on, from overlapping spans of doubled length."""
    have = 1
    while have < n:
        step = min(have, n - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def selected(texts: list[str], k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, position) of the chosen grams, in order of text and position.

    A text shorter than k is one gram, padded; one with fewer than w grams is one window; an empty
    text has none.
    """
    pad = k + w
    flat = np.frombuffer("".join(t + "\0" * pad for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.concatenate([[0], np.cumsum(length + pad)])[:-1]
    grams = np.where(length >= k, length - k + 1, np.minimum(length, 1))
    rolling = _rolled(mixed(flat.astype(np.uint64) + np.uint64(1)), k)
    hashes = mixed(rolling) >> np.uint64(32)
    place = np.arange(len(hashes), dtype=np.uint64)
    valid = np.zeros(len(flat) + 1, np.int64)
    np.add.at(valid, start, (grams > 0).astype(np.int64))
    np.add.at(valid, start + grams, -(grams > 0).astype(np.int64))
    ranked = np.where(np.cumsum(valid)[: len(hashes)] > 0, (hashes << np.uint64(32)) | (_LOW - place), _NONE)
    least = _least(ranked, w)
    windows = np.where(grams > 0, np.maximum(grams - w + 1, 1), 0)
    first = np.repeat(start - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    chosen = least[first]
    at = np.unique((_LOW - (chosen & _LOW)).astype(np.int64))
    text = np.searchsorted(start, at, side="right") - 1
    return text, hashes[at].astype(np.uint32), at - start[text]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Jaccard of the hash sets of n pairs, given as (pair, hash); two empty sets are alike (1)."""
    x, y = (np.unique((pair.astype(np.uint64) << np.uint64(32)) | h.astype(np.uint64)) for pair, h in (a, b))
    count = lambda keys: np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=n)
    both, either = count(np.intersect1d(x, y, assume_unique=True)), count(x) + count(y)
    either = either - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def _grouped(text: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(values, np.searchsorted(text, np.arange(1, n)))


def _runs(sizes: list[int], limit: int):
    begin = held = 0
    for k, size in enumerate(sizes):
        if k > begin and held + size > limit:
            yield begin, k
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def fingerprints(docs: DataFrame, key: str = "doc_id", k: int = K, w: int = W) -> DataFrame:
    """key, hashes array<long>, positions array<int> of each whole text, by position.

    Null and empty texts have empty arrays. Rows do not depend on each other; other columns of docs
    are ignored.
    """
    source = docs.select(F.col(key).alias("key"), F.col("text").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def choose(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for begin, end in _runs([len(t) for t in texts], SLICE):
                text, hashes, at = selected(texts[begin:end], k, w)
                n = end - begin
                yield pa.RecordBatch.from_arrays([batch.column("key")[begin:end], pa.array(_grouped(text, hashes.astype(np.int64), n), pa.list_(pa.int64())), pa.array(_grouped(text, at.astype(np.int32), n), pa.list_(pa.int32()))], names=["key", "hashes", "positions"])

    return source.mapInArrow(choose, f"key {kind}, hashes array<bigint>, positions array<int>").withColumnRenamed("key", key)


def _below(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the value, found in two steps; null is below all."""
    if not bounds:
        return F.lit(0)
    step = math.ceil(math.sqrt(len(bounds)))
    parts = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda edges: F.size(F.filter(edges, lambda edge: edge < value))
    part = below(F.array(*(F.lit(p[-1]) for p in parts)))
    inner = F.try_element_at(F.array(*(F.array(*map(F.lit, p)) for p in parts)), part + 1)
    found = part * step + F.when(inner.isNull(), 0).otherwise(below(inner))
    return F.when(value.isNull(), 0).otherwise(F.least(found, F.lit(len(bounds))))  # the last part may be short


def _dealt(rows: DataFrame, n: int) -> Column:
    """The bucket of rows (doc_id, _hash), numbered in descending order of ids, nulls last, and equal
    ids by hash. Ids are cut at their quantiles; an id that is several of them, and null if it is as
    frequent, has as many buckets by hash, so that none has many more rows than others."""
    cuts, total, known = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n) if n > 1 else F.lit(None), F.count("*"), F.count("doc_id")).first()
    often = Counter(cuts or [])
    bounds = sorted(often)
    # parts[k]: the buckets of what lies above k bounds; its largest id is bounds[k].
    parts = [often[c] for c in bounds] + [1]
    begins, at = [0] * len(parts), 0
    for k in reversed(range(len(parts))):
        begins[k], at = at, at + parts[k]
    nulls = max(1, math.ceil(n * (total - known) / max(1, total)))
    of = lambda values, place: F.element_at(F.array(*map(F.lit, values)), place + 1)
    own = _below(F.col("doc_id"), bounds)
    share = F.col("_hash") / F.lit(2.0**64) + 0.5
    piece = lambda m: F.least(F.floor(share * m), m - 1)
    hot = of([*bounds, None], own) == F.col("doc_id")
    with_id = of(begins, own) + F.when(F.coalesce(hot, F.lit(False)), piece(of(parts, own))).otherwise(of(parts, own) - 1)
    # Nulls come behind the smallest ids, whose last bucket their first one is.
    return F.when(F.col("doc_id").isNull(), at - 1 + piece(F.lit(nulls))).otherwise(with_id).cast("int")


def followed(docs: DataFrame, partitions: int | None = None) -> tuple[DataFrame, int]:
    """Deal doc_id and text into buckets of rows that follow each other in descending order of ids,
    nulls last and equal ids by a hash of the text, so that each row's successor is at hand: (bucket,
    halo, doc_id, text, _hash). The first row of the next bucket is added as a bucket's halo; after
    the last bucket comes the first. Only rows that are alike in id and text are always together."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    rows = rows.withColumn("_own", _dealt(rows, n))
    # Descending ids are ascending complements. One row for each bucket comes to the driver.
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("id"), F.col("_hash").alias("hash"))
    tops = {r[0]: r[1] for r in rows.groupBy("_own").agg(F.min(place)).collect()}
    order = sorted(tops)
    heads = [(None if tops[then].none else ~tops[then].id, tops[then].hash, own) for own, then in zip(order, order[1:] + order[:1], strict=True)]
    halo = F.broadcast(spark.createDataFrame(heads, "_head long, _head_hash long, _for int"))
    same = rows["doc_id"].eqNullSafe(halo["_head"]) & (rows["_hash"] == halo["_head_hash"])
    found = rows.join(halo, same, "left")
    places = F.array_compact(F.array(F.struct(F.col("_own").alias("bucket"), F.lit(False).alias("halo")), F.when(F.col("_for").isNotNull(), F.struct(F.col("_for").alias("bucket"), F.lit(True).alias("halo")))))
    return found.select(F.explode(places).alias("_at"), "doc_id", "text", "_hash").select("_at.bucket", "_at.halo", "doc_id", "text", "_hash"), n


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"


def compare_with_next(docs: DataFrame, partitions: int | None = None, k: int = K, w: int = W) -> DataFrame:
    """Fingerprint each text, its edited text and the next document's, and compare them.

    The next document is the one after it by descending doc_id (nulls last, equal ids by a hash of
    their texts); after the last comes the first, so a lone document follows itself. The edited text has its last
    third replaced by the start of the next document. Texts are shuffled once, to buckets of
    neighbouring ids. Null texts are empty, and an empty table gives an empty result.
    """
    dealt, n = followed(docs, partitions)
    ordered = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "halo", F.col("doc_id").desc_nulls_last(), "_hash", "text")

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "halo", "doc_id", "text")), strict=True)

    def pairs(batches):
        last = None
        for bucket, halo, doc, text in rows(batches):
            text = text or ""
            if last is not None and last[0] == bucket:
                yield last[1], last[2], text
            last = None if halo else (bucket, doc, text)

    def compare(batches):
        held, size = [], 0
        for pair in pairs(batches):
            if held and size + len(pair[1]) > SLICE // 3:
                yield compared(held, k, w)
                held, size = [], 0
            held.append(pair)
            size += len(pair[1])
        if held:
            yield compared(held, k, w)

    return ordered.mapInArrow(compare, OUT)


def compared(triples: list[tuple[int, str, str]], k: int = K, w: int = W) -> pa.RecordBatch:
    """triples: (doc_id, text, next text)."""
    n = len(triples)
    texts = [t for _, t, _ in triples]
    third = [len(t) // 3 for t in texts]
    edited = [t[: len(t) - c] + after[:c] for (_, t, after), c in zip(triples, third, strict=True)]
    # A row's next text is mostly the following row's own; only the others are added.
    index, extra = [], []
    for j, (_, _, after) in enumerate(triples):
        if j + 1 < n and texts[j + 1] == after:
            index.append(j + 1)
        else:
            index.append(2 * n + len(extra))
            extra.append(after)
    text, hashes, at = selected(texts + edited + extra, k, w)
    bounds = np.searchsorted(text, np.arange(2 * n + len(extra) + 1))
    own = slice(0, bounds[n])
    mine = (text[own], hashes[own])
    theirs = slice(bounds[n], bounds[2 * n])
    index = np.asarray(index, np.int64)
    lengths = bounds[index + 1] - bounds[index]
    spread = np.repeat(bounds[index] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    after = (np.repeat(np.arange(n), lengths), hashes[spread])
    digits = hashes.astype(">u4").tobytes().hex()
    prints = [digits[8 * bounds[j] : 8 * bounds[j + 1]] for j in range(2 * n)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _, _ in triples], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array(prints[:n], pa.string()), pa.array(prints[n:], pa.string()),
            pa.array(likeness(mine, (text[theirs] - n, hashes[theirs]), n)), pa.array(likeness(mine, after, n)),
            pa.array(_grouped(text[own], at[own].astype(np.int32), n), pa.list_(pa.int32())),
        ],
        names=[c.split()[0] for c in OUT.split(", ")],
    )


def op7_winnow(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(common.table(spark, sf_dir, "documents"))
