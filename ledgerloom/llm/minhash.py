"""Near-duplicates by b-bit MinHash.

Texts become sets of hashed word shingles, and sets become minima of many hash functions. Texts with
equal sets form one class. Classes that share all minima of a band are candidates; the low bits of
all minima, packed, estimate a candidate pair's similarity by bit counts, corrected for chance
collisions; pairs that can reach the threshold are confirmed on the full sets.

A bucket of many classes is not expanded into pairs. Each of its classes is first compared with one
leader, which joins most groups of copies. Classes that still are in different components are then
compared in blocks, in numpy, first by their bits and then on their sets; a block gives out no more
links than join its components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import stored
from .components import components
from .flat import Flat, grams, mixed, slices

#: With 32 bands of 4 a pair at similarity 0.8 shares no band with a probability of 5e-8.
BANDS, ROWS = 32, 4
#: Low bits kept of each minimum; of 128 pairs of them, those of different shingles agree by chance in 1 of 2^BITS.
BITS = 2
#: A pair is confirmed on its sets if its estimate is no more than this below the threshold, six standard errors.
MARGIN = 0.25
#: Classes are compared all with all in blocks of so many by their bits.
BLOCK = 512
#: On their sets, blocks have at least and at most so many, to deal a family to SPREAD blocks: a
#: member is sent to as many tasks as there are blocks. In a task, EXACT_BLOCK by EXACT_BLOCK meet at once.
EXACT_BLOCK, EXACT_MOST, SPREAD = 256, 4096, 16
#: Bytes of text of such a block, by the mean length in its family: fewer members if texts are long.
EXACT_BYTES = 32_000_000
#: A set of ids up to this many (8 or 16 bytes each) may be broadcast.
BROADCAST_IDS = 500_000
SHINGLE, THRESHOLD = 5, 80

_RANDOM = np.random.Generator(np.random.PCG64(10)).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
_TIMES, _PLUS = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]
_WORDS = BANDS * ROWS * BITS // 64


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): distinct hashes of n-word shingles, sorted in each text; text k's end at ends[k].

    A-Z are lower-cased. A text of fewer words than n has its whole sequence as one shingle; one
    without words has none.
    """
    flat = Flat(texts, lower=True)
    begin, end, text = flat.words()
    words = flat.hashes(begin, end)
    out, first = grams(words, text, n)
    parts, owners = [out], [text[first]]
    count = np.bincount(text, minlength=flat.n)
    opening = np.concatenate([[0], np.cumsum(count)])[:-1]
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        value = np.zeros(len(short), np.uint64)
        for k in range(m):
            value = mixed(value * np.uint64(3) + words[opening[short] + k])
        parts.append(value)
        owners.append(short)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    hashes, owner = hashes[order], owner[order]
    ends = np.searchsorted(owner, np.arange(flat.n + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.searchsorted(owner[fresh], np.arange(1, flat.n + 1))


def sliced_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets(), a slice of the texts at a time, so that little but the hashes is held."""
    hashes, ends, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for begin, end in slices(texts):
        own, own_ends = shingle_sets(texts[begin:end], n)
        hashes.append(own)
        ends.append(own_ends + before)
        before += len(own)
    return np.concatenate(hashes), np.concatenate(ends)


def sketched(texts: pa.Array, n: int) -> tuple[np.ndarray, ...]:
    """(sizes, set digests, band keys, packed low bits); texts without words have zeros."""
    hashes, ends = shingle_sets(texts, n)
    sizes = np.diff(ends, prepend=0)
    some = np.flatnonzero(sizes)
    at = (ends - sizes)[some]
    minima = np.zeros((len(some), BANDS * ROWS), np.uint64)
    digests, keys, bits = np.zeros((len(sizes), 2), np.uint64), np.zeros((len(sizes), BANDS), np.uint64), np.zeros((len(sizes), _WORDS), np.uint64)
    if len(some):
        for j in range(BANDS * ROWS):
            minima[:, j] = np.minimum.reduceat(hashes * _TIMES[j] + _PLUS[j], at)
        for k in (0, 1):
            digests[some, k] = np.add.reduceat(mixed(hashes ^ np.uint64(k + 1)), at)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), BANDS))
        for r in range(ROWS):
            key = mixed(key * np.uint64(3) + minima[:, r::ROWS])
        keys[some] = key
        low = mixed(minima) & np.uint64(2**BITS - 1)
        per = 64 // BITS
        for k in range(_WORDS):
            bits[some, k] = np.bitwise_or.reduce(low[:, k * per : (k + 1) * per] << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=1)
    return sizes, digests, keys, bits


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1).view(np.int64))


def sketch(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands, bits) of every row."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for begin, end in slices(texts):
                sizes, digests, keys, bits = sketched(texts[begin:end], n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[begin:end], pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(digests[:, k]).view(np.int64)) for k in (0, 1)), _lists(keys), _lists(bits)], names=["doc_id", "n_shingles", "s1", "s2", "bands", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>, bits array<bigint>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity by the packed bits: the share of equal groups, less chance agreement."""
    equal = F.lit(0)
    ones = sum(1 << k for k in range(0, 64, BITS))
    ones -= (1 << 64) * (ones >> 63)
    for k in range(_WORDS):
        differs = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        any_bit = differs
        for s in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(differs, s))
        equal = equal + (64 // BITS - F.bit_count(any_bit.bitwiseAND(F.lit(ones).cast("long"))))
    chance = 1 / 2**BITS
    return (equal / float(BANDS * ROWS) - chance) / (1 - chance)


def _may_link(similarity: Column, n: Column, m: Column, threshold: int) -> Column:
    return (similarity >= threshold / 100 - MARGIN) & (F.least(n, m) * 100 >= F.greatest(n, m) * threshold)


def _few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if there are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def confirmed(docs: DataFrame, pairs: DataFrame, n: int, threshold: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the threshold, as u, v. Ids of docs are unique.

    Texts of documents in no pair are left out before anything is shuffled.
    """
    sides = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("doc_id"))
    ids = _few(stored(sides.select("doc_id").distinct()))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = sides.join(texts, "doc_id").select("u", "v", "text").repartition(parts, "u", "v").sortWithinPartitions("u", "v")

    def check(batches):
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            whole = batch.num_rows // 2 * 2
            for begin, end in slices(batch.column("text")[:whole]):
                begin += begin % 2  # a pair's two rows stay together: the slice before took this one
                end = min(whole, end + end % 2)
                if begin >= end:
                    continue
                u, v = (batch.column(c).take(pa.array(range(begin, end, 2), pa.int64())) for c in ("u", "v"))
                hit = _linked(batch.column("text")[begin:end], n, threshold)
                yield pa.RecordBatch.from_arrays([u.filter(hit), v.filter(hit)], names=["u", "v"])
            rest = batch.slice(whole) if whole < batch.num_rows else None

    return both.mapInArrow(check, "u bigint, v bigint")


def _linked(texts: pa.Array, n: int, threshold: int) -> pa.Array:
    """For texts 0 and 1, 2 and 3, ...: whether their sets are so similar."""
    hashes, ends = shingle_sets(texts, n)
    sizes = np.diff(ends, prepend=0)
    pair = np.repeat(np.arange(len(sizes)) // 2, sizes)
    order = np.lexsort((hashes, pair))
    h, p = hashes[order], pair[order]
    twice = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
    both = np.bincount(p[1:][twice], minlength=len(sizes) // 2)
    either = sizes[::2] + sizes[1::2] - both
    return pa.array((100 * both >= threshold * either) & (either > 0))


def _cross_blocks(members: DataFrame, block: int, most: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """Deal members (group, doc_id, component, ...) so that any two of a group but of different
    components meet: rows get i, j and their own block b, and meet within (group, i, j).

    A group's largest component is compared with the others only, and the others with each other
    too, in blocks of about so many members by hash; with `most`, blocks of larger groups grow up to
    that, and with `most_bytes` they have about so many bytes of text at most. Groups of one
    component are left out.
    """
    held = F.sum(F.octet_length("text")) if most_bytes else F.lit(0)
    counts = members.groupBy("group", "component").agg(F.count("*").alias("count"), held.alias("_held"))
    sizes = counts.groupBy("group").agg(F.max_by("component", "count").alias("_main"), F.max("count").alias("_n_main"), F.sum("count").alias("_n"), F.sum("_held").alias("_held"))
    size = F.lit(block) if most is None else F.greatest(F.lit(block), F.least(F.lit(most), F.ceil(F.col("_n") / SPREAD)))
    if most_bytes:
        size = F.greatest(F.lit(1), F.least(size, F.ceil(most_bytes * F.col("_n") / F.greatest("_held", F.lit(1)))))
    blocks = lambda n: F.ceil(n / size).cast("int")
    several = sizes.filter("_n > _n_main").select("group", "_main", blocks(F.col("_n") - F.col("_n_main")).alias("_others"), blocks(F.col("_n_main")).alias("_mains"))
    is_main, h = F.col("component") == F.col("_main"), F.xxhash64("doc_id")
    own = F.when(is_main, F.col("_others") + F.pmod(h, F.col("_mains"))).otherwise(F.pmod(h, F.col("_others"))).cast("int")
    rows = members.join(several, "group").withColumn("b", own)
    last = F.col("_others") - 1 + F.when(is_main, 0).otherwise(F.col("_mains"))
    meets = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j")))
    dealt = rows.withColumn("_m", F.explode(meets)).select("_m.i", "_m.j", "b", *members.columns)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j")


def _groups(batches):
    """A table for each run of equal group, i, j."""
    held, key = [], None
    for batch in batches:
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)] if len(k) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = tuple(k[a])
            if held and mine != key:
                yield held
                held = []
            key = mine
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _forest(table: pa.RecordBatch, alike) -> list[tuple[int, int]]:
    """Links between components, by their ids, of one meeting of blocks: as many as join them, no more.

    alike(left rows, right rows) gives a boolean matrix.
    """
    b, i, j = (table.column(c).to_numpy(zero_copy_only=False) for c in ("b", "i", "j"))
    left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
    names, component = np.unique(table.column("component").to_numpy(zero_copy_only=False), return_inverse=True)
    own = component.copy()
    if not len(left) or not len(right) or component.max(initial=0) == 0:
        return []
    hits = alike(left, right) & (component[left][:, None] != component[right][None, :])
    out = []
    for x in np.flatnonzero(hits.any(axis=1)):
        to = np.flatnonzero(hits[x])
        to = to[component[right[to]] != component[left[x]]]
        for y in to[np.unique(component[right[to]], return_index=True)[1]]:
            old, new = component[right[y]], component[left[x]]
            if old != new:
                component[component == old] = new
                out.append((int(names[own[left[x]]]), int(names[own[right[y]]])))
    return out


def _linked_pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _joined_by(dealt: DataFrame, of_table) -> DataFrame:
    """The links (u, v) between components that of_table(table) finds in each meeting of blocks."""

    def run(batches):
        found = []
        for held in _groups(batches):
            found += of_table(held[0] if len(held) == 1 else pa.concat_batches(held))
            if len(found) >= 10_000:
                yield _linked_pairs(found)
                found = []
        yield _linked_pairs(found)

    return dealt.mapInArrow(run, "u bigint, v bigint")


def _likely(members: DataFrame, threshold: int) -> DataFrame:
    """Links by the packed bits between components that meet in a bucket."""
    ones = np.uint64(sum(1 << k for k in range(0, 64, BITS)))
    chance = 1 / 2**BITS

    def find(table):
        bits = pc.list_flatten(table.column("bits")).to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, _WORDS)
        n = table.column("n_shingles").to_numpy(zero_copy_only=False)

        def alike(left, right):
            equal = np.full((len(left), len(right)), BANDS * ROWS)
            for k in range(_WORDS):
                x = bits[left, k][:, None] ^ bits[right, k][None, :]
                some = x
                for shift in range(1, BITS):
                    some = some | (x >> np.uint64(shift))
                equal -= np.bitwise_count(some & ones)
            a, b = n[left][:, None], n[right][None, :]
            return ((equal / (BANDS * ROWS) - chance) / (1 - chance) >= threshold / 100 - MARGIN) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * threshold)

        return _forest(table, alike)

    return _joined_by(_cross_blocks(members, BLOCK), find)


def _exact(members: DataFrame, n: int, threshold: int) -> DataFrame:
    """Links by the full shingle sets between components of a group. members: group, doc_id, component, text."""

    def find(table):
        hashes, ends = sliced_sets(table.column("text"), n)
        sizes = np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(hashes, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = hashes[order][1:] != hashes[order][:-1]
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(fresh) - 1
        shared = np.bincount(code)[code] > 1  # the others are in no intersection
        owner, code = owner[shared], code[shared]
        cuts = np.searchsorted(owner, np.arange(len(sizes) + 1))

        def alike(left, right):
            out = np.zeros((len(left), len(right)), bool)
            for x in range(0, len(left), EXACT_BLOCK):
                for y in range(0, len(right), EXACT_BLOCK):
                    out[x : x + EXACT_BLOCK, y : y + EXACT_BLOCK] = some(left[x : x + EXACT_BLOCK], right[y : y + EXACT_BLOCK])
            return out

        def some(left, right):
            held = [np.concatenate([code[cuts[k] : cuts[k + 1]] for k in side]) for side in (left, right)]
            rows = [np.repeat(np.arange(len(side)), cuts[side + 1] - cuts[side]) for side in (left, right)]
            common = np.intersect1d(*held)
            both = np.zeros((len(left), len(right)), np.float32)
            for low in range(0, len(common), 4096):
                part = common[low : low + 4096]
                there = []
                for side, c, r in zip((left, right), held, rows, strict=True):
                    at = np.searchsorted(part, c)
                    mine = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == c)
                    matrix = np.zeros((len(side), len(part)), np.float32)
                    matrix[r[mine], at[mine]] = 1
                    there.append(matrix)
                both += there[0] @ there[1].T
            return 100 * both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both)

        return _forest(table, alike)

    return _joined_by(_cross_blocks(members, EXACT_BLOCK, EXACT_MOST, EXACT_BYTES), find)


def _one_row_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one row per doc_id but null ones, and how many rows there were of the ids
    that repeat (doc_id, rows), None if none does."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = stored(own.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1"))
    if again.isEmpty():
        return own, None
    ids = _few(again.select("doc_id"))
    least = own.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return own.join(ids, "doc_id", "left_anti").unionByName(least), again


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Documents link if their sets of `shingle`-word shingles have a Jaccard similarity of `threshold`
    per cent or more; component_id is the smallest doc_id reachable by links. Null, empty and
    wordless texts have empty sets and link with nothing. Rows that repeat a doc_id are one document,
    whose text is the smallest of theirs. Rows with a null doc_id are not linked: their component_id
    is null and they are kept. Other columns of docs are ignored.
    """
    docs, again = _one_row_each(docs)
    sketches = stored(sketch(docs, shingle))
    full = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Classes of equal sets, of which there may be huge ones; each is represented by its smallest id.
    same = ["s1", "s2", "n_shingles"]
    classes = stored(full.groupBy(*same).agg(F.min("doc_id").alias("class"), F.count("*").alias("_n")))
    reps = full.join(classes.select(F.col("class").alias("doc_id")), "doc_id", "left_semi")
    banded = reps.select(F.explode("bands").alias("key"), "doc_id")
    # A bucket's leader is the least of its ids after a XOR with the bucket's key, so leaders differ by bucket.
    buckets = banded.groupBy("key").agg(F.count("*").alias("_n"), F.min(F.col("doc_id").bitwiseXOR(F.col("key"))).alias("_least"))
    shared = buckets.filter("_n > 1").select("key", F.col("_least").bitwiseXOR(F.col("key")).alias("leader"))
    members = stored(banded.join(shared, "key"))
    # First links: each class with the leader it shares most bands with.
    led = members.filter("leader <> doc_id").groupBy("doc_id", "leader").count().groupBy("doc_id").agg(F.max_by("leader", "count").alias("leader"))
    bits = reps.select("doc_id", "n_shingles", "bits")
    of_leader = bits.select(F.col("doc_id").alias("leader"), F.col("n_shingles").alias("_m"), F.col("bits").alias("_bits"))
    first = led.join(bits, "doc_id").join(of_leader, "leader").filter(_may_link(estimate(F.col("bits"), F.col("_bits")), F.col("n_shingles"), F.col("_m"), threshold))
    star = stored(first.select(F.least("doc_id", "leader").alias("u"), F.greatest("doc_id", "leader").alias("v")).distinct())
    links = stored(confirmed(docs, star, shingle, threshold))
    # Then components that share a bucket and look alike form families, and all of a family's
    # components are compared on their sets, since one true link between them is enough.
    joined = stored(components(links).withColumnRenamed("id", "doc_id"))
    placed = members.select(F.col("key").alias("group"), "doc_id").join(bits, "doc_id").join(joined, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    families = stored(components(_likely(placed, threshold)).select(F.col("id").alias("component"), F.col("component").alias("group")))
    single = families.join(joined.select("component").distinct(), "component", "left_anti").select("component", F.col("component").alias("doc_id"))
    to_compare = stored(joined.unionByName(single).join(_few(families), "component"))
    texts = docs.join(_few(to_compare.select("doc_id")), "doc_id", "left_semi")
    more = components(_exact(to_compare.join(texts, "doc_id").select("group", "doc_id", "component", "text"), shingle, threshold))
    more = stored(more.select(F.col("id").alias("component"), F.col("component").alias("_whole")))
    # A document's component is that of its class, which is looked up by the digest of its set.
    whole = joined.withColumnRenamed("doc_id", "class")
    placed = classes.join(whole, "class", "left").withColumn("component", F.coalesce("component", "class")).join(_few(more), "component", "left")
    of_class = stored(placed.select(*same, "_n", F.coalesce("_whole", "component").alias("component_id")))
    linked = common.join_spread(full.select("doc_id", *same), of_class, same, "_n", full.count())
    alone = sketches.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", *same, F.col("doc_id").alias("component_id"))
    found = linked.unionByName(alone)
    if again is not None:
        counted = found.join(again, "doc_id", "left")
        found = counted.withColumn("_", F.explode(F.sequence(F.lit(1), F.coalesce("rows", F.lit(1).cast("long")))))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, without those that another document stands for."""
    found = near_duplicates(docs, shingle, threshold)
    dropped = stored(found.filter(~F.col("kept")).select("doc_id").distinct())
    return docs.join(_few(dropped), "doc_id", "left_anti").select(*docs.columns)


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=4)


OP10_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{common.WORD}') AS ws FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS ss FROM words),
sizes AS (SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles FROM shingles),
flat AS (SELECT doc_id, hash(unnest(ss)) AS s FROM shingles),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * n >= 80 * (x.n_shingles + y.n_shingles - n)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, e.v FROM reached r JOIN edges e ON r.other = e.u),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""
