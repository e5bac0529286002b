"""Quality rules, mixing, sharding, winnowing and pieces on awkward tables, against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import mixing, pieces, quality, sharding, winnowing

from pyspark.sql.functions import col as F_col

from .helpers import awkward, clashing, empty, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(t):
    t = t or ""
    words = WORD.findall(t)
    grams = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_quality_measures(spark):
    docs = awkward(spark)
    got = sorted((r["doc_id"] or -1, *(r[m] for m in quality.MEASURES[:5])) for r in quality.ledger(clashing(docs)).collect())
    assert got == sorted((r["doc_id"] or -1, *plain_measures(r["text"])) for r in docs.collect())


def test_quality_lines_and_repeats():
    t = ["a b c a b c\nx y\nx y\n \nx y ", "", "w " * 10, "\n\n", "é é é é"]
    got = quality.measured(pa.array(t, pa.large_string()))
    assert [tuple(int(got[m][k]) for m in quality.MEASURES[:5]) for k in range(len(t))] == [plain_measures(x) for x in t]


def test_quality_policies_and_ablations(spark):
    docs = awkward(spark)
    entries = quality.ledger(docs)
    kept = quality.keep_good(clashing(docs))
    assert kept.columns == clashing(docs).columns
    few = {r["rule"]: r["documents"] for r in quality.ablations(entries, "strict-1").collect()}
    bits = [r["failed_bits"] for r in entries.collect()]
    assert few == {n: sum(b & quality.policy_mask("strict-1") == quality.BITS[n] for b in bits) for n in quality.POLICIES["strict-1"]}
    assert quality.ledger(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0


def plain_targets(sizes):
    sources = sorted({s for s, _ in sizes}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for t, n in sizes if t == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total, stopped = sum(own.values()), set()
    while True:
        free = [s for s in sources if s not in stopped]
        left = total - sum(3 * own[s] for s in stopped)
        target = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if target[s] > 3 * own[s]}
        if not over:
            return {**target, **{s: 3.0 * own[s] for s in stopped}}
        stopped |= over


def test_mixing_targets(spark):
    docs = awkward(spark)
    got = mixing.with_copies(clashing(docs)).collect()
    want = plain_targets([(r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()])
    assert len(got) == docs.count()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
    assert mixing.mix(empty(spark)).count() == 0
    again = mixing.taken_sizes(docs).collect()
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in again) == sorted((r["doc_id"] or -1, r["size"] * r["copies"]) for r in got)
    assert mixing.mix(docs).count() == sum(r["copies"] for r in got)


def test_mixing_comes_near_targets(spark):
    rows = [(k, text(k, 20 + k % 50), "en", "abc"[k % 7 % 3], 0) for k in range(3000)]
    got = mixing.taken_sizes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).groupBy("source_size", "target").sum("taken").collect()
    for r in got:
        assert r["sum(taken)"] == pytest.approx(r["target"], rel=0.1)


def test_shards(spark):
    rows = [(k, text(k, 5 + k * k % 300), "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, 0) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    placed = sharding.assign_shards(clashing(docs), shards=7).select("doc_id", "text", "shard").collect()
    assert len(placed) == 900
    load = Counter()
    for r in placed:
        load[r["shard"]] += len(r["text"].encode()) + 16
    longest = max(len(r[1]) for r in rows) + 16
    assert sorted(load) == list(range(7)) and max(load.values()) - min(load.values()) <= 3 * longest
    by_bytes = sharding.assign_shards(docs, target_bytes=sum(load.values()) // 3).select("shard").distinct().count()
    assert by_bytes in (3, 4)


def test_shards_of_awkward_tables(spark):
    docs = awkward(spark)
    placed = sharding.assign_shards(docs, shards=4)
    assert placed.count() == docs.count() and {r["shard"] for r in placed.collect()} <= set(range(4))
    assert sharding.assign_shards(empty(spark), shards=4).count() == 0
    assert sharding.assign_shards(empty(spark), target_bytes=100).count() == 0
    same = spark.createDataFrame([(1, "x", "en", "a", 1)] * 30, docs.schema)
    assert sharding.assign_shards(same, shards=4).count() == 30
    from pyspark.sql import functions as F

    keyed = placed.withColumns({"_size": sharding.byte_size(placed["text"]), "_hash": F.xxhash64("text"), "slot": F.lit("x")})
    numbered = sharding.with_slots(keyed, "doc_id").collect()
    for s in {r["shard"] for r in numbered}:
        slots = sorted(r["slot"] for r in numbered if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shards_of_64_bit_keys(spark):
    """Keys that a double cannot tell apart, next to each other or over the whole range, are parted."""
    near = [2**62 + k for k in range(400)]
    wide = [k * 0x9E3779B97F4A7C15 % 2**64 - 2**63 for k in range(398)] + [-(2**63), 2**63 - 1]
    for keys in (near, wide):
        rows = [(k, "one source", "en", f"text {j:03}") for j, k in enumerate(keys)] + [(None, None, None, None)]
        docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").repartition(3)
        placed = sharding.assign_shards(docs, shards=8).select("doc_id", "shard").collect()
        assert sorted(r["doc_id"] for r in placed if r["doc_id"] is not None) == sorted(keys) and len(placed) == 401
        sizes = [sum(r["shard"] == s for r in placed) for s in range(8)]
        assert max(sizes) - min(sizes) <= 3, sizes
        # One dimension is left, the id: shards are ranges of it.
        ends = sorted((min(ids), max(ids)) for s in range(8) if (ids := [r["doc_id"] for r in placed if r["shard"] == s and r["doc_id"] is not None]))
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def plain_leaves(rows, dims, shards):
    """rows: (id, size, tie, dims...). The leaf of each id, by splitting at the exact weighted median."""
    spread = [max((r[3 + d] for r in rows), default=0) - min((r[3 + d] for r in rows), default=0) for d in range(dims)]
    out = {}

    def split(mine, first, leaves):
        if leaves == 1 or not mine:
            out.update({r[0]: first for r in mine})
            return
        wide = [(max(r[3 + d] for r in mine) - min(r[3 + d] for r in mine)) / spread[d] if spread[d] else 0 for d in range(dims)]
        d = wide.index(max(wide))
        mine = sorted(mine, key=lambda r: (r[3 + d], r[2]))
        goal, below, cut = sum(r[1] for r in mine) * (leaves // 2) / leaves, 0, 0
        while cut < len(mine) and below + mine[cut][1] < goal:
            below += mine[cut][1]
            cut += 1
        if cut == 0 or goal - below > below + mine[cut][1] - goal:  # the nearer end, the first row at least
            cut += 1
        split(mine[:cut], first, leaves // 2)
        split(mine[cut:], first + leaves // 2, leaves - leaves // 2)

    split(rows, 0, shards)
    return out


def test_tree_against_plain_medians(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    r = random.Random(4)
    rows = [(k, r.randrange(10, 200), k * 7 % 500, float(r.randrange(6)), r.random(), float(r.randrange(3))) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, _size long, _tie long, a double, b double, c double")
    for shards in (2, 5, 16):
        root = sharding.kd_tree(df, ["a", "b", "c"], shards)
        from pyspark.sql import functions as F

        got = {x["id"]: x["s"] for x in df.select("id", root.place({n: F.col(n) for n in "abc"}, F.col("_tie")).alias("s")).collect()}
        assert got == plain_leaves(rows, 3, shards)


def test_equal_texts_stay_together(spark):
    """Groups below the limit are in one shard, a huge one is parted, and shards are near equal."""
    rows = [(k, text(k // 3, 40 + k // 3 % 30), f"source_with_a_long_name_{k % 2}", "en", 0) for k in range(600)]
    rows += [(1000 + k, "huge " * 20, "z", None, 0) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(4)
    placed = sharding.assign_shards(docs, shards=8).select("text", "shard").collect()
    of, load = {}, Counter()
    for r in placed:
        of.setdefault(r["text"], set()).add(r["shard"])
        load[r["shard"]] += len(r["text"].encode()) + 16
    assert len(of.pop("huge " * 20)) > 1 and all(len(s) == 1 for s in of.values())
    assert max(load.values()) < 1.15 * min(load.values())


def test_sources_are_told_apart_by_their_ends(spark):
    df = spark.createDataFrame([("common_crawl_2024",), ("common_crawl_2019",), (None,), ("common_crawl_2019",)], "x string")
    got = sharding._ranked(df.select("x", F_col("x").alias("_d_x")), "_d_x").collect()
    assert {(r["x"], r["_d_x"]) for r in got} == {("common_crawl_2019", 0.0), ("common_crawl_2024", 1.0), (None, -1.0)}


def plain_winnow(t, k, w):
    base, mask = int(winnowing._BASE), 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    if not t:
        return []
    s = t + "\0" * max(0, k - len(t))
    hashes = []
    for i in range(len(s) - k + 1):
        h = 0
        for c in s[i : i + k]:
            h = (h * base + mix(ord(c) + 1)) & mask
        hashes.append(mix(h) >> 32)
    out = set()
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i : i + w]
        j = max(q for q, h in enumerate(window) if h == min(window))
        out.add((i + j, hashes[i + j]))
    return sorted(out)


@pytest.mark.parametrize("k,w", [(5, 4), (24, 77), (1, 1), (7, 3)])
def test_winnowing_is_exact(k, w):
    r = random.Random(k)
    texts = ["".join(r.choice("abé \U0001f600") for _ in range(r.choice([0, 1, 3, k, k + w, 300]))) for _ in range(25)]
    owner, hashes, at = winnowing.selected(texts, k, w)
    for j, t in enumerate(texts):
        assert [(int(p), int(h)) for p, h in zip(at[owner == j], hashes[owner == j])] == plain_winnow(t, k, w)


def test_winnowing_guarantee():
    passage = text(9, 40)[: winnowing.K + winnowing.W - 1]
    owner, hashes, _ = winnowing.selected([text(5, 200) + passage + text(6, 50), "x" * 33 + passage + text(7, 10)])
    assert set(hashes[owner == 0]) & set(hashes[owner == 1])


def spark_hash(t: str) -> int:
    import xxhash

    h = xxhash.xxh64(t.encode(), seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("n", [1, 2, 9, 30])
def test_null_and_equal_ids_are_dealt_over_buckets(spark, n):
    """A third of the rows has no id and a third has one and the same; some are alike in all."""
    rng = random.Random(n)
    ids = [None] * 100 + [7] * 100 + rng.sample(range(-50, 2**62, 10**15 + 1), 99) + [7]
    rows = [(i, text(k, 3 + k % 9)) for k, i in enumerate(ids)] + [(7, text(150, 3 + 150 % 9)), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt, _ = winnowing.followed(docs, n)
    sizes = [r["count"] for r in dealt.filter("NOT halo").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 4 * len(rows) / n + 8
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), spark_hash(r[1]), r[1]))
    expected = []
    for k, (i, t) in enumerate(ordered):
        after, third = ordered[(k + 1) % len(ordered)][1], len(t) // 3
        expected.append((str(i), hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()))
    found = winnowing.compare_with_next(docs, n).select("doc_id", "edited_sha256").collect()
    assert sorted((str(r[0]), r[1]) for r in found) == sorted(expected)


def test_next_document(spark):
    docs = awkward(spark)
    got = winnowing.compare_with_next(docs, partitions=3).collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    texts = [r["text"] or "" for r in rows]
    want = []
    for k, (r, t) in enumerate(zip(rows, texts)):
        after, third = texts[(k + 1) % len(texts)], len(t) // 3
        want.append((r["doc_id"] or -1, len(t), hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()))
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1] == prints[2] and prints[4] == prints[5] == ""
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert winnowing.compare_with_next(empty(spark), 3).count() == 0
    assert winnowing.compare_with_next(docs.filter("doc_id = 1"), 3).first()["near_next"] == 1.0
    assert winnowing.fingerprints(clashing(docs)).count() == docs.count()


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary()


def test_pieces_are_lossless_and_reproducible(spark, vocabulary):
    docs = awkward(spark)
    made = pieces.encode(clashing(docs), keep=("lang",))
    back = pieces.decode(made)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back.collect()) == sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    again = pieces.encode(docs.repartition(3))
    assert sorted((r["doc_id"] or -1, r["pieces"]) for r in again.collect()) == sorted((r["doc_id"] or -1, r["pieces"]) for r in made.collect())
    assert pieces.encode(empty(spark)).count() == 0


def test_pieces_follow_the_lattice(vocabulary):
    """Sampled ways have the probabilities of a plain enumeration."""
    weights = {int(k): w for k, w in zip(vocabulary.ids, vocabulary.weights)}
    named = {}
    for k in weights:
        named.setdefault(vocabulary.pieces[k].decode(), []).append(k)

    def ways(s):
        if not s:
            return {(): 1.0}
        return {(k, *rest): np.exp(weights[k]) * p for n in range(1, len(s) + 1) for k in named.get(s[:n], ()) for rest, p in ways(s[n:]).items()}

    for word in ("tea", "walls", "a b"):
        want = ways(" " + word)
        total, n = sum(want.values()), 20000
        ids, ends = pieces.cut([word] * n, pieces._row_seeds(range(n), 3), vocabulary)
        got = Counter(tuple(map(int, x)) for x in np.split(ids, ends[:-1]))
        assert set(got) <= set(want)
        assert sum(abs(got[w] / n - p / total) for w, p in want.items()) < 0.05


def test_likeness_against_plain_fingerprints(spark):
    """near_edited and near_next are the Jaccard similarities of plainly chosen hash sets."""
    docs = clashing(awkward(spark)).withColumnRenamed("own", "positions")
    rows = sorted(awkward(spark).collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    texts = [r["text"] or "" for r in rows]
    chosen = lambda t: {h for _, h in plain_winnow(t, 24, 77)}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for k, (r, t) in enumerate(zip(rows, texts)):
        if len(t) > 5000:
            continue  # the plain version is slow
        after, third = texts[(k + 1) % len(texts)], len(t) // 3
        next_print = chosen(after) if len(after) <= 5000 else None
        near_next = None if next_print is None else round(jaccard(chosen(t), next_print), 9)
        want.append((r["doc_id"] or -1, round(jaccard(chosen(t), chosen(t[: len(t) - third] + after[:third])), 9), near_next))
    got = {}
    for r in winnowing.compare_with_next(docs, partitions=2).collect():
        got.setdefault(r["doc_id"] or -1, []).append((round(r["near_edited"], 9), round(r["near_next"], 9)))
    for k, edited, after in want:
        assert any(e == edited and (after is None or n == after) for e, n in got[k]), k


def test_pieces_of_null_rows_are_empty_texts(spark):
    made = spark.createDataFrame([(1, None), (None, [])], "doc_id long, pieces array<int>")
    assert sorted(((r["doc_id"] or -1), r["text"]) for r in pieces.decode(made).collect()) == [(-1, ""), (1, "")]
