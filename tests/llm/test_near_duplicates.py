"""Near-duplicates, components, toxicity and the pipeline."""

import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import components, minhash, toxicity

from .helpers import DOCS, WORDS, awkward, clashing, empty, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_components(rows, n, threshold):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= threshold * len(x | y):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n,blocks", [(4, (512, 256)), (5, (8, 4))])
def test_against_all_pairs(spark, monkeypatch, n, blocks):
    """Families of near copies around the threshold, in blocks much smaller than they are too."""
    monkeypatch.setattr(minhash, "BLOCK", blocks[0])
    monkeypatch.setattr(minhash, "EXACT_BLOCK", blocks[1])
    r = random.Random(n)
    rows = []
    for family in range(8):
        base = text(family, 100).split()
        for _ in range(25):
            words = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
                words[r.randrange(len(words))] = r.choice(WORDS) + str(r.randrange(99))
            rows.append((len(rows), " ".join(words).upper() if r.random() < 0.1 else " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One TWO"), (1004, "two one"), (1005, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(df, shingle=n).collect()}
    assert got == plain_components(rows, n, 80)


def test_awkward_tables(spark):
    docs = awkward(spark)
    found = minhash.near_duplicates(clashing(docs), shingle=4).collect()
    assert len(found) == docs.count()
    want = plain_components([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == want
    assert [r["kept"] for r in found if r["doc_id"] is None] == [True]
    left = minhash.one_of_each(clashing(docs))
    assert left.columns == clashing(docs).columns and sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 1, 4, 5, 6, 7, 8, 8, 9, 10]
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_estimate_is_close(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    pair = [text(1, 300), " ".join(text(1, 300).split()[:270] + text(2, 30).split())]
    bits = minhash.sketched(pa.array(pair, pa.large_string()), 5)[3].view("int64").tolist()
    got = spark.createDataFrame([tuple(bits)], "a array<long>, b array<long>").select(minhash.estimate(F.col("a"), F.col("b"))).first()[0]
    x, y = (shingles(t, 5) for t in pair)
    assert got == pytest.approx(len(x & y) / len(x | y), abs=0.2)


def test_components(spark):
    r = random.Random(5)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    up = {}
    for a, b in pairs:
        if a is not None and a != b:
            up.setdefault(a, a)
            up.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a is not None and a != b and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    assert got == up
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def labelled(n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        words = text(seed * 1000 + k, r.randrange(5, 120)).split()
        bad = k % 4 == 0
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["grumbleface", "snotnose", "blockhead"]))
        rows.append((" ".join(words), int(bad)))
    return rows


def test_toxicity_learns_words_and_their_misspellings(spark):
    rows = labelled(600, 1)
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    docs = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(labelled(200, 2))], "doc_id long, text string, y int")
    got = toxicity.score(docs, model).collect()
    assert sum(r["predicted"] == r["y"] for r in got) >= 195
    odd = spark.createDataFrame([(1, "you grumblefase there"), (2, "the blokhead fox"), (3, "the green tea"), (4, None), (5, ""), (6, " \n")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert min(scores[1], scores[2]) > scores[3] and max(scores[4], scores[5], scores[6]) < toxicity.THRESHOLD
    assert all(0 <= s <= 1 for s in scores.values())


def test_toxicity_of_awkward_tables(spark):
    docs, model = awkward(spark), toxicity.train(["a", "b"], [0, 0])
    scored = toxicity.score(clashing(docs), model)
    assert scored.count() == docs.count() and scored.filter("predicted = 1").count() == 0
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, None), (None, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and kept.count() == docs.count()
    assert toxicity.keep_clean(empty(spark), labels.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    """On the driver's own labels, none of which are learnt from."""
    import os

    if not os.path.isdir("/root/testdata/sf0.1/labels.parquet") and not os.path.isfile("/root/testdata/sf0.1/labels.parquet"):
        pytest.skip("no data")
    found = toxicity.op9_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.95 * len(rows)


def test_pipeline(spark, tmp_path):
    """Each stage keeps what a plain reading says, and the last one's pieces decode to the texts."""
    from ledgerloom.llm import mixing, pieces, quality

    docs = awkward(spark)
    rows = [(100 + k, text(k, 60 + k), "en", "abc"[k % 3], 1) for k in range(30)]
    docs = docs.unionByName(spark.createDataFrame(rows, DOCS))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = corpus_pipeline.clean(spark, docs, str(tmp_path))
    assert clean.count() == docs.count() and clean.columns == docs.columns
    good = corpus_pipeline.good(spark, clean, str(tmp_path))
    mask = quality.policy_mask("strict-1")
    bits = quality.ledger(docs).collect()
    assert sorted(r["doc_id"] or -1 for r in good.collect()) == sorted(r["doc_id"] or -1 for r in bits if not r["failed_bits"] & mask)
    one = corpus_pipeline.distinct(spark, good, str(tmp_path))
    plain = plain_components([(r["doc_id"], r["text"]) for r in good.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in one.filter("doc_id IS NOT NULL").collect()) == sorted(i for i, (_, c) in plain.items() if i == c)
    mixed = corpus_pipeline.mixed(spark, one, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() == mixing.with_copies(one).groupBy().sum("copies").first()[0]
    result = corpus_pipeline.run(spark, str(tmp_path))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    back = pieces.decode(result).collect()
    assert sorted(r["doc_id"] or -1 for r in back) == sorted(r["doc_id"] or -1 for r in mixed.collect())
    assert all(r["text"] == texts[r["doc_id"]] for r in back)


def test_pairs_longer_than_a_slice(spark, monkeypatch):
    """A pair's two texts stay together however texts are sliced."""
    from ledgerloom.llm import flat

    real = flat.slices
    monkeypatch.setattr(minhash, "slices", lambda texts, limit=1: real(texts, limit))
    rows = [(k, text(k // 2, 40) + (" end" if k % 2 else "")) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(k, k + 1) for k in range(19)], "u long, v long")
    got = sorted((r["u"], r["v"]) for r in minhash.confirmed(df, pairs, 5, 80).collect())
    assert got == [(k, k + 1) for k in range(0, 20, 2)]


def test_repeated_ids_have_one_text(spark):
    """Rows of one doc_id are one document, with the smallest of their texts, and links of no other."""
    a, b = text(1, 60), text(2, 60)
    small, large = sorted((a, b))
    rows = [(1, large), (1, small), (1, None), (2, small), (3, large)]
    for order in (rows, rows[::-1]):
        found = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3), shingle=4).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3)]


def test_hot_classes_and_hot_nodes(spark, monkeypatch):
    """A class and a node with most of the rows, beside small ones, when hot ones are set apart."""
    from ledgerloom.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    rows = [(k, text(1, 50)) for k in range(40)] + [(100 + k, text(1, 50) + f" end{k}") for k in range(30)] + [(200 + k, text(k // 2 + 9, 40)) for k in range(20)] + [(300 + k, "") for k in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows, 5, 80)


def plain_grams(t):
    """(word, buckets) of each word of a text, by the definition: its n-grams of code points with a
    space at either edge, and itself."""
    bits, mask = 32 - toxicity.BUCKET_BITS, 2**32 - 1
    s = " " + "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in t) + " "
    codes = [int(toxicity._MIX[ord(c) & 0xFFFF]) ^ ((ord(c) >> 16) * 0x9E3779B1 & mask) for c in s]
    out = []
    for m in re.finditer("[^ ]+", s):
        found = []
        for n in toxicity.GRAMS:
            for i in range(m.start() - 1, m.end()):
                if i + n <= len(s) and " " not in s[i + 1 : i + n - 1]:
                    x = codes[i]
                    for c in codes[i + 1 : i + n]:
                        x = (x * 0x01000193 + c) & mask
                    x = x * 0x9E3779B1 & mask
                    found.append((((x ^ (x >> 15)) * 0x85EBCA77 + n) & mask) >> bits)
        x = sum(c * ((2654435761 * (k + 1) + 1) & mask) for k, c in enumerate(codes[m.start() : m.end()])) & mask
        x = (x ^ (x >> 16)) * 0x85EBCA6B & mask
        found.append(((x ^ (x >> 13)) * 0xC2B2AE35 & mask) >> bits)
        out.append(found)
    return out


def test_scores_against_a_plain_version():
    import numpy as np
    import pyarrow as pa

    values = np.random.Generator(np.random.PCG64(1)).integers(-(2**15), 2**15, 1 << toxicity.BUCKET_BITS)
    texts = ["You Idiot there", "één \U0001f600 straße\tÉTÉ", "a", "", " \n ", "word " * 50 + "odd", "日本語 テキスト x"]
    got = toxicity._text_scores(pa.array(texts, pa.large_string()), values)
    for t, g in zip(texts, got, strict=True):
        words = plain_grams(t)
        windows = [sum(words[i : i + toxicity.WINDOW], []) for i in range(max(1, len(words) - toxicity.WINDOW + 1))] if words else []
        means = [sum(int(values[b]) for b in w) * toxicity.UNIT / len(w) for w in windows]
        assert (np.isnan(g) and not means) or g == pytest.approx(max(means))


def test_a_step_against_a_plain_version():
    import copy
    import math

    import numpy as np

    rng = np.random.Generator(np.random.PCG64(2))
    mine = toxicity._Learner.new(rng, buckets=12)
    plain = copy.deepcopy(mine)
    bags, goal, weight = [[1, 2, 2], [3], [2, 5, 7, 7]], [1, 0, 1], [0.5, 2.0, 1.0]
    mine.step(np.concatenate(bags), np.array([len(b) for b in bags]), np.array(goal), np.array(weight, np.float32))
    d = toxicity.DIMENSIONS
    g_v, g_s, g_b = np.zeros((12, d)), np.zeros((2, d)), np.zeros(2)
    for bag, y, w in zip(bags, goal, weight, strict=True):
        mean = [sum(float(plain.vectors[b][k]) for b in bag) / len(bag) for k in range(d)]
        logits = [sum(float(plain.softmax[c][k]) * mean[k] for k in range(d)) + float(plain.bias[c]) for c in (0, 1)]
        total = sum(map(math.exp, logits))
        for c in (0, 1):
            off = (math.exp(logits[c]) / total - (c == y)) * w / len(bags)
            g_b[c] += off
            for k in range(d):
                g_s[c][k] += off * mean[k]
                for b in bag:
                    g_v[b][k] += off * float(plain.softmax[c][k]) / len(bag)
    for b in range(12):
        if g_v[b].any():
            assert mine.vectors[b] == pytest.approx(plain.vectors[b] - toxicity.RATE * g_v[b] / np.sqrt(1e-4 + (g_v[b] ** 2).mean()), rel=1e-4, abs=1e-6)
        else:
            assert (mine.vectors[b] == plain.vectors[b]).all()
    assert mine.softmax == pytest.approx(plain.softmax - toxicity.RATE * 0.2 * g_s / np.sqrt(1e-4 + g_s**2), rel=1e-4, abs=1e-6)
    assert mine.bias == pytest.approx(plain.bias - toxicity.RATE * g_b, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("case", ["empty", "clashing"])
def test_pipeline_of_awkward_tables(spark, tmp_path, case):
    """An empty table gives an empty result, and columns named like ones that stages add go through."""
    docs = empty(spark) if case == "empty" else clashing(awkward(spark))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        stage = step(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == ["doc_id", "lang", "source", "n_pieces", "pieces"]
    assert (result.count() == 0) == (case == "empty")


def test_long_families_meet_in_blocks_of_bounded_bytes(spark, monkeypatch):
    """Texts of one family are long: fewer of them meet at once, and no link is lost."""
    monkeypatch.setattr(minhash, "EXACT_BYTES", 20_000)
    base = text(77, 700)
    rows = [(k, f"{base} own ending {k} {k * k}", "en", "a", 1) for k in range(40)]
    members = spark.createDataFrame([(1, k, k, t) for k, t, *_ in rows], "group long, doc_id long, component long, text string")
    dealt = minhash._cross_blocks(members, 256, 4096, 20_000)
    sizes = [r["bytes"] for r in dealt.groupBy("group", "i", "j", "b").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()]
    assert len(sizes) > 20 and max(sizes) < 60_000
    found = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["component_id"] for r in found} == {0}


def test_sets_of_slices_are_those_of_all(monkeypatch):
    texts = pa.array([text(k, 50) for k in range(20)] + [None, "", "one two"])
    whole = minhash.shingle_sets(texts, 5)
    monkeypatch.setattr(minhash, "slices", lambda t: ((k, min(k + 3, len(t))) for k in range(0, len(t), 3)))
    assert all((a == b).all() for a, b in zip(minhash.sliced_sets(texts, 5), whole, strict=True))
