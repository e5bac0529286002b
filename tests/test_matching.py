"""Values are found in pages by one automaton, as a place-by-place search finds them."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import tokens
from ledgerloom.operators.tokens import find_runs


def plain(page, values):
    places = ((rank, k, len(v), field) for rank, field, v in values for k in range(len(page) - len(v) + 1) if page[k : k + len(v)] == v)
    return sorted(places)


def test_random_pages():
    rng = random.Random(3)
    alphabet = ["a", "b", "ab", "", "a\x1fb", "\x1f", "é"]
    for _ in range(400):
        page = rng.choices(alphabet, k=rng.randrange(40))
        values = [(rng.randrange(3), rng.choice("xyz"), rng.choices(alphabet, k=rng.randrange(1, 4))) for _ in range(rng.randrange(12))]
        assert find_runs(page, values) == plain(page, values)


def test_many_values_of_a_page(spark):
    """Two hundred values on a page, of which most are there, some twice, and pages without any."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(300)}" for _ in range(3000)]
    rows = [(1, k, w) for k, w in enumerate(words)] + [(2, 0, "alone"), (3, 0, None)]
    page = spark.createDataFrame(rows, "doc_id long, pos long, word string")
    starts = [rng.randrange(2990) for _ in range(200)]
    made = [(1, f"f{k}", " ".join(words[s : s + 1 + k % 3])) for k, s in enumerate(starts)]
    values = spark.createDataFrame([*made, (1, "none", "  "), (4, "f", "x")], "doc_id long, field string, value string")
    found = sorted(tuple(r) for r in tokens.value_ngram_match(page, values).collect())
    expected = sorted((1, field, start, n) for _, start, n, field in plain(words, [(0, f, v.split()) for _, f, v in made]))
    assert found == expected and len(found) >= 200
    assert tokens.value_ngram_match(page, values.limit(0)).count() == 0
    labels = {(r.doc_id, r.pos): r.label for r in tokens.weak_label(page, values.withColumn("rank", F.lit(1))).collect()}
    assert len(labels) == 3002 and labels[2, 0] == labels[3, 0] == "O" and sum(x.startswith("B-") for x in labels.values()) > 100
