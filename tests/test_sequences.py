"""Similarities of many pairs equal those of the standard library."""

import difflib
import random

import pytest

from ledgerloom.functions import sequences


def pairs(seed, n, longest):
    rng = random.Random(seed)
    for _ in range(n):
        alphabet = rng.choice(["ab", "abcdef ", "abcdefghijklmnopqrstuvwxyz .,é\U0001f600"])
        a = "".join(rng.choices(alphabet, k=rng.randrange(longest)))
        kind = rng.random()
        if kind < 0.4:
            b = "".join(rng.choices(alphabet, k=rng.randrange(longest)))
        else:
            b = list(a)
            for _ in range(rng.randrange(1, 6)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.choice([0, 1, 4])] = rng.choices(alphabet, k=rng.choice([0, 1, 9]))
            b = "".join(b)
        yield a, b


def plain(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("n,longest", [(6000, 12), (2000, 60), (200, 450), (6, 4000)])
def test_random_pairs(n, longest):
    a, b = zip(*pairs(longest, n, longest), strict=True)
    assert sequences.ratios(list(a), list(b)).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]


def test_small_groups_and_nulls(monkeypatch):
    monkeypatch.setattr(sequences, "CELLS", 40)
    a, b = zip(*pairs(3, 300, 30), strict=True)
    assert sequences.ratios(list(a), list(b)).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]
    found = sequences.ratios([None, "", "x", "", "x"], ["x", None, "", "", "x"]).tolist()
    assert found[2:] == [0.0, 1.0, 1.0] and all(r != r for r in found[:2])
    assert sequences.ratios([], []).tolist() == []
