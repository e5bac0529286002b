"""Conversation repair, source divergence and byte-level BPE against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, divergence, repair

from .helpers import awkward, clashing, empty, text

TURNS = "conv_id long, turn long, role string, text string"


# ---- conversation repair ----

def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str, list[str]]:
    """(cost, audit, final roles) by trying everything up to the cost of deleting all.

    rows: (role initial, fault), fault one of k, t, d."""
    limit, best = 2 * len(rows), None

    def go(k, cost, audit, roles):
        nonlocal best
        if cost > limit or not re.fullmatch("s?(ua)*u?", "".join(roles)):
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(roles)):
            best = min(best or (cost, audit, roles), (cost, audit, roles))
        for r in "ua":
            go(k, cost + 5, audit + "I", [*roles, r])
        if k < len(rows):
            initial, fault = rows[k]
            go(k + 1, cost + 2, audit + "D", roles)
            if fault != "d":
                more = 5 if fault == "t" else 0
                go(k + 1, cost + more, audit + "K", [*roles, initial])
                for r in "ua":
                    go(k + 1, cost + more + 1, audit + "R", [*roles, r])

    go(0, 0, "", [])
    return best


def test_automaton_against_all_edits():
    random.seed(5)
    letters = [(i, f) for i in "suax" for f in "ktd"]
    for n in range(6):
        every = list(itertools.product(letters, repeat=n)) if n < 3 else [random.choices(letters, k=n) for _ in range(150)]
        for rows in every:
            signature = "".join("d" if f == "d" else i.upper() if f == "t" else i for i, f in rows)
            nodes = [repair._end()]
            for letter in reversed(signature):
                nodes.append(repair._node(letter, nodes[-1]))
            script = repair._script(signature[::-1], nodes)
            cost, audit, roles = cheapest(list(rows))
            assert (nodes[-1][0][0], script.translate(str.maketrans("uaUA", "IIRR"))) == (cost, audit)
            kept = iter([c for c in script if c != "D"])
            assert [c.lower() if c != "K" else r for c, r in zip(kept, roles)] == roles


def plain_repair(rows: list[tuple]) -> dict:
    talks, out = defaultdict(list), {}
    for conv, turn, role, said in rows:
        talks[conv].append((turn, " " if role is None else role, " " if said is None else said))
    for conv, turns in talks.items():
        after = []
        for turn, role, said in turns:
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            case = zlib.crc32(name.encode()) % 20
            if case:
                said = {1: "", 2: re.sub("[.!?]", "", said)}.get(case, said)
                after += [(turn, "user" if case == 4 else role, said)] * (2 if case == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, said in after:
            words = re.sub(r"[\x20\x09-\x0D]+", "", said)
            faults.append("b" if not words else "d" if (role, said) in seen else "k" if words[-1] in ".!?" else "t")
            seen.add((role, said))
        initials = [r[1][:1] if r[1][:1] in tuple("sua") else "x" for r in after]
        cost, audit, roles = cheapest([(i, "d" if f == "b" else f) for i, f in zip(initials, faults)])
        lines, k, roles = [], 0, iter(roles)
        for edit in audit:
            role = next(roles) if edit != "D" else ""
            name = {"u": "user", "a": "assistant"}.get(role, "")
            if edit == "I":
                lines.append(f"{name}:")
                continue
            if edit != "D":
                lines.append(f"{after[k][1] if edit == 'K' else name}:{after[k][2]}")
            k += 1
        known = {r[0] for r in after if r[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def awkward_turns():
    random.seed(11)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (70, None, "user", "é\x0b"), (71, None, None, "")]
    for conv in range(60):
        for turn in range(random.randrange(1, 5)):
            role = random.choice(["user", "assistant", "system", "tool", "", None])
            said = random.choice(["Yes.", "No", " \n\t ", "", None, "Why?\n", "a.b", " ", "Yes."])
            rows.append((conv, random.choice([turn, turn * 2, None]), role, said))
    return rows


def repaired(spark, turns, tmp_path):
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    found = repair.op11_repair_conversations(spark, str(tmp_path)).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


def test_repair_against_a_plain_version(spark, tmp_path):
    rows = awkward_turns()
    turns = spark.createDataFrame(rows, TURNS).withColumns({"g": F.lit("x"), "place": F.lit(1), "first": F.lit(2), "_n": F.lit(3)})
    assert repaired(spark, turns.repartition(3), tmp_path) == plain_repair(rows)


def test_repair_of_an_empty_table_and_of_a_conversation_that_is_gone(spark, tmp_path):
    assert repaired(spark, spark.createDataFrame([], TURNS), tmp_path / "a") == {}
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    found = repaired(spark, spark.createDataFrame([(conv, 0, "user", "Hi.")], TURNS), tmp_path / "b")
    assert found == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_of_a_long_conversation_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 7)
    rows = [(5, k, "user" if k % 2 == 0 else "assistant", f"Part {k}.") for k in range(400)]
    found = repaired(spark, spark.createDataFrame(rows, TURNS).repartition(5), tmp_path)[5]
    gaps, *faults, _, audit, _ = found
    dropped = [k for k in range(400) if zlib.crc32(f"5:{k}".encode()) % 20 == 0]
    assert gaps == len([k for k in dropped if 0 < k < 399]) and len(audit.replace("I", "")) == 400 - len(dropped) + faults[1]


# ---- source divergence ----

def plain_divergence(rows: list[tuple], least: int, top: int) -> list[tuple]:
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, n = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for lang, source, said in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (said or "").translate(table))
        docs[lang or ""].update(set(terms))
        n[lang or ""][source or ""].update(terms)
    out = []
    for lang, sources in n.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        whole = Counter()
        for c in sources.values():
            whole.update(c)

        def prices(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        q, p = prices(whole), {s: prices(c) for s, c in sources.items()}
        for s, c in sources.items():
            pairs = [(r, sum(abs(p[s][t] - p[r][t]) for t in kept)) for r in sources if r != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ordered[: None if part == "pair" else top], 1)]
    return sorted(out)


def spoken(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["Tea", "tea", "ÉTÉ", "été", "a1b", "x-y", "中文", "İ", "the", "of", "and", "Wall", "é\u0000b", "z"]
    rows = []
    for _ in range(300):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"])
        said = " ".join(rng.choices(words, weights=range(1, 15), k=rng.choice([0, 3, 9]))) if rng.random() < 0.95 else None
        rows.append((lang, source, said))
    return [*rows, ("xx", "only", "never enough"), ("xx", "other", None), ("yy", "alone", "")]


@pytest.mark.parametrize("least,top", [(10, 4), (30, 50), (1, 2)])
def test_divergence_against_a_plain_version(spark, monkeypatch, least, top):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    given_rows = spoken(least)
    docs = spark.createDataFrame(given_rows, "lang string, source string, text string")
    docs = docs.repartition(3).withColumns({"term": F.lit("x"), "block": F.lit(1), "n": F.lit(2), "counts": F.lit(3), "value": F.lit(4)})
    assert sorted(map(tuple, divergence.divergence(docs, least, top).collect())) == plain_divergence(given_rows, least, top)


@pytest.mark.parametrize("rows,columns", [(1, 1), (3, 4), (256, 2048)])
def test_a_block_in_slices_of_any_size(monkeypatch, rows, columns):
    """In this process, as a task would: workers import the module anew, without these settings."""
    monkeypatch.setattr(divergence, "ROWS", rows)
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    rng = np.random.default_rng(1)
    counts = rng.poisson(rng.choice([0.3, 2, 30], (40, 1)), (40, 6))
    terms = pa.table({"term": [f"t{k}" for k in range(40)], "counts": [[{"source": f"s{g}", "n": int(n)} for g, n in enumerate(row) if n] for row in counts]})
    totals = counts.sum(axis=0)
    groups = pa.table({"lang": ["en"] * 6, "source": [f"s{g}" for g in range(6)], "total": totals, "terms": [40] * 6, "lang_total": [int(totals.sum())] * 6})
    prices = [[1 + 10**9 * (int(n) + 5) // (int(totals[g]) + 200) for n in counts[:, g]] for g in range(6)]
    expected = [[sum(abs(p - q) for p, q in zip(prices[a], prices[b])) for b in range(6)] for a in range(6)]
    assert divergence._Block(terms, groups).distances().tolist() == expected


@pytest.mark.parametrize("held", [1, 30, 10**6])
def test_counts_that_are_given_out_early(monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = [(lang or "", source or "", said or "") for lang, source, said in spoken(7)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r)) for r in rows[k : k + 40]]) for k in range(0, len(rows), 40)]
    n, docs, expected_n, expected_docs = Counter(), Counter(), Counter(), Counter()
    for batch in divergence._count(batches):
        for r in batch.to_pylist():
            n[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, source, said in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", said.translate(table))
        expected_n.update((lang, source, t) for t in terms)
        expected_docs.update((lang, source, t) for t in set(terms))
    assert (n, docs) == (expected_n, expected_docs)


def test_joint_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    rows = spoken(3)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    kept = {(r.lang, r.term): Counter() for r in divergence.kept_terms(docs, 10).collect()}
    for r in divergence.kept_terms(docs, 10).collect():
        for source, n in r.counts:
            kept[r.lang, r.term][source] += n
    sources = defaultdict(set)
    for lang, source, _ in rows:
        sources[lang or ""].add(source or "")
    expected = Counter()
    for (lang, _), c in kept.items():
        for a, b in itertools.combinations(sorted(sources[lang], key=str.encode), 2):
            expected[lang, a, c[a], b, c[b]] += 1
    found = {tuple(r)[:5]: r.terms for r in divergence.joint_tables(docs, 10).collect()}
    assert found == dict(expected)


def test_divergence_of_awkward_tables(spark):
    assert divergence.divergence(empty(spark)).count() == 0
    docs = clashing(awkward(spark))
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert sorted(map(tuple, divergence.divergence(docs, 2).collect())) == plain_divergence(rows, 2, 50)


# ---- byte-level BPE ----

@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(public_tokenizers.path(bpe.RANKS))


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


ALPHABET = "abcdeehtinoors  \n\t'’éßЖ中\U0001f600019.,-_\x1c\x85 ​▁"


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=60) | st.text(max_size=30))
def test_encoding_equals_the_library(vocabulary, library, said):
    encoder = bpe.Encoder(vocabulary)
    ids = encoder.ids(said)
    assert ids == library.encode_ordinary(said)
    assert encoder.decoded(np.array(ids, np.int64)) == said.encode()


def test_pairs_against_merging(vocabulary):
    rng = random.Random(2)
    frequent = rng.choices(range(256, 3000), k=4000)
    for left, right in zip(frequent, [*frequent[1:], *rng.choices(range(len(vocabulary.tokens)), k=1)]):
        *_, parts = vocabulary.merges(vocabulary.tokens[left] + vocabulary.tokens[right])
        assert vocabulary.follows(left, right) == (parts == [vocabulary.tokens[left], vocabulary.tokens[right]])


def test_drafts_keep_the_encoding(vocabulary, library):
    rng = random.Random(4)
    for _ in range(150):
        draft = bpe.Draft(vocabulary, "".join(rng.choices(ALPHABET, k=rng.randrange(60))))
        for _ in range(8):
            a = rng.randrange(len(draft.text) + 1)
            b = min(len(draft.text), a + rng.choice([0, 0, 1, 3, 9]))
            new = "".join(rng.choices(ALPHABET, k=rng.choice([0, 1, 2, 8])))
            expected = draft.text[:a] + new + draft.text[b:]
            draft.replace(a, b, new)
            assert draft.text == expected and draft.ids() == library.encode_ordinary(expected)
        draft.append("tail's end")
        assert draft.ids() == library.encode_ordinary(draft.text)


def test_an_edit_of_a_long_piece_is_local(vocabulary, library, monkeypatch):
    rng = random.Random(6)
    piece = bpe.Prefixes(vocabulary, "".join(rng.choices("abcdehtinors", k=4000)).encode())
    calls = []
    follows = bpe.Vocabulary.follows
    monkeypatch.setattr(bpe.Vocabulary, "follows", lambda self, *pair: calls.append(pair) or follows(self, *pair))
    for _ in range(30):
        vocabulary.pairs.clear()
        calls.clear()
        a = rng.randrange(len(piece.data) - 3)
        piece.replace(a, a + 3, b"the")
        assert piece.ids() == library.encode_ordinary(piece.data.decode())
        assert len(calls) < 2500  # not some 10,000, as for the whole piece
    piece.append(b"ing")
    assert piece.ids() == library.encode_ordinary(piece.data.decode())


def test_long_texts_are_split_in_parts(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 10)
    for said in (text(8, 300) + "   \n\n x's" * 9, "x" * 99, " " * 40 + "é  \n" * 20):
        assert bpe.Encoder(vocabulary).ids(said) == library.encode_ordinary(said)


def test_encode_and_decode_awkward_tables(spark, library):
    docs = clashing(awkward(spark)).withColumn("ids", F.lit("x"))
    made = bpe.encode(docs, keep=("lang",))
    assert made.columns == ["doc_id", "lang", "ids"]
    found = sorted((str(r.doc_id), r.ids) for r in made.collect())
    assert found == sorted((str(r.doc_id), library.encode_ordinary(r.text or "")) for r in docs.collect())
    back = sorted((str(r.doc_id), bytes(r.data)) for r in bpe.decode(made).collect())
    assert back == sorted((str(r.doc_id), (r.text or "").encode()) for r in docs.collect())
    assert bpe.encode(empty(spark)).count() == 0


def test_query_digests(spark, library, tmp_path):
    docs = awkward(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(str, bpe.op13_byte_bpe(spark, str(tmp_path)).collect()))
    expected = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        packed = np.array(ids, "<u4").tobytes()
        digests = (hashlib.sha256(x).hexdigest() for x in (packed, (r.text or "").encode()))
        expected.append(f"Row(doc_id={r.doc_id}, n_tokens={len(ids)}, ids_sha256='{next(digests)}', decoded_sha256='{next(digests)}')")
    assert found == sorted(expected)
