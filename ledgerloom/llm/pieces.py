"""SentencePiece encoding by sampling, and decoding.

All ways to cut a text into pieces of a given vocabulary form a lattice. Forward filtering sums the
weight of the ways to reach each place; backward sampling then draws pieces from the end with exactly
the probability that their way has among all. Draws depend on the row's key, the place and a seed
alone. No piece crosses from a word into the white space after it, so the lattice falls into words,
each distinct one is filtered once in a batch, and all its occurrences are drawn from that.

The vocabulary has ranks instead of probabilities (it was made by merging), so piece k gets the Zipf
weight 1 / (k + 2.7), normalised. Characters without a piece, and a literal U+2581, which is what
stands for a space, are spelt in bytes; hence decoding restores every text exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .flat import mixed, powers, slices

#: The public vocabulary file; any SentencePiece model with byte pieces will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 1
#: Probabilities are raised to this power and normalised: 0 draws all ways alike, a large number the likeliest.
ALPHA = 1.0
#: Bytes of text that are cut at once.
SLICE = 750_000
_SPACE, _LITERAL = 0x2581, 0x110000
_FILTER_BITS = 21


@dataclass
class Vocabulary:
    """pieces: the bytes of each id, spaces as such. keys: hashes of pieces in order, with their ids
    and log weights. single: which code points are a piece. first_byte: the id of byte 0."""

    pieces: list[bytes]
    keys: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    single: np.ndarray
    longest: int
    first_byte: int
    seen: np.ndarray


def _span_hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, times an inverse power, are hashes of spans of codes."""
    up, _ = powers(len(codes) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def vocabulary(model: str = MODEL) -> Vocabulary:
    """Read the pieces of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(k) for k in range(n)]
    spelt = [k for k in range(n) if sp.is_byte(k)]
    if len(spelt) != 256:
        raise ValueError("the vocabulary has no byte pieces")
    whole = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
    if any("▁" in names[k].lstrip("▁") for k in whole):
        raise ValueError("a piece crosses from a word into a space")
    keys, single = np.zeros(len(whole), np.uint64), np.zeros(_LITERAL + 1, bool)
    for j, k in enumerate(whole):
        keys[j] = _span_hashes(_code_points(names[k]))[-1]
        if len(names[k]) == 1:
            single[ord(names[k])] = True
    keys = mixed(keys)
    rank = np.arange(len(whole)) + 2.7
    weights = -np.log(rank) - np.log((1 / rank).sum())
    order = np.argsort(keys)
    pieces = [names[k].replace("▁", " ").encode("utf-8", "surrogatepass") for k in range(n)]
    for b, k in enumerate(spelt):
        pieces[k] = bytes([b])
    for k in set(range(n)) - set(whole) - set(spelt):
        pieces[k] = b""
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[keys >> np.uint64(64 - _FILTER_BITS)] = True
    return Vocabulary(pieces, keys[order], np.array(whole, np.int32)[order], weights[order], single, max(len(names[k]) for k in whole), spelt[0], seen)


def _lattice(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, v: Vocabulary, alpha: float):
    """Filter the words codes[begin:end], laid end to end.

    (word starts, place -> first edge, edge -> piece id, edge -> start place, edge -> cumulated
    probability among the edges that end where it ends). Place k is after k codes.
    """
    size = end - begin
    start = np.concatenate([[0], np.cumsum(size)])
    flat = codes[np.repeat(begin - start[:-1], size) + np.arange(start[-1])]
    word_end = np.repeat(start[1:], size)
    sums = _span_hashes(flat)
    _, down = powers(len(flat) + 1)
    tails, heads, kinds, scores = [], [], [], []
    for n in range(1, v.longest + 1):
        at = np.flatnonzero(np.arange(n, len(flat) + n) <= word_end)
        if not len(at):
            break
        keys = mixed((sums[at + n] - sums[at]) * down[at])
        maybe = v.seen[keys >> np.uint64(64 - _FILTER_BITS)]
        at, keys = at[maybe], keys[maybe]
        found = np.minimum(np.searchsorted(v.keys, keys), len(v.keys) - 1)
        hit = v.keys[found] == keys
        at, found = at[hit], found[hit]
        tails.append((at + n).astype(np.int32))
        heads.append(at.astype(np.int32))
        kinds.append(v.ids[found])
        scores.append(alpha * v.weights[found])
    # Longer pieces first among those that end at one place: they are mostly likelier.
    tail, head, kind, score = (np.concatenate(x[::-1]) for x in (tails, heads, kinds, scores))
    order = np.argsort(tail, kind="stable")
    tail, head, kind, score = tail[order], head[order], kind[order], score[order]
    many = np.bincount(tail, minlength=len(flat) + 1)
    first_edge = np.cumsum(many) - many
    total, reach = np.zeros(len(flat) + 1), np.empty(len(tail))
    by_size = np.argsort(-size, kind="stable")
    reaching = np.searchsorted(-size[by_size], -np.arange(1, size.max() + 1), side="right")
    for depth, k in enumerate(reaching.tolist(), 1):
        base = start[:-1][by_size[:k]]
        place = base + depth
        n = many[place]
        at = np.cumsum(n) - n
        edge = np.repeat(first_edge[place] - at, n) + np.arange(at[-1] + n[-1])
        origin = head[edge]
        r = np.where(origin == np.repeat(base, n), 0.0, total[origin]) + score[edge]
        top = np.maximum.reduceat(r, at)
        r = np.exp(r - np.repeat(top, n))
        summed = np.add.reduceat(r, at)
        total[place] = top + np.log(summed)
        reach[edge] = r / np.repeat(summed, n)
    running = np.cumsum(reach)
    firsts = first_edge[many > 0]
    spread = many[many > 0]
    cumulated = running - np.repeat(running[firsts] - reach[firsts], spread)
    cumulated[firsts + spread - 1] = np.inf  # the last edge takes what rounding leaves
    return start, first_edge, kind, head, cumulated


def cut(texts: list[str], seeds: np.ndarray, v: Vocabulary, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ends): text k's pieces end at ends[k]. seeds: a 64-bit number per text."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    codes = _code_points("".join(" " + t for t in texts)).copy()
    codes[codes == _SPACE] = _LITERAL
    codes[codes == 32] = _SPACE
    text_at = np.concatenate([[0], np.cumsum(lengths)])
    spelt = ~v.single[codes]
    space = codes == _SPACE
    opens = spelt.copy()
    opens[1:] |= spelt[:-1] | (space[1:] & ~space[:-1])
    opens[text_at[:-1]] = True
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], len(codes))
    words = ~spelt[begin]
    w_begin, w_end = begin[words], end[words]
    count = np.zeros(len(codes), np.int64)
    count[spelt] = np.select([codes[spelt] < 0x80, codes[spelt] < 0x800, (codes[spelt] < 0x10000) | (codes[spelt] == _LITERAL)], [1, 2, 3], 4)
    drawn_at, drawn = [], []
    if len(w_begin):
        sums = _span_hashes(codes)
        _, down = powers(len(codes) + 1)
        keys = mixed((sums[w_end] - sums[w_begin]) * down[w_begin] + (w_end - w_begin).astype(np.uint64))
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        start, first_edge, kind, head, cumulated = _lattice(codes, w_begin[one], w_end[one], v, alpha)
        owner = np.searchsorted(text_at, w_begin, side="right") - 1
        key = mixed(seeds[owner] + (w_begin - text_at[owner]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        base, place = start[:-1][which], start[1:][which]
        shift = w_begin - base
        while len(place):
            draw = (mixed(key + (place - base).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = first_edge[place]
            late = np.flatnonzero(cumulated[edge] <= draw)
            while len(late):
                edge[late] += 1
                late = late[cumulated[edge[late]] <= draw[late]]
            place = head[edge]
            drawn_at.append(place + shift)
            drawn.append(kind[edge])
            going = place > base
            key, base, place, shift = key[going], base[going], place[going], shift[going]
        at = np.concatenate(drawn_at)
        count[at] = 1
    offset = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(offset[-1], np.int32)
    if len(w_begin):
        out[offset[at]] = np.concatenate(drawn)
    where = np.flatnonzero(spelt)
    c, n = codes[where].astype(np.int64), count[where]
    c[c == _LITERAL] = _SPACE
    for k in range(4):
        mine = n > k
        lead = np.select([n == 1, n == 2, n == 3], [c, 0xC0 | c >> 6, 0xE0 | c >> 12], 0xF0 | c >> 18)
        byte = lead if k == 0 else 0x80 | (c >> (6 * np.maximum(n - 1 - k, 0)) & 0x3F)
        out[offset[where[mine]] + k] = byte[mine] + v.first_byte
    return out, offset[text_at[1:]]


def decoded(ids: np.ndarray, v: Vocabulary) -> str:
    return b"".join([v.pieces[k] for k in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


def _row_seeds(keys: list, seed: int) -> np.ndarray:
    return np.fromiter((int.from_bytes(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest(), "little") for k in keys), np.uint64, len(keys))


def _cut_batches(batches, column: str, key: str, v: Vocabulary, seed: int, alpha: float):
    """(batch, begin, end, texts, ids, ends) for slices of batches."""
    for batch in batches:
        texts = batch.column(column)
        for a, b in slices(texts, SLICE):
            own = [t or "" for t in texts[a:b].to_pylist()]
            ids, ends = cut(own, _row_seeds(batch.column(key)[a:b].to_pylist(), seed), v, alpha)
            yield batch, a, b, own, ids, ends


def encode(docs: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = (), model: str = MODEL, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """key, the columns in keep, n_pieces and pieces (array<int>) of every row's whole text.

    A null text is encoded as an empty one, which is the piece of the leading space alone. Equal
    texts under equal keys are cut alike, so a repeated row repeats its pieces; under other keys
    they are drawn anew. Other columns are ignored.
    """
    v = docs.sparkSession.sparkContext.broadcast(vocabulary(model))
    source = docs.select(F.struct(key, *keep).alias("own"), F.col(key).alias("key"), F.col("text").alias("text"))

    def run(batches):
        for batch, a, b, _, ids, ends in _cut_batches(batches, "text", "key", v.value, seed, alpha):
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("own")[a:b], pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(offsets, ids)], names=["own", "n_pieces", "pieces"])

    return source.mapInArrow(run, f"own {source.schema['own'].dataType.simpleString()}, n_pieces bigint, pieces array<int>").select("own.*", "n_pieces", "pieces")


def decode(encoded: DataFrame, key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """key and text of rows with pieces, as they were before encode()."""
    v = encoded.sparkSession.sparkContext.broadcast(vocabulary(model))
    source = encoded.select(F.struct(key).alias("own"), "pieces")

    def run(batches):
        for batch in batches:
            texts = [decoded(np.asarray(p or [], np.int32), v.value) for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(texts, pa.string())], names=["own", "text"])

    return source.mapInArrow(run, f"own {source.schema['own'].dataType.simpleString()}, text string").select("own.*", "text")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_pieces, pieces_sha256 (of the ids as 4 bytes, little endian),
    decoded_sha256 and lossless of every document, encoded and decoded again in one pass."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    v = spark.sparkContext.broadcast(vocabulary())
    names = ["doc_id", "n_chars", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"]

    def run(batches):
        for batch, a, b, texts, ids, ends in _cut_batches(batches, "text", "doc_id", v.value, SEED, ALPHA):
            parts = np.split(ids, ends[:-1])
            back = [decoded(p, v.value) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[a:b], pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in parts], pa.int64()),
                    pa.array([hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in parts]),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]), pa.array([x == y for x, y in zip(texts, back, strict=True)]),
                ],
                names=names,
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_chars bigint, n_pieces bigint, pieces_sha256 string, decoded_sha256 string, lossless boolean")
