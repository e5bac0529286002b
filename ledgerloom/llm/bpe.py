"""Byte-level BPE by prefix dynamic programming.

Of all tokens that end a byte prefix, exactly one is the last token of the prefix's encoding: the one
that follows validly on the encoding of what is before it. So a piece is encoded from left to right
by keeping that one token for every prefix. Text can be appended without looking back further than
the longest token, and after an edit only the prefixes near it are worked out again, until they
agree with the old ones over the length of the longest token.

Two tokens may follow each other if merging their bytes gives these two again, so that no merge goes
across the place where they meet. Tokens that merging their own bytes does not give stand in no
encoding, but for a piece that is itself such a token, which is taken whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .flat import slices

#: The public rank file; any rank file that has all single bytes will do.
RANKS = "byte_bpe_50k.tiktoken"
#: Distinct pieces, and pairs of tokens, that a worker keeps.
HELD_PIECES, HELD_PAIRS = 400_000, 500_000
#: Bytes of text that are encoded at once, and characters of a long text that are split at once.
SLICE, PART = 2_000_000, 1_000_000
_SPLIT = regex.compile(public_tokenizers.PATTERN)
#: The same for ASCII texts, which the standard library splits in half the time.
_ASCII = re.compile(
    public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"),
    re.ASCII,
)
_BREAK = regex.compile(r"(?<=\S)(?=\s)")


class Vocabulary:
    """tokens: the bytes of each id; ranks: the id of bytes; longest: the most bytes of a token.

    ending: an Aho-Corasick automaton of the tokens that merging gives, as (id, length), for the
    tokens that end at each place. edges: for each token the nodes of its merge tree at its (left,
    right) edge from the byte upwards, each with the rank of the merge that takes it up.
    """

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        self.edges = {k: e for t, k in self.ranks.items() if (e := self._merge_edges(t))}
        self._prepare()

    def _prepare(self) -> None:
        self.pairs: dict[int, bool] = {}
        self.ending = ahocorasick.Automaton()
        for k in self.edges:
            self.ending.add_word(self.tokens[k].decode("latin-1"), (k, len(self.tokens[k])))
        self.ending.make_automaton()

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if k not in ("ending", "pairs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    def merges(self, data: bytes) -> Iterator[list[bytes]]:
        """The parts of bytes after each merge: of all neighbours the pair with the lowest rank,
        leftmost first, until none has one. The time is quadratic; for tokens and pairs of them."""
        parts, none = [data[k : k + 1] for k in range(len(data))], len(self.tokens)
        yield parts
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], none))
            if parts[at] + parts[at + 1] not in self.ranks:
                return
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
            yield parts

    def _merge_edges(self, token: bytes):
        left, right, parts = [], [], []
        for parts in self.merges(token):
            for edge, node in ((left, parts[0]), (right, parts[-1])):
                if not edge or edge[-1] != node:
                    edge.append(node)
        taken_up = [(*(self.ranks[x] for x in edge[1:]), len(self.tokens)) for edge in (left, right)]
        return tuple(tuple(zip(e, up, strict=True)) for e, up in zip((left, right), taken_up, strict=True)) if len(parts) == 1 else None

    def follows(self, left: int, right: int) -> bool:
        """Whether an encoding can have `right` after `left`: going up the two edges that meet, in
        the order of their merges, no two nodes have a merge that comes before both next ones."""
        key = left * len(self.tokens) + right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= HELD_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = not self._crossed(self.edges[left][1], self.edges[right][0])
        return found

    def _crossed(self, left, right) -> bool:
        i = j = 0
        while i < len(left) and j < len(right):
            (x, x_up), (y, y_up) = left[i], right[j]
            across = self.ranks.get(x + y)
            if across is not None and across < x_up and across <= y_up:  # of equal ranks the left comes first
                return True
            i, j = (i + 1, j) if x_up <= y_up else (i, j + 1)
        return False


class Prefixes:
    """Bytes of one piece with the last token of each of their prefixes: last[k] is that of the
    first k bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _extend(self, end: int, old: tuple[int, ...] = (), settled: int = 0) -> None:
        """The last tokens of prefixes longer than `end` bytes; shorter ones are known.

        old: what they were before an edit, from place `settled` on; stops where both agree over the
        length of the longest token and takes the rest from there.
        """
        v, last, n, alike = self.vocabulary, self.last, end + 1, 0
        pairs, size, begin = v.pairs, len(v.tokens), max(0, n - v.longest)
        for at, (token, length) in v.ending.iter(self.data[begin:].decode("latin-1")):
            if at + begin + 1 != n:
                continue  # this prefix has its token, or is a known one
            if length < n:
                if length > n - begin:
                    continue
                ok = pairs.get(last[n - length] * size + token)
                if not (v.follows(last[n - length], token) if ok is None else ok):
                    continue
            last.append(token)
            if old and n > settled:
                alike = alike + 1 if token == old[n - settled] else 0
                if alike == v.longest:
                    last.extend(old[n - settled + 1 :])
                    return
            n += 1
        if n <= len(self.data):
            raise ValueError("the vocabulary has no token for a byte")

    def append(self, more: bytes) -> None:
        """Add bytes at the end; what is known stays."""
        begin = len(self.data)
        self.data += more
        if more:
            self._extend(begin)

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Put `new` in place of bytes begin to end."""
        old = tuple(self.last[end:])
        self.data = self.data[:begin] + new + self.data[end:]
        del self.last[begin + 1 :]
        if begin < len(self.data):
            self._extend(begin, old, begin + len(new))

    def ids(self) -> list[int]:
        """The encoding of all bytes."""
        whole = self.vocabulary.ranks.get(self.data)
        if whole is not None:
            return [whole]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


def split(text: str) -> Iterator[list[str]]:
    """The pieces of a text in lists, of one part of it each. Parts end before white space that
    follows on other characters: no piece goes across such a place, nor looks beyond it."""
    begin, find = 0, (_ASCII if text.isascii() else _SPLIT).findall
    while begin < len(text):
        cut = _BREAK.search(text, begin + PART)
        end = cut.start() if cut else len(text)
        yield find(text, begin, end)
        begin = end


class _Pieces(dict):
    """The ids of pieces as bytes, four for each, little endian."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else Prefixes(self.vocabulary, data).ids()
        packed = self[piece] = np.array(ids, "<u4").tobytes()
        return packed


class Encoder:
    """Encodes texts; a piece that was seen before is looked up."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self._pieces = vocabulary, _Pieces(vocabulary)

    def packed(self, text: str) -> bytes:
        """The ids as unsigned 32-bit numbers, little endian."""
        if len(self._pieces) > HELD_PIECES:
            self._pieces.clear()
        return b"".join([b"".join(map(self._pieces.__getitem__, pieces)) for pieces in split(text)])

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decoded(self, ids: np.ndarray) -> bytes:
        tokens = self.vocabulary.tokens
        return b"".join([tokens[k] for k in ids.tolist()])


class Draft:
    """A text that is edited while its encoding is kept: each piece has its prefixes, and an edit
    splits the text anew from the white space before it to that behind it only."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self._begins: list[int] = []
        self._pieces: list[Prefixes] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, new: str) -> int:
        """Put `new` in place of characters begin to end; the number of pieces that were split anew."""
        shift = len(new) - (end - begin)
        text = self.text[:begin] + new + self.text[end:]
        first = begin - 1
        while first > 0 and not _BREAK.match(self.text, first):
            first -= 1
        first = max(first, 0)
        found = _BREAK.search(text, begin + len(new) + 1)
        stop = found.start() if found else len(text)
        a = bisect_left(self._begins, first)
        b = bisect_left(self._begins, stop - shift) if found else len(self._begins)
        old = self._pieces[a:b]
        begins, pieces, at = [], [], first
        for piece in _SPLIT.findall(text, first, stop):
            data = piece.encode("utf-8", "surrogatepass")
            begins.append(at)
            pieces.append(self._grown(old, data))
            at += len(piece)
        self._begins[a:] = begins + [k + shift for k in self._begins[b:]]
        self._pieces[a:b] = pieces
        self.text = text
        return len(pieces)

    def _grown(self, old: list[Prefixes], data: bytes) -> Prefixes:
        """The prefixes of a piece, from the next old piece if they have their beginning in common."""
        if not old or not data.startswith(old[0].data[:1]):
            return Prefixes(self.vocabulary, data)
        piece = old.pop(0)
        same = next((k for k, (x, y) in enumerate(zip(piece.data, data)) if x != y), min(len(piece.data), len(data)))
        rest = min(len(piece.data), len(data)) - same
        tail = next((k for k in range(rest) if piece.data[-1 - k] != data[-1 - k]), rest)
        piece.replace(same, len(piece.data) - tail, data[same : len(data) - tail])
        return piece

    def ids(self) -> list[int]:
        return [k for piece in self._pieces for k in piece.ids()]

    def piece_at(self, at: int) -> int:
        """The number of the piece that holds a character."""
        return bisect_right(self._begins, at) - 1


def _encoded(batches, encoder: Encoder):
    """(batch, begin, end, packed ids of each row) for slices of batches."""
    for batch in batches:
        texts = batch.column("text")
        for a, b in slices(texts, SLICE):
            yield batch, a, b, [encoder.packed(t or "") for t in texts[a:b].to_pylist()]


def _vocabulary(df: DataFrame, path: str | None):
    return df.sparkSession.sparkContext.broadcast(Vocabulary(path or public_tokenizers.path(RANKS)))


def encode(docs: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """key, the columns in keep, and ids (array<int>) of every row's whole text.

    A null or empty text has no ids. Rows may repeat, keys may be null; other columns are ignored.
    Strings of special tokens are ordinary text. The vocabulary file is broadcast, nothing else.
    """
    v = _vocabulary(docs, path)
    source = docs.select(F.struct(key, *keep).alias("own"), F.col("text").alias("text"))

    def run(batches):
        for batch, a, b, packed in _encoded(batches, Encoder(v.value)):
            offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("own")[a:b], pa.ListArray.from_arrays(offsets, ids)], names=["own", "ids"])

    return source.mapInArrow(run, f"own {source.schema['own'].dataType.simpleString()}, ids array<int>").select("own.*", "ids")


def decode(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """key and the bytes (binary `data`) of rows with ids; null ids give no bytes."""
    v = _vocabulary(encoded, path)
    source = encoded.select(F.struct(key).alias("own"), "ids")

    def run(batches):
        encoder = Encoder(v.value)
        for batch in batches:
            data = [encoder.decoded(np.asarray(k or [], np.int64)) for k in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(data, pa.binary())], names=["own", "data"])

    return source.mapInArrow(run, f"own {source.schema['own'].dataType.simpleString()}, data binary").select("own.*", "data")


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as 4 bytes, little endian) and decoded_sha256 of every
    document, encoded and decoded again in one pass."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    v = _vocabulary(docs, None)

    def run(batches):
        encoder = Encoder(v.value)
        for batch, a, b, packed in _encoded(batches, encoder):
            back = [encoder.decoded(np.frombuffer(p, "<u4")) for p in packed]
            digests = [[hashlib.sha256(x).hexdigest() for x in texts] for texts in (packed, back)]
            columns = [batch.column("doc_id")[a:b], pa.array([len(p) // 4 for p in packed], pa.int64()), *map(pa.array, digests)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
