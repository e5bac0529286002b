"""Source divergence audit: how far the word use of a language's sources lies apart.

Terms are counted once. A block of terms becomes one-hot indicator columns, one for each (source,
count level) that occurs in it; the product of that matrix and its transpose holds, for every pair
of sources at once, the joint table of their levels: how many terms have count a in one and b in
the other. A term's price depends on its source and level alone, so a joint table and the prices of
its levels give the sum of the differences over all its terms. All numbers are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .flat import Flat, mixed, slices

#: A term is kept in a language with so many documents that hold it.
LEAST_DOCS = 30
#: Ranks of the terms that a source uses more than its language.
TOP = 50
UNIT = 1_000_000_000
PRIOR = 5
#: Terms of a block at least; blocks of languages with many sources are larger, as a block gives out
#: one figure for each pair of sources.
BLOCK = 2048
#: Rows and columns of the indicator matrices that are multiplied at once.
ROWS, COLUMNS = 256, 2048
#: Rows of counts that a task holds before it merges and gives them out.
HELD = 1_000_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(0x80, 256)]] = True
_COUNTED = ["lang", "source", "term", "n", "docs"]


class _Counts:
    """Counts of a task by (language and term, group). Terms go by 64-bit hashes inside a task: of a
    million terms two are taken for one with a probability of 3e-8."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.langs: dict[str, int] = {}
        self.clear()

    def clear(self):
        self.rows, self.parts, self.names = 0, [], []

    def add(self, texts: pa.Array, langs: list[str], sources: list[str]):
        """Count the terms of whole texts; rows of one group are brought together first."""
        of = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)])
        order = np.argsort(of, kind="stable")
        flat, of = Flat(texts.take(pa.array(order)), lower=True), of[order]
        lang = np.array([self.langs.setdefault(langs[k], len(self.langs)) for k in order], np.uint64)
        begin, end, doc = flat.runs(~_LETTER[flat.data])
        if not len(begin):
            return
        key = mixed(flat.hashes(begin, end) + lang[doc])
        by_key = np.argsort(key, kind="stable")  # and so by group and document
        key, doc, group = key[by_key], doc[by_key], of[doc[by_key]]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new_doc = new.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(key)))
        self.parts.append((key[first], group[first], n, np.add.reduceat(new_doc, first, dtype=np.int64)))
        names = first[np.append(True, key[first[1:]] != key[first[:-1]])]
        self.names.append((key[names], _spans(flat.data, begin[by_key[names]], end[by_key[names]])))
        self.rows += len(first)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Merged rows (lang, source, term, n, docs); nothing is held afterwards."""
        if not self.rows:
            return
        key, group, n, docs = map(np.concatenate, zip(*self.parts, strict=True))
        order = np.lexsort((group, key))
        key, group = key[order], group[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        n, docs = (np.add.reduceat(x[order], first) for x in (n, docs))
        known, at = np.unique(np.concatenate([k for k, _ in self.names]), return_index=True)
        terms = pa.chunked_array([t for _, t in self.names]).take(pa.array(at)).combine_chunks()
        place, group = np.searchsorted(known, key[first]), group[first]
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        self.clear()
        for k in range(0, len(first), 50_000):
            part = slice(k, k + 50_000)
            own = pa.array(group[part])
            columns = [langs.take(own), sources.take(own), terms.take(pa.array(place[part])), pa.array(n[part]), pa.array(docs[part])]
            yield pa.RecordBatch.from_arrays(columns, names=_COUNTED)


def _spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of bytes as texts."""
    ends = np.cumsum(end - begin)
    at = np.arange(ends[-1]) + np.repeat(begin - np.append(0, ends[:-1]), end - begin)
    offsets = np.append(0, ends).astype(np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])
    return whole.cast(pa.string())


def _count(batches):
    counts = _Counts()
    for batch in batches:
        texts, langs, sources = batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for a, b in slices(texts):
            counts.add(texts[a:b], langs[a:b], sources[a:b])
            if counts.rows > HELD:
                yield from counts.batches()
    yield from counts.batches()


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, counts): counts is an array of (source, n) with one entry for each source of the
    language that has the term. Tasks count before the one shuffle."""
    counted = _named(docs).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    by_source = (
        counted.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    return (
        by_source.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
        .filter(F.col("docs") >= least_docs)
        .select("lang", "term", "counts")
    )


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total, blocks) of every group that occurs."""
    group, counts = ["lang", "source"], kept.select("lang", F.explode("counts").alias("c"))
    totals = counts.groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    found = _named(docs).select(*group).distinct().join(totals, group, "left")
    langs = (
        found.groupBy("lang")
        .agg(F.sum("total").alias("lang_total"), F.count("*").alias("_sources"))
        .join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left")
    )
    blocks = F.ceil(F.col("terms") / F.greatest(F.lit(BLOCK), 4 * F.col("_sources"))).cast("int")
    nothing = dict.fromkeys(("total", "terms", "lang_total", "blocks"), 0)
    return found.join(langs.withColumn("blocks", blocks).drop("_sources"), "lang").fillna(nothing)


def _prices(levels: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), in integers of any length."""
    whole = total + PRIOR * terms
    return np.array([1 + UNIT * (int(c) + PRIOR) // whole for c in levels], np.int64)


class _Block:
    """Counts of a block's terms (rows, in UTF-8 order) in all sources of their language (columns)."""

    def __init__(self, rows: pa.Table, groups: pa.Table):
        groups = groups.sort_by("source")
        self.lang = groups["lang"][0].as_py()
        self.sources = groups["source"].combine_chunks()
        self.totals = groups["total"].to_pylist()
        self.n_terms, self.lang_total = groups["terms"][0].as_py(), groups["lang_total"][0].as_py()
        terms = rows["term"].combine_chunks().cast(pa.binary())
        order = pc.sort_indices(terms)
        self.terms = terms.take(order).cast(pa.string())
        lists = rows["counts"].combine_chunks().take(order)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
        column = np.asarray(pc.index_in(flat.field("source"), value_set=self.sources))
        self.counts = np.zeros((len(lists), len(self.sources)), np.int64)
        self.counts[row, column] = np.asarray(flat.field("n"))

    def products(self) -> Iterator[tuple]:
        """(left, right, joint) for slices of terms and of columns: joint[i, j] is the number of the
        slice's terms with the group and level of column left[i] and of column right[j]. left and
        right are (group, level, price, begin of each group); left groups come before right ones or
        are the same. Terms of like frequency share a slice, so that it has few levels."""
        order = np.argsort(self.counts.sum(axis=1), kind="stable")
        for k in range(0, len(order), ROWS):
            part = self.counts[order[k : k + ROWS]]
            panels, group = [], 0
            while group < part.shape[1]:
                hot, columns, levels, prices, begins, width = [], [], [], [], [], 0
                while group < part.shape[1] and width < COLUMNS:
                    found, place = np.unique(part[:, group], return_inverse=True)
                    begins.append(width)
                    hot.append(place + width)
                    columns.append(np.full(len(found), group))
                    levels.append(found)
                    prices.append(_prices(found, self.totals[group], self.n_terms))
                    width, group = width + len(found), group + 1
                one_hot = np.zeros((len(part), width), np.float32)  # exact: sums are at most ROWS
                one_hot[np.arange(len(part))[:, None], np.stack(hot, axis=1)] = 1
                panels.append((one_hot, (*map(np.concatenate, (columns, levels, prices)), np.array(begins))))
            for i, (x, left) in enumerate(panels):
                for y, right in panels[i:]:
                    yield left, right, (x.T @ y).astype(np.int64)

    def distances(self) -> np.ndarray:
        """Sums of the price differences of all terms, for every pair of sources."""
        out = np.zeros((len(self.sources), len(self.sources)), np.int64)
        for left, right, joint in self.products():
            cost = np.abs(left[2][:, None] - right[2]) * joint
            sums = np.add.reduceat(np.add.reduceat(cost, left[3], axis=0), right[3], axis=1)
            out[left[0][left[3]][:, None], right[0][right[3]]] += sums
        upper = np.triu(out, 1)
        return upper + upper.T

    def overused(self, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(source, terms, values): the terms whose price in the source is most above the language's."""
        levels, place = np.unique(self.counts.sum(axis=1), return_inverse=True)
        base = _prices(levels, self.lang_total, self.n_terms)[place]
        for g, total in enumerate(self.totals):
            levels, place = np.unique(self.counts[:, g], return_inverse=True)
            above = _prices(levels, total, self.n_terms)[place] - base
            found = np.flatnonzero((self.counts[:, g] > 0) & (above > 0))
            found = found[np.argsort(-above[found], kind="stable")[:top]]
            yield g, found, above[found]


def _tables(kept: DataFrame, groups: DataFrame, run, schema: str) -> DataFrame:
    """run(_Block) of blocks of a language's terms, dealt by a hash of the term."""
    total = kept.count()
    langs = groups.filter("blocks > 0").select("lang", "blocks", "terms").distinct()
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    rows = common.join_spread(kept, langs, ["lang"], "terms", total).select("lang", block, "term", "counts")
    places = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    figures = groups.filter("blocks > 0").select("lang", places, "source", "total", "terms", "lang_total")
    empty = pa.schema([(f.name, f.type) for f in _arrow(schema)]).empty_table()

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(_Block(left, right)) if len(left) else empty

    return rows.groupBy("lang", "block").cogroup(figures.groupBy("lang", "block")).applyInArrow(each, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


_ITEMS = "lang string, source string, part string, item string, value long"
_JOINT = "lang string, source string, level long, item string, item_level long, terms long"


def joint_tables(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, level, item, item_level, terms): how many kept terms a language's source uses
    `level` times and its source `item` (by UTF-8 after the first) `item_level` times; never 0."""
    kept = common.stored(kept_terms(docs, least_docs))

    def run(block: _Block) -> pa.Table:
        found = []
        for left, right, joint in block.products():
            i, j = np.nonzero(joint * (left[0][:, None] < right[0]))
            found.append(np.stack([left[0][i], left[1][i], right[0][j], right[1][j], joint[i, j]]))
        source, level, item, item_level, terms = np.concatenate(found, axis=1)
        lang = pa.array([block.lang] * len(terms), pa.string())
        source, item = (block.sources.take(pa.array(x)) for x in (source, item))
        return pa.table([lang, source, level, item, item_level, terms], schema=_arrow(_JOINT))

    parts = _tables(kept, _groups(docs, kept), run, _JOINT)
    return parts.groupBy("lang", "source", "level", "item", "item_level").agg(F.sum("terms").alias("terms"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs.

    docs has lang, source, text; other columns are ignored. Nulls are empty, a repeated row is
    another document. Part `pair` has each other source of the language; part `term` has the terms
    with the largest value, at most `top`. Ranks go by value, largest first, then by item. Groups
    and languages without kept terms have pairs of value 0; an empty table gives no rows. A
    language's sources are listed in every block of its terms, so their number, not that of
    documents or terms, has to fit in a task; pairs of sources are what is asked for.
    """
    kept = common.stored(kept_terms(docs, least_docs))
    groups = common.stored(_groups(docs, kept))

    def run(block: _Block) -> pa.Table:
        far, n = block.distances(), len(block.sources)
        i, j = np.nonzero(~np.eye(n, dtype=bool))
        parts = [(block.sources.take(pa.array(i)), "pair", block.sources.take(pa.array(j)), far[i, j])]
        for g, terms, values in block.overused(top):
            sources = pa.array([block.sources[g].as_py()] * len(terms), pa.string())
            parts.append((sources, "term", block.terms.take(pa.array(terms)), values))
        return pa.concat_tables(
            pa.table(
                [pa.array([block.lang] * len(v), pa.string()), s, pa.array([part] * len(v), pa.string()), item, v],
                schema=_arrow(_ITEMS),
            )
            for s, part, item, v in parts
        )

    bare = groups.filter("terms = 0").select("lang", "source")
    zero = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    zero = zero.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    items = _tables(kept, groups, run, _ITEMS).unionByName(zero)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return (
        items.groupBy("lang", "source", "part", "item")
        .agg(F.sum("value").alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .filter((F.col("part") == "pair") | (F.col("rank") <= top))
    )


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(common.table(spark, sf_dir, "documents").select("lang", "source", "text"))


_LETTERS = "".join(map(chr, range(65, 91)))
OP12_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[a-z\x{{80}}-\x{{10FFFF}}]+') AS terms
  FROM documents),
words AS (SELECT k, lang, source, unnest(terms) AS term FROM docs),
by_doc AS (SELECT k, lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term FROM by_doc GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
counts AS (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM by_doc JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(v.terms, 0) AS terms FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS terms FROM kept GROUP BY ALL) v USING (lang)),
langs AS (SELECT lang, sum(total) AS total FROM groups GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (CAST({UNIT} AS HUGEINT) * (coalesce(c.n, 0) + {PRIOR})) // CAST(g.total + {PRIOR} * g.terms AS HUGEINT) AS p,
    1 + (CAST({UNIT} AS HUGEINT) * (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) + {PRIOR}))
      // CAST(l.total + {PRIOR} * g.terms AS HUGEINT) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.terms = 0
  UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM items QUALIFY part = 'pair' OR rank <= {TOP}
"""
