"""K-d tree sharding: split recursively at weighted medians along the widest metadata dimension.

The tree is small (one node per shard) and lives on the driver; rows stay where they are. All nodes
of a level are split together: one pass finds each node's widest dimension, and a few passes of
histograms close in on its weighted median. The passes read a stored table of numbers, not texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Bytes that a record takes besides its text.
OVERHEAD = 16
BINS = 2048
#: A median may be off by this share of a leaf's weight; beyond that it is exact to one row.
TOLERANCE = 1e-3
#: Whole numbers below it are all doubles.
EXACT = 2**53
#: Rows of equal texts stay together up to this share of a shard's bytes.
KEPT_TOGETHER = 0.1


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def metadata() -> dict[str, Column]:
    """The dimensions of a document, in the order that breaks ties of width. Texts among them are
    taken by their rank among all distinct values, whole numbers by their distance from the smallest
    one, or by rank if that is more than a double holds."""
    return {
        "source": F.col("source"),
        "lang": F.col("lang"),
        "length": F.log2(byte_size(F.col("text")).cast("double")),
        "id": F.col("doc_id"),
    }


class _Node:
    """leaves: shards below it, the first being `first`. A split node sends a row left if its
    (value, tie) along dim is at most (value, tie) here."""

    def __init__(self, first: int, leaves: int):
        self.first, self.leaves, self.split = first, leaves, None

    def place(self, values: dict[str, Column], tie: Column) -> Column:
        if self.split is None:
            return F.lit(self.first)
        dim, value, at, left, right = self.split
        goes = values[dim] <= value if at is None else (values[dim] < value) | ((values[dim] == value) & (tie <= at))
        return F.when(goes, left.place(values, tie)).otherwise(right.place(values, tie))

    def open(self) -> list[_Node]:
        if self.split:
            return self.split[3].open() + self.split[4].open()
        return [self] if self.leaves > 1 else []


def _histograms(rows: DataFrame, dims: list[str], searches: list[dict]) -> dict[int, list]:
    """For each search, (lowest, highest, weight) of its bins' keys, in order."""
    of = {s["node"].first: s for s in searches}

    def looked_up(what, kind: str) -> Column:
        per_node = [F.lit(what(of[n]) if n in of else None).cast(kind) for n in range(max(of) + 1)]
        return F.try_element_at(F.array(*per_node), F.col("_node") + 1)

    along = F.element_at(F.array(*dims), looked_up(lambda s: dims.index(s["dim"]) + 1, "int"))
    aims = rows.select("_node", "_size", "_tie", along.alias("_along"), *(looked_up(lambda s, k=k: s[k], "double").alias(f"_{k}") for k in ("value", "low", "high")))
    keyed = aims.withColumn("_key", F.when(F.col("_value").isNull(), F.col("_along")).when(F.col("_along") == F.col("_value"), F.col("_tie").cast("double")))
    part = F.floor((F.col("_key") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS)
    at = F.when(F.col("_low") == F.col("_high"), 0).otherwise(F.least(F.lit(BINS - 1), part))
    binned = keyed.withColumn("_bin", F.when(F.col("_key").between(F.col("_low"), F.col("_high")), at.cast("int")))
    found: dict[int, list] = {}
    for r in binned.groupBy("_node", "_bin").agg(F.min("_key"), F.max("_key"), F.sum("_size")).collect():
        if r["_bin"] is not None:
            found.setdefault(r[0], []).append(tuple(r)[1:])
    return {k: [x[1:] for x in sorted(v)] for k, v in found.items()}


def _medians(rows: DataFrame, dims: list[str], searches: list[dict]) -> None:
    """Give each search its split: the value, and the tie if a value's rows have to be parted."""
    while searches:
        bins, going = _histograms(rows, dims, searches), []
        for s in searches:
            below = s["below"]
            for k, (low, high, weight) in enumerate(bins[s["node"].first]):
                if below + weight >= s["goal"] or k == len(bins[s["node"].first]) - 1:
                    break
                below, s["before"] = below + weight, high
            if low < high and weight > s["slack"]:
                going.append(s | {"low": low, "high": high, "below": below})
            elif low == high and s["value"] is None and weight > s["slack"] and s["ties"][0] < s["ties"][1]:
                going.append(s | {"value": low, "outer": s["before"], "below": below, "before": None, "low": float(s["ties"][0]), "high": float(s["ties"][1])})
            else:  # the nearer end of the last bin
                after = s["goal"] - below > below + weight - s["goal"]
                end = high if after or s["before"] is None and (s["value"] is None or s["outer"] is None) else s["before"]
                if s["value"] is None:
                    s["found"].append((end, None))
                elif end is None:
                    s["found"].append((s["outer"], None))
                else:
                    s["found"].append((s["value"], int(end)))
        searches = going


def kd_tree(rows: DataFrame, dims: list[str], shards: int) -> _Node:
    """rows: dims (double), _tie (long), _size (long). The root of a tree with so many leaves."""
    root, columns = _Node(0, shards), {d: F.col(d) for d in dims}
    spread: dict[str, float] = {}
    while nodes := root.open():
        placed = rows.withColumn("_node", root.place(columns, F.col("_tie")))
        edges = [f(x).alias(f"{f.__name__}_{x}") for x in [*dims, "_tie"] for f in (F.min, F.max)]
        stats = {r["_node"]: r for r in placed.groupBy("_node").agg(F.sum("_size").alias("weight"), *edges).collect()}
        wide = {n: {d: r[f"max_{d}"] - r[f"min_{d}"] for d in dims} for n, r in stats.items()}
        spread = spread or wide.get(0, {})
        searches = []
        for node in nodes:
            if (r := stats.get(node.first)) is None:
                node.leaves = 1  # no rows: nothing to split
                continue
            dim = max(dims, key=lambda d: wide[node.first][d] / spread[d] if spread[d] else 0)
            searches.append({"node": node, "dim": dim, "value": None, "before": None, "outer": None, "low": r[f"min_{dim}"], "high": r[f"max_{dim}"], "ties": (r["min__tie"], r["max__tie"]), "below": 0, "goal": r["weight"] * (node.leaves // 2) / node.leaves, "slack": TOLERANCE * r["weight"] / node.leaves, "found": []})
        _medians(placed, dims, searches)
        for s in searches:
            node, half = s["node"], s["node"].leaves // 2
            node.split = (s["dim"], *s["found"][0], _Node(node.first, half), _Node(node.first + half, node.leaves - half))
    return root


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= common.BROADCAST_ROWS else table


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """rows with a column replaced by its rank among all its values; null is below everything. Texts
    go in code point order."""
    values = common.global_rank(rows.select(F.col(name).alias("_value")).filter("_value IS NOT NULL").distinct(), [F.col("_value")], "_rank")
    joined = rows.join(_few(common.stored(values)), F.col(name) == F.col("_value"), "left")
    return joined.withColumn(name, F.coalesce(F.col("_rank").cast("double"), F.lit(-1.0))).drop("_value", "_rank")


def _exact(rows: DataFrame, name: str, least: int | None, most: int | None) -> DataFrame:
    """rows with a column of whole numbers from least to most replaced by doubles that keep each apart
    from the others, in their order; null is below everything."""
    if least is not None and most - least >= EXACT:
        return _ranked(rows, name)
    place = (F.col(name) - F.lit(least or 0).cast("long")).cast("double")
    return rows.withColumn(name, F.coalesce(place, F.lit(-1.0)))


def _together(numbers: DataFrame, places: list[str], most: float) -> DataFrame:
    """numbers with the place of the smallest key of their text, for rows of equal texts that have at
    most so many bytes together. A text with more rows than that keeps each row's own place: there
    are less of them than bytes in all over `most`, so they are set apart by a broadcast."""
    same = ["_hash", "_size"]
    place = F.min(F.struct("_tie", *(p for p in places if p != "_tie")))
    groups = common.stored(numbers.groupBy(*same).agg(F.count("*").alias("_n"), place.alias("_place")).filter("_n > 1"))
    large = F.broadcast(groups.filter(F.col("_n") * F.col("_size") > most).select(*same))
    small = _few(groups.filter(F.col("_n") * F.col("_size") <= most).select(*same, "_place"))
    moved = numbers.join(large, same, "left_anti").join(small, same, "left")
    moved = moved.withColumns({p: F.coalesce(f"_place.{p}", p) for p in places}).drop("_place")
    return moved.unionByName(numbers.join(large, same, "left_semi"))


def _placed(docs: DataFrame, key: str, dimensions: dict[str, Column], shards: int | None, target_bytes: int | None, *more: Column) -> DataFrame:
    """key, _size, _hash (of the text), shard and more columns of every row."""
    names = {k: f"_d_{k}" for k in dimensions}
    text = F.coalesce("text", F.lit(""))
    values = [v.alias(names[k]) for k, v in dimensions.items()]
    rows = docs.select(F.col(key), byte_size(F.col("text")).alias("_size"), F.col(key).cast("long").alias("_tie"), F.xxhash64(text).alias("_hash"), *values, *more)
    whole = ["_tie"]
    for name in names.values():
        kind = rows.schema[name].dataType.simpleString()
        if kind == "string":
            rows = _ranked(rows, name)
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            rows = rows.withColumn(name, F.col(name).cast("long"))
            whole.append(name)
        else:
            rows = rows.withColumn(name, F.col(name).cast("double"))
    numbers = common.stored(rows)
    found = numbers.agg(F.sum("_size"), *(f(name) for name in whole for f in (F.min, F.max))).first()
    total = found[0] or 0
    for k, name in enumerate(whole):
        numbers = _exact(numbers, name, found[2 * k + 1], found[2 * k + 2])
    numbers = numbers.withColumn("_tie", F.col("_tie").cast("long"))
    shards = shards or max(1, math.ceil(total / target_bytes))
    numbers = common.stored(_together(numbers, ["_tie", *names.values()], KEPT_TOGETHER * total / shards))
    root = kd_tree(numbers, list(names.values()), shards)
    place = root.place({n: F.col(n) for n in names.values()}, F.col("_tie"))
    return numbers.withColumn("shard", place).drop("_tie", *names.values())


def assign_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", dimensions: dict[str, Column] | None = None) -> DataFrame:
    """docs with a column shard (replaced if there is one): a leaf of the tree for every row.

    Give the number of shards, or the bytes a leaf should reach. Sizes of shards differ by a few
    rows' sizes at most. Equal texts stay together while they have no more than KEPT_TOGETHER of a
    shard's bytes; larger groups, and other rows of one place in all dimensions, are parted by key.
    Rows that repeat a key and text stay together; null keys are one place. Keys may be any 64-bit
    numbers, hashes among them: those further apart than 2^53 go by rank. Null texts have no bytes and
    are equal to empty ones. An empty table gives an empty result.
    """
    docs = docs.drop("shard")
    own = _placed(docs, key, dimensions or metadata(), shards, target_bytes).select(F.col(key).alias("_key"), "_hash", "shard").distinct()
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.withColumn("_text", text).join(own, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_text") == F.col("_hash")))
    return joined.select(*docs.columns, "shard")


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """A Parquet folder per shard."""
    placed = assign_shards(docs, **how)
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


def with_slots(placed: DataFrame, key: str, rows_per_bucket: int = 100_000) -> DataFrame:
    """placed (key, shard, _size, _hash, ...) with slot (replaced if there is one): 0, 1, ... in each
    shard.

    A shard's rows are numbered in buckets of their key's hash, by key, size and text, null keys
    first; rows that are equal in all of these are alike.
    """
    placed = placed.drop("slot")
    shards, rows = placed.agg(F.countDistinct("shard"), F.count("*")).first()
    buckets = max(16, math.ceil(rows / max(1, shards) / rows_per_bucket))
    dealt = placed.withColumn("_bucket", F.pmod(F.xxhash64(key, "_hash"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "_bucket").count()
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(key, "_size", "_hash")) - 1
    numbered = dealt.withColumn("_place", place).join(offsets, ["shard", "_bucket"])
    return numbered.withColumn("slot", (F.col("_before") + F.col("_place")).cast("long")).drop("_bucket", "_before", "_place")


def op2_kd_shards(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    slots = with_slots(_placed(docs, "doc_id", metadata(), 40, None, crc), "doc_id")
    return slots.select(
        "doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
