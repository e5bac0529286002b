"""Pages that are a JSON text each, read a slice of texts at a time by Arrow.

Spark's from_json makes an object of each value of a page. Arrow reads many pages at once into arrays;
a page that it does not read, or in which something is missing, is left to from_json.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..operators.tokens import _sizes, _slices

#: Bytes of texts that are read at once, unless one is longer.
_BYTES = 8_000_000
#: What Arrow's reader takes in one block.
_LONGEST = 2**31 - 2


def _nested(table: pa.Table, outer: str, inner: str) -> tuple[np.ndarray, pa.Array] | None:
    """How many entries each row has, and all entries; None if a list of them is missing."""
    lists = table.column(outer).combine_chunks()
    parts = lists.flatten()
    held = pc.struct_field(parts, inner)
    if lists.null_count or parts.null_count or held.null_count:
        return None
    ends = np.concatenate([[0], np.cumsum(_sizes(held))])
    at = np.concatenate([[0], np.cumsum(_sizes(lists))])
    return np.diff(ends[at]), held.flatten()


def _plain(texts: pa.Array) -> bool:
    """Whether all texts are objects to look at. A null outside of any object, which may follow one,
    ends Arrow's reader together with its process."""
    if texts.null_count or not pc.all(pc.match_substring_regex(texts, r"^\s*\{")).as_py():
        return False
    return not pc.any(pc.match_substring(texts, "null")).as_py() or not pc.any(pc.match_substring_regex(texts, r"\}\s*null")).as_py()


def _read(texts: pa.Array, begin: int, schema: pa.Schema, outer: str, inner: str) -> Iterator[tuple[int, tuple | None]]:
    """(place of the first text, _nested) of runs of texts, or None for a single text that is not read."""
    found, n = None, len(texts)
    if _plain(texts) and int(pc.sum(pc.binary_length(texts)).as_py()) + n < _LONGEST:
        whole = pc.binary_join(pa.ListArray.from_arrays([0, n], texts), "\n")[0].as_buffer()
        try:
            table = pj.read_json(
                pa.BufferReader(whole),
                pj.ReadOptions(use_threads=False, block_size=whole.size + 1),
                pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore"),
            )
            found = _nested(table, outer, inner) if table.num_rows == n else None
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            pass
    if found is not None or n == 1:
        yield begin, found
    else:
        # One odd text is looked for by halves.
        yield from _read(texts[: n // 2], begin, schema, outer, inner)
        yield from _read(texts[n // 2 :], begin + n // 2, schema, outer, inner)


def entries_of_pages(
    files: DataFrame, kind: str, made: Callable[[pa.StructArray], tuple[np.ndarray, list[pa.Array]]], columns: str, plain: Column
) -> DataFrame:
    """doc_id, pos and columns of the entries of pages (stem, value: JSON). kind: outer array<struct<inner:
    array<entry>>>, as DDL. made gives which entries stay and, of those, the columns. plain: the same
    of a single page by from_json, an array of structs of the column _raw."""
    outer_type = DataType.fromDDL(kind)
    outer, inner = outer_type.names[0], outer_type[0].dataType.elementType.names[0]
    schema = pa.schema([pa.field(outer, to_arrow_type(outer_type[0].dataType))])
    names = DataType.fromDDL(columns).names
    types = [to_arrow_type(f.dataType) for f in DataType.fromDDL(columns)]

    def laid(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, ids = part.column("value"), part.column("stem")
        for begin, found in _read(texts, 0, schema, outer, inner):
            if found is None:
                held = [ids[begin : begin + 1], texts[begin : begin + 1], pa.nulls(1, pa.int64()), *(pa.nulls(1, t) for t in types)]
            else:
                sizes, entries = found
                kept, made_of = made(entries)
                owner = np.repeat(np.arange(len(sizes)), sizes)[kept]
                # Entries are numbered within their page.
                count = np.bincount(owner, minlength=len(sizes))
                pos = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
                held = [ids.take(pa.array(owner + begin)), pa.nulls(len(owner), pa.string()), pa.array(pos), *made_of]
            yield pa.RecordBatch.from_arrays(held, names=["doc_id", "_raw", "pos", *names])

    def run(batches):
        for batch in batches:
            for part in _slices(batch, pc.fill_null(pc.binary_length(batch.column("value")), 0).to_numpy(zero_copy_only=False).astype(np.int64), _BYTES):
                yield from laid(part)

    stem = files.schema["stem"].dataType.simpleString()
    read = files.select("stem", "value").mapInArrow(run, f"doc_id {stem}, _raw string, pos bigint, {columns}")
    # An outer generator: for an inner one Spark would parse a page a second time, to filter by.
    rows = read.select("*", F.posexplode_outer(F.when(F.col("_raw").isNotNull(), plain)).alias("_pos", "_w"))
    odd = F.col("_raw").isNotNull()
    both = [F.when(odd, F.col("_pos").cast("long")).otherwise(F.col("pos")).alias("pos"), *(F.when(odd, F.col(f"_w.{c}")).otherwise(F.col(c)).alias(c) for c in names)]
    return rows.filter("pos IS NOT NULL OR _pos IS NOT NULL").select("doc_id", *both)
