"""WARC: write archives and their index, and read selected records by coalesced byte ranges.

Archives are WARC/1.1 files with a gzip member for each record, as is usual. A task writes whole
archives of its own, under names that no other attempt of it has, and gives out their index: offset,
length, URL and digest of every record, known as it writes them. Spark commits the index, so it names
complete archives only; what a lost attempt leaves behind is in no index. A reader sorts the records
it wants by file and offset, joins neighbouring ranges and reads each joined range at once.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = "\r\n\r\n"
LEVEL = 6
#: Payloads below this are always stored, never revisits.
LEAST_SHARED = 1000
#: A task begins another archive after so many bytes.
ARCHIVE = 256 << 20
#: Revisits are broadcast up to this many (page, digest and response, about 100 bytes each).
BROADCAST_REVISITS = 500_000
#: Ranges with a smaller gap between them are read together, up to so many bytes at once.
GAP, CHUNK = 64 << 10, 8 << 20

INDEX = (
    "file string, offset long, length long, record_id string, url string, record_type string, digest string, "
    "refers_to string"
)


def payload_digest(payload: Column) -> Column:
    return F.sha1(F.coalesce(payload, F.lit("")).cast("binary"))


def records(pages: DataFrame) -> DataFrame:
    """(record_id, url, record_type, digest, refers_to, record): WARC records of rows (page_id, url,
    html), without END.

    Of rows with equal payloads of LEAST_SHARED bytes or more, that with the largest page_id is a
    response and the others revisits of it, without a payload of their own. Rows that share the
    largest page_id are all responses, as are rows whose ids are all null; smaller payloads are
    always responses. Null html is an empty payload. A null url has no target header, and control
    characters in a url are percent-encoded. Revisits are found among digests, so a page that
    thousands copy burdens no task; pages are shuffled only if there are very many revisits.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    narrow = own.select("page_id", payload_digest(F.col("html")).alias("digest"), F.octet_length("html").alias("size"))
    shared = common.stored(narrow.filter(F.col("size") >= LEAST_SHARED).drop("size"))
    firsts = shared.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    later = shared.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("response")))
    revisits = common.stored(later.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "response").distinct())
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    with_digest = own.withColumn("digest", payload_digest(F.col("html")))
    same = with_digest["page_id"].eqNullSafe(revisits["_page"]) & (with_digest["digest"] == revisits["_digest"])
    joined = with_digest.join(revisits, same, "left")
    again = F.col("response").isNotNull()
    kind = F.when(again, "revisit").otherwise("response")
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    name = lambda key: F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))
    fixed = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
    http = F.concat(F.lit(fixed), F.octet_length("html").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("response")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return joined.select(
        name(F.col("page_id")).alias("record_id"),
        uri.alias("url"),
        kind.alias("record_type"),
        "digest",
        F.when(again, name(F.col("response"))).alias("refers_to"),
        F.concat(head, F.lit(END), block).alias("record"),
    )


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write all pages to archives below path, and return their index (INDEX), which is stored too."""
    columns = ("record_id", "url", "record_type", "digest", "refers_to")

    def pack(batches):
        out = uri = None
        rows: list[list] = [[] for _ in range(8)]
        try:
            for batch in batches:
                own = [batch.column(c).to_pylist() for c in columns]
                for k, record in enumerate(batch.column("record")):
                    if out is None:
                        uri = f"{path}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out, rows = _create(uri), [[] for _ in range(8)]
                    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    offset = out.tell()
                    out.write(gz.compress(record.as_buffer()) + gz.compress(END.encode()) + gz.flush())
                    for column, value in zip(rows, (uri, offset, out.tell() - offset, *(c[k] for c in own)), strict=True):
                        column.append(value)
                    if out.tell() >= ARCHIVE:
                        out.close()
                        out = None
                        yield _index_batch(rows)
            if out is not None:
                out.close()
                out = None
                yield _index_batch(rows)
        finally:
            if out is not None:
                out.close()

    return common.stored(records(pages).mapInArrow(pack, INDEX))


def _file_system(uri: str):
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _create(uri: str):
    """A new file by its URI, on any store that executors reach."""
    system, path = _file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def _open(uri: str):
    """A random-access file by its URI, on any store that executors reach."""
    system, path = _file_system(uri)
    return system.open_input_file(path)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _scanned(file) -> Iterator[tuple[int, int, dict]]:
    """(offset, length, headers) of the member of each record. A member is read in parts, and
    nothing of it is kept but its headers."""
    size, at, held = file.size(), 0, b""
    while at < size:
        gz, head, used, begun = zlib.decompressobj(31), b"", 0, False
        while not gz.eof:
            if not held and not (held := file.read_at(CHUNK, at + used)):
                raise ValueError(f"the gzip member at {at} does not end")
            out = gz.decompress(held, CHUNK)
            begun = begun or bool(out)
            if END.encode() not in head:
                head += out
            left = gz.unused_data if gz.eof else gz.unconsumed_tail
            used += len(held) - len(left)
            held = left
        if begun:
            yield at, used, _headers(head[: head.index(END.encode())])
        at += used


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """One row of INDEX per record below path, for archives that came without an index. Files are
    listed by Spark and scanned in tasks."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                rows = [[] for _ in range(8)]
                with _open(uri) as file:
                    for offset, length, h in _scanned(file):
                        digest = h.get("warc-payload-digest", "").rpartition(":")[2]
                        for column, value in zip(rows, (uri, offset, length, h.get("warc-record-id"), h.get("warc-target-uri"), h["warc-type"], digest, h.get("warc-refers-to")), strict=True):
                            column.append(value)
                        if len(rows[0]) >= 10_000:
                            yield _index_batch(rows)
                            rows = [[] for _ in range(8)]
                yield _index_batch(rows)

    return files.select("path").repartition(n).mapInArrow(scan, INDEX)


def _index_batch(rows: list[list]) -> pa.RecordBatch:
    names = [c.split()[0] for c in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if c in ("offset", "length") else pa.string()) for c, v in zip(names, rows, strict=True)], names=names)


def _coalesced(wanted: Iterator[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of (file, offset, length), sorted, that are read at once."""
    run: list[tuple[str, int, int]] = []
    for x in wanted:
        if run and (x[0] != run[0][0] or x[1] - (run[-1][1] + run[-1][2]) > GAP or x[1] + x[2] - run[0][1] > CHUNK):
            yield run
            run = []
        run.append(x)
    if run:
        yield run


def read_records(index: DataFrame, make, schema: str) -> DataFrame:
    """Read the records of index, of which rows may be left out, and put each through make.

    make(headers, payload) gives a row of schema; headers are those of the record itself, by names in
    lower case. Rows are dealt by file and range of CHUNK
    bytes, sorted by offset, and neighbouring ranges are read together; at most CHUNK bytes, or one
    record, are held at a time.
    """
    names = [c.split()[0] for c in INDEX.split(", ")]
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select(*names, F.floor(F.col("offset") / CHUNK).alias("_chunk")).repartition(n, "file", "_chunk").sortWithinPartitions("file", "offset")

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)

    def read(batches):
        out_names = [c.split()[0] for c in schema.split(", ")]
        open_uri, file, made = None, None, []
        try:
            for run in _coalesced(rows(batches)):
                if run[0][0] != open_uri:
                    if file:
                        file.close()
                    open_uri, file = run[0][0], _open(run[0][0])
                begin = run[0][1]
                held = file.read_at(run[-1][1] + run[-1][2] - begin, begin)
                for row in run:
                    record = zlib.decompress(held[row[1] - begin : row[1] - begin + row[2]], 31)[: -len(END)]
                    head, block = record.split(END.encode(), 1)
                    payload = block[block.index(END.encode()) + len(END) :]
                    made.append(make(_headers(head), payload))
                if len(made) >= 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(out_names, m, strict=True)) for m in made], schema=arrow)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist([dict(zip(out_names, m, strict=True)) for m in made], schema=arrow)
        finally:
            if file:
                file.close()

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return dealt.mapInArrow(read, schema)


def _digest(headers: dict[str, str]) -> str:
    return headers.get("warc-payload-digest", "").rpartition(":")[2]


def payloads(index: DataFrame) -> DataFrame:
    """(record_id, url, record_type, refers_to, digest, payload binary) of the records of index, as
    the archives have them."""

    def make(h, payload):
        return h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-type"), h.get("warc-refers-to"), _digest(h), payload

    return read_records(index, make, "record_id string, url string, record_type string, refers_to string, digest string, payload binary")


def op1_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """What the archives say of each page: every record is read, its id, type and reference are those
    of its headers, and a response's digest is that of its payload. A revisit has no payload; its
    length is that of the response that it refers to by id and digest."""
    index = write_archives(common.table(spark, sf_dir, "pages"), common.shared_dir(spark))

    def make(h, payload):
        response = h.get("warc-type") == "response"
        digest = hashlib.sha1(payload).hexdigest() if response else _digest(h)
        return h.get("warc-record-id"), h.get("warc-type"), h.get("warc-refers-to"), len(payload) if response else None, digest

    found = common.stored(read_records(index, make, "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    of = lambda c: F.when(page(F.col(c)) != "", page(F.col(c))).cast("long").alias("page_id" if c == "record_id" else c)
    again = F.col("record_type") == "revisit"
    # Names of pages that are revisited are unique among responses but for repeated rows.
    known = found.filter(~again).groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    responses = found.filter(~again)
    revisits = found.filter(again).drop("payload_bytes").join(known, ["refers_to", "payload_digest"], "left")
    both = responses.unionByName(revisits.select(responses.columns))
    return both.select(of("record_id"), "payload_bytes", "payload_digest", "record_type", of("refers_to"))


OP1_SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
r AS (SELECT *, payload_bytes >= {LEAST_SHARED} AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM r
"""
