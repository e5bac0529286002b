"""Where jobs put tables that others read, and tables of invoices that are replaced by key.

A store is a folder of data folders and manifests. A table of the store is cut into buckets by a hash
of its key; a manifest names, for each bucket, the data folders that hold it. A commit writes the
buckets that a batch touches to new folders, and then one manifest, by a rename that fails if another
writer has made that version. So readers see one whole version, a failed job leaves the last one, and
rows of other buckets are neither read nor written.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "invoice_id"
#: Buckets of a new store: a few hundred MB each is a good size for a bucket.
BUCKETS = 64
_BUCKET = "_bucket"
#: How a store's keys become buckets, by the name that its manifest has for it. Stores without one are older.
_HASHES = {"hash": F.hash, "xxhash64": F.xxhash64}
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, which spark.checkpoint.dir names.

    A session on one machine without that setting, as in tests, gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of jobs that are started within go as their job ends, not as the driver happens to
    collect its garbage. If one is read again after all, Spark makes it again."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def key_buckets(spark: SparkSession) -> int:
    """The buckets of frames that are stored by key: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored_by_key(df: DataFrame, key: str = KEY) -> DataFrame:
    """stored(df) as a table in buckets of its key, so that frames stored like this are joined and
    grouped by key without a shuffle.

    Rows are not shuffled for it. They make a file a bucket if a join, a grouping or a repartition by
    key was the last to deal them, and otherwise as many as each task has buckets. The name that the
    table needs while it is written is dropped; its files stay as those of stored do.
    """
    spark, name = df.sparkSession, f"by_key_{uuid.uuid4().hex}"
    with freed(spark):
        df.write.format("parquet").bucketBy(key_buckets(spark), key).option("compression", "zstd").option("path", new_path(spark)).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def bucket_of(key: Column, buckets: int, by: str = "hash") -> Column:
    """The bucket of a key; by hash it is that of Spark's own shuffles and bucketed tables."""
    return F.pmod(_HASHES[by](key), F.lit(buckets)).cast("int")


class Folder:
    """Small files of a folder that any Hadoop file system may hold."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def names(self) -> list[str]:
        if not self._fs.exists(self._path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The whole file or none; an error if there is one of that name."""
        draft = self._at(f".{name}.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path)
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(draft, self._at(name)):
            self._fs.delete(draft, False)
            raise FileExistsError(f"another writer has published {name}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Store:
    """Tables below path that are written by batches and have the column `key`.

    A manifest's tables are {name: {"schema", "folders": {bucket: [folder]}}}; by names the hash that
    deals keys to buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, key: str = KEY):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._manifests = Folder(spark, f"{self.path}/manifests")
        self._new = {"version": 0, "buckets": buckets, "by": "hash", "batches": [], "tables": {}}

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._manifests.names() if n.endswith(".json") and n[0] != "."]

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            version = max(self.versions(), default=0)
        return json.loads(self._manifests.read(f"{version:010d}.json")) if version else self._new

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as it is in a version (the last one by default), or some of its buckets."""
        table = self.manifest(version)["tables"][name]
        mine = [f for b, folders in table["folders"].items() if buckets is None or int(b) in buckets for f in folders]
        paths = sorted(f"{self.path}/data/{f}" for f in mine)
        schema = table["schema"]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, manifest: dict) -> Column:
        return bucket_of(F.col(self.key), manifest["buckets"], manifest.get("by", "xxhash64"))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that have keys of rows."""
        return sorted(r[0] for r in rows.select(self._bucket(self.manifest())).distinct().collect())

    def _write(self, df: DataFrame, folder: str, bucket: Column, in_place: bool) -> dict[str, list[str]]:
        """Write rows by bucket; the folders of the buckets that have any."""
        dealt = df.withColumn(_BUCKET, bucket)
        if not in_place:
            dealt = dealt.hint("rebalance", F.col(_BUCKET))
        # Rows stay until their key comes again, so they are packed well.
        with freed(self.spark):
            dealt.write.partitionBy(_BUCKET).option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
        names = Folder(self.spark, f"{self.path}/data/{folder}").names()
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in names if n.startswith(_BUCKET)}

    def commit(self, batch: str, replaced: dict[str, DataFrame], ids: DataFrame, appended: dict[str, DataFrame], in_place: bool = False) -> int:
        """The version with the batch in it.

        In the tables `replaced`, all rows of the keys in `ids` go and those given come in; other
        keys keep theirs. Only buckets that have rows of these keys are written anew; in others, as
        in all of the tables `appended`, rows are added. A batch that was committed before changes
        nothing, so that one may be sent again after a failure, even after later ones. Only the
        numbers of touched buckets come to the driver. Columns have to stay the same.

        Rows are dealt to their buckets by a shuffle, or written in_place: for frames that are cut from
        tables stored by key with as many buckets as the store, whose partitions have one bucket each.
        Others would make a file for each bucket that a partition has rows of.
        """
        last = self.manifest()
        if batch in last["batches"]:
            return last["version"]
        bucket, mark, tables = self._bucket(last), uuid.uuid4().hex, dict(last["tables"])
        keys = ids.select(self.key).distinct()
        touched = self.touched(keys) if replaced else []
        for name, rows in (replaced | appended).items():
            schema = _schema(rows)
            folders = dict(tables[name]["folders"]) if name in tables else {}
            if name in tables and tables[name]["schema"] != schema:
                raise ValueError(f"the columns of {name} are {tables[name]['schema']}, not {schema}")
            if name in replaced and folders:
                old = self.read(name, last["version"], touched).select(self.key).join(keys, self.key, "left_semi")
                if held := self.touched(old):
                    rows = self.read(name, last["version"], held).join(keys, self.key, "left_anti").unionByName(rows)
                    folders = {b: f for b, f in folders.items() if int(b) not in held}
            made = self._write(rows, f"{name}/{mark}", bucket, in_place)
            folders |= {b: [*folders.get(b, []), *f] for b, f in made.items()}
            tables[name] = {"schema": schema, "folders": folders}
        version = last["version"] + 1
        manifest = last | {"version": version, "batches": [*last["batches"], batch], "tables": tables}
        self._manifests.publish(f"{version:010d}.json", json.dumps(manifest))
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Remove versions but for the last `keep`, and folders that none of these names; how many
        folders went. Not beside a writer: what it has not published yet would go too."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._manifests.remove(f"{v:010d}.json")
        used = set()
        for v in versions[-keep:]:
            for table in self.manifest(v)["tables"].values():
                used |= {"/".join(f.split("/")[:2]) for folders in table["folders"].values() for f in folders}
        gone, data = 0, Folder(self.spark, f"{self.path}/data")
        for name in data.names():
            for mark in Folder(self.spark, f"{self.path}/data/{name}").names():
                if f"{name}/{mark}" not in used:
                    data.remove(f"{name}/{mark}")
                    gone += 1
        return gone


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def write_tables(
    spark: SparkSession, path: str, batch: str, invoices: DataFrame, items: DataFrame, logs: DataFrame, buckets: int = BUCKETS, in_place: bool = False
) -> int:
    """Commit a batch of the pipeline's tables: its invoices take the place of those of the same id,
    their items that of all their earlier items, and logs are added. See Store.commit."""
    return Store(spark, path, buckets).commit(batch, {"invoices": invoices, "items": items}, invoices, {"logs": logs}, in_place)
