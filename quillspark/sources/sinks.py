"""A knowledge store on a shared file system: tables cut into buckets of documents,
and numbered manifests that name the current folder of every bucket.

A write adds folders for the buckets it changes and then one manifest; the manifest
with the highest number is the current state, so readers see all of a write or
nothing of it and no file is ever replaced.
"""
from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new store.  A build rewrites the buckets of its documents only.
BUCKETS = 16


class StoreMissing(FileNotFoundError):
    """There is no manifest below the root: nothing was ever written there."""


class StoreChanged(RuntimeError):
    """Another write came in between; it is to be repeated on the new state."""


@dataclass(frozen=True)
class Snapshot:
    """One state of a store: ``tables`` maps a table to its schema (JSON) and its
    folders by bucket."""

    root: str
    number: int = 0
    buckets: int = BUCKETS
    tables: dict[str, dict] = field(default_factory=dict)

    def read(self, spark: SparkSession, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        here = self.tables[table]
        schema = StructType.fromJson(here["schema"])
        folders = [f"{self.root}/{at}" for b, at in sorted(here["folders"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def bucket_of(self, document_id="document_id"):
        return F.pmod(F.xxhash64(document_id), F.lit(self.buckets)).cast("int")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the manifests below ``root``.  Only a missing folder counts as
    empty; whatever else goes wrong is raised."""
    _, folder, fs = _fs(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())


def current_snapshot(spark: SparkSession, root: str) -> Snapshot:
    numbers = _manifests(spark, root)
    if not numbers:
        raise StoreMissing(f"no knowledge store at {root}")
    told = json.loads(spark.read.option("wholetext", True).text(f"{root}/manifests/{numbers[-1]:012d}.json").first()[0])
    return Snapshot(root, numbers[-1], told["buckets"], told["tables"])


def _commit(spark: SparkSession, snapshot: Snapshot) -> None:
    """Write the manifest under its number: the claim fails if another writer has
    that number, and the manifest appears whole, by a rename to a new name."""
    path, claim, fs = _fs(spark, f"{snapshot.root}/manifests/{snapshot.number:012d}.claim")
    try:
        fs.create(claim, False).close()
    except Exception as e:
        raise StoreChanged(f"state {snapshot.number} of {snapshot.root} is written by another build") from e
    draft, target = (path(f"{snapshot.root}/manifests/{snapshot.number:012d}.{x}") for x in ("draft", "json"))
    try:
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"buckets": snapshot.buckets, "tables": snapshot.tables}, sort_keys=True).encode()))
        out.close()
        if not fs.rename(draft, target):
            raise StoreChanged(f"state {snapshot.number} of {snapshot.root} cannot be written")
    except Exception:
        fs.delete(claim, False)
        raise


def write_snapshot(spark: SparkSession, tables: dict[str, DataFrame], base: Snapshot, changed: list[int] | None = None) -> Snapshot:
    """The next state after ``base``: in the buckets ``changed`` (or all) the tables
    hold the given rows, elsewhere what ``base`` holds.

    Every table has ``document_id``.  A bucket's rows are one sorted file (by
    document, then by the other plain columns), so that a document or a key is found
    by the files' statistics.  A write that fails leaves ``base`` the current state."""
    build, told = uuid.uuid4().hex[:12], {}
    for table, df in tables.items():
        rows = df.withColumn("bucket", base.bucket_of())
        if changed is not None:
            rows = rows.where(F.col("bucket").isin(changed))
        keys = [c for c, t in df.dtypes if t in ("string", "int", "bigint") and c != "document_id"]
        rows = rows.repartition(len(changed) if changed else base.buckets, "bucket").sortWithinPartitions("bucket", "document_id", *keys)
        folder = f"{table}/{base.number + 1:012d}-{build}"
        rows.write.partitionBy("bucket").parquet(f"{base.root}/{folder}")
        path, at, fs = _fs(spark, f"{base.root}/{folder}")
        new = {s.getPath().getName().removeprefix("bucket="): f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(at) if s.isDirectory()}
        old = base.tables.get(table, {"folders": {}})["folders"]
        kept = {b: f for b, f in old.items() if changed is not None and int(b) not in changed}
        told[table] = {"schema": df.schema.jsonValue(), "folders": kept | new}
    after = Snapshot(base.root, base.number + 1, base.buckets, base.tables | told)
    _commit(spark, after)
    return after


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the current state.  To read several tables of one state, take
    :func:`current_snapshot` once."""
    return current_snapshot(spark, root).read(spark, table)


def export_json(df: DataFrame, path: str, *folders: str) -> None:
    """One JSON object per line with its keys sorted, for readers outside Spark;
    maps come as objects whose keys are sorted, too.  The columns ``folders`` become
    folders instead."""
    def ordered(name: str, kind: str):
        if kind.startswith("map<"):
            return F.map_from_entries(F.array_sort(F.map_entries(name))).alias(name)
        return F.col(name)

    df.select(*[ordered(c, t) for c, t in sorted(df.dtypes)]).write.mode("overwrite").partitionBy(*folders).json(path)
