"""Written intermediate tables, size-checked joins and connected components.

The tables live in the folder the cluster names in
``spark.checkpoint.dir`` so that a lost executor costs a re-read, never a
recomputation of the whole lineage.
"""
from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shipping import ship

#: A joined side is broadcast only after it was written and counted, and only
#: up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

#: Edges whose components one task finds; more are rewritten round by round.
TASK_EDGES = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    ``spark.checkpoint.dir`` wins.  Where it is unset a local master falls back
    to a folder of its own and a cluster to its warehouse, which is shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.gettempdir() + "/quillspark-shared"
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillspark"
    return root.rstrip("/")


class Workspace:
    """A uniquely named folder below :func:`shared_root` holding written tables."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._noted = False

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back with its own schema."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        if not self._noted:  # removed when the application ends
            self._noted = True
            jvm = self.spark.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(self.root)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing lazy refers to any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS, size: str | None = None) -> DataFrame:
    """Join with a narrow written table: broadcast when its counted size allows
    it, else let Spark shuffle both sides (AQE splits skewed partitions).
    ``size`` names an array column whose elements count as rows."""
    each = F.lit(1) + F.coalesce(F.size(size), F.lit(0)) if size else F.lit(1)
    if (small.agg(F.sum(each)).first()[0] or 0) <= limit:
        return big.join(F.broadcast(small), on, how)
    return big.hint("merge").join(small.hint("merge"), on, how)


def numbered(ws: Workspace, df: DataFrame, order: list[str], name: str, column: str = "idx") -> DataFrame:
    """Adds the 0-based position of every row in ``order``, without a task that
    sees all rows: the rows are written by ranges, ranges are counted, and a row's
    position is its range's first one plus its rank there."""
    kept = ws.keep(df.repartitionByRange(*order).withColumn("_quillspark_range", F.spark_partition_id()), name)
    before = Window.orderBy("_quillspark_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = kept.groupBy("_quillspark_range").agg(F.count("*").alias("_quillspark_n"))
    firsts = sizes.select("_quillspark_range", F.coalesce(F.sum("_quillspark_n").over(before), F.lit(0)).alias("_quillspark_first"))
    rank = F.row_number().over(Window.partitionBy("_quillspark_range").orderBy(*order)) - 1
    out = kept.withColumn("_quillspark_rank", rank).join(F.broadcast(firsts), "_quillspark_range")
    return out.withColumn(column, (F.col("_quillspark_first") + F.col("_quillspark_rank")).cast("long")).drop("_quillspark_range", "_quillspark_rank", "_quillspark_first")


def components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(u, v)`` -> ``(node, component)``.

    Alternating large-star and small-star rewrites: every rewrite is a minimum
    per node (combined before the shuffle) joined back to the edge table, so a
    hub with very many neighbours is never gathered into one task.  Each round
    is written to the shared folder.  Nodes without an edge do not appear;
    ``component`` is the smallest node reachable.  Self-loops are ignored.

    Up to TASK_EDGES edges between numbers go to one task instead: the jobs of the
    rounds would cost the driver more time and memory than the edges do.
    """
    cur = ws.keep(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(),
        f"{name}-0",
    )
    mark, turn = _mark(cur), 0
    if mark[0] <= TASK_EDGES and dict(cur.dtypes)["u"] == dict(cur.dtypes)["v"] == "bigint":
        return cur.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    while mark[0]:
        turn += 1
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = ws.keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{turn}")
        now = _mark(nxt)
        ws.drop(f"{name}-{turn - 1}")
        cur = nxt
        if now == mark:
            break
        mark = now
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def _in_one_task(batches):
    """All rows (u, v) -> (node, component)."""
    pairs = [[batch.column(i).to_numpy() for i in (0, 1)] for batch in batches]
    if not pairs:
        return
    nodes, at = np.unique(np.concatenate([np.concatenate(side) for side in zip(*pairs)]), return_inverse=True)
    a, b = np.split(at, 2)
    low, last = np.arange(len(nodes)), None  # the smallest node that each is known to reach
    while last is None or (low != last).any():
        last = low.copy()
        least = np.minimum(low[a], low[b])
        for end in (a, b):
            np.minimum.at(low, end, least)
            np.minimum.at(low, last[end], least)
        low = low[low]
    for s in range(0, len(nodes), 1 << 16):
        part = slice(s, s + (1 << 16))
        yield pa.record_batch([pa.array(nodes[part]), pa.array(nodes[low[part]])], ["node", "component"])


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return (row[0], row[1])
