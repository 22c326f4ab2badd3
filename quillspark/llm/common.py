"""Shared pieces of the training-data operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..workspace import BROADCAST_ROWS, Workspace, components, join_counted, numbered, shared_root

__all__ = ["BROADCAST_ROWS", "ROW", "Workspace", "components", "join_counted", "keyed", "named", "shared_root", "table"]

#: The column that :func:`keyed` adds; names that begin so are the library's own.
ROW = "_quillspark_row"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def keyed(docs: DataFrame, ws: Workspace, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``_row``, a number that no other row has, in id order (null
    ids last).  It is the id itself where ids are unique and none is null;
    otherwise the rows are numbered once in a written table, so that rows which
    repeat or lack an id are told apart."""
    docs = docs.drop(ROW)
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct(F.col(id_col).cast("long"))).first()
    if rows == ids:
        return docs.withColumn(ROW, F.col(id_col).cast("long"))
    # the place in the input breaks ties, so that many rows of one id are many ranges
    order = {f"{ROW}_late": F.col(id_col).isNull(), f"{ROW}_id": F.col(id_col).cast("long"), f"{ROW}_at": F.monotonically_increasing_id()}
    return numbered(ws, docs.withColumns(order), [*order], "keyed", ROW).drop(*order)


def named(found: DataFrame, docs: DataFrame, ws: Workspace, row_col: str = ROW, *others: str, id_col: str = "doc_id") -> DataFrame:
    """Results with the rows' ids in place of the numbers of :func:`keyed` in
    ``row_col`` and ``others``."""
    plain = docs.where(~F.col(ROW).eqNullSafe(F.col(id_col).cast("long"))).isEmpty()
    if plain:
        return found.withColumnRenamed(row_col, id_col)
    ids = ws.keep(docs.select(F.col(ROW).alias("_k"), F.col(id_col).cast("long").alias("_v")), "ids")
    order = [id_col if c == row_col else c for c in found.columns]
    for col in (row_col, *others):
        found = found.join(ids, F.col(col) == F.col("_k"), "left").drop("_k", col)
        found = found.withColumnRenamed("_v", id_col if col == row_col else col)
    return found.select(*order)
