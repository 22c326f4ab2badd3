"""Exact dedup through an extendible-hash index on shared files (native).

The directory maps the top bits of a key's hash to buckets of bounded size.  Owner
tasks take consecutive buckets, that is ranges of hashes; there, keys of one hash
form a chain whose bytes are compared.  What they find is written as index pages,
and every document reads its group from the page of its bucket.
"""
from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_counted

#: Bits of the hash that the directory uses at most: 2**13 entries, which bounds
#: what the driver holds and broadcasts.
MAX_DEPTH = 13
#: Distinct hashes that a bucket holds before it splits.
CAPACITY = 8_192
#: Distinct hashes that an owner task takes at most, if its buckets allow it.
OWNED = 65_536
#: Copies of one hash beyond which a task combines its own before they travel.
HOT = 32

_BLANK = " \t\n\u000b\f\r"


def normalised(text):
    """Text without the six ASCII white-space characters; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _BLANK, "")


class Bucket(NamedTuple):
    """``start`` and ``depth``: the cells whose first ``depth`` bits are those of
    ``start``.  ``load`` keys, spread over ``2**pages`` pages by the bits after the
    directory's (more than one only where the directory cannot double further)."""

    start: int
    depth: int
    load: int
    pages: int


def build_directory(load: list[int], capacity: int = CAPACITY) -> list[Bucket]:
    """Buckets in order of their cells, for the keys of each of 2**k cells.

    It starts as one bucket of depth 0; an overfull bucket splits in two, and the
    directory doubles when the bucket that splits has its own depth.  A bucket of a
    single cell that is still overfull gets pages by further bits.
    """
    before = [0, *accumulate(load)]
    depth = len(load).bit_length() - 1
    done, todo = [], [(0, 0)]
    while todo:
        start, d = todo.pop()
        width = 1 << (depth - d)
        n = before[start + width] - before[start]
        if n > capacity and d < depth:
            todo += [(start + width // 2, d + 1), (start, d + 1)]
        else:
            done.append(Bucket(start, d, n, (-(-n // capacity) - 1).bit_length() if n > capacity else 0))
    return done


def directory_table(ws: Workspace, buckets: list[Bucket], owners: int, depth: int) -> DataFrame:
    """The directory as a written table, a row per cell: its bucket and the pages of
    it, and the keys in the buckets before it (``before``) and per page (``share``),
    which place the pages on the owners."""
    cells: list[tuple[int, int, int, float]] = []
    before = 0
    for b in buckets:
        cells += [(b.start, b.pages, before, b.load / (1 << b.pages))] * (1 << (depth - b.depth))
        before += b.load
    lists = [F.split(F.lit(",".join(map(str, column))), ",").cast("array<double>") for column in zip(*cells)]
    at = F.col("id").cast("int")
    values = [F.get(x, at).cast(t).alias(c) for x, t, c in zip(lists, ("long", "int", "double", "double"), ("bucket", "pages", "before", "share"))]
    return ws.keep(ws.spark.range(0, len(cells), 1, 1).select(F.col("id").alias("cell"), *values, F.lit(max(1.0, before / owners)).alias("each")), "directory")


def route(keys: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """``keys`` with ``bucket``, ``page`` and ``owner`` of their hash ``h``."""
    cell = F.shiftrightunsigned(F.col("h"), 64 - depth)
    page = F.expr(f"if(pages = 0, 0, shiftrightunsigned(shiftleft(h, {depth}), 64 - pages))").cast("long")
    owner = F.floor((F.col("before") + F.col("page") * F.col("share")) / F.col("each")).cast("int")
    routed = keys.withColumn("cell", cell).join(F.broadcast(directory), "cell").withColumn("page", page)
    return routed.withColumn("owner", owner).drop("cell", "pages", "before", "share", "each")


def dedup(
    docs: DataFrame,
    ws: Workspace,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_depth: int = MAX_DEPTH,
    hash_bits: int = 64,
    hot: int = HOT,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.

    Two texts are equal when identical without ASCII white space (compared byte
    for byte, the hash only routes).  Of equal texts the row with the most code
    points in the original, then the smallest id, stays; null ids lose ties.  Null
    text counts as empty; empty texts are equal to each other; a repeated id is a
    row of its own in ``group_size`` and yields one output row per input row; an
    empty table gives an empty result; other columns of ``docs`` are not read.
    ``hash_bits`` narrows the routing hash (tests force collisions with it).

    Plan: the hashes are counted by cell, which makes the directory.  Rows travel to
    the owner of their bucket; rows of a hash with more than ``hot`` copies are
    combined per task first, so a group with a third of all rows travels as a row per
    task.  Owners order their keys by bucket, hash and text, which chains equal
    hashes and compares their bytes, and write a page entry per distinct text.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    norm = normalised(F.col("_text"))
    digest = F.xxhash64(norm)
    if hash_bits < 64:
        digest = F.pmod(digest, F.lit(1 << hash_bits)) * F.lit(1 << (63 - hash_bits))
    keys = ws.keep(rows.select("_id", digest.alias("h"), F.sha2(norm, 256).alias("sha")), "keys")
    hashes = keys.groupBy("h").agg(F.count("*").alias("n"))
    cell = F.shiftrightunsigned(F.col("h"), 64 - max_depth)
    load = [0] * (1 << max_depth)
    for r in hashes.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect():  # a row per cell at most
        load[r["cell"]] = r["n"]
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    owners = max(parts, -(-sum(load) // OWNED))
    directory = directory_table(ws, build_directory(load, capacity), owners, max_depth)

    rank = F.struct(F.length(F.coalesce("_text", F.lit(""))).alias("len"), (-F.col("_id")).alias("neg"))
    texts = rows.select(digest.alias("h"), norm.alias("norm"), F.lit(1).cast("long").alias("n"), rank.alias("best"))
    often = ws.keep(hashes.where(F.col("n") > hot).select("h"), "often")
    chain = [F.sum("n").alias("n"), F.max("best").alias("best")]
    if not often.isEmpty():
        copies = join_counted(texts, often, "h", "left_semi").groupBy("h", "norm").agg(*chain)
        texts = join_counted(texts, often, "h", "left_anti").unionByName(copies)
    owned = route(texts, directory, max_depth).repartitionById(owners, "owner")
    entries = owned.groupBy("owner", "bucket", "page", "h", "norm").agg(*chain)
    entries = entries.select("bucket", "page", "h", F.sha2("norm", 256).alias("sha"), F.col("n").alias("group_size"), (-F.col("best.neg")).alias("keep_id"))
    pages = ws.keep(entries.sortWithinPartitions("bucket", "page", "h", "sha"), "pages")
    probes = route(keys, directory, max_depth).drop("owner")
    return probes.join(pages, ["bucket", "page", "h", "sha"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
