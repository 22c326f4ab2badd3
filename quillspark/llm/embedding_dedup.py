"""Embedding near-dedup by a pivot-permutation index.

A vector is described by the order of its nearest pivots.  The first ``PREFIX``
of them post the vector to their inverted lists; two vectors are compared where
they share ``SHARED`` pivots of their prefixes at least, in the list of the first
one they share (in pivot order), so every pair is met once.  The cosine is then
checked in double precision.  Vectors with equal directions are one class, which
the index holds once.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, join_counted

#: Pivots for vectors of one length are this many at most, of a sample twice as large.
MAX_PIVOTS = 2048
PREFIX = 8
SHARED = 2
#: Vectors of one part of a list; a task compares the vectors of two parts at a time.
TILE = 4096


def unit_vectors(column: pa.Array):
    """Yield ``(rows, matrix)`` for each length: the vectors in double precision,
    scaled to length 1.  Null, empty and zero vectors, and those with null or
    non-finite components, are left out.  The largest component is scaled to 1
    first, so that neither squares nor their sum leave the range of doubles."""
    flat = column.flatten() if not column.null_count else column.drop_null().flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        some = values[start[rows][:, None] + np.arange(n)]
        largest = np.abs(some).max(axis=1)
        good = np.isfinite(largest) & (largest > 0)
        rows, some = rows[good], some[good] / largest[good][:, None]
        if len(rows):
            yield rows, some / np.sqrt((some * some).sum(axis=1))[:, None]


def pivot_count(n: int) -> int:
    """Pivots for ``n`` vectors: four times the root, so that lists grow like it."""
    return int(min(MAX_PIVOTS, max(32, 4 * n**0.5)))


def apart(units: np.ndarray, want: int, least: float) -> np.ndarray:
    """``want`` of the vectors at most, in their order, none within twice the angle
    of ``least`` of an earlier one: whatever links with the same vector gets one
    pivot, so a hot group cannot fill the table with near copies of itself."""
    limit = max(0.0, 2 * least * least - 1)
    table, n = np.empty((want, units.shape[1])), 0
    for u in units:
        if n == want:
            break
        if not n or (table[:n] @ u).max() < limit:
            table[n] = u
            n += 1
    return table[:n].copy()


def _units(batches):
    """Rows (id, vector) -> usable ones as unit vectors with their length."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for rows, units in unit_vectors(batch.column(1)):
            yield pa.record_batch([pa.array(ids[rows]), pa.array(np.full(len(rows), units.shape[1], np.int32)), pa.array([(u + 0.0).tobytes() for u in units], pa.binary())], ["id", "dim", "unit"])


def _matrix(column) -> np.ndarray:
    """Unit vectors of one length, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _posted(pivots, prefix: int, shared: int):
    """Classes (id, dim, unit, n) -> one row per posting, with the sorted prefix.  The
    last of the prefix cannot be the first of several shared pivots and has none."""

    def run(batches):
        tables, base = pivots.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                table = tables[int(dim)]
                k = min(prefix, len(table))
                keep = k - min(shared, k) + 1
                for at in range(0, len(some), 2048):
                    part = some.slice(at, 2048)
                    unit = _matrix(part.column("unit"))
                    near = np.argpartition(-(unit @ table.T), k - 1, axis=1)[:, :k] if k < len(table) else np.tile(np.arange(k), (len(unit), 1))
                    near = np.sort(near, axis=1).astype(np.int32) + np.int32(base[int(dim)])
                    who = pa.array(np.repeat(np.arange(len(part)), keep))
                    order = pa.array([p.tobytes() for p in near], pa.binary())
                    yield pa.record_batch(
                        [pa.array(near[:, :keep].ravel()), *(part.column(c).take(who) for c in ("id", "n")), order.take(who), part.column("unit").take(who)],
                        ["pivot", "id", "n", "near", "unit"],
                    )

    return run


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable within a tile over the links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tiles(least: float, shared: int):
    """Rows (pivot, here, there, home, id, n, near, unit), sorted by the first three
    -> (u, v, n): n vectors linked with class u, and the smallest class of u's
    component in these rows.  Home rows meet guests, or one another where both parts
    are the same."""

    def of_parts(pivot, same, home, ids, size, near, unit):
        h = np.flatnonzero(home)
        g = h if same else np.flatnonzero(~home)
        count, left, right = np.zeros(len(ids), np.int64), [], []
        least_shared = min(shared, near.shape[1])
        for at in range(0, len(h), 256):
            x = h[at : at + 256]
            close = unit[x] @ unit[g].T >= least
            if same:  # each pair once
                close &= x[:, None] < g[None, :]
            i, j = np.nonzero(close)
            for lo in range(0, len(i), 100_000):
                p, q = x[i[lo : lo + 100_000]], g[j[lo : lo + 100_000]]
                common = (near[p][:, :, None] == near[q][:, None, :]).any(axis=2)
                first = near[p, np.argmax(common, axis=1)]
                ok = (common.sum(axis=1) >= least_shared) & (first == pivot)
                np.add.at(count, p[ok], size[q[ok]])
                np.add.at(count, q[ok], size[p[ok]])
                left.append(p[ok])
                right.append(q[ok])
        if not count.any():
            return None
        a, b = np.concatenate(left), np.concatenate(right)
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(ids))
        label = ids[order][_components(place[a], place[b], len(ids))][place]
        some = np.flatnonzero(count)
        return ids[some], label[some], count[some]

    def run(batches):
        held = None

        def groups():
            nonlocal held
            for batch in batches:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
                if not len(held):
                    continue
                keys = np.stack([held.column(c).to_numpy() for c in ("pivot", "here", "there")])
                cut = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
                for s, e in zip(cut[:-1], cut[1:]):
                    yield held.slice(s, e - s)
                held = held.slice(cut[-1])
            if held is not None and len(held):
                yield held

        for rows in groups():
            if len(rows) < 2:
                continue
            pivot, here, there = (rows.column(c)[0].as_py() for c in ("pivot", "here", "there"))
            home, ids, size = (rows.column(c).to_numpy() for c in ("home", "id", "n"))
            near = np.frombuffer(b"".join(rows.column("near").to_pylist()), np.int32).reshape(len(rows), -1)
            found = of_parts(pivot, here == there, home, ids, size, near, _matrix(rows.column("unit")))
            if found:
                yield pa.record_batch([pa.array(c) for c in found], ["u", "v", "n"])

    return run


def _pivots(reps: DataFrame, least: float) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """For each vector length, the pivots and the number of the first one.  They come
    from a bounded sample of the classes of that length, by the hash of their id."""
    counts = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    share = F.element_at(F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, min(1.0, 2.2 * pivot_count(n) / n))]), F.col("dim"))
    draw = F.xxhash64("id")
    drawn = reps.where(F.pmod(draw, F.lit(1 << 30)) < share * (1 << 30)).select(draw.alias("draw"), "id", "dim", "unit").collect()
    tables, base, at = {}, {}, 0
    for dim, n in sorted(counts.items()):
        some = [r["unit"] for r in sorted((r for r in drawn if r["dim"] == dim), key=lambda r: (r["draw"], r["id"]))]
        if not some:  # few of this length, none drawn
            some = [reps.where(F.col("dim") == dim).agg(F.min_by("unit", "id")).first()[0]]
        tables[dim], base[dim] = apart(np.frombuffer(b"".join(some), np.float64).reshape(len(some), dim), pivot_count(n), least), at
        at += len(tables[dim])
    return tables, base


def near_duplicates(
    vectors: DataFrame,
    ws: Workspace,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.95,
    prefix: int = PREFIX,
    shared: int = SHARED,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Ids are unique and not null (see :func:`common.keyed`).  Null, empty, zero and
    non-finite vectors link with nothing; others link with vectors of their length
    only; vectors of one direction link with each other; an empty table gives an
    empty result; other columns are not read.  Pivots come from a bounded sample of
    the usable vectors of each length (``2.2 * MAX_PIVOTS``) and lie :func:`apart`;
    every vector is indexed.  A list is cut into parts of about ``TILE``, and a group
    of rows holds two of them, so that memory does not grow with a list.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    units = ws.keep(rows.mapInArrow(_units, "id long, dim int, unit binary"), "units")
    members = units.select("id", F.md5("unit").alias("key"))
    classes = ws.keep(members.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = join_counted(units, classes.select(F.col("rep").alias("id"), "n"), "id")
    reps = ws.keep(reps, "reps")
    if reps.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    sent = spark.sparkContext.broadcast(_pivots(reps, least))
    posts = ws.keep(reps.mapInArrow(_posted(sent, prefix, shared), "pivot int, id long, n long, near binary, unit binary"), "posts")
    lists = ws.keep(posts.groupBy("pivot").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "lists")  # a row per pivot
    posts = posts.join(F.broadcast(lists), "pivot").withColumn("own", F.pmod(F.hash("id"), F.col("parts")))
    # part t meets itself and every later part, and is met by every earlier one
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = posts.select("pivot", F.least("own", "other").alias("here"), F.greatest("own", "other").alias("there"), (F.col("own") <= F.col("other")).alias("home"), "id", "n", "near", "unit")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-reps.count() // (8 * TILE)))
    tiles = tiles.repartition(parts, "pivot", "here", "there").sortWithinPartitions("pivot", "here", "there")
    found = ws.keep(tiles.mapInArrow(_tiles(least, shared), "u long, v long, n long"), "found")
    joined = components(ws, found.select("u", "v"), "cc")
    links = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    told = classes.join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    told = ws.keep(told.select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "told")
    out = rows.select("id").join(join_counted(members, told, "key").drop("key"), "id", "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), comp.alias("component_id"), (F.col("id") == comp).alias("kept"))
