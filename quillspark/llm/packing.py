"""Packing by cutting-stock column generation.

The driver sees only the histogram of piece lengths (at most ``capacity / unit``
classes).  A linear program over patterns (multisets of classes that fit into a
sequence) is solved by column generation: the simplex duals are prices, and a
knapsack dynamic programme finds the pattern worth most.  Its solution is
rounded, the rest is filled first-fit decreasing, and the patterns are laid out
as intervals of ranks: the r-th piece of a class takes the r-th slot of it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, keyed
from .tokens import encoder

#: Pieces of a class that are ranked in one window partition, on average.
RANKED = 2_000


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern and its value."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = sizes[: np.searchsorted(sizes, c, "right")]
        if len(fit):
            worth = best[c - fit] + values[: len(fit)]
            i = int(np.argmax(worth))
            if worth[i] > best[c] + 1e-12:
                best[c], pick[c] = worth[i], i
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; the driver's BLAS threads stay out of it."""
    m = len(a)
    work = np.hstack([a, np.eye(m)])
    for i in range(m):
        p = i + int(np.argmax(np.abs(work[i:, i])))
        work[[i, p]] = work[[p, i]]
        work[i] /= work[i, i]
        rest = work[:, i].copy()
        rest[i] = 0
        work -= np.outer(rest, work[i])
    return work[:, m:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.002, rounds: int = 4000):
    """Patterns and fractional counts of the linear program, within ``gap`` of
    its optimum: the lower bound is the larger of the filled capacity and the
    best ``objective / value`` of all rounds."""
    m = len(sizes)
    basis = [np.eye(m, dtype=np.int64)[i] * int(capacity // sizes[i]) for i in range(m)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = (inverse * demand).sum(axis=1)  # sums, not BLAS: its threads would fight the tasks
    least = float((sizes * demand).sum()) / capacity
    for turn in range(rounds):
        prices = inverse.sum(axis=0)
        value, pattern = price(np.maximum(prices, 0), sizes, capacity)
        least = max(least, float(x.sum()) / value)
        if x.sum() <= (1 + gap) * least:
            break
        step = (inverse * pattern).sum(axis=1)
        ratio = np.where(step > 1e-11, x / np.where(step > 1e-11, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = x - ratio[out] * step
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[out] = pattern
        if turn % 200 == 199:  # wash out rounding errors
            inverse = _inverse(np.array(basis, float).T)
            x = np.maximum((inverse * demand).sum(axis=1), 0)
    return basis, x


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``{class size: pieces}`` -> patterns ``({class size: copies}, times)``
    that hold every piece exactly once."""
    if not counts:
        return []
    sizes = np.array(sorted(counts), np.int64)
    left = np.array([counts[int(s)] for s in sizes], np.int64)
    basis, x = column_generation(sizes, left.astype(float), capacity)
    used: list[tuple[np.ndarray, int]] = []
    for i in np.argsort(-(x - np.floor(x + 1e-9)), kind="stable"):
        times = int(np.floor(x[i] + 1e-9))
        own = basis[i] > 0
        times = min(times, int((left[own] // basis[i][own]).min()))
        if times:
            used.append((basis[i], times))
            left = left - basis[i] * times
    for i in np.argsort(-(x - np.floor(x + 1e-9)), kind="stable"):  # round up while the pieces last
        if x[i] - np.floor(x[i]) >= 0.5 and (left >= basis[i]).all():
            used.append((basis[i], 1))
            left = left - basis[i]
    while left.any():  # first fit decreasing, as often as the same filling repeats
        room, pattern = capacity, np.zeros_like(left)
        for i in range(len(sizes) - 1, -1, -1):
            take = int(min(left[i], room // sizes[i]))
            pattern[i], room = take, room - take * int(sizes[i])
        own = pattern > 0
        times = int((left[own] // pattern[own]).min())
        used.append((pattern, times))
        left = left - pattern * times
    return [({int(sizes[i]): int(p[i]) for i in np.flatnonzero(p)}, t) for p, t in used]


def _cut(tokenizer: str, end_id: int, capacity: int):
    def run(batches):
        enc = encoder(tokenizer)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        flush = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], ["row", "id", "start", "length", "doc_tokens", "ids"])
        for batch in batches:
            numbers, doc_ids, out, held = batch.column(2).to_pylist(), batch.column(0).to_pylist(), tuple([] for _ in kinds), 0
            for row, ids in enc.encode(batch.column(1)):
                ids = np.append(ids, end_id).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    for col, v in zip(out, (numbers[row], doc_ids[row], at, len(part), len(ids), part.tobytes())):
                        col.append(v)
                held += len(ids)
                if held > 1 << 21:
                    yield flush()
                    out, held = tuple([] for _ in kinds), 0
            yield flush()

    return run


def pack(
    docs: DataFrame,
    ws: Workspace,
    tokenizer: str,
    end_id: int,
    capacity: int = 4096,
    unit: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32`` (of its ids as
    little-endian u32), ``doc_tokens``, ``sequence_id``, ``offset`` and ``row`` (a
    number of the document that no other has).  The ids themselves are in the
    written table ``pieces``; see :func:`sequences`.

    Every document is its ids followed by ``end_id`` (null text: ``end_id``
    alone), cut every ``capacity`` ids; each piece lies in one sequence, offsets
    there have no gaps.  Rows that repeat or lack an id are documents of their own,
    an empty table gives no piece, other columns are not read.  The ids are written once
    and never shuffled: only the narrow description of the pieces is.
    """
    spark = docs.sparkSession
    rows = keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ws, "id")
    schema = "row long, id long, start long, length long, doc_tokens long, ids binary"
    pieces = ws.keep(rows.mapInArrow(_cut(tokenizer, end_id, capacity), schema), "pieces")

    narrow = pieces.select("row", "id", "start", "length", F.crc32("ids").alias("crc"), "doc_tokens")
    narrow = narrow.withColumn("size", F.ceil(F.col("length") / unit) * unit)
    narrow = ws.keep(narrow, "narrow")
    # a row per class of lengths, capacity / unit at most
    histogram = {int(r["size"]): int(r["n"]) for r in narrow.groupBy("size").agg(F.count("*").alias("n")).collect()}
    salts = F.create_map(*[F.lit(int(x)) for size, n in histogram.items() for x in (size, -(-n // RANKED))]) if histogram else F.lit(None).cast("map<int,int>")
    narrow = narrow.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.element_at(salts, F.col("size").cast("int"))))
    counts = ws.keep(narrow.groupBy("size", "salt").agg(F.count("*").alias("n")), "counts")

    slots, base, filled = [], 0, dict.fromkeys(histogram, 0)
    units = {s // unit: n for s, n in histogram.items()}
    for pattern, times in plan_patterns(units, capacity // unit):
        for size, copies in pattern.items():
            size *= unit
            lo = filled[size]
            filled[size] = lo + copies * times
            slots.append((size, lo, filled[size], base, copies))
        base += times
    slots = spark.createDataFrame(slots, "size long, lo long, hi long, base long, copies long")

    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("size", "salt").orderBy("row", "start")
    ranked = narrow.withColumn("r", F.row_number().over(within) - 1).join(firsts, ["size", "salt"])
    ranked = ranked.withColumn("r", F.col("r") + F.col("first"))
    # a slot row per class and pattern: bounded by the histogram, not by the data
    placed = ranked.join(F.broadcast(slots), (ranked["size"] == slots["size"]) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor((F.col("r") - F.col("lo")) / F.col("copies")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"),
        "row",
    )


def sequences(ws: Workspace, packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from the written pieces: ``sequence_id``,
    ``ids`` (little-endian u32) and ``length``.  A sequence has ``capacity`` ids
    at most, so its group is bounded."""
    pieces = ws.spark.read.parquet(ws.path("pieces")).select("row", "start", "ids")
    rows = packed.join(pieces, ["row", "start"])
    group = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
    ids = F.aggregate(F.col("parts"), F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return group.select("sequence_id", ids.alias("ids"), "length")
