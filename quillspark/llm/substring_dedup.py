"""Substring dedup by hashing units of the texts.

Units are normalised, their digests are grouped over the whole table, the
earliest occurrence in rank order stays and every other one is removed, with its
offsets in the original.  There are two kinds:

* *lines* (or paragraphs between blank lines) of ``MIN_WORDS`` words or more;
* *passages*: every run of ``PASSAGE`` consecutive words, wherever lines break.
  Lines of prose are as long as paragraphs, so what two texts share mostly covers
  a part of a line and no whole one has an equal digest.

Passages overlap, one starts at every word, but few are written out.  Consecutive
passages with the same smallest hash of ``GRAM`` words form a *stretch*: equal
passages have equal smallest hashes, so a stretch whose hash nothing else has holds no
repeat.  Of the others, stretches with equal digests are equal as a whole, and only
where stretches of one hash differ are their passages hashed one by one.
"""
from __future__ import annotations

import hashlib
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, join_counted
from .wordvec import Rolling, blocks, word_bounds, word_hashes

#: Lines of fewer words are no units of their own: short lines repeat in clean prose.
MIN_WORDS = 20
#: Words of a passage: what repeats over so many words or more is removed.
PASSAGE = 50
#: Words whose hashes are compared to find a passage's smallest one.
GRAM = 25
#: Multipliers of the two halves of a passage's digest; the first makes stretches, too.
LANES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_SPLIT = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[\x20\x09-\x0D]*\n")}


def normalise(unit: str) -> str:
    """A-Z lowered, runs of ASCII white space one space, none at the ends."""
    return _BLANK.sub(" ", unit).strip(" ").translate(_LOWER)


def _cut(text: str, kind: str):
    """``(start, end)`` of the units of a text, in characters."""
    at = 0
    for m in _SPLIT[kind].finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _units(kind: str, min_words: int):
    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["id", "unit", "start", "stop", "digest"]
        for batch in batches:
            out = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                for unit, (start, stop) in enumerate(_cut(text, kind)):
                    if stop - start < 2 * min_words - 1:
                        continue
                    norm = normalise(text[start:stop])
                    if not norm or norm.count(" ") + 1 < min_words:
                        continue
                    for col, v in zip(out, (doc_id, unit, start, stop, hashlib.md5(norm.encode(), usedforsecurity=False).digest())):
                        col.append(v)
                if len(out[0]) > 20_000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names)
                    out = ([], [], [], [], [])
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return run


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class _Passages:
    """The passages of a block of texts: ``starts`` are the words that begin one."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, size: int):
        self.size = size
        words, self.first = word_hashes(buf, offs)
        self.lanes = [Rolling(words, m) for m in LANES]
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        at = np.arange(max(0, len(words) - size + 1))
        self.starts = at[self.row[at] == self.row[at + size - 1]]
        self._text = buf, offs

    def stretches(self, gram: int):
        """Smallest hash, first and last passage of every stretch."""
        if not len(self.starts):
            return np.zeros(0, np.uint64), self.starts, self.starts
        at = np.arange(len(self.row) - gram + 1)
        least = _least(self.lanes[0].of(at, at + gram), self.size - gram + 1)[self.starts]
        new = np.append(True, (least[1:] != least[:-1]) | (np.diff(self.starts) != 1))
        return least[new], self.starts[new], self.starts[np.append(new[1:], True)]

    def digests(self, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Both halves of the digests of the passages ``begin`` to ``end``."""
        return [lane.of(begin, end + self.size).view(np.int64) for lane in self.lanes]

    def places(self, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Row, first and last passage counted within it, and the characters that
        they cover together."""
        start, stop, base = self._characters
        row = self.row[begin]
        zero = self.first[row]
        return [row, begin - zero, end - zero, start[begin] - base[row], stop[end + self.size - 1] - base[row]]

    @cached_property
    def _characters(self):
        """Characters of the block before each word's start and end, and each row."""
        buf, offs = self._text
        chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
        start, stop = word_bounds(buf, offs)
        return chars[start], chars[stop], chars[offs]


def _batch(ids: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(ids)] + [pa.array(c) for c in columns.values()], ["id", *columns])


def _stretches(size: int, gram: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for base, buf, offs in blocks(batch.column(1)):
                found = _Passages(buf, offs, size)
                least, begin, end = found.stretches(gram)
                row, a, b, start, stop = found.places(begin, end)
                lo, hi = found.digests(begin, end)
                yield _batch(ids[base + row], {"least": least.view(np.int64), "a": a, "b": b, "start": start, "stop": stop, "lo": lo, "hi": hi})

    return run


def _singles(size: int):
    """Rows (id, text, at: first and last passage of stretches) -> the passages."""

    def run(batches):
        for batch in batches:
            ids, at = batch.column(0).to_numpy(), batch.column(2)
            for base, buf, offs in blocks(batch.column(1)):
                found = _Passages(buf, offs, size)
                for i in range(len(offs) - 1):
                    spans = at[base + i].as_py()
                    for part in range(0, len(spans), 1024):  # bounded rows a batch
                        begin = found.first[i] + np.concatenate([np.arange(s["a"], s["b"] + 1) for s in spans[part : part + 1024]])
                        _, a, b, start, stop = found.places(begin, begin)
                        lo, hi = found.digests(begin, begin)
                        yield _batch(np.full(len(a), ids[base + i]), {"a": a, "b": b, "start": start, "stop": stop, "lo": lo, "hi": hi})

    return run


def _later(rows: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``again``: whether an equal one comes earlier, and not so near
    before that both overlap."""
    rows = join_counted(rows, groups, ["lo", "hi"], "left")
    near = (F.col("first.id") == F.col("id")) & (F.col("a") - F.col("first.a") < size)
    return rows.withColumn("again", F.coalesce(~near, F.lit(False))).drop("first")


def passages(docs: DataFrame, ws: Workspace, id_col: str, text_col: str = "text", size: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """One row per repeated passage: id, ``unit`` (its first word in the text, from
    0), ``start`` and ``stop`` (characters), ``n_words``.

    A run of ``size`` words repeats when an equal run comes earlier (smaller id,
    then position) in the table, other than one in the same text that overlaps it.
    A row of the result is a longest run of words that lie in such runs.  Ids are
    unique and not null (see :func:`common.keyed`); null and shorter texts have no
    passages.  Digests have 128 bits of sums over 64-bit word hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    places = "a long, b long, start long, stop long, lo long, hi long"
    marks = ws.keep(rows.mapInArrow(_stretches(size, gram), f"id long, least long, {places}"), "stretches")
    # a stretch as long as a passage can repeat within itself
    weight = F.when(F.col("b") - F.col("a") >= size, 2).otherwise(1)
    hot = marks.groupBy("least").agg(F.sum(weight).alias("n"), (F.min("lo") != F.max("lo")).alias("mixed")).where("n > 1")
    marks = ws.keep(join_counted(marks, ws.keep(hot.select("least", "mixed"), "hashes"), "least"), "shared")
    ws.drop("stretches")
    first = F.min(F.struct("id", "a")).alias("first")
    groups = lambda x: x.groupBy("lo", "hi").agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    marks = ws.keep(_later(marks, ws.keep(groups(marks), "equal"), size), "told")
    some = marks.where(~F.col("again") & (F.col("mixed") | (F.col("b") - F.col("a") >= size)))
    some = ws.keep(some.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("at")), "open")
    texts = join_counted(rows, some, "id", size="at").select("id", "text", "at")
    single = ws.keep(texts.mapInArrow(_singles(size), f"id long, {places}"), "singles")
    single = _later(single, ws.keep(groups(single), "equal-singles"), size)
    span = ["id", "a", "b", "start", "stop"]
    gone = marks.where("again").select(span).unionByName(single.where("again").select(span))
    # all pieces of one text, whose number its length bounds
    order = Window.partitionBy("id").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gone = gone.withColumn("new", F.coalesce(F.col("a") > reach + size, F.lit(True)).cast("int"))
    gone = gone.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gone = gone.groupBy("id", "run").agg(F.min("a").alias("unit"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("b").alias("b"))
    return gone.select(F.col("id").alias(id_col), "unit", "start", "stop", (F.col("b") + size - F.col("unit")).alias("n_words"))


def lines(docs: DataFrame, ws: Workspace, id_col: str, text_col: str = "text", kind: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated line (or paragraph): id, ``unit`` (its number in the
    text), ``start`` and ``stop`` (characters), ``digest`` (md5 of the normalised
    unit, hex), ``n_copies`` (occurrences in the table), ``kept_id`` and ``kept_unit``
    (the occurrence that stays: smallest id, then first unit).  Ids are unique and
    not null.  Counts are combined before the shuffle, and a digest that many units
    share is joined by Spark's skew-splitting join, so no group is gathered.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    units = ws.keep(rows.mapInArrow(_units(kind, min_words), "id long, unit long, start long, stop long, digest binary"), "units")
    groups = units.groupBy("digest").agg(F.count("*").alias("n_copies"), F.min(F.struct("id", "unit")).alias("first")).where("n_copies > 1")
    groups = ws.keep(groups.select("digest", "n_copies", F.col("first.id").alias("kept_id"), F.col("first.unit").alias("kept_unit")), "groups")
    found = join_counted(units, groups, "digest").where("id <> kept_id or unit <> kept_unit")
    return found.select(F.col("id").alias(id_col), "unit", "start", "stop", F.lower(F.hex("digest")).alias("digest"), "n_copies", "kept_id", "kept_unit")


def repeats(
    docs: DataFrame,
    ws: Workspace,
    id_col: str = "doc_id",
    text_col: str = "text",
    kind: str = "line",
    min_words: int = MIN_WORDS,
    size: int = PASSAGE,
) -> DataFrame:
    """One row per removed occurrence, of :func:`lines` (``kind`` line or paragraph)
    and of :func:`passages` (kind passage; digest, copies and what stays are null):
    id, ``kind``, ``unit``, ``start``, ``stop``, ``digest``, ``n_copies``,
    ``kept_id``, ``kept_unit``.  Rows of both kinds may cover the same characters.

    Null and empty texts have no units; ids are unique and not null (see
    :func:`common.keyed`, which numbers rows that repeat or lack one); an empty
    table gives no row; further columns are not read.
    """
    whole = lines(docs, ws, id_col, text_col, kind, min_words).withColumn("kind", F.lit(kind))
    parts = passages(docs, ws, id_col, text_col, size, min(GRAM, (size + 1) // 2)).drop("n_words").withColumn("kind", F.lit("passage"))
    both = whole.unionByName(parts, allowMissingColumns=True)
    return both.select(id_col, "kind", "unit", "start", "stop", "digest", "n_copies", "kept_id", "kept_unit")


def _strip(batches):
    for batch in batches:
        at = batch.schema.names.index("_quillspark_text")
        cuts = batch.schema.names.index("_quillspark_cuts")
        texts, spans = [], []
        for text, cut in zip(batch.column(at).to_pylist(), batch.column(cuts).to_pylist()):
            if not cut or text is None:
                texts.append(text)
                spans.append([] if not text else [{"start": 0, "stop": len(text)}])
                continue
            parts, kept, last = [], [], 0
            for c in sorted({(c["start"], c["stop"]) for c in cut}):
                # the break after a removed unit goes with it, or the one before the last
                start, stop = c
                stop = stop + 1 if stop < len(text) else stop
                if start > last:
                    kept.append({"start": last, "stop": start})
                    parts.append(text[last:start])
                last = max(last, stop)
            if last < len(text):
                kept.append({"start": last, "stop": len(text)})
                parts.append(text[last:])
            texts.append("".join(parts))
            spans.append(kept)
        batch = batch.set_column(at, "_quillspark_text", pa.array(texts, pa.string()))
        yield batch.set_column(cuts, "_quillspark_kept", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))


def remove(docs: DataFrame, removed: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", spans: str | None = None) -> DataFrame:
    """``docs`` without the units that ``removed`` (of :func:`repeats`) lists.

    All columns are kept; with ``spans`` a column of that name has the kept
    parts' offsets in the original text.  Texts of which nothing is left are
    empty; rows without an id stay as they are.  Only the affected rows' spans
    travel: they are broadcast when their counted number allows it."""
    cuts = removed.groupBy(id_col).agg(F.collect_list(F.struct("start", "stop")).alias("_quillspark_cuts"))
    cuts = ws.keep(cuts.where(F.col(id_col).isNotNull()).withColumnRenamed(id_col, "_quillspark_cut_id"), "cuts")
    rows = docs.select(*[F.col(f"`{c}`").alias("_quillspark_text" if c == text_col else c) for c in docs.columns])
    rows = join_counted(rows.withColumn("_quillspark_cut_id", F.col(id_col).cast("long")), cuts, "_quillspark_cut_id", "left", size="_quillspark_cuts").drop("_quillspark_cut_id")
    kinds = dict(rows.dtypes)
    fields = ", ".join(f"`{'_quillspark_kept' if c == '_quillspark_cuts' else c}` {'array<struct<start:bigint,stop:bigint>>' if c == '_quillspark_cuts' else kinds[c]}" for c in rows.columns)
    done = rows.mapInArrow(_strip, fields)
    names = [F.col("_quillspark_text").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*names, *([F.col("_quillspark_kept").alias(spans)] if spans else []))
