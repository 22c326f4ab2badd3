"""Toxicity by two class-conditional Kneser-Ney bigram models.

A model interpolates three orders by absolute discounting, each a distribution:

* bigrams: how often a word follows another one in the class's texts,
* words of the class: how many distinct words stand before a word in them,
* words of the corpus: the same count over all texts, shared by both classes.

An expression (word or bigram) has figures of its own class only where the classes'
texts hold it unequally beyond chance; rare and even ones are left to the order
below, words to the shared counts, whose mass is scaled so that probabilities still
sum to 1.  A text's feature is the difference of its two log-likelihoods divided by
its length; a logistic curve fitted on rows that the models have not seen turns it
into a score.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_counted
from .wordvec import PLAIN, blocks, mix, word_hashes

#: Labelled rows of one class and one role (models, calibration) used at most,
#: chosen by the hash of their id; the only bounded sample here.
MAX_ROWS = 12_000
#: Absolute discount of the models, and the least count of a kept bigram.
DISCOUNT = 0.75
LEAST = 2
#: Hashes that a task holds before it passes the distinct ones on.
HELD = 4_000_000
#: Bytes of text for one range of hashes.
RANGE_BYTES = 32 << 20
#: Standard deviations beyond which a difference between classes counts.
CHANCE = 3.0
THRESHOLD = 0.7
#: The column of the score beside all columns of a table.
SCORE = "_quillspark_score"


def _bigrams(buf, offs):
    """Word hashes, their predecessors (0 starts a text), bigram keys and the
    first word of every row."""
    words, first = word_hashes(buf, offs, PLAIN)
    words = np.maximum(words, np.uint64(1))
    prev = np.zeros_like(words)
    prev[1:] = words[:-1]
    heads = first[:-1][first[:-1] < first[1:]]
    prev[heads] = 0
    return words, prev, _key(prev, words), first


def _key(prev: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(prev * np.uint64(0xD6E8FEB86659FD93) + words)


def _place(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``x`` is in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def _pack(x: np.ndarray) -> bytes:
    """Numbers: a few as they are, many with equal places of all together,
    compressed; the zero bytes of small ones go."""
    if len(x) < 32:
        return x.tobytes()
    return pa.Codec("zstd").compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), asbytes=True)


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    if n < 32:
        return np.frombuffer(data, kind)
    width = np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(data, width * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _distinct(needed, parts: int):
    """Per task: the distinct bigrams that end in needed words (``i`` is -3) with the
    indices of those, all other ones (-1), so each is sent once, and the distinct words
    (-2), in ``parts`` ranges of hashes: three rows a range at most.  Sorted hashes go
    as their differences."""
    width = (1 << 64) // parts + 1
    edges = np.array([p * width for p in range(1, parts)], np.uint64)

    def rows(i: int, x: np.ndarray, word: np.ndarray):
        x, at = np.unique(x, return_index=True)
        cut = np.append(0, np.append(np.searchsorted(x, edges), len(x)))
        some = np.flatnonzero(cut[1:] > cut[:-1])
        lo, hi, word = cut[some], cut[some + 1], word[at] if len(word) else word
        names = [_pack(word[a:b]) for a, b in zip(lo, hi)]
        yield pa.record_batch(
            [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), i, np.int32)), pa.array(hi - lo), pa.array([_pack(np.diff(x[a:b], prepend=x.dtype.type(0))) for a, b in zip(lo, hi)], pa.binary()), pa.array(names, pa.binary())],
            ["part", "i", "n", "hashes", "words"],
        )

    def run(batches):
        table = needed.value
        held, size = [], 0

        def flush():
            for i, kind in zip((-1, -2, -3), zip(*held)):
                yield from rows(i, *(np.concatenate(c) for c in zip(*kind)))

        for batch in batches:
            for _, buf, offs in blocks(batch.column(0)):
                words, _, key, _ = _bigrams(buf, offs)
                if not len(words):
                    continue
                key, at = np.unique(key, return_index=True)
                kinds = np.unique(words)
                i, hit = _place(table, words[at])
                none = np.zeros(0, np.int32)
                held.append(((key[~hit], none), (kinds, none), (key[hit], i[hit].astype(np.int32))))
                size += len(key) + len(kinds)
                if size > HELD:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    return run


def _united(batches):
    """Rows sorted by (part, i) -> the number of distinct hashes of each.  Hashes are
    sorted anew when as many are new as are held, so each is a few times at most."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    last, held, names, new, waiting, done = None, *none, [], 0, []

    def unite():
        nonlocal held, names, new, waiting
        held, at = np.unique(np.concatenate([held, *(x for x, _ in new)]), return_index=True)
        if last[1] == -3:  # an entry's word is that of its bigram
            names = np.concatenate([names, *(w for _, w in new)])[at]
        new, waiting = [], 0

    def counted():
        nonlocal done
        told, done = done, []
        return pa.record_batch([pa.array([i for i, _ in told], pa.int32()), pa.array([n for _, n in told], pa.int64())], ["i", "n"])

    def close():
        if last is not None:
            unite()
            done.append((-2 if last[1] == -2 else -1, len(held)))
            word, n = np.unique(names, return_counts=True)
            done.extend(zip(word.tolist(), n.tolist()))

    for batch in batches:
        for part, i, n, data, word in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if (part, i) != last:
                close()
                last, (held, names) = (part, i), none
            new.append((np.cumsum(_unpack(data, n, np.uint64)), _unpack(word, n if i == -3 else 0, np.int32)))
            waiting += n
            if waiting > max(len(held), 1 << 20):
                unite()
        yield counted()
    close()
    yield counted()


def shared_counts(ws: Workspace, texts: DataFrame, needed: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Over all texts: the distinct words before each of the needed words (sorted
    hashes), the number of distinct bigrams, and that of distinct words.  All are
    exact; a range of hashes is united in one task, and ranges grow in number with
    the texts."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(needed)
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    found = texts.mapInArrow(_distinct(sent, parts), "part int, i int, n long, hashes binary, words binary")
    found = found.repartition(parts, "part").sortWithinPartitions("part", "i").mapInArrow(_united, "i int, n long")
    found = found.groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    i, n = (found.column(c).to_numpy() for c in ("i", "n"))
    count = np.zeros(len(needed))
    count[i[i >= 0]] = n[i >= 0]
    return count, int(n[i == -1].sum()), int(n[i == -2].sum())


def _class_counts(batches):
    """By class, the documents that hold each bigram (d) and its occurrences (c), and
    the documents that hold each word (not ``pair``)."""
    for batch in batches:
        label = batch.column(1).to_numpy()
        for base, buf, offs in blocks(batch.column(0)):
            words, prev, key, first = _bigrams(buf, offs)
            if not len(words):
                continue
            row = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(first))
            toxic = label[base : base + len(offs) - 1].astype(np.int64)
            for pair, u, k in ((True, prev, key), (False, np.zeros_like(words), words)):
                _, at, inv = np.unique(k, return_index=True, return_inverse=True)
                _, once = np.unique(mix(k + row * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                counts = []
                for rows in (once, np.arange(len(k))):
                    t = np.bincount(inv[rows], weights=toxic[row[rows].astype(np.int64)], minlength=len(at)).astype(np.int64)
                    counts += [np.bincount(inv[rows], minlength=len(at)) - t, t]
                columns = [np.full(len(at), pair), u[at].view(np.int64), words[at].view(np.int64), *counts]
                yield pa.record_batch([pa.array(c) for c in columns], ["pair", "u", "w", "d0", "d1", "c0", "c1"])


def _take(values: np.ndarray, at: np.ndarray, hit: np.ndarray, default: float) -> np.ndarray:
    return np.where(hit, values[at], default) if len(values) else np.full(len(at), default)


@dataclass
class Model:
    """Sorted hashes of the expressions in which the models differ, and their
    figures, a row per class.  A context that is not listed has the same figures in
    both classes and cancels out, and so does the shared count of a word that is
    not, so sizes depend on MAX_ROWS only."""

    keys: np.ndarray  # kept bigrams
    kept: np.ndarray  # their discounted counts
    contexts: np.ndarray  # first words of kept bigrams
    total: np.ndarray  # words after a context
    back: np.ndarray  # mass that a context passes to the lower order
    words: np.ndarray  # words that tell or end a kept bigram
    lower: np.ndarray  # lower-order probability of a word
    rest: np.ndarray  # factor of the shared counts of all other words
    slope: float = 0.0
    offset: float = 0.0

    def ratio(self, column: pa.Array) -> np.ndarray:
        """Length-normalised log-likelihood difference of every text, 0 without
        words."""
        out = np.zeros(len(column))
        for base, buf, offs in blocks(column):
            words, prev, key, first = _bigrams(buf, offs)
            if not len(words):
                continue
            at, hit = _place(self.keys, key)
            ctx, known = _place(self.contexts, prev)
            word, listed = _place(self.words, words)
            logs = []
            for k in (0, 1):
                n = _take(self.total[k], ctx, known, 0.0)
                top = _take(self.kept[k], at, hit, 0.0)
                back, low = _take(self.back[k], ctx, known, 1.0), _take(self.lower[k], word, listed, self.rest[k])
                logs.append(np.log(np.where(n > 0, top / np.maximum(n, 1), 0) + back * low))
            gain = np.append(0.0, np.cumsum(logs[1] - logs[0]))
            n = np.diff(first)
            out[base : base + len(n)] = (gain[first[1:]] - gain[first[:-1]]) / np.maximum(n, 1)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        z = np.clip(self.slope * self.ratio(column) + self.offset, -30, 30)
        return 1 / (1 + np.exp(-z))


def _telling(c0, c1, share: float, root):
    """Whether the counts of an expression differ between the classes by more
    than chance would have them (arrays or columns); the others are left to the
    shared counts."""
    expected = (c0 + c1) * share
    gap = c1 - expected
    return (gap > CHANCE * root(expected + 1)) | (-gap > CHANCE * root(expected + 1))


def _model(words: pa.Table, contexts: pa.Table, bigrams: pa.Table, size: list, types: list, shared) -> Model:
    """``words(w, n0, n1)`` tell the classes apart and have continuation counts,
    ``bigrams(u, w, c0, c1)`` do and have occurrences, ``contexts(u, c0, c1)`` are
    their first words; ``size`` and ``types`` are the classes' distinct bigrams and
    words.  ``shared`` looks the corpus's counts up, which are smoothed by one."""

    def columns(t, *names):
        return [t.column(x).to_numpy().view(np.uint64) if x in "uw" else t.column(x).to_numpy().astype(np.float64) for x in names]

    w, *n = columns(words, "w", "n0", "n1")
    bu, bw, *c = columns(bigrams, "u", "w", "c0", "c1")
    u, *total = columns(contexts, "u", "c0", "c1")
    by = np.argsort(u)
    u, total = u[by], np.array([x[by] for x in total]).reshape(2, -1)
    needed = np.union1d(w, bw)
    count, all_counts, kinds = shared(needed)
    base = (count + 1.0) / (all_counts + max(1, kinds))
    at, _ = _place(needed, w)
    key = _key(bu, bw)
    order = np.argsort(key)
    ctx, _ = _place(u, bu)
    back, lower, kept, factors = [], [], [], []
    for k in (0, 1):
        passed = DISCOUNT * types[k] / size[k] if types[k] else 1.0  # every count is 1 at least
        own = np.maximum(n[k] - DISCOUNT, 0) / max(1, size[k]) + passed * base[at]
        factors.append((1 - own.sum()) / (1 - base[at].sum()))
        low = factors[k] * base
        low[at] = own
        lower.append(low)
        own = np.maximum(c[k] - DISCOUNT, 0)
        mass = np.bincount(ctx, weights=own, minlength=len(u))
        back.append(np.where(total[k] > 0, 1 - mass / np.maximum(total[k], 1), 1.0))
        kept.append(own[order])
    return Model(key[order], np.array(kept), u, total, np.array(back), needed, np.array(lower), np.array(factors))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps with a weak prior; both classes weigh the
    same, so the score does not depend on how rare label 1 is."""
    if not len(y) or y.min() == y.max():
        return (1.0, 0.0) if len(y) else (0.0, 0.0)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    scale = x.std() or 1.0
    design, beta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - 0.1 * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        det = hess[0, 0] * hess[1, 1] - hess[0, 1] * hess[1, 0]
        step = np.array([hess[1, 1] * grad[0] - hess[0, 1] * grad[1], hess[0, 0] * grad[1] - hess[1, 0] * grad[0]]) / det
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(beta[0] / scale)), float(beta[1])


def held_out(id_col):
    """Whether a row is never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(ws: Workspace, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Of the rows that are not held out three quarters make the models, the others
    the calibration.  Null labels and ids, and ids that carry both labels, are not
    learnt from; null texts count as empty; rows that repeat an id are learnt from as
    often as they come.  Without rows of both classes, or with empty tables, nothing
    tells the classes apart and every text scores 0.5.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    role = F.when(F.pmod(F.xxhash64(F.col("id").cast("long"), F.lit(7)), F.lit(4)) == 0, F.lit(2)).otherwise(F.lit(0))
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("id", "toxic")
    known = known.where(~held_out("id")).withColumn("role", role)
    have = {(r[0], r[1]): r[2] for r in known.groupBy("toxic", "role").count().collect()}
    share = F.lit(1.0)
    for (toxic, part), n in have.items():
        if n > MAX_ROWS:
            share = F.when((F.col("toxic") == toxic) & (F.col("role") == part), F.lit(MAX_ROWS / n)).otherwise(share)
    chosen = ws.keep(known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)), "chosen")
    texts = ws.keep(join_counted(rows, chosen, "id").select("text", "toxic", "role"), "training")
    counts = texts.where("role = 0").select("text", "toxic").mapInArrow(_class_counts, "pair boolean, u long, w long, d0 long, d1 long, c0 long, c1 long")
    counts = ws.keep(counts.groupBy("pair", "u", "w").agg(*[F.sum(x).alias(x) for x in ("d0", "d1", "c0", "c1")]), "counts")
    pairs = counts.where("pair")
    # words after distinct words, by class
    before = [F.sum((F.col(c) > 0).cast("long")).alias(n) for c, n in (("c0", "n0"), ("c1", "n1"))]
    words = counts.where("not pair").select("w", "d0", "d1").join(pairs.groupBy("w").agg(*before), "w")
    words = ws.keep(words, "words")
    sums = [F.coalesce(F.sum(x), F.lit(0)) for x in (*map(F.col, ("d0", "d1", "n0", "n1")), (F.col("n0") > 0).cast("long"), (F.col("n1") > 0).cast("long"))]
    d0, d1, *size, t0, t1 = words.agg(*sums).first()
    told = _telling(F.col("d0"), F.col("d1"), d1 / max(1, d0 + d1), F.sqrt)
    # what is collected is bounded by the telling expressions of MAX_ROWS texts
    kept = ws.keep(pairs.where((F.col("d0") + F.col("d1") >= LEAST) & told), "kept")
    contexts = join_counted(pairs, ws.keep(kept.select("u").distinct(), "contexts"), "u", "left_semi")
    contexts = contexts.groupBy("u").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    shared = lambda needed: shared_counts(ws, rows.select("text"), needed)
    model = _model(words.where(told).toArrow(), contexts.toArrow(), kept.toArrow(), size, [t0, t1], shared)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def ratios(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(sent.value.ratio(batch.column(0))), batch.column(1)], ["x", "toxic"])

    fit = texts.where("role = 2").select("text", "toxic").mapInArrow(ratios, "x double, toxic int").toArrow()
    model.slope, model.offset = _calibrate(fit.column("x").to_numpy(), fit.column("toxic").to_numpy())
    sent.destroy()
    pa.default_memory_pool().release_unused()  # the driver keeps the model only
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``(doc_id, score)``, or with ``keep`` all columns of ``docs`` and the score
    under :data:`SCORE`.  Null and empty texts get the score of a text without
    evidence; repeated rows get one each; other columns play no part."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col) if keep else 1

    def run(batches):
        for batch in batches:
            score = pa.array(sent.value.score(batch.column(at)))
            if keep:
                yield batch.append_column(SCORE, score)
            else:
                yield pa.record_batch([batch.column(0), score], [id_col, "score"])

    if keep:
        return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", {SCORE} double")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, score double")
