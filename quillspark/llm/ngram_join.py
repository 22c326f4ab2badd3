"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact check.

Every document is the set of its distinct word shingles.  Two documents link
when ``100 * |A & B| >= percent * |A | B|``.

* A *tile* holds the documents of one size band that share a rare shingle.  With
  shingles in one global order (rarest slot first) two linked sets always share
  one of the first ``n - ceil(n * percent / 100) + 1``, so no link is lost.
* In a tile the hashed bitmaps of two sets bound their overlap from above:
  every bit that only A has stands for an element that B lacks.
* What the bound leaves is checked by intersecting the sorted shingle arrays.

Copies with equal sets are one *class*.  Short tiles test all their pairs; a
long tile first tests the members of each band against the band's smallest set,
and only members that are still unconnected afterwards are tested against each
other, so a group of thousands of near copies never becomes all of its pairs
while no link between unconnected sets is missed.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, join_counted
from .wordvec import mix, shingle_sets

#: Slots of the shingle frequency table: a fixed 2**21 counters.
SLOTS = 1 << 21
#: A tile of at most so many sets tests all of its pairs at once.
SHORT = 12
#: Times that loose sets are tested against one member before all of them are.
ROUNDS = 2
#: Rows of a long tile in one chunk of it; a task compares two chunks at a time.
CHUNK = 4096
#: Documents that hold a shingle's slot beyond which its tile is salted.
HOT = 8192
#: Bits of a prefix row's size column that hold the size.
SALT_BITS = 32
#: Prefix rows of one partition.
PREFIX_ROWS = 4_000_000
#: Members of one band leader that one task checks.
SALT = 512


def least_overlap(na, nb, percent: int):
    """Smallest intersection that links sets of sizes ``na`` and ``nb``."""
    return -((-percent * (na + nb)) // (100 + percent))


def signature(grams: np.ndarray) -> bytes:
    """Bitmap of the hashed shingles: eight times the set size in bits, rounded
    up to a power of two, so that few shingles share a bit."""
    bits = 64
    while bits < 8 * len(grams):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(grams >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def overlap_bound(a: bytes, na: int, b: bytes, nb: int) -> int:
    """Upper bound of the intersection from the bit counts of two signatures."""
    x, y, wa, wb = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a) * 8, len(b) * 8
    while wa > wb:
        wa //= 2
        x = (x >> wa) | (x & ((1 << wa) - 1))
    while wb > wa:
        wb //= 2
        y = (y >> wb) | (y & ((1 << wb) - 1))
    return min(na - (x & ~y).bit_count(), nb - (y & ~x).bit_count())


def _set_key(grams: np.ndarray) -> int:
    total = mix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _describe(width: int):
    """doc rows -> set size, set key and signature; a last row has slot counts."""

    def run(batches):
        slots = np.zeros(SLOTS, np.uint32)
        seen = False
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), ([], [], [], [])
            for row, grams in shingle_sets(batch.column(1), width):
                seen = True
                n = len(grams)
                out[0].append(ids[row])
                out[1].append(n)
                out[2].append(_set_key(grams) if n else None)
                out[3].append(signature(grams) if n else None)
                np.add.at(slots, (grams & np.uint64(SLOTS - 1)).astype(np.int64), np.uint32(1))
            yield pa.record_batch(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.binary()), pa.nulls(len(out[0]), pa.binary())],
                ["id", "n", "skey", "sig", "slots"],
            )
        if seen:
            yield pa.record_batch(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([_squeeze(slots)], pa.binary())],
                ["id", "n", "skey", "sig", "slots"],
            )

    return run


def _squeeze(slots: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(slots.tobytes(), asbytes=True)


def _unsqueeze(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, 4 * SLOTS, asbytes=True), np.uint32)


def _add_slots(batches):
    total = np.zeros(SLOTS, np.uint32)
    for batch in batches:
        for x in batch.column(0):
            total += _unsqueeze(x.as_py())
    yield pa.record_batch([pa.array([_squeeze(total)], pa.binary())], ["slots"])


def _slot_counts(ws: Workspace, parts: DataFrame) -> np.ndarray:
    """Sum of the tasks' slot counts, eight at a time in a task."""
    turn, n = 0, parts.count()
    while n > 8:
        turn, n = turn + 1, -(-n // 8)
        parts = ws.keep(parts.repartition(n).mapInArrow(_add_slots, "slots binary"), f"slots-{turn}")
        n = min(n, parts.count())
    total = np.zeros(SLOTS, np.uint32)
    for r in parts.toLocalIterator():
        total += _unsqueeze(r[0])
    return total


def slot_levels(counts: np.ndarray, mean: float | None = None) -> np.ndarray:
    """Frequency level of each slot, four to a doubling of the count (0..255)."""
    mean = max(1.0, float(counts.mean())) if mean is None else mean
    return np.clip(np.floor(4 * np.log2(1.0 + counts / mean)), 0, 255).astype(np.uint8)


def slot_salts(counts: np.ndarray) -> np.ndarray:
    """Parts of the tiles of a slot's shingles: as many as keep each below HOT rows."""
    return np.minimum(np.ceil(counts / HOT), 1 << 20).astype(np.int64)


def _slot_order(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the tasks need of the counts: levels, and the salts of the few slots that
    have several, by slot; taken in parts, so that the driver holds little at once."""
    mean = max(1.0, float(counts.mean()))
    levels = np.concatenate([slot_levels(part, mean) for part in np.split(counts, 32)])
    many = np.flatnonzero(counts > HOT)
    return levels, many, slot_salts(counts[many])


def _prefixes(width: int, percent: int, levels):
    """Rows (token, skey, size) of every distinct set's prefix.  ``size`` holds the set's
    size and above SALT_BITS the part of the tile, from 1; 0 where the tile is whole."""

    def run(batches):
        (order, *several), done = levels.value, set()
        salts = np.ones(SLOTS, np.uint32)
        salts[several[0]] = several[1]
        for batch in batches:
            tok, key, part = [], [], []
            for _, grams in shingle_sets(batch.column(1), width):
                n = len(grams)
                if not n or (k := _set_key(grams)) in done:
                    continue
                done.add(k)
                slot = (grams & np.uint64(SLOTS - 1)).astype(np.int64)
                ranked = (order[slot].astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))
                p = n - least_share(n, percent) + 1
                first = np.argpartition(ranked, p - 1)[:p] if p < n else np.arange(n)
                tok.append(ranked[first])
                parts = salts[slot[first]].astype(np.int64)
                part.append(np.where(parts > 1, k % np.maximum(parts, 1) + 1, 0) << SALT_BITS | n)
                key.append(np.full(len(tok[-1]), k, np.int64))
            if tok:
                yield pa.record_batch(
                    [pa.array(np.concatenate(tok).view(np.int64)), pa.array(np.concatenate(key)), pa.array(np.concatenate(part))],
                    ["token", "skey", "size"],
                )

    return run


def least_share(n: int, percent: int) -> int:
    """Smallest overlap with a set of size ``n`` that any linked set has."""
    return -((-percent * n) // 100)


def _tiles(percent: int):
    """Rows sorted by (token, size, skey) -> candidate pairs (kind 0: a, b) and
    the rows of long tiles (kind 1: a = token, b = skey, n).  A part of a salted tile
    counts as long, so that its rows meet those of the other parts later."""

    def pairs_of(tok, key, both, opened):
        """Whole tiles, or parts of the tile of token ``opened``, which is long."""
        salt, n = both >> SALT_BITS, (both & ((1 << SALT_BITS) - 1)).astype(np.int32)
        cut = np.flatnonzero(np.append(True, (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])))
        size = np.diff(np.append(cut, len(tok)))
        long = (size > SHORT) | (salt[cut] > 0)
        if opened is not None:
            long |= tok[cut] == opened
        rows = np.flatnonzero(np.repeat((size > 1) & ~long, size))
        left, right = [], []
        t, k, m = tok[rows], key[rows], n[rows].astype(np.int64)
        for d in range(1, SHORT):
            if len(t) <= d:
                break
            ok = (t[d:] == t[:-d]) & (k[d:] != k[:-d]) & (100 * m[:-d] >= percent * m[d:])
            if not ok.any():
                continue
            left.append(k[:-d][ok])
            right.append(k[d:][ok])
        posts = []
        for i in np.flatnonzero(long):
            s, e = int(cut[i]), int(cut[i] + size[i])
            m, k = n[s:e].astype(np.int64), key[s:e]
            at = 0
            while at < len(m):  # bands of the tile; the smallest set leads
                to = int(np.searchsorted(m, m[at] * 100 // percent, "right"))
                to = max(to, at + 1)
                other = k[at + 1 : to]
                other = other[other != k[at]]
                left.append(np.full(len(other), k[at], np.int64))
                right.append(other)
                at = to
            posts.append((tok[s:e], k, n[s:e]))
        return left, right, posts

    def emit(left, right, posts):
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            both = np.unique(np.stack([lo, hi], 1), axis=0)
            yield pa.record_batch(
                [pa.array(np.zeros(len(both), np.int32)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.zeros(len(both), np.int32))],
                ["kind", "a", "b", "n"],
            )
        for t, k, n in posts:
            yield pa.record_batch([pa.array(np.ones(len(t), np.int32)), pa.array(t), pa.array(k), pa.array(n)], ["kind", "a", "b", "n"])

    def run(batches):
        held = opened = None
        left, right, held_pairs = [], [], 0
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            tok = cols[0]
            if not len(tok):
                continue
            last = int(np.searchsorted(tok, tok[-1], "left"))
            if last == 0 and len(tok) > 200_000:  # one long tile: pass it on in parts
                last = len(tok)
            held = [c[last:] for c in cols]
            l, r, posts = pairs_of(*[c[:last] for c in cols], opened) if last else ([], [], [])
            opened = tok[-1] if last == len(tok) else opened
            left += l
            right += r
            held_pairs += sum(map(len, l))
            yield from emit([], [], posts)
            if held_pairs > 500_000:
                yield from emit(left, right, [])
                left, right, held_pairs = [], [], 0
        if held is not None and len(held[0]):
            l, r, posts = pairs_of(*held, opened)
            yield from emit(left + l, right + r, posts)
        elif left:
            yield from emit(left, right, [])

    return run


def _fold(sigs: list[bytes], width: int) -> np.ndarray:
    """Signatures as rows of 64-bit words; those of twice ``width`` bytes are
    folded to it (a bit position is the hash modulo the width)."""
    out = np.zeros((len(sigs), width // 8), np.uint64)
    for i, x in enumerate(sigs):
        v = np.frombuffer(x, np.uint64)
        out[i] = v if len(x) == width else v[: width // 8] | v[width // 8 :]
    return out


def _close(i, others, n, comp, sig_i, sigs, percent):
    """Which of ``others`` set ``i`` can link with by component, size and bits."""
    ok = (comp[others] != comp[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))
    j = np.flatnonzero(ok)
    if not len(j):
        return others[:0]
    only = n[i] - np.bitwise_count(sig_i & ~sigs[j]).sum(axis=1, dtype=np.int64)
    other = n[others[j]] - np.bitwise_count(sigs[j] & ~sig_i).sum(axis=1, dtype=np.int64)
    return others[j[np.minimum(only, other) >= least_overlap(n[i], n[others[j]], percent)]]


def _open_pairs(percent: int):
    """Rows (tile, chunk, other, n, skey, comp, probe, home, sig), sorted by (tile,
    chunk, other) -> pairs of unconnected sets that sizes and bit counts allow.  In
    two chunks every probe meets every home row once."""

    def of_chunk(rows):
        n, key, comp, probe, home = (np.array(rows[c]) for c in ("n", "skey", "comp", "probe", "home"))
        sig = rows["sig"]
        width = np.array([len(x) for x in sig])
        for w in np.unique(width[probe]):
            mine = np.flatnonzero(probe & (width == w))
            for wide in (w, 2 * w, w // 2):
                there = np.flatnonzero(home & (width == wide))
                if not len(there):
                    continue
                low = int(min(w, wide))
                left = _fold([sig[i] for i in mine], low)
                for at in range(0, len(there), 4096):
                    some = there[at : at + 4096]
                    right = _fold([sig[j] for j in some], low)
                    for x, i in enumerate(mine):
                        k = key[_close(i, some, n, comp, left[x], right, percent)]
                        if len(k):
                            yield np.minimum(k, key[i]), np.maximum(k, key[i])

    def run(batches):
        a, b, many, held = [], [], 0, None

        def flush():
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            return pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

        def chunks():
            nonlocal held
            for batch in batches:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
                if not len(held):
                    continue
                keys = np.stack([held.column(c).to_numpy().astype(np.int64) for c in ("tile", "chunk", "other")])
                cut = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
                for s, e in zip(cut[:-1], cut[1:]):
                    yield held.slice(s, e - s).to_pydict()
                held = held.slice(cut[-1])
            if held is not None and len(held):
                yield held.to_pydict()

        for rows in chunks():
            for x, y in of_chunk(rows):
                a.append(x)
                b.append(y)
                many += len(x)
            if many > 1_000_000:
                yield flush()
                a, b, many = [], [], 0
        if a:
            yield flush()

    return run


def _bounded(percent: int):
    def run(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(i).to_pylist() for i in range(6))
            keep = [overlap_bound(sa[i], na[i], sb[i], nb[i]) >= least_overlap(na[i], nb[i], percent) for i in range(len(a))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(width: int, percent: int):
    """Rows (lead, salt, member, text) sorted so that the leader's text (member
    null) comes first -> verified links."""

    def run(batches):
        lead = own = None
        for batch in batches:
            leads, members = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            u, v = [], []
            for row, grams in shingle_sets(batch.column(3), width):
                if members[row] is None:
                    lead, own = leads[row], grams
                elif lead == leads[row]:
                    common = len(np.intersect1d(own, grams, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(grams) - common):
                        u.append(lead)
                        v.append(members[row])
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _check(ws: Workspace, docs: DataFrame, reps: DataFrame, pairs: DataFrame, name: str, width: int, percent: int) -> DataFrame:
    """Candidate pairs of set keys -> links between representatives' ids."""
    need = pairs.select(F.col("a").alias("skey")).unionAll(pairs.select(F.col("b").alias("skey"))).distinct()
    reps = ws.keep(join_counted(reps, ws.keep(need, f"{name}-need"), "skey"), f"{name}-sigs")
    side = lambda s: reps.select(F.col("skey").alias(s), F.col("rep").alias(f"r{s}"), F.col("n").alias(f"n{s}"), F.col("sig").alias(f"s{s}"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b").select("ra", "rb", "na", "nb", "sa", "sb")
    left = ws.keep(wide.mapInArrow(_bounded(percent), "ra long, rb long"), f"{name}-bounded")
    # the end with more partners leads, so that a hub's text is shipped once
    deg = left.select(F.col("ra").alias("x")).unionAll(left.select(F.col("rb").alias("x"))).groupBy("x").agg(F.count("*").alias("deg"))
    deg = ws.keep(deg, f"{name}-degree")
    d = lambda s: deg.select(F.col("x").alias(f"r{s}"), F.col("deg").alias(f"d{s}"))
    lead = left.join(d("a"), "ra").join(d("b"), "rb")
    first = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("ra") < F.col("rb")))
    lead = lead.select(
        F.when(first, F.col("ra")).otherwise(F.col("rb")).alias("lead"),
        F.when(first, F.col("rb")).otherwise(F.col("ra")).alias("member"),
        F.floor(F.greatest("da", "db") / SALT).cast("int").alias("salts"),
    )
    lead = ws.keep(lead.withColumn("salt", F.pmod(F.hash("member"), F.col("salts") + 1)), f"{name}-lead")
    texts = join_counted(docs, deg.select(F.col("x").alias("_id")), "_id", "inner")
    texts = ws.keep(texts.select(F.col("_id").alias("x"), F.col("_text").alias("text")), f"{name}-texts")
    heads = lead.select(F.col("lead").alias("x"), "salt").distinct().join(texts, "x")
    rows = heads.select(F.col("x").alias("lead"), "salt", F.lit(None).cast("long").alias("member"), "text").unionByName(
        lead.withColumnRenamed("member", "x").join(texts, "x").select("lead", "salt", F.col("x").alias("member"), "text")
    )
    rows = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", F.col("member").asc_nulls_first())
    links = ws.keep(rows.mapInArrow(_verify(width, percent), "u long, v long"), f"{name}-links")
    ws.drop(f"{name}-texts")
    return links


def _loose(ws: Workspace, posts: DataFrame, joined: DataFrame, name: str) -> DataFrame:
    """Rows of the long tiles that hold several components: ``dense`` is the
    component with most rows of the tile, ``loose`` marks the others' rows."""
    rows = posts.join(joined, F.col("rep") == F.col("node"), "left").select("token", "skey", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    rows = ws.keep(rows, f"{name}-state")
    shares = rows.groupBy("token", "comp").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("dense"), F.count("*").alias("comps")).where("comps > 1")
    return rows.join(ws.keep(mixed.select("token", "dense"), f"{name}-mixed"), "token").withColumn("loose", F.col("comp") != F.col("dense"))


def similar(
    docs: DataFrame,
    ws: Workspace,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``.

    ``component_id`` is the smallest id reachable over links, itself included.
    Null and empty texts, and texts of white space, have no shingles and link
    with nothing; equal texts link through their common set; rows that repeat
    an id each give a row; an empty table gives an empty result; further
    columns of ``docs`` are not read, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    spark = docs.sparkSession
    told = ws.keep(docs.mapInArrow(_describe(width), "id long, n long, skey long, sig binary, slots binary"), "sets")
    total = _slot_counts(ws, told.where("slots is not null").select("slots"))
    levels = spark.sparkContext.broadcast(_slot_order(total))

    sets = told.where("slots is null").select("id", "n", "skey", "sig")
    reps = ws.keep(
        sets.where("n > 0").groupBy("skey").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "reps"
    )
    prefixes = docs.mapInArrow(_prefixes(width, percent, levels), "token long, skey long, size long")
    # every prefix row is a few bytes, so partitions sized by the text would be small
    total_rows = int(total.sum(dtype=np.int64)) * (100 - percent) // 100
    del total
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_rows // PREFIX_ROWS))
    salt = F.shiftright("size", SALT_BITS)
    tiles = prefixes.repartition(parts, "token", salt).sortWithinPartitions("token", "size", "skey")
    found = ws.keep(tiles.mapInArrow(_tiles(percent), "kind int, a long, b long, n int"), "tiles")
    levels.destroy()  # nothing lazy reads the prefixes
    pairs = ws.keep(found.where("kind = 0").select("a", "b").distinct(), "pairs")
    links = _check(ws, docs, reps, pairs, "lead", width, percent)
    joined = ws.keep(components(ws, links, "cc1"), "joined")

    # long tiles: members that are still in different components
    posts = found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("skey"), "n").distinct()
    posts = posts.join(reps.select("skey", "rep"), "skey").select("token", "skey", "rep", F.col("n").cast("long").alias("n"))
    posts = ws.keep(posts, "posts")
    tested, all_links = pairs, links
    for turn in range(ROUNDS):
        state = _loose(ws, posts, joined, f"round{turn}")
        # each loose set is tested against one member of the component it meets:
        # first the one with the most links, later ones by chance
        deg = all_links.select(F.col("u").alias("rep")).unionAll(all_links.select(F.col("v").alias("rep"))).groupBy("rep").agg(F.count("*").alias("deg"))
        order = F.struct(F.coalesce("deg", F.lit(0)).alias("o"), "skey") if turn == 0 else F.struct(F.xxhash64("skey", F.lit(turn)).alias("o"), "skey")
        heads = state.where("not loose").select("dense", "skey", "rep", "n").distinct().join(deg, "rep", "left")
        heads = heads.groupBy("dense").agg(F.max_by(F.struct("skey", "n"), order).alias("head"))
        near = state.where("loose").select("dense", "skey", "n").distinct().join(heads, "dense")
        near = near.where(f"100 * least(n, head.n) >= {percent} * greatest(n, head.n)")
        near = near.select(F.least("skey", "head.skey").alias("a"), F.greatest("skey", "head.skey").alias("b")).distinct()
        near = ws.keep(near.join(tested, ["a", "b"], "left_anti"), f"round{turn}-pairs")
        all_links = all_links.unionByName(_check(ws, docs, reps, near, f"round{turn}", width, percent))
        tested = tested.unionByName(near)
        joined = ws.keep(components(ws, all_links, f"round{turn}-cc"), f"round{turn}-joined")

    # what is still apart: loose sets against the dense component of their tile,
    # once per component, and against each other, tile by tile
    state = _loose(ws, posts, joined, "open")
    sized = reps.select("skey", "sig")
    dense = state.where("not loose").select("dense", "skey", "n", F.col("dense").alias("comp")).distinct()
    probes = state.where("loose").select("dense", "skey", "n", "comp").distinct()
    size = lambda rows, name: rows.groupBy("dense").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    grid = ws.keep(size(dense, "chunks").join(size(probes, "others"), "dense"), "open-chunks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.hash("skey"), F.col(n))
    place = lambda chunk, other, probe: [F.col("dense").alias("tile"), chunk.alias("chunk"), other.alias("other"), "n", "skey", "comp", F.lit(probe).alias("probe"), F.lit(not probe).alias("home")]
    dense = dense.join(grid, "dense").select(*place(own("chunks"), every("others"), False))
    probes = probes.join(grid, "dense").select(*place(every("chunks"), own("others"), True))
    apart = state.where("loose").select("token", "skey", "n", "comp")
    mixed = apart.groupBy("token").agg(F.count("*").alias("all"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    mixed = ws.keep(mixed.select("token", F.ceil(F.col("all") / CHUNK).cast("int").alias("chunks")), "open-tiles")
    apart = apart.join(mixed, "token").withColumn("own", own("chunks")).withColumn("at", every("chunks"))
    # a chunk's rows are at home with every later chunk and probe every earlier one;
    # the tile of a token is told from that of a component by its sign bit
    apart = apart.select(
        F.col("token").bitwiseOR(F.lit(-(1 << 63))).alias("tile"), F.least("own", "at").alias("chunk"), F.greatest("own", "at").alias("other"), "n", "skey", "comp",
        (F.col("own") >= F.col("at")).alias("probe"), (F.col("own") <= F.col("at")).alias("home"),
    )
    columns = ["tile", "chunk", "other", "n", "skey", "comp", "probe", "home", "sig"]
    rows = dense.unionByName(probes).unionByName(apart).join(sized, "skey").select(*columns)
    rows = rows.repartition(parts, "tile", "chunk", "other").sortWithinPartitions("tile", "chunk", "other")
    more = rows.mapInArrow(_open_pairs(percent), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")
    more = ws.keep(more, "open-pairs")
    late = _check(ws, docs, reps, more, "late", width, percent)
    final = ws.keep(components(ws, all_links.unionByName(late), "cc2"), "components")

    named = reps.join(final, F.col("rep") == F.col("node"), "left").select(
        "skey", F.coalesce("component", "rep").alias("component_id")
    )
    named = ws.keep(named, "named")
    return sets.join(named, "skey", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )
