"""Each operator against a brute-force version on small hostile inputs."""
import gzip
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from quillspark.llm import bpe, codec, embedding_dedup, exact_dedup, license_scan, ngram_join, packing, sstable, substring_dedup, tokens, toxicity, warc  # noqa: E402
from quillspark.llm.common import ROW, Workspace, components, keyed, named  # noqa: E402

BYTES, WORDS = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, h string, _id int, norm string, n long"
HOSTILE = [None, "", "  ", "a", "a ", " a\n", "b", "Straße 🙂 日本", "x" * 30_000, "same words here " * 40, "same words here " * 40, "<|endoftext|> 1 22 it's"]


def frame(spark, texts, parts=3):
    rows = [(i, t, "h", 1, "x", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def groups(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(0, i) for i in range(200, 260)]
    got = {r["node"]: r["component"] for r in components(Workspace(spark, "t"), spark.createDataFrame(links, "u long, v long")).collect()}
    want = groups(300, links)
    assert all(got[i] == want[i] for i in got) and all(want[i] == i and i not in want[:i] + want[i + 1 :] for i in range(300) if i not in got)
    assert components(Workspace(spark, "t"), spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_in_one_task(spark, monkeypatch):
    """Few edges take no rounds, each of which is a dozen jobs; both ways find the same."""
    from quillspark import workspace

    rng, marked, mark = np.random.default_rng(5), [], workspace._mark
    monkeypatch.setattr(workspace, "_mark", lambda edges: marked.append(1) or mark(edges))
    links = [(i, i + 1) for i in range(100, 400)] + [tuple(x) for x in rng.integers(1000, 1600, (400, 2)).tolist()] + [(-7, 3), (9, 9)]
    edges = spark.createDataFrame(links, "u long, v long")
    rows = lambda: sorted(map(tuple, workspace.components(Workspace(spark, "t"), edges).collect()))
    found = rows()
    assert len(marked) == 1
    monkeypatch.setattr(workspace, "TASK_EDGES", 10)
    assert found == rows() and len(marked) > 3 and (3, -7) in found and (400, 100) in found


def test_slots_of_one_part_send_no_salts(monkeypatch):
    """The salts of the 2 M slots took 16 MB of every process; few slots have several."""
    counts = np.zeros(ngram_join.SLOTS, np.uint32)
    counts[[5, 70]] = ngram_join.HOT, 3 * ngram_join.HOT + 1
    levels, many, salts = ngram_join._slot_order(counts)
    assert (many.tolist(), salts.tolist()) == ([70], [4])
    assert (levels == ngram_join.slot_levels(counts)).all() and levels.nbytes == ngram_join.SLOTS


# -- 1 ---------------------------------------------------------------------------
@pytest.mark.parametrize("bits,hot", [(64, 256), (2, 256), (64, 3), (2, 3)])
def test_exact(spark, bits, hot):
    rng = random.Random(2)
    texts = HOSTILE + ["".join(rng.choice("ab \t\n") for _ in range(rng.randrange(5))) for _ in range(200)]
    got = {r["doc_id"]: r for r in exact_dedup.dedup(frame(spark, texts), Workspace(spark, "t"), capacity=4, max_depth=4, hash_bits=bits, hot=hot).collect()}
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    assert len(got) == len(texts)
    for norm, ids in by.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (keep, len(ids), i == keep)
            assert got[i]["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()


def test_directory_doubles():
    load = [10] * 8 + [1] * 56
    buckets = exact_dedup.build_directory(load, capacity=20)
    assert [b.start for b in buckets] == sorted({b.start for b in buckets})
    assert sum(b.load for b in buckets) == sum(load) and sum(64 >> b.depth for b in buckets) == 64
    assert max(b.load for b in buckets) <= 20 and len({b.depth for b in buckets}) > 1 and not any(b.pages for b in buckets)
    for b in buckets:  # the shallowest that fits: its parent would be overfull
        parent = b.start - b.start % (128 >> b.depth)
        assert not b.depth or sum(load[parent : parent + (128 >> b.depth)]) > 20
    over = exact_dedup.build_directory([100, 0], capacity=20)
    assert over == [(0, 1, 100, 3), (1, 1, 0, 0)] and exact_dedup.build_directory([0, 0]) == [(0, 0, 0, 0)]


def test_exact_reads_its_pages_through_the_directory(spark, monkeypatch):
    """Owners hold ranges of hashes; with a wrong directory at the probe nothing is found."""
    texts, ws = [f"text {i % 70}" for i in range(100)], Workspace(spark, "t")
    out = exact_dedup.dedup(frame(spark, texts), ws, capacity=8, max_depth=6)
    assert out.count() == 100
    pages = spark.read.parquet(ws.path("pages"))
    spans = pages.groupBy(F.input_file_name().alias("f")).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).orderBy("lo").collect()
    assert len(spans) > 1 and all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))
    assert pages.groupBy("bucket").agg(F.count_distinct("h").alias("n")).agg(F.max("n")).first()[0] <= 8
    whole = exact_dedup.route
    wrong = lambda keys, directory, depth: whole(keys, directory.withColumn("bucket", F.col("bucket") + F.lit(0 if "norm" in keys.columns else 1)), depth)
    monkeypatch.setattr(exact_dedup, "route", wrong)
    assert exact_dedup.dedup(frame(spark, texts), Workspace(spark, "t"), capacity=8, max_depth=6).count() == 0


def test_exact_empty(spark):
    assert exact_dedup.dedup(frame(spark, []), Workspace(spark, "t")).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "ab"), (3, "ab"), (3, "ab")], "doc_id long, text string")
    got = [tuple(r)[:4] for r in exact_dedup.dedup(rows, Workspace(spark, "t")).collect()]
    assert sorted(got, key=str) == [(3, 3, 4, True)] * 0 + sorted([(None, None, 4, True), (None, None, 4, True), (3, None, 4, False), (3, None, 4, False)], key=str)


# -- 2 ---------------------------------------------------------------------------
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_texts():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(5)]
    out = HOSTILE + ["one two", "One  two", "a b c d e f", "A b c d e"]
    for _ in range(140):
        w = base[rng.randrange(3) if rng.random() < 0.9 else 4].split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"z{rng.randrange(30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("short,hot,chunk", [(12, 8192, 1024), (2, 3, 3)])
def test_ngram_join(spark, short, hot, chunk, monkeypatch):
    """Short and long tiles, salted ones, and chunks of a few rows."""
    for name, value in (("SHORT", short), ("HOT", hot), ("CHUNK", chunk)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar(frame(spark, texts), Workspace(spark, "t")).collect()}
    assert got == {i: (len(sets[i]), c) for i, c in enumerate(groups(len(texts), links))}


def test_bounds():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 3000, n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in rng.integers(1, 400, 2))
        bound = ngram_join.overlap_bound(ngram_join.signature(a), len(a), ngram_join.signature(b), len(b))
        assert bound >= len(np.intersect1d(a, b))
        assert ngram_join.least_overlap(len(a), len(b), 75) == min(k for k in range(3000) if 100 * k >= 75 * (len(a) + len(b) - k))


def test_long_tile_in_parts():
    """A tile that comes in many batches loses no member."""
    n = 260_000
    key = np.arange(n, dtype=np.int64)
    batches = [pa.record_batch([pa.array(np.full(len(k), 7, np.int64)), pa.array(k), pa.array(np.full(len(k), 9, np.int64))], ["token", "skey", "size"]) for k in np.array_split(key, 30)]
    posts = sum(int((b.column(0).to_numpy() == 1).sum()) for b in ngram_join._tiles(75)(iter(batches)))
    assert posts == n


# -- 3, 5 ------------------------------------------------------------------------
ODD = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "ß", "\x1c", "\x85", "<|endoftext|>", "<|end", "日本", "🙂", "́", "İ", "Σ", "!", "...", "\r\n", "　", "A", "ŉ", "×"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=14).map("".join), st.sampled_from([1, 3, 7, 1 << 16]))
def test_streaming_bpe(text, chunk):
    table, library = bpe.load(BYTES), tokenizers.Tokenizer.from_file(BYTES)
    want = library.encode(text, add_special_tokens=False).ids
    enc, out = bpe.Encoder(table), []
    for at in range(0, len(text), chunk):
        out += enc.feed(text[at : at + chunk])
    out += enc.finish()
    ids = b"".join(out)
    assert np.frombuffer(ids, "<u4").tolist() == want
    machine = bpe.Decoder(table)
    assert "".join(machine.feed(ids[i : i + 4]) for i in range(0, len(ids), 4)) + machine.finish() == library.decode(want, skip_special_tokens=False)


def test_window_keeps_long_runs_exact():
    table, library, rng = bpe.load(BYTES), tokenizers.Tokenizer.from_file(BYTES), random.Random(5)
    assert 0 < table.lookahead < table.window
    parts = [x.decode("utf-8", "ignore") for x in table.bytes if x.isalpha()]
    for source in (parts, ["a"], ["ab", "ba", "a"], ["th", "e", "ing", "er"]):
        text = "".join(rng.choice(source) for _ in range(6000))[:12_000]
        for piece in (text, " " * 5000 + text[:50] + "\n" * 3000, "1" * 5000 + "!" * 5000):
            assert np.frombuffer(b"".join(bpe.encode(table, piece)), "<u4").tolist() == library.encode(piece, add_special_tokens=False).ids


def test_codec(spark):
    library = tokenizers.Tokenizer.from_file(BYTES)
    rows = codec.decode(codec.encode(frame(spark, HOSTILE), BYTES).select("doc_id", F.octet_length("ids").alias("size"), "ids"), BYTES).collect()
    assert {r["doc_id"]: (r["size"] // 4, r["text"]) for r in rows} == {i: (len(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in enumerate(HOSTILE)}


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_column_encoder(path):
    rng, library = random.Random(6), tokenizers.Tokenizer.from_file(path)
    plain = ["the", "a", " ", ".", ",", "B", "12", " the", "\n", "é", "-", "(", "<", "|"]
    texts = HOSTILE + ["".join(rng.choice(ODD if k % 2 else plain) for _ in range(rng.randrange(12))) for k in range(4000)]
    for i, ids in tokens.encoder(path).encode(pa.array(texts)):
        assert ids.tolist() == library.encode(texts[i] or "", add_special_tokens=False).ids


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    library, ws = tokenizers.Tokenizer.from_file(BYTES), Workspace(spark, "t")
    rows = [(i * 7 - 20, t) for i, t in enumerate(HOSTILE)] + [(None, "null id"), (-20, "again")]
    sstable.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ws.path("s"), BYTES, 0)
    got = sstable.read(spark, ws.path("s")).collect()
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [0]
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((k, np.array(ids(t), "<u4").tobytes()) for k, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    found = sstable.lookup(spark, ws.path("s"), [-20, 1, 999, None]).collect()
    assert Counter(r["doc_id"] for r in found) == {-20: 2, 1: 1, None: 1}
    sstable.write(spark.createDataFrame([], "doc_id long, text string"), ws.path("e"), BYTES, 0)
    assert sstable.read(spark, ws.path("e")).count() == 0


# -- 4 ---------------------------------------------------------------------------
def test_patterns_hold_every_piece():
    rng = np.random.default_rng(7)
    for n in (0, 1, 40, 3000):
        counts = Counter(int(x) for x in np.clip(rng.lognormal(3, 1, n), 1, 64))
        plan, used = packing.plan_patterns(dict(counts), 64), Counter()
        for pattern, times in plan:
            assert sum(s * k for s, k in pattern.items()) <= 64
            for s, k in pattern.items():
                used[s] += k * times
        assert used == counts
        if n == 3000:
            assert sum(t for _, t in plan) <= 1.02 * sum(s * k for s, k in counts.items()) / 64 + 2


def test_pack(spark):
    rng = random.Random(8)
    texts = HOSTILE + [" ".join(rng.choice(["alpha", "beta", "gamma9", "x!"]) for _ in range(int(rng.lognormvariate(4, 1)))) for _ in range(150)]
    library, ws = tokenizers.Tokenizer.from_file(WORDS), Workspace(spark, "t")
    rows = packing.pack(frame(spark, texts), ws, WORDS, 2, capacity=256, unit=4)
    got, docs, seqs = rows.collect(), defaultdict(list), defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    total = 0
    for i, t in enumerate(texts):
        ids, at = library.encode(t or "", add_special_tokens=False).ids + [2], 0
        total += len(ids)
        for r in sorted(docs[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert total >= 0.93 * 256 * len(seqs)
    twice = spark.createDataFrame([(1, "alpha"), (1, "beta gamma9"), (None, "x!"), (None, None)], "doc_id long, text string")
    own = Workspace(spark, "t")
    ids = [r["ids"] for r in packing.sequences(own, packing.pack(twice, own, WORDS, 2, capacity=2, unit=1)).collect()]
    flat = [x for t in ("alpha", "beta gamma9", "x!", "") for x in [*library.encode(t, add_special_tokens=False).ids, 2]]
    assert sorted(x for i in ids for x in np.frombuffer(i, "<u4")) == sorted(flat)
    whole = packing.sequences(ws, rows).collect()
    assert {r["sequence_id"]: len(r["ids"]) // 4 for r in whole} == {k: sum(p["length"] for p in v) for k, v in seqs.items()}


# -- 6 ---------------------------------------------------------------------------
def test_toxicity(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = [f"w{int(rng.paretovariate(0.8)) % 500}" for _ in range(rng.randrange(30, 120))]
        for _ in range(4 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "scum"])
        texts.append(" ".join(words))
        labels.append((i, 1 if bad else 0))
    texts += [None, ""]
    docs = frame(spark, texts)
    marks = spark.createDataFrame(labels + [(None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(Workspace(spark, "t"), docs, marks)
    rows = toxicity.score(docs, model).withColumn("held", toxicity.held_out("doc_id")).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(r["score"] >= 0.7, r["doc_id"] % 5 == 0) for r in rows if r["held"] and r["doc_id"] < 600]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.05 * len(held)
    assert toxicity.score(docs.limit(0), model).count() == 0


def kneser_ney(texts, marks, discount=0.75, least=2, chance=3.0):
    """Both models by brute force: (class, previous word, word) -> probability, and
    the corpus's words."""
    cut = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").lower())
    pairs = lambda t: list(zip([""] + cut(t), cut(t)))
    everything = {p for t in texts for p in pairs(t)}
    shared, vocabulary = Counter(w for _, w in everything), {w for _, w in everything}
    base = lambda w: (shared[w] + 1) / (len(everything) + len(vocabulary))
    occur, docs, held = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for t, y in marks:
        occur[y].update(pairs(t))
        docs[y].update(set(pairs(t)))
        held[y].update(set(cut(t)))
    share = sum(held[1].values()) / (sum(held[0].values()) + sum(held[1].values()))

    def tells(a, b):
        e = (a + b) * share
        return abs(b - e) > chance * (e + 1) ** 0.5

    words = {w for w in held[0] | held[1] if tells(held[0][w], held[1][w])}
    bigrams = {p for p in docs[0] | docs[1] if docs[0][p] + docs[1][p] >= least and tells(docs[0][p], docs[1][p])}
    before = [Counter(w for _, w in occur[k]) for k in (0, 1)]
    after = [Counter() for _ in (0, 1)]
    for k in (0, 1):
        for (u, _), c in occur[k].items():
            after[k][u] += c

    def low(k, w):
        passed = discount * len(before[k]) / len(occur[k])
        own = lambda x: max(before[k][x] - discount, 0) / len(occur[k]) + passed * base(x)
        if w in words:
            return own(w)
        return base(w) * (1 - sum(map(own, words))) / (1 - sum(map(base, words)))

    def probability(k, u, w):
        top = {x: max(occur[k][p] - discount, 0) for p in bigrams if p[0] == u for x in [p[1]]}
        if not after[k][u]:
            return low(k, w)
        return top.get(w, 0) / after[k][u] + (1 - sum(top.values()) / after[k][u]) * low(k, w)

    return probability, vocabulary, pairs, (words, bigrams)


def test_toxicity_is_kneser_ney(spark):
    """The model's log-likelihoods against brute force, and probabilities sum to 1."""
    rng = random.Random(31)
    texts = []
    for i in range(260):
        words = [f"w{int(rng.paretovariate(0.9)) % 30}" for _ in range(rng.randrange(5, 30))]
        for _ in range(3 if i % 4 == 0 else 0):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice([["Bad", "egg"], ["scum"]])
        texts.append(", ".join(words))
    texts += [None, "", "scum", "never seen"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(260)], "doc_id long, toxic int")
    ws = Workspace(spark, "t")
    model = toxicity.train(ws, docs, labels)
    fitted = spark.read.parquet(ws.path("training")).where("role = 0").select("text", "toxic").collect()
    probability, vocabulary, pairs, told = kneser_ney(texts, fitted)
    assert told[0] >= {"bad", "scum"} and ("bad", "egg") in told[1] and len(model.words) <= len(vocabulary) / 2
    for k in (0, 1):
        for u in ("", "bad", "w1", "scum", "unseen"):
            assert abs(sum(probability(k, u, w) for w in vocabulary) - 1) < 1e-9
    got = model.ratio(pa.array(texts))
    for t, x in zip(texts, got):
        want = [np.log(probability(1, u, w) / probability(0, u, w)) for u, w in pairs(t)]
        assert abs(x - (sum(want) / len(want) if want else 0)) < 1e-9


def test_toxicity_without_evidence(spark):
    empty = frame(spark, [])
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    for docs, marks in ((empty, labels), (frame(spark, ["a b", None]), labels.limit(0)), (frame(spark, ["a b"] * 9), labels)):
        model = toxicity.train(Workspace(spark, "t"), docs, marks)
        assert all(0.3 < r["score"] < 0.7 for r in toxicity.score(docs, model).collect())


def test_toxicity_words_stay_apart(spark):
    """Words are told apart by 64 bits of their hash, whatever the vocabulary."""
    words = pa.array([f"w{i}" for i in range(200_000)])
    seen = [toxicity._bigrams(buf, offs)[0] for _, buf, offs in toxicity.blocks(words)]
    assert len(np.unique(np.concatenate(seen))) == len(words)
    rows = [" ".join(f"w{i}" for i in range(a, a + 500)) for a in range(0, 100_000, 500)]
    needed = np.sort(toxicity._bigrams(*next(toxicity.blocks(pa.array(["w7"])))[1:])[0])
    count, total, kinds = toxicity.shared_counts(Workspace(spark, "t"), frame(spark, rows).select("text"), needed)
    assert (count.tolist(), total, kinds) == ([1], 100_000, 100_000)


def test_toxicity_shared_counts_are_of_distinct_predecessors(spark):
    docs = frame(spark, ["a b"] * 50 + ["c b c b", None, ""])
    needed = np.unique(toxicity._bigrams(*next(toxicity.blocks(pa.array(["b"])))[1:])[0])
    # before b: a, c; all: ^a ab ^c cb bc
    count, total, kinds = toxicity.shared_counts(Workspace(spark, "t"), docs.select("text"), needed)
    assert (count.tolist(), total, kinds) == ([2], 5, 3)


def test_toxicity_sends_a_bigram_once():
    """Whether it ends in a needed word or not; and the needed words' indices are packed."""
    rng = random.Random(5)
    texts = pa.array([" ".join(f"w{rng.randrange(60)}" for _ in range(300)) for _ in range(40)])
    seen = [toxicity._bigrams(buf, offs) for _, buf, offs in toxicity.blocks(texts)]
    keys, words = (np.unique(np.concatenate([s[k] for s in seen])) for k in (2, 0))

    class needed:
        value = words[::2]

    rows = [r for b in toxicity._distinct(needed, 3)(iter([pa.record_batch([texts], ["text"])])) for r in b.to_pylist()]
    assert sum(r["n"] for r in rows if r["i"] != -2) == len(keys) and sum(r["n"] for r in rows if r["i"] == -2) == len(words)
    ends = [r for r in rows if r["i"] == -3]
    assert ends and sum(len(r["words"]) for r in ends) < 2 * sum(r["n"] for r in ends)
    totals = Counter()
    for b in toxicity._united(iter([pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: (r["part"], r["i"])), pa.schema([("part", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("words", pa.binary())]))])):
        for r in b.to_pylist():
            totals[r["i"]] += r["n"]
    assert totals.pop(-1) == len(keys) and totals.pop(-2) == len(words)
    ends_in = np.unique(np.concatenate([s[2][np.isin(s[0], needed.value)] for s in seen]))
    assert sum(totals.values()) == len(ends_in)


# -- 7 ---------------------------------------------------------------------------
def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 64)
    rng = np.random.default_rng(10)
    base = rng.normal(size=(300, 16))
    rows = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.12, base[0] + rng.normal(size=(150, 16)) * 0.12, base[1:2].repeat(5, 0)])
    vectors = [[float(x) for x in v] for v in rows] + [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, []]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, pivot string").repartition(3)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, Workspace(spark, "t")).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    close = (unit @ unit.T) >= 0.95
    np.fill_diagonal(close, False)
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(vectors) and 0.9 * close.sum() <= found <= close.sum()
    assert all(got[i]["n_links"] <= close[i].sum() for i in range(len(rows)))
    want = groups(len(rows), list(zip(*np.nonzero(close))))
    assert sum(got[i]["component_id"] == want[i] for i in range(len(rows))) >= 0.9 * len(rows)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(len(rows), len(vectors)))
    assert embedding_dedup.near_duplicates(df.limit(0), Workspace(spark, "t")).count() == 0


def test_embeddings_lose_no_link(spark):
    """Few usable vectors among many nulls, several lengths, very large and very small
    components, copies and scaled copies, repeated and null ids."""
    near = lambda vectors, ids=None: embedding_dedup.near_duplicates(
        keyed(spark.createDataFrame(list(zip(ids or range(len(vectors)), vectors)), "vec_id long, embedding array<double>"), ws, "vec_id"), ws, id_col=ROW
    ).orderBy(ROW).collect()
    ws = Workspace(spark, "t")
    got = near([None] * 3000 + [[1.0, 2.0]] + [None] * 3000 + [[1.0, 2.0]])
    assert [r["n_links"] for r in got] == [0] * 3000 + [1] + [0] * 3000 + [1] and got[-1]["component_id"] == 3000
    got = near([[1.0, 0.0, 0.0]] * 2 + [[0.0, 1.0]] * 3 + [[2.0, 0.0, 1e-9]] + [[1.0]] + [[-1.0]] + [[3.0]])
    assert [(r["n_links"], r["component_id"]) for r in got] == [(2, 0), (2, 0), (2, 2), (2, 2), (2, 2), (2, 0), (1, 6), (0, 7), (1, 6)]
    got = near([[1e200, 1e200], [1e-200, 1e-200], [5e-324, 5e-324], [1e308, -1e308], [float("inf"), 1.0], [0.0, -0.0]])
    assert [r["n_links"] for r in got] == [2, 2, 2, 0, 0, 0]
    got = near([[1.0, 2.0], [1.0, 2.0], [1.0, 2.1], None, [5.0, -1.0]], [7, 7, None, 7, None])
    assert sorted(r["n_links"] for r in got) == [0, 0, 2, 2, 2] and len({r[ROW] for r in got}) == 5


def test_embeddings_hot_group(spark):
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(10_000, 64))
    rows[::3] = rows[0] + rng.normal(size=rows[::3].shape) * 0.17 * np.linalg.norm(rows[0]) / 8
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(8)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, Workspace(spark, "t")).collect()}
    want = sum(int(((unit[a : a + 1000] @ unit.T) >= 0.95).sum()) for a in range(0, len(rows), 1000)) - len(rows)
    assert 0.98 * want <= sum(r["n_links"] for r in got.values()) <= want
    assert {got[i]["component_id"] for i in range(0, len(rows), 3)} == {0}
    # a table of one hot group has a single pivot
    few = embedding_dedup.near_duplicates(df.where("vec_id % 3 = 0 and vec_id < 600"), Workspace(spark, "t")).collect()
    some = unit[: 600 : 3]
    assert sum(r["n_links"] for r in few) == ((some @ some.T) >= 0.95).sum() - len(some)


# -- 8 ---------------------------------------------------------------------------
def test_licenses(spark):
    lines = {
        "Released under the MIT license.": "mit",
        "Licensed under the Apache License, Version 2.0": "apache-2.0",
        "LICENSED UNDER CC BY-SA 4.0": "cc-by-sa",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
        "Licensed under the Frobnicator License 7.": "unknown",
        "Available under the EUPL 1.2": "unknown",
        "This is free and unencumbered software (Unlicense)": "unknown",
        "He was licensed to drive a bus.": None,
        "Er kam mit dem Bus.": None,
        "": None,
    }
    docs = frame(spark, ["Intro.\n" + t for t in lines] + [None])
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in license_scan.scan(docs).collect()}
    assert got == {(i, 1): f for i, f in enumerate(lines.values()) if f}
    assert license_scan.scan(docs.limit(0)).count() == 0
    wrapped = "First.\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and\nassociated documentation files\nLast"
    got = license_scan.scan(frame(spark, [wrapped])).collect()
    assert [(r["paragraph"], r["family"]) for r in got] == [(1, "mit")] and got[0]["template_match"] == 1


def classified(text, model):
    """Class and its probability by brute force over one paragraph."""
    classes, rows, intercepts, heat = model
    z, grams = dict(zip(classes, intercepts)), set(license_scan.grams_of(text))
    for g, c, w in rows:
        z[c] += w if g in grams else 0
    total = sum(np.exp(v / heat) for v in z.values())
    p = {c: np.exp(v / heat) / total for c, v in z.items()}
    best = max((c for c in classes if c != "none"), key=p.get)
    return (best if p["none"] < 0.5 else "none"), p


def test_license_evidence_is_a_bound():
    """What the words' levels drop is none, for any mixture of the model's words."""
    model, rng = license_scan.train(), random.Random(41)
    steps = license_scan.evidence()
    level = {w: k + 1 for k, step in enumerate(steps) for w in step}
    vocabulary = sorted({w for t, _ in license_scan.sentences() for w in re.findall("[a-z0-9.]+", t.lower())})
    dropped = 0
    for _ in range(4000):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))
        if sum(level.get(w, 0) for w in set(re.split("[^a-z0-9]+", text))) <= license_scan.LEVELS:
            dropped += 1
            assert classified(text, model)[0] == "none"
    assert dropped > 100


def test_license_classes_on_held_out_sentences():
    """Every third sentence held out, as class and as template: licences are told from
    prose that was written to share their words; most families hold."""
    examples, found, false, wrong = license_scan.sentences(), [], [], []
    for fold in range(3):
        known = [e for i, e in enumerate(examples) if i % 3 != fold]
        model = license_scan.train(known)
        for t, c in examples[fold::3]:
            (best, p), grams = classified(t, model), set(license_scan.grams_of(t))
            (found if c != "none" else false).append(best != "none")
            share = max((len(grams & set(own)) / len(own) for x, k in known if k == best for own in [license_scan.grams_of(x)]), default=0)
            family = best if best in license_scan.TEMPLATES and p[best] >= license_scan.CONFIDENT and share >= license_scan.CONFIRMED else "unknown"
            if c != "none":
                wrong.append(best != "none" and family not in (c, "unknown"))
    print(f"held out: found {np.mean(found):.2f}, false {np.mean(false):.2f}, wrong family {np.mean(wrong):.2f}")
    assert np.mean(found) >= 0.8 and np.mean(false) <= 0.25 and np.mean(wrong) <= 0.15


def test_gram_columns_agree(spark):
    texts = ["Version 2.0. (the License); x", "SPDX-License-Identifier: MIT", ".5 a..b", "one", "Ü ß 1.2.3"]
    rows = frame(spark, texts).select("doc_id", F.array_sort(license_scan.gram_column(license_scan.words_column(F.col("text")))).alias("g")).collect()
    assert {r["doc_id"]: r["g"] for r in rows} == {i: license_scan.grams_of(t) for i, t in enumerate(texts)}


# -- 9 ---------------------------------------------------------------------------
def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n", "ü🙂\r\n\r\n", "x" * 50_000]
    pages = spark.createDataFrame([(i, f"http://h{i}.org/\r\nx", h, "t") for i, h in enumerate(html)], "page_id long, url string, html string, type string").repartition(3)
    ws = Workspace(spark, "t")
    warc.write(pages, ws.path("w"), ws)
    got = {r["capture"]: r for r in warc.assemble(warc.read(spark, ws.path("w"))).collect()}
    assert len(got) == len(html)
    first = {}
    for i, h in enumerate(html):
        data = (h or "").encode()
        r, seen = got[f"urn:capture:{i}:main"], first.setdefault(data, i)
        assert (r["main"]["payload_bytes"], r["main"]["digest"]) == (len(data), warc._digest(data))
        if seen == i:
            assert r["main"]["type"] == "response" and bytes(r["main"]["payload"]) == data and r["main"]["refers_to"] is None
        else:
            assert r["main"]["type"] == "revisit" and r["main"]["refers_to"] == f"urn:capture:{seen}:main"
        assert r["request"]["http"].startswith("GET http://") and f"Host: h{i}.org" in r["request"]["http"]
        assert bytes(r["metadata"]["payload"]).startswith(b"payload-bytes: ")
    warc.write(pages, ws.path("m"), ws, min_bytes=5)
    kinds = Counter(r["type"] for r in warc.read(spark, ws.path("m")).collect())
    assert kinds["revisit"] == 1 and kinds["response"] == len(html) - 1
    warc.write(pages.limit(0), ws.path("e"), ws)
    assert warc.read(spark, ws.path("e")).count() == 0


def test_warc_rows_that_repeat_or_lack_an_id(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1)
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "b"), (None, None, "a"), (2, "u", None)]
    ws = Workspace(spark, "t")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), ws.path("w"), ws)
    records = warc.read(spark, ws.path("w"))
    got = warc.assemble(records).collect()
    assert len(got) == 5 and Counter(r["main"]["type"] for r in got) == {"response": 3, "revisit": 2}
    assert sorted(re.findall(r"(?m)^page-id: (.*)\r$", "".join(r["metadata"]["payload"].decode() for r in got))) == ["1", "1", "2"]
    assert Counter(r["intact"] for r in records.collect()) == {True: 3, None: 12}
    assert len([f for f in os.listdir(ws.path("w").removeprefix("file://")) if f.startswith("part-")]) >= 5  # a capture a file


def test_warc_checks_payloads_and_form():
    data = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabcd\r\n\r\n"
    read = lambda x: next(iter(warc._parsed([pa.record_batch([pa.array([x], pa.binary())], ["content"])]))).to_pylist()
    good, bad = (read(gzip.compress(data % warc._digest(x).encode()))[0] for x in (b"abcd", b"abce"))
    assert (good["intact"], bad["intact"], good["payload"]) == (True, False, b"abcd")
    assert len(read(gzip.compress(data) + gzip.compress(data))) == 2
    for wrong in (b"WARX", data[:40], data[:-9], data + b"x"):
        with pytest.raises(ValueError):
            list(warc.parse(wrong))
    assert [h["warc-type"] for h, _ in warc.parse(data[i : i + 1] for i in range(len(data)))] == ["response"]


# -- 10 --------------------------------------------------------------------------
def spans_of(texts, size):
    """Repeated passages by brute force, rank by rank: (row, unit) -> offsets."""
    first, want = {}, {}
    for i, t in enumerate(texts):
        words = [(m.start(), m.end(), substring_dedup.normalise(m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        gone = set()
        for a in range(len(words) - size + 1):
            key = tuple(w[2] for w in words[a : a + size])
            d, at = first.setdefault(key, (i, a))
            if d != i or a - at >= size:
                gone.update(range(a, a + size))
        for a in sorted(gone):
            if a - 1 not in gone:
                b = a
                while b + 1 in gone:
                    b += 1
                want[i, a] = (words[a][0], words[b][1])
    return want


def lines_of(texts):
    seen, want = {}, {}
    for i, t in enumerate(texts):
        at = 0
        for u, line in enumerate((t or "").split("\n")):
            norm = substring_dedup.normalise(line)
            if len(norm.split(" ")) >= 20 and norm:
                if norm in seen:
                    want[i, u] = (at, at + len(line), *seen[norm])
                else:
                    seen[norm] = (i, u)
            at += len(line) + 1
    return want


def test_substrings(spark):
    rng = random.Random(11)
    common = [" ".join(f"c{k}w{i}" for i in range(25)) for k in range(4)]
    texts = list(HOSTILE)
    for i in range(60):
        lines = [" ".join(f"d{i}x{j}y{k}" for k in range(rng.randrange(1, 40))) for j in range(rng.randrange(4))]
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(common).replace("c", rng.choice("cC")).replace(" ", rng.choice([" ", "  "])))
        texts.append("\n".join(lines))
    want, parts = lines_of(texts), spans_of(texts, 50)
    ws, docs = Workspace(spark, "t"), frame(spark, texts)
    gone = substring_dedup.repeats(docs, ws)
    rows = gone.collect()
    assert {(r["doc_id"], r["unit"]): (r["start"], r["stop"], r["kept_id"], r["kept_unit"]) for r in rows if r["kind"] == "line"} == want
    assert {(r["doc_id"], r["unit"]): (r["start"], r["stop"]) for r in rows if r["kind"] == "passage"} == parts
    left = substring_dedup.remove(docs, gone, ws, spans="spans")
    assert left.columns == [*docs.columns, "spans"]
    for r in left.collect():
        text = texts[r["doc_id"]]
        cut = [s[:2] for (d, _), s in [*want.items(), *parts.items()] if d == r["doc_id"]]
        if text is None:
            assert r["text"] is None
            continue
        assert "".join(text[s["start"] : s["stop"]] for s in r["spans"]) == r["text"]
        kept = "".join(" " if any(a <= k < b for a, b in cut) else c for k, c in enumerate(text))
        assert r["text"].split() == kept.split()
    assert substring_dedup.repeats(docs.limit(0), ws).count() == 0


def test_passages(spark):
    """Passages at any place in lines, edited copies, self-repeats, very long and
    equal texts, ties."""
    rng = random.Random(12)
    word = lambda: rng.choice(["e", "é", "Wort", "WORT", "日本", "🙂x", "the", "a,", "b."]) + str(rng.randrange(40))
    shared = [[word() for _ in range(n)] for n in (50, 51, 60, 90, 200, 700)]
    texts = [*HOSTILE, "x " * 400, "x " * 400, " ".join(f"p{i % 30}" for i in range(300)), " ".join(f"p{i % 30}" for i in range(70))]
    for i in range(150):
        words = [word() for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            at, part = rng.randrange(len(words) + 1), list(rng.choice(shared))
            if rng.random() < 0.4:  # an edited or cut copy
                part[rng.randrange(len(part))] = word()
                part = part[rng.randrange(20) :]
            words[at:at] = [w.upper() if w.isascii() and rng.random() < 0.1 else w for w in part]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\t"]) for w in words))
    texts += [texts[40], texts[41] + "end", "long " + " ".join(word() for _ in range(30_000)) + " " + " ".join(shared[1])]
    for size in (50, 7):
        want = spans_of(texts, size)
        assert len(want) > 60
        got = substring_dedup.passages(frame(spark, texts), Workspace(spark, "t"), "doc_id", size=size, gram=(size + 1) // 2).collect()
        assert {(r["doc_id"], r["unit"]): (r["start"], r["stop"]) for r in got} == want
        assert all(r["n_words"] >= size for r in got)


def test_rows_that_repeat_or_lack_an_id(spark):
    """Every row is told apart, equal ones of one id too; results carry ids again."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(5, text), (5, text), (None, text), (None, text), (1, "other " * 30)], "doc_id long, text string")
    ws = Workspace(spark, "t")
    docs = keyed(rows, ws)
    assert sorted(r[ROW] for r in docs.collect()) == [0, 1, 2, 3, 4]
    found = substring_dedup.repeats(docs, ws, id_col=ROW)
    left = substring_dedup.remove(docs, found, ws, id_col=ROW)
    assert sorted(r["text"] for r in left.collect()) == sorted(["", "", "", text, "other " * 30])
    ids = named(found, docs, ws, ROW, "kept_id").where("kind = 'line'").collect()
    assert sorted(str(r["doc_id"]) for r in ids) == ["5", "None", "None"] and {r["kept_id"] for r in ids} == {5}
    unique = keyed(rows.where("doc_id = 1"), ws)
    assert unique.first()[ROW] == 1
    assert keyed(rows.limit(0), ws).count() == 0


def test_paragraphs():
    assert [("a\n\nb\n \nc"[s:e]) for s, e in substring_dedup._cut("a\n\nb\n \nc", "paragraph")] == ["a", "b", "c"]
