"""The two-document store: retrieval, ranking, evidence, context, citations."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import build, graph, postings, questions, retrieval
from quillspark.operators.retrieval import Store


@pytest.fixture(scope="module")
def store(spark):
    concepts = spark.createDataFrame(
        [
            ("doc-a", "sample-magic", "Sample Magic", "the art of samples", [3], ["sample magic", "magic"]),
            ("doc-a", "sample-energy", "Sample Energy", "the force of samples", [4], ["sample energy", "energy"]),
            ("doc-a", "sample-wand", "Sample Wand", "a tool", [5], ["sample wand", "wand"]),
            ("doc-b", "sample-potion", "Sample Potion", "a drink", [2], ["sample potion", "potion", "magic"]),
        ],
        "document_id string, concept_id string, name string, description string, page_numbers array<int>, keywords array<string>",
    )
    words = {"sample magic": "sample-magic", "magic": "sample-magic", "sample energy": "sample-energy", "sample wand": "sample-wand", "wand": "sample-wand"}
    posts = [("doc-a", k, v) for k, v in words.items()] + [("doc-a", "energy", "sample-energy"), ("doc-a", "energy", "sample-magic")]
    posts += [("doc-b", k, "sample-potion") for k in ("sample potion", "potion", "magic")]
    return Store(
        spark.createDataFrame([("doc-a", 3, "magic is a sample of magic arts"), ("doc-a", 4, "energy flows in sample things"), ("doc-a", 5, "a wand is for the sample"), ("doc-b", 2, "a potion")], "document_id string, page_number int, content string"),
        concepts,
        spark.createDataFrame(posts, "document_id string, keyword string, concept_id string"),
        spark.createDataFrame([("doc-a", "sample sorcery", "sample-magic")], "document_id string, alias string, concept_id string"),
        spark.createDataFrame([("sample sorcery", "sample-magic")], "alias string, concept_id string"),
        concepts.select("concept_id", "document_id"),
        spark.createDataFrame([("doc-a", "sample-magic", "sample-energy"), ("doc-a", "sample-energy", "sample-wand"), ("doc-b", "sample-magic", "sample-potion")], "document_id string, source string, target string"),
    )


def terms(spark, concepts, keywords):
    rows = spark.createDataFrame([(1, concepts, keywords)], "query_id long, concepts array<string>, keywords array<string>")
    return retrieval.plan_terms(rows)


@pytest.fixture(scope="module")
def both(spark):
    return spark.createDataFrame([("doc-a",), ("doc-b",)], "document_id string")


def pairs(df):
    return {(r["concept_id"], r["document_id"]) for r in df.collect()}


def test_scope(spark, both):
    assert {r[0] for r in retrieval.resolve_scope("all", both).collect()} == {"doc-a", "doc-b"}
    assert [r[0] for r in retrieval.resolve_scope(["doc-b"], both).collect()] == ["doc-b"]
    for bad in ([], "doc-x"):
        with pytest.raises(ValueError):
            retrieval.resolve_scope(bad, both)


def test_candidates(spark, store, both):
    t = terms(spark, ["sample sorcery"], ["magic"])
    found = pairs(retrieval.candidates(t, store, both, 1))
    assert {("sample-magic", "doc-a"), ("sample-potion", "doc-b"), ("sample-energy", "doc-a")} <= found
    assert {d for _, d in pairs(retrieval.candidates(t, store, both.where("document_id = 'doc-a'"), 1))} == {"doc-a"}
    assert pairs(retrieval.candidates(terms(spark, [], ["sample magic"]), store, both, 0)) == {("sample-magic", "doc-a")}
    assert not pairs(retrieval.candidates(terms(spark, [], ["zzzz"]), store, both, 1))


def test_bm25(spark, store, both):
    t = terms(spark, [], ["magic"])
    got = {r["concept_id"]: r["score"] for r in retrieval.bm25(retrieval.candidates(t, store, both, 0), t, store).collect()}
    assert got == {"sample-magic": pytest.approx(0.6359148445504086, abs=1e-8), "sample-potion": pytest.approx(0.6359148445504086, abs=1e-8)}


def test_fusion(spark, store, both):
    t = terms(spark, ["sample magic"], ["sample magic"])
    found = retrieval.candidates(t, store, both, 1).persist()
    got = [(r["concept_id"], r["score"]) for r in retrieval.rank(found, t, store, 1).orderBy("rank").collect()]
    assert [c for c, _ in got] == ["sample-magic", "sample-energy", "sample-potion"]
    assert [s for _, s in got] == [pytest.approx(x, abs=1e-8) for x in (3 / 61, 1 / 62, 1 / 63)]


@pytest.fixture(scope="module")
def dealt(spark):
    """Random concepts of 12 documents, their store, one row per document, and terms."""
    rng = __import__("random").Random(8)
    word = lambda: f"w{rng.randrange(12)}"
    rows = []
    for d in range(12):
        for at in range(rng.randrange(1, 9)):
            name = " ".join(word() for _ in range(rng.randrange(1, 4)))
            rows.append((f"doc-{d}", name.replace(" ", "-"), name, name, [at], [" ".join(name.split()[:2])], [word() for _ in range(3)], at))
    raw = spark.createDataFrame(rows, "document_id string, concept_id string, name string, description string, page_numbers array<int>, aliases array<string>, keywords array<string>, ord int").cache()
    merged = build.merge_concepts(raw).cache()
    local = build.alias_map(raw.select("document_id", F.col("aliases")[0].alias("alias"), "concept_id", "ord")).cache()
    none = spark.createDataFrame([], "document_id string, source string, target string")
    store = Store(None, merged, build.keyword_postings(merged), local, build.registry_aliases(local), build.registry_concepts(merged), none)
    asked = [(q, [" ".join(word() for _ in range(rng.randrange(1, 3))) for _ in range(2)], [word() for _ in range(4)]) for q in range(9)] + [(50, ["nothing"], [" "])]
    terms = retrieval.plan_terms(spark.createDataFrame(asked, "query_id long, concepts array<string>, keywords array<string>")).cache()
    return store, postings.by_document(raw, merged).cache(), terms, merged.select("document_id").distinct()


def ordered(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("held,turn", [(1 << 21, 4_000_000), (3, 7)])
def test_alias_counts_by_document(dealt, monkeypatch, held, turn):
    """As of the candidates, which are not listed: nothing is shuffled afterwards."""
    monkeypatch.setattr(postings, "HELD", held), monkeypatch.setattr(postings, "SENT_TERMS", turn)
    store, docs, terms, scope = dealt
    found = postings.alias_counts(terms, docs)
    want = ordered(retrieval.alias_list(retrieval.candidates(terms, store, scope, 0), terms, store))
    assert want and ordered(found) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


@pytest.mark.parametrize("held,turn", [(1 << 21, 4_000_000), (3, 7)])
def test_top_bm25_by_document(dealt, monkeypatch, held, turn):
    monkeypatch.setattr(postings, "HELD", held), monkeypatch.setattr(postings, "SENT_TERMS", turn)
    store, docs, terms, scope = dealt
    rows = retrieval.bm25(retrieval.candidates(terms, store, scope, 0), terms, store)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "concept_id", "document_id"))
    want = ordered(rows.withColumn("position", at).where("position <= 3"))
    assert want and ordered(postings.top_bm25(terms, docs, retrieval.named(terms, store.registry_aliases), 3)) == want
    assert not postings.asks_odd(terms, docs)


@pytest.mark.parametrize("held,turn,depth", [(1 << 21, 4_000_000, 1), (3, 7, 2)])
def test_top_bm25_of_what_is_reached(spark, dealt, monkeypatch, held, turn, depth):
    """A document counts for a question, too, by a concept near the question's own."""
    monkeypatch.setattr(postings, "HELD", held), monkeypatch.setattr(postings, "SENT_TERMS", turn)
    store, docs, terms, scope = dealt
    terms = terms.where("origin = 'concept' or ord = 0 and query_id > 6")
    names = [r[0] for r in store.registry_concepts.select("concept_id").distinct().orderBy("concept_id").collect()]
    store = retrieval.Store(**{**vars(store), "edges": spark.createDataFrame([("doc-1", a, b) for a, b in zip(names, names[1:])], "document_id string, source string, target string")})
    found = retrieval.candidates(terms, store, scope, depth)
    documents = lambda rows: rows.select("query_id", "document_id").distinct().count()
    assert documents(found) > documents(retrieval.candidates(terms, store, scope, 0))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "concept_id", "document_id"))
    want = ordered(retrieval.bm25(found, terms, store).withColumn("position", at).where("position <= 3"))
    near, seeds = graph.adjacency(store.edges), retrieval.seeds(terms, store, scope)
    steps = postings.leads(seeds, near, depth)
    assert want and ordered(postings.top_bm25(terms, docs, retrieval.named(terms, store.registry_aliases), 3, steps)) == want
    monkeypatch.setattr(graph, "SENT_EDGES", 1)
    assert postings.leads(seeds, near, depth) is None


@pytest.fixture(scope="module")
def linked(spark, dealt):
    """A store with edges, its documents by page, and terms: names and keywords repeat in a
    document, one is odd, and an alias leads to the last of its concepts."""
    rng = __import__("random").Random(5)
    word = lambda: f"w{rng.randrange(9)}"
    rows = []
    for d in range(12):
        for at in range(rng.randrange(1, 9)):
            name = " ".join(word() for _ in range(rng.randrange(1, 4)))
            keywords = [word() for _ in range(3)] + ["O  dd"] * (at == 2)
            rows.append((f"doc-{d}", name.replace(" ", "-"), name.upper(), name, [at], [" ".join(name.split()[:2]).title()], keywords, at))
    raw = spark.createDataFrame(rows, "document_id string, concept_id string, name string, description string, page_numbers array<int>, aliases array<string>, keywords array<string>, ord int").cache()
    merged = build.merge_concepts(raw).cache()
    local = build.alias_map(raw.select("document_id", F.col("aliases")[0].alias("alias"), "concept_id", "ord")).cache()
    names = [r[0] for r in merged.select("concept_id").distinct().orderBy("concept_id").collect()]
    edges = spark.createDataFrame([("doc-1", a, b) for a, b in zip(names, names[1:])], "document_id string, source string, target string").cache()
    store = Store(None, merged, build.keyword_postings(merged), local, build.registry_aliases(local), build.registry_concepts(merged), edges)
    return store, questions.by_page(raw).cache(), dealt[2], merged.select("document_id").distinct()


def unlisted(rows):
    """Candidates come from the tasks' questions: nothing is shuffled afterwards."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return "Exchange" not in plan[: plan.index("MapInArrow")]


@pytest.mark.parametrize("held,depth", [(1 << 16, 1), (3, 2)])
def test_candidates_by_question(linked, monkeypatch, held, depth):
    monkeypatch.setattr(questions, "HELD", held)
    store, docs, terms, scope = linked
    near = graph.adjacency(store.edges)
    found = questions.index(terms, docs, build.registry_aliases, near, depth).listed()
    want = ordered(retrieval.candidate_order(retrieval.candidates(terms, store, scope, depth)).select(*found.columns))
    assert want and ordered(found) == want
    assert unlisted(found)


@pytest.mark.parametrize("held,depth", [(1 << 16, 1), (3, 2)])
def test_ranks_by_question(linked, monkeypatch, held, depth):
    """All ranks, and the first three of every question."""
    monkeypatch.setattr(questions, "HELD", held)
    store, docs, terms, scope = linked
    index = questions.index(terms, docs, build.registry_aliases, graph.adjacency(store.edges), depth)
    found = index.ranked()
    candidates = retrieval.candidates(terms, store, scope, depth).cache()
    want = ordered(retrieval.rank(candidates, terms, store, depth).select(*found.columns))
    assert want and ordered(found) == want and unlisted(found)
    assert ordered(index.ranked(3)) == [r for r in want if r[-1] <= 3]


@pytest.fixture(scope="module", params=[1, 2])
def by_question(request, linked):
    """Questions that are answered one by one, and their listed candidates."""
    store, docs, terms, scope = linked
    depth = request.param
    index = questions.index(terms, docs, build.registry_aliases, graph.adjacency(store.edges), depth)
    return index, retrieval.candidates(terms, store, scope, depth).cache(), terms, store, depth


def test_stats_by_question(by_question):
    index, found, _, store, _ = by_question
    got = index.stats()
    want = ordered(retrieval.bm25_stats(found, store).select(*got.columns))
    assert want and ordered(got) == want and unlisted(got)


def test_order_of_held_rows(monkeypatch):
    """What is held is handed on in blocks by row, then question, and once."""
    rng = __import__("random").Random(4)
    for block, most, queries in ((1 << 16, 1 << 23, 5), (20, 100, 9), (20, 1 << 23, 50), (1, 50, 7)):
        monkeypatch.setattr(graph, "BLOCK", block)
        held, want, got = graph.Held(most), [], []
        for q in range(queries):
            rows = np.array(sorted(rng.sample(range(200), rng.choice([0, 2, 90]))), np.int64)
            want += [(r, q, r * q) for r in rows.tolist()]
            if held.add(q, rows, {"x": rows * q}) or q == queries - 1:
                part = [list(zip(r.tolist(), x.tolist(), v["x"].tolist())) for x, r, v in held.blocks()]
                assert all(part) and sum(part, []) == sorted(sum(part, [])) and held.n == 0
                assert block > 20 or len(sum(part, [])) < 99 or len(part) > 1
                got += sum(part, [])
        assert want and sorted(got) == sorted(want)


def test_concepts_that_terms_name(spark, tmp_path, monkeypatch):
    """Of registered aliases and concepts what the terms name, whether terms are few or many;
    the join's rows are not shuffled to be compared again."""
    from quillspark.plans import corpus, queries

    texts = ["A b one\nA B two\nc d", "a  B three\nc d\nc d", None, "a b one\n\nc d\nx", "x\ny z\nA b two"]
    rows = [(20 - i, text, f"s{i}") for i, text in enumerate(texts)] + [(40, "c d\nq", "s2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = corpus.Corpus(spark, str(tmp_path))
    terms = retrieval.plan_terms(spark.createDataFrame([(1, ["A B", "zz"], ["x"]), (2, ["c d"], ["x"])], "query_id long, concepts array<string>, keywords array<string>"))
    want = ordered(c.registry_aliases.where("alias in ('a b', 'c d', 'x')").select("alias", "concept_id"))
    for most in (1, 9):
        monkeypatch.setattr(corpus, "BROADCAST_ROWS", most)
        aliases, concepts = c.named_concepts(terms)
        assert want and ordered(aliases.select("alias", "concept_id")) == want
        assert ordered(concepts) == ordered(c.registry_concepts.join(aliases, "concept_id", "left_semi").select("concept_id", "document_id"))
    found = queries.QUERIES["j1_alias_join"](spark, str(tmp_path))
    assert ordered(found) == ordered(retrieval.by_registry_alias(queries._terms(c), c.store, queries._scope(c)).distinct()) and found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" not in plan or "document_id#" not in plan.split("hashpartitioning(query_id#")[1].split(")")[0]


def test_neighbours_of_lines(spark, tmp_path):
    """Neighbours of a corpus are told document by document as by its edges: blank lines
    between pages, repeats, white space of all kinds, and no text at all."""
    from quillspark.plans.corpus import Corpus

    texts = ["A b c d\n a\tB  c x\nq\n\nq r\nq", "\n \nx\n\u00e4 \u00f6 y\nx", "one", "", None, "q\nq r\n a b\x0bc\n\x0c\nz"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    corpus = Corpus(spark, str(tmp_path))
    near = corpus.neighbours
    want = ordered(graph.adjacency(corpus.raw_edges.where("source <> target")))
    assert ordered(near) == want and ("q", "q-r") in want and ("x", "unknown") not in want
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert ordered(graph.adjacency(corpus.edges)) == want


def test_hydrated_by_question(by_question, monkeypatch):
    """Pages and length of a description come with the rows; where these are too many, not."""
    index, found, _, store, _ = by_question
    monkeypatch.setattr(questions, "HELD", 3)
    columns = {"pages": F.array_join(F.col("page_numbers").cast("array<string>"), ","), "chars": F.col("chars").cast("long")}
    got = index.hydrated(**columns)
    rows = retrieval.hydrate(found, store).select("query_id", "concept_id", "document_id", F.array_join(F.col("evidence_pages").cast("array<string>"), ",").alias("pages"), F.length("description").cast("long").alias("chars"))
    want = ordered(rows)
    assert want and ordered(got) == want and unlisted(got) and any("," in r[3] for r in want)
    monkeypatch.setattr(questions, "SENT_NUMBERS", 9)
    assert index.hydrated(**columns) is None


def test_pages_of_merged_concepts(spark):
    """Pages repeat, are out of order or missing, and so may descriptions be."""
    rows = [("d", "c", "N", None, [3, 1], ["a"], ["w"], 0), ("d", "c", "N", "long one", [1, -2, None], ["a"], ["w"], 1), ("d", "c", "N", "b", [], ["a"], ["w"], 2), ("d", "e", "M", None, [], ["b"], ["w"], 3)]
    raw = spark.createDataFrame(rows, "document_id string, concept_id string, name string, description string, page_numbers array<int>, aliases array<string>, keywords array<string>, ord int")
    terms = retrieval.plan_terms(spark.createDataFrame([(1, [], ["w"])], "query_id long, concepts array<string>, keywords array<string>"))
    near = spark.createDataFrame([], "a string, b string")
    got = questions.index(terms, questions.by_page(raw), build.registry_aliases, near, 1).hydrated(p=F.col("page_numbers").cast("string"), chars=F.col("chars"))
    assert ordered(got.select("concept_id", "p", "chars")) == [("c", "[-2, 1, 3]", 8), ("e", "[]", None)]


def test_bm25_by_question(by_question):
    index, found, terms, store, _ = by_question
    got = index.bm25()
    want = ordered(retrieval.bm25(found, terms, store).select(*got.columns))
    assert want and ordered(got) == want and unlisted(got)


def test_found_by_question(by_question):
    index, found, _, _, _ = by_question
    got = index.found()
    want = ordered(found.select(*got.columns))
    assert want and ordered(got) == want and unlisted(got)


def test_distances_by_question(by_question):
    index, found, terms, store, depth = by_question
    got = index.distances()
    want = ordered(retrieval.graph_list(found, terms, store, depth).select(*got.columns))
    assert want and ordered(got) == want and unlisted(got)


def test_questions_that_are_not_sent(spark, linked, monkeypatch):
    """Too many numbers, or odd terms: the candidates are to be listed."""
    store, docs, terms, _ = linked
    ask = lambda terms, docs=docs: questions.index(terms, docs, build.registry_aliases, graph.adjacency(store.edges), 1)
    odd = retrieval.plan_terms(spark.createDataFrame([(1, [], ["o dd"])], "query_id long, concepts array<string>, keywords array<string>"))
    assert ask(odd) is None and ask(terms, docs.limit(0)).listed().count() == 0
    monkeypatch.setattr(questions, "SENT_NUMBERS", 9)
    assert ask(terms) is None


def test_odd_terms_are_noticed(spark, dealt):
    terms = dealt[2]
    docs = lambda odd: spark.createDataFrame([("doc-1", [("c", ["w1", odd], [odd])], None)], "document_id string, concepts array<struct<concept_id string, terms array<string>, odd array<string>>>, aliases array<struct<alias string, concept_id string>>")
    word = retrieval.ranking_terms(terms).first()["term"]
    assert postings.asks_odd(terms, docs(word)) and not postings.asks_odd(terms, docs("never asked"))
    assert postings.top_bm25(terms, docs("never asked").limit(0), retrieval.named(terms, dealt[0].registry_aliases), 3).count() == 0


def test_search_by_query(spark):
    """The rows of the search by joins; what is reached is not shuffled."""
    rng = __import__("random").Random(3)
    edges = spark.createDataFrame([("d", f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(120)] + [("d", None, "n1")], "document_id string, source string, target string")
    seeds = spark.createDataFrame([(q, f"n{rng.randrange(90)}") for q in range(30) for _ in range(3)] + [(99, "alone"), (1, None)], "query_id long, concept_id string")
    near = graph.adjacency(edges)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for depth in (-1, 0, 2):
        want = rows(graph.bfs(seeds, near, depth))
        assert rows(graph.bfs_by_query(seeds, near, depth)) == want == rows(graph.bfs_by_query(seeds, near, depth, limit=5))
    plan = graph.bfs_by_query(seeds, near, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
    assert rows(graph.bfs_by_query(seeds, near.limit(0), 2)) == []


def test_search_depth(spark, store):
    near = graph.adjacency(store.edges)
    seed = spark.createDataFrame([(1, "sample-magic"), (1, "nowhere")], "query_id long, concept_id string")
    got = {r["concept_id"]: r["distance"] for r in graph.bfs(seed, near, 2).collect()}
    assert got == {"sample-magic": 0, "sample-energy": 1, "sample-potion": 1, "sample-wand": 2}
    assert graph.bfs(seed, near, -1).count() == 0


def test_evidence(spark, store, both):
    t = terms(spark, ["sample magic"], ["magic", "sample"])
    found = retrieval.candidates(t, store, both, 1).persist()
    top = retrieval.hydrate(retrieval.rank(found, t, store, 1).persist(), store).persist()
    kept = retrieval.evidence(top, t, store, 5).collect()
    assert [(r["document_id"], r["page_number"]) for r in kept] == [("doc-a", 3)] and kept[0]["score"] == 1.0
    multi = retrieval.evidence(top, terms(spark, [], ["sample magic"]), store, 5)
    assert multi.count() == 0  # a term of two words never equals a token
    assert retrieval.evidence(top, None, store, 0).count() == 0
    with pytest.raises(ValueError):
        retrieval.evidence(top, None, store, -1)
    cited = retrieval.citations(top, multi).orderBy("ord").collect()
    assert all(not r["evidence_loaded"] for r in cited) and (cited[0]["document_id"], cited[0]["page_number"], cited[0]["concepts"]) == ("doc-a", 3, ["sample-magic"])


@pytest.mark.parametrize("most", [6000, 1500, 250])
def test_context_budget(spark, most):
    top = spark.createDataFrame([(1, f"concept-{i:02d}", "doc-x", i + 1, f"about {i} " * 3) for i in range(25)], "query_id long, concept_id string, document_id string, rank long, description string")
    pages = spark.createDataFrame([(1, "doc-x", i, "word " * 580, i) for i in range(1, 11)], "query_id long, document_id string, page_number int, content string, position long")
    text = retrieval.build_context(top, pages, most).first()["context"]
    assert -(-len(text) // 4) <= most
    assert most < 6000 or "concept-24" in text
    with pytest.raises(ValueError):
        retrieval.build_context(top, pages, 0)


def test_batches(spark):
    kinds = ["t", "t", "i", "i", "t"]
    rows = [("d", i, f"/x/{i}.png" if k == "i" else f"text {i}") for i, k in enumerate(kinds, 1)]
    pages = build.classify(spark.createDataFrame(rows, "document_id string, page_number int, content string"))
    got = build.batch_table(build.batches(pages, 2, 1)).orderBy("batch_id").collect()
    assert [r["page_numbers"] for r in got] == [[1, 2], [3], [4], [5]]
    assert [r["content_type"] for r in got] == ["text", "image", "image", "text"]
    assert got[0]["text"] == "### Page 1\ntext 1\n\n### Page 2\ntext 2"


def test_empty_pages(spark):
    rows = [("d", 1, ""), ("d", 2, "   "), ("d", 3, "Text"), ("d", 4, None)]
    got = build.split_empty(build.classify(spark.createDataFrame(rows, "document_id string, page_number int, content string")))
    assert [r["page_number"] for r in got.where("kept").collect()] == [3]


def test_merge_is_order_free(spark):
    rows = [("d", "m", "Magic", "desc", [1], ["Magic"], ["a"], 1), ("d", "m", "magic", "longer description", [4], ["Spell"], ["B"], 2), ("d", "m", "MAGIC", "longer descriptiom", [4], [], [], 3)]
    schema = "document_id string, concept_id string, name string, description string, page_numbers array<int>, aliases array<string>, keywords array<string>, ord long"
    for order in (rows, rows[::-1]):
        got = build.merge_concepts(spark.createDataFrame(order, schema).repartition(3)).first()
        assert (got["name"], got["description"], got["page_numbers"], got["aliases"], got["keywords"]) == ("Magic", "longer description", [1, 4], ["magic", "spell"], ["a", "b"])


def test_edges_need_concepts(spark):
    edges = spark.createDataFrame([("d", "a", "b", "x", [1], 1), ("d", "a", "a", "uses", [1], 2), ("d", "a", "c", "odd", [1], 3)], "document_id string, source string, target string, type string, page_numbers array<int>, ord long")
    known = spark.createDataFrame([("d", "a"), ("d", "c")], "document_id string, concept_id string")
    got = build.graph_edges(edges, known).collect()
    assert [(r["source"], r["target"], r["type"]) for r in got] == [("a", "c", "relates_to")]


def test_headers(spark):
    rows = [("d", i, f"Header\n\nBody {i}\nmore\nFooter") for i in range(3)]
    got = build.remove_headers(spark.createDataFrame(rows, "document_id string, page_number int, content string"))
    assert {r["content"] for r in got.collect()} == {f"\nBody {i}\nmore" for i in range(3)}


def test_line_ends(spark):
    rows = spark.createDataFrame([("a\r\nb\x0bc\u2028d\x85e\n",), ("",), ("\n\n",), ("x",)], "t string")
    from quillspark.functions import text as T

    assert [r[0] for r in rows.select(T.lines("t")).collect()] == [list("abcde"), [], ["", ""], ["x"]]


def test_merge_paragraphs(spark):
    """Against a fold over the lines, with and without code fences."""
    import random
    import re

    from quillspark.functions import text as T

    def fold(text):
        out, code = [], False
        item, head = re.compile(r"^\s*([-*+]|[0-9]+[.)])\s+"), re.compile(r"^\s*#{1,6}\s+")
        for line in re.split(r"\r\n|[\n\x0b\f\r\x85\u2028\u2029]", text):
            fence = re.match(r"\s*```", line)
            plain = not (fence or code or not line.strip() or item.match(line) or head.match(line))
            last = out[-1] if out else ""
            if plain and last and not re.search(r"[.:?!]$", last) and not item.match(last) and not head.match(last) and len(line) < 120:
                out[-1] = last + " " + line
            else:
                out.append(line)
            code = code != bool(fence)
        return "\n".join(out)

    rng = random.Random(3)
    lines = ["word", "ends.", "", "- item", "# Head", "2) two", "```", "x" * 130, "what?", "  ", "go on", "a:"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.merge_paragraphs("t")).collect()] == [fold(t) for t in texts]


def test_image_path(spark):
    from quillspark.functions import text as T

    df = spark.createDataFrame([("../a/./b.png", "/r/x"), ("/abs/../c.png", None), ("d.png", None), ("e.png", "s3a://k/p")], "t string, r string")
    assert [r[0] for r in df.select(T.image_path("t", "r", F.lit("/f"))).collect()] == ["/r/a/b.png", "/c.png", "/f/d.png", "s3a://k/p/e.png"]


def test_seeds_by_query(spark, store, both):
    """A local alias counts for a query only in the documents of its own candidates."""
    t = spark.createDataFrame([(1, ["sample sorcery"], []), (2, ["sample sorcery"], [])], "query_id long, concepts array<string>, keywords array<string>")
    docs = spark.createDataFrame([(1, "doc-a"), (2, "doc-b")], "query_id long, document_id string")
    own = Store(**{**vars(store), "registry_aliases": store.registry_aliases.limit(0)})
    got = {(r["query_id"], r["concept_id"]) for r in retrieval.seeds(retrieval.plan_terms(t), own, docs).collect()}
    assert (1, "sample-magic") in got and (2, "sample-magic") not in got


def test_formats(spark):
    docs = spark.createDataFrame([("f.pdf", ["finance", "größe"]), ("g", [])], "document_id string, tags array<string>")
    pages = spark.createDataFrame([("f.pdf", 1, "a\nb")], "document_id string, page_number int, content string")
    md = {r[0]: r[1] for r in build.format_markdown(docs, pages).collect()}
    assert md["f.pdf"] == "# f.pdf\n\n## Metadata\n\n- finance\n- größe\n\n---\n\n# Page 1\n\na\nb\n"
    assert md["g"] == "# g\n\n## Metadata\n\n- _No metadata_\n\n---\n"
    rule = "-" * 51
    tx = {r[0]: r[1] for r in build.format_text(docs, pages).collect()}
    assert tx["f.pdf"] == f'FILE_NAME : f.pdf\nMETADATA : ["finance", "gr\\u00f6\\u00dfe"]\n\n{rule}\nPAGE_NO : 1\n\nCONTENT:\na\nb\n{rule}'
    js = {r[0]: r[1] for r in build.format_json(docs, pages).collect()}
    assert js["g"] == '{"FileName":"g","Metadata":[],"FileContent":[]}'


def test_components_with_a_cycle(spark):
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate("abcdefg")], "id string, idx long")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("e", "f")], "source string, target string")
    got = {r["id"]: r["component"] for r in graph.components(nodes, links).collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 2, "f": 2, "g": 3}


def test_superset_replaces(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "document_id string, x int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "document_id string, x int")
    assert sorted(tuple(r) for r in build.replace_documents(old, new).collect()) == [("a", 1), ("b", 2), ("c", 2)]
    versions = spark.createDataFrame([("a", 3), ("b", 1)], "document_id string, version int")
    assert sorted(tuple(r) for r in build.bump_versions(versions, new).collect()) == [("a", 3), ("b", 2), ("c", 1)]


def test_answered_is_the_queries_of_the_candidates(spark, store, both):
    asked = [([], ["sample magic"]), ([], ["zzzz"]), (["sample sorcery"], []), (["Sample Wand"], []), (["nothing here"], ["potion"]), (["!"], []), ([], [])]
    intents = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "query_id long, concepts array<string>, keywords array<string>")
    t = retrieval.plan_terms(intents)
    gone = Store(**{**vars(store), "registry_concepts": store.registry_concepts.where("concept_id <> 'sample-wand'")})
    for s, scope, depth in ((store, both, 1), (gone, both.where("document_id = 'doc-b'"), 2)):
        want = {r[0] for r in retrieval.candidates(t, s, scope, depth).select("query_id").distinct().collect()}
        assert {r[0] for r in retrieval.answered(t, s, scope, depth).collect()} == want


def test_terms_of_concepts_are_those_of_their_postings(spark, store):
    from quillspark.operators import build

    rows = spark.createDataFrame([("d", "c", "A  B", ["a b", "x", "X"]), ("d", "e", "E", []), ("f", "c", None, ["y"])], "document_id string, concept_id string, name string, keywords array<string>")
    whole = retrieval.index_terms(build.keyword_postings(rows))
    slim = retrieval.concept_terms(rows).select("document_id", "concept_id", F.explode("terms").alias("term"), F.size("terms").alias("len"))
    assert sorted(map(str, (tuple(r) for r in whole.collect()))) == sorted(map(str, (tuple(r) for r in slim.collect())))


def test_a_corpus_builds_only_what_is_read(spark, tmp_path):
    """The registry's documents take neither descriptions nor postings, and indexes
    within documents one shuffle."""
    from quillspark.plans import corpus, queries

    rows = [(i, "alpha beta gamma\ndelta alpha beta", "en", "s2", 33) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    queries.QUERIES["a11_concept_docs"](spark, str(tmp_path)).collect()
    assert {k[-1] for k in corpus._STORED if k[1] == str(tmp_path)} == {"registry_concepts"}
    index = queries.QUERIES["a7_keyword_index"](spark, str(tmp_path))
    assert index._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {k[-1] for k in corpus._STORED if k[1] == str(tmp_path)} == {"registry_concepts"}


def test_fusion_joins_no_candidates(spark, store, both):
    """Rows that are no candidates get no rank, all others do, without a join."""
    kind = "query_id long, concept_id string, document_id string"
    found = spark.createDataFrame([(1, "a", "d"), (1, "b", "d")], kind)
    scored = spark.createDataFrame([(1, "x", "d", 2.0), (1, "b", "d", 1.0)], kind + ", score double")
    named, near = scored.limit(0).withColumnRenamed("score", "matches"), scored.limit(0).withColumnRenamed("score", "distance")
    fused = retrieval.fuse(found, scored, named, near)
    assert [tuple(r) for r in fused.orderBy("rank").select("concept_id", "score", "rank").collect()] == [("b", round(1 / 62, 9), 1), ("a", 0.0, 2)]
    assert "Join" not in fused._jdf.queryExecution().optimizedPlan().toString()
