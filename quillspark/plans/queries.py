"""Registered queries of the engine's operators over the driver's tables.

All outputs are flat: arrays come as joined strings, scores rounded.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import build, graph, postings, retrieval
from .corpus import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DEPTH, TOP_K = 1, 5
#: A chain of the retrieval steps is cut here, once per corpus.
_HIDDEN_SIZE = 2


def query(f: Callable[[Corpus], DataFrame]):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
    return f


def joined(x, sep=","):
    return F.array_join(F.transform(x, lambda v: v.cast("string")), sep)


# -- sources, formatters ---------------------------------------------------
@query
def s18_scope_scan(c):
    return retrieval.in_scope(c.postings, _scope(c)).select("document_id", "keyword", "concept_id")


@query
def s19_bundle_list(c):
    title = F.coalesce(F.expr("nullif(category, '')"), F.col("document_id"))
    return c.documents.select("document_id", title.alias("title"), "pages")


@query
def s20_page_scan(c):
    """Pages 1..n+1 of every document; blank and missing ones say so."""
    numbers = c.documents.select("document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pages") + 1)).alias("page_number"))
    shown = numbers.join(c.pages, ["document_id", "page_number"], "left")
    text = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "no content").otherwise(F.col("content"))
    return shown.select("document_id", "page_number", F.md5(text).alias("content_md5"))


def _tagged(c):
    """All documents; every other one has tags."""
    return c.documents.select("document_id", F.when(F.col("doc_id") % 2 == 0, F.array("category", F.lit("größe"))).otherwise(F.array().cast("array<string>")).alias("tags"))


@query
def k1_format_markdown(c):
    return build.format_markdown(_tagged(c), c.pages).select("document_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


@query
def k2_format_text(c):
    return build.format_text(_tagged(c), c.pages).select("document_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


@query
def k3_format_json(c):
    """What the JSON holds, read back: name, tags, and every page."""
    kind = "FileName string, Metadata array<string>, FileContent array<struct<page_no:int,content:string>>"
    rows = build.format_json(_tagged(c), c.pages).select(F.from_json("text", kind).alias("j"))
    page = F.transform("j.FileContent", lambda p: F.concat(p["page_no"].cast("string"), F.lit(":"), p["content"]))
    return rows.select(F.col("j.FileName").alias("document_id"), joined("j.Metadata", "|").alias("tags"), F.size("j.FileContent").cast("long").alias("pages"), F.md5(F.array_join(page, "\n")).alias("content_md5"))


@query
def k8_usage_log(c):
    return build.usage_totals(c.usage).select(F.format_string("%s: %d calls, %d in, %d out, %d total", "document_name", "calls", "input_tokens", "output_tokens", "total_tokens").alias("line"))


# -- filters ----------------------------------------------------------------
@query
def f1_classify(c):
    return build.classify(c.media).select("document_id", "page_number", "content_type")


@query
def f3_empty_pages(c):
    return build.split_empty(build.classify(c.pages)).select("document_id", "page_number", "kept")


@query
def f4_poor_pages(c):
    return c.pages.where(T.poor_text("content")).select("document_id", "page_number", T.word_count("content").cast("long").alias("words"))


@query
def f5_better_text(c):
    after = F.lead("content").over(Window.partitionBy("document_id").orderBy("page_number"))
    return c.pages.withColumn("other", after).where("other is not null").select("document_id", "page_number", T.better_text("other", "content").alias("better"))


@query
def f6_page_numbers(c):
    raw = F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.lit("x"), F.lit("3"))
    rows = c.table("lineitem").select("l_orderkey", "l_linenumber", build.sanitize_pages(raw, F.sequence(F.lit(1), F.lit(100))).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", joined("p").alias("pages"))


def _checked(c):
    """Every seventh page cites a page that does not exist, every eleventh has
    no name."""
    rows = c.raw_concepts.withColumn("page_numbers", F.when(F.col("ord") % 7 == 0, F.array("ord", F.lit(999999).cast("long"))).otherwise(F.col("page_numbers")))
    rows = rows.withColumn("name", F.when(F.col("ord") % 11 == 0, "  ").otherwise(F.col("name")))
    allowed = c.pages.groupBy("document_id").agg(F.collect_set("page_number").alias("allowed"))
    return build.validate_concepts(rows, allowed)


@query
def f11_validate_concepts(c):
    return _checked(c).select("document_id", F.col("ord").alias("page_number"), "valid", "reason")


@query
def f12_validate_keywords(c):
    rows = c.table("conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))
    return build.validate_words(rows, "word").groupBy("conv_id", "turn").agg(F.count("*").alias("words"))


@query
def f13_validate_entries(c):
    turns = c.table("conversations").select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("document_id"), F.col("turn").cast("long").alias("turn"))
    allowed = turns.groupBy("document_id").agg(F.collect_set("turn").alias("allowed"))
    return build.validate_entries(c.glossary, allowed).select("document_id", "key", "page_number")


@query
def f15_graph_edges(c):
    return c.edges.select("document_id", "source", "target", "type", joined("page_numbers").alias("pages"))


@query
def f2_image_paths(c):
    """Relative, absolute and dotted paths against a root or a folder."""
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "/abs/./").when(F.col("page_id") % 3 == 1, "../up/").otherwise("img//"), F.col("page_id").cast("string"), F.lit(".png"))
    root = F.when(F.col("page_id") % 2 == 0, F.lit("/store/data"))
    return c.table("pages").select("page_id", T.image_path(path, root, F.lit("/docs/web")).alias("path"))


@query
def f14_image_errors(c):
    """Image pages whose file is not in a listing that lacks every tenth."""
    files = c.media.where("page_number % 10 <> 0").select(F.col("content").alias("path"))
    return build.image_errors(build.batch_table(_batched(c)), files).select("document_id", "batch_id", "page_number", "error")


@query
def f16_evidence_floor(c):
    """Pages loaded for a question, and those that reach the floor and the cap."""
    loaded = retrieval.load_pages(_top(c), c.store, TOP_K).groupBy("query_id").agg(F.count("*").alias("loaded"))
    kept = _evidence(c).groupBy("query_id").agg(F.count("*").alias("kept"), F.round(F.min("score"), 6).alias("least"))
    return loaded.join(kept, "query_id", "left").select("query_id", "loaded", F.coalesce("kept", F.lit(0)).alias("kept"), "least")


@query
def f17_scope(c):
    """Names with a repeat -> the documents in scope."""
    return retrieval.resolve_scope(["doc-7", "doc-14", "doc-7", "doc-100"], c.documents)


@query
def f18_concept_search(c):
    return graph.search_concepts(c.concepts, "THAN").select("document_id", "concept_id")


@query
def f19_question_search(c):
    return graph.question_concepts(c.concepts, "Where is the scum of it?").select("document_id", "concept_id")


@query
def f20_links(c):
    return c.links.select("document_id", "source", "target", "type", "weight")


def _components(c):
    return c.stored("components", lambda: graph.components(c.nodes, c.links))


def _hidden(c, comp):
    return comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= _HIDDEN_SIZE).select("component")


@query
def f21_subgraph(c):
    comp = _components(c)
    shown, lines = graph.visible(c.nodes.join(comp, "id"), c.links, _hidden(c, comp))
    return shown.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).union(lines.select(F.lit("link"), "source", "target"))


@query
def f22_dim(c):
    return graph.dimmed(c.nodes, None, [], "than").select("id", "dim")


def _centres(c):
    return c.nodes.where("idx < 5").select("id")


@query
def f23_incident(c):
    return graph.incident(c.links, c.nodes, _centres(c)).select("concept", "document_id", "source", "target", "other", "other_label")


@query
def f24_find_first(c):
    return graph.find_first(c.nodes, "Than")


@query
def f25_answer_nodes(c):
    asked = retrieval.plan_terms(c.intents).where("origin = 'concept'").select("query_id", T.slugify("term", "").alias("id")).distinct()
    return asked.join(c.nodes.select("id"), "id", "left_semi")


# -- joins --------------------------------------------------------------------
def _terms(c):
    return c.stored("terms", lambda: retrieval.plan_terms(c.intents))


def _scope(c):
    """Documents of the sources whose name ends in an even digit."""
    return c.documents.where(F.col("category").rlike("[02468]$")).select("document_id")


@query
def j1_alias_join(c):
    """Rows are distinct as they are joined, and not compared once more."""
    terms = _terms(c)
    aliases, concepts = c.named_concepts(terms)
    store = retrieval.Store(None, None, None, None, aliases, concepts, None)
    return retrieval.by_registry_alias(terms, store, _scope(c))


@query
def j2_slug_join(c):
    return retrieval.by_slug(_terms(c), c.store, c.documents.select("document_id"))


@query
def j3_local_alias(c):
    return retrieval.by_local_alias(_terms(c), c.store, c.documents.select("document_id"))


@query
def j4_keyword_join(c):
    return retrieval.by_keyword(_terms(c), c.store, _scope(c)).groupBy("query_id", "keyword").agg(F.count("*").alias("hits"))


def _found(c):
    return c.stored("found", lambda: retrieval.candidates(_terms(c), c.store, c.documents.select("document_id"), DEPTH))


def _index(c):
    """Candidates question by question, where all that is asked for can be sent."""
    return c.index(_terms(c), DEPTH)


def _bm25(c):
    return c.stored("bm25", lambda: retrieval.bm25(_found(c), _terms(c), c.store))


def _ranked(c, most=None):
    """All candidates of a question by rank, or the first ``most``: question by question
    where all that is asked for can be sent, else a plan of which no more is sorted than kept."""
    terms, index = _terms(c), _index(c)
    if index:
        return index.ranked(most)
    rows = retrieval.fuse(_found(c), _bm25(c), retrieval.alias_list(_found(c), terms, c.store), retrieval.graph_list(_found(c), terms, c.store))
    return rows.where(F.col("rank") <= most) if most else rows


def _top(c, k=25):
    return c.stored(f"top{k}", lambda: retrieval.hydrate(_ranked(c, k), c.store))


@query
def j5_scope_intersection(c):
    return retrieval.in_scope(c.store.registry_concepts, _scope(c)).groupBy("concept_id").agg(F.count("*").alias("n_documents"))


@query
def j6_hydrate(c):
    index = _index(c)
    rows = index.hydrated(pages=joined("page_numbers"), chars=F.col("chars").cast("long")) if index else None
    if rows is not None:
        return rows
    rows = retrieval.hydrate(_found(c), c.store)
    return rows.select("query_id", "concept_id", "document_id", joined("evidence_pages").alias("pages"), F.length("description").cast("long").alias("chars"))


@query
def j7_seeds(c):
    return retrieval.seeds(_terms(c), c.store, c.documents.select("document_id"))


@query
def j8_evidence_join(c):
    return retrieval.evidence(_top(c), None, c.store, TOP_K).select("query_id", "document_id", "page_number", "position")


def _evidence(c):
    return c.stored("evidence", lambda: retrieval.evidence(_top(c), _terms(c), c.store, TOP_K))


@query
def j9_loaded_flag(c):
    top = _top(c)
    return retrieval.citations(top, _evidence(c)).select("query_id", "document_id", "page_number", "evidence_loaded")


@query
def j12_labels(c):
    return c.edges.select(F.col("target").alias("id")).distinct().join(c.nodes.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


# -- aggregations ---------------------------------------------------------------
@query
def a1_merge_concepts(c):
    return c.concepts.select("document_id", "concept_id", "name", F.md5("description").alias("description_md5"), joined("page_numbers").alias("pages"), joined("aliases", "|").alias("aliases"), joined("keywords").alias("keywords"))


@query
def a2_edge_dedup(c):
    return build.dedup_edges(c.raw_edges).select("document_id", "source", "target", "type", joined("page_numbers").alias("pages"))


@query
def a3_keyword_set(c):
    return build.keyword_set(c.raw_concepts)


@query
def a4_alias_last(c):
    return c.local_aliases.select("document_id", "alias", "concept_id")


@query
def a5_glossary_first(c):
    return build.first_entries(c.glossary, "definition", "page_number").select("document_id", "key", F.md5("definition").alias("definition_md5"), "page_number")


def _batched(c):
    return build.batches(build.split_empty(build.classify(c.media)).where("kept"), 3, 1)


@query
def a6_pages_extracted(c):
    return build.batch_table(_batched(c)).groupBy("document_id").agg(F.sum(F.size("page_numbers")).alias("pages_extracted"))


@query
def a7_keyword_index(c):
    return build.keyword_index(c.plain_postings).select("document_id", "keyword", joined("concept_ids").alias("concept_ids"))


@query
def a8_page_index(c):
    return build.page_index(c.concepts).select("document_id", "page_number", joined("concept_ids").alias("concept_ids"))


@query
def a9_entry_index(c):
    rows = build.first_entries(c.glossary, "definition", "page_number")
    return rows.select("document_id", "key", F.coalesce("page_number", F.lit(0)).alias("page_number"))


@query
def a10_validation(c):
    return build.validation_summary(_checked(c))


@query
def a11_concept_docs(c):
    return c.store.registry_concepts.groupBy("concept_id").agg(F.array_join(F.array_sort(F.collect_set("document_id")), ",").alias("documents"))


@query
def a12_keyword_docs(c):
    return build.registry_keywords(c.postings).select("keyword", joined("documents").alias("documents"))


@query
def a13_alias_first(c):
    return c.registry_aliases.select("alias", "concept_id")


@query
def a14_tags(c):
    return build.registry_tags(c.documents).select("category", joined("documents").alias("documents"))


@query
def a15_statistics(c):
    return build.registry_statistics(c.documents, c.concepts, c.edges)


@query
def a16_global_graph(c):
    """All nodes and all edges of the global graph."""
    nodes, edges = build.global_graph(c.concepts, c.edges)
    none = F.lit(None).cast("string")
    rows = edges.select(F.lit("edge").alias("kind"), "document_id", F.col("source").alias("id"), "target", "type", joined("page_numbers").alias("pages"))
    return nodes.select(F.lit("node").alias("kind"), none.alias("document_id"), F.col("concept_id").alias("id"), none.alias("target"), none.alias("type"), none.alias("pages")).unionByName(rows)


@query
def a17_bm25_stats(c):
    index = _index(c)
    stats = index.stats() if index else retrieval.bm25_stats(_found(c), c.store)
    return stats.select("query_id", "n", F.round("avg", 6).alias("avg"))


@query
def a18_bm25(c):
    index = _index(c)
    rows = index.bm25() if index else _bm25(c)
    return rows.select("query_id", "concept_id", "document_id", F.round("score", 6).alias("score"))


@query
def a19_page_bm25(c):
    return _evidence(c).select("query_id", "document_id", "page_number", F.round("score", 6).alias("score"), "position")


@query
def a20_alias_count(c):
    return postings.alias_counts(_terms(c), c.by_document)


@query
def a21_rrf(c):
    return _ranked(c).select("query_id", "concept_id", "document_id", F.round("score", 6).alias("score"), "rank")


@query
def a22_citations(c):
    top = _top(c)
    return retrieval.citations(top, _evidence(c)).select("query_id", "ord", "document_id", "page_number", joined("concepts").alias("concepts"))


@query
def a23_response(c):
    return retrieval.response(_ranked(c, 25)).select("query_id", joined("documents_used").alias("documents_used"), joined("concepts_used").alias("concepts_used"))


@query
def a24_repeated_lines(c):
    return build.repeated_lines(c.framed).where("n >= 3").select("document_id", F.md5("line").alias("line_md5"), "n", F.round("mean_position", 6).alias("mean_position"))


@query
def a25_usage(c):
    return build.usage_totals(c.usage)


@query
def a26_degree(c):
    return graph.degrees(c.links, c.nodes).select("id", "degree")


@query
def a27_clusters(c):
    return graph.clusters(_components(c), c.nodes)


@query
def a28_merged_graph(c):
    """Nodes with their place, and the links between them."""
    none = F.lit(None).cast("string")
    rows = c.links.select(F.lit("link").alias("kind"), "document_id", F.col("source").alias("id"), F.col("target").alias("other"), F.col("weight").alias("n"))
    return c.nodes.select(F.lit("node").alias("kind"), F.col("doc").alias("document_id"), "id", none.alias("other"), F.col("idx").alias("n")).unionByName(rows)


@query
def a29_link_weight(c):
    return c.links.groupBy("weight").agg(F.count("*").alias("links"))


@query
def a30_totals(c):
    n = c.nodes.agg(F.count("*").alias("nodes"), F.count_distinct("doc").alias("documents"))
    return n.crossJoin(c.documents.agg(F.sum("pages").alias("pages"))).crossJoin(c.links.agg(F.count("*").alias("links")))


@query
def a31_neighbours(c):
    """The neighbours of every node."""
    near = graph.adjacency(c.links).groupBy(F.col("a").alias("id"))
    return near.agg(F.array_join(F.array_sort(F.collect_list("b")), ",").alias("neighbours"))


@query
def a32_visible_counts(c):
    comp = _components(c)
    nodes = c.nodes.join(comp, "id")
    shown, lines = graph.visible(nodes, c.links, _hidden(c, comp))
    out = shown.agg(F.count("*").alias("visible"), F.count_distinct("component").alias("components"))
    return out.crossJoin(nodes.agg(F.count("*").alias("nodes"))).crossJoin(lines.agg(F.count("*").alias("links")))


# -- windows ----------------------------------------------------------------------
@query
def w1_runs(c):
    return build.runs(build.classify(c.media)).select("document_id", "page_number", "run")


@query
def w2_batches(c):
    return _batched(c).select("document_id", "page_number", "batch_id")


@query
def w3_batch_text(c):
    return build.batch_table(_batched(c)).select("document_id", "batch_id", "content_type", joined("page_numbers").alias("pages"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query
def w4_ranked_lists(c):
    """The first ten of a question by BM25; its candidates are not listed."""
    terms, every = _terms(c), c.documents.select("document_id")
    steps = None
    if not postings.asks_odd(terms, c.by_document):
        steps = postings.leads(retrieval.seeds(terms, c.store, every), graph.adjacency(c.edges), DEPTH)
    if steps is not None:
        rows = postings.top_bm25(terms, c.by_document, retrieval.named(terms, c.registry_aliases.select("alias", "concept_id")), 10, steps)
        return rows.select("query_id", "concept_id", "document_id", "position")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "concept_id", "document_id"))
    return _bm25(c).withColumn("position", at.cast("long")).where("position <= 10").select("query_id", "concept_id", "document_id", "position")


@query
def w5_final_rank(c):
    return _ranked(c, 25).select("query_id", "rank", "concept_id", "document_id")


@query
def w6_context_budget(c):
    top = _top(c)
    return retrieval.build_context(top, _evidence(c), 500).select("query_id", F.length("context").cast("long").alias("chars"), F.md5("context").alias("context_md5"))


@query
def w7_context_order(c):
    top = _top(c)
    return retrieval.context_blocks(top, _evidence(c)).select("query_id", F.col("tier").cast("long").alias("tier"), F.col("at"), T.estimate_tokens("text").alias("cost"))


@query
def w8_parallel_edges(c):
    return graph.parallel_links(c.links).select("document_id", "source", "target", "type", F.col("ord"), "pair_index", "curvature")


@query
def w9_call_numbers(c):
    return build.number_calls(c.usage).where("call_number <= 100").select("document_name", "call_id", "call_number")


@query
def w10_radius(c):
    return graph.styled(graph.degrees(c.links, c.nodes)).select("id", F.round("radius", 6).alias("radius"), "palette")


@query
def t3_evidence_cap(c):
    """Evidence of many candidates, where the cap on pages holds."""
    top = _top(c, 100)
    return retrieval.evidence(top, _terms(c), c.store, 100).select("query_id", "position", "document_id", "page_number", F.round("score", 6).alias("score"))


@query
def t5_candidate_order(c):
    index = _index(c)
    rows = index.listed() if index else retrieval.candidate_order(_found(c))
    return rows.select("query_id", "concept_id", "document_id", "position")


@query
def t6_top_labels(c):
    return graph.top_labels(graph.degrees(c.links, c.nodes))


@query
def t7_cards(c):
    return c.concepts.select("document_id", "concept_id", joined(F.slice("keywords", 1, 4)).alias("tags"), F.md5(T.truncate("description", 140)).alias("text_md5"))


@query
def t8_sorted_names(c):
    at = F.row_number().over(Window.partitionBy("document_id").orderBy(F.collate("name", "UNICODE"), "concept_id"))
    return c.concepts.withColumn("position", at.cast("long")).select("document_id", "concept_id", "position")


# -- sets ---------------------------------------------------------------------------
@query
def x1_candidates(c):
    index = _index(c)
    return index.found() if index else _found(c).select("query_id", "concept_id", "document_id")


@query
def x2_plan_terms(c):
    return _terms(c).select("query_id", "origin", "term", F.col("ord").cast("long").alias("ord"))


@query
def x3_query_terms(c):
    return retrieval.ranking_terms(_terms(c))


@query
def x6_unknown_scope(c):
    wanted = c.table("labels").select(F.concat(F.lit("doc-"), (F.col("doc_id") * 2).cast("string")).alias("document_id")).distinct()
    return retrieval.unknown_scope(wanted, c.documents)


@query
def x7_upsert(c):
    stored = c.edges.select("document_id", "source", "target", "type")
    new = c.edges.join(c.documents.where("doc_id % 3 = 0").select("document_id"), "document_id", "left_semi").select("document_id", F.col("target").alias("source"), F.col("source").alias("target"), F.lit("uses").alias("type"))
    return build.replace_documents(stored, new)


# -- scalar functions ------------------------------------------------------------------
@query
def e1_slugify(c):
    return c.table("part").select("p_partkey", T.slugify(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query
def e2_normalize(c):
    return c.table("conversations").select("conv_id", "turn", F.md5(T.normalize_term("text")).alias("term_md5"))


@query
def e3_tokens(c):
    return c.table("conversations").select("conv_id", "turn", joined(T.tokens("text"), " ").alias("tokens"))


@query
def e4_fallback_tokens(c):
    return c.table("conversations").select("conv_id", "turn", joined(T.query_words("text"), " ").alias("words"))


@query
def e8_whitespace(c):
    text = F.concat(F.lit("\t "), F.replace("text", F.lit(" "), F.lit("  \t")), F.lit(" \n  x  y "))
    return c.table("conversations").select("conv_id", "turn", F.md5(T.clean_whitespace(text)).alias("text_md5"))


@query
def e12_paragraphs(c):
    """Lines of prose joined where they go on: sentences are put on lines of their own."""
    return c.table("documents").where("text is not null").select("doc_id", F.md5(T.merge_paragraphs(F.regexp_replace("text", "([,.]) ", "$1\n"))).alias("text_md5"))


@query
def e26_answers(c):
    text = F.concat("text", F.lit("\n\n <b>&\nnext\n\n\n"), F.col("role"))
    return c.table("conversations").select("conv_id", "turn", F.md5(T.answer_paragraphs(text)).alias("html_md5"))


@query
def e7_ligatures(c):
    return c.table("part").select("p_partkey", T.fix_ligatures(F.concat(F.lit("ﬁne ﬂow oﬃce "), F.col("p_name"))).alias("text"))


@query
def e9_dashes(c):
    text = F.concat(F.col("c_custkey").cast("string"), F.lit("–"), F.col("c_nationkey").cast("string"), F.lit("−1 a–b 10^‒4 e—7"))
    return c.table("customer").select("c_custkey", T.normalize_dashes(text).alias("text"))


@query
def e10_scientific(c):
    return c.table("customer").select("c_custkey", T.scientific_notation(F.concat(F.lit("10^^^"), F.col("c_nationkey").cast("string"), F.lit("‒2 ^+-3"))).alias("text"))


@query
def e11_blank_lines(c):
    return c.table("customer").select("c_custkey", T.collapse_blank_lines(F.concat("c_name", F.repeat(F.lit("\n"), (F.col("c_custkey") % 6).cast("int")), F.lit("x"))).alias("text"))


@query
def e13_cleanup(c):
    return c.table("conversations").select("conv_id", "turn", F.length(T.cleanup_page("text")).cast("long").alias("chars"))


@query
def e15_clean_documents(c):
    """Documents of one source without their running heads and feet."""
    left = build.remove_headers(c.framed)
    return left.select("document_id", "page_number", F.md5("content").alias("content_md5"))


@query
def e14_headers(c):
    return build.header_lines(c.framed).select("document_id", "line", "n")


@query
def e16_tokens(c):
    return c.pages.groupBy("document_id").agg(F.sum(T.estimate_tokens("content")).alias("tokens"))


@query
def e17_truncate(c):
    """Contexts of so few tokens that the first long block is cut."""
    return retrieval.build_context(_top(c), _evidence(c), 60).select("query_id", "context")


@query
def e22_data_urls(c):
    """MIME types by extension, and the content as a data URL."""
    kind = F.element_at(F.array(*map(F.lit, (".png", ".JPG", ".jpeg", ".gif", ".bmp", ".webp", ""))), (F.col("page_id") % 7 + 1).cast("int"))
    name = F.concat(F.lit("img/"), F.col("page_id").cast("string"), kind)
    return c.table("pages").select("page_id", T.mime_type(name).alias("mime"), F.md5(T.data_url(name, F.encode("url", "UTF-8"))).alias("url_md5"))


@query
def e23_filenames(c):
    return c.table("part").select("p_partkey", T.safe_file_name(F.concat(F.lit(" a/b:"), F.col("p_name"), F.lit("?.. "))).alias("name"))


@query
def e24_model_id(c):
    model = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("lab/"), F.col("n_name"))).otherwise(F.col("n_name"))
    return c.table("nation").select("n_nationkey", T.model_id(model, F.lit("provider")).alias("model"))


@query
def e25_escape(c):
    return c.table("pages").select("page_id", F.md5(T.escape_html("html")).alias("html_md5"))


@query
def e27_rgb(c):
    return c.table("nation").select("n_nationkey", T.hex_to_rgb(F.concat(F.lit("#"), F.lpad(F.hex(F.col("n_nationkey") * 654321), 6, "0"))).alias("rgb"))


@query
def e28_strokes(c):
    rows = graph.layout(c.links).groupBy("weight").agg(F.max("width").alias("width"), F.max("alpha").alias("alpha"), F.max("distance").alias("distance"))
    return rows.select("weight", *[F.round(x, 6).alias(x) for x in ("width", "alpha", "distance")])


@query
def e29_display_time(c):
    return c.table("orders").select("o_orderkey", T.display_time(F.col("o_orderdate").cast("string")).alias("shown"))


# -- graph ---------------------------------------------------------------------------------
@query
def g1_adjacency(c):
    return graph.adjacency(c.edges)


@query
def g2_bfs(c):
    return graph.bfs_by_query(retrieval.seeds(_terms(c), c.store, c.documents.select("document_id")), c.neighbours, 2)


@query
def g3_expansion(c):
    reached = graph.bfs(retrieval.seeds(_terms(c), c.store, c.documents.select("document_id")), graph.adjacency(c.edges), DEPTH)
    return retrieval.in_scope(reached.join(c.store.registry_concepts, "concept_id"), _scope(c)).select("query_id", "concept_id", "document_id")


@query
def g4_graph_rank(c):
    index = _index(c)
    return index.distances() if index else retrieval.graph_list(_found(c), _terms(c), c.store, DEPTH).select("query_id", "concept_id", "document_id", "distance")


@query
def g5_components(c):
    return _components(c)


@query
def g6_forces(c):
    rows = graph.forces(graph.degrees(c.links, c.nodes))
    return rows.select("id", F.round("collide", 6).alias("collide"), F.round("charge", 6).alias("charge"))


@query
def g7_neighbourhood(c):
    return graph.neighbourhood(graph.adjacency(c.links), _centres(c))


@query
def u6_no_result(c):
    return retrieval.unanswered(c.intents, retrieval.answered(_terms(c), c.store, c.documents.select("document_id"), DEPTH))


@query
def bench_bm25(c):
    """Top concepts per benchmark item: keyword postings scored by BM25."""
    terms = c.stored("bench_terms", lambda: retrieval.plan_terms(c.benchmark_intents))
    if postings.asks_odd(terms, c.by_document):
        found = c.stored("bench_found", lambda: retrieval.candidates(terms, c.store, c.documents.select("document_id"), 0))
        at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "concept_id", "document_id"))
        rows = retrieval.bm25(found, terms, c.store).withColumn("position", at.cast("long")).where(F.col("position") <= TOP_K)
    else:
        rows = postings.top_bm25(terms, c.by_document, retrieval.named(terms, c.named_aliases(terms)), TOP_K)
    return rows.select("query_id", "position", "concept_id", "document_id", F.round("score", 6).alias("score"))


@query
def ask_end_to_end(c):
    top = _top(c)
    return retrieval.citations(top, _evidence(c)).select("query_id", "ord", "document_id", "page_number", joined("concepts").alias("concepts"), "evidence_loaded")
