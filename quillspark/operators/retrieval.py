"""Answering questions: scope, candidates, ranking, evidence, context, citations.

Every table carries ``query_id``, so one job answers many questions.  Term tables
are ``(query_id, term, origin, ord)``; ``origin`` is ``concept`` or ``keyword``.
The steps are lazy; store or persist what one hands to the next (terms,
candidates, the ranked top), or the plan of the whole chain grows with every
step that reads it more than once.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..workspace import join_counted
from . import graph

K1, B, RRF_K = 1.5, 0.75, 60
EVIDENCE_CAP, EVIDENCE_FLOOR = 35, 0.3
# The machine-visible marks of a context.
TITLE, TIER_1, TIER_2 = "# Knowledge Context", "\n## Tier 1: Concept Descriptions", "\n## Tier 2: Evidence Pages"
CUT_MARK = "\n[... truncated to fit max_context_tokens]"


@dataclass
class Store:
    """The tables that retrieval reads."""

    pages: DataFrame  # document_id, page_number, content
    concepts: DataFrame  # document_id, concept_id, name, description, page_numbers, keywords
    postings: DataFrame  # document_id, keyword, concept_id
    local_aliases: DataFrame  # document_id, alias, concept_id
    registry_aliases: DataFrame  # alias, concept_id
    registry_concepts: DataFrame  # concept_id, document_id
    edges: DataFrame  # document_id, source, target
    terms: DataFrame | None = None  # index_terms(postings), where it is written
    sizes: DataFrame | None = None  # document_sizes(terms), where it is written
    consistent: bool = False  # no posting, alias or registry row lacks its concept row

    def existing(self, rows: DataFrame) -> DataFrame:
        """Rows whose concept the document has."""
        if self.consistent:
            return rows
        return rows.join(self.concepts.select("concept_id", "document_id"), ["concept_id", "document_id"], "left_semi")

    def index(self) -> DataFrame:
        return self.terms if self.terms is not None else index_terms(self.postings)

    def per_document(self) -> DataFrame:
        return self.sizes if self.sizes is not None else document_sizes(self.index())


def index_terms(postings: DataFrame) -> DataFrame:
    """``(document_id, concept_id, term, len)``: the normalised keywords of every
    concept and their number, which is all that BM25 reads of the postings."""
    keys = postings.select("document_id", "concept_id", T.normalize_term("keyword").alias("term")).distinct()
    sizes = keys.groupBy("document_id", "concept_id").agg(F.count("*").alias("len"))
    return keys.join(sizes, ["document_id", "concept_id"])


def concept_terms(concepts: DataFrame) -> DataFrame:
    """The terms of :func:`index_terms` as one array per concept, which takes no
    shuffle: ``concepts`` has one row per document and concept."""
    keys = F.array_union("keywords", F.array(F.lower("name")))
    terms = F.array_distinct(F.transform(keys, lambda k: T.normalize_term(k)))
    return concepts.select("document_id", "concept_id", terms.alias("terms")).where(F.size("terms") > 0)


def document_sizes(index: DataFrame) -> DataFrame:
    """``(document_id, n, total)``: concepts of a document, and terms of all of them."""
    return index.groupBy("document_id").agg(F.count_distinct("concept_id").alias("n"), F.count("*").alias("total"))


def unknown_scope(requested: DataFrame, documents: DataFrame) -> DataFrame:
    return requested.join(documents.select("document_id"), "document_id", "left_anti")


def resolve_scope(requested: list[str] | str, documents: DataFrame) -> DataFrame:
    """``all``, one name or a list -> distinct ids; unknown names raise."""
    known = documents.select("document_id").distinct()
    if requested == "all":
        return known
    names = [requested] if isinstance(requested, str) else list(requested)
    if not names:
        raise ValueError("the scope names no document")
    wanted = documents.sparkSession.createDataFrame([(n,) for n in names], "document_id string").distinct()
    missing = sorted(r[0] for r in unknown_scope(wanted, known).collect())
    if missing:
        raise ValueError(f"unknown documents: {missing}")
    return wanted


def plan_terms(intents: DataFrame) -> DataFrame:
    """``intents(query_id, concepts, keywords)`` -> term rows, each list without
    its repeats, concepts first."""
    def part(column: str, origin: str) -> DataFrame:
        rows = intents.select("query_id", F.posexplode(F.array_distinct(column)).alias("ord", "term"))
        return rows.select("query_id", "term", F.lit(origin).alias("origin"), "ord")

    return part("concepts", "concept").unionByName(part("keywords", "keyword"))


def ranking_terms(terms: DataFrame) -> DataFrame:
    """Normalised distinct terms of a query, blanks removed."""
    return terms.select("query_id", T.normalize_term("term").alias("term")).where("term <> ''").distinct()


def seeds(terms: DataFrame, store: Store, scope: DataFrame) -> DataFrame:
    """Concepts to start from: registry alias, local alias, and the slug.  Local
    aliases count in the documents of ``scope(document_id)``, or, with a column
    ``query_id``, in those of the query itself."""
    rows = terms.where("origin = 'concept'").select("query_id", T.normalize_term("term").alias("alias"), T.slugify("term", empty="").alias("slug"))
    local = store.local_aliases.select("document_id", "alias", "concept_id")
    own = ["query_id", "document_id"] if "query_id" in scope.columns else ["document_id"]
    if own == ["document_id"]:
        local = local.join(scope, own, "left_semi").select("alias", "concept_id").distinct()
        by_local = rows.join(local, "alias")
    else:
        by_local = rows.join(local, "alias").join(scope.select(*own).distinct(), own, "left_semi")
    named = rows.join(store.registry_aliases.select("alias", "concept_id"), "alias").select("query_id", "concept_id")
    named = named.unionByName(by_local.select("query_id", "concept_id"))
    return named.unionByName(rows.where("slug <> ''").select("query_id", F.col("slug").alias("concept_id"))).distinct()


_FOUND = ["query_id", "concept_id", "document_id"]


def _search_terms(terms: DataFrame) -> DataFrame:
    return terms.select("query_id", T.normalize_term("term").alias("term"), T.slugify("term", empty="").alias("slug")).distinct()


def in_scope(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows of the documents in scope."""
    return rows.join(scope, "document_id", "left_semi")


def _registered(terms: DataFrame, store: Store) -> DataFrame:
    return _search_terms(terms).join(store.registry_aliases, F.col("term") == F.col("alias")).select("query_id", "concept_id")


def _slugs(terms: DataFrame) -> DataFrame:
    return _search_terms(terms).where("slug <> ''").select("query_id", F.col("slug").alias("concept_id"))


def named(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(query_id, concept_id)``: concepts that a term is registered for or spells."""
    rows = _search_terms(terms).join(aliases, F.col("term") == F.col("alias")).select("query_id", "concept_id")
    return rows.unionByName(_slugs(terms)).distinct()


def by_registry_alias(terms: DataFrame, store: Store, scope: DataFrame) -> DataFrame:
    """Concepts that a term is registered for, in all documents that have them."""
    rows = _registered(terms, store).distinct()
    return rows.join(in_scope(store.registry_concepts, scope), "concept_id").select(*_FOUND)


def by_slug(terms: DataFrame, store: Store, scope: DataFrame) -> DataFrame:
    """Concepts whose id is a term's slug."""
    rows = _slugs(terms).distinct()
    return rows.join(in_scope(store.registry_concepts, scope), "concept_id").select(*_FOUND)


def by_local_alias(terms: DataFrame, store: Store, scope: DataFrame) -> DataFrame:
    """Concepts that a document itself names by a term; empty targets do not count."""
    local = in_scope(store.local_aliases.where("concept_id <> ''"), scope)
    return _search_terms(terms).join(local, F.col("term") == F.col("alias")).select(*_FOUND).distinct()


def by_keyword(terms: DataFrame, store: Store, scope: DataFrame) -> DataFrame:
    """Concepts with a term among their keywords, and the keyword."""
    words = in_scope(store.postings, scope)
    wanted = _search_terms(terms).select("query_id", F.col("term").alias("keyword")).distinct()
    return join_counted(words, wanted, "keyword").select(*_FOUND, "keyword")


def candidates(terms: DataFrame, store: Store, scope: DataFrame, depth: int = 1) -> DataFrame:
    """Distinct ``(query_id, concept_id, document_id)`` from five sources.  Three of
    them find concepts, whatever the document; these are united before their
    documents are joined."""
    named = _registered(terms, store).unionByName(_slugs(terms))
    if depth > 0:
        reached = graph.bfs(seeds(terms, store, scope), graph.adjacency(store.edges), depth)
        named = named.unionByName(reached.select("query_id", "concept_id"))
    found = named.distinct().join(in_scope(store.registry_concepts, scope), "concept_id").select(*_FOUND)
    found = found.unionByName(by_local_alias(terms, store, scope)).unionByName(by_keyword(terms, store, scope).drop("keyword"))
    return store.existing(found.distinct())


def candidate_order(found: DataFrame) -> DataFrame:
    """Adds ``position``: candidates of a query by concept, then document."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("concept_id", "document_id"))
    return found.withColumn("position", at.cast("long"))


def answered(terms: DataFrame, store: Store, scope: DataFrame, depth: int = 1) -> DataFrame:
    """The queries of :func:`candidates`, each once, without its rows: terms are
    looked up among those that lead to any concept, and the search goes back from
    the concepts, so the work grows with the tables and not with their matches."""
    there = lambda rows: store.existing(in_scope(rows, scope))
    live = there(store.registry_concepts).select("concept_id").distinct()
    wanted = _search_terms(terms)
    keys = store.registry_aliases.join(live, "concept_id", "left_semi").select(F.col("alias").alias("term"))
    keys = keys.unionByName(there(store.local_aliases.where("concept_id <> ''")).select(F.col("alias").alias("term")))
    keys = keys.unionByName(there(store.postings).select(F.col("keyword").alias("term"))).distinct()
    found = wanted.join(keys, "term", "left_semi").select("query_id")
    slug = wanted.where("slug <> ''").select("query_id", F.col("slug").alias("concept_id"))
    found = found.unionByName(slug.join(live, "concept_id", "left_semi").select("query_id"))
    if depth > 0:
        near = graph.adjacency(store.edges)
        leads = graph.leading_to(live, near, depth)
        named = store.local_aliases.join(scope, "document_id", "left_semi").select("alias", "concept_id").unionByName(store.registry_aliases.select("alias", "concept_id"))
        named = named.join(leads, "concept_id", "left_semi").select(F.col("alias").alias("term")).distinct()
        own = _search_terms(terms.where("origin = 'concept'"))
        found = found.unionByName(own.join(named, "term", "left_semi").select("query_id"))
        by_slug = own.where("slug <> ''").select("query_id", F.col("slug").alias("concept_id"))
        found = found.unionByName(by_slug.join(leads, "concept_id", "left_semi").select("query_id"))
    return found.distinct()


def unanswered(intents: DataFrame, found: DataFrame) -> DataFrame:
    """Questions without any candidate, which are answered by a fixed sentence."""
    return intents.select("query_id").join(found.select("query_id"), "query_id", "left_anti")


def bm25_stats(found: DataFrame, store: Store) -> DataFrame:
    """Per query, over all concepts of the candidates' documents: ``(n, avg)``."""
    docs = found.select("query_id", "document_id").distinct()
    return docs.join(store.per_document(), "document_id").groupBy("query_id").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avg"))


def bm25(found: DataFrame, terms: DataFrame, store: Store) -> DataFrame:
    """``(query_id, concept_id, document_id, score)`` of candidates above 0.

    The index is read once, for the terms of any query; what a query's documents
    hold of its terms gives both the document frequencies and the scored rows."""
    stats = bm25_stats(found, store)
    wanted = ranking_terms(terms)
    docs = found.select("query_id", "document_id").distinct()
    hits = join_counted(store.index(), wanted, "term").join(docs, ["query_id", "document_id"], "left_semi")
    df = hits.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    rows = hits.join(found, _FOUND, "left_semi").join(df, ["query_id", "term"]).join(stats, "query_id")
    part = T.bm25_idf("n", "df") * (K1 + 1) / (1.0 + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return rows.groupBy(*_FOUND).agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")


def alias_matches(found: DataFrame, terms: DataFrame, store: Store) -> DataFrame:
    """``matches``: query terms that name the candidate by a local alias or by its
    slug; a term that does both counts once."""
    wanted = ranking_terms(terms).withColumn("slug", T.slugify("term", empty=""))
    slug = found.join(wanted.select("query_id", "term", F.col("slug").alias("concept_id")), ["query_id", "concept_id"])
    local = store.local_aliases.select("document_id", F.col("alias").alias("term"), "concept_id").where("concept_id <> ''")
    alias = wanted.select("query_id", "term").join(local, "term").join(found, _FOUND, "left_semi")
    both = slug.select(*_FOUND, "term").unionByName(alias.select(*_FOUND, "term")).distinct()
    return both.groupBy(*_FOUND).agg(F.count("*").alias("matches"))


def alias_list(found: DataFrame, terms: DataFrame, store: Store) -> DataFrame:
    return alias_matches(found, terms, store)


def graph_list(found: DataFrame, terms: DataFrame, store: Store, depth: int = 1) -> DataFrame:
    """Distances of the candidates from the query's own concepts; local aliases
    come from the documents of the query's candidates."""
    docs = found.select("query_id", "document_id").distinct()
    reached = graph.bfs(seeds(terms, store, docs), graph.adjacency(store.edges), depth)
    return found.join(reached, ["query_id", "concept_id"])


def fuse(found: DataFrame, by_bm25: DataFrame, by_alias: DataFrame, by_graph: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion; all candidates get a rank, 0 scores too."""
    keys = ["query_id", "concept_id", "document_id"]
    order = Window.partitionBy("query_id")
    place = lambda df, first: df.select(*keys, F.row_number().over(order.orderBy(first, "concept_id", "document_id")).alias("pos"))
    lists = place(by_bm25, F.desc("score")).unionByName(place(by_alias, F.desc("matches"))).unionByName(place(by_graph, F.asc("distance")))
    # candidates are rows of no place, so one aggregate takes the place of a join of all of them
    parts = lists.select(*keys, (1.0 / (RRF_K + F.col("pos"))).alias("part"), F.lit(False).alias("_found"))
    parts = parts.unionByName(found.select(*keys, F.lit(0.0).alias("part"), F.lit(True).alias("_found")))
    scored = parts.groupBy(*keys).agg(F.round(F.sum("part"), 9).alias("score"), F.max("_found").alias("_found")).where("_found").drop("_found")
    rank = F.row_number().over(order.orderBy(F.desc("score"), "concept_id", "document_id"))
    return scored.withColumn("rank", rank.cast("long"))


def rank(found: DataFrame, terms: DataFrame, store: Store, depth: int = 1) -> DataFrame:
    return fuse(found, bm25(found, terms, store), alias_list(found, terms, store), graph_list(found, terms, store, depth))


def hydrate(ranked: DataFrame, store: Store) -> DataFrame:
    """Candidates with pages and description: joined after the cut, so long
    descriptions travel for the kept rows only."""
    rows = store.concepts.select("concept_id", "document_id", "description", F.array_sort(F.array_distinct("page_numbers")).alias("evidence_pages"))
    return ranked.join(rows, ["concept_id", "document_id"])


def load_pages(top: DataFrame, store: Store, top_k: int = 5) -> DataFrame:
    """The pages of the first ``top_k`` candidates, each once per query, with the
    best rank that cites it."""
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    wanted = top.where(F.col("rank") <= top_k).select("query_id", "document_id", F.explode("evidence_pages").alias("page_number"), "rank")
    wanted = wanted.groupBy("query_id", "document_id", "page_number").agg(F.min("rank").alias("rank"))
    return wanted.join(store.pages.select("document_id", "page_number", "content"), ["document_id", "page_number"])


def evidence(top: DataFrame, terms: DataFrame | None, store: Store, top_k: int = 5) -> DataFrame:
    """Scored pages of the first ``top_k`` candidates.

    With terms: BM25 over the pages that a query loaded, divided by the best,
    pages below the floor dropped, 35 at most.  Without: in candidate order."""
    loaded = load_pages(top, store, top_k)
    if terms is None:
        at = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "page_number", "document_id"))
        return loaded.withColumn("score", F.lit(0.0)).withColumn("position", at.cast("long"))
    tokens = loaded.withColumn("_t", T.tokens("content")).withColumn("len", F.size("_t"))
    stats = tokens.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    stats = stats.withColumn("avg", F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0))
    pages = ["query_id", "document_id", "page_number"]
    words = tokens.select(*pages, F.explode("_t").alias("term")).join(ranking_terms(terms), ["query_id", "term"], "left_semi")
    tf = words.groupBy(*pages, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    part = T.bm25_idf("n", "df") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    raw = tf.join(df, ["query_id", "term"]).join(stats, "query_id").join(tokens.select(*pages, "len"), pages).groupBy(*pages).agg(F.sum(part).alias("raw"))
    best = F.max("raw").over(Window.partitionBy("query_id"))
    scored = raw.withColumn("score", F.round(F.col("raw") / best, 9)).where((F.col("score") >= EVIDENCE_FLOOR) & (F.col("score") > 0))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "page_number"))
    scored = scored.withColumn("position", at.cast("long")).where(F.col("position") <= EVIDENCE_CAP)
    return scored.drop("raw").join(loaded, pages)


def context_blocks(top: DataFrame, pages: DataFrame) -> DataFrame:
    """``(query_id, tier, at, text)`` in the order of the context."""
    heads = top.select("query_id").unionByName(pages.select("query_id")).distinct()
    one = F.concat(F.lit("\n"), F.col("rank").cast("string"), F.lit(". Concept `"), F.col("concept_id"), F.lit("` (document: "), F.col("document_id"), F.lit(")\n   "), F.coalesce("description", F.lit("")))
    two = F.concat(F.lit("\n### "), F.col("document_id"), F.lit(" — page "), F.col("page_number").cast("string"), F.lit("\n"), F.col("content"))
    head = lambda tier, text: heads.select("query_id", F.lit(tier).alias("tier"), F.lit(0).cast("long").alias("at"), F.lit(text).alias("text"))
    return (
        head(0, TITLE).unionByName(head(1, TIER_1)).unionByName(head(3, TIER_2))
        .unionByName(top.select("query_id", F.lit(2).alias("tier"), F.col("rank").alias("at"), one.alias("text")))
        .unionByName(pages.select("query_id", F.lit(4).alias("tier"), F.col("position").alias("at"), two.alias("text")))
    )


def build_context(top: DataFrame, pages: DataFrame, max_tokens: int = 6000) -> DataFrame:
    """``(query_id, context)``: blocks while they fit, the first that does not is
    cut and ends the context."""
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    order = Window.partitionBy("query_id").orderBy("tier", "at")
    rows = context_blocks(top, pages).withColumn("cost", T.estimate_tokens("text"))
    rows = rows.withColumn("cum", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    room = F.lit(max_tokens) - (F.col("cum") - F.col("cost"))
    fits = F.col("cum") <= max_tokens
    part = F.regexp_replace(F.substring("text", F.lit(1), F.greatest(F.lit(0), (room * T.CHARS_PER_TOKEN - len(CUT_MARK)).cast("int"))), r"(?U)\s+$", "")
    shown = F.when(fits, F.col("text")).when((room > 0) & (part != ""), F.concat(part, F.lit(CUT_MARK)))
    over = F.sum(F.when(~fits, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("shown", shown).withColumn("over", over).where((F.col("over") <= 1) & F.col("shown").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("tier", "at", "shown")))
    whole = F.array_join(F.transform(F.col("parts"), lambda p: p["shown"]), "\n")
    out = rows.groupBy("query_id").agg(parts.alias("parts")).select("query_id", whole.alias("context"))
    return out.withColumn("context", F.substring("context", 1, max_tokens * T.CHARS_PER_TOKEN))


def citations(top: DataFrame, pages: DataFrame) -> DataFrame:
    """``(query_id, ord, document_id, page_number, concepts, evidence_loaded)``:
    every page of every candidate, in the order of first appearance."""
    rows = top.select("query_id", "rank", "concept_id", "document_id", F.posexplode("evidence_pages").alias("_p", "page_number"))
    keys = ["query_id", "document_id", "page_number"]
    grouped = rows.groupBy(*keys).agg(F.min(F.struct("rank", "_p")).alias("first"), F.array_sort(F.collect_list(F.struct("rank", "concept_id"))).alias("l"))
    seen = pages.select(*keys, F.lit(True).alias("_seen")).distinct()
    out = grouped.join(seen, keys, "left")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return out.select("query_id", at.cast("long").alias("ord"), "document_id", "page_number", F.array_distinct("l.concept_id").alias("concepts"), F.coalesce("_seen", F.lit(False)).alias("evidence_loaded"))


def response(top: DataFrame) -> DataFrame:
    """Documents used, sorted; concepts in rank order, repeats kept."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "concept_id")))
    return top.groupBy("query_id").agg(F.array_sort(F.collect_set("document_id")).alias("documents_used"), listed.alias("l")).select("query_id", "documents_used", F.col("l.concept_id").alias("concepts_used"))
