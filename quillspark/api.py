"""Build a knowledge store from parsed pages, ask it, browse it."""
from __future__ import annotations

import asyncio
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import build, extract, graph, retrieval
from .sources import sinks
from .workspace import Workspace

NO_RESULT = "Nothing in the selected documents answers this question."


@dataclass
class Config:
    page_batch: int = 3
    image_page_batch: int = 1
    workers: int | None = None
    max_retries: int = 3
    top_k_concepts: int = 25
    top_k_evidence_pages: int = 5
    max_context_tokens: int = 6000
    relationship_depth: int = 1
    buckets: int = sinks.BUCKETS
    image_folder: str | None = None  # where image pages' files lie; their paths are relative to it
    append_metadata: dict[str, str] = field(default_factory=dict)
    dump: str | None = None  # a shared folder to which the steps of a question write their tables


TABLES = ("documents", "pages", "concepts", "edges", "postings", "local_aliases", "glossary", "procedures", "apis", "usage", "validation", "alias_log", "terms")


def build_tables(pages: DataFrame, provider=None, config: Config | None = None) -> dict[str, DataFrame]:
    """``pages(document_id, title, page_number, content)`` -> the store's tables.

    Rows follow ``batch_id`` and place, whatever the order of the calls."""
    config, provider = config or Config(), provider or extract.WordProvider()
    ws = Workspace(pages.sparkSession, "build")
    typed = build.classify(pages.withColumn("page_number", F.col("page_number").cast("int")))
    files = None
    if config.image_folder is not None:
        files = ws.keep(build.list_files(ws.spark, config.image_folder), "files")
        typed = build.resolve_images(typed, config.image_folder, config.image_folder)
    split = ws.keep(build.split_empty(typed, files), "split")
    kept = split.where("kept")
    batches = build.batch_table(build.batches(kept, config.page_batch, config.image_page_batch))
    if config.image_folder is not None:
        batches = build.attach_images(batches, ws.spark, config.image_folder)
    batches = ws.keep(batches, "batches")
    extract.check_vision(batches, provider)
    # the calls are made once: everything below reads their written answers
    raw_answers = ws.keep(extract.run_provider(batches, provider, config.workers, config.max_retries), "answers")
    answers = extract.parse_answers(raw_answers).join(batches.select("document_id", "batch_id", F.col("page_numbers").alias("allowed")), ["document_id", "batch_id"])
    raw = ws.keep(extract.concepts(answers), "raw")
    known = kept.groupBy("document_id").agg(F.collect_set("page_number").alias("allowed"))
    checked = ws.keep(build.validate_concepts(raw, known), "checked")
    concepts = ws.keep(build.merge_concepts(checked.where("valid").drop("valid", "reason")), "concepts")
    edges = build.graph_edges(build.dedup_edges(extract.relationships(answers, raw)), concepts)
    sizes = split.groupBy("document_id").agg(
        F.max("title").alias("title"), F.count("*").alias("pages"), F.count_if("kept").alias("pages_extracted"),
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("page_number")))).alias("dropped_pages"),
    )
    metadata = F.create_map(*[F.lit(x) for kv in config.append_metadata.items() for x in kv]).cast("map<string,string>")
    documents = sizes.withColumn("append_metadata", metadata).withColumn("category", F.try_element_at("append_metadata", F.lit("category"))).withColumn("version", F.lit(1))
    return {
        "documents": documents,
        "pages": kept.select("document_id", "page_number", "content", "content_type"),
        "concepts": concepts,
        "edges": edges,
        "postings": build.keyword_postings(concepts),
        "terms": retrieval.index_terms(build.keyword_postings(concepts)),
        "local_aliases": build.alias_map(extract.aliases(answers)),
        **{k: build.first_entries(extract.entries(answers, k), "body", "page_numbers") for k in ("glossary", "procedures", "apis")},
        "usage": raw_answers.select("document_id", "batch_id", "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens")),
        "validation": build.validation_summary(checked),
    }


def build_kb(pages: DataFrame, root: str, provider=None, config: Config | None = None) -> sinks.Snapshot:
    """Build and register documents: their rows replace earlier ones, versions grow
    by one, and the concept that an alias was first registered for stays (builds in
    their order, documents of one build in id order).

    Only the buckets of the built documents are read and rewritten.  The state is
    read once; if another build commits in between, ``sinks.StoreChanged`` is raised
    and the store keeps that build's state."""
    spark, config = pages.sparkSession, config or Config()
    ws = Workspace(spark, "register")
    try:
        base = sinks.current_snapshot(spark, root)
    except sinks.StoreMissing:
        base = sinks.Snapshot(root, 0, config.buckets)
    new = build_tables(pages, provider, config)
    new = {t: ws.keep(df, t) for t, df in new.items()}
    new["alias_log"] = new["local_aliases"].withColumn("build", F.lit(base.number + 1).cast("long"))
    if not base.number:
        return sinks.write_snapshot(spark, new, base)
    changed = sorted(r[0] for r in new["documents"].select(base.bucket_of()).distinct().collect())  # base.buckets at most
    old = {t: base.read(spark, t, changed) for t in TABLES}
    merged = {t: build.replace_documents(old[t], new[t].select(*old[t].columns)) for t in TABLES}
    # what was registered stays registered, with its first build
    log = old["alias_log"].unionByName(new["alias_log"]).groupBy("document_id", "alias", "concept_id").agg(F.min("build").alias("build"))
    merged["alias_log"] = log.select(*old["alias_log"].columns)
    versions = build.bump_versions(old["documents"].select("document_id", "version"), new["documents"])
    merged["documents"] = merged["documents"].drop("version").join(versions, "document_id").select(*old["documents"].columns)
    return sinks.write_snapshot(spark, merged, base, changed)


def open_store(spark: SparkSession, root: str, state: sinks.Snapshot | None = None) -> retrieval.Store:
    """The tables of one state, the current one unless ``state`` names it."""
    state = state or sinks.current_snapshot(spark, root)
    t = {n: state.read(spark, n) for n in ("pages", "concepts", "postings", "local_aliases", "edges", "alias_log", "terms")}
    first = build.registry_aliases(t["alias_log"], "build", "document_id")
    return retrieval.Store(t["pages"], t["concepts"], t["postings"], t["local_aliases"], first, build.registry_concepts(t["concepts"]), t["edges"], t["terms"])


def fallback_intents(questions: DataFrame) -> DataFrame:
    """``questions(query_id, question)`` -> intents from the question's words."""
    return questions.select("query_id", F.array().cast("array<string>").alias("concepts"), T.query_words("question").alias("keywords"))


def understand(questions: DataFrame, provider=None, max_retries: int = 0) -> DataFrame:
    """Intents by the provider, by the words where its answer does not parse."""
    plain = fallback_intents(questions)
    if provider is None:
        return plain

    def run(parts):
        import pandas as pd

        for rows in parts:
            out = []
            for qid, text in zip(rows["query_id"], rows["question"]):
                try:
                    answer = extract.call_provider(provider, text, None, max_retries)[0]
                except extract.ProviderError:
                    answer = ""
                out.append((qid, answer))
            yield pd.DataFrame(out, columns=["query_id", "raw"])

    kind = dict(questions.dtypes)["query_id"]
    raw = questions.select("query_id", "question").mapInPandas(run, f"query_id {kind}, raw string").withColumn("v", T.extract_json("raw"))
    told = raw.select("query_id", F.col("v").isNotNull().alias("ok"), extract.text_list(extract.as_list(F.col("v"), "$.concepts")).alias("c"), extract.text_list(extract.as_list(F.col("v"), "$.keywords")).alias("k"))
    both = plain.join(told, "query_id", "left")
    return both.select(
        "query_id", F.when(F.col("ok"), F.col("c")).otherwise(F.col("concepts")).alias("concepts"), F.when(F.col("ok"), F.col("k")).otherwise(F.col("keywords")).alias("keywords")
    )


@dataclass
class Answer:
    """Result tables of :func:`ask_all`, one row set per ``query_id``."""

    context: DataFrame
    citations: DataFrame
    used: DataFrame
    unanswered: DataFrame


def ask_all(intents: DataFrame, store: retrieval.Store, scope: DataFrame, config: Config | None = None) -> Answer:
    config, ws = config or Config(), Workspace(intents.sparkSession, "ask")
    if config.dump:
        ws.root, ws._noted = config.dump.rstrip("/"), True  # stays
    terms = ws.keep(retrieval.plan_terms(intents), "terms")
    found = ws.keep(retrieval.candidates(terms, store, scope, config.relationship_depth), "found")
    lists = [
        ws.keep(retrieval.bm25(found, terms, store), "bm25"),
        ws.keep(retrieval.alias_list(found, terms, store), "alias"),
        ws.keep(retrieval.graph_list(found, terms, store, config.relationship_depth), "graph"),
    ]
    ranked = retrieval.fuse(found, *lists).where(F.col("rank") <= config.top_k_concepts)
    top = ws.keep(retrieval.hydrate(ranked, store), "top")
    pages = ws.keep(retrieval.evidence(top, terms, store, config.top_k_evidence_pages), "evidence")
    return Answer(
        retrieval.build_context(top, pages, config.max_context_tokens),
        retrieval.citations(top, pages),
        retrieval.response(top),
        retrieval.unanswered(intents, found),
    )


def ask(spark: SparkSession, root: str, question: str, scope: list[str] | str = "all", config: Config | None = None, provider=None, generate=None) -> dict:
    """One question: answer, citations, documents and concepts used.  ``generate``
    turns (question, context) into prose; without it the context is the answer."""
    state = sinks.current_snapshot(spark, root)
    store, documents = open_store(spark, root, state), state.read(spark, "documents")
    intents = understand(spark.createDataFrame([(0, question)], "query_id long, question string"), provider)
    out = ask_all(intents, store, retrieval.resolve_scope(scope, documents), config)
    used = out.used.first()
    if used is None:
        return {"answer": NO_RESULT, "citations": [], "documents_used": [], "concepts_used": []}
    context = out.context.first()["context"]
    return {
        "answer": generate(question, context) if generate else context,
        "citations": [r.asDict() for r in out.citations.orderBy("ord").drop("query_id").collect()],
        "documents_used": used["documents_used"],
        "concepts_used": used["concepts_used"],
    }


def run_sync(call):
    """The result of a coroutine, in a thread of its own where a loop runs already:
    providers whose interface is asynchronous are called so from a task."""
    try:
        asyncio.get_running_loop()
    except RuntimeError:
        return asyncio.run(call)
    with ThreadPoolExecutor(1) as pool:
        return pool.submit(asyncio.run, call).result()


# -- browsing ----------------------------------------------------------------------
def list_bundles(spark: SparkSession, root: str) -> DataFrame:
    title = F.coalesce(F.expr("nullif(title, '')"), F.col("document_id"))
    return sinks.read_table(spark, root, "documents").select("document_id", title.alias("title"), "pages", "version")


def registry_stats(spark: SparkSession, root: str) -> DataFrame:
    state = sinks.current_snapshot(spark, root)
    return build.registry_statistics(*[state.read(spark, t) for t in ("documents", "concepts", "edges")])


def concepts(spark: SparkSession, root: str, document_id: str) -> DataFrame:
    return sinks.read_table(spark, root, "concepts").where(F.col("document_id") == document_id)


def concept(spark: SparkSession, root: str, document_id: str, concept_id: str) -> DataFrame:
    return concepts(spark, root, document_id).where(F.col("concept_id") == concept_id)


def page(spark: SparkSession, root: str, document_id: str, number: int) -> DataFrame:
    return sinks.read_table(spark, root, "pages").where((F.col("document_id") == document_id) & (F.col("page_number") == number))


def indexes(spark: SparkSession, root: str, document_id: str) -> dict[str, DataFrame]:
    state = sinks.current_snapshot(spark, root)
    here = lambda t: state.read(spark, t).where(F.col("document_id") == document_id)
    return {"keyword": build.keyword_index(here("postings")), "page": build.page_index(here("concepts")), "alias": here("local_aliases"), "glossary": here("glossary"), "procedure": here("procedures"), "api": here("apis")}


def export_bundles(spark: SparkSession, root: str, path: str) -> None:
    """Every table of the current state as JSON below ``path/<table>/document_id=...``,
    keys sorted, for readers outside Spark; ``validation`` is the report."""
    state = sinks.current_snapshot(spark, root)
    for table in TABLES:
        sinks.export_json(state.read(spark, table), f"{path}/{table}", "document_id")


def merged_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    state = sinks.current_snapshot(spark, root)
    nodes = graph.with_idx(graph.nodes(state.read(spark, "concepts")))
    return nodes, graph.links(state.read(spark, "edges"), nodes)
