"""Building knowledge tables: pages, batches, validation, merge, indexes."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Relation types that a graph may hold.
RELATION_TYPES = ["part_of", "references", "depends_on", "causes", "relates_to", "example_of", "is_a", "has_a", "uses"]


# -- pages and batches ---------------------------------------------------
def classify(pages: DataFrame) -> DataFrame:
    """``content_type``: a page that is one image path is ``image``."""
    return pages.withColumn("content_type", F.when(T.is_image_page("content"), "image").otherwise("text"))


def resolve_images(pages: DataFrame, root: str | None, folder: str) -> DataFrame:
    """Image pages hold a whole path: against the storage root, else the folder of
    the document."""
    path = T.image_path("content", F.lit(root).cast("string"), F.lit(folder))
    return pages.withColumn("content", F.when(F.col("content_type") == "image", path).otherwise(F.col("content")))


def split_empty(pages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds ``kept``: text pages with something on them, and image pages whose file
    is in ``files(path)`` (all of them, where no listing is given)."""
    blank = T.strip(F.coalesce("content", F.lit(""))) == ""
    image = F.col("content_type") == "image"
    if files is None:
        return pages.withColumn("kept", image | ~blank)
    known = files.select(F.col("path").alias("_path"), F.lit(True).alias("_known")).distinct()
    rows = pages.join(known, F.when(image, F.col("content")) == F.col("_path"), "left")
    return rows.withColumn("kept", F.when(image, F.coalesce("_known", F.lit(False))).otherwise(~blank)).drop("_path", "_known")


def image_errors(batches: DataFrame, files: DataFrame) -> DataFrame:
    """``(document_id, batch_id, page_number, error)`` of the pages of image batches
    whose file is not in ``files(path)``."""
    rows = batches.where("content_type = 'image'").select("document_id", "batch_id", F.explode(F.arrays_zip("page_numbers", "images")).alias("p"))
    rows = rows.select("document_id", "batch_id", F.col("p.page_numbers").alias("page_number"), F.col("p.images").alias("path"))
    error = F.format_string("Batch %d: image file for page %d not readable: %s", "batch_id", "page_number", "path")
    return rows.join(files.select("path").distinct(), "path", "left_anti").select("document_id", "batch_id", "page_number", error.alias("error"))


def list_files(spark, folder: str, glob: str = "*") -> DataFrame:
    """``(path, length)`` of the files below a folder, without reading them; paths
    without a ``file:`` scheme."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def attach_images(batches: DataFrame, spark, folder: str) -> DataFrame:
    """Image batches with the data URLs of their files in place of the paths, in
    page order; a file that is missing fails the job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    rows = batches.where("content_type = 'image'").select("document_id", "batch_id", F.posexplode("images").alias("at", "path"))
    found = rows.join(files, "path", "left")
    url = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("image file is missing: "), F.col("path")))).otherwise(T.data_url("path", F.col("content")))
    urls = found.select("document_id", "batch_id", F.struct("at", url.alias("url")).alias("u")).groupBy("document_id", "batch_id").agg(F.array_sort(F.collect_list("u")).alias("u"))
    return batches.join(urls, ["document_id", "batch_id"], "left").withColumn("images", F.when(F.col("content_type") == "image", F.col("u.url"))).drop("u")


def runs(pages: DataFrame) -> DataFrame:
    """Adds ``run``: its number grows whenever the content type changes."""
    order = Window.partitionBy("document_id").orderBy("page_number")
    change = F.when(F.lag("content_type").over(order).eqNullSafe(F.col("content_type")), 0).otherwise(1)
    return pages.withColumn("_c", change).withColumn("run", F.sum("_c").over(order).cast("long")).drop("_c")


def batches(pages: DataFrame, page_batch: int = 3, image_page_batch: int = 1) -> DataFrame:
    """Adds ``batch_id``: 1..n over a document, chunks of each run."""
    size = F.when(F.col("content_type") == "image", image_page_batch).otherwise(page_batch)
    within = Window.partitionBy("document_id", "run").orderBy("page_number")
    chunked = runs(pages).withColumn("_chunk", F.floor((F.row_number().over(within) - 1) / size))
    ids = F.dense_rank().over(Window.partitionBy("document_id").orderBy("run", "_chunk"))
    return chunked.withColumn("batch_id", ids.cast("long")).drop("_chunk")


def batch_table(batched: DataFrame) -> DataFrame:
    """One row per batch with its page numbers and joined text."""
    part = F.concat(F.lit("### Page "), F.col("page_number").cast("string"), F.lit("\n"), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct("page_number", part.alias("part"), "content")))
    grouped = batched.groupBy("document_id", "batch_id", "content_type").agg(rows.alias("rows"))
    return grouped.select(
        "document_id",
        "batch_id",
        "content_type",
        F.col("rows.page_number").alias("page_numbers"),
        F.when(F.col("content_type") == "text", F.array_join("rows.part", "\n\n")).alias("text"),
        F.when(F.col("content_type") == "image", F.col("rows.content")).alias("images"),
    )


# -- extraction clean-up ---------------------------------------------------
def sanitize_pages(raw, allowed):
    """Page numbers as sorted distinct integers that are allowed."""
    numbers = F.transform(raw, lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.array_intersect(F.filter(numbers, lambda x: x.isNotNull()), allowed)))


def validate_concepts(concepts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``reason``: a name, and pages that the document has."""
    rows = concepts.join(allowed, "document_id", "left")
    legal = F.forall("page_numbers", lambda p: F.array_contains(F.col("allowed"), p)) & (F.size("page_numbers") > 0)
    reason = (
        F.when(T.strip(F.coalesce("name", F.lit(""))) == "", "missing name")
        .when(F.size("page_numbers") <= 0, "no pages")
        .when(~F.coalesce(legal, F.lit(False)), "unknown pages")
    )
    return rows.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("allowed")


def validate_words(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & (T.strip(column) != ""))


def validate_entries(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Glossary, procedure or API rows with a key and with pages, all of which
    ``allowed(document_id, allowed)`` has."""
    legal = (F.size("page_numbers") > 0) & F.forall("page_numbers", lambda p: F.array_contains("allowed", p))
    return rows.where("key <> ''").join(allowed, "document_id").where(legal).drop("allowed")


def keyword_set(rows: DataFrame) -> DataFrame:
    """``(document_id, keyword)``: all keywords of a document's raw concepts, lower
    case, each once."""
    return rows.select("document_id", F.explode("keywords").alias("keyword")).select("document_id", F.lower("keyword").alias("keyword")).distinct()


def validation_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("document_id").agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid")
    )


# -- merge -----------------------------------------------------------------
def merge_concepts(rows: DataFrame) -> DataFrame:
    """One row per (document, concept): sorted union of pages, aliases and
    keywords, first name, strictly longest description (the earlier one of equal
    length).  ``ord`` is the position of the raw row, so the result does not
    depend on task order; the aggregates combine before the shuffle."""
    low = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(c, lambda x: F.lower(x))))))
    return rows.groupBy("document_id", "concept_id").agg(
        F.min_by("name", "ord").alias("name"),
        F.max_by("description", F.struct(F.length("description").alias("l"), (-F.col("ord")).alias("o"))).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("page_numbers"),
        low(F.col("aliases")).alias("aliases"),
        low(F.col("keywords")).alias("keywords"),
        F.min("ord").alias("ord"),
    )


def dedup_edges(edges: DataFrame) -> DataFrame:
    """First edge of each (document, source, target, type, sorted pages)."""
    keyed = edges.withColumn("page_numbers", F.array_sort("page_numbers"))
    keys = ["document_id", "source", "target", "type", "page_numbers"]
    return keyed.groupBy(*keys).agg(F.min("ord").alias("ord"))


def graph_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges between different known concepts; unknown types become
    ``relates_to``."""
    known = concepts.select("document_id", "concept_id").distinct()
    ends = edges.where("source <> target")
    for end in ("source", "target"):
        ends = ends.join(known.withColumnRenamed("concept_id", end), ["document_id", end], "left_semi")
    legal = F.when(F.col("type").isin(RELATION_TYPES), F.col("type")).otherwise("relates_to")
    return ends.withColumn("type", legal).select("document_id", "source", "target", "type", "page_numbers", "ord")


def alias_map(aliases: DataFrame) -> DataFrame:
    """Last concept of each alias of a document."""
    rows = aliases.select("document_id", F.lower(F.trim("alias")).alias("alias"), "concept_id", "ord").where("alias <> ''")
    return rows.groupBy("document_id", "alias").agg(F.max_by("concept_id", "ord").alias("concept_id"))


def first_entries(rows: DataFrame, *values: str) -> DataFrame:
    """First entry of each trimmed lower-case key of a document."""
    keyed = rows.withColumn("key", F.lower(T.strip("key"))).where("key <> ''")
    best = keyed.groupBy("document_id", "key").agg(F.min_by(F.struct(*values), "ord").alias("v"))
    return best.select("document_id", "key", *[F.col(f"v.{v}").alias(v) for v in values])


# -- indexes ---------------------------------------------------------------
def keyword_postings(concepts: DataFrame, merged: bool = False) -> DataFrame:
    """``(document, keyword, concept)``; the lower-cased name is a key as well.
    Concepts of :func:`merge_concepts` (``merged``) have no repeats to take out."""
    keys = F.array_union("keywords", F.array(F.lower("name")))
    rows = concepts.select("document_id", F.explode(keys).alias("keyword"), "concept_id")
    return rows if merged else rows.distinct()


def keyword_index(postings: DataFrame) -> DataFrame:
    return postings.groupBy("document_id", "keyword").agg(F.array_sort(F.collect_set("concept_id")).alias("concept_ids"))


def page_index(concepts: DataFrame) -> DataFrame:
    """Concepts of every page, in concept order."""
    rows = concepts.select("document_id", F.explode("page_numbers").alias("page_number"), "concept_id", "ord")
    listed = F.array_sort(F.collect_list(F.struct("ord", "concept_id")))
    return rows.groupBy("document_id", "page_number").agg(listed.alias("l")).select("document_id", "page_number", F.col("l.concept_id").alias("concept_ids"))


# -- registry --------------------------------------------------------------
def registry_concepts(concepts: DataFrame) -> DataFrame:
    return concepts.select("concept_id", "document_id").distinct()


def registry_keywords(postings: DataFrame) -> DataFrame:
    """``(keyword, documents)``: the documents of every keyword, sorted."""
    pairs = postings.select("keyword", "document_id").distinct()
    return pairs.groupBy("keyword").agg(F.array_sort(F.collect_list("document_id")).alias("documents"))


def registry_aliases(registered: DataFrame, *order: str) -> DataFrame:
    """The concept that every alias was registered for first, by the columns
    ``order`` (the documents' ids unless another order is known)."""
    first = F.struct(*(order or ("document_id",)))
    return registered.groupBy("alias").agg(F.min_by("concept_id", first).alias("concept_id"))


def registry_tags(documents: DataFrame) -> DataFrame:
    """``(category, documents)``: the documents of every category, sorted."""
    pairs = documents.where("category is not null and category <> ''").select("category", "document_id").distinct()
    return pairs.groupBy("category").agg(F.array_sort(F.collect_list("document_id")).alias("documents"))


def global_graph(concepts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All concepts, and all edges of different (document, ends, type, pages); an
    edge without a type ``relates_to``."""
    typed = edges.withColumn("type", F.coalesce("type", F.lit("relates_to")))
    return concepts.select("concept_id").distinct(), typed.select("document_id", "source", "target", "type", "page_numbers").distinct()


def registry_statistics(documents: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    d = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))
    c = concepts.agg(F.count_distinct("concept_id").alias("concepts"))
    e = edges.agg(F.count("*").alias("relationships"))
    return d.crossJoin(c).crossJoin(e)  # three rows of one


def replace_documents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by document: the new rows of a document take the place of all its
    old ones."""
    gone = new.select("document_id").distinct()
    return stored.join(gone, "document_id", "left_anti").unionByName(new)


def bump_versions(stored: DataFrame, built: DataFrame) -> DataFrame:
    """``(document_id, version)`` after a build: previous plus one, or 1."""
    new = built.select("document_id").distinct().withColumn("_n", F.lit(1))
    joined = stored.join(new, "document_id", "full_outer")
    return joined.select("document_id", (F.coalesce("version", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("version"))


# -- documents -------------------------------------------------------------
def repeated_lines(pages: DataFrame) -> DataFrame:
    """``count`` and mean position of every non-blank line of a document."""
    lines = pages.select("document_id", "page_number", F.posexplode(T.lines("content")).alias("i", "line"))
    lines = lines.withColumn("line", T.strip("line")).where("line <> ''")
    page = Window.partitionBy("document_id", "page_number")
    at = F.row_number().over(page.orderBy("i")) - 1
    placed = lines.withColumn("_at", at / F.greatest(F.count("*").over(page) - 1, F.lit(1)))
    return placed.groupBy("document_id", "line").agg(F.count("*").alias("n"), F.avg("_at").alias("mean_position"))


def header_lines(pages: DataFrame, least: int = 3) -> DataFrame:
    """Lines at the top or bottom of at least half of a document's pages."""
    sizes = pages.groupBy("document_id").agg(F.count("*").alias("pages"))
    stats = repeated_lines(pages).join(sizes, "document_id")
    edge = (F.col("mean_position") < 0.15) | (F.col("mean_position") > 0.85)
    return stats.where((F.col("pages") >= least) & (F.col("n") >= least) & (F.col("n") >= 0.5 * F.col("pages")) & edge).select("document_id", "line", "n")


def remove_headers(pages: DataFrame, least: int = 3) -> DataFrame:
    """Pages without their header and footer lines; blank lines stay."""
    found = header_lines(pages, least).groupBy("document_id").agg(F.collect_set("line").alias("_gone"))
    rows = pages.join(found, "document_id", "left")
    kept = F.filter(T.lines("content"), lambda s: ~F.coalesce(F.array_contains(F.col("_gone"), T.strip(s)), F.lit(False)))
    return rows.withColumn("content", F.when(F.col("_gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n"))).drop("_gone")


def cleanup_pages(pages: DataFrame, least: int = 3) -> DataFrame:
    """``pages(document_id, page_number, content)``: every page cleaned, then the
    header and footer lines of its document removed."""
    return remove_headers(pages.withColumn("content", T.cleanup_page(F.coalesce("content", F.lit("")))), least)


def format_markdown(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``documents(document_id, tags)`` and their pages as markdown text."""
    part = F.concat(F.lit("# Page "), F.col("page_number").cast("string"), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    body = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", part.alias("part")))).alias("rows"))
    items = F.when(F.size("tags") > 0, F.array_join(F.transform("tags", lambda t: F.concat(F.lit("- "), t)), "\n")).otherwise("- _No metadata_")
    text = F.concat(F.lit("# "), F.col("document_id"), F.lit("\n\n## Metadata\n\n"), items, F.lit("\n\n---\n\n"), F.coalesce(F.array_join("rows.part", "\n"), F.lit("")))
    return documents.join(body, "document_id", "left").select("document_id", F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("\n")).alias("text"))


def json_string(x):
    """A JSON string with everything outside ASCII as ``\\uXXXX``."""
    plain = F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    units = F.transform(F.split(plain, ""), lambda c: F.when(c.rlike("[^\\x00-\\x7f]"), F.concat(F.lit("\\u"), F.lower(F.array_join(F.transform(F.split(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(....)(?=.)", "$1 "), " "), lambda h: h), "\\u")))).otherwise(c))
    return F.array_join(units, "")


def format_text(documents: DataFrame, pages: DataFrame) -> DataFrame:
    rule = "-" * 51
    part = F.concat(F.lit("PAGE_NO : "), F.col("page_number").cast("string"), F.lit("\n\nCONTENT:\n"), F.coalesce("content", F.lit("")), F.lit("\n" + rule))
    body = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", part.alias("part")))).alias("rows"))
    tags = F.concat(F.lit("["), F.array_join(F.transform("tags", json_string), ", "), F.lit("]"))
    head = F.concat(F.lit("FILE_NAME : "), F.col("document_id"), F.lit("\nMETADATA : "), tags, F.lit("\n\n" + rule))
    joined = documents.join(body, "document_id", "left")
    return joined.select("document_id", F.concat_ws("\n", head, F.when(F.size("rows") > 0, F.array_join("rows.part", "\n"))).alias("text"))


def format_json(documents: DataFrame, pages: DataFrame) -> DataFrame:
    body = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_number").alias("page_no"), F.coalesce("content", F.lit("")).alias("content")))).alias("rows"))
    joined = documents.join(body, "document_id", "left")
    none = F.array().cast("array<struct<page_no:int,content:string>>")
    out = F.struct(F.col("document_id").alias("FileName"), F.col("tags").alias("Metadata"), F.coalesce(F.col("rows").cast("array<struct<page_no:int,content:string>>"), none).alias("FileContent"))
    return joined.select("document_id", F.to_json(out).alias("text"))


def usage_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("document_name").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens")
    )


def number_calls(calls: DataFrame) -> DataFrame:
    order = Window.partitionBy("document_name").orderBy("ts", "call_id")
    return calls.withColumn("call_number", F.row_number().over(order).cast("long"))
