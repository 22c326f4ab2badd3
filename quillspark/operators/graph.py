"""Graph operators: adjacency, bounded search, components, explorer model."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..workspace import Workspace, numbered
from ..workspace import components as star_components

#: Ends of edges that are sent to every task at most (8 bytes each), and the
#: queries of one task of :func:`bfs_by_query`.
SENT_EDGES = 16_000_000
TASK_QUERIES = 256
#: Rows that a task holds to put them in order (4 bytes each and their values), and about
#: how many it hands on at once.
HELD, BLOCK = 1 << 23, 1 << 16
PALETTE_SIZE = 30
#: Nodes that get a label whatever their degree, and the degree that always does.
TOP_LABELS = 30
LABEL_DEGREE = 4
# Fixed values of the force layout: room around a node, charge of a node without
# links and of others, and what each link adds to it.
COLLIDE_GAP, LONE_CHARGE, CHARGE, CHARGE_BY_DEGREE = 4.0, -60.0, -200.0, -3.0


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct neighbours in both directions; ends must be present."""
    rows = edges.where("source is not null and target is not null")
    return rows.select("source", "target").union(rows.select("target", "source")).toDF("a", "b").distinct()


def bfs(seeds: DataFrame, near: DataFrame, max_depth: int) -> DataFrame:
    """``seeds(query_id, concept_id)`` -> ``(query_id, concept_id, distance)``.

    A seed without an edge has no distance.  The frontier is deduplicated and
    visited pairs are taken out at every step, so a hub is entered once per
    query; the depth bounds the number of joins.
    """
    if max_depth < 0:
        return seeds.select("query_id", "concept_id", F.lit(0).cast("long").alias("distance")).limit(0)
    nodes = near.select(F.col("a").alias("concept_id")).distinct()
    found = seeds.select("query_id", "concept_id").distinct().join(nodes, "concept_id", "left_semi")
    found = found.select("query_id", "concept_id", F.lit(0).cast("long").alias("distance"))
    frontier = found
    for depth in range(1, max_depth + 1):
        step = frontier.join(near, F.col("concept_id") == F.col("a")).select("query_id", F.col("b").alias("concept_id")).distinct()
        frontier = step.join(found, ["query_id", "concept_id"], "left_anti").withColumn("distance", F.lit(depth).cast("long"))
        found = found.unionByName(frontier)
    return found


class Held:
    """What some queries find, handed on by what is found and not by query: neighbours of a
    row in a file then repeat its names, which takes a fraction of the room on disk."""

    def __init__(self, most: int):
        self.most, self.queries, self.rows, self.values, self.n = most, [], [], [], 0

    def add(self, query: int, rows: np.ndarray, values: dict[str, np.ndarray]) -> bool:
        """Holds ``rows``, which are sorted; whether it is time to hand all on."""
        if len(rows):
            self.queries.append(query), self.rows.append(rows.astype(np.int32)), self.values.append(values)
            self.n += len(rows)
        return self.n >= self.most

    def blocks(self):
        """``(queries, rows, values)`` of about BLOCK rows in order, and those of equal rows
        by query; nothing is held afterwards."""
        some = 16  # every which row tells where blocks end
        ends = np.unique(np.sort(np.concatenate([x[::some] for x in self.rows]))[:: max(1, BLOCK // some)][1:]) if self.n > BLOCK else np.zeros(0, np.int32)
        cuts = np.array([np.concatenate([[0], np.searchsorted(x, ends), [len(x)]]) for x in self.rows])
        for k in range(len(ends) + bool(self.n)):
            parts = [(i, slice(a, b)) for i, (a, b) in enumerate(cuts[:, k : k + 2].tolist()) if b > a]
            if not parts:
                continue
            rows = np.concatenate([self.rows[i][part] for i, part in parts])
            order = np.argsort(rows, kind="stable")
            query = np.repeat([self.queries[i] for i, _ in parts], [part.stop - part.start for _, part in parts])
            yield query[order], rows[order], {name: np.concatenate([self.values[i][name][part] for i, part in parts])[order] for name in self.values[0]}
        self.__init__(self.most)


def bfs_by_query(seeds: DataFrame, near: DataFrame, max_depth: int, limit: int = SENT_EDGES) -> DataFrame:
    """The rows of :func:`bfs`, where they are many more than seeds and edges: the
    neighbours are numbered and sent to all tasks, and a task searches for one query
    after the other, so what is reached is neither shuffled nor written.  With more
    than ``limit`` edges it is a join per step, as in :func:`bfs`."""
    if max_depth < 0:
        return bfs(seeds, near, max_depth)
    spark = seeds.sparkSession
    ws = Workspace(spark, "bfs")
    near = ws.keep(near.select("a", "b"), "near")
    if near.count() > limit:
        return bfs(seeds, near, max_depth)
    named = ws.keep(numbered(ws, near.select(F.col("a").alias("concept_id")).distinct(), ["concept_id"], "names"), "nodes")
    node = lambda end: named.select(F.col("concept_id").alias(end), F.col("idx").cast("int").alias(f"{end}_idx"))
    ends = near.join(node("a"), "a").join(node("b"), "b").select("a_idx", "b_idx").toArrow()
    a, b = (ends.column(c).to_numpy() for c in ("a_idx", "b_idx"))
    names = named.toArrow()
    names = names.column("concept_id").combine_chunks().take(pa.array(np.argsort(names.column("idx").to_numpy())))
    first = np.append(0, np.cumsum(np.bincount(a, minlength=len(names))))
    sent = spark.sparkContext.broadcast((names, first, b[np.argsort(a, kind="stable")]))
    own = seeds.select("query_id", "concept_id").join(named, "concept_id").groupBy("query_id").agg(F.collect_set(F.col("idx").cast("int")).alias("nodes"))
    own = ws.keep(own, "seeds")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), own.count() // TASK_QUERIES)

    def run(batches):
        names, first, ends = sent.value
        seen = np.zeros(len(names), bool)
        held = Held(HELD)
        for batch in batches:

            def told():
                for query, rows, values in held.blocks():
                    columns = [batch.column(0).take(pa.array(query)), names.take(pa.array(rows)), pa.array(values["distance"], pa.int64())]
                    yield pa.record_batch(columns, ["query_id", "concept_id", "distance"])

            at, nodes = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            for row in range(len(batch)):
                reached, frontier = [], nodes[at[row] : at[row + 1]]
                for depth in range(max_depth + 1):
                    if depth:
                        start, n = first[frontier], first[frontier + 1] - first[frontier]
                        step = ends[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]
                        frontier = np.unique(step[~seen[step]])
                    if not len(frontier):
                        break
                    seen[frontier] = True
                    reached.append(frontier)
                for x in reached:
                    seen[x] = False
                found = np.concatenate([nodes[:0], *reached])
                order = np.argsort(found)
                if held.add(row, found[order], {"distance": np.repeat(np.arange(len(reached), dtype=np.int32), [len(x) for x in reached])[order]}):
                    yield from told()
            yield from told()

    kind = dict(own.dtypes)["query_id"]
    return own.repartition(tasks, "query_id").mapInArrow(run, f"query_id {kind}, concept_id string, distance long")


def leading_to(targets: DataFrame, near: DataFrame, max_depth: int) -> DataFrame:
    """The nodes from which :func:`bfs` reaches any of ``targets(concept_id)``."""
    ends = near.select(F.col("a").alias("concept_id")).distinct()
    found = ends.join(targets, "concept_id", "left_semi")
    for _ in range(max_depth):
        step = near.join(found.select(F.col("concept_id").alias("b")), "b", "left_semi").select(F.col("a").alias("concept_id"))
        found = found.unionByName(step).distinct()
    return found


def nodes(concepts: DataFrame, documents_first: bool = True) -> DataFrame:
    """Merged graph nodes: each concept once, under its first document by id,
    with the keyword ``idx`` order (document, first appearance)."""
    best = F.min(F.struct("document_id", "ord"))
    return concepts.groupBy("concept_id").agg(best.alias("f"), F.min_by("name", F.struct("document_id", "ord")).alias("label")).select(
        F.col("concept_id").alias("id"), F.col("f.document_id").alias("doc"), F.col("f.ord").alias("ord"), "label"
    )


def with_idx(rows: DataFrame) -> DataFrame:
    """0-based node position in (document, order, id) order."""
    return numbered(Workspace(rows.sparkSession, "nodes"), rows, ["doc", "ord", "id"], "nodes")


def links(edges: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Drawable links: both ends are nodes and differ; type defaults to
    ``related``, weight is the number of pages, one at least."""
    ids = node_rows.select("id")
    rows = edges.where("source <> target")
    for end in ("source", "target"):
        rows = rows.join(ids.withColumnRenamed("id", end), end, "left_semi")
    weight = F.greatest(F.lit(1), F.size(F.coalesce("page_numbers", F.array().cast("array<int>")))).cast("long")
    return rows.withColumn("type", F.coalesce(F.expr("nullif(type, '')"), F.lit("related"))).withColumn("weight", weight)


def degrees(link_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Degree of every node; parallel links count each."""
    ends = link_rows.select(F.col("source").alias("id")).unionAll(link_rows.select(F.col("target").alias("id")))
    counted = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return node_rows.join(counted, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def styled(degree_rows: DataFrame) -> DataFrame:
    """Adds ``radius`` and ``palette`` from degree and position."""
    top = degree_rows.agg(F.greatest(F.lit(1), F.coalesce(F.max("degree"), F.lit(0))).alias("top"))
    rows = degree_rows.crossJoin(F.broadcast(top))  # one row
    radius = F.least(F.lit(32.0), F.greatest(F.lit(6.0), 6.0 + F.col("degree") / F.col("top") * 26.0))
    return rows.withColumn("radius", radius).withColumn("palette", F.pmod(F.col("degree") * 7 + F.col("idx") * 3, F.lit(PALETTE_SIZE)).cast("long")).drop("top")


def top_labels(degree_rows: DataFrame, most: int = TOP_LABELS) -> DataFrame:
    """Nodes that are labelled: the top ones by degree (input order on ties) and
    every one of degree four or more."""
    first = degree_rows.orderBy(F.desc("degree"), "idx").limit(most).select("id")
    return first.unionByName(degree_rows.where(F.col("degree") >= LABEL_DEGREE).select("id")).distinct()


def parallel_links(link_rows: DataFrame) -> DataFrame:
    """Position and curvature among the links of one unordered pair."""
    pair = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target"))
    at = (F.row_number().over(pair.orderBy("document_id", "ord", "source", "type")) - 1).cast("long")
    n = F.count("*").over(pair)
    return link_rows.withColumn("pair_index", at).withColumn("curvature", F.when(n > 1, 0.25 * (F.col("pair_index") - (n - 1) / 2.0)).otherwise(0.0))


def components(node_rows: DataFrame, link_rows: DataFrame) -> DataFrame:
    """``(id, component)``: components numbered by their first node's position."""
    ws = Workspace(node_rows.sparkSession, "graph")
    ids = ws.keep(node_rows.select("id", "idx"), "ids")
    ends = link_rows.select("source", "target").distinct()
    ends = ends.join(ids.select(F.col("id").alias("source"), F.col("idx").alias("u")), "source").join(ids.select(F.col("id").alias("target"), F.col("idx").alias("v")), "target")
    found = star_components(ws, ends.select("u", "v"))
    label = ids.join(found, F.col("idx") == F.col("node"), "left").select("id", F.coalesce("component", "idx").alias("label"))
    label = ws.keep(label, "label")
    roots = numbered(ws, label.select("label").distinct(), ["label"], "roots", "component")
    return label.join(roots, "label").select("id", "component")


def clusters(component_rows: DataFrame, degree_rows: DataFrame) -> DataFrame:
    """Size and dominant document of every component, largest first."""
    rows = component_rows.join(degree_rows.select("id", "doc", "idx"), "id")
    by_doc = rows.groupBy("component", "doc").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    return by_doc.groupBy("component").agg(F.sum("n").alias("size"), F.max_by("doc", F.struct("n", (-F.col("first")).alias("f"))).alias("dominant_doc"))


def visible(node_rows: DataFrame, link_rows: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes outside hidden components and the links between them."""
    shown = node_rows.join(hidden, "component", "left_anti")
    out = link_rows
    for end in ("source", "target"):
        out = out.join(shown.select(F.col("id").alias(end)), end, "left_semi")
    return shown, out


def incident(link_rows: DataFrame, node_rows: DataFrame, concept: DataFrame) -> DataFrame:
    """Links at the given concepts with the other end and its label."""
    seen = concept.select(F.col("id").alias("concept"))
    out = link_rows.join(F.broadcast(seen), (F.col("source") == F.col("concept")) | (F.col("target") == F.col("concept")))
    out = out.withColumn("other", F.when(F.col("source") == F.col("concept"), F.col("target")).otherwise(F.col("source")))
    names = node_rows.select(F.col("id").alias("other"), F.col("label").alias("_l"))
    return out.join(names, "other", "left").withColumn("other_label", F.coalesce("_l", "other")).drop("_l")


def neighbourhood(near: DataFrame, concept: DataFrame) -> DataFrame:
    """The given nodes and their direct neighbours."""
    seen = concept.select(F.col("id").alias("a"))
    return near.join(F.broadcast(seen), "a").select(F.col("a").alias("centre"), F.col("b").alias("id")).unionByName(seen.select(F.col("a").alias("centre"), F.col("a").alias("id"))).distinct()


def dimmed(node_rows: DataFrame, selected: str | None, answer: list[str], term: str | None) -> DataFrame:
    """Whether a node is dimmed: selection first, then answer, then search."""
    if selected:
        lit = F.col("id") == selected
    elif answer:
        lit = F.col("id").isin(answer)
    elif term:
        lit = F.contains(F.lower("label"), F.lit(term.lower()))
    else:
        lit = F.lit(True)
    return node_rows.withColumn("dim", ~lit)


def find_first(node_rows: DataFrame, term: str) -> DataFrame:
    hit = node_rows.where(F.contains(F.lower("label"), F.lit(term.lower())))
    return hit.agg(F.min_by("id", "idx").alias("id"))


def search_concepts(concepts: DataFrame, term: str) -> DataFrame:
    """Substring of name, description or a keyword, whatever the case."""
    t = F.lit(term.lower())
    hit = F.contains(F.lower("name"), t) | F.contains(F.lower(F.coalesce("description", F.lit(""))), t) | F.exists("keywords", lambda k: F.contains(F.lower(k), t))
    return concepts.where(hit)


def question_concepts(concepts: DataFrame, question: str) -> DataFrame:
    """Concepts that hold a word of the question (longer than two characters)."""
    hay = F.lower(F.concat_ws(" ", "name", F.array_join("keywords", " "), F.coalesce("description", F.lit(""))))
    words = T.query_words(F.lit(question))
    return concepts.withColumn("_hay", hay).where(F.exists(words, lambda w: F.contains(F.col("_hay"), w))).drop("_hay")


def forces(degree_rows: DataFrame) -> DataFrame:
    """Adds what the force layout takes for a node: the radius that others may not
    enter, and a repelling charge, stronger with every link."""
    rows = styled(degree_rows)
    charge = F.when(F.col("degree") == 0, LONE_CHARGE).otherwise(CHARGE + CHARGE_BY_DEGREE * F.col("degree"))
    return rows.withColumn("collide", F.col("radius") + COLLIDE_GAP).withColumn("charge", charge)


def layout(link_rows: DataFrame) -> DataFrame:
    """Distances and strokes that the explorer's force layout takes."""
    return link_rows.withColumn("distance", 35.0 + 25.0 / F.col("weight")).withColumn("width", T.link_width("weight")).withColumn("alpha", T.link_alpha("weight"))
