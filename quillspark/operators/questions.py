"""Candidates and their rankings, question by question.

What all questions ask for, numbered, takes little room beside what they find: the rows
that can be a candidate, in the order of concept and document, the rows of every asked
term, and the neighbours of the questions' own concepts are sent to the tasks.  A task
then finds and ranks all candidates of one question after the other, so candidates, which
grow with the square of the tables, are neither shuffled nor written nor sorted as text.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..workspace import Workspace, numbered
from . import graph, postings
from .retrieval import K1, RRF_K, B, ranking_terms

#: Numbers that are sent to every task at most (rows, their terms, edges; 4 to 8 bytes each).
SENT_NUMBERS = 32_000_000
#: Questions of a task, rows that a task holds before they are handed on, and documents
#: whose terms it holds.
TASK_QUERIES, HELD, TASK_DOCUMENTS = 256, graph.HELD, 2048


def _lists(key: np.ndarray, values: np.ndarray, n: int) -> postings.Lookup:
    """For every number below ``n``, the values that stand with it."""
    return postings.Lookup(None, np.append(0, np.cumsum(np.bincount(key, minlength=n))), values[np.argsort(key, kind="stable")].astype(np.int32))


def by_page(raw: DataFrame) -> DataFrame:
    """``(document_id, pages)`` of ``raw`` concepts, a page with its terms as BM25 counts
    them and those that are no keyword as they stand (``odd``).  Concepts are merged in the
    tasks (:func:`_hits`); keywords of plain letters need no normalising one by one."""
    plain = F.array_join("keywords", "").rlike("^[a-z0-9]*$")
    none = F.array().cast("array<string>")
    each = lambda f: F.transform("keywords", f)
    odd = F.when(plain, none).otherwise(F.array_except(each(T.normalize_term), each(F.lower)))
    term = T.normalize_term("name")
    page = F.struct(
        F.col("ord").cast("long").alias("ord"), "concept_id", F.lower(F.trim(F.col("aliases")[0])).alias("alias"), term.alias("term"),
        F.when(plain, F.col("keywords")).otherwise(each(T.normalize_term)).alias("terms"),
        F.concat(odd, F.when(term == F.lower("name"), none).otherwise(F.array(term))).alias("odd"),
        F.length("description").alias("chars"), F.col("page_numbers").cast("array<long>").alias("page_numbers"),
    )
    return raw.select("document_id", page.alias("page")).groupBy("document_id").agg(F.collect_list("page").alias("pages"))


def _hits(terms: pa.Array, docs: DataFrame) -> DataFrame:
    """The merged concepts of :func:`by_page` with the numbers of their asked terms and
    aliases, whether an asked one is ``odd``, and their document's figures."""
    sent = docs.sparkSession.sparkContext.broadcast(postings.Lookup(terms, None, None))
    flat = postings.Rows.flat

    def run(batches):
        words = sent.value
        for batch in (whole.slice(s, TASK_DOCUMENTS) for whole in batches for s in range(0, len(whole), TASK_DOCUMENTS)):
            pages, doc, _ = flat(batch.column(1))
            coded, order = pages.field("concept_id").dictionary_encode(), pages.field("ord").to_numpy()
            # a row is a document's concept
            key, row = np.unique(doc * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)
            of, concept = key // len(coded.dictionary), coded.dictionary.take(pa.array(key % len(coded.dictionary)))
            by = np.lexsort((order, row))
            heads = np.flatnonzero(np.diff(row[by], prepend=-1))
            first = by[heads]  # its first page gives the name
            chars = pc.fill_null(pages.field("chars"), -1).to_numpy()[by]
            chars = np.maximum.reduceat(chars, heads) if len(by) else chars  # of the longest description
            number, page, _ = flat(pages.field("page_numbers"))
            number, page = number.drop_null().to_numpy(), page[number.is_valid().to_numpy(zero_copy_only=False)]
            by = np.lexsort((number, row[page]))
            number, cited = number[by], row[page][by]
            new = np.flatnonzero((np.diff(cited, prepend=-1) != 0) | (np.diff(number, prepend=0) != 0))
            found, page, _ = flat(pages.field("terms"))
            found = pa.concat_arrays([found, pages.field("term").take(pa.array(first))]).dictionary_encode()
            pair = np.unique(np.append(row[page], np.arange(len(key))) * len(found.dictionary) + found.indices.to_numpy())
            size = np.bincount(pair // len(found.dictionary), minlength=len(key))
            t = words.find(found.dictionary)[pair % len(found.dictionary)]
            hit = t >= 0
            odd, page, _ = flat(pages.field("odd"))
            odd = np.bincount(row[page[words.find(odd) >= 0]], minlength=len(key)) > 0
            # the last page with an alias gives its concept
            names = pages.field("alias").dictionary_encode()
            own = np.append(words.find(names.dictionary), -1)[pc.fill_null(names.indices, -1).to_numpy()]
            asked = np.flatnonzero(own >= 0)
            place = doc[asked] * len(words.keys) + own[asked]
            by = np.lexsort((order[asked], place))
            last = asked[by[np.flatnonzero(np.diff(place[by], append=-1))]]

            def lists(row, values, kind=pa.int32()):
                first = np.append(0, np.cumsum(np.bincount(row, minlength=len(key))))
                return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values[np.argsort(row, kind="stable")], kind))

            concepts, sizes = np.bincount(of[size > 0], minlength=len(batch)), np.bincount(of, weights=size, minlength=len(batch)).astype(np.int64)
            columns = [batch.column(0).take(pa.array(of)), concept, pa.array(size, pa.int32()), pa.array(concepts[of]), pa.array(sizes[of])]
            columns += [lists((pair // len(found.dictionary))[hit], t[hit]), lists(row[last], own[last]), pa.array(odd)]
            columns += [lists(cited[new], number[new], pa.int64()), pa.array(chars, pa.int32(), mask=chars < 0)]
            yield pa.record_batch(columns, ["document_id", "concept_id", "len", "n", "total", "terms", "aliases", "odd", "page_numbers", "chars"])

    return docs.mapInArrow(run, "document_id string, concept_id string, len int, n long, total long, terms array<int>, aliases array<int>, odd boolean, page_numbers array<long>, chars int")


@dataclass
class Figures:
    """What is sent to the tasks.  Rows are numbered by concept, then document."""

    concepts: pa.Array
    documents: pa.Array
    concept: np.ndarray  # of a row
    doc: np.ndarray
    len: np.ndarray
    first: np.ndarray  # row of a concept
    n: np.ndarray  # concepts of a document
    total: np.ndarray  # terms of all of them
    terms: postings.Lookup  # term -> rows with it as keyword
    aliases: postings.Lookup  # term -> rows with it as alias
    named: postings.Lookup  # term -> concepts that it is registered for or spells
    slug: np.ndarray  # the concept that a term spells, -1 for none
    seeds: postings.Lookup  # term -> concepts to start from
    near: postings.Lookup
    depth: int


def parts(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    """The lists of a column."""
    at, all_of_it = batch.column(i).offsets.to_numpy(), batch.column(i).values.to_numpy()
    return [all_of_it[a:b] for a, b in zip(at, at[1:])]


class Found:
    """The candidates of one question after the other."""

    def __init__(self, figures: Figures):
        self.f = figures
        self.mark, self.there = np.zeros(len(figures.doc), bool), np.zeros(len(figures.documents), bool)
        self.far = np.full(len(figures.concepts), -1, np.int8)

    def of(self, terms: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Rows of the candidates, sorted; ``own`` are the terms that name concepts."""
        f = self.f
        self.terms = terms
        self.reached = self._search(f.seeds.expand(own)[1])
        self.place, self.hits = f.terms.expand(terms)
        self.alias_place, self.alias_hits = f.aliases.expand(terms)
        concepts = np.unique(np.concatenate([f.named.expand(terms)[1], *self.reached]))
        for rows in (self.hits, self.alias_hits, self.rows_of(concepts)[1]):
            self.mark[rows] = True
        self.rows = np.flatnonzero(self.mark)
        self.mark[self.rows] = False
        return self.rows

    def rows_of(self, concepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the rows of all concepts: the concept's place, and the row."""
        start, n = self.f.first[concepts], self.f.first[concepts + 1] - self.f.first[concepts]
        return np.repeat(np.arange(len(concepts)), n), np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())

    def _search(self, seeds: np.ndarray) -> list[np.ndarray]:
        """Concepts by their distance, as :func:`graph.bfs` finds them."""
        near, out = self.f.near, []
        frontier = np.unique(seeds[near.degree(seeds) > 0])
        for depth in range(self.f.depth + 1):
            if depth:
                step = near.expand(frontier)[1]
                frontier = np.unique(step[self.far[step] < 0])
            self.far[frontier] = depth
            out.append(frontier)
        for x in out:
            self.far[x] = -1
        return out

    def _place(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, rows)

    def documents(self) -> np.ndarray:
        """Those of the candidates."""
        self.there[self.f.doc[self.rows]] = True
        docs = np.flatnonzero(self.there)
        self.there[docs] = False
        return docs

    def bm25(self) -> np.ndarray:
        """Scores of :func:`retrieval.bm25`, 0 for candidates without one.  All rows with a
        term are candidates, so its document frequency is the same for all questions."""
        f, docs = self.f, self.documents()
        n = f.n[docs].sum()
        df = f.terms.degree(self.terms)[self.place]
        size = f.len[self.hits] / (f.total[docs].sum() / max(n, 1)) if len(self.hits) else 0.0
        gain = np.log(1.0 + (n - df + 0.5) / (df + 0.5)) * (K1 + 1) / (1.0 + K1 * (1 - B + B * size))
        return np.round(np.bincount(self._place(self.hits), weights=gain, minlength=len(self.rows)), 9)

    def matches(self) -> np.ndarray:
        """Counts of :func:`retrieval.alias_matches`, 0 for candidates without one."""
        slug = self.f.slug[self.terms]
        spells = np.flatnonzero(slug >= 0)
        place, rows = self.rows_of(slug[spells])
        row = self._place(np.append(rows, self.alias_hits))
        pair = np.unique(row * len(self.terms) + np.append(spells[place], self.alias_place))
        return np.bincount(pair // max(1, len(self.terms)), minlength=len(self.rows))

    def scores(self) -> np.ndarray:
        """Scores of :func:`retrieval.fuse`."""
        score = np.zeros(len(self.rows))
        for values in (self.bm25(), self.matches()):
            best = np.flatnonzero(values > 0)
            best = best[np.argsort(-values[best], kind="stable")]
            score[best] += 1.0 / (RRF_K + np.arange(1, len(best) + 1))
        near = np.concatenate([self._place(self.rows_of(concepts)[1]) for concepts in self.reached])
        score[near] += 1.0 / (RRF_K + np.arange(1, len(near) + 1))
        return np.round(score, 9)


class Index:
    """The questions of ``terms``, to be answered over all documents."""

    def __init__(self, asked: DataFrame, figures: Figures, rows: DataFrame):
        self.asked, self.rows = asked, rows
        self.sent = asked.sparkSession.sparkContext.broadcast(figures)

    def _each(self, tell: Callable[[Found], tuple[np.ndarray, dict]], kind: str = "", more: tuple[str, ...] = (), texts: Broadcast | None = None) -> DataFrame:
        """What ``tell`` says of a question: rows, sorted, and a value of each by column; and
        the columns ``more`` of ``texts``, which has a value for every row."""
        sent = self.sent

        def run(batches):
            f = sent.value
            found, held = Found(f), graph.Held(HELD)
            for batch in batches:

                def told():
                    for query, at, values in held.blocks():
                        columns = {"query_id": batch.column(0).take(pa.array(query))}
                        columns |= {"concept_id": f.concepts.take(pa.array(f.concept[at])), "document_id": f.documents.take(pa.array(f.doc[at]))}
                        columns |= {name: pa.array(v.astype(np.int64) if v.dtype == np.int32 else v) for name, v in values.items()}
                        columns |= {name: texts.value[name].take(pa.array(at)) for name in more}
                        yield pa.record_batch(columns)

                for i, (terms, own) in enumerate(zip(parts(batch, 1), parts(batch, 2))):
                    found.of(terms, own)
                    if held.add(i, *tell(found)):
                        yield from told()
                yield from told()

        ids = dict(self.asked.dtypes)["query_id"]
        return self.asked.mapInArrow(run, ", ".join([f"query_id {ids}, concept_id string, document_id string", *([kind] if kind else [])]))

    def found(self) -> DataFrame:
        """:func:`retrieval.candidates`."""
        return self._each(lambda found: (found.rows, {}))

    def hydrated(self, **columns: Column) -> DataFrame | None:
        """:func:`found` with ``columns`` made of a concept's ``page_numbers`` (sorted) and
        ``chars`` (of its description).  None where they are too many to be sent."""
        spark = self.asked.sparkSession
        rows = self.rows.select("c", "d", *[x.alias(name) for name, x in columns.items()])
        if len(self.sent.value.doc) * len(columns) > SENT_NUMBERS:
            return None
        told = rows.toArrow().combine_chunks().sort_by([("c", "ascending"), ("d", "ascending")])
        texts = spark.sparkContext.broadcast({name: told.column(name).combine_chunks() for name in columns})
        kind = ", ".join(f"{name} {dict(rows.dtypes)[name]}" for name in columns)
        return self._each(lambda found: (found.rows, {}), kind, tuple(columns), texts)

    def bm25(self) -> DataFrame:
        """:func:`retrieval.bm25`."""

        def tell(found):
            score = found.bm25()
            good = np.flatnonzero(score > 0)
            return found.rows[good], {"score": score[good]}

        return self._each(tell, "score double")

    def distances(self) -> DataFrame:
        """:func:`retrieval.graph_list`."""

        def tell(found):
            rows = [found.rows_of(concepts)[1] for concepts in found.reached]
            far = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in rows])
            rows = np.concatenate(rows)
            order = np.argsort(rows)
            return rows[order], {"distance": far[order]}

        return self._each(tell, "distance long")

    def stats(self) -> DataFrame:
        """:func:`retrieval.bm25_stats`."""
        sent = self.sent

        def run(batches):
            f = sent.value
            found = Found(f)
            for batch in batches:
                sums = np.zeros((len(batch), 2), np.int64)
                for i, (terms, own) in enumerate(zip(parts(batch, 1), parts(batch, 2))):
                    found.of(terms, own)
                    docs = found.documents()
                    sums[i] = f.n[docs].sum(), f.total[docs].sum()
                good = np.flatnonzero(sums[:, 0])
                n, total = sums[good].T
                yield pa.record_batch([batch.column(0).take(pa.array(good)), pa.array(n), pa.array(total / n)], ["query_id", "n", "avg"])

        return self.asked.mapInArrow(run, f"query_id {dict(self.asked.dtypes)['query_id']}, n long, avg double")

    def listed(self) -> DataFrame:
        """:func:`retrieval.candidates` with their :func:`retrieval.candidate_order`."""
        return self._each(lambda found: (found.rows, {"position": np.arange(1, len(found.rows) + 1, dtype=np.int32)}), "position long")

    def ranked(self, most: int | None = None) -> DataFrame:
        """:func:`retrieval.rank` of all candidates, or the first ``most`` of a question."""

        def tell(found):
            score = found.scores()
            order = np.argsort(-score, kind="stable")[:most]
            rank = np.zeros(len(score), np.int32)
            rank[order] = np.arange(1, len(order) + 1)
            kept = np.flatnonzero(rank)
            return found.rows[kept], {"score": score[kept], "rank": rank[kept]}

        return self._each(tell, "score double, rank long")


def index(terms: DataFrame, docs: DataFrame, register: Callable[[DataFrame], DataFrame], near: DataFrame, depth: int) -> Index | None:
    """The :class:`Index` of questions over ``docs`` of :func:`by_page`, all of which are in
    scope.  ``register(document_id, alias, concept_id)`` gives the registered
    concept of an alias, ``near`` is :func:`graph.adjacency`.  None where it is too large to
    be sent, or a question asks for ``odd`` terms; then the candidates are to be listed."""
    if depth < 1:
        raise ValueError("depth must be 1 at least")
    spark = terms.sparkSession
    ws = Workspace(spark, "questions")
    wanted = ranking_terms(terms)
    if wanted.count() > postings.SENT_TERMS:
        return None
    wanted, own = wanted.toArrow(), ranking_terms(terms.where("origin = 'concept'")).toArrow()
    coded = wanted.column("term").combine_chunks().dictionary_encode()
    words = coded.dictionary
    ids = wanted.column("query_id").combine_chunks().dictionary_encode()
    known = postings.Lookup(words, None, None)

    def by_query(query, term):
        found = _lists(query, term, len(ids.dictionary))
        return pa.ListArray.from_arrays(pa.array(found.first, pa.int32()), pa.array(found.to))

    own_terms = known.find(own.column("term").combine_chunks())
    own_query = postings.Lookup(ids.dictionary, None, None).find(own.column("query_id").combine_chunks())
    asked = pa.table({"query_id": ids.dictionary, "terms": by_query(ids.indices.to_numpy(), coded.indices.to_numpy()), "own": by_query(own_query, own_terms)})
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), asked.num_rows // TASK_QUERIES)
    schema = f"query_id {dict(terms.dtypes)['query_id']}, terms array<int>, own array<int>"

    hits = ws.keep(_hits(words, docs), "hits")
    if not hits.where("odd").isEmpty():
        return None
    names = np.zeros(len(words), bool)
    names[own_terms] = True
    spelt = spark.createDataFrame(pa.table({"term": np.arange(len(words), dtype=np.int32), "word": words, "own": names}))
    spelt = ws.keep(spelt.select("term", "word", "own", T.slugify("word", empty="").alias("slug")), "words")
    local = hits.where(F.size("aliases") > 0).select("document_id", F.explode("aliases").alias("alias"), "concept_id")
    slugs = spelt.where("slug <> ''").select("term", F.col("slug").alias("concept_id"))
    named = ws.keep(register(local).select(F.col("alias").alias("term"), "concept_id").unionByName(slugs).distinct(), "named")
    seeds = named.unionByName(local.select(F.col("alias").alias("term"), "concept_id")).distinct()
    seeds = ws.keep(seeds.join(F.broadcast(spelt.where("own").select("term")), "term", "left_semi"), "seeds")
    near = ws.keep(near.select("a", "b"), "near")
    reached = ws.keep(graph.bfs(seeds.select(F.lit(0).alias("query_id"), "concept_id"), near, depth), "reached")
    steps = near.join(reached.where(F.col("distance") < depth).select(F.col("concept_id").alias("a")), "a", "left_semi")
    live = hits.where("size(terms) > 0 or size(aliases) > 0").select("concept_id").unionByName(named.select("concept_id")).unionByName(reached.select("concept_id")).distinct()
    concepts = ws.keep(numbered(ws, live, ["concept_id"], "live").select("concept_id", F.col("idx").cast("int").alias("c")), "concepts")
    rows = hits.join(concepts, "concept_id")
    sizes = rows.agg(F.count("*"), F.sum(F.size("terms") + F.size("aliases"))).first()
    if sizes[0] + (sizes[1] or 0) + steps.count() + concepts.count() > SENT_NUMBERS:
        return None
    documents = ws.keep(numbered(ws, rows.select("document_id", "n", "total").distinct(), ["document_id"], "documents").withColumn("d", F.col("idx").cast("int")), "numbered")

    def collected(df, *columns):
        found = df.select(*columns).toArrow()
        return [found.column(c).combine_chunks() if found.num_rows else pa.array([], found.schema.field(c).type) for c in columns]

    def numbers(df, *columns):
        return [x.to_numpy() for x in collected(df, *columns)]

    def strings(df, key, at):
        found, place = collected(df, key, at)
        return found.take(pa.array(np.argsort(place.to_numpy())))

    rows = rows.join(documents.select("document_id", "d"), "document_id")
    c, d, length, term, alias = collected(rows, "c", "d", "len", "terms", "aliases")
    c, d, length = c.to_numpy(), d.to_numpy(), length.to_numpy()
    order = np.lexsort((d, c))
    at = np.empty(len(order), np.int32)
    at[order] = np.arange(len(order))

    def rows_of(lists):
        n = lists.value_lengths().to_numpy()
        return _lists(lists.flatten().to_numpy(), np.repeat(at, n), len(words))

    place, n, total = numbers(documents, "d", "n", "total")
    by = np.argsort(place)
    names = strings(concepts, "concept_id", "c")
    first = np.append(0, np.cumsum(np.bincount(c, minlength=len(names))))
    numbered_of = lambda df: df.join(concepts, "concept_id")
    slug = np.full(len(words), -1, np.int32)
    which, to = numbers(numbered_of(slugs), "term", "c")
    slug[which] = to
    ends = steps.join(concepts.toDF("a", "a_c"), "a").join(concepts.toDF("b", "b_c"), "b")
    figures = Figures(
        names, strings(documents, "document_id", "d"), c[order], d[order], length[order], first, n[by], total[by], rows_of(term), rows_of(alias),
        _lists(*numbers(numbered_of(named), "term", "c"), len(words)), slug, _lists(*numbers(numbered_of(seeds), "term", "c"), len(words)),
        _lists(*numbers(ends, "a_c", "b_c"), len(names)), depth,
    )
    return Index(ws.keep(spark.createDataFrame(asked, schema).repartition(tasks), "asked").repartition(tasks), figures, rows)
