"""Extraction: providers inside partitions, and relational parsing of answers."""
from __future__ import annotations

import json
import re
import time
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship

RAW_SCHEMA = "document_id string, batch_id long, raw string, input_tokens long, output_tokens long"


class ProviderError(RuntimeError):
    """A call that failed for good; ``retryable`` ones are tried again."""

    retryable = True


class AuthenticationError(ProviderError):
    retryable = False


class Provider(Protocol):
    """An external model: text in, an answer and its token counts out."""

    def complete(self, prompt: str, images: list[str] | None = None) -> tuple[str, int, int]: ...


class WordProvider:
    """The deterministic stand-in: one concept per page, named by its first words.
    Answers in the JSON that a model would give."""

    supports_images = False

    def complete(self, prompt: str, images: list[str] | None = None) -> tuple[str, int, int]:
        concepts, links, last = [], [], None
        for number, body in re.findall(r"(?ms)^### Page (\d+)\n(.*?)(?=\n\n### Page |\Z)", prompt):
            words = body.split()
            if not words:
                continue
            name = " ".join(words[:3])
            keys = sorted({w for w in re.findall(r"[a-z0-9]+", body.lower()) if len(w) > 2})
            concepts.append({"name": name, "description": body, "page_numbers": [int(number)], "aliases": [" ".join(words[:2])], "keywords": keys})
            if last is not None:
                links.append({"source": last, "target": name, "type": "relates_to", "page_numbers": [int(number)]})
            last = name
        answer = json.dumps({"concepts": concepts, "relationships": links, "keywords": [], "aliases": [], "glossary": {}, "procedures": {}, "apis": {}})
        return answer, len(prompt) // 4, len(answer) // 4


def call_provider(provider: Provider, prompt: str, images: list[str] | None, max_retries: int = 3, wait: float = 1.0) -> tuple[str, int, int]:
    """One call with doubling waits; what must not be retried is raised at once."""
    for attempt in range(max_retries + 1):
        try:
            return provider.complete(prompt, images)
        except ProviderError as e:
            if not e.retryable or attempt == max_retries:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


def check_vision(batches: DataFrame, provider: Provider) -> None:
    """Images need a provider that reads them; asked before any call is made."""
    if not getattr(provider, "supports_images", False) and not batches.where("content_type = 'image'").isEmpty():
        raise ValueError("the provider cannot read image pages")


def run_provider(batches: DataFrame, provider: Provider, workers: int | None = None, max_retries: int = 3) -> DataFrame:
    """A raw answer per batch.  ``workers`` caps the calls made at once; a batch
    that fails for good fails the job, none is dropped."""
    ship(batches.sparkSession)

    def run(parts):
        for rows in parts:
            out = []
            for doc, batch, text, images in zip(rows["document_id"], rows["batch_id"], rows["text"], rows["images"]):
                prompt = text if isinstance(text, str) else ""
                answer, i, o = call_provider(provider, prompt, list(images) if images is not None else None, max_retries)
                out.append((doc, batch, answer, i, o))
            yield pd.DataFrame(out, columns=["document_id", "batch_id", "raw", "input_tokens", "output_tokens"])

    rows = batches.select("document_id", "batch_id", "text", "images")
    return (rows.repartition(workers) if workers else rows).mapInPandas(run, RAW_SCHEMA)


def parse_answers(raw: DataFrame) -> DataFrame:
    """Adds ``v``, the answer as VARIANT; an answer without a JSON object raises.
    ``raw`` should be a written table: every table of a build parses it again,
    and the calls must not be made again."""
    raw = raw.withColumn("j", T.extract_json("raw"))
    v = F.col("j")
    fail = F.raise_error(F.concat(F.lit("no JSON object in the answer of batch "), F.col("batch_id").cast("string")))
    return raw.withColumn("v", F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), v).otherwise(fail.cast("variant"))).drop("j")


def as_list(v, path: str):
    """A VARIANT field as an array: a scalar becomes a list of one, null none."""
    return F.coalesce(
        F.try_variant_get(v, path, "array<variant>"),
        F.when(F.try_variant_get(v, path, "variant").isNotNull(), F.array(F.try_variant_get(v, path, "variant"))),
        F.array().cast("array<variant>"),
    )


def as_int(v):
    """Integers as Python's ``int()`` reads them: numbers cut, digits in strings."""
    kind = F.schema_of_variant(v)
    text = F.trim(F.try_variant_get(v, "$", "string"))
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int"))
        .when(kind == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int")))
        .when(kind.isNotNull() & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(v, "$", "double").cast("int"))
    )


def page_list(v, allowed):
    numbers = F.filter(F.transform(v, as_int), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.array_intersect(numbers, allowed)))


def text_list(v):
    return F.filter(F.transform(v, lambda x: T.strip(F.try_variant_get(x, "$", "string"))), lambda s: s.isNotNull() & (s != ""))


def concepts(answers: DataFrame) -> DataFrame:
    """Concept rows of ``answers(document_id, batch_id, allowed, v)``: objects
    with a name, pages that the batch has."""
    rows = answers.select("document_id", "batch_id", "allowed", F.posexplode(as_list(F.col("v"), "$.concepts")).alias("pos", "c"))
    rows = rows.where(F.schema_of_variant("c").startswith("OBJECT")).withColumn("name", T.strip(F.try_variant_get("c", "$.name", "string"))).where("name <> ''")
    return rows.select(
        "document_id", "batch_id", T.slugify("name").alias("concept_id"), "name",
        T.strip(F.coalesce(F.try_variant_get("c", "$.description", "string"), F.lit(""))).alias("description"),
        page_list(as_list(F.col("c"), "$.page_numbers"), F.col("allowed")).alias("page_numbers"),
        text_list(as_list(F.col("c"), "$.aliases")).alias("aliases"),
        text_list(as_list(F.col("c"), "$.keywords")).alias("keywords"),
        (F.col("batch_id") * 1_000_000 + F.col("pos")).alias("ord"),
    )


def endpoint_names(concept_rows: DataFrame) -> DataFrame:
    """Slug of every name and alias of a batch -> concept; an alias beats a name."""
    names = concept_rows.select("document_id", "batch_id", T.slugify("name").alias("slug"), "concept_id", F.lit(0).alias("p"), "ord")
    other = concept_rows.select("document_id", "batch_id", F.explode("aliases").alias("a"), "concept_id", "ord").select("document_id", "batch_id", T.slugify("a").alias("slug"), "concept_id", F.lit(1).alias("p"), "ord")
    return names.unionByName(other).groupBy("document_id", "batch_id", "slug").agg(F.max_by("concept_id", F.struct("p", "ord")).alias("concept_id"))


def relationships(answers: DataFrame, concept_rows: DataFrame) -> DataFrame:
    rows = answers.select("document_id", "batch_id", "allowed", F.posexplode(as_list(F.col("v"), "$.relationships")).alias("pos", "r"))
    rows = rows.where(F.schema_of_variant("r").startswith("OBJECT"))
    get = lambda f: T.strip(F.try_variant_get("r", f, "string"))
    rows = rows.withColumn("s", T.slugify(get("$.source"))).withColumn("t", T.slugify(get("$.target"))).where("s is not null and t is not null")
    names = endpoint_names(concept_rows)
    keys = ["document_id", "batch_id"]
    rows = rows.join(names.select(*keys, F.col("slug").alias("s"), F.col("concept_id").alias("sid")), [*keys, "s"], "left").join(names.select(*keys, F.col("slug").alias("t"), F.col("concept_id").alias("tid")), [*keys, "t"], "left")
    kind = F.lower(F.coalesce(F.expr("nullif(trim(try_variant_get(r, '$.type', 'string')), '')"), F.lit("relates_to")))
    return rows.select("document_id", F.coalesce("sid", "s").alias("source"), F.coalesce("tid", "t").alias("target"), kind.alias("type"), page_list(as_list(F.col("r"), "$.page_numbers"), F.col("allowed")).alias("page_numbers"), (F.col("batch_id") * 1_000_000 + F.col("pos")).alias("ord"))


def aliases(answers: DataFrame) -> DataFrame:
    """Objects ``{alias, concept}`` and lists of two."""
    rows = answers.select("document_id", "batch_id", F.posexplode(as_list(F.col("v"), "$.aliases")).alias("pos", "a"))
    listed = F.schema_of_variant("a").startswith("ARRAY")
    pick = lambda i, f: T.strip(F.when(listed, F.try_variant_get("a", f"$[{i}]", "string")).otherwise(F.try_variant_get("a", f, "string")))
    out = rows.select("document_id", pick(0, "$.alias").alias("alias"), pick(1, "$.concept").alias("concept"), (F.col("batch_id") * 1_000_000 + F.col("pos")).alias("ord"))
    return out.where("alias <> '' and concept <> ''").select("document_id", "alias", T.slugify("concept").alias("concept_id"), "ord")


def entries(answers: DataFrame, kind: str) -> DataFrame:
    """Rows of an open object (``glossary``, ``procedures``, ``apis``): key, body
    as JSON, and the pages that the batch has."""
    rows = answers.select("document_id", "batch_id", "allowed", F.explode(F.coalesce(F.try_variant_get("v", f"$.{kind}", "map<string,variant>"), F.create_map().cast("map<string,variant>"))).alias("key", "body"))
    pages = F.concat(as_list(F.col("body"), "$.page_numbers"), as_list(F.col("body"), "$.pages"))
    return rows.select("document_id", "key", F.to_json("body").alias("body"), page_list(pages, F.col("allowed")).alias("page_numbers"), (F.col("batch_id") * 1_000_000).alias("ord"))
