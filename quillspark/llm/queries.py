"""Registered queries ``opN_<name>`` of the training-data operators, and SQL that
gives the same rows where SQL can."""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import codec, embedding_dedup, exact_dedup, license_scan, ngram_join, packing, sstable, substring_dedup, toxicity, warc
from .common import ROW, Workspace, keyed, named, table


def tokenizer_file(name: str) -> str:
    """A public tokenizer file; ``QUILLSPARK_TOKENIZERS`` names another folder."""
    folder = os.environ.get("QUILLSPARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"), Workspace(spark, "op1"))


def op2_ngram_jaccard(spark, sf_dir):
    return ngram_join.similar(table(spark, sf_dir, "documents", "doc_id", "text"), Workspace(spark, "op2"))


def op3_token_shards(spark, sf_dir):
    path = Workspace(spark, "op3").path("shards")
    sstable.write(table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return sstable.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, Workspace(spark, "op4"), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op5_bpe_roundtrip(spark, sf_dir):
    path = tokenizer_file("byte_bpe_50k.json")
    rows = codec.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    rows = rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return codec.decode(rows, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(Workspace(spark, "op6"), docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_embedding_dedup(spark, sf_dir):
    ws = Workspace(spark, "op7")
    vectors = keyed(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), ws, "vec_id")
    return named(embedding_dedup.near_duplicates(vectors, ws, id_col=ROW), vectors, ws, ROW, "component_id", id_col="vec_id")


def op8_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_warc(spark, sf_dir):
    ws = Workspace(spark, "op9")
    warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), ws.path("archives"), ws)
    captures = warc.assemble(warc.read(spark, ws.path("archives")))
    field = lambda name: F.expr(f"try_cast(nullif(regexp_extract(cast(metadata.payload as string), '(?m)^{name}: (-?[0-9]+)', 1), '') as bigint)")
    broken = F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("main.record_id")))
    return captures.select(
        field("page-id").alias("page_id"),
        F.col("main.payload_bytes").alias("payload_bytes"),
        F.when(F.coalesce("main.intact", F.lit(True)), F.col("main.digest")).otherwise(broken).alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        field("refers-to-page-id").alias("refers_to"),
    )


def op10_substring_dedup(spark, sf_dir):
    ws = Workspace(spark, "op10")
    docs = keyed(table(spark, sf_dir, "documents", "doc_id", "text"), ws)
    found = substring_dedup.repeats(docs, ws, id_col=ROW)
    return named(found, docs, ws, ROW, "kept_id")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_token_shards": op3_token_shards,
    "op4_packing": op4_packing,
    "op5_bpe_roundtrip": op5_bpe_roundtrip,
    "op6_toxicity": op6_toxicity,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_warc": op9_warc,
    "op10_substring_dedup": op10_substring_dedup,
}

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x20\x09-\x0D]+')"
)

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS len,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        k AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
    "op2_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 3),
                    lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS grams
            FROM w),
        n AS (SELECT doc_id, len(grams) AS n FROM s),
        g AS (SELECT doc_id, len(grams) AS n, hash(unnest(grams)) AS gram FROM s),
        links AS (
            SELECT a.doc_id AS u, b.doc_id AS v
            FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
                AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach AS (
            SELECT doc_id AS u, doc_id AS v FROM n
            UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
        SELECT n.doc_id, n.n AS n_shingles, min(reach.v) AS component_id
        FROM n JOIN reach ON reach.u = n.doc_id GROUP BY n.doc_id, n.n""",
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b
            ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (
            SELECT vec_id AS u, vec_id AS v FROM embeddings
            UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
        c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
        n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id""",
    "op8_license_scan": license_scan.scan_sql(),
    "op9_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        d AS (
            SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
                list_transform(range(0, 32), lambda i:
                    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
                        (CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)) AS letters
            FROM p)
        SELECT page_id, payload_bytes, array_to_string(letters, '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d""",
    "op10_substring_dedup": r"""
        WITH u AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS unit
            FROM documents),
        o AS (
            SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM u),
        n AS (
            SELECT *, translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM o),
        k AS (SELECT *, md5(norm) AS digest FROM n WHERE len(string_split(norm, ' ')) >= 20),
        g AS (
            SELECT *, count(*) OVER (PARTITION BY digest) AS n_copies,
                   first_value(doc_id) OVER w AS kept_id, first_value(unit) OVER w AS kept_unit
            FROM k WINDOW w AS (PARTITION BY digest ORDER BY doc_id, unit)),
        p AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS pieces
            FROM documents),
        l AS (SELECT doc_id, list_transform(pieces, lambda y: trim(translate(y, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ')) AS words FROM p),
        w AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS i FROM p),
        x AS (
            SELECT doc_id, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop,
                   length(regexp_replace(piece, '[\x20\x09-\x0D]', '', 'g')) AS len FROM w),
        q AS (
            SELECT doc_id, unnest(range(0, len(words) - 49)) AS i,
                   unnest(list_transform(range(0, len(words) - 49), lambda j: md5(array_to_string(words[j + 1 : j + 50], ' ')))) AS digest
            FROM l WHERE len(words) >= 50),
        f AS (SELECT doc_id, i, first_value(doc_id) OVER v AS d0, first_value(i) OVER v AS i0 FROM q WINDOW v AS (PARTITION BY digest ORDER BY doc_id, i)),
        r AS (SELECT doc_id, i FROM f WHERE doc_id <> d0 OR i - i0 >= 50),
        s AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM r),
        t AS (SELECT *, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
        z AS (SELECT doc_id, run, min(i) AS a, max(i) + 49 AS b FROM t GROUP BY doc_id, run)
        SELECT doc_id, 'line' AS kind, unit, CAST(start AS BIGINT) AS start, CAST(start + length(line) AS BIGINT) AS stop, digest, n_copies, kept_id, kept_unit
        FROM g WHERE n_copies > 1 AND NOT (doc_id = kept_id AND unit = kept_unit)
        UNION ALL
        SELECT z.doc_id, 'passage', z.a, CAST(xa.stop - xa.len AS BIGINT), CAST(xb.stop AS BIGINT), NULL, NULL, NULL, NULL
        FROM z JOIN x xa ON xa.doc_id = z.doc_id AND xa.i = z.a JOIN x xb ON xb.doc_id = z.doc_id AND xb.i = z.b""",
}
