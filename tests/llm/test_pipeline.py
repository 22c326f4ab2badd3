"""The pipeline stage by stage on the smallest tables."""
import os
import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from quillspark.llm import queries, substring_dedup  # noqa: E402

from .test_operators import shingles  # noqa: E402

SF = os.environ.get("QUILLSPARK_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            continue
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "substring_dedup":
            assert all(before[i] == t for i, t in after.items())
        if name == "exact_dedup":
            norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in after.values()]
            assert len(set(norm)) == len(norm) and set(norm) == {re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in before.values()}
        if name == "ngram_jaccard":
            sets = [shingles(t) for t in after.values()]
            assert not any(sets[i] and 100 * len(sets[i] & s) >= 75 * len(sets[i] | s) for i in range(len(sets)) for s in sets[:i])
        if name == "substring_dedup":
            units = [n for t in after.values() for line in (t or "").split("\n") if (n := substring_dedup.normalise(line)) and n.count(" ") + 1 >= substring_dedup.MIN_WORDS]
            assert len(units) == len(set(units))
        before = after


def test_hostile_documents(spark):
    """Repeated and null ids, empty and null texts, equal rows, further columns whose
    names clash with the operators' own."""
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, "a"), (1, long, "b"), (None, long + " end", "c"), (None, None, "d"), (2, "", "e"), (3, "x y", "f"), (3, "other text", "g"), (None, "x  y", "h")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, _text string, _cuts int, kept string, component_id int, id string, _score int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), n, 1, n, 2, n, 3) for i, t, n in rows], kind)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name == "packing":
            assert docs.count() == len(left)
            break
        left = {r["_text"]: r["text"] for r in docs.collect()}
        assert docs.columns == [c.split()[0] for c in kind.split(", ")]
        if name == "exact_dedup":
            assert set(left) == {"a", "c", "e", "g", "h"}  # the longest, then the first id, null ids last
        if name == "ngram_jaccard":
            assert set(left) == {"a", "e", "g", "h"}
    empty = spark.createDataFrame([], kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0
        empty = out if name != "packing" else empty


def test_queries_cover_all_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
