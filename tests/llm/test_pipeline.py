"""The pipeline's stages on the smallest tables, each against what it should keep."""

import os

import pytest

import corpus_pipeline
from pricelake.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == first.columns
            docs = docs.cache()
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.count() >= counts[-1]
    by_sequence = {}
    for r in docs.collect():
        by_sequence[r["sequence_id"]] = by_sequence.get(r["sequence_id"], 0) + r["length"]
    assert max(by_sequence.values()) <= 4096


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, one id with two texts, clashing columns; and no rows at all."""
    import random

    rnd = random.Random(12)
    prose = lambda n: " ".join("".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(n)) + "."
    first, second, passage = prose(150), prose(160), prose(70)
    rows = [(1, None), (2, ""), (3, "too short"), (4, first), (4, first), (9, first + " end"), (5, second), (5, prose(155)), (None, first), (6, prose(80) + " " + passage), (7, passage + " " + prose(90)), (8, prose(9000))]
    docs = spark.createDataFrame([(i, t, None if i == 8 else "en", "s", len(t or ""), 1, 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __cutoffs0 int, class long, key string")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "quality classifier":  # its labels are of other texts
            kept = stage(spark, kept, SF)
            assert kept.columns == docs.columns
            kept = kept.cache()
    got = {(r["doc_id"], r["n_chars"]): r["text"] for r in kept.collect()}
    assert sorted((i for i, _ in got), key=str) == [4, 5, 5, 6, 7, 8] and kept.where("doc_id = 4").count() == 2
    assert first in got.values() and passage not in next(t for (i, _), t in got.items() if i == 7) and passage in next(t for (i, _), t in got.items() if i == 6)
    packed = corpus_pipeline.packed(spark, kept, SF).collect()
    assert {r["doc_id"] for r in packed} == {4, 5, 6, 7, 8} and sum(r["doc_id"] == 8 for r in packed) > 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SF)
    table = {"op5_mtree_top_k": "embeddings", "op10_site_style_tree": "pages"}.get(name, "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert df.count() >= (n if name not in ("op3_repeated_passages", "op5_mtree_top_k") else 1)
