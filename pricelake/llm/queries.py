"""The training-data queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hmm, html_tree, mtree, ngram_join, packing, quality_model, quality_rules, sharding, suffix_dedup
from .common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=5, num=4, den=5).drop("class_id")


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16, points=128)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix_dedup.repeats(table(spark, sf_dir, "documents"), min_words=50)
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("copy").alias("is_copy"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.pack(pieces, 4096)


def op5_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), states=6, passes=4)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encode, decode = bpe.encode_batches(ranks, pattern), bpe.decode_batches(ranks, pattern)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of: dict[int, str] = {}
        for batch in decode(encode(batches)):
            ids = list(bpe.id_lists(batch.column(1)))
            for i in set().union(*ids) - text_of.keys():
                text_of[i] = str(i)
            joined = [hashlib.sha256(",".join(map(text_of.__getitem__, x)).encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(x).hexdigest() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(joined, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_ring_shards, op3_repeated_passages, op4_best_fit_packing, op5_mtree_top_k, op6_quality_classifier, op7_hmm_scores, op8_byte_bpe, op9_quality_rules, op10_site_style_tree)}

_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": f"""
        WITH RECURSIVE words AS MATERIALIZED (
            SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
        ), sets AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
        ), shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets
        ), links AS MATERIALIZED (
            SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reached(doc_id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT y, c FROM reached JOIN edges ON x = reached.doc_id)
        SELECT sets.doc_id, len(s) AS n_shingles, min(c) AS component_id FROM sets JOIN reached ON reached.doc_id = sets.doc_id GROUP BY sets.doc_id, s
    """,
    "op3_repeated_passages": f"""
        WITH words AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
        ), windows AS MATERIALIZED (
            SELECT doc_id, pos, md5(array_to_string(w[pos + 1:pos + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM words WHERE len(w) >= 50)
        ), found AS MATERIALIZED (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) <> max(doc_id)
        ), kept AS (
            SELECT doc_id, pos, FALSE AS is_copy FROM windows JOIN found USING (h) UNION ALL SELECT doc_id, pos, TRUE FROM windows JOIN found USING (h) WHERE first <> doc_id
        ), islands AS (
            SELECT *, sum(new) OVER (PARTITION BY doc_id, is_copy ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k
            FROM (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, is_copy ORDER BY pos) + 50 THEN 0 ELSE 1 END AS new FROM kept)
        )
        SELECT doc_id, min(pos) AS start_word, max(pos) + 50 AS end_word, max(pos) + 50 - min(pos) AS n_words, is_copy FROM islands GROUP BY doc_id, is_copy, k
    """,
    "op5_mtree_top_k": """
        WITH points AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score
            FROM points q JOIN points p ON p.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
}
