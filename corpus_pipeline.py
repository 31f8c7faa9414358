"""The corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; all but the last return the
columns of ``documents``. A runner may write each stage's result and read it again; :func:`run` does so itself.

Null and empty texts fail the quality rules' base, so only words reach the later stages; null labels and labels of unknown
documents count for nothing; a null language is a stratum of its own; documents of any length are taken whole. Rows that repeat
an id and a text are one document, which near duplicates keep or drop as a whole; another text under the same id is another
document; ties go to the smaller id, null ids last. Without rows every stage returns none. Further columns, whatever their names,
stay as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelake.llm import ngram_join, packing, quality_model, quality_rules, suffix_dedup
from pricelake.llm.common import materialise, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules reject go."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant scores below 0.7 go."""
    return quality_model.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (word 5-grams, Jaccard 0.8) the document with the least id stays (see
    :func:`pricelake.llm.ngram_join.one_of_each`)."""
    return ngram_join.one_of_each(docs, n=5, num=4, den=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller id holds are cut out."""
    return suffix_dedup.without_copies(docs, min_words=50)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece."""
    import public_tokenizers

    return packing.pack(packing.tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096), 4096)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", passages), ("best-fit packing", packed)]

#: Binomial bounds, a fitted discriminant and a tokenizer are beyond SQL; tests compare near duplicates, passages, packing
#: and the choice of rules with brute force, and check on odd rows what the stages keep together.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{k}")
    return docs
