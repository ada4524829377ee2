"""The dealt queries, with their production parameters, and their checking SQL where SQL can tell."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipscope.llm import (alignment, interpolation, learned_partitions, retrieval_packing,
                          secret_scan, set_join, spelling_variants, spliced_counts,
                          subword_classifier, toxicity, tree_bpe, url_cascade, weak_rules)
from tipscope.llm import checking_sql
from tipscope.llm.common import table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_interpolated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.interpolated_scores(table(spark, sf_dir, "documents"))


def op2_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.quality_votes(table(spark, sf_dir, "documents"))


def op3_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_cascade.url_verdicts(table(spark, sf_dir, "pages"), rules)


def op4_spliced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spliced_counts.token_counts(table(spark, sf_dir, "documents"),
                                       public_tokenizers.path("piece_bpe_32k.model"))


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.bpe_digests(table(spark, sf_dir, "documents"),
                                public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                public_tokenizers.PATTERN)


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                    public_tokenizers.PATTERN)


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.packed_pieces(table(spark, sf_dir, "documents"),
                                           public_tokenizers.path("word_bpe_49k.json"))


def op9_subword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_classifier.quality_scores(table(spark, sf_dir, "documents"),
                                             table(spark, sf_dir, "labels"))


def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.nearest(table(spark, sf_dir, "embeddings"),
                                      F.col("vec_id") % 50 == 0)


def op11_cut_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_counts(table(spark, sf_dir, "documents"),
                                      public_tokenizers.path("byte_bpe_50k.json"),
                                      public_tokenizers.path("piece_bpe_32k.model"))


def op12_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (
        op1_interpolated_scores, op2_quality_votes, op3_url_verdicts, op4_spliced_counts,
        op5_jaccard_components, op6_tree_bpe, op7_secret_spans, op8_retrieval_packing,
        op9_subword_scores, op10_learned_partitions, op11_cut_alignment, op12_toxicity_trees,
        op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_votes": checking_sql.quality_votes(),
            "op3_url_verdicts": checking_sql.URL_VERDICTS,
            "op5_jaccard_components": checking_sql.jaccard_components(3, 90)}
