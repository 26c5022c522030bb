"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, lexical, media_avi, negatives, ngram_jaccard, packing, pii, quality_fm, secrets, suffixes, toxicity, warc
from .common import table


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.flat(chat.rotate(table(spark, sf_dir, "conversations")))


def op3_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), word_vocabulary()))


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.digests(media_avi.decode_media(media_avi.encode_media(table(spark, sf_dir, "documents"))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(table(spark, sf_dir, "documents")))


def op9_secret_lexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.without_repeats(table(spark, sf_dir, "documents")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    ops = (op1_ngram_jaccard, op2_chat_rotation, op3_warc_chain, op4_packing, op5_quality_fm, op6_avi_clips, op7_toxicity, op8_pii_crf, op9_secret_lexer, op10_decontamination, op11_hard_negatives, op12_suffix_dedup, op13_ranked_search, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql():
    return {"op2_chat_rotation": chat.ORACLE, "op10_decontamination": decontam.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op12_suffix_dedup": suffixes.ORACLE, "op13_ranked_search": lexical.ORACLE}
