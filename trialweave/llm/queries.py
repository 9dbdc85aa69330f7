"""The registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialweave.llm import decontaminate, fill_in_middle, fingerprint, kneser_ney, line_join, minhash_join, mixing, quality_crf, rans, slots, spelling, substring_dedup, warc
from trialweave.llm.scratch import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.line_classes(table(spark, sf_dir, "documents"), min_chars=1)


def op4_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard(table(spark, sf_dir, "documents"))


def op5_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents"))


def op6_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, normal = new_path(spark, "warc"), new_path(spark, "warc-members")
    warc.write_archives(table(spark, sf_dir, "pages"), written)
    warc.normalise(warc.archives(spark, written), written, normal)
    return warc.page_records(spark, normal)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only here: the other queries do without it

    path = new_path(spark, "tokens")
    rans.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return rans.read_tokens(spark, path, with_ids=False)


def op10_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op11_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(table(spark, sf_dir, "documents"))


def op12_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_multiset_fingerprint, op2_quality_crf, op3_line_edit_join, op4_slot_sharding, op5_hierarchical_mixing, op6_minhash_join, op7_warc_normaliser, op8_decontaminate, op9_rans_tokens, op10_cover_anchors, op11_kneser_ney, op12_permuterm_variants, op13_fill_in_middle)}
ORACLE = {"op3_line_edit_join": line_join.ORACLE, "op6_minhash_join": minhash_join.ORACLE, "op7_warc_normaliser": warc.ORACLE, "op10_cover_anchors": substring_dedup.ORACLE, "op5_hierarchical_mixing": mixing.ORACLE, "op8_decontaminate": decontaminate.ORACLE, "op13_fill_in_middle": fill_in_middle.ORACLE}
