"""The queries op1_* to op13_*, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import table


def op1_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import kneser_ney

    rows = kneser_ney.quality(table(spark, sf_dir, "documents"))
    facts = [c for c in rows.columns if c.startswith("_q_")]
    return rows.select("doc_id", *[F.col(c).alias(c[3:]) for c in facts])


def op2_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import projection_forest

    return projection_forest.link(table(spark, sf_dir, "embeddings"))


def op3_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import bpe_chunks

    return bpe_chunks.digests(bpe_chunks.encode_decode(table(spark, sf_dir, "documents")))


def op4_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import chosen_path

    return chosen_path.join(table(spark, sf_dir, "documents")).drop("_k1", "_k2")


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import line_runs

    rows = line_runs.dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("_l_n_lines").alias("n_lines"), F.col("_l_n_removed").alias("n_removed"), "text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import license_scan

    return license_scan.summary(license_scan.matches(table(spark, sf_dir, "documents")))


def op7_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import golden_mix

    return golden_mix.mix(table(spark, sf_dir, "documents")).drop("source", "_k1", "_k2")


def op8_token_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import token_files

    return token_files.read(token_files.write(table(spark, sf_dir, "documents")))


def op9_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import ftrl

    return ftrl.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import masked_lm

    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import hard_negatives

    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op12_impact_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import impact_index

    return impact_index.ranked(spark, sf_dir)


def op13_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm import fm_index

    return fm_index.decontaminated(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict:
    from loomspan.llm import chosen_path, fm_index, golden_mix, hard_negatives, impact_index, line_runs, projection_forest

    more = {"op11_hard_negatives": hard_negatives.ORACLE, "op12_impact_slices": impact_index.ORACLE, "op13_fm_decontamination": fm_index.ORACLE}
    return more | {"op2_embedding_forest": projection_forest.ORACLE, "op4_chosen_path_join": chosen_path.ORACLE, "op5_line_runs": line_runs.ORACLE, "op7_golden_mix": golden_mix.ORACLE}
