"""From raw documents to token ids: five stages, each of which works on all that the one before kept.

A stage's result is to be written before the next stage begins (as ``run`` does): a stage deletes the tables that earlier
ones wrote to the shared folder on their way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import bpe_chunks, chosen_path, common, golden_mix, kneser_ney, line_runs
from loomspan.llm.common import deleted, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the basic rules or the perplexity bands of their language reject go.

    Null and empty texts go (fewer than 50 words); a null language is a language; very long texts are judged whole;
    repeated rows share their verdict; an empty table stays empty; other columns are carried whatever their names.
    """
    return common.stage(lambda: kneser_ney.filtered(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts; n_chars follows where it is a column.

    A null text stays null and an empty one empty; lines of any length are lines; the copy in the row of the least id (nulls
    last, then by key) is the first; rows that agree in id and text get the same text; an empty table stays empty; other columns
    are carried whatever their names.
    """
    return common.stage(lambda: line_runs.dedup(docs, length="n_chars" if "n_chars" in docs.columns else None, facts=False))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of least id (nulls last, then by key).

    Null texts and those without words stay; very long texts are compared whole; of rows that agree in id and text one
    stays; an empty table stays empty; other columns are carried whatever their names.
    """
    return common.stage(lambda: chosen_path.deduplicated(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, rounded to whole documents.

    Null and empty texts have no words and go; a null source is a source; rows that agree in id and text share their copies;
    very long texts may be taken in part, which rounds to none or all; an empty table stays empty; other columns are carried
    whatever their names.
    """
    return common.stage(lambda: golden_mix.mixed(docs))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row a document.

    Null texts count as empty, which have no ids; very long texts are encoded whole; repeated rows give repeated rows; an empty
    table stays empty; other columns are left out.
    """
    common.stage_over()
    return bpe_chunks.digests(bpe_chunks.encode_decode(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("source_mix", source_mix),
    ("bpe", bpe),
]

#: SQL can express neither the language model nor the vocabulary's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of ``sf_dir``. Each stage's result is written to the shared folder, and what the stage
    wrote on the way, and the result before it, are deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        made = written(stage(spark, docs, sf_dir), keep=True)
        common.stage_over()
        if before is not None:
            deleted(spark, before)
        docs = before = made
    return STAGES[-1][1](spark, docs, sf_dir)
