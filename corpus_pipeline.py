"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's ``docs``.  The last stage's rows describe the token files it has written.

All stages keep columns that they don't read, whatever their names (but those that begin with
``_fw_``); a stage of an empty table is an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import decontaminate, mixing, quality, simhash, token_files
from framewright.llm.common import cut
from framewright.llm.queries import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the rules reject go.

    Null, empty and short texts (fewer than 50 words) fail the base rules; rows that repeat, and null
    ids, are judged as any other; equal votes get equal verdicts.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one of smallest doc_id, then of smallest hash.

    Groups go by fingerprints, not by ids, so texts with null or repeated ids are lost only to a near
    copy of theirs; of rows that repeat id and text one stays; all texts without words are one group.
    """
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which a benchmark window stands, exactly or nearly, go.

    Null and empty texts hold none and stay; null items and those without a word match nothing; rows
    that repeat share their verdict.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are repeated or left out until sources have their weights.

    Texts without words are never taken; null sources are one source, last in order; rows that repeat
    take their copies together, at most two each.
    """
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token-id files: a row per text, read back from them, in order of doc_id (null first).

    A null text is its end id alone.
    """
    rows = token_files.token_files(docs, tokenizer_path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", source_mix), ("token_files", token_output)]

#: Expectation-maximisation and the component search are loops that SQL can't state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents; returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
