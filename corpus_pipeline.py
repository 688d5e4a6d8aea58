"""The corpus pipeline: documents in, clean deduplicated decontaminated documents through, sampled token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; each works on all
that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.7 or more. A document is told by its row, so repeated ids are judged each by its own text."""
    from tessera.llm.queries import toxicity_model
    from tessera.llm.toxicity import without_toxic

    return without_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), threshold=0.7).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages removed; n_chars counts what is left. A document that consisted of nothing else is dropped: all its text stands elsewhere."""
    from tessera.llm.line_dedup import dedup_lines

    out = dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), the one with the smallest id. Rows that share an id are judged each by its own text."""
    from tessera.llm.minhash import representatives

    return representatives(docs.select(*COLUMNS), width=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents into which a benchmark item leaks."""
    from tessera.llm.decontamination import find_leaks

    return find_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text, with piece ids and inclusion scores; decoding gives the text back."""
    from tessera.llm.queries import tokenizer_path
    from tessera.llm.sampling import sample_segmentations

    return sample_segmentations(docs, tokenizer_path(), k=2, seed=17)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("minhash_near_dedup", drop_near_duplicates), ("decontamination", drop_benchmark), ("sentencepiece", encode)]

#: SQL can express neither the learned scores nor the content-defined chunks; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
