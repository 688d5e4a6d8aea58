"""Loading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows take long to work on.
HEAVY = ("documents", "pages", "embeddings")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out to all of them; any other as it is. A file of one row group would else be one task's work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df
