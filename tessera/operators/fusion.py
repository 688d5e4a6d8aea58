"""Fusing ranked lists. Hits are (query_id, source, chunk_id, score, rank); one shuffle by (query_id, chunk_id) serves all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.search import ranked


def normalized(hits: DataFrame, method: str = "minmax") -> DataFrame:
    """hits with `norm`, the score normalised in its query and source: minmax (1 without a range), zscore through the logistic function, softmax, none."""
    w = Window.partitionBy("query_id", "source")
    s = F.col("score")
    low, high, mean, sd = F.min(s).over(w), F.max(s).over(w), F.avg(s).over(w), F.stddev_pop(s).over(w)
    value: Column = {
        "minmax": F.when(high == low, F.lit(1.0)).otherwise((s - low) / (high - low)),
        "zscore": 1 / (1 + F.exp(-F.when(sd == 0, F.lit(0.0)).otherwise((s - mean) / sd))),
        "softmax": F.exp(s - high) / F.sum(F.exp(s - F.col("__high"))).over(w),
        "none": s,
    }[method]
    return hits.withColumn("__high", high).withColumn("norm", value).drop("__high")


def by_source(column: str, name: str) -> Column:
    return F.max(F.when(F.col("source") == name, F.col(column)))


def rrf(hits: DataFrame, k: int = 60, weights: dict[str, float] | None = None, top: int | None = None, digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, score, occurrences, rank): the sum over sources of weight / (k + rank)."""
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    fused = hits.withColumn("c", weight / (k + F.col("rank"))).groupBy("query_id", "chunk_id").agg(F.round(F.sum("c"), digits).alias("score"), F.count(F.lit(1)).alias("occurrences"))
    return ranked(fused, top)


def weighted_rrf(hits: DataFrame, alpha: float = 0.5, k: int = 60, top: int | None = None) -> DataFrame:
    """Twice alpha for the dense list, twice 1 - alpha for the sparse one."""
    return rrf(hits, k, {"dense": 2 * alpha, "sparse": 2 * (1 - alpha)}, top)


def alpha_rrf(hits: DataFrame, dense_weight: float = 0.5, k: int = 60, top: int | None = None) -> DataFrame:
    """dense_weight for the dense list, the rest for the sparse one."""
    return rrf(hits, k, {"dense": dense_weight, "sparse": 1 - dense_weight}, top)


def weighted_scores(hits: DataFrame, alpha: float = 0.5, method: str = "minmax", top: int | None = None) -> DataFrame:
    """alpha times the dense norm plus the rest times the sparse one; a missing one counts 0."""
    norms = normalized(hits, method).groupBy("query_id", "chunk_id").agg(by_source("norm", "dense").alias("dense_norm"), by_source("norm", "sparse").alias("sparse_norm"))
    fused = norms.withColumn("score", F.round(alpha * F.coalesce("dense_norm", F.lit(0.0)) + (1 - alpha) * F.coalesce("sparse_norm", F.lit(0.0)), 9))
    return ranked(fused, top)


def explained(hits: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score, dense_rank, sparse_rank, parts, text): where a fused score comes from."""
    at = lambda name: by_source("rank", name).cast("string")
    term = lambda name: F.coalesce(F.concat(F.lit(f"{name} rank "), at(name), F.lit(f": 1/({k}+"), at(name), F.lit(")")), F.lit(f"{name}: none"))
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"), by_source("rank", "dense").alias("dense_rank"), by_source("rank", "sparse").alias("sparse_rank"), F.sort_array(F.collect_list(F.struct("source", "rank", (1 / (k + F.col("rank"))).alias("part")))).alias("parts"), F.concat_ws("; ", term("dense"), term("sparse")).alias("text"))


def merge_queries(hits: DataFrame, strategy: str = "rrf", k: int = 60) -> DataFrame:
    """Merge the lists of a question's variations: hits (question_id, query_id, chunk_id, score, rank) to a row a question and chunk.

    (question_id, chunk_id, occurrences, max_score, avg_score, rrf_score, score, queries, scores, ranks, rank); score is by strategy rrf,
    max_score or avg_score. Order: score, occurrences, chunk_id.
    """
    each = hits.groupBy("question_id", "chunk_id", "query_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    merged = each.groupBy("question_id", "chunk_id").agg(F.count(F.lit(1)).alias("occurrences"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score"), F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("rrf_score"), F.sort_array(F.collect_list("query_id")).alias("queries"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("query_id", "score")))).alias("scores"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("query_id", "rank")))).alias("ranks"))
    scored = merged.withColumn("score", F.round(F.col({"rrf": "rrf_score", "max_score": "max_score", "avg_score": "avg_score"}[strategy]), 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("occurrences"), "chunk_id")))


# How much a hit's score counts by how it was found.
SOURCE_WEIGHTS = {"hyde_vector": 1.0, "direct_vector": 0.8, "bm25": 0.6}
CHILD_WEIGHTS = {"child_dense": 1.0, "child_bm25": 0.6}


def merge_sources(hits: DataFrame, strategy: str = "rrf", weights: dict[str, float] | None = None, k: int = 60, rank_mode: str = "true", group: str = "query_id", digits: int = 5) -> DataFrame:
    """Merge hits (query_id, source, chunk_id, score, rank) of several methods: (query_id, chunk_id, score, occurrences, methods, rank).

    strategy rrf (rank_mode true: by the hit's rank; occurrence: by its place among the chunk's own hits), score_weighted (mean of weighted scores) or
    max_score; scores have five decimals unless said otherwise.
    """
    if rank_mode == "occurrence":
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(group, "chunk_id").orderBy("source", "rank")))
    weight = F.lit(0.6)
    for name, value in (SOURCE_WEIGHTS if weights is None else weights).items():
        weight = F.when(F.col("source") == name, F.lit(value)).otherwise(weight)
    value = {"rrf": F.sum(1 / (k + F.col("rank"))), "score_weighted": F.avg(F.col("score") * weight), "max_score": F.max("score")}[strategy]
    merged = hits.groupBy(group, "chunk_id").agg(F.round(value, digits).alias("score"), F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.collect_set("source")).alias("methods"))
    return ranked(merged, group=group)
