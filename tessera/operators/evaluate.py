"""Measures of retrieval quality over ranked lists (query_id, chunk_id, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, hits, wanted, recall): the share of each query's true chunks that were found."""
    hits = truth.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    wanted = truth.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("wanted"))
    return wanted.join(hits, "query_id", "left").na.fill(0, ["hits"]).withColumn("recall", F.col("hits") / F.col("wanted")).select("query_id", "hits", "wanted", "recall")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, common, jaccard, kendall_tau, spearman_rho) of two lists; the last two are 0 with fewer than two common chunks and use ranks in the full lists."""
    x, y = a.select("query_id", "chunk_id", F.col("rank").alias("ra")), b.select("query_id", "chunk_id", F.col("rank").alias("rb"))
    both = x.join(y, ["query_id", "chunk_id"])
    sizes = x.join(y, ["query_id", "chunk_id"], "full_outer").groupBy("query_id").agg(F.count(F.lit(1)).alias("union"), F.count(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), 1)).alias("common"), F.coalesce(F.sum((F.col("ra") - F.col("rb")) ** 2), F.lit(0.0)).alias("d2"))
    left, right = both.withColumnsRenamed({"chunk_id": "c1", "ra": "a1", "rb": "b1"}), both.withColumnsRenamed({"chunk_id": "c2", "ra": "a2", "rb": "b2"})
    pairs = left.join(right, "query_id").where("c1 < c2").groupBy("query_id").agg(F.sum(F.signum((F.col("a1") - F.col("a2")) * (F.col("b1") - F.col("b2")))).alias("s"))  # lists are top-k, so short
    n = F.col("common")
    out = sizes.join(pairs, "query_id", "left")
    return out.select("query_id", "common", (n / F.col("union")).alias("jaccard"), F.when(n < 2, 0.0).otherwise(F.coalesce("s", F.lit(0.0)) / (n * (n - 1) / 2)).alias("kendall_tau"), F.when(n < 2, 0.0).otherwise(1 - 6 * F.col("d2") / F.nullif(n * (n * n - 1), F.lit(0))).alias("spearman_rho"))


def overlap_percent(found: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap): chunks in common per cent of k."""
    common = found.select("query_id", "chunk_id").join(other.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("query_id").distinct().join(common, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) * 100.0 / k).alias("overlap"))


def gain(single: DataFrame, merged: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, n_single, n_merged, n_new, recall_gain, dedup_ratio) of merged variations against the question alone; gain in per cent, ratio of retrieved hits that were repeats."""
    one, many = single.select("query_id", "chunk_id").distinct(), merged.select("query_id", "chunk_id").distinct()
    count = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    new = count(many.join(one, ["query_id", "chunk_id"], "left_anti"), "n_new")
    out = count(many, "n_merged").join(count(one, "n_single"), "query_id", "left").join(new, "query_id", "left").join(count(retrieved, "n_hits"), "query_id", "left").na.fill(0)
    return out.select("query_id", "n_single", "n_merged", "n_new", F.round(F.coalesce(F.try_divide(F.col("n_new") * 100.0, "n_single"), F.lit(0.0)), 6).alias("recall_gain"), F.round(F.coalesce(1 - F.try_divide("n_merged", "n_hits"), F.lit(0.0)), 6).alias("dedup_ratio"))


def ranking_quality(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, reciprocal_rank, ndcg) at k against relevant (query_id, chunk_id), for every query with a relevant chunk."""
    marked = found.where(F.col("rank") <= k).join(relevant.select("query_id", "chunk_id", F.lit(1).alias("rel")), ["query_id", "chunk_id"])
    got = marked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = relevant.groupBy("query_id").agg(F.least(F.count_distinct("chunk_id"), F.lit(k)).alias("m")).withColumn("idcg", F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))
    return ideal.join(got, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"))


def swap_rate(staged: DataFrame) -> DataFrame:
    """One row (queries, changed, swap_rate, mean_shift) of two-stage results with top_changed and rank_delta."""
    by_query = staged.groupBy("query_id").agg(F.max(F.col("top_changed").cast("int")).alias("c"), F.avg(F.abs("rank_delta")).alias("shift"))
    return by_query.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("c"), F.lit(0)).alias("changed"), F.round(F.avg("c"), 6).alias("swap_rate"), F.round(F.avg("shift"), 6).alias("mean_shift"))


def candidate_sweep(candidates: DataFrame, sizes: list[int]) -> DataFrame:
    """(candidate_n, queries, shifted, shift_rate): how often a second score moves another chunk to the top of the first n candidates; candidates (query_id, chunk_id, rank, second), ties to the better rank."""
    sized = candidates.withColumn("candidate_n", F.explode(F.array(*map(F.lit, sizes)))).where("rank <= candidate_n")
    firsts = sized.groupBy("candidate_n", "query_id").agg(F.min_by("chunk_id", "rank").alias("one"), F.max_by("chunk_id", F.struct("second", -F.col("rank"))).alias("two"))
    moved = (F.col("one") != F.col("two")).cast("long")
    return firsts.groupBy("candidate_n").agg(F.count(F.lit(1)).alias("queries"), F.sum(moved).alias("shifted"), F.round(F.avg(moved), 2).alias("shift_rate"))


def report(df: DataFrame) -> str:
    """A small result as an aligned text table, for the console."""
    rows = [df.columns, *([str(v) for v in r] for r in df.limit(200).collect())]
    widths = [max(map(len, c)) for c in zip(*rows, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows)
