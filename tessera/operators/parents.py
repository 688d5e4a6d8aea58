"""From child hits to parent contexts under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.search import ranked


def resolve(candidates: DataFrame, parents: DataFrame, aggregation: str = "mean_child") -> DataFrame:
    """Children's hits (query_id, chunk_id, parent_id, score) grouped by parent and ranked: .6 best + .3 mean + at most .1 for company.

    (query_id, parent_id, best_score, aggregate_score, rank_score, n_children, children, token_estimate, rank); children by falling score. Children whose
    parent isn't in parents (parent_id, token_estimate) are dropped.
    """
    value = {"best_child": F.max("score"), "mean_child": F.avg("score"), "sum_child": F.sum("score")}[aggregation]
    grouped = candidates.groupBy("query_id", "parent_id").agg(
        F.round(F.max("score"), 5).alias("best_score"),
        F.round(value, 5).alias("aggregate_score"),
        F.round(F.max("score") * 0.6 + F.avg("score") * 0.3 + F.least(F.lit(0.1), (F.count(F.lit(1)) - 1) * 0.02), 5).alias("rank_score"),
        F.count(F.lit(1)).alias("n_children"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id"))), lambda x: x["chunk_id"]).alias("children"),
    )
    return ranked(grouped.join(parents.select("parent_id", "token_estimate"), "parent_id"), by="rank_score", key="parent_id")


def greedy(items: Column, most: int, budget: int) -> Column:
    """Fold over (parent_id, tokens) by rank: the first is always admitted, later ones while they fit; what doesn't fit is skipped."""
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).cast("long").alias("tokens"), F.lit(0).alias("by_limit"), F.lit(0).alias("by_budget"))

    def step(s: Column, x: Column) -> Column:
        full = F.size(s["ids"]) >= most
        over = (F.size(s["ids"]) > 0) & (s["tokens"] + x["tokens"] > budget)
        return F.struct(
            F.when(full | over, s["ids"]).otherwise(F.concat(s["ids"], F.array(x["id"]))).alias("ids"),
            F.when(full | over, s["tokens"]).otherwise(s["tokens"] + x["tokens"]).alias("tokens"),
            F.when(full, s["by_limit"] + 1).otherwise(s["by_limit"]).alias("by_limit"),
            F.when(~full & over, s["by_budget"] + 1).otherwise(s["by_budget"]).alias("by_budget"),
        )

    return F.aggregate(items, start, step)


def within_budget(resolved: DataFrame, max_parents: int = 4, max_tokens: int = 2000) -> DataFrame:
    """(query_id, parent_ids, total_tokens, dropped_by_limit, dropped_by_budget, budget_exceeded, unique_parents, n_children) of resolved parents."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("parent_id").alias("id"), F.col("token_estimate").cast("long").alias("tokens")))), lambda x: F.struct(x["id"].alias("id"), x["tokens"].alias("tokens")))
    folded = resolved.groupBy("query_id").agg(greedy(items, max_parents, max_tokens).alias("s"), F.count(F.lit(1)).alias("unique_parents"), F.sum("n_children").alias("n_children"))
    return folded.select("query_id", F.col("s.ids").alias("parent_ids"), F.col("s.tokens").alias("total_tokens"), F.col("s.by_limit").alias("dropped_by_limit"), F.col("s.by_budget").alias("dropped_by_budget"), (F.col("s.by_budget") > 0).alias("budget_exceeded"), "unique_parents", "n_children")


def fetch(parents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Parents of wanted (query_id, parent_ids) in the order asked, with their place; unknown ids are left out."""
    return wanted.select("query_id", F.posexplode("parent_ids").alias("place", "parent_id")).join(parents, "parent_id")


def completeness(candidates: DataFrame, resolved: DataFrame, children: DataFrame) -> DataFrame:
    """(query_id, covered): the share of the first parent's tokens that the retrieved children cover, at most 1, four decimals."""
    first = resolved.where("rank = 1").select("query_id", "parent_id", "token_estimate")
    met = candidates.join(children.select(F.col("child_id").alias("chunk_id"), F.col("token_estimate").alias("tokens")), "chunk_id").join(first, ["query_id", "parent_id"])
    return met.groupBy("query_id").agg(F.round(F.least(F.lit(1.0), F.sum("tokens") / F.max("token_estimate")), 4).alias("covered"))
