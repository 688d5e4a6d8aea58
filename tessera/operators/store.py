"""A vector store over a table: one place to add, remove and search, with a choice of index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.sources.loaders import delete, upsert


class VectorStore:
    """Records (chunk_id, embedding, ...) with an index: flat (exact), ivf (inverted lists) or graph.

    Every change gives a new table, nothing is copied; lists and graphs are built over what the store holds at the time of a search.
    """

    def __init__(self, records: DataFrame, index: str = "flat", metric: str = "cosine", lists: int = 8, nprobe: int = 3, rounds: int = 10):
        if index not in ("flat", "ivf", "graph"):
            raise ValueError(f"unknown index {index}")
        self.records, self.index, self.metric, self.lists, self.nprobe, self.rounds = records, index, metric, lists, nprobe, rounds

    def add(self, fresh: DataFrame) -> "VectorStore":
        """Records of fresh take the place of those with their ids."""
        self.records = upsert(self.records, fresh, "chunk_id")
        return self

    def remove(self, gone: DataFrame) -> "VectorStore":
        self.records = delete(self.records, gone, "chunk_id")
        return self

    def clear(self) -> "VectorStore":
        self.records = self.records.where("false")
        return self

    def count(self) -> int:
        return self.records.count()

    def search(self, queries: DataFrame, k: int = 5, predicate: Column | None = None, least: float | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank) for queries (query_id, q). The predicate comes before a flat or list search, and after a graph's beam; the threshold after the top k."""
        usable = self.records.where("embedding is not null")
        if self.index == "flat":
            hits = S.top_k(usable, queries, k, self.metric, predicate=predicate)
        elif self.index == "ivf":
            kept = (usable if predicate is None else usable.where(predicate)).select("chunk_id", "embedding")
            centroids, held = S.ivf_train(kept, self.lists, self.rounds, normalized=True)
            hits = S.ivf_search(kept, centroids, held, queries, k, self.nprobe)
        else:
            hits = S.graph_search(usable, queries, k if predicate is None else 4 * k)
            if predicate is not None:
                hits = S.ranked(hits.drop("rank").join(usable.where(predicate).select("chunk_id"), "chunk_id", "left_semi"), k)
        return hits if least is None else S.at_least(hits, least)

    def stats(self) -> DataFrame:
        return self.records.agg(F.count(F.lit(1)).alias("records"), F.count("embedding").alias("embedded"), F.max(F.size("embedding")).alias("dim"))
