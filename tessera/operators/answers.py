"""Context assembly and answers without a model."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """What a generating model must offer; the engine itself brings the deterministic answers below."""

    def complete(self, prompts: DataFrame) -> DataFrame: ...


def in_order(value: Column) -> Column:
    """An aggregate: values by rank."""
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda x: x["v"])


def context(hits: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(query_id, context, n): numbered sources with scores, by rank. hits (query_id, chunk_id, content, source, score, rank)."""
    line = F.format_string("[Source %d (%s, score: %.3f)]: %s", "rank", F.coalesce("source", F.lit("unknown")), "score", "content")
    return hits.groupBy("query_id").agg(F.array_join(in_order(line), separator).alias("context"), F.count(F.lit(1)).alias("n"))


def template_answers(queries: DataFrame, hits: DataFrame, snippet: int = 180) -> DataFrame:
    """(query_id, answer): the first hit's beginning and the number of hits, or a refusal where there are none. queries (query_id, query)."""
    first = hits.groupBy("query_id").agg(F.element_at(in_order(F.regexp_replace(F.substring("content", 1, snippet), "\n", " ")), 1).alias("s"), F.count(F.lit(1)).alias("n"))
    said = F.format_string("From the retrieved context, for \"%s\": \"%s...\" (%d documents).", "query", "s", "n")
    return queries.join(first, "query_id", "left").select("query_id", F.when(F.col("n").isNull(), F.format_string("Nothing relevant to \"%s\" was found.", "query")).otherwise(said).alias("answer"))


def grounded(hits: DataFrame, low: float = 0.7, high: float = 0.98, snippet: int = 140) -> DataFrame:
    """(query_id, answer, confidence, cited, insights): the top hit's text, its score held between low and high (.95 above 1), and the first three hits' ids and beginnings."""
    top = F.element_at(in_order(F.col("score")), 1)
    return hits.groupBy("query_id").agg(F.element_at(in_order(F.col("content")), 1).alias("answer"), F.least(F.lit(high), F.greatest(F.lit(low), F.when(top > 1, 0.95).otherwise(top))).alias("confidence"), F.slice(in_order(F.col("chunk_id").cast("string")), 1, 3).alias("cited"), F.slice(in_order(F.concat(F.regexp_replace(F.substring("content", 1, snippet), "\n", " "), F.lit("..."))), 1, 3).alias("insights"))
