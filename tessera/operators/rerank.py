"""Second-stage scores over candidates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import service_tokens, space_tokens, word_tokens
from tessera.operators.search import ranked

# Terms whose joint presence is rewarded.
INTENTS = ("reset", "password", "login", "auth", "delete", "update", "refund")


def has(text: Column, term: Column) -> Column:
    return F.contains(text, term)


def cross_score(query: Column, title: Column, content: Column) -> Column:
    """The local cross-encoder: coverage, phrase, title, proximity and intent, three decimals, within .05 and .99; .5 for a query without terms."""
    q = F.trim(F.lower(query))
    t, c = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    full = F.concat(t, F.lit(" "), c)
    terms = space_tokens(query)
    n = F.size(terms)
    found = F.filter(terms, lambda w: has(full, w))
    phrase = F.when(has(c, q), 0.45).otherwise(0.0) + F.when(has(t, q), 0.25).otherwise(0.0)
    boost = F.size(F.filter(terms, lambda w: has(t, w))) * 0.1 / n
    places = F.array_sort(F.filter(F.transform(found, lambda w: F.position(w, c)), lambda p: p > 0))
    gaps = F.zip_with(F.slice(places, F.lit(1), F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), lambda a, b: b - a)
    gap = F.array_min(gaps)
    near = F.when((F.size(found) >= 2) & (gap < 50), 0.2).when((F.size(found) >= 2) & (gap < 150), 0.1).otherwise(0.0)
    wanted = F.filter(terms, lambda w: w.isin(*INTENTS))
    intent = F.when((F.size(wanted) > 0) & F.forall(wanted, lambda w: has(full, w)), 0.15).otherwise(0.0)
    raw = F.size(found) / n * 0.4 + phrase + boost + near + intent
    return F.when(n == 0, F.lit(0.5)).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.05), F.round(raw, 3))))


def overlap(query_terms: Column, text: Column) -> Column:
    """Share of a query's terms that occur in the text; 0 without terms."""
    return F.when(F.size(query_terms) > 0, F.size(F.filter(query_terms, lambda w: has(text, w))) / F.size(query_terms)).otherwise(F.lit(0.0))


def both(content: Column, title: Column) -> Column:
    return F.lower(F.concat(F.coalesce(content, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))))


def rerank_cross(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """candidates (query_id, query, chunk_id, title, content, ...) with score and rank."""
    return ranked(candidates.withColumn("score", cross_score(F.col("query"), F.col("title"), F.col("content"))), k)


def alone(df: DataFrame) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy("query_id")) <= 1


def rerank_multiplicative(candidates: DataFrame, k: int = 5) -> DataFrame:
    """(.5 cosine + .3 fusion + .2 overlap)(1 + .15 (occurrences - 1)); a single candidate keeps its fusion score. candidates (query_id, query, chunk_id, title, content, cosine, score, occurrences)."""
    value = (F.col("cosine") * 0.5 + F.col("score") * 0.3 + overlap(word_tokens(F.col("query")), both(F.col("content"), F.col("title"))) * 0.2) * (1 + (F.col("occurrences") - 1) * 0.15)
    return ranked(candidates.withColumn("score", F.round(F.when(alone(candidates), F.col("score")).otherwise(value), 9)), k)


def rerank_additive(candidates: DataFrame, k: int = 5) -> DataFrame:
    """.55 cosine + .25 overlap + .1 fusion + at most .25 for occurrences, four decimals; a single candidate keeps its score."""
    value = F.col("cosine") * 0.55 + overlap(service_tokens(F.col("query"), 2), both(F.col("content"), F.col("title"))) * 0.25 + F.col("score") * 0.1 + F.least(F.lit(0.25), (F.col("occurrences") - 1) * 0.1)
    return ranked(candidates.withColumn("score", F.when(alone(candidates), F.col("score")).otherwise(F.round(value, 4))), k)


def rerank_children(candidates: DataFrame, k: int = 8) -> DataFrame:
    """.5 cosine + .25 overlap + .1 fusion + at most .2 for occurrences + .08 if several methods found it, five decimals; a single candidate keeps its score."""
    value = F.col("cosine") * 0.5 + overlap(service_tokens(F.col("query"), 2), both(F.col("content"), F.col("title"))) * 0.25 + F.col("score") * 0.1 + F.least(F.lit(0.2), (F.col("occurrences") - 1) * 0.08) + F.when(F.size("methods") > 1, 0.08).otherwise(0.0)
    return ranked(candidates.withColumn("score", F.when(alone(candidates), F.col("score")).otherwise(F.round(value, 5))), k)


def two_stage(first: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """Rerank first-stage hits (query_id, query, chunk_id, score, rank): final rank and score with first_rank, first_score, rank_delta, and whether the top changed."""
    joined = first.withColumnsRenamed({"score": "first_score", "rank": "first_rank"}).join(texts.select("chunk_id", "title", "content"), "chunk_id")
    final = rerank_cross(joined).withColumn("rank_delta", F.col("first_rank") - F.col("rank"))
    top = F.max(F.when((F.col("rank") == 1) & (F.col("first_rank") != 1), F.lit(True)).otherwise(F.lit(False))).over(Window.partitionBy("query_id"))
    return final.withColumn("top_changed", top).where(F.col("rank") <= k).drop("title", "content")
