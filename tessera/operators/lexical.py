"""Inverted index and lexical scoring. Token tables are (chunk_id, pos, term); queries are rows (query_id, term)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_rows(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(chunk_id, pos, term) of an array of terms."""
    return df.select(F.col(id_col).alias("chunk_id"), F.posexplode(tokens).alias("pos", "term"))


def postings(tokens: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, positions)."""
    return tokens.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_stats(tokens: DataFrame) -> DataFrame:
    """(term, df, ctf): documents and occurrences of each term."""
    return tokens.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))


def lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("dl"))


def index_stats(tokens: DataFrame, chunks: DataFrame | None = None, id_col: str = "chunk_id") -> DataFrame:
    """One row (n, total_tokens, vocabulary, avgdl); n counts chunks without tokens too if chunks are given."""
    by_chunk = lengths(tokens).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"))
    if chunks is not None:
        by_chunk = by_chunk.drop("n").crossJoin(chunks.agg(F.count_distinct(id_col).alias("n")))  # one row by one row
    vocabulary = tokens.select("term").distinct().agg(F.count(F.lit(1)).alias("vocabulary"))
    return by_chunk.crossJoin(vocabulary).select("n", "total_tokens", "vocabulary", F.coalesce(F.try_divide("total_tokens", "n"), F.lit(0.0)).alias("avgdl"))


def remove_chunks(index: DataFrame, gone: DataFrame) -> DataFrame:
    """An index (tokens or postings) without the chunks of gone; statistics follow from what is left."""
    return index.join(gone.select("chunk_id"), "chunk_id", "left_anti")


def reindex(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with the chunks of fresh in place of their earlier versions."""
    return remove_chunks(index, fresh.select("chunk_id").distinct()).unionByName(fresh)


def bm25_idf(n: Column, df: Column, floor: float | None = None) -> Column:
    value = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return F.when(df == 0, F.lit(0.0)).otherwise(value if floor is None else F.greatest(F.lit(floor), value))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def plain_idf(n: Column, df: Column) -> Column:
    return F.when(df == 0, F.lit(0.0)).otherwise(F.log(n / df))


def probabilistic_idf(n: Column, df: Column) -> Column:
    return F.when(n <= df, F.lit(0.0)).otherwise(F.log((n - df) / df))


@dataclass(frozen=True)
class Bm25:
    """k1 and b; the least idf (None: as it comes); whether repeated query terms count once."""

    k1: float = 1.5
    b: float = 0.75
    idf_floor: float | None = None
    unique_terms: bool = True


def matches(tokens: DataFrame, queries: DataFrame, unique_terms: bool = True) -> DataFrame:
    """(query_id, term, qtf, chunk_id, tf, df, dl, n, avgdl) of every query term in every chunk that holds it.

    The tokens are read once: terms that no query has fall together in one row a chunk, so that the same small table gives term
    frequencies and lengths. Queries are small against the corpus; Spark broadcasts them if they are below its threshold, else it shuffles by term.
    """
    asked = queries.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    if unique_terms:
        asked = asked.withColumn("qtf", F.lit(1).cast("long"))
    wanted = asked.select("term").distinct().withColumn("wanted", F.col("term"))
    counts = tokens.join(wanted, "term", "left").groupBy("chunk_id", F.col("wanted").alias("term")).agg(F.count(F.lit(1)).alias("tf"))
    full = counts.withColumn("dl", F.sum("tf").over(Window.partitionBy("chunk_id")))
    stats = full.groupBy("chunk_id").agg(F.max("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    tf = full.where("term is not null")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats))


def bm25_contribution(o: Bm25) -> Column:
    saturated = F.col("tf") * (o.k1 + 1) / (F.col("tf") + o.k1 * (1 - o.b + o.b * F.col("dl") / F.col("avgdl")))
    return F.col("qtf") * bm25_idf(F.col("n"), F.col("df"), o.idf_floor) * saturated


def bm25(tokens: DataFrame, queries: DataFrame, options: Bm25 = Bm25()) -> DataFrame:
    """(query_id, chunk_id, score) of chunks that hold a query term."""
    return matches(tokens, queries, options.unique_terms).withColumn("c", bm25_contribution(options)).groupBy("query_id", "chunk_id").agg(F.sum("c").alias("score"))


def bm25_explain(tokens: DataFrame, queries: DataFrame, options: Bm25 = Bm25()) -> DataFrame:
    """(query_id, chunk_id, term, tf, df, idf, dl, avgdl, contribution): a score's parts."""
    return matches(tokens, queries, options.unique_terms).select("query_id", "chunk_id", "term", "tf", "df", bm25_idf(F.col("n"), F.col("df"), options.idf_floor).alias("idf"), "dl", "avgdl", bm25_contribution(options).alias("contribution"))


def tfidf(tokens: DataFrame, queries: DataFrame, smooth: bool = True, sublinear: bool = True) -> DataFrame:
    """(query_id, chunk_id, score) with 1 + ln tf (or tf) times the smooth (or plain) idf of each distinct query term."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    idf = (smooth_idf if smooth else plain_idf)(F.col("n"), F.col("df"))
    return matches(tokens, queries).groupBy("query_id", "chunk_id").agg(F.sum(tf * idf).alias("score"))


def keyword_search(tokens: DataFrame, queries: DataFrame, metadata: DataFrame | None = None, predicate: Column | None = None, options: Bm25 = Bm25(idf_floor=0.25), k: int = 10) -> DataFrame:
    """(query_id, chunk_id, bm25, tfidf, rank): candidates from the postings, then the metadata predicate, then both scores, then the best k by BM25."""
    scored = bm25(tokens, queries, options).withColumnRenamed("score", "bm25").join(tfidf(tokens, queries).withColumnRenamed("score", "tfidf"), ["query_id", "chunk_id"])
    if predicate is not None:
        scored = scored.join(metadata.where(predicate).select("chunk_id"), "chunk_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def phrases(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, pos) of every place where a query's terms follow each other; queries (query_id, at, term), at from 0."""
    size = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    hits = tokens.join(queries, "term").groupBy("query_id", "chunk_id", (F.col("pos") - F.col("at")).alias("pos")).agg(F.count(F.lit(1)).alias("found"))
    return hits.join(size, "query_id").where("found = size").select("query_id", "chunk_id", "pos")


def proximity(tokens: DataFrame, asked: DataFrame, within: int) -> DataFrame:
    """(query_id, chunk_id, n, least): how often the two terms of asked (query_id, a, b), a other than b, stand next to each other but for other words, at most `within` places apart, in any order, and the least distance.

    The least distance of two terms is one between neighbours in the sequence of their places, so no pairs of places are joined.
    """
    either = asked.select("query_id", F.explode(F.array("a", "b")).alias("term"))
    order = Window.partitionBy("query_id", "chunk_id").orderBy("pos")
    places = tokens.select("chunk_id", "pos", "term").join(either, "term")
    gaps = places.select("query_id", "chunk_id", "term", F.lag("term").over(order).alias("before"), (F.col("pos") - F.lag("pos").over(order)).alias("gap"))
    return gaps.where((F.col("term") != F.col("before")) & (F.col("gap") <= within)).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("gap").cast("long").alias("least"))
