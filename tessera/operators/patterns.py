"""Retrieval patterns beyond a single search: hops, routing, correction, hierarchy, conversation, graphs, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lexical import Bm25, bm25
from tessera.operators.search import ranked


def multi_hop(tokens: DataFrame, queries: DataFrame, hops: int = 2, k: int = 3, new_terms: int = 2, options: Bm25 = Bm25()) -> DataFrame:
    """A trace (query_id, hop, chunk_id, score, rank): each hop asks with the terms before plus the rarest new ones of the last hop's best chunk. queries (query_id, term)."""
    df = tokens.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    trace, asked = None, queries.select("query_id", "term").distinct()
    for hop in range(1, hops + 1):
        scored = bm25(tokens, asked, options).withColumn("score", F.round("score", 6))
        found = ranked(scored, k).withColumn("hop", F.lit(hop))
        trace = found if trace is None else trace.unionByName(found)
        if hop < hops:
            best = found.where("rank = 1").select("query_id", "chunk_id")
            terms = tokens.select("chunk_id", "term").join(best, "chunk_id").select("query_id", "term").distinct().join(asked, ["query_id", "term"], "left_anti").join(df, "term")
            rare = terms.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))).where(F.col("r") <= new_terms)
            asked = asked.unionByName(rare.select("query_id", "term"))
    return trace.select("query_id", "hop", "chunk_id", "score", "rank")


def corrective(hits: DataFrame, fallback: DataFrame, accept: float = 0.8, refine: float = 0.5) -> DataFrame:
    """Hits with an action by each query's best score: accept, refine (scores of at least refine stay) or fallback (the fallback's hits instead)."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    action = F.when(F.col("best") >= accept, "accept").when(F.col("best") >= refine, "refine").otherwise("fallback")
    routed = hits.join(best.select("query_id", action.alias("action")), "query_id")
    kept = routed.where((F.col("action") == "accept") | ((F.col("action") == "refine") & (F.col("score") >= refine)))
    other = fallback.join(best.where(F.col("best") < refine).select("query_id"), "query_id", "left_semi").withColumn("action", F.lit("fallback"))
    columns = ["query_id", "chunk_id", "score", "action"]
    return kept.select(*columns).unionByName(other.select(*columns))


def coarse_to_fine(coarse: DataFrame, fine: DataFrame, group: str, k_coarse: int, k_fine: int) -> DataFrame:
    """The best fine hits among those whose group is one of the best coarse hits: coarse (query_id, <group>, score), fine (query_id, <group>, chunk_id, score)."""
    top = ranked(coarse, k_coarse, key=group).select("query_id", group)
    return ranked(fine.join(top, ["query_id", group], "left_semi"), k_fine)


def contextual(chunks: DataFrame, docs: DataFrame, fields: list[str], id_col: str = "doc_id") -> DataFrame:
    """chunks with `contextual`: their document's fields in front of the content."""
    head = docs.select(id_col, F.concat_ws(" | ", *(F.concat(F.lit(f"{f}: "), F.col(f).cast("string")) for f in fields)).alias("__head"))
    return chunks.join(head, id_col).withColumn("contextual", F.concat_ws("\n", "__head", "content")).drop("__head")


def standalone_queries(turns: DataFrame, history: int = 2, role: str = "user") -> DataFrame:
    """(conv_id, turn, query): every user turn with the texts of the history turns before it in front."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-history, -1)
    past = F.concat_ws(" ", F.collect_list(F.coalesce("text", F.lit(""))).over(before))
    return turns.withColumn("past", past).where(F.col("role") == role).select("conv_id", "turn", F.trim(F.concat_ws(" ", "past", "text")).alias("query"))


def k_hops(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(start, node, hops): the nodes within hops steps of each start along edges (src, dst), with the fewest steps. Nodes already reached are not expanded again."""
    reached = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("hops", F.lit(0))
    frontier = reached
    for h in range(1, hops + 1):
        step = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("start", F.col("dst").alias("node")).distinct()
        frontier = step.join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(h))
        reached = reached.unionByName(frontier)
    return reached


def deletions(word: Column, most: int) -> Column:
    """A word and what is left of it without up to most letters."""
    out = F.array(word)
    for _ in range(most):
        less = F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))
        out = F.array_distinct(F.concat(out, F.flatten(less)))
    return out


def same_entities(names: DataFrame, most: int = 1) -> DataFrame:
    """(name, canonical): the smallest spelling within `most` edits, after case and punctuation go.

    Spellings that near share what is left of them after as many deletions, so they meet on that; nothing else is paired up.
    """
    clean = F.trim(F.regexp_replace(F.lower("name"), r"[^\w]+", " "))
    base = names.select("name", clean.alias("c")).where("c <> ''").distinct()
    spread = base.select("c").distinct().select("c", F.explode(deletions(F.col("c"), most)).alias("rest"))
    near = spread.join(spread.withColumnRenamed("c", "o"), "rest").where("o <= c").where(F.levenshtein("c", "o") <= most)
    return base.join(near.groupBy("c").agg(F.min("o").alias("canonical")), "c").select("name", "canonical")


def route(query: Column) -> Column:
    """A strategy by a question's form: metadata, multi_hop, keyword or hybrid."""
    words = F.size(F.split(F.trim(query), r"\s+"))
    return F.when(query.rlike(r"(?i)\b(tenant|department|created|language)\b"), "metadata").when(query.rlike(r"(?i)\b(and then|compare|relationship|between)\b"), "multi_hop").when((words <= 2) | query.rlike("[0-9_]"), "keyword").otherwise("hybrid")


def memory(facts: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """The latest fact of each key that isn't older than ttl_days: facts (key, value, ts)."""
    last = facts.groupBy("key").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "value")).alias("f")).select("key", "f.value", "f.ts")
    return last.where(F.col("ts") >= now - F.expr(f"make_interval(0, 0, 0, {ttl_days})"))
