"""Query expansion: rule-based variations and hypothetical passages, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases and what they are replaced by in a variation.
SYNONYMS = {
    "stop users from accessing": "restrict user access and invalidate session",
    "session expires": "authentication token expiration handling",
    "protected pages": "authorized routes and endpoint security",
    "authentication": "login user identity and authorization",
    "refund policy": "subscription billing cancellation return terms",
    "password reset": "credential recovery account security",
    "slow queries": "database index execution plan performance tuning",
    "rate limit": "api throttling request threshold control",
}
# Hypothetical passages by the keywords that call for them, in order.
PASSAGES = (
    (("rag", "hallucinat", "retriev"), "Retrieval-Augmented Generation (RAG) incorporates external knowledge retrieval to eliminate model hallucinations. By embedding user questions and retrieving dense vector matches from a document store, context is supplied directly to the LLM. Hypothetical Document Embeddings (HyDE) further optimize semantic matching by replacing the raw user query with a generated synthetic passage that shares structural and lexical similarity with target knowledge base documents."),
    (("auth", "jwt", "token", "session"), "Authentication and session management rely on JSON Web Tokens (JWT) for stateless identity verification. Access tokens carry a short time-to-live (15 minutes), while refresh tokens (7-day TTL) allow seamless session renewal. Invalidated or expired sessions are tracked in a high-performance Redis blacklist to enforce immediate access revocation across all microservice endpoints."),
    (("postgres", "db", "index", "sql", "slow"), "Database performance optimization in PostgreSQL requires analyzing slow query logs via pg_stat_statements and adding composite B-Tree indexes on frequently filtered columns. Proper indexing eliminates expensive full table sequential scans and optimizes query execution plans under high concurrent transaction loads."),
    (("cache", "redis"), "Distributed caching with Redis employs sliding window TTL expiration and volatile-lru eviction policies. Caching frequently requested database queries reduces primary datastore load and maintains sub-millisecond API response latency during peak traffic spikes."),
    (("rate limit", "circuit", "resilien", "gateway"), "API Gateway infrastructure utilizes Redis-backed Token Bucket algorithms for rate limiting and Resilience4j circuit breakers for microservice fault tolerance. When failure thresholds exceed 50%, circuit breakers trip to isolate downstream service degradation and prevent system-wide failure."),
)
GENERIC = ("Comprehensive documentation regarding ", ": The system implements declarative domain patterns to handle request processing, system optimization, and architectural reliability. Detailed procedures specify configuration, error handling, performance metrics, and standard operational protocols for ", ".")
FURTHER = (" Additional architectural perspective #", ": Implementation guidelines emphasize fault isolation, scalable data structures, and optimized vector search representations.")


def synonym(query: Column) -> Column:
    out = query
    for phrase, other in SYNONYMS.items():
        out = F.regexp_replace(out, f"(?i){phrase}", other)
    return out


def variations(queries: DataFrame, count: int = 3) -> DataFrame:
    """(question_id, query_id, ordinal, text): each question as asked, then up to count distinct variations by rules. queries (question_id, text)."""
    q = F.col("text")
    low = F.lower(q)
    asks = F.contains(low, F.lit("how can i")) | F.contains(low, F.lit("how do i")) | F.contains(low, F.lit("how to"))
    long = F.filter(F.split(q, r"\s+"), lambda w: F.length(w) > 3)
    rules = F.array(
        F.when(synonym(q) != q, synonym(q)),
        F.when(asks, F.regexp_replace(q, "(?i)how (can|do|should) (i|we|users)", "Best practices and steps for")).otherwise(F.concat(F.lit("Implementation details and guide for "), q)),
        F.concat(F.lit("Architectural design and workflow of "), F.regexp_replace(q, "[?.]", "")),
        F.when(F.size(long) >= 2, F.concat(F.lit("Configuration and management of "), F.concat_ws(" ", F.slice(long, 1, 3)))),
    )
    made = F.filter(rules, lambda v: v.isNotNull())
    padded = F.slice(F.concat(made, F.transform(F.sequence(F.size(made) + 1, F.greatest(F.size(made) + 1, F.lit(count + 1))), lambda i: F.concat(q, F.lit(" technical specification overview "), i.cast("string")))), 1, count)
    rows = queries.select("question_id", F.posexplode(F.concat(F.array(q), padded)).alias("ordinal", "text"))
    first = F.row_number().over(Window.partitionBy("question_id", F.lower("text")).orderBy("ordinal"))
    kept = rows.withColumn("n", first).where("n = 1").drop("n")
    return kept.withColumn("query_id", F.concat(F.col("question_id").cast("string"), F.lit("_"), F.when(F.col("ordinal") == 0, F.lit("q_0_original")).otherwise(F.concat(F.lit("q_"), F.col("ordinal").cast("string")))))


def passage(query: Column) -> Column:
    low = F.lower(query)
    words = F.concat_ws(" ", F.filter(F.split(query, r"\W+"), lambda w: F.length(w) > 3))
    out = F.concat(F.lit(GENERIC[0]), F.when(words == "", query).otherwise(words), F.lit(GENERIC[1]), query, F.lit(GENERIC[2]))
    for keys, text in reversed(PASSAGES):
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(low, F.lit(k))
        out = F.when(hit, F.lit(text)).otherwise(out)
    return out


def hypothetical(queries: DataFrame, count: int = 2) -> DataFrame:
    """(question_id, query_id, ordinal, text): count hypothetical passages for each question."""
    rows = queries.select("question_id", passage(F.col("text")).alias("p"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("ordinal"))
    text = F.when(F.col("ordinal") > 1, F.concat(F.col("p"), F.lit(FURTHER[0]), F.col("ordinal").cast("string"), F.lit(FURTHER[1]))).otherwise(F.col("p"))
    return rows.select("question_id", F.concat(F.col("question_id").cast("string"), F.lit("_hyde_"), F.col("ordinal").cast("string")).alias("query_id"), "ordinal", text.alias("text"))
