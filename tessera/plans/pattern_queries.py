"""Retrieval patterns and relational checks on the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import patterns as P
from tessera.operators.lexical import Bm25, bm25
from tessera.plans.common import bm25_sql, doc_tokens, index_sql, question_terms, rank_sql, top
from tessera.tables import load


def multi_hop(spark: SparkSession, d: str) -> DataFrame:
    out = P.multi_hop(doc_tokens(spark, d), question_terms(spark), hops=2, k=3)
    return out.withColumn("rank", F.col("rank").cast("long")).withColumn("hop", F.col("hop").cast("long"))


HOP_SQL = f"""WITH {index_sql(True)}, s1 AS (SELECT query_id, chunk_id, sum({bm25_sql()}) AS score FROM m GROUP BY 1, 2), h1 AS ({rank_sql('SELECT * FROM s1', 3)}),
adf AS (SELECT term, count(DISTINCT chunk_id) AS df FROM tok GROUP BY term),
nt AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS r FROM (SELECT DISTINCT h1.query_id, tok.term FROM h1 JOIN tok USING (chunk_id) WHERE h1.rank = 1) x JOIN adf USING (term) WHERE NOT EXISTS (SELECT 1 FROM qt WHERE qt.query_id = x.query_id AND qt.term = x.term)),
q2 AS (SELECT query_id, term FROM qt UNION ALL SELECT query_id, term FROM nt WHERE r <= 2),
t2 AS (SELECT chunk_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q2) GROUP BY 1, 2),
m2 AS (SELECT query_id, term, chunk_id, 1 AS qtf, tf, df, dl, n, avgdl FROM t2 JOIN adf USING (term) JOIN q2 USING (term) JOIN dl USING (chunk_id), st),
s2 AS (SELECT query_id, chunk_id, sum({bm25_sql()}) AS score FROM m2 GROUP BY 1, 2), h2 AS ({rank_sql('SELECT * FROM s2', 3)})
SELECT query_id, 1 AS hop, chunk_id, score, rank FROM h1 UNION ALL SELECT query_id, 2, chunk_id, score, rank FROM h2"""


def bm25_share(spark, d) -> DataFrame:
    """Hits with scores as shares of 15, a scale on which the questions differ."""
    hits = top(bm25(doc_tokens(spark, d), question_terms(spark), Bm25()), 5)
    return hits.withColumn("score", F.round(F.col("score") / 15, 6))


def corrective_route(spark, d):
    fallback = top(bm25(doc_tokens(spark, d), question_terms(spark), Bm25(k1=1.2, b=0.0)), 3).select("query_id", "chunk_id", "score")
    return P.corrective(bm25_share(spark, d), fallback)


CORRECTIVE_SQL = f"""WITH {index_sql(True)}, s AS (SELECT query_id, chunk_id, sum({bm25_sql()}) AS score FROM m GROUP BY 1, 2), h AS (SELECT query_id, chunk_id, round(score / 15, 6) AS score FROM ({rank_sql('SELECT * FROM s', 5)})),
g AS (SELECT query_id, chunk_id, sum({bm25_sql(1.2, 0.0)}) AS score FROM m GROUP BY 1, 2), fb AS ({rank_sql('SELECT * FROM g', 3)}),
b AS (SELECT query_id, max(score) AS best FROM h GROUP BY 1)
SELECT query_id, chunk_id, score, CASE WHEN best >= 0.8 THEN 'accept' ELSE 'refine' END AS action FROM h JOIN b USING (query_id) WHERE best >= 0.8 OR (best >= 0.5 AND score >= 0.5)
UNION ALL SELECT query_id, chunk_id, score, 'fallback' FROM fb JOIN b USING (query_id) WHERE best < 0.5"""


def coarse_to_fine(spark, d):
    """Best sources first, then best documents among theirs."""
    hits = bm25(doc_tokens(spark, d), question_terms(spark), Bm25()).join(load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id").withColumn("score", F.round("score", 6))
    coarse = hits.groupBy("query_id", "source").agg(F.round(F.sum("score"), 4).alias("score"))
    return P.coarse_to_fine(coarse, hits, "source", 2, 5).select("query_id", "source", "chunk_id", "score")


COARSE_SQL = f"""WITH {index_sql(True)}, s AS (SELECT query_id, chunk_id, round(sum({bm25_sql()}), 6) AS score FROM m GROUP BY 1, 2), h AS (SELECT s.*, source FROM s JOIN documents d ON d.doc_id = s.chunk_id),
c AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 4) DESC, source) AS k FROM h GROUP BY query_id, source),
f AS (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS j FROM h JOIN c USING (query_id, source) WHERE k <= 2) SELECT query_id, source, chunk_id, score FROM f WHERE j <= 5"""


def conversation_window(spark, d):
    """Every user turn as a question that stands alone: the two turns before it in front."""
    return P.standalone_queries(load(spark, d, "conversations"), 2)


CONVERSATION_SQL = "SELECT conv_id, turn, trim(concat_ws(' ', a, b, text)) AS query FROM (SELECT *, lag(text, 2) OVER w AS a, lag(text) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'"


def edges(spark, d) -> DataFrame:
    """Customers to nations, nations to regions, and back to nations."""
    nation, customer = load(spark, d, "nation"), load(spark, d, "customer")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    up = nation.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    return customer.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")).unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def graph_khop(spark, d):
    """What each nation reaches in two steps, and each customer in two."""
    e = edges(spark, d)
    starts = e.select(F.col("src").alias("node")).distinct()
    return P.k_hops(e, starts, 2).groupBy("start", "hops").agg(F.count(F.lit(1)).alias("n")).withColumn("hops", F.col("hops").cast("long"))


GRAPH_SQL = """WITH e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
s0 AS (SELECT DISTINCT src AS start, src AS node FROM e), s1 AS (SELECT DISTINCT start, dst AS node FROM s0 JOIN e ON node = src WHERE start <> dst),
s2 AS (SELECT DISTINCT start, dst AS node FROM s1 JOIN e ON node = src WHERE start <> dst AND NOT EXISTS (SELECT 1 FROM s1 x WHERE x.start = s1.start AND x.node = e.dst))
SELECT start, 0 AS hops, count(*) AS n FROM s0 GROUP BY start UNION ALL SELECT start, 1, count(*) FROM s1 GROUP BY start UNION ALL SELECT start, 2, count(*) FROM s2 GROUP BY start"""


def entity_resolution(spark, d):
    """Parts by name and brand that differ in case, punctuation or one letter."""
    return P.same_entities(load(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name")))


ENTITY_SQL = r"WITH b AS (SELECT DISTINCT name, trim(regexp_replace(lower(name), '[^\w]+', ' ', 'g')) AS c FROM (SELECT p_name || ' ' || p_brand AS name FROM part)), n AS (SELECT x.c, min(y.c) AS canonical FROM (SELECT DISTINCT c FROM b) x JOIN (SELECT DISTINCT c FROM b) y ON y.c <= x.c AND levenshtein(x.c, y.c) <= 1 GROUP BY x.c) SELECT name, canonical FROM b JOIN n USING (c)"


def adaptive_route(spark, d):
    """A strategy for every user turn."""
    return load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", P.route(F.col("text")).alias("strategy"))


ROUTE_SQL = r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\b(tenant|department|created|language)\b') THEN 'metadata' WHEN regexp_matches(text, '(?i)\b(and then|compare|relationship|between)\b') THEN 'multi_hop' WHEN len(regexp_split_to_array(trim(text), '\s+')) <= 2 OR regexp_matches(text, '[0-9_]') THEN 'keyword' ELSE 'hybrid' END AS strategy FROM conversations WHERE role = 'user'"


def memory_ttl(spark, d):
    """The latest event of each user and type that is at most ten days older than the last of all."""
    events = load(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "value", "ts")
    last = events.agg(F.max("ts").alias("now"))
    return P.memory(events, F.lit(last.first()["now"]), 10).select("key", "value")


MEMORY_SQL = "WITH l AS (SELECT user_id::VARCHAR || '/' || event_type AS key, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) AS k FROM events) SELECT key, value FROM l WHERE k = 1 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY"


def revenue_by_nation(spark, d):
    """A star join as a relational check: revenue by nation and year."""
    orders, lines, customers, nations = (load(spark, d, t) for t in ("orders", "lineitem", "customer", "nation"))
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


REVENUE_SQL = "SELECT n_name, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"

QUERIES = {
    "multi_hop": (multi_hop, HOP_SQL),
    "corrective_route": (corrective_route, CORRECTIVE_SQL),
    "coarse_to_fine": (coarse_to_fine, COARSE_SQL),
    "conversation_window": (conversation_window, CONVERSATION_SQL),
    "graph_khop": (graph_khop, GRAPH_SQL),
    "entity_resolution": (entity_resolution, ENTITY_SQL),
    "adaptive_route": (adaptive_route, ROUTE_SQL),
    "memory_ttl": (memory_ttl, MEMORY_SQL),
    "revenue_by_nation": (revenue_by_nation, REVENUE_SQL),
}
