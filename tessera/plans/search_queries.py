"""Lexical search, vector search and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.embeddings import embed, fnv_scheme, sparse_cosine
from tessera.functions.vectors import manhattan
from tessera.operators import lexical as L
from tessera.operators import search as S
from tessera.operators.filters import Guard, Principal, compile_filter, distinct_values, parse, secured
from tessera.plans.common import Q_SQL, TOK_SQL, bm25_sql, doc_tokens, fnv_sql, index_sql, question_terms, questions, rank_sql, top
from tessera.tables import load


def postings_tf_df(spark: SparkSession, d: str) -> DataFrame:
    """Terms with their document and collection frequencies and the checksum of their postings."""
    p = L.postings(doc_tokens(spark, d))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"), F.sum(F.element_at("positions", 1)).cast("long").alias("first_positions"), F.max("chunk_id").alias("last_chunk"))


def index_stats(spark, d):
    return L.index_stats(doc_tokens(spark, d), load(spark, d, "documents"), "doc_id").withColumn("avgdl", F.round("avgdl", 6))


def vocab_topk(spark, d):
    """The 100 commonest terms."""
    return L.term_stats(doc_tokens(spark, d)).orderBy(F.desc("ctf"), "term").limit(100)


def index_remove(spark, d):
    """Statistics after the labelled documents left the index."""
    gone = load(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))
    return L.index_stats(L.remove_chunks(doc_tokens(spark, d), gone)).withColumn("avgdl", F.round("avgdl", 6))


def idf_variants(spark, d):
    n = L.lengths(doc_tokens(spark, d)).agg(F.count(F.lit(1)).alias("n"))
    stats = L.term_stats(doc_tokens(spark, d)).crossJoin(F.broadcast(n))  # one row
    a, b = F.col("n"), F.col("df")
    return stats.select("term", F.round(L.bm25_idf(a, b), 6).alias("bm25"), F.round(L.bm25_idf(a, b, 0.25), 6).alias("floored"), F.round(L.smooth_idf(a, b), 6).alias("smooth"), F.round(L.plain_idf(a, b), 6).alias("plain"), F.round(L.probabilistic_idf(a, b), 6).alias("probabilistic"))


def bm25_variant(options: L.Bm25, k: int = 20):
    return lambda spark, d: top(L.bm25(doc_tokens(spark, d), question_terms(spark), options), k)


def tfidf_topk(spark, d):
    return top(L.tfidf(doc_tokens(spark, d), question_terms(spark)), 20)


def tfidf_raw(spark, d):
    return top(L.tfidf(doc_tokens(spark, d), question_terms(spark), smooth=False, sublinear=False), 20)


def bm25_explain(spark, d):
    parts = L.bm25_explain(doc_tokens(spark, d), question_terms(spark), L.Bm25(unique_terms=True))
    return parts.select("query_id", "chunk_id", "term", "tf", "df", F.round("idf", 6).alias("idf"), "dl", F.round("contribution", 6).alias("contribution"))


def keyword_search(spark, d):
    """Question terms against English documents only."""
    meta = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    found = L.keyword_search(doc_tokens(spark, d), question_terms(spark), meta, compile_filter({"lang": "en"}, meta.schema), L.Bm25(idf_floor=0.25), 10)
    return found.select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"), F.round("tfidf", 6).alias("tfidf"))


def phrase_search(spark, d):
    asked = spark.sql("select query_id, at, term from values (1L, 0, 'of'), (1L, 1, 'the'), (2L, 0, 'on'), (2L, 1, 'the'), (3L, 0, 'de'), (3L, 1, 'la') as v(query_id, at, term)")
    return L.phrases(doc_tokens(spark, d), asked).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("first_pos"))


PHRASE_SQL = f"""WITH {TOK_SQL.replace('AS term FROM documents', 'AS term FROM documents')},
l AS (SELECT doc_id AS chunk_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1) AS ws FROM documents),
p AS (SELECT chunk_id, unnest(range(1, len(ws))) AS k, ws FROM l),
h AS (SELECT chunk_id, k, ws[k] AS a, ws[k + 1] AS b FROM p),
f AS (SELECT CASE WHEN a = 'of' AND b = 'the' THEN 1 WHEN a = 'on' AND b = 'the' THEN 2 WHEN a = 'de' AND b = 'la' THEN 3 END AS query_id, chunk_id, k - 1 AS pos FROM h)
SELECT query_id::BIGINT AS query_id, chunk_id, count(*) AS n, min(pos)::BIGINT AS first_pos FROM f WHERE query_id IS NOT NULL GROUP BY 1, 2"""


def bm25_query_sql(unique: bool, k: int = 20, **options) -> str:
    return f"WITH {index_sql(unique)}, s AS (SELECT query_id, chunk_id, sum({bm25_sql(**options)}) AS score FROM m GROUP BY 1, 2) {rank_sql('SELECT * FROM s', k)}"


def vectors(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark, d):
    """The stated query set: every vector whose id is divisible by 50, against all vectors."""
    return load(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def vector_topk(metric: str, mode: str = "raw", k: int = 10):
    def query(spark, d):
        hits = S.top_k(vectors(spark, d), vector_queries(spark, d), k, metric, mode, digits=6)
        return hits.select("query_id", "chunk_id", "score", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))

    return query


# A metric's similarity and distance in SQL, over a and b.
METRIC_SQL = {
    ("cosine", "raw"): ("greatest(-1, least(1, list_cosine_similarity(a, b)))", "1 - list_cosine_similarity(a, b)"),
    ("cosine", "unit"): ("(list_cosine_similarity(a, b) + 1) / 2", "1 - list_cosine_similarity(a, b)"),
    ("dot", "raw"): ("list_dot_product(a, b)", "-list_dot_product(a, b)"),
    ("dot", "unit"): ("1 / (1 + exp(-list_dot_product(a, b)))", "-list_dot_product(a, b)"),
    ("euclidean", "raw"): ("1 / (1 + list_distance(a, b))", "list_distance(a, b)"),
    ("manhattan", "raw"): ("1 / (1 + list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))))", "list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i])))"),
}
V_SQL = "v AS (SELECT vec_id, embedding::DOUBLE[] AS a, label FROM embeddings), vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id % 50 = 0)"


def vector_sql(metric: str, mode: str = "raw", k: int = 10, where: str = "true") -> str:
    s, t = METRIC_SQL[metric, mode]
    return f"WITH {V_SQL}, s AS (SELECT query_id, vec_id AS chunk_id, round(round({s}, 9), 6) AS score, round(round({t}, 9), 6) AS distance FROM v, vq WHERE {where}) SELECT query_id, chunk_id, score, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= {k}"


def prefilter_topk(spark, d):
    table = vectors(spark, d)
    pred = compile_filter(parse('{"label": {"$in": [1, 3, 5]}}'), table.schema)
    hits = S.top_k(table, vector_queries(spark, d), 10, predicate=pred, digits=6)
    return hits.select("query_id", "chunk_id", "score", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def postfilter_topk(spark, d):
    table = vectors(spark, d)
    return S.post_filtered(table, vector_queries(spark, d), 5, 20, F.col("label").isin(1, 3, 5)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def filter_waste(spark, d):
    return S.filter_comparison(vectors(spark, d), vector_queries(spark, d), 5, 20, F.col("label").isin(1, 3, 5))


def score_threshold(spark, d):
    return S.at_least(S.top_k(vectors(spark, d), vector_queries(spark, d), 10), 0.2).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def ivf(spark, d):
    table = vectors(spark, d).select("chunk_id", "embedding")
    centroids, held = S.ivf_train(table, 4, 2)
    return table, S.ivf_search(table, centroids, held, vector_queries(spark, d), 10, 2)


def ivf_topk(spark, d):
    return ivf(spark, d)[1].select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def ivf_recall(spark, d):
    from tessera.operators.evaluate import recall

    table, found = ivf(spark, d)
    return recall(found, S.top_k(table, vector_queries(spark, d), 10)).withColumn("recall", F.round("recall", 6))


#: The tuned lists: on these vectors, which hardly cluster, half of them must be read for nine tenths of the exact neighbours.
TUNED_LISTS, TUNED_PROBES = 32, 20


def ivf_tuned_recall(spark, d):
    """Recall of normalised lists after ten rounds, every vector indexed; the test wants 0.9 on average."""
    from tessera.operators.evaluate import recall

    table = vectors(spark, d).select("chunk_id", "embedding")
    centroids, held = S.ivf_train(table, TUNED_LISTS, 10, normalized=True)
    found = S.ivf_search(table, centroids, held, vector_queries(spark, d), 10, TUNED_PROBES)
    return recall(found, S.top_k(table, vector_queries(spark, d), 10)).withColumn("recall", F.round("recall", 6))


def stage_one_topk(spark, d):
    """The first stage over vectors of which those labelled 9 are missing."""
    table = vectors(spark, d).withColumn("embedding", F.when(F.col("label") != 9, F.col("embedding")))
    return S.stage_one(table, vector_queries(spark, d), 40).withColumn("rank", F.col("rank").cast("long"))


def candidate_sweep(spark, d):
    """Cosine candidates, reranked by Manhattan distance, for four sizes of the pool."""
    from tessera.operators.evaluate import candidate_sweep as sweep

    hits = S.top_k(vectors(spark, d), vector_queries(spark, d), 50).select("query_id", "chunk_id", "rank")
    both = hits.join(vectors(spark, d).select("chunk_id", "embedding"), "chunk_id").join(vector_queries(spark, d), "query_id")
    return sweep(both.where("chunk_id <> query_id").withColumn("second", F.round(-manhattan(F.col("embedding"), F.col("q")), 9)).drop("embedding", "q"), [5, 10, 20, 50])


def proximity_search(spark, d):
    asked = spark.sql("select query_id, a, b from values (1L, 'of', 'the'), (2L, 'de', 'la'), (3L, 'on', 'that') as v(query_id, a, b)")
    return L.proximity(doc_tokens(spark, d), asked, 4)


def distinct_access(spark, d):
    return distinct_values(meta(spark, d), "tenant_id", "department")


def graph_recall(spark, d):
    """Recall of the graph index against the exact lists, every vector indexed."""
    from tessera.operators.evaluate import recall

    table = vectors(spark, d)
    return recall(S.graph_search(table, vector_queries(spark, d), 10), S.top_k(table, vector_queries(spark, d), 10))


COS = "round(list_cosine_similarity({0}, {1}), 9)"
IVF_SQL = f"""WITH {V_SQL},
c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS l, a AS c FROM (SELECT * FROM v ORDER BY vec_id LIMIT 4)),
a0 AS (SELECT vec_id, arg_max(l, round(list_cosine_similarity(a, c), 9) - l * 1e-12) AS l FROM v, c0 GROUP BY vec_id),
c1 AS (SELECT l, list(m ORDER BY d) AS c FROM (SELECT l, d, avg(a[d]) AS m FROM v JOIN a0 USING (vec_id), (SELECT unnest(range(1, 65)) AS d) GROUP BY l, d) GROUP BY l),
a1 AS (SELECT vec_id, arg_max(l, round(list_cosine_similarity(a, c), 9) - l * 1e-12) AS l FROM v, c1 GROUP BY vec_id),
c2 AS (SELECT l, list(m ORDER BY d) AS c FROM (SELECT l, d, avg(a[d]) AS m FROM v JOIN a1 USING (vec_id), (SELECT unnest(range(1, 65)) AS d) GROUP BY l, d) GROUP BY l),
p AS (SELECT query_id, b, l FROM (SELECT query_id, b, l, row_number() OVER (PARTITION BY query_id ORDER BY {COS.format('c', 'b')} DESC, l) AS k FROM vq, c2) WHERE k <= 2),
s AS (SELECT query_id, vec_id AS chunk_id, {COS.format('a', 'b')} AS score FROM v JOIN a1 USING (vec_id) JOIN p USING (l))
SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM s) WHERE k <= 10"""


IVF_RECALL_SQL = IVF_SQL.rsplit("SELECT query_id, chunk_id, round(score, 6)", 1)[0].rstrip() + f""",
i AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM s) WHERE k <= 10),
t AS (SELECT query_id, chunk_id FROM (SELECT query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY {COS.format('a', 'b')} DESC, vec_id) AS k FROM v, vq) WHERE k <= 10)
SELECT t.query_id, count(i.chunk_id) AS hits, count(*) AS wanted, round(count(i.chunk_id) / count(*), 6) AS recall FROM t LEFT JOIN i USING (query_id, chunk_id) GROUP BY 1"""


def embed_text_cosine(spark, d):
    """Documents by hashed embeddings against the questions."""
    vectors_ = embed(load(spark, d, "documents"), "doc_id", "text", fnv_scheme()).withColumnRenamed("doc_id", "chunk_id")
    return top(sparse_cosine(vectors_, embed(questions(spark), "query_id", "query", fnv_scheme())), 20)


TEXT_COSINE_SQL = f"WITH {Q_SQL}, {fnv_sql('d', 'SELECT doc_id AS id, text FROM documents')}, {fnv_sql('q', 'SELECT query_id AS id, query AS text FROM q')}, s AS (SELECT qe.id AS query_id, de.id AS chunk_id, sum(de.w * qe.w) AS score FROM de JOIN qe USING (idx) GROUP BY 1, 2) {rank_sql('SELECT * FROM s', 20)}"


def meta(spark, d):
    """Documents with access metadata from labels: a tenant and a department, level by quality, some missing."""
    t = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    return t.select("doc_id", "n_chars", "lang", F.col("source").alias("tenant_id"), F.when(F.col("quality").isNotNull(), F.col("lang")).alias("department"), F.coalesce("quality", F.lit(2)).cast("int").alias("access_level"), (F.col("toxic") == 0).alias("is_public"), F.split("source", "c").alias("tags"))


META_SQL = "meta AS (SELECT doc_id, n_chars, lang, source AS tenant_id, CASE WHEN quality IS NOT NULL THEN lang END AS department, coalesce(quality, 2)::INT AS access_level, toxic = 0 AS is_public, string_split(source, 'c') AS tags FROM documents LEFT JOIN labels USING (doc_id))"

FILTERS = {
    "eq": ({"lang": "de"}, "lang = 'de'"),
    "ne_missing": ({"department": {"$ne": "en"}}, "department IS DISTINCT FROM 'en'"),
    "range": ({"n_chars": {"$gte": 500, "$lt": 2000}}, "n_chars >= 500 AND n_chars < 2000"),
    "in_list": ({"lang": {"$in": ["fr", "es"]}}, "lang IN ('fr', 'es')"),
    "nin_missing": ({"department": {"$nin": ["fr", "es"]}}, "department IS NULL OR department NOT IN ('fr', 'es')"),
    "contains": ({"tenant_id": {"$contains": "RC1"}}, "contains(lower(tenant_id), 'rc1')"),
    "not": ({"$not": {"is_public": True}}, "NOT coalesce(is_public, false)"),
    "wrong_type": ({"n_chars": {"$gt": "500"}}, "false"),
    "empty_or": ({"$or": []}, "false"),
}


def filter_ops(spark, d):
    """Rows that pass each operator's filter."""
    t = meta(spark, d)
    return t.agg(*(F.sum(compile_filter(f, t.schema).cast("long")).alias(n) for n, (f, _) in FILTERS.items()))


def filter_nested(spark, d):
    t = meta(spark, d)
    tree = {"$and": [{"$or": [{"lang": "en"}, {"lang": "de", "n_chars": {"$gt": 1000}}]}, {"$not": {"tenant_id": {"$in": ["src0", "src1"]}}}]}
    return t.where(compile_filter(tree, t.schema)).select("doc_id", "lang", "n_chars")


def filter_array_overlap(spark, d):
    t = meta(spark, d)
    return t.where(compile_filter({"tags": {"$in": ["1", "2"]}}, t.schema)).select("doc_id")


def secure_search(spark, d):
    """What a principal may see of the hits for the questions."""
    who = Principal("src0", 0, ("en", "de"))
    allowed = secured(meta(spark, d), who, {"n_chars": {"$gt": 100}, "tenant_id": "src1"}, Guard()).select(F.col("doc_id").alias("chunk_id"))
    scored = L.bm25(doc_tokens(spark, d), question_terms(spark), L.Bm25(unique_terms=False)).join(allowed, "chunk_id", "left_semi")
    return top(scored, 5)


SECURE_SQL = f"WITH {index_sql()}, {META_SQL}, s AS (SELECT query_id, chunk_id, sum({bm25_sql()}) AS score FROM m GROUP BY 1, 2), ok AS (SELECT doc_id FROM meta WHERE tenant_id = 'src0' AND (coalesce(is_public, false) OR access_level <= 0) AND (coalesce(is_public, false) OR department IN ('en', 'de') OR department IS NULL) AND n_chars > 100) {rank_sql('SELECT * FROM s WHERE chunk_id IN (SELECT doc_id FROM ok)', 5)}"

SWEEP_SQL = f"""WITH {V_SQL},
s AS (SELECT query_id, vec_id AS chunk_id, {COS.format('a', 'b')} AS score, round(-list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))), 9) AS second FROM v, vq),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s),
n AS (SELECT unnest([5, 10, 20, 50]) AS candidate_n),
x AS (SELECT candidate_n, query_id, chunk_id, row_number() OVER (PARTITION BY candidate_n, query_id ORDER BY rank) AS k1, row_number() OVER (PARTITION BY candidate_n, query_id ORDER BY second DESC, rank) AS k2 FROM t, n WHERE rank <= candidate_n AND chunk_id <> query_id),
y AS (SELECT candidate_n, query_id, max(CASE WHEN k1 = 1 AND k2 <> 1 THEN 1 ELSE 0 END) AS moved FROM x GROUP BY 1, 2)
SELECT candidate_n, count(*) AS queries, sum(moved)::BIGINT AS shifted, round(avg(moved), 2) AS shift_rate FROM y GROUP BY 1"""

PROXIMITY_SQL = f"""WITH l AS (SELECT doc_id AS chunk_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1) AS ws FROM documents),
p AS (SELECT chunk_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM l),
q AS (SELECT query_id, term FROM (VALUES (1, 'of'), (1, 'the'), (2, 'de'), (2, 'la'), (3, 'on'), (3, 'that')) v(query_id, term)),
g AS (SELECT query_id, chunk_id, term, lag(term) OVER w AS before, pos - lag(pos) OVER w AS gap FROM p JOIN q USING (term) WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY pos))
SELECT query_id::BIGINT AS query_id, chunk_id, count(*) AS n, min(gap)::BIGINT AS least FROM g WHERE term <> before AND gap <= 4 GROUP BY 1, 2"""

QUERIES = {
    "stage_one_topk": (stage_one_topk, f"WITH {V_SQL}, s AS (SELECT query_id, vec_id AS chunk_id, CASE WHEN label = 9 THEN 0 ELSE {COS.format('a', 'b')} END AS score FROM v, vq) SELECT query_id, chunk_id, round(score, 3) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 40"),
    "candidate_sweep": (candidate_sweep, SWEEP_SQL),
    "proximity_search": (proximity_search, PROXIMITY_SQL),
    "distinct_access": (distinct_access, f"WITH {META_SQL} SELECT 'tenant_id' AS field, tenant_id AS value, count(*) AS rows FROM meta WHERE tenant_id IS NOT NULL GROUP BY ALL UNION ALL SELECT 'department', department, count(*) FROM meta WHERE department IS NOT NULL GROUP BY ALL"),
    "ivf_tuned_recall": (ivf_tuned_recall, None),
    "postings_tf_df": (postings_tf_df, f"WITH l AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1) AS ws FROM documents)), p AS (SELECT term, doc_id, count(*) AS tf, min(pos) AS f FROM l GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf, sum(f)::BIGINT AS first_positions, max(doc_id) AS last_chunk FROM p GROUP BY term"),
    "index_stats": (index_stats, f"WITH {TOK_SQL} SELECT (SELECT count(*) FROM documents) AS n, count(*) AS total_tokens, count(DISTINCT term) AS vocabulary, round(count(*) / (SELECT count(*) FROM documents), 6) AS avgdl FROM tok"),
    "vocab_topk": (vocab_topk, f"WITH {TOK_SQL} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS ctf FROM tok GROUP BY term ORDER BY ctf DESC, term LIMIT 100"),
    "index_remove": (index_remove, f"WITH {TOK_SQL}, t AS (SELECT * FROM tok WHERE chunk_id NOT IN (SELECT doc_id FROM labels)) SELECT count(DISTINCT chunk_id) AS n, count(*) AS total_tokens, count(DISTINCT term) AS vocabulary, round(count(*) / count(DISTINCT chunk_id), 6) AS avgdl FROM t"),
    "idf_variants": (idf_variants, f"WITH {TOK_SQL}, x AS (SELECT term, count(DISTINCT chunk_id) AS df, (SELECT count(DISTINCT chunk_id) FROM tok) AS n FROM tok GROUP BY term) SELECT term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS bm25, round(greatest(0.25, ln((n - df + 0.5) / (df + 0.5) + 1)), 6) AS floored, round(ln((n + 1) / (df + 1)) + 1, 6) AS smooth, round(ln(n / df), 6) AS plain, round(CASE WHEN n <= df THEN 0 ELSE ln((n - df) / df) END, 6) AS probabilistic FROM x"),
    "bm25_topk": (bm25_variant(L.Bm25(idf_floor=0.25)), bm25_query_sql(True, floor=0.25)),
    "bm25_dup_terms": (bm25_variant(L.Bm25(unique_terms=False)), bm25_query_sql(False)),
    "bm25_service": (bm25_variant(L.Bm25(k1=1.2, unique_terms=False)), bm25_query_sql(False, k1=1.2)),
    "tfidf_topk": (tfidf_topk, f"WITH {index_sql(True)}, s AS (SELECT query_id, chunk_id, sum((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1)) AS score FROM m GROUP BY 1, 2) {rank_sql('SELECT * FROM s', 20)}"),
    "tfidf_raw": (tfidf_raw, f"WITH {index_sql(True)}, s AS (SELECT query_id, chunk_id, sum(tf * ln(n / df)) AS score FROM m GROUP BY 1, 2) {rank_sql('SELECT * FROM s', 20)}"),
    "bm25_explain": (bm25_explain, f"WITH {index_sql(True)} SELECT query_id, chunk_id, term, tf, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf, dl, round({bm25_sql()}, 6) AS contribution FROM m"),
    "keyword_search": (keyword_search, f"WITH {index_sql(True)}, s AS (SELECT query_id, chunk_id, sum({bm25_sql(floor=0.25)}) AS bm25, sum((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1)) AS tfidf FROM m WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY 1, 2) SELECT query_id, chunk_id, round(bm25, 6) AS bm25, round(tfidf, 6) AS tfidf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS k FROM s) WHERE k <= 10"),
    "phrase_search": (phrase_search, PHRASE_SQL),
    "cosine_topk": (vector_topk("cosine"), vector_sql("cosine")),
    "dot_topk": (vector_topk("dot"), vector_sql("dot")),
    "euclid_topk": (vector_topk("euclidean"), vector_sql("euclidean")),
    "manhattan_topk": (vector_topk("manhattan"), vector_sql("manhattan")),
    "cosine_unit": (vector_topk("cosine", "unit"), vector_sql("cosine", "unit")),
    "dot_unit": (vector_topk("dot", "unit"), vector_sql("dot", "unit")),
    "prefilter_topk": (prefilter_topk, vector_sql("cosine", where="label IN (1, 3, 5)")),
    "postfilter_topk": (postfilter_topk, f"WITH {V_SQL}, s AS (SELECT query_id, vec_id AS chunk_id, label, {COS.format('a', 'b')} AS score FROM v, vq), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM s), u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS j FROM t WHERE k <= 20 AND label IN (1, 3, 5)) SELECT query_id, chunk_id, round(score, 6) AS score FROM u WHERE j <= 5"),
    "filter_waste": (filter_waste, f"WITH {V_SQL}, s AS (SELECT query_id, vec_id AS chunk_id, label, {COS.format('a', 'b')} AS score FROM v, vq), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM s), u AS (SELECT query_id, least(5, count(*) FILTER (label IN (1, 3, 5))) AS pre_rows, least(5, count(*) FILTER (k <= 20 AND label IN (1, 3, 5))) AS post_rows FROM t GROUP BY query_id) SELECT query_id, pre_rows, post_rows, post_rows < pre_rows AS starved, round((20 - post_rows) / 20, 2) AS waste FROM u"),
    "score_threshold": (score_threshold, f"WITH {V_SQL}, s AS (SELECT query_id, vec_id AS chunk_id, {COS.format('a', 'b')} AS score FROM v, vq), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM s) SELECT query_id, chunk_id, round(score, 6) AS score FROM t WHERE k <= 10 AND score >= 0.2"),
    "ivf_topk": (ivf_topk, IVF_SQL),
    "ivf_recall": (ivf_recall, IVF_RECALL_SQL),
    "graph_recall": (graph_recall, None),
    "embed_text_cosine": (embed_text_cosine, TEXT_COSINE_SQL),
    "filter_ops": (filter_ops, f"WITH {META_SQL} SELECT {', '.join(f'count(*) FILTER ({w}) AS {n}' for n, (_, w) in FILTERS.items())} FROM meta"),
    "filter_nested": (filter_nested, f"WITH {META_SQL} SELECT doc_id, lang, n_chars FROM meta WHERE (lang = 'en' OR (lang = 'de' AND n_chars > 1000)) AND NOT tenant_id IN ('src0', 'src1')"),
    "filter_array_overlap": (filter_array_overlap, f"WITH {META_SQL} SELECT doc_id FROM meta WHERE list_has_any(tags, ['1', '2'])"),
    "secure_search": (secure_search, SECURE_SQL),
}
