"""Fusion, reranking, expansion, parents and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.embeddings import embed, fnv_scheme, sparse_cosine
from tessera.functions.text import service_tokens
from tessera.operators import answers, chunking, evaluate, expand, fusion, parents, rerank
from tessera.operators.lexical import Bm25, bm25, token_rows
from tessera.operators.search import ranked
from tessera.plans.common import Q_SQL, SERVICE, bm25_sql, doc_tokens, fnv_sql, index_sql, question_terms, questions, rank_sql, top
from tessera.tables import load

POOL = 20


def sparse_hits(spark: SparkSession, d: str, k: int = POOL, options: Bm25 = Bm25(unique_terms=False)) -> DataFrame:
    return top(bm25(doc_tokens(spark, d), question_terms(spark), options), k)


def dense_scores(spark, d, asked: DataFrame) -> DataFrame:
    docs = embed(load(spark, d, "documents"), "doc_id", "text", fnv_scheme()).withColumnRenamed("doc_id", "chunk_id")
    return sparse_cosine(docs, embed(asked, "query_id", "query", fnv_scheme()))


def dense_hits(spark, d, k: int = POOL) -> DataFrame:
    return top(dense_scores(spark, d, questions(spark)), k)


def both(spark, d, k: int = POOL, scored: DataFrame | None = None) -> DataFrame:
    """Dense and sparse hits as one table with their source; scored: dense scores that are used elsewhere too, so that the corpus is embedded once."""
    dense = dense_hits(spark, d, k) if scored is None else top(scored, k)
    return dense.withColumn("source", F.lit("dense")).unionByName(sparse_hits(spark, d, k).withColumn("source", F.lit("sparse")))


SPARSE_SQL = f"sraw AS (SELECT query_id, chunk_id, sum({bm25_sql()}) AS score FROM m GROUP BY 1, 2)"
DENSE_SQL = f"{fnv_sql('d', 'SELECT doc_id AS id, text FROM documents')}, {fnv_sql('z', 'SELECT query_id AS id, query AS text FROM q')}, draw AS (SELECT ze.id AS query_id, de.id AS chunk_id, sum(de.w * ze.w) AS score FROM de JOIN ze USING (idx) GROUP BY 1, 2)"
HITS_SQL = f"{index_sql()}, {SPARSE_SQL}, {DENSE_SQL}, sparse AS ({rank_sql('SELECT * FROM sraw', POOL)}), dense AS ({rank_sql('SELECT * FROM draw', POOL)}), hits AS (SELECT *, 'dense' AS source FROM dense UNION ALL SELECT *, 'sparse' FROM sparse)"


def final(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def rrf_hybrid(spark, d):
    """The flagship: BM25 and hashed dense search, fused by reciprocal ranks."""
    return final(fusion.rrf(both(spark, d), 60, top=10))


def fused_sql(score: str, k: int = 10, digits: int = 9) -> str:
    return f"WITH {HITS_SQL}, f AS (SELECT query_id, chunk_id, {score} AS score FROM hits GROUP BY 1, 2) {rank_sql('SELECT * FROM f', k, digits)}"


def weighted_rrf(spark, d):
    return final(fusion.weighted_rrf(both(spark, d), 0.7, top=10))


def alpha_rrf(spark, d):
    return final(fusion.alpha_rrf(both(spark, d), 0.3, top=10))


def weighted_score(spark, d):
    return final(fusion.weighted_scores(both(spark, d), 0.6, "minmax", top=10))


def norm(method: str):
    def query(spark, d):
        return fusion.normalized(both(spark, d), method).select("query_id", "source", "chunk_id", F.round("norm", 6).alias("norm"))

    return query


NORM_SQL = {
    "minmax": "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END",
    "zscore": "1 / (1 + exp(-CASE WHEN stddev_pop(score) OVER w = 0 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END))",
    "softmax": "exp(score - max(score) OVER w) / (sum(exp(score)) OVER w / exp(max(score) OVER w))",
}


def norm_sql(method: str) -> str:
    return f"WITH {HITS_SQL} SELECT query_id, source, chunk_id, round({NORM_SQL[method]}, 6) AS norm FROM hits WINDOW w AS (PARTITION BY query_id, source)"


def fusion_explain(spark, d):
    return fusion.explained(both(spark, d)).select("query_id", "chunk_id", "score", "dense_rank", "sparse_rank", "text")


EXPLAIN_SQL = f"WITH {HITS_SQL}, r AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 9) AS score, max(rank) FILTER (source = 'dense') AS dense_rank, max(rank) FILTER (source = 'sparse') AS sparse_rank FROM hits GROUP BY 1, 2) SELECT *, coalesce('dense rank ' || dense_rank || ': 1/(60+' || dense_rank || ')', 'dense: none') || '; ' || coalesce('sparse rank ' || sparse_rank || ': 1/(60+' || sparse_rank || ')', 'sparse: none') AS text FROM r"


def multisource_merge(strategy: str):
    def query(spark, d):
        hits = both(spark, d).withColumn("source", F.when(F.col("source") == "dense", F.lit("direct_vector")).otherwise(F.lit("bm25")))
        return fusion.merge_sources(hits, strategy, digits=9).select("query_id", "chunk_id", "score", "occurrences", F.array_join("methods", ",").alias("methods"))

    return query


def multisource_sql(value: str) -> str:
    return f"WITH {HITS_SQL}, h AS (SELECT query_id, chunk_id, score, rank, CASE source WHEN 'dense' THEN 'direct_vector' ELSE 'bm25' END AS source FROM hits) SELECT query_id, chunk_id, round({value}, 9) AS score, count(*) AS occurrences, string_agg(DISTINCT source, ',' ORDER BY source) AS methods FROM h GROUP BY 1, 2"


def asked_variations(spark) -> DataFrame:
    return expand.variations(questions(spark).select(F.col("query_id").alias("question_id"), F.col("query").alias("text")), 3)


def query_variations(spark, d):
    """The variations themselves; they hang on the stated questions alone."""
    return asked_variations(spark).select("question_id", "query_id", "text")


def variation_hits(spark, d, k: int = POOL) -> DataFrame:
    asked = asked_variations(spark)
    terms = asked.select("query_id", F.explode(service_tokens(F.col("text"))).alias("term"))
    return top(bm25(doc_tokens(spark, d), terms), k).join(F.broadcast(asked.select("question_id", "query_id")), "query_id")  # a few rows a question


def multiquery_merge(strategy: str):
    def query(spark, d):
        merged = fusion.merge_queries(variation_hits(spark, d), strategy)
        return merged.select("question_id", "chunk_id", "occurrences", F.round("max_score", 6).alias("max_score"), F.round("avg_score", 9).alias("avg_score"), F.round("rrf_score", 6).alias("rrf_score"), F.array_join("queries", ",").alias("queries"))

    return query


LONG = r"list_filter(regexp_split_to_array(query, '\s+'), lambda w: length(w) > 3)"
VARIATION_SQL = rf"""r AS (SELECT query_id AS question_id, query, list_filter([CASE WHEN s <> query THEN s END,
  CASE WHEN contains(lower(query), 'how can i') OR contains(lower(query), 'how do i') OR contains(lower(query), 'how to') THEN regexp_replace(query, 'how (can|do|should) (i|we|users)', 'Best practices and steps for', 'i') ELSE 'Implementation details and guide for ' || query END,
  'Architectural design and workflow of ' || regexp_replace(query, '[?.]', '', 'g'),
  CASE WHEN len({LONG}) >= 2 THEN 'Configuration and management of ' || array_to_string(list_slice({LONG}, 1, 3), ' ') END], lambda x: x IS NOT NULL) AS made
  FROM (SELECT *, regexp_replace(query, 'password reset', 'credential recovery account security', 'gi') AS s FROM q)),
pad AS (SELECT question_id, query, list_slice(list_concat(made, list_transform(range(len(made) + 1, len(made) + 5), lambda i: query || ' technical specification overview ' || i)), 1, 3) AS made FROM r),
va AS (SELECT question_id, unnest(list_concat([query], made)) AS text, unnest(range(0, 4)) AS ordinal FROM pad),
asked AS (SELECT question_id, question_id || '_' || CASE ordinal WHEN 0 THEN 'q_0_original' ELSE 'q_' || ordinal END AS query_id, text FROM (SELECT *, row_number() OVER (PARTITION BY question_id, lower(text) ORDER BY ordinal) AS n FROM va) WHERE n = 1)"""


def multi_sql() -> str:
    tokens = index_sql().split("qt AS")[0].rstrip().rstrip(",").split(", tok AS", 1)
    rest = index_sql(True).split("tf AS", 1)[1]
    return f"""WITH {tokens[0]}, {VARIATION_SQL}, tok AS{tokens[1]},
qt AS (SELECT query_id, term, 1 AS qtf FROM (SELECT query_id, unnest({SERVICE.format('text')}) AS term FROM asked) GROUP BY query_id, term),
tf AS{rest}, raw AS (SELECT query_id, chunk_id, sum({bm25_sql()}) AS score FROM m GROUP BY 1, 2), hits AS ({rank_sql('SELECT * FROM raw', POOL)})
SELECT question_id, chunk_id, count(*) AS occurrences, max(score) AS max_score, round(avg(score), 9) AS avg_score, round(sum(1 / (60 + rank)), 6) AS rrf_score, string_agg(query_id, ',' ORDER BY query_id) AS queries FROM hits JOIN asked USING (query_id) GROUP BY 1, 2"""


def gain_sql() -> str:
    head = multi_sql().rsplit("SELECT question_id, chunk_id, count(*)", 1)[0].replace(f"WHERE rank <= {POOL}", "WHERE rank <= 10")
    return head + """, rr AS (SELECT question_id AS query_id, query_id AS v, chunk_id FROM hits JOIN asked USING (query_id)), one AS (SELECT DISTINCT query_id, chunk_id FROM rr WHERE ends_with(v, 'q_0_original')), many AS (SELECT DISTINCT query_id, chunk_id FROM rr),
c AS (SELECT query_id, count(*) AS n_merged, count(*) FILTER (NOT EXISTS (SELECT 1 FROM one WHERE one.query_id = many.query_id AND one.chunk_id = many.chunk_id)) AS n_new FROM many GROUP BY 1), o AS (SELECT query_id, count(*) AS n_single FROM one GROUP BY 1), h AS (SELECT query_id, count(*) AS n_hits FROM rr GROUP BY 1)
SELECT query_id, coalesce(n_single, 0) AS n_single, n_merged, n_new, round(coalesce(n_new * 100.0 / nullif(n_single, 0), 0), 6) AS recall_gain, round(1 - n_merged / n_hits, 6) AS dedup_ratio FROM c LEFT JOIN o USING (query_id) LEFT JOIN h USING (query_id)"""


def hyde_search(spark, d):
    """Hypothetical passages and the questions themselves against the documents, by hashed embeddings and by terms, merged."""
    q = questions(spark)
    passages = expand.hypothetical(q.select(F.col("query_id").alias("question_id"), F.col("query").alias("text")), 2)
    ids = passages.select("query_id", "question_id")
    dense = top(dense_scores(spark, d, passages.select("query_id", F.col("text").alias("query"))), 10).join(F.broadcast(ids), "query_id").select(F.col("question_id").alias("query_id"), "chunk_id", "score", "rank").withColumn("source", F.lit("hyde_vector"))
    direct = dense_hits(spark, d, 10).withColumn("source", F.lit("direct_vector"))
    lexical = sparse_hits(spark, d, 10).withColumn("source", F.lit("bm25"))
    return fusion.merge_sources(dense.unionByName(direct).unionByName(lexical), "rrf").where("rank <= 10").select("query_id", "chunk_id", "score", "occurrences")


def passages(spark, d):
    return expand.hypothetical(questions(spark).select(F.col("query_id").alias("question_id"), F.col("query").alias("text")), 2).select("question_id", "query_id", "text")


def candidates(spark, d) -> DataFrame:
    """Fused candidates with question, text, title (the first line) and cosine."""
    scored = dense_scores(spark, d, questions(spark))
    fused = fusion.rrf(both(spark, d, scored=scored), 60, top=15)
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.split("text", "\n")[0].alias("title"))
    cosine = scored.select("query_id", "chunk_id", F.round("score", 9).alias("cosine"))
    return fused.join(F.broadcast(questions(spark)), "query_id").join(texts, "chunk_id").join(cosine, ["query_id", "chunk_id"], "left").fillna(0.0, ["cosine"])


CAND_SQL = f"""{HITS_SQL}, fr AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 9) AS score, count(*) AS occurrences FROM hits GROUP BY 1, 2),
fk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fr),
cand AS (SELECT fk.query_id, fk.chunk_id, fk.score, fk.occurrences, fk.rank, q.query, d.text AS content, string_split(d.text, chr(10))[1] AS title, coalesce(round(x.score, 9), 0) AS cosine FROM fk JOIN q USING (query_id) JOIN documents d ON d.doc_id = fk.chunk_id LEFT JOIN draw x ON x.query_id = fk.query_id AND x.chunk_id = fk.chunk_id WHERE fk.rank <= 15)"""


def share_sql(tokens: str) -> str:
    return f"len(list_filter({tokens}, lambda w: contains(lower(content || ' ' || title), w))) / len({tokens})"


def service3(column: str) -> str:
    return SERVICE.format(column).replace("length(w) > 1", "length(w) > 2")


def reranked_sql(value: str, k: int, digits: int) -> str:
    return f"WITH {CAND_SQL}, r AS (SELECT query_id, chunk_id, {value} AS score FROM cand) {rank_sql('SELECT * FROM r', k, digits)}"


WORD3 = r"list_filter(regexp_split_to_array(lower(query), '\W+'), lambda w: length(w) > 2)"
TERMS = r"list_filter(regexp_split_to_array(trim(lower(query)), '\s+'), lambda w: length(w) > 1)"
CROSS_SQL = rf"""WITH {CAND_SQL}, t AS (SELECT *, lower(title) AS lt, lower(content) AS lc, {TERMS} AS terms FROM cand),
u AS (SELECT *, list_filter(terms, lambda w: contains(lt || ' ' || lc, w)) AS found FROM t),
v AS (SELECT *, list_sort(list_filter(list_transform(found, lambda w: instr(lc, w)), lambda p: p > 0)) AS pl FROM u),
g AS (SELECT *, CASE WHEN len(pl) >= 2 THEN list_min(list_transform(range(1, len(pl)), lambda i: pl[i + 1] - pl[i])) END AS gap, list_filter(terms, lambda w: list_contains({list(rerank.INTENTS)}, w)) AS wanted FROM v),
r AS (SELECT query_id, chunk_id, least(0.99, greatest(0.05, round(len(found) / len(terms) * 0.4 + CASE WHEN contains(lc, trim(lower(query))) THEN 0.45 ELSE 0 END + CASE WHEN contains(lt, trim(lower(query))) THEN 0.25 ELSE 0 END
  + len(list_filter(terms, lambda w: contains(lt, w))) * 0.1 / len(terms) + CASE WHEN len(found) >= 2 AND gap < 50 THEN 0.2 WHEN len(found) >= 2 AND gap < 150 THEN 0.1 ELSE 0 END
  + CASE WHEN len(wanted) > 0 AND len(list_filter(wanted, lambda w: contains(lt || ' ' || lc, w))) = len(wanted) THEN 0.15 ELSE 0 END, 3))) AS score FROM g)
{rank_sql('SELECT * FROM r', 15)}"""


def rerank_local(spark, d):
    return final(rerank.rerank_cross(candidates(spark, d)))


def rerank_multiplicative(spark, d):
    return final(rerank.rerank_multiplicative(candidates(spark, d), 5).withColumn("score", F.round("score", 6)))


def rerank_additive(spark, d):
    return final(rerank.rerank_additive(candidates(spark, d), 5))


def two(spark, d) -> DataFrame:
    first = candidates(spark, d).select("query_id", "query", "chunk_id", "score", "rank")
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.split("text", "\n")[0].alias("title"))
    return rerank.two_stage(first, texts, 5)


def two_stage(spark, d):
    return two(spark, d).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), F.col("first_rank").cast("long").alias("first_rank"), F.col("rank_delta").cast("long").alias("rank_delta"), "top_changed")


TWO_SQL = CROSS_SQL.rsplit("SELECT query_id, chunk_id, score, rank FROM", 1)[0] + ", k AS (SELECT r.query_id, r.chunk_id, r.score, cand.rank AS first_rank, row_number() OVER (PARTITION BY r.query_id ORDER BY r.score DESC, r.chunk_id) AS rank FROM r JOIN cand USING (query_id, chunk_id)), w AS (SELECT *, first_rank - rank AS rank_delta, bool_or(rank = 1 AND first_rank <> 1) OVER (PARTITION BY query_id) AS top_changed FROM k) SELECT query_id, chunk_id, score, rank, first_rank, rank_delta, top_changed FROM w WHERE rank <= 5"


def rank_swap_rate(spark, d):
    return evaluate.swap_rate(two(spark, d))


SWAP_SQL = TWO_SQL.rsplit("SELECT query_id, chunk_id, score, rank, first_rank", 1)[0] + "SELECT count(*) AS queries, sum(c)::BIGINT AS changed, round(avg(c), 6) AS swap_rate, round(avg(s), 6) AS mean_shift FROM (SELECT query_id, max(top_changed::INT) AS c, avg(abs(rank_delta)) AS s FROM w WHERE rank <= 5 GROUP BY query_id)"


def hierarchy(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents, children, the questions' best children): children by BM25 with k1 1.2."""
    parent, child = chunking.parent_child(load(spark, d, "documents"))
    tokens = token_rows(child, "child_id", service_tokens(F.col("content")))
    hits = top(bm25(tokens, question_terms(spark), Bm25(k1=1.2, unique_terms=False)), 30)
    return parent, child, hits.withColumn("parent_id", F.regexp_replace("chunk_id", "::child_.*$", ""))


def parent_resolve(spark, d):
    parent, _, hits = hierarchy(spark, d)
    return parents.resolve(hits, parent).select("query_id", "parent_id", "best_score", "aggregate_score", "rank_score", "n_children", "rank")


def parent_budget(spark, d):
    parent, _, hits = hierarchy(spark, d)
    return parents.within_budget(parents.resolve(hits, parent), 4, 1200)


def parent_completeness(spark, d):
    parent, child, hits = hierarchy(spark, d)
    return parents.completeness(hits, parents.resolve(hits, parent), child)


def child_merge(spark, d):
    """Children by dense and lexical search, merged by true ranks and reranked."""
    _, child, hits = hierarchy(spark, d)
    sparse = embed(child, "child_id", "content", fnv_scheme()).withColumnRenamed("child_id", "chunk_id")
    cosine = sparse_cosine(sparse, embed(questions(spark), "query_id", "query", fnv_scheme()))
    dense = top(cosine, 30).withColumn("source", F.lit("child_dense"))
    merged = fusion.merge_sources(dense.unionByName(hits.drop("parent_id").withColumn("source", F.lit("child_bm25"))), "rrf", fusion.CHILD_WEIGHTS).drop("rank")
    full = merged.join(F.broadcast(questions(spark)), "query_id").join(child.select(F.col("child_id").alias("chunk_id"), "content", F.lit("").alias("title")), "chunk_id").join(cosine.select("query_id", "chunk_id", F.col("score").alias("cosine")), ["query_id", "chunk_id"], "left").fillna(0.0, ["cosine"])
    return final(rerank.rerank_children(full, 8))


def benchmark_hits(spark, d, k: int = 10) -> DataFrame:
    terms = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(service_tokens(F.col("text"))).alias("term"))
    return top(bm25(doc_tokens(spark, d), terms), k)


def judged(spark, d) -> DataFrame:
    """(query_id, chunk_id) of items and documents that share five-word runs enough to hold the item.

    Documents keep the hashes of those runs that an item has: a semi-join against the items' hashes comes before anything is shuffled. Equal hashes only propose
    pairs; their runs are then compared word by word.
    """
    words = lambda table, key: load(spark, d, table).select(key, service_tokens(F.col("text")).alias("w"))
    items, docs = words("benchmark", "item_id"), words("documents", "doc_id")
    hashes = lambda df, key: df.select(key, F.explode(run_hashes("w")).alias("h"))
    asked = hashes(items, "item_id").distinct()
    enough = lambda met, of: met.join(of.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "item_id").where("10 * k >= 8 * n").select("item_id", "doc_id")
    found = hashes(docs, "doc_id").join(asked.select("h").distinct(), "h", "left_semi").distinct().join(asked, "h").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    # runs that fall together in a hash lower the number an item needs and raise what a document has, so no pair is lost
    pairs = enough(found, asked)
    run = lambda df, *keys: df.select(*keys, F.explode(F.array_distinct(runs("w"))).alias("run"))
    known = run(items, "item_id")
    exact = run(docs.join(pairs, "doc_id"), "item_id", "doc_id").join(known, ["item_id", "run"]).groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return enough(exact, known).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))


def run_hashes(words, size: int = 5):
    """A 64-bit hash of every run of size words."""
    n = F.greatest(F.size(words) - (size - 1), F.lit(0))
    single = F.transform(words, lambda w: F.xxhash64(w))
    rolled = F.slice(single, F.lit(1), n)
    for k in range(2, size + 1):
        rolled = F.zip_with(rolled, F.slice(single, F.lit(k), n), lambda a, b: F.xxhash64(a, b))
    return rolled


def runs(words, size: int = 5):
    """Every run of size words, by shifted copies of the list; the list isn't built anew for each run."""
    n = F.greatest(F.size(words) - (size - 1), F.lit(0))
    shifted = F.slice(words, F.lit(1), n)
    for k in range(2, size + 1):
        shifted = F.zip_with(shifted, F.slice(words, F.lit(k), n), lambda a, b: F.concat_ws(" ", a, b))
    return shifted


JUDGED_SQL = rf"""bi AS (SELECT item_id, {SERVICE.format('text')} AS w FROM benchmark), dw AS (SELECT doc_id, {SERVICE.format('text')} AS w FROM documents),
br AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 4), ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM bi)),
dr AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM dw)),
bn AS (SELECT item_id, count(*) AS n FROM br GROUP BY 1),
rel AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM (SELECT item_id, doc_id, count(*) AS k FROM dr JOIN br USING (run) GROUP BY 1, 2) JOIN bn USING (item_id) WHERE 10 * k >= 8 * n)"""
BENCH_HITS_SQL = f"{index_sql(True).replace('FROM q)', 'FROM (SELECT item_id AS query_id, text AS query FROM benchmark))')}, raw AS (SELECT query_id, chunk_id, sum({bm25_sql()}) AS score FROM m GROUP BY 1, 2), found AS ({rank_sql('SELECT * FROM raw', 10)})"


def recall_at_k(spark, d):
    return evaluate.recall(benchmark_hits(spark, d), judged(spark, d)).withColumn("recall", F.round("recall", 6))


def mrr_ndcg(spark, d):
    q = evaluate.ranking_quality(benchmark_hits(spark, d), judged(spark, d), 10)
    return q.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "reciprocal_rank", "ndcg")))


def rank_correlation(spark, d):
    out = evaluate.agreement(dense_hits(spark, d), sparse_hits(spark, d))
    return out.select("query_id", "common", *(F.round(c, 6).alias(c) for c in ("jaccard", "kendall_tau", "spearman_rho")))


CORRELATION_SQL = f"""WITH {HITS_SQL}, j AS (SELECT query_id, chunk_id, a.rank AS ra, b.rank AS rb FROM dense a FULL JOIN sparse b USING (query_id, chunk_id)),
c AS (SELECT * FROM j WHERE ra IS NOT NULL AND rb IS NOT NULL),
p AS (SELECT x.query_id, sum(sign((x.ra - y.ra) * (x.rb - y.rb))) AS s FROM c x JOIN c y ON x.query_id = y.query_id AND x.chunk_id < y.chunk_id GROUP BY 1),
n AS (SELECT query_id, count(*) AS u, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS common, coalesce(sum((ra - rb) * (ra - rb)), 0) AS d2 FROM j GROUP BY 1)
SELECT query_id, common, round(common / u, 6) AS jaccard, round(CASE WHEN common < 2 THEN 0 ELSE coalesce(s, 0) / (common * (common - 1) / 2) END, 6) AS kendall_tau, round(CASE WHEN common < 2 THEN 0 ELSE 1 - 6 * d2 / (common * (common * common - 1)) END, 6) AS spearman_rho FROM n LEFT JOIN p USING (query_id)"""


def overlap_pct(spark, d):
    """How much of the fused top ten each side had in its own."""
    fused = fusion.rrf(both(spark, d), 60, top=10)
    return evaluate.overlap_percent(sparse_hits(spark, d, 10), fused, 10)


OVERLAP_SQL = f"WITH {HITS_SQL}, f AS (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS score FROM hits GROUP BY 1, 2), fk AS ({rank_sql('SELECT * FROM f', 10, 9)}), s AS (SELECT query_id, chunk_id FROM sparse WHERE rank <= 10) SELECT s.query_id, count(fk.chunk_id) * 100.0 / 10 AS overlap FROM s LEFT JOIN fk USING (query_id, chunk_id) GROUP BY 1"


def recall_gain(spark, d):
    hits = variation_hits(spark, d, 10)
    retrieved = hits.select(F.col("question_id").alias("query_id"), "chunk_id")
    single = hits.where(F.col("query_id").endswith("q_0_original")).select(F.col("question_id").alias("query_id"), "chunk_id")
    return evaluate.gain(single, retrieved, retrieved)


def context_answers(spark, d):
    """Contexts and template answers from the first three fused hits."""
    hits = candidates(spark, d).where("rank <= 3").withColumn("source", F.col("title"))
    made = answers.context(hits).join(answers.template_answers(questions(spark), hits).withColumnRenamed("answer", "said"), "query_id").join(answers.grounded(hits), "query_id", "left")
    return made.select("query_id", "n", F.length("context").cast("long").alias("context_chars"), F.md5(F.col("context").cast("binary")).alias("context_md5"), "said", F.array_join("cited", ",").alias("cited"), F.round("confidence", 6).alias("confidence"))


QUERIES = {
    "rrf_hybrid": (rrf_hybrid, fused_sql("sum(1 / (60 + rank))")),
    "weighted_rrf": (weighted_rrf, fused_sql("sum(CASE source WHEN 'dense' THEN 1.4 ELSE 0.6 END / (60 + rank))")),
    "alpha_rrf": (alpha_rrf, fused_sql("sum(CASE source WHEN 'dense' THEN 0.3 ELSE 0.7 END / (60 + rank))")),
    "weighted_score": (weighted_score, f"WITH {HITS_SQL}, n AS (SELECT query_id, source, chunk_id, {NORM_SQL['minmax']} AS norm FROM hits WINDOW w AS (PARTITION BY query_id, source)), f AS (SELECT query_id, chunk_id, 0.6 * coalesce(max(norm) FILTER (source = 'dense'), 0) + 0.4 * coalesce(max(norm) FILTER (source = 'sparse'), 0) AS score FROM n GROUP BY 1, 2) {rank_sql('SELECT * FROM f', 10, 9)}"),
    **{f"norm_{m}": (norm(m), norm_sql(m)) for m in NORM_SQL},
    "fusion_explain": (fusion_explain, EXPLAIN_SQL),
    "multisource_merge": (multisource_merge("rrf"), multisource_sql("sum(1 / (60 + rank))")),
    "multisource_weighted": (multisource_merge("score_weighted"), multisource_sql("avg(score * CASE source WHEN 'direct_vector' THEN 0.8 ELSE 0.6 END)")),
    "multisource_max": (multisource_merge("max_score"), multisource_sql("max(score)")),
    "query_variations": (query_variations, f"WITH {Q_SQL}, {VARIATION_SQL} SELECT question_id, query_id, text FROM asked"),
    "multiquery_merge": (multiquery_merge("rrf"), multi_sql()),
    "hyde_passages": (passages, None),
    "hyde_search": (hyde_search, None),
    "rerank_local": (rerank_local, CROSS_SQL),
    "rerank_multiplicative": (rerank_multiplicative, reranked_sql(f"round((cosine * 0.5 + score * 0.3 + {share_sql(WORD3)} * 0.2) * (1 + (occurrences - 1) * 0.15), 9)", 5, 6)),
    "rerank_additive": (rerank_additive, reranked_sql(f"round(cosine * 0.55 + {share_sql(service3('query'))} * 0.25 + score * 0.1 + least(0.25, (occurrences - 1) * 0.1), 4)", 5, 4)),
    "two_stage": (two_stage, TWO_SQL),
    "rank_swap_rate": (rank_swap_rate, SWAP_SQL),
    "parent_resolve": (parent_resolve, None),
    "parent_budget": (parent_budget, None),
    "parent_completeness": (parent_completeness, None),
    "child_merge": (child_merge, None),
    "recall_at_k": (recall_at_k, f"WITH {BENCH_HITS_SQL}, {JUDGED_SQL} SELECT rel.query_id, count(found.chunk_id) AS hits, count(*) AS wanted, round(count(found.chunk_id) / count(*), 6) AS recall FROM rel LEFT JOIN found USING (query_id, chunk_id) GROUP BY 1"),
    "mrr_ndcg": (mrr_ndcg, f"WITH {BENCH_HITS_SQL}, {JUDGED_SQL}, i AS (SELECT query_id, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda k: 1 / log2(k + 1))) AS idcg FROM rel GROUP BY 1), g AS (SELECT query_id, count(*) AS n, min(rank) AS f, sum(1 / log2(rank + 1)) AS dcg FROM found JOIN rel USING (query_id, chunk_id) GROUP BY 1) SELECT query_id, round(coalesce(n, 0) / 10, 6) AS precision, round(coalesce(1 / f, 0), 6) AS reciprocal_rank, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM i LEFT JOIN g USING (query_id)"),
    "rank_correlation": (rank_correlation, CORRELATION_SQL),
    "overlap_pct": (overlap_pct, OVERLAP_SQL),
    "recall_gain": (recall_gain, gain_sql()),
    "context_answers": (context_answers, None),
}
