"""What the registered queries share: the fixed questions, token columns and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import service_tokens
from tessera.operators.lexical import token_rows
from tessera.operators.search import ranked
from tessera.tables import load

#: The stated question set of the text queries.
QUESTIONS = {1: "that tion the than", 2: "chch ente der und", 3: "que de la con", 4: "on on thand ere", 5: "how to reset password"}
VALUES = ", ".join(f"({k}, '{v}')" for k, v in QUESTIONS.items())

SERVICE = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\w\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1)"


def questions(spark: SparkSession) -> DataFrame:
    """(query_id, query)."""
    return spark.sql(f"select cast(query_id as bigint) query_id, query from values {VALUES} as v(query_id, query)")


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, pos, term) of documents, each a chunk."""
    return token_rows(load(spark, sf_dir, "documents"), "doc_id", service_tokens(F.col("text")))


def question_terms(spark: SparkSession) -> DataFrame:
    """(query_id, term), repeats kept."""
    return questions(spark).select("query_id", F.explode(service_tokens(F.col("query"))).alias("term"))


def top(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Rounded first, so that ranks don't hang on the last bits."""
    return ranked(scored.withColumn("score", F.round("score", digits)), k).withColumn("rank", F.col("rank").cast("long"))


Q_SQL = f"q AS (SELECT query_id::BIGINT AS query_id, query FROM (VALUES {VALUES}) v(query_id, query))"
TOK_SQL = f"tok AS (SELECT doc_id AS chunk_id, unnest({SERVICE.format('text')}) AS term FROM documents)"


def index_sql(unique: bool = False) -> str:
    """CTEs up to `m`: every question term in every document that holds it."""
    return f"""{Q_SQL}, {TOK_SQL},
qt AS (SELECT query_id, term, {'1' if unique else 'count(*)'} AS qtf FROM (SELECT query_id, unnest({SERVICE.format('query')}) AS term FROM q) GROUP BY query_id, term),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY chunk_id, term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), dl AS (SELECT chunk_id, count(*) AS dl FROM tok GROUP BY chunk_id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
m AS (SELECT query_id, term, chunk_id, qtf, tf, df, dl, n, avgdl FROM tf JOIN dfs USING (term) JOIN qt USING (term) JOIN dl USING (chunk_id), st)"""


def bm25_sql(k1: float = 1.5, b: float = 0.75, floor: float | None = None) -> str:
    """A contribution over m."""
    idf = "ln((n - df + 0.5) / (df + 0.5) + 1)"
    return f"qtf * {idf if floor is None else f'greatest({floor}, {idf})'} * (tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * dl / avgdl)))"


def rank_sql(source: str, k: int, digits: int = 6) -> str:
    """The best k of source (query_id, chunk_id, score) with score rounded and rank."""
    return f"SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(score, {digits}) AS score FROM ({source}))) WHERE rank <= {k}"


#: Hashed FNV embeddings of a table t(id, text) as e(id, idx, w); p prefixes the names.
def fnv_sql(p: str, source: str, dim: int = 1536) -> str:
    h = lambda w: f"list_reduce(list_transform(string_split({w}, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT)"
    sign = lambda x: f"CASE WHEN {x} % 2 = 0 THEN 1.0 ELSE -1.0 END"
    return f"""{p}w AS (SELECT id, word, count(*) AS k FROM (SELECT id, unnest(list_filter(regexp_split_to_array(trim(lower(text)), '\\W+'), lambda w: w <> '')) AS word FROM ({source})) GROUP BY id, word),
{p}v AS (SELECT DISTINCT word FROM {p}w),
{p}f AS (SELECT word, {h('word')} AS h, 1.0 AS u FROM {p}v UNION ALL SELECT word, {h('g')}, 0.5 FROM (SELECT word, unnest(list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3))) AS g FROM {p}v)),
{p}x AS (SELECT word, h % {dim} AS idx, sum(u * {sign('h')}) AS w FROM {p}f GROUP BY word, idx),
{p}s AS (SELECT id, idx, sum(k * w) AS w FROM {p}w JOIN {p}x USING (word) GROUP BY id, idx HAVING sum(k * w) <> 0),
{p}e AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {p}s)"""
