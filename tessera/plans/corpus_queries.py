"""Queries over the corpus itself: statistics, tokens, chunks, embeddings, ingest."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import embeddings as E
from tessera.functions import text as X
from tessera.operators import chunking as C
from tessera.operators.patterns import contextual
from tessera.plans.common import SERVICE, fnv_sql
from tessera.sources.loaders import snippets, upsert
from tessera.streaming.ingest import latest, window_counts
from tessera.tables import load


def docs(spark, d):
    return load(spark, d, "documents")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.max("n_chars").alias("longest"))


def corpus_rollup(spark, d):
    return docs(spark, d).rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def snippet_scan(spark, d):
    return snippets(docs(spark, d), "doc_id", "text")


def counted(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("distinct_terms"), F.sum("start_off").alias("starts"), F.sum("end_off").alias("ends"), F.max("pos").cast("long").alias("last_pos"))


def tok_standard(spark, d):
    return counted(X.tokenize(docs(spark, d), "doc_id", "text", "standard"))


def tok_technical(spark, d):
    return counted(X.tokenize(docs(spark, d), "doc_id", "text", "technical"))


def tok_simple(spark, d):
    return counted(X.tokenize(docs(spark, d), "doc_id", "text", "simple"))


def listed(spark, d, tokens) -> DataFrame:
    return docs(spark, d).select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("distinct_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


def tok_service(spark, d):
    return listed(spark, d, X.service_tokens)


def tok_compact(spark, d):
    return listed(spark, d, X.compact_tokens)


def listed_sql(tokens: str) -> str:
    return f"SELECT doc_id, count(*) AS n, count(DISTINCT term) AS distinct_terms, min(term) AS first_term, max(term) AS last_term FROM (SELECT doc_id, unnest({tokens}) AS term FROM documents) GROUP BY doc_id"


def offsets_sql(pattern: str) -> str:
    return rf"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS w, regexp_split_to_array(text, '{pattern}') AS g FROM documents),
r AS (SELECT doc_id, k, w[k] AS term, length(w[k]) AS lw, length(g[k]) AS lg FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM a)),
o AS (SELECT *, sum(lw + lg) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM r)
SELECT doc_id, count(*) AS n, count(DISTINCT lower(term)) AS distinct_terms, sum(e - lw)::BIGINT AS starts, sum(e)::BIGINT AS ends, (count(*) - 1)::BIGINT AS last_pos FROM o GROUP BY doc_id"""


def tok_analyzed(spark, d):
    """Standard analysis: stop words gone, the rest stemmed."""
    return counted(X.analyze(docs(spark, d), "doc_id", "text", "standard"))


def stem_vocab(spark, d):
    vocabulary = docs(spark, d).select(F.explode(X.standard_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return X.with_stems(vocabulary.withColumn("stem", F.col("term")), "stem")


def chunked(method: str, **options):
    def query(spark, d):
        return C.chunk(docs(spark, d), method, **options).select("chunk_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("n_chars"), "token_estimate", F.md5(F.col("content").cast("binary")).alias("content_md5"))

    query.__name__ = f"chunk_{method}"
    return query


def parent_child(spark, d):
    parents, children = C.parent_child(docs(spark, d))
    per = children.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"), F.sum("token_estimate").alias("child_tokens"))
    return parents.select("parent_id", "doc_id", "parent_index", "token_estimate").join(per, "parent_id")


def chunk_stats(spark, d):
    """Word windows by language: how many, their estimated tokens, and the longest."""
    table = docs(spark, d)
    made = C.chunk(table, "word_window").join(table.select("doc_id", "lang"), "doc_id")
    return made.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("token_estimate").alias("tokens"), F.max("token_estimate").cast("long").alias("most"))


def contextual_chunks(spark, d):
    table = docs(spark, d)
    chunks = C.chunk(table, "sentence_window", size=1500, overlap=200)
    return contextual(chunks, table, ["lang", "source"]).select("chunk_id", F.length("contextual").cast("long").alias("n_chars"), F.md5(F.col("contextual").cast("binary")).alias("content_md5"))


def embedded(name: str):
    def query(spark, d):
        sparse = E.embed(docs(spark, d), "doc_id", "text", E.SCHEMES[name]())
        return sparse.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dims"), F.round(F.sum("w"), 6).alias("total"), F.round(F.max("w"), 6).alias("largest"), F.round(F.sum(F.col("w") * F.col("idx")), 4).alias("moment"))

    query.__name__ = f"embed_{name}"
    return query


def embed_sql(body: str) -> str:
    return f"{body} SELECT id AS doc_id, count(*) AS dims, round(sum(w), 6) AS total, round(max(w), 6) AS largest, round(sum(w * idx), 4) AS moment FROM e GROUP BY id"


HASH31 = "list_reduce(list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT), lambda h, c: ((h * 31 + c + 2147483648) & 4294967295) - 2147483648, 0::BIGINT)"
TOKEN_SQL = embed_sql(rf"""WITH w AS (SELECT doc_id AS id, word, count(*) AS k FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda w: w <> '')) AS word FROM documents) GROUP BY ALL),
x AS (SELECT word, abs({HASH31.format('word')}) % 64 AS idx FROM (SELECT DISTINCT word FROM w)),
s AS (SELECT id, idx, sum(k) AS w FROM w JOIN x USING (word) GROUP BY id, idx),
none AS (SELECT doc_id AS id, 0 AS idx, 1.0 AS w FROM documents WHERE doc_id NOT IN (SELECT id FROM w)),
e AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM s UNION ALL SELECT * FROM none)""")
NEIGHBOUR_SQL = embed_sql(rf"""WITH w AS (SELECT doc_id AS id, word, count(*) AS k FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\w\s]', '', 'g'), '\s+'), lambda w: w <> '')) AS word FROM documents) GROUP BY ALL),
h AS (SELECT word, abs({HASH31.format('word')}) % 1536 AS i FROM (SELECT DISTINCT word FROM w)),
x AS (SELECT word, i AS idx, 1.0 AS u FROM h UNION ALL SELECT word, (i + 137) % 1536, 0.5 FROM h),
s AS (SELECT id, idx, sum(k * u) AS w FROM w JOIN x USING (word) GROUP BY id, idx),
e AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM s)""")
HASH33 = "list_reduce(list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT), lambda h, c: ((xor(h * 33, c) + 2147483648) & 4294967295) - 2147483648, 5381::BIGINT)"
SIGNED_SQL = embed_sql(rf"""WITH w AS (SELECT doc_id AS id, word, count(*) AS k FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda w: w <> '')) AS word FROM documents) GROUP BY ALL),
v AS (SELECT DISTINCT word FROM w),
f AS (SELECT word, {HASH33.format('word')} AS h, 2.0 AS u FROM v UNION ALL SELECT word, {HASH33.format('g')}, 0.5 FROM (SELECT word, unnest(list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3))) AS g FROM v)),
x AS (SELECT word, abs(h) % 128 AS idx, sum(CASE WHEN h % 2 = 0 THEN u ELSE -u END) AS u FROM f GROUP BY 1, 2),
s AS (SELECT id, idx, sum(k * u) AS w FROM w JOIN x USING (word) GROUP BY id, idx HAVING sum(k * u) <> 0),
e AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM s)""")
MULTIPLIED = "list_reduce(list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (h * {1} + c) & 4294967295, 0::BIGINT)"
BIGRAM_SQL = embed_sql(rf"""WITH l AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(trim(lower(text)), '\W+'), lambda w: w <> '') AS ws FROM documents),
a AS (SELECT id, unnest(ws) AS t FROM l), b AS (SELECT id, ws[k] || '_' || ws[k + 1] AS t FROM (SELECT id, ws, unnest(range(1, len(ws))) AS k FROM l)),
x AS (SELECT t, {MULTIPLIED.format('t', 31)} % 64 AS idx, 1.0 + (length(t) % 5) * 0.1 AS u FROM (SELECT DISTINCT t FROM a)), y AS (SELECT t, {MULTIPLIED.format('t', 17)} % 64 AS idx, 0.5 AS u FROM (SELECT DISTINCT t FROM b)),
s AS (SELECT id, idx, sum(u) AS w FROM (SELECT id, idx, u FROM a JOIN x USING (t) UNION ALL SELECT id, idx, u FROM b JOIN y USING (t)) GROUP BY id, idx),
e AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM s UNION ALL SELECT id, 0, 1.0 FROM l WHERE len(ws) = 0)""")
FNV_SQL = embed_sql(f"WITH {fnv_sql('', 'SELECT doc_id AS id, text FROM documents')}")


def event_windows(spark, d):
    return window_counts(load(spark, d, "events")).withColumn("total", F.round("total", 4))


def memory_latest(spark, d):
    facts = load(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "value", "ts", "event_id")
    return latest(facts, "key", "ts").select("key", "value", "event_id")


def upsert_documents(spark, d):
    """Documents with the rows of labels' documents written anew."""
    table = docs(spark, d).select("doc_id", "text", "lang")
    fresh = table.join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("text", F.concat(F.lit("new "), "text"))
    return upsert(table, fresh).select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def stream_upsert(spark, d):
    """Documents through a stream into a sink in the shared folder; what it holds at the end."""
    from tessera.streaming.ingest import ingest, stream_documents, upserted

    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tessera-stream-")
    root = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    path = f"{d}/documents.parquet"
    query = ingest(stream_documents(spark, path if "://" in path or os.path.isdir(path) else f"{d}/documents.parque[t]", docs(spark, d).schema), lambda b: b.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars")), f"{root}/sink", f"{root}/checkpoint")
    query.awaitTermination()
    return upserted(spark, f"{root}/sink", "doc_id")


def last_at(separator: str, floor: str) -> str:
    """0-based place of the last separator of text beyond floor that begins at e or before; null without one."""
    size = len(separator)
    sep = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in separator)
    seg = f"substr(text, ({floor}) + 2, e - ({floor}) + {size - 1})"
    return f"CASE WHEN contains({seg}, {sep}) THEN ({floor}) + length({seg}) - strpos(reverse({seg}), reverse({sep})) - {size - 2} END"


def windows_sql(cut: str, follow: str, cleaned: str = "text", whole: bool = False) -> str:
    """CTEs up to c (doc_id, chunk_index, content): windows by recursion. cut: a window's end by its start s, its farthest end e and the text's length n;
    follow: the next start by s, stop and the last start that gave a chunk; whole: texts that fit stay as they are."""
    strip = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
    one = f"SELECT doc_id, text, n, s, last, CASE WHEN e >= n THEN n ELSE {cut} END AS stop FROM (SELECT *, least(s + 500, n) AS e FROM {{0}})"
    step = f"(SELECT doc_id, text, n, {follow} AS s, last FROM (SELECT doc_id, text, n, s, stop, CASE WHEN {strip.format('substr(text, s + 1, stop - s)')} <> '' THEN s ELSE last END AS last FROM w WHERE stop < n))"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {cleaned} AS text, length({cleaned}) AS n FROM documents WHERE {strip.format("coalesce(text, '')")} <> ''),
w AS ({one.format(f"(SELECT doc_id, text, n, 0::BIGINT AS s, -1::BIGINT AS last FROM d{' WHERE n > 500' if whole else ''})")} UNION ALL {one.format(step)}),
p AS (SELECT doc_id, s, {strip.format('substr(text, s + 1, stop - s)')} AS content FROM w{' UNION ALL SELECT doc_id, 0, text FROM d WHERE n <= 500' if whole else ''}),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, content FROM p WHERE content <> '')"""


CHUNK_SELECT = " SELECT doc_id || '_chunk_' || chunk_index AS chunk_id, doc_id, chunk_index, length(content) AS n_chars, ceil(length(content) / 4)::INT AS token_estimate, md5(content) AS content_md5 FROM c"
WORD_WINDOWS = windows_sql(f"coalesce({last_at(' ', 's')}, e)", "greatest(stop - 50, s + 1)", whole=True)
BACKED, BEYOND = "greatest(s, e - 150)", "s + 50"
CHUNK_SQL = {
    "window": windows_sql(f"coalesce({', '.join(f'{last_at(x, BACKED)} + {len(x)}' for x in (chr(10) * 2, chr(10), '. ', ' '))}, e)", "greatest(stop - 50, last + 1)") + CHUNK_SELECT,
    "window_any": windows_sql(f"coalesce({', '.join(f'{last_at(x, BEYOND)} + {len(x)}' for x in (chr(10) * 2, chr(10), ' '))}, e)", "CASE WHEN stop - 50 > s THEN stop - 50 ELSE stop END") + CHUNK_SELECT,
    "word_window": WORD_WINDOWS + CHUNK_SELECT,
    "sentence_window": windows_sql(f"coalesce({last_at('. ', 's + 250')} + 1, {last_at(' ', 's')}, e)", "greatest(stop - 50, s + 1)", r"trim(regexp_replace(text, '\s+', ' ', 'g'))") + CHUNK_SELECT,
}

SIMPLE_SQL = r"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w, regexp_split_to_array(text, '\S+') AS g FROM documents),
r AS (SELECT doc_id, k, w[k] AS term, length(w[k]) AS lw, length(g[k]) AS lg FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM a)),
o AS (SELECT *, sum(lw + lg) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM r),
c AS (SELECT doc_id, regexp_replace(term, '^\W+|\W+$', '', 'g') AS core, e - length(regexp_replace(term, '^\W+', '')) AS s FROM o)
SELECT doc_id, count(*) AS n, count(DISTINCT lower(core)) AS distinct_terms, sum(s)::BIGINT AS starts, sum(s + length(core))::BIGINT AS ends, (count(*) - 1)::BIGINT AS last_pos FROM c WHERE core <> '' GROUP BY doc_id"""
TECHNICAL_SQL = rf"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '{X.TECHNICAL}') AS w, regexp_split_to_array(text, '{X.TECHNICAL}') AS g FROM documents),
r AS (SELECT doc_id, k, w[k] AS term, length(w[k]) AS lw, length(g[k]) AS lg FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM a)),
o AS (SELECT *, sum(lw + lg) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM r),
p AS (SELECT *, string_split(regexp_replace(term, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' ') AS camel, list_filter(regexp_split_to_array(term, '[-_./:]+'), lambda x: x <> '') AS parts FROM o),
t AS (SELECT doc_id, e, lw, unnest(list_concat([term], CASE WHEN len(camel) > 1 THEN list_filter(camel, lambda x: x <> '' AND lower(x) <> lower(term)) ELSE [] END, CASE WHEN len(parts) > 1 THEN list_filter(parts, lambda x: lower(x) <> lower(term)) ELSE [] END)) AS term FROM p)
SELECT doc_id, count(*) AS n, count(DISTINCT lower(term)) AS distinct_terms, sum(e - lw)::BIGINT AS starts, sum(e)::BIGINT AS ends, (count(*) - 1)::BIGINT AS last_pos FROM t GROUP BY doc_id"""
CHAR_SQL = embed_sql(r"""WITH w AS (SELECT doc_id AS id, word, count(*) AS k FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\w\s]', '', 'g'), '\s+'), lambda w: w <> '')) AS word FROM documents) GROUP BY ALL),
v AS (SELECT word, list_transform(string_split(word, ''), lambda c: unicode(c)::BIGINT) AS c FROM (SELECT DISTINCT word FROM w)),
f AS (SELECT word, (c[i] * 31 + (i - 1) * 17) % 128 AS idx, 1 / log2(len(c) + 2) AS u FROM (SELECT word, c, unnest(range(1, len(c) + 1)) AS i FROM v) UNION ALL SELECT word, (c[i] * 101 + c[i + 1] * 37) % 128, 0.5 FROM (SELECT word, c, unnest(range(1, len(c))) AS i FROM v)),
x AS (SELECT word, idx, sum(u) AS u FROM f GROUP BY 1, 2),
a AS (SELECT id, idx, k * u AS w FROM w JOIN x USING (word) UNION ALL SELECT doc_id, (length(text) * 13) % 128, 0.25 FROM documents),
s AS (SELECT id, idx, sum(w) AS w FROM a GROUP BY 1, 2), e AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM s)""")


QUERIES = {
    "corpus_stats": (corpus_stats, "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS mean_chars, max(n_chars) AS longest FROM documents GROUP BY lang"),
    "corpus_rollup": (corpus_rollup, "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)"),
    "snippet_scan": (snippet_scan, "SELECT doc_id, substr(text, 1, 100) AS snippet, length(text) AS n_chars FROM documents"),
    "tok_standard": (tok_standard, offsets_sql("[a-zA-Z0-9]+")),
    "tok_technical": (tok_technical, TECHNICAL_SQL),
    "tok_simple": (tok_simple, SIMPLE_SQL),
    "tok_service": (tok_service, listed_sql(SERVICE.format("text"))),
    "tok_compact": (tok_compact, listed_sql(f"list_filter(list_transform(regexp_extract_all(text, '{X.COMPACT}'), lambda w: lower(w)), lambda w: regexp_matches(w, '[0-9_-]') OR NOT list_contains({list(X.COMPACT_STOP_WORDS)}, w))")),
    "tok_analyzed": (tok_analyzed, None),
    "stem_vocab": (stem_vocab, None),
    **{f"chunk_{m}": (chunked(m, **o), CHUNK_SQL.get(m)) for m, o in (("window", {}), ("window_any", {}), ("token_window", {}), ("separated", {}), ("recursive", {}), ("recursive_flat", {}), ("word_window", {}), ("sentence_window", {"size": 500, "overlap": 50}))},
    "parent_child": (parent_child, None),
    "chunk_stats": (chunk_stats, WORD_WINDOWS + " SELECT lang, count(*) AS n, sum(ceil(length(content) / 4))::BIGINT AS tokens, max(ceil(length(content) / 4))::BIGINT AS most FROM c JOIN documents USING (doc_id) GROUP BY lang"),
    "contextual_chunks": (contextual_chunks, None),
    "embed_token": (embedded("token"), TOKEN_SQL),
    "embed_signed": (embedded("signed"), SIGNED_SQL),
    "embed_bigram": (embedded("bigram"), BIGRAM_SQL),
    "embed_neighbour": (embedded("neighbour"), NEIGHBOUR_SQL),
    "embed_char": (embedded("char"), CHAR_SQL),
    "embed_fnv": (embedded("fnv"), FNV_SQL),
    "event_windows": (event_windows, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "memory_latest": (memory_latest, "SELECT key, value, event_id FROM (SELECT user_id::VARCHAR || '/' || event_type AS key, value, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC, event_id DESC) AS k FROM events) WHERE k = 1"),
    "upsert_documents": (upsert_documents, "SELECT doc_id, lang, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (SELECT d.doc_id, lang, CASE WHEN l.doc_id IS NULL THEN text ELSE 'new ' || text END AS t FROM documents d LEFT JOIN labels l USING (doc_id))"),
    "stream_upsert": (stream_upsert, "SELECT doc_id, lang, length(text)::BIGINT AS n_chars FROM documents"),
}
