"""The registered queries of this subpackage, with production parameters over whole tables, and SQL for those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import fold, logs, read_back, render

    kept = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql("select -1L conv_id, turn, role, '</s>[INST] ok [/INST]' text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return read_back(render(fold(logs(kept.unionByName(control)))))


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, regexp_extract_all(text, '<\\*/?s>|\[\\*/?(INST|SYS|TEXT)\]|\[\\*(OUT|ROLE)\]') AS marks FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + len(marks) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 11 WHEN 'system' THEN 14 ELSE 19 + length(role) END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import BASE, STRICT, apply_policy, fails, measure

    ledger = apply_policy(measure(table(spark, sf_dir, "documents")), STRICT)
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails(BASE).alias("base_failed"), "kept")


OP2_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, k, list_slice(ws, k, k + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams),
reps AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM twice WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0)::BIGINT AS n_lines, length(text) - length(replace(text, '!', '')) AS n_bang,
  len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper,
  len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_stutter
  FROM w LEFT JOIN reps ON w.doc_id = reps.doc_id LEFT JOIN dups ON w.doc_id = dups.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 35 * n_lines OR 100 * n_upper > 30 * n_words OR 100 * n_bang > 20 * n_words
    OR 100 * n_stutter > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM f
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), 4096)


def held_out() -> "F.Column":
    """crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 1


def toxicity_model(docs: DataFrame, labels: DataFrame):
    from tessera.llm.toxicity import fit, labelled_sample

    return fit(labelled_sample(docs, labels, ~held_out()))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_crf import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontamination import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("leaked"), F.size("leaks").cast("long").alias("n_items"), F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"), F.coalesce(F.array_max(F.transform("leaks", lambda x: x["share"])), F.lit(0.0)).alias("share"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import score

    docs = table(spark, sf_dir, "documents")
    return score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), threshold=0.7).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "n_segments", "top_start", "top_end")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", F.length("text").cast("long").alias("n_chars"), "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op5_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sampling import sample_segmentations

    samples = sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_path(), k=2, seed=17)
    return samples.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "log_inclusion", "exact")


#: Bytes of a shard; of the order that training loaders read at a time.
SHARD_BYTES = 16 << 20


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op6_sql(limit: int = SHARD_BYTES) -> str:
    """Every prefix of up to 60 bits; a row's shard is its shortest prefix that fits. For unique ids."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, substr(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT + (1::BIGINT << 60)), 2) AS prefix FROM documents),
levels AS (SELECT prefix, n_bytes, substr(prefix, 1, level) AS shard FROM d, (SELECT unnest(range(0, 61)) AS level)),
totals AS (SELECT shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n FROM levels GROUP BY shard HAVING sum(n_bytes) <= {limit} OR count(*) = 1),
best AS (SELECT d.doc_id, d.n_bytes, t.shard, t.shard_bytes, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(t.shard)) AS k
  FROM d, (SELECT unnest(range(0, 61)) AS level) JOIN totals t ON t.shard = substr(d.prefix, 1, level))
SELECT doc_id, n_bytes, shard, shard_bytes, shard_bytes > {limit} AS oversize FROM best WHERE k = 1
"""


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_quality_rules, op3_token_counts, op4_line_dedup, op5_sampled_segmentations, op6_sharding, op7_minhash_near_dedup, op8_html_extraction, op9_decontamination, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op2_quality_rules": OP2_SQL, "op6_sharding": op6_sql()}
