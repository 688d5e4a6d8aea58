"""Whole pipelines: documents and a batch of questions in, ranked contexts and answers out.

docs are (doc_id, title, content) with any other columns as metadata, questions (query_id, query). One plan serves the whole batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions.embeddings import Scheme, embed, embedding_text, fnv_scheme, sparse_cosine
from tessera.functions.text import service_tokens
from tessera.operators import answers, chunking, expand, fusion, parents, rerank
from tessera.operators.filters import Guard, Principal, compile_filter, secured
from tessera.operators.lexical import Bm25, bm25, token_rows
from tessera.operators.search import ranked


@dataclass
class Engine:
    """Chunks of documents with their tokens and vectors, searched in any of the ways the pipelines need."""

    docs: DataFrame
    settings: Settings = field(default_factory=Settings)
    method: str = "sentence_window"
    scheme: Scheme = field(default_factory=fnv_scheme)
    bm25: Bm25 = Bm25(k1=1.2, unique_terms=False)

    def __post_init__(self):
        s = self.settings
        pieces = chunking.chunk(self.docs, self.method, "doc_id", "content", size=s.chunk_size, overlap=s.chunk_overlap)
        self.chunks = pieces.join(self.docs.drop("content"), "doc_id")
        text = embedding_text(F.col("title"), F.col("content"))
        self.tokens = token_rows(self.chunks.withColumn("t", text), "chunk_id", service_tokens(F.col("t")))
        self.vectors = embed(self.chunks.withColumn("t", text), "chunk_id", "t", self.scheme)

    def restricted(self, hits: DataFrame, allowed: DataFrame | None) -> DataFrame:
        return hits if allowed is None else hits.join(allowed.select("chunk_id"), "chunk_id", "left_semi")

    def dense(self, questions: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        scored = sparse_cosine(self.vectors if allowed is None else self.restricted(self.vectors, allowed), embed(questions, "query_id", "query", self.scheme))
        return ranked(scored.withColumn("score", F.round("score", 9)), k).withColumn("source", F.lit("dense"))

    def sparse(self, questions: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        terms = questions.select("query_id", F.explode(service_tokens(F.col("query"))).alias("term"))
        scored = self.restricted(bm25(self.tokens, terms, self.bm25), allowed)
        return ranked(scored.withColumn("score", F.round("score", 9)), k).withColumn("source", F.lit("sparse"))

    def hybrid(self, questions: DataFrame, k: int, fuse: str = "rrf", allowed: DataFrame | None = None) -> DataFrame:
        """fuse: rrf, weighted_rrf or weighted_score."""
        s = self.settings
        hits = self.dense(questions, s.pool, allowed).unionByName(self.sparse(questions, s.pool, allowed))
        if fuse == "rrf":
            return fusion.rrf(hits, s.rrf_k, top=k)
        return fusion.weighted_rrf(hits, s.alpha, s.rrf_k, k) if fuse == "weighted_rrf" else fusion.weighted_scores(hits, s.alpha, top=k)

    def allowed(self, predicate: Column | dict | None = None, who: Principal | None = None, guard: Guard = Guard()) -> DataFrame:
        """The chunks that pass a metadata filter, within what a principal may see."""
        tree = predicate if isinstance(predicate, dict) else None
        kept = secured(self.chunks, who, tree, guard) if who else self.chunks if tree is None else self.chunks.where(compile_filter(tree, self.chunks.schema))
        return kept.where(predicate) if isinstance(predicate, Column) else kept

    def with_text(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.chunks.select("chunk_id", "content", "title"), "chunk_id")

    def answer(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        """(query_id, query, answer, context, n) from hits, a refusal where there are none."""
        full = self.with_text(hits).withColumn("source", F.col("title"))
        made = answers.template_answers(questions, full).join(answers.context(full), "query_id", "left")
        return questions.join(made, "query_id")


def basic(engine: Engine, questions: DataFrame) -> DataFrame:
    return engine.answer(questions, engine.dense(questions, engine.settings.top_k))


def keyword(engine: Engine, questions: DataFrame) -> DataFrame:
    return engine.answer(questions, engine.sparse(questions, engine.settings.top_k))


def hybrid(engine: Engine, questions: DataFrame, fuse: str = "rrf") -> DataFrame:
    return engine.answer(questions, engine.hybrid(questions, engine.settings.top_k, fuse))


def tenant(engine: Engine, questions: DataFrame, who: Principal, client: dict | None = None) -> DataFrame:
    """Only what the principal may see is searched."""
    return engine.answer(questions, engine.dense(questions, engine.settings.top_k, engine.allowed(client, who)))


def reranked(engine: Engine, questions: DataFrame) -> DataFrame:
    """Hybrid candidates, then the cross-encoder; with rank deltas: (query_id, chunk_id, score, rank, first_rank, rank_delta, top_changed)."""
    first = engine.hybrid(questions, engine.settings.pool).join(questions, "query_id")
    return rerank.two_stage(first, engine.chunks, engine.settings.top_k)


def candidates(engine: Engine, questions: DataFrame, merged: DataFrame) -> DataFrame:
    cosine = sparse_cosine(engine.vectors, embed(questions, "query_id", "query", engine.scheme)).select("query_id", "chunk_id", F.col("score").alias("cosine"))
    return engine.with_text(merged.join(questions, "query_id")).join(cosine, ["query_id", "chunk_id"], "left").fillna(0.0, ["cosine"])


def multi_query(engine: Engine, questions: DataFrame) -> DataFrame:
    """Variations of each question searched together, merged with attribution and reranked."""
    s = engine.settings
    asked = expand.variations(questions.select(F.col("query_id").alias("question_id"), F.col("query").alias("text")), s.query_variations)
    found = engine.hybrid(asked.select("query_id", F.col("text").alias("query")), s.pool).join(asked.select("query_id", "question_id"), "query_id")
    merged = fusion.merge_queries(found, "rrf", s.rrf_k).withColumnRenamed("question_id", "query_id").select("query_id", "chunk_id", "score", "occurrences")
    return engine.answer(questions, rerank.rerank_multiplicative(candidates(engine, questions, merged), s.top_k).select("query_id", "chunk_id", "score", "rank"))


def hypothetical(engine: Engine, questions: DataFrame) -> DataFrame:
    """Hypothetical passages, the question itself and its terms, merged and reranked."""
    s = engine.settings
    made = expand.hypothetical(questions.select(F.col("query_id").alias("question_id"), F.col("query").alias("text")), s.hypothetical_passages)
    by_passage = engine.dense(made.select("query_id", F.col("text").alias("query")), s.pool).join(made.select("query_id", "question_id"), "query_id").drop("query_id").withColumnRenamed("question_id", "query_id")
    hits = by_passage.withColumn("source", F.lit("hyde_vector")).unionByName(engine.dense(questions, s.pool).withColumn("source", F.lit("direct_vector"))).unionByName(engine.sparse(questions, s.pool).withColumn("source", F.lit("bm25")))
    merged = fusion.merge_sources(hits, "rrf", k=s.rrf_k).select("query_id", "chunk_id", "score", "occurrences")
    return engine.answer(questions, rerank.rerank_additive(candidates(engine, questions, merged), s.top_k).select("query_id", "chunk_id", "score", "rank"))


def parent_document(docs: DataFrame, questions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Children are searched, parents answer: (query_id, parent_ids, total_tokens, dropped_by_limit, ..., context)."""
    s = settings
    parent, child = chunking.parent_child(docs, s.parent_size, s.parent_overlap, s.child_size, s.child_overlap, "doc_id", "content")
    tokens = token_rows(child, "child_id", service_tokens(F.col("content")))
    vectors = embed(child, "child_id", "content", fnv_scheme(s.embedding_dim)).withColumnRenamed("child_id", "chunk_id")
    asked = embed(questions, "query_id", "query", fnv_scheme(s.embedding_dim))
    terms = questions.select("query_id", F.explode(service_tokens(F.col("query"))).alias("term"))
    hits = ranked(sparse_cosine(vectors, asked), s.pool).withColumn("source", F.lit("child_dense")).unionByName(ranked(bm25(tokens, terms, Bm25(k1=1.2, unique_terms=False)), s.pool).withColumn("source", F.lit("child_bm25")))
    merged = fusion.merge_sources(hits, "rrf", fusion.CHILD_WEIGHTS, s.rrf_k).withColumn("parent_id", F.regexp_replace("chunk_id", "::child_.*$", ""))
    chosen = parents.within_budget(parents.resolve(merged, parent), s.max_parents, s.max_context_tokens)
    texts = parents.fetch(parent, chosen).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), "\n\n").alias("context"))
    return chosen.join(texts, "query_id", "left")
