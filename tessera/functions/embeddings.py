"""Deterministic hashed embeddings, in sparse form: rows (id, idx, w) of unit vectors.

A text's words are cut by column expressions; one pass in Arrow batches turns them into its vector, so nothing is shuffled. What a word
adds is computed once a task and kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a batch whose words are Python objects at a time, and words whose features a task keeps.
SLICE, KEPT = 256, 200_000
LOW = 0xFFFFFFFF


def signed32(h: int) -> int:
    return h - (1 << 32) if h >= 1 << 31 else h


def hash31(word: str) -> int:
    """31 h + c in 32 signed bits."""
    h = 0
    for c in map(ord, word):
        h = h * 31 + c & LOW
    return signed32(h)


def hash33(word: str) -> int:
    """33 h xor c in 32 signed bits, from 5381."""
    h = 5381
    for c in map(ord, word):
        h = (h * 33 ^ c) & LOW
    return signed32(h)


def hash_mul(word: str, factor: int) -> int:
    h = 0
    for c in map(ord, word):
        h = h * factor + c & LOW
    return h


def fnv1a(word: str) -> int:
    """FNV-1a of 32 bits."""
    h = 2166136261
    for c in map(ord, word):
        h = (h ^ c) * 16777619 & LOW
    return h


def trigrams(word: str) -> list[str]:
    return [word[i : i + 3] for i in range(len(word) - 2)]


def signed(h: int, weight: float) -> float:
    return weight if h % 2 == 0 else -weight


@dataclass(frozen=True)
class Scheme:
    """How words are cut and hashed: `words` is a text's words as a column, `of_word` a word's features (index, weight), `of_pair` those of two neighbours joined by _,
    `length` the weight of the text's length; zero says where the weight of a text without words goes."""

    dim: int
    words: Callable[[Column], Column]
    of_word: Callable[[str], list[tuple[int, float]]]
    zero: int | None = None
    of_pair: Callable[[str], list[tuple[int, float]]] | None = None
    length: float = 0.0


def only_plain(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: w != "")


def only_word(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", ""), r"\s+"), lambda w: w != "")


def at_nonword(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.lower(text)), r"\W+"), lambda w: w != "")


def token_scheme(dim: int = 64) -> Scheme:
    return Scheme(dim, only_plain, lambda w: [(abs(hash31(w)) % dim, 1.0)], zero=0)


def signed_scheme(dim: int = 128) -> Scheme:
    def of_word(w: str) -> list[tuple[int, float]]:
        return [(abs(h) % dim, signed(h, weight)) for h, weight in [(hash33(w), 2.0), *((hash33(t), 0.5) for t in trigrams(w))]]

    return Scheme(dim, only_plain, of_word)


def bigram_scheme(dim: int = 64) -> Scheme:
    """Words and pairs of neighbours."""
    return Scheme(dim, at_nonword, lambda w: [(hash_mul(w, 31) % dim, 1.0 + len(w) % 5 * 0.1)], zero=0, of_pair=lambda p: [(hash_mul(p, 17) % dim, 0.5)])


def neighbour_scheme(dim: int = 1536) -> Scheme:
    """Weights are relative, as vectors are normalised."""

    def of_word(w: str) -> list[tuple[int, float]]:
        i = abs(hash31(w)) % dim
        return [(i, 1.0), ((i + 137) % dim, 0.5)]

    return Scheme(dim, only_word, of_word)


def fnv_scheme(dim: int = 1536) -> Scheme:
    def of_word(w: str) -> list[tuple[int, float]]:
        return [(h % dim, signed(h, weight)) for h, weight in [(fnv1a(w), 1.0), *((fnv1a(t), 0.5) for t in trigrams(w))]]

    return Scheme(dim, at_nonword, of_word)


def char_scheme(dim: int = 128) -> Scheme:
    """Characters by place and character pairs, and the text's length."""

    def of_word(w: str) -> list[tuple[int, float]]:
        c = list(map(ord, w))
        return [((x * 31 + i * 17) % dim, 1 / math.log2(len(c) + 2)) for i, x in enumerate(c)] + [((a * 101 + b * 37) % dim, 0.5) for a, b in zip(c, c[1:], strict=False)]

    return Scheme(dim, only_word, of_word, length=0.25)


SCHEMES = {"token": token_scheme, "signed": signed_scheme, "bigram": bigram_scheme, "neighbour": neighbour_scheme, "char": char_scheme, "fnv": fnv_scheme}


class Features(dict):
    """Word -> arrays of indexes and weights; emptied when full."""

    def __init__(self, of: Callable[[str], list[tuple[int, float]]]):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self) >= KEPT:
            self.clear()
        found = self.of(word)
        made = self[word] = (np.array([i for i, _ in found], np.int64), np.array([w for _, w in found], np.float64))
        return made


def unit_vector(words: list[str], length: int, scheme: Scheme, features: Features, pairs: Features | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and weights of a text's unit vector, without its zeros."""
    parts = [(features[w], k) for w, k in Counter(words).items()]
    if pairs is not None:
        parts += [(pairs[p], k) for p, k in Counter(f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)).items()]
    if scheme.length:
        parts.append(((np.array([length * 13 % scheme.dim]), np.array([scheme.length])), 1))
    if not parts:
        return (np.array([scheme.zero]), np.array([1.0])) if scheme.zero is not None else (np.empty(0, np.int64), np.empty(0))
    v = np.bincount(np.concatenate([i for (i, _), _ in parts]), np.concatenate([w * k for (_, w), k in parts]), scheme.dim)
    at = np.flatnonzero(v)
    return at, v[at] / math.sqrt(float(v @ v)) if len(at) else v[at]


def embed(df: DataFrame, id_col: str, text_col: str, scheme: Scheme) -> DataFrame:
    """Rows (id, idx, w) of each text's unit vector without its zeros. Texts without features have no rows, or one at scheme.zero. Null counts as empty; rows that share an id are texts of their own."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, pairs = Features(scheme.of_word), Features(scheme.of_pair) if scheme.of_pair else None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                ids, words, lengths = batch.slice(start, SLICE).columns
                made = [unit_vector(w, n, scheme, features, pairs) for w, n in zip(words.to_pylist(), lengths.to_pylist(), strict=True)]
                owner = pa.array(np.repeat(np.arange(len(made)), [len(i) for i, _ in made]))
                idx, w = (np.concatenate(x) for x in zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(owner), pa.array(idx.astype(np.int32)), pa.array(w.astype(np.float64))], [id_col, "idx", "w"])

    cut = df.select(F.col(id_col), scheme.words(text).alias("words"), F.length(text).alias("n"))
    return cut.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, idx int, w double")


def to_dense(sparse: DataFrame, id_col: str, dim: int) -> DataFrame:
    """(id, embedding array<double>) of sparse vectors."""
    entries = sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("idx", "w"))).alias("m"))
    return entries.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("embedding"))


def sparse_cosine(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of all pairs with a common dimension: docs (chunk_id, idx, w), queries (query_id, idx, w), both of unit length."""
    q = queries.select("query_id", "idx", F.col("w").alias("qw"))
    return docs.join(q, "idx").groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))


def embedding_text(title: Column, content: Column, order: str = "content title") -> Column:
    """What is embedded of a titled document: 'content', 'title content' or 'content title'."""
    return F.concat_ws(" ", *({"content": content, "title": title}[p] for p in order.split()))
