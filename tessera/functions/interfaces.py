"""The parts that a user may bring: anything with these methods fits the pipelines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession


class Loader(Protocol):
    def load(self, spark: SparkSession, path: str) -> DataFrame:
        """(doc_id, content, ...)"""


class Splitter(Protocol):
    def __call__(self, text: str, **options) -> Iterator[tuple[str, int, int]]:
        """(piece, start, end) in order; give it to operators.chunking.METHODS under a name."""


class Analyzer(Protocol):
    def __call__(self, text: Column) -> Column:
        """An array of terms."""


class Embedder(Protocol):
    def embed(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, embedding); a remote model belongs in mapInPandas, a batch of texts a call."""


class Index(Protocol):
    def search(self, queries: DataFrame, k: int, predicate: Column | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank)"""


class Generator(Protocol):
    def complete(self, prompts: DataFrame) -> DataFrame:
        """(query_id, prompt) to (query_id, answer)."""
