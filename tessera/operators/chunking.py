"""Splitting texts into chunks.

The splitters carry state from one window to the next, so they run as plain functions over Arrow batches; everything
around them (ids, counts, the parent and child hierarchy) is in DataFrames. All offsets are in characters, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Piece = tuple[str, int, int]


def token_estimate(text: Column) -> Column:
    """A token for every four characters begun."""
    return F.ceil(F.length(text) / 4).cast("int")


def checked(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")


def trimmed(text: str, start: int, end: int) -> Iterator[Piece]:
    piece = text[start:end].strip()
    if piece:
        yield piece, start, end


def window(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> Iterator[Piece]:
    """Windows that end after the first separator (by preference) whose last place is in the window's last 30 %."""
    start, last = 0, -1
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            floor = max(start, end - int(size * 0.3))
            places = ((text.rfind(s, 0, end + len(s)), s) for s in separators)
            end = next((at + len(s) for at, s in places if at > floor), end)
        for piece in trimmed(text, start, end):
            last = start
            yield piece
        if end >= len(text):
            return
        start = max(end - overlap, last + 1)


def window_any(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", " ")) -> Iterator[Piece]:
    """Windows that end after the first separator (by preference) found beyond the overlap."""
    start = 0
    while text.strip() and start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            places = ((text.rfind(s, 0, end + len(s)), s) for s in separators)
            end = next((at + len(s) for at, s in places if at > start + overlap), end)
        yield from trimmed(text, start, end)
        start = end - overlap if end - overlap > start and end < len(text) else end


def token_window(text: str, size: int = 300, overlap: int = 30) -> Iterator[Piece]:
    """Runs of words and gaps of at most size estimated tokens (four characters each, one at least); the tail of each, up to overlap, comes again."""
    if not text.strip():
        return
    parts = [(m.start(), m.end(), -(-len(m[0].strip()) // 4) or 1) for m in re.finditer(r"\s+|\S+", text)]
    first, cost = 0, 0
    for n, (_, _, own) in enumerate(parts):
        if n > first and cost + own > size:
            yield from trimmed(text, parts[first][0], parts[n - 1][1])
            first, cost = n, 0
            while cost + parts[first - 1][2] <= overlap:
                first -= 1
                cost += parts[first][2]
        cost += own
    yield from trimmed(text, parts[first][0], parts[-1][1])


def separated(text: str, size: int = 500, overlap: int = 0, separator: str = "\n\n") -> Iterator[Piece]:
    """Paragraphs joined while they fit; a larger one stays whole."""
    yield from located(text, (p for p in greedy(text.split(separator), separator, size)), 0)


def greedy(parts: list[str], separator: str, size: int) -> Iterator[str]:
    held = ""
    for part in parts:
        longer = f"{held}{separator}{part}" if held else part
        if len(longer) <= size:
            held = longer
        else:
            if held:
                yield held
            held = part
    if held.strip():
        yield held


def finest(text: str, separators: tuple[str, ...]) -> tuple[str, tuple[str, ...]]:
    """The first separator that the text holds, and those after it."""
    return next(((s, separators[k + 1 :]) for k, s in enumerate(separators) if not s or s in text), (separators[-1], ()))


def recursive_flat(text: str, size: int = 500, overlap: int = 0, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> Iterator[Piece]:
    """Pieces by the first separator there is, joined while they fit; larger ones are split by the next."""

    def split(t: str, rest: tuple[str, ...]) -> Iterator[str]:
        s, finer = finest(t, rest)
        held = ""
        for part in t.split(s) if s else t:
            longer = f"{held}{s}{part}" if held else part
            if len(longer) <= size:
                held = longer
                continue
            if held:
                yield held
            held = part
            if len(part) > size and finer:
                yield from split(part, finer)
                held = ""
        if held.strip():
            yield held

    yield from located(text, split(text, separators), overlap)


def recursive(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> Iterator[Piece]:
    """As recursive_flat, but each chunk starts with the pieces at the end of the one before it, up to overlap characters."""

    def merge(parts: list[str], s: str) -> Iterator[str]:
        held: list[str] = []
        length = lambda: sum(map(len, held)) + len(s) * max(0, len(held) - 1)
        for part in parts:
            if held and length() + len(part) + len(s) > size:
                yield s.join(held)
                while held and (length() > overlap or length() + len(part) + len(s) > size):
                    held.pop(0)
            held.append(part)
        if held:
            yield s.join(held)

    def split(t: str, rest: tuple[str, ...]) -> Iterator[str]:
        s, finer = finest(t, rest)
        small: list[str] = []
        for part in t.split(s) if s else t:
            if len(part) < size:
                small.append(part)
                continue
            yield from merge(small, s)
            small = []
            if finer:
                yield from split(part, finer)
            else:
                yield part
        yield from merge(small, s)

    yield from located(text, split(text, separators), overlap)


def located(text: str, pieces: Iterator[str], overlap: int) -> Iterator[Piece]:
    """Pieces, trimmed, with the places where they stand next; -1 for both where they don't."""
    cursor = 0
    for piece in pieces:
        piece = piece.strip()
        if not piece:
            continue
        at = text.find(piece, cursor)
        if at >= 0:
            cursor = at + max(1, len(piece) - overlap)
        yield piece, at, at + len(piece) if at >= 0 else -1


def word_window(text: str, size: int = 500, overlap: int = 50) -> Iterator[Piece]:
    """Windows cut back to the last space; a text that fits stays as it is. Each window starts after the one before."""
    if len(text) <= size:
        yield text, 0, len(text)
        return
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text) and (space := text.rfind(" ", 0, end + 1)) > start:
            end = space
        yield from trimmed(text, start, end)
        if end >= len(text):
            return
        start = max(end - overlap, start + 1)


def sentence_window(text: str, size: int = 500, overlap: int = 50) -> Iterator[Piece]:
    """White space becomes one space; windows end after a full stop in their second half, else at the last space. Offsets are in the cleaned text."""
    clean = " ".join(re.split(r"\s+", text)).strip()
    start = 0
    while start < len(clean):
        end = min(start + size, len(clean))
        if end < len(clean):
            stop, space = clean.rfind(". ", 0, end + 2), clean.rfind(" ", 0, end + 1)
            end = stop + 1 if stop > start + size * 0.5 else space if space > start else end
        yield from trimmed(clean, start, end)
        if end >= len(clean):
            return
        start = max(end - overlap, start + 1)


METHODS: dict[str, Callable[..., Iterator[Piece]]] = {f.__name__: f for f in (window, window_any, token_window, separated, recursive, recursive_flat, word_window, sentence_window)}


def chunk(df: DataFrame, method: str = "sentence_window", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (id, chunk_index, total_chunks, start_char, end_char, content, token_estimate, chunk_id) for every chunk; texts without any give none."""
    split = METHODS[method]
    if "size" in options:
        checked(options["size"], options.get("overlap", 0))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, source = [], []
                for n, text in enumerate(part.column(1).to_pylist()):
                    found = list(split(text or "", **options)) if (text or "").strip() else []
                    rows += [(k, len(found), a, b, piece) for k, (piece, a, b) in enumerate(found)]
                    source += [n] * len(found)
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(),) * 4 + (pa.string(),), strict=True))], [id_col, "chunk_index", "total_chunks", "start_char", "end_char", "content"])

    chunks = df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, chunk_index int, total_chunks int, start_char int, end_char int, content string")
    return chunks.withColumn("token_estimate", token_estimate(F.col("content"))).withColumn("chunk_id", F.concat(F.col(id_col).cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")))


def parent_child(df: DataFrame, parent_size: int = 1500, parent_overlap: int = 200, child_size: int = 350, child_overlap: int = 60, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(parents, children): sentence windows of the texts, and sentence windows of those. Overlaps are held below sizes."""
    clamp = lambda overlap, size: min(overlap, max(0, size - 1))
    parents = chunk(df, "sentence_window", id_col, text_col, size=parent_size, overlap=clamp(parent_overlap, parent_size))
    parents = parents.select(F.concat(F.col(id_col).cast("string"), F.lit("::parent_"), (F.col("chunk_index") + 1).cast("string")).alias("parent_id"), id_col, F.col("chunk_index").alias("parent_index"), F.col("total_chunks").alias("total_parents"), "content", "token_estimate")
    children = chunk(parents, "sentence_window", "parent_id", "content", size=child_size, overlap=clamp(child_overlap, child_size))
    children = children.select(F.concat("parent_id", F.lit("::child_"), (F.col("chunk_index") + 1).cast("string")).alias("child_id"), "parent_id", F.split("parent_id", "::")[0].alias(id_col), F.col("chunk_index").alias("child_index"), F.col("total_chunks").alias("child_count"), "content", "token_estimate")
    return parents, children
