"""Token counts by a compiled finite-state transducer.

A BPE vocabulary is compiled into a deterministic transducer over characters. Its state is what the future can still
depend on: the longest suffix of the input that some piece starts with, the last token of the encoding of every prefix
that ends inside that suffix, and their counts relative to now. Each transition carries the change in the number of
emitted tokens. The rule behind it: the encoding of a prefix ends in the one piece t that is a suffix of it and whose
pair (last token before t, t) is stable, that is, encodes to itself. States are made on demand and interned.

A text is cut into blocks. Where a block begins matters only through the states that can enter it, so each block has a state map: entering
state -> (state at its end, tokens). Maps compose, and a parallel prefix scan over a text's maps gives its count. Blocks end, if
they can, at synchronising places, where the state doesn't depend on what came before: before a run of word marks that
follows another character. One state can enter a block that begins there, and inside it words are counted through a cache, as they synchronise
as well. A word longer than a block is cut anywhere; its blocks are run from the states that the block before ends in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow

MARK = "▁"
#: A space after another character.
word_start = re.compile(r"(?<! ) ").search


def load_pieces(model_path: str) -> dict[str, float]:
    """Normal pieces of a sentencepiece BPE model with byte fallback, with their scores; read on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    spec, trainer = model.normalizer_spec, model.trainer_spec
    kinds = {p.type for p in model.pieces}
    if trainer.model_type != 2 or not trainer.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces or kinds - {1, 2, 3, 6}:
        raise ValueError("only BPE models with byte fallback, identity normalisation and no user-defined pieces are compiled")
    return {p.piece: p.score for p in model.pieces if p.type == 1}


class Transducer:
    """Deterministic transducer of a BPE vocabulary; transitions give (next state, change of token count)."""

    START = 0

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.prefixes = {p[:k] for p in pieces for k in range(len(p))}  # proper ones: those that may grow
        self.held = {c for p in pieces for c in p}
        self.longest = max(map(len, pieces), default=1)
        self.stable: dict[tuple, bool] = {}
        self.states: dict[tuple, int] = {BEGIN: 0}
        self.by_id = [BEGIN]
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]

    def merge(self, text: str) -> list[str]:
        """Plain BPE: join the adjacent pair whose joint piece scores highest, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.pieces.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def is_stable(self, before: str | None, piece: str) -> bool:
        key = (before, piece)
        if (known := self.stable.get(key)) is None:
            known = self.stable[key] = self.merge((before or "") + piece) == [*([] if before is None else [before]), piece]
        return known

    def step(self, state: int, char: str) -> tuple[int, int]:
        if (arc := self.arcs[state].get(char)) is not None:
            return arc
        suffix, last, rel = self.by_id[state]
        grown = suffix + char
        for k in range(len(grown) - 1):
            if (piece := grown[k:]) in self.pieces and self.is_stable(last[k], piece):
                token, delta = piece, 1 + rel[k]
                break
        else:
            token, delta = char, 1 if char in self.pieces else len(char.encode("utf-8", "surrogatepass"))
        keep = next(k for k in range(len(grown) + 1) if grown[k:] in self.prefixes)
        if keep == len(grown) and char not in self.held:
            token = None  # no piece holds it: as at the start
        starts = [k for k in range(keep, len(grown) + 1) if grown[k:] in self.prefixes]  # where a later piece may begin
        last, rel = (*last, token), (*rel, delta)
        state_to = (grown[keep:], tuple(last[k] if k in starts else None for k in range(keep, len(last))), tuple(rel[k] - delta if k in starts else 0 for k in range(keep, len(rel))))
        to = self.states.setdefault(state_to, len(self.by_id))
        if to == len(self.by_id):
            self.by_id.append(state_to)
            self.arcs.append({})
        arc = self.arcs[state][char] = (to, delta)
        return arc

    def run(self, text: str, state: int = START) -> tuple[int, int]:
        """State after text and tokens emitted, from a state."""
        count, arcs = 0, self.arcs
        for char in text:
            state, delta = arcs[state].get(char) or self.step(state, char)
            count += delta
        return state, count

    def chunk_map(self, text: str, starts: Iterable[tuple]) -> dict[tuple, tuple[tuple, int]]:
        """State map of a text by the states' own descriptions, which outlive their numbers."""
        out = {}
        for start in starts:
            at = self.states.setdefault(start, len(self.by_id))
            if at == len(self.by_id):
                self.by_id.append(start)
                self.arcs.append({})
            to, count = self.run(text, at)
            out[start] = (self.by_id[to], count)
        return out

    def chunk_pattern(self) -> re.Pattern:
        """Chunks of a text whose spaces are still spaces: a run of spaces with what follows; a newline too if no piece holds it."""
        return re.compile(" *[^ \n]+| +|\n" if "\n" not in self.held else " *[^ ]+| +")

    def synchronises(self) -> bool:
        """No piece has a word mark after another character, so that a mark there begins anew."""
        return not any(MARK in p.lstrip(MARK) for p in self.pieces)


#: What a text begins with, and any block that begins at a synchronising place.
BEGIN = ("", (None,), (0,))


def compose(a: dict[tuple, tuple[tuple, int]], b: dict[tuple, tuple[tuple, int]]) -> dict[tuple, tuple[tuple, int]]:
    """The map of two blocks in a row."""
    return {s: (b[mid][0], n + b[mid][1]) for s, (mid, n) in a.items() if mid in b}


def scan(maps: list[dict]) -> list[dict]:
    """Inclusive prefix scan by doubling: after round r, entry i covers 2**r blocks."""
    out, reach = list(maps), 1
    while reach < len(out):
        out = [compose(out[i - reach], m) if i >= reach else m for i, m in enumerate(out)]
        reach *= 2
    return out


class ChunkCounts(dict):
    """Chunk -> its token count from a synchronised state; emptied when full."""

    def __init__(self, transducer: Transducer, most: int = 500_000, most_states: int = 200_000):
        super().__init__()
        self.transducer, self.most, self.most_states = transducer, most, most_states

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self.trim()
        count = self[chunk] = self.transducer.run(chunk.replace(" ", MARK))[1]
        return count

    def trim(self) -> None:
        """Forget the states where they are too many; they are made anew."""
        if len(self.transducer.by_id) > self.most_states or len(self.transducer.stable) > 4 * self.most_states:
            self.transducer.__init__(self.transducer.pieces)


class Counter:
    """Counts tokens of texts by scans over the state maps of their blocks, of block characters to twice as many."""

    def __init__(self, pieces: dict[str, float], block: int = 1 << 15):
        self.transducer = Transducer(pieces)
        if not self.transducer.synchronises():
            raise ValueError("a piece holds a word mark after another character: word starts don't synchronise")
        self.block = block
        self.chunks = self.transducer.chunk_pattern().findall
        self.counts = ChunkCounts(self.transducer)

    def blocks(self, text: str) -> Iterator[tuple[str, bool]]:
        """The blocks of a text, and whether each ends at a synchronising place."""
        at = 0
        while len(text) - at > 2 * self.block:
            found = word_start(text, at + self.block, at + 2 * self.block)
            to = found.start() if found else at + 2 * self.block
            yield text[at:to], found is not None
            at = to
        yield text[at:], True

    def state_maps(self, text: str) -> Iterator[dict]:
        """A map for each block, from the states that can enter it."""
        enter = [BEGIN]
        for block, synchronised in self.blocks(text):
            if enter == [BEGIN] and synchronised:
                yield {BEGIN: (BEGIN, sum(map(self.counts.__getitem__, self.chunks(block))))}
                continue
            self.counts.trim()
            made = self.transducer.chunk_map(block.replace(" ", MARK), enter)
            if synchronised:
                made = {start: (BEGIN, count) for start, (_, count) in made.items()}
            enter = list({to for to, _ in made.values()})
            yield made

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        return scan(list(self.state_maps(" " + text)))[-1][BEGIN][1]


_counters: dict[int, Counter] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes (UTF-8), n_tokens of the whole text, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Null or repeated ids pass through, a row each. An empty table gives
    no rows; other columns are ignored. The vocabulary (a fixed file) is read on the driver and broadcast.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def setup() -> Counter:
        vocabulary = pieces.value
        key = id(vocabulary)
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(vocabulary)
        return _counters[key]

    def per_slice(batch: pa.RecordBatch, counter: Counter) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        counts = [counter.count(t) for t in texts]
        sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names)

    names = [id_col, "n_bytes", "n_tokens", "over_limit"]
    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return map_arrow(chosen, per_slice, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", setup)
