"""Removal of passages that repeat across documents, by content-defined chunks of lines.

Passages lie inside paragraphs too, where whole lines never repeat, so lines are wrapped at every word: a line here is a word. A
rolling hash over the hashes of the next `size` lines is taken at every place; a place is a boundary if its rolling hash is the least of
some `window` places in a row. So boundaries hang on the lines around them alone and are the same wherever a passage stands.
The chunks of a boundary are the windows of size + window - 1 lines in a row (16 here) whose least rolling hash is the boundary's: chunks that
only reached from one boundary to the next would leave the passage's beginning and end, which lie inside such a chunk.

Texts that are equal, byte by byte, are one: all but that with the smallest id are repeated as a whole. Of the others, boundaries whose
hash occurs once are unique. The chunks in a row of one boundary are a stretch. Stretches of the rest are told apart by a digest of their
exact bytes, white space included, and one that occurs at a smaller (id, place) is repeated with all its chunks. Equal chunks have
equal boundaries; so only where stretches with one hash differ, or a text holds it twice, the chunks of each one's first occurrence are
told apart in the same way, and each that occurs at a smaller (id, place) is repeated, whichever of its occurrences it equals. So
copies that differ from the first in part are found as well, to the first and last line, and no length in bytes limits a line, a chunk or a passage.
Repeated chunks that touch or overlap in a document are one run; those of at least `min_words` lines in all go, shorter ones stay.

Every removed byte equals one at a smaller (id, place), so of all that is equal the first stays; of a text that repeats itself at
once, its first period.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import delete, discard, free, map_arrow, materialise
from tessera.llm.minhash import M1, mix, text_key

#: Rows of a batch whose rows may hold whole texts twice.
LONG_ROWS = 64

SPACES = b" \t\n\v\f\r"
SPACE_BYTES = np.isin(np.arange(256), list(SPACES))
#: A random number for each byte, an odd base and its inverse, for polynomial hashes modulo 2**64.
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * M1)
BASE = 0x2545F4914F6CDD1D
BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """BASE and its inverse to the powers 0 to BLOCK - 1."""
    if not _powers:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            out = np.ones(BLOCK, np.uint64)
            out[1:] = np.uint64(base)
            _powers.append(np.multiply.accumulate(out))
    return _powers


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each word by differences of prefix sums, a block of bytes at a time; of a word over BLOCK bytes, of its first ones."""
    up, down = powers()
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        base = int(starts[k])
        end = max(k + 1, int(np.searchsorted(stops, base + BLOCK, side="right")))
        part = raw[base : min(int(stops[end - 1]), base + BLOCK)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(VALUES[part] * up[: len(part)], out=sums[1:])
        a, b = starts[k:end] - base, np.minimum(stops[k:end] - base, len(part))
        out[k:end] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * M1)
        k = end
    return out


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every window of width values, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def parts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of a column in parts of about BLOCK bytes, at least a text each: (the first's row, their bytes, where each begins and the last ends)."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, side="right")) - 1)
        yield at, raw[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at]
        at = stop


def words_at(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, in bytes, and which text each is of; no word reaches over a bound."""
    solid = ~SPACE_BYTES[raw]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    first, last = bounds[:-1][bounds[:-1] < len(raw)], bounds[1:][bounds[1:] > 0] - 1
    begin[first], end[last] = solid[first], solid[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(bounds, starts, side="right") - 1


class Places:
    """The places of a part's texts: words, rolling hashes of `size` words, least hashes of `window` places, and which windows lie in one text."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, size: int, window: int):
        self.window = window
        self.starts, self.stops, self.owner = words_at(raw, bounds)
        n = len(self.starts) - size + 1
        self.rolled, self.least, self.whole = (np.empty(0, kind) for kind in (np.uint64, np.uint64, bool))
        if n < window:
            return
        w = word_hashes(raw, self.starts, self.stops)
        rolled = np.zeros(n, np.uint64)
        factor = 1
        for k in range(size):
            rolled += w[k : k + n] * np.uint64(factor)
            factor = factor * BASE & 0xFFFFFFFFFFFFFFFF
        self.rolled = mix(rolled)
        self.least = sliding(self.rolled, window, np.minimum)
        self.whole = self.owner[: len(self.least)] == self.owner[size + window - 2 :]

    def boundaries(self) -> np.ndarray:
        """The places whose rolling hash is the least of a window of places."""
        if not len(self.rolled):
            return np.empty(0, np.int64)
        # a place is chosen if it is the least of some window, that is, of the windows with it, the one with the largest least
        edge = np.zeros(self.window - 1, np.uint64)
        padded = np.concatenate([edge, np.where(self.whole, self.least, np.uint64(0)), edge])
        return np.flatnonzero(sliding(padded, self.window, np.maximum) == self.rolled)

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, number of places) of the boundaries."""
        at = self.boundaries()
        owner, h = self.owner[at], self.rolled[at].view(np.int64)
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
        begin = np.flatnonzero(fresh)
        return owner[begin], h[begin], np.diff(np.append(begin, len(at)))


def hashes_of(text: bytes, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The boundaries' hashes of one text, and at how many places each is."""
    return Places(np.frombuffer(text, np.uint8), np.array([0, len(text)]), size, window).hashes()[1:]


def stretches_of(places: Places, wanted: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(text, start, end, hash, loop) of the stretches of wanted hashes: all windows in a row with one least rolling hash. loop: the hash is a boundary of that text more than once."""
    at = np.flatnonzero(places.whole & np.isin(places.least, wanted))
    least, owner = places.least[at], places.owner[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(at))[: len(begin)] - 1
    owners, hashes, n = places.hashes()
    often = set(zip(owners[n > 1].tolist(), hashes[n > 1].tolist(), strict=True))
    h = least[begin].view(np.int64)
    loop = np.array([x in often for x in zip(owner[begin].tolist(), h.tolist(), strict=True)], bool)
    return owner[begin], places.starts[at[begin]], places.stops[at[end] + size + places.window - 2], h, loop


def digests_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests, of 128 bits, of these bytes, and which of them stand earlier in the same text (owner; in order of places)."""
    view = memoryview(raw)
    out, own, seen, last = [], np.zeros(len(starts), bool), set(), -1
    for k, (a, b, o) in enumerate(zip(starts.tolist(), ends.tolist(), owner.tolist(), strict=True)):
        if o != last:
            seen, last = set(), o
        digest = blake2b(view[a:b], digest_size=16).digest()
        if digest in seen:
            own[k] = True
        else:
            seen.add(digest)
        out.append(digest)
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2), own


def distinct_texts(chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, copies) of chosen (d, t, text): texts (d, t, u) numbered in order of (d, t), and copies (d, t, e) of texts that stand, byte by byte, at a smaller id; e is their size in bytes."""
    keyed = materialise(chosen.select("d", "t", text_key("text").alias("key"), F.octet_length("text").alias("e")).distinct(), "keyed")
    firsts = materialise(keyed.groupBy("key").agg(F.min("d").alias("fd"), F.max("d").alias("other")).where("fd < other").select("key", "fd"), "copied")
    marked = materialise(keyed.join(firsts, "key", "left").select("d", "t", "e", F.coalesce(F.col("d") > F.col("fd"), F.lit(False)).alias("copy")), "marked")
    texts = materialise(marked.where("not copy").select("d", "t").orderBy("d", "t").withColumn("u", F.monotonically_increasing_id()), "texts")
    delete(keyed, firsts)
    return texts, marked.where("copy").select("d", "t", "e")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 16) -> DataFrame:
    """(d, t, spans): of every text its chunks of width lines, or the text as a whole, that stand at a smaller (id, place) too; t is a hash of the text, a span start << 32 | end in bytes of its UTF-8."""
    size = (width + 1) // 2
    window = width - size + 1
    text = F.col(text_col).cast("string")
    chosen = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))

    def cut_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows, hashes, others = [], [], []
        for row, raw, bounds in parts_of(batch.column(2)):
            owner, h, n = Places(raw, bounds, size, window).hashes()
            # a boundary that stands in a text more than once counts as one of another text too
            for pick, other in ((slice(None), False), (n > 1, True)):
                rows.append(owner[pick] + row)
                hashes.append(h[pick])
                others.append(np.full(len(h[pick]), other))
        at = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(t[at] ^ np.concatenate(others)), pa.array(np.concatenate(hashes))], ["d", "t", "h"])

    boundaries = materialise(map_arrow(chosen, cut_up, "d long, t long, h long"), "boundaries")
    # hashes of several texts; written before they are joined, so that the joins are shuffles of their own, whose hot hashes Spark splits
    repeated = materialise(boundaries.groupBy("h").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low < high").select("h"), "repeated")
    free(docs.sparkSession)
    wanted = materialise(boundaries.select("d", "h").join(repeated, "h"), "wanted")
    discard(boundaries, repeated)
    texts, copies = distinct_texts(chosen)
    by_doc = wanted.groupBy("d").agg(F.collect_set("h").alias("wanted"))  # no more than the document's own boundaries

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        u, lists = batch.column(0).to_numpy(), batch.column(2)
        found = []
        for row, raw, bounds in parts_of(batch.column(1)):
            mine = np.unique(lists.slice(row, len(bounds) - 1).flatten().to_numpy()).view(np.uint64)
            owner, s, e, h, loop = stretches_of(Places(raw, bounds, size, window), mine, size)
            keys, own = digests_of(raw, s, e, owner)
            found.append((u[owner + row], (s - bounds[owner]) << 32 | (e - bounds[owner]), h, keys[:, 0].copy(), keys[:, 1].copy(), own, loop))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "span", "h", "k", "l", "own", "loop"])

    # the small tables are joined first, so that a text is shuffled once
    held = chosen.join(by_doc.join(texts, "d"), ["d", "t"]).select("u", "text", "wanted")
    stretches = materialise(map_arrow(held, cut_out, "u long, span long, h long, k long, l long, own boolean, loop boolean"), "stretches", LONG_ROWS)
    discard(wanted)
    one = stretches.where("not own")
    firsts = materialise(one.groupBy("h", "k", "l").agg(F.min("u").alias("first")), "first_stretches")
    several = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.lit(True).alias("several"))
    marked = materialise(firsts.join(several, "h", "left").select("k", "l", "first", F.col("several").isNotNull().alias("several")), "marked_stretches")
    free(docs.sparkSession)
    met = materialise(one.join(marked, ["k", "l"]).where("u > first or several or loop").select("u", "span", (F.col("u") > F.col("first")).alias("again")), "met")
    discard(firsts, marked)
    whole = met.where("again").select("u", "span").unionByName(stretches.where("own").select("u", "span"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Of the stretches that differ from others with their hash, or may repeat themselves, every window."""
        u, lists = batch.column(0).to_numpy(), batch.column(2)
        found = []
        for row, raw, bounds in parts_of(batch.column(1)):
            mine = lists.slice(row, len(bounds) - 1)
            spans = mine.flatten().to_numpy()
            text_of = np.repeat(np.arange(len(bounds) - 1), mine.value_lengths().to_numpy())
            order = np.lexsort((spans, text_of))
            spans, text_of = spans[order], text_of[order]
            a, b = (spans >> 32) + bounds[text_of], (spans & 0xFFFFFFFF) + bounds[text_of]
            slices = np.concatenate([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            cuts = np.concatenate([[0], np.cumsum(b - a)])
            starts, stops, stretch = words_at(slices, cuts)
            at = np.flatnonzero(stretch[: len(stretch) - width + 1] == stretch[width - 1 :])
            s, e, stretch = starts[at], stops[at + width - 1], stretch[at]
            keys, own = digests_of(slices, s, e, text_of[stretch])
            move = (a - bounds[text_of] - cuts[:-1])[stretch]
            found.append((u[text_of[stretch] + row], (s + move) << 32 | (e + move), keys[:, 0].copy(), keys[:, 1].copy(), own))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "span", "k", "l", "own"])

    open_ones = met.where("not again").groupBy("u").agg(F.collect_list("span").alias("spans"))
    open_texts = chosen.join(open_ones.join(texts, "u"), ["d", "t"]).select("u", "text", "spans")
    chunks = materialise(map_arrow(open_texts, digest, "u long, span long, k long, l long, own boolean"), "chunks", LONG_ROWS)
    free(docs.sparkSession)
    single = chunks.where("not own").drop("own")
    firsts = materialise(single.groupBy("k", "l").agg(F.min("u").alias("first"), F.max("u").alias("last")).where("first < last").select("k", "l", "first"), "firsts")
    across = materialise(single.join(firsts, ["k", "l"]).where("u > first").select("u", "span"), "across")
    spans = across.unionByName(chunks.where("own").select("u", "span")).unionByName(whole).groupBy("u").agg(F.collect_list("span").alias("spans"))
    found = materialise(spans.join(texts, "u").select("d", "t", "spans"), "found")
    discard(stretches, met, chunks, firsts, across, texts)
    return found.unionByName(copies.select("d", "t", F.array(F.col("e").cast("long")).alias("spans")))


def remove(text: bytes, starts: np.ndarray, ends: np.ndarray, min_words: int) -> tuple[bytes, int]:
    """The text without the runs of min_words words that these windows make, and the bytes removed; white space at a gap becomes one separator."""
    order = np.argsort(starts)
    merged: list[list[int]] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if merged and (s <= merged[-1][1] or not text[merged[-1][1] : s].strip(SPACES)):
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    merged = [x for x in merged if len(text[x[0] : x[1]].split()) >= min_words]
    if not merged:
        return text, 0
    parts, at = [], 0
    for s, e in merged:
        parts.append(text[at:s])
        at = e
    parts.append(text[at:])
    kept, tail = [parts[0]], parts[0]
    for part in parts[1:]:
        x, y = tail.rstrip(SPACES), part.lstrip(SPACES)
        gap = tail[len(x) :] + part[: len(part) - len(y)]
        kept[-1:] = [x, (b"\n" if b"\n" in gap else b" ") if x and y else b"", y]
        tail = y
    out = b"".join(kept)
    return out, len(text) - len(out)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, width: int = 16) -> DataFrame:
    """docs with repeated passages removed from text_col, and one more column, n_removed (UTF-8 bytes removed, long).

    Ids are taken as long numbers; ones that are none count as null.
    A text that consists of repeated passages becomes empty; rows are never dropped. Null texts stay null. Rows that
    share an id are told apart by their texts and those that agree in both are one document; rows without an id stay as they are. An empty table gives an empty one. Other columns
    pass through under their names, except that an n_removed of the input is replaced.
    """
    docs = docs.drop("n_removed")
    found = repeated_chunks(docs, id_col, text_col, min(width, min_words))
    names = docs.columns
    same = (F.col(id_col).cast("long") == F.col("__d")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__t"))
    joined = docs.join(found.withColumnsRenamed({"d": "__d", "t": "__t", "spans": "__spans"}), same, "left").drop("__d", "__t")
    at = names.index(text_col)

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, removed = [], []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)), strict=True):
            if text is None or not spans.is_valid:
                texts.append(text)
                removed.append(0)
            else:
                out, n = remove(text.encode("utf-8", "surrogatepass"), (both := spans.values.to_numpy()) >> 32, both & 0xFFFFFFFF, min_words)
                texts.append(out.decode("utf-8", "replace"))
                removed.append(n)
        columns = batch.columns[: len(names)]
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], [*names, "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString() if f.name != text_col else 'string'}" for f in docs.schema)
    return map_arrow(joined, apply, f"{schema}, n_removed long")
