"""Benchmark decontamination on canonical templates.

Text becomes a template: numbers, names and units turn into typed placeholders, other words lose case and surrounding
punctuation. A capitalised word that begins a sentence may be a name or not, so there is a template for each. Windows of five template words of the benchmark items are indexed by hash; each document's windows are
looked up there. An item leaks into a document if at least `share` of its distinct windows lie near one diagonal, that
is, in the item's order and about its length, and its slots are filled consistently: equal values of the item map to equal
values of the document and different ones to different ones. So a re-parameterised question counts, with the number
of its slots that changed.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, materialise
from tessera.llm.minhash import M1, mix, text_key

# Number words and units of measurement.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons ml l litre litres liter liters gallon gallons ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years hz khz mhz ghz v volt volts a amp amps w watt watts kw kwh j joule joules n newton newtons pa kpa bar c f k degree degrees percent % $ € £ dollar dollars euro euros cent cents usd eur kmh mph".split())
number = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?").fullmatch
edges = re.compile(r"^\W+|\W+$")
#: Ids of placeholders; words follow. A word that no item has is 0.
NUM, NAME, UNIT, FIRST = 1, 2, 3, 4
END, TITLE, UNITLIKE, LINE = 1 << 40, 1 << 41, 1 << 42, 1 << 43
MARK = b"\x1e"
SLOT = frozenset((NUM, NAME, UNIT))


def bare(raw: bytes) -> str:
    """A word without surrounding punctuation and symbols, case kept; a number keeps its sign and currency, and one per cent sign."""
    text = raw.decode("utf-8", "replace").rstrip(".,;:!?)\"'")
    return text if number(text) else edges.sub("", text)


class Codes(dict):
    """Raw word (bytes) -> id of its lower-cased core, or of a placeholder, with flags; emptied when full."""

    def __init__(self, ids: dict[str, int], grow: bool = False, most: int = 400_000):
        super().__init__({MARK: LINE | END})
        self.ids, self.grow, self.most = ids, grow, most

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
            self[MARK] = LINE | END
        core = bare(raw)
        low = core.lower()
        if number(core) or low in NUMBER_WORDS:
            code = NUM
        elif not core:
            code = LINE
        else:
            code = self.ids.setdefault(low, len(self.ids) + FIRST) if self.grow else self.ids.get(low, 0)
            if low in UNITS:
                code |= UNITLIKE
            if core[0].isupper() and core[1:].islower():
                code |= TITLE
        if raw.rstrip(b"\"')]#*$%&|<>")[-1:] in (b".", b"!", b"?", b":"):
            code |= END
        self[raw] = code
        return code


def template(text: str | None, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(typed ids, plain ids, open ids, raw words, index of each id's raw word). Typed: capitalised words inside a sentence are names, units after a
    number units; plain: both are words, for copies whose capitals changed; open: as typed, with capitalised words that begin a sentence names too."""
    raw = (text or "").encode("utf-8", "surrogatepass").replace(MARK, b" ").replace(b"\n", b" " + MARK + b" ").split()
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), raw, np.empty(0, np.int64)
    c = np.fromiter(map(codes.__getitem__, raw), np.int64, n)
    after_end = np.empty(n, bool)
    after_end[0] = True
    after_end[1:] = c[:-1] & END != 0
    at = np.flatnonzero(c & LINE == 0)
    name = ((c & TITLE != 0) & ~after_end)[at]
    c = c[at]
    plain = c & (END - 1)
    ids = np.where(name, NAME, plain)
    if len(ids) > 1:
        unit = np.zeros(len(ids), bool)
        unit[1:] = (c[1:] & UNITLIKE != 0) & (ids[:-1] == NUM)
        ids[unit] = UNIT
    return ids, plain, np.where((c & TITLE != 0) & (ids != UNIT), NAME, ids), raw, at


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    n = len(ids) - width + 1
    h = np.full(max(n, 0), np.uint64(width))
    for k in range(width):
        h = mix(h * M1 + ids[k : k + n].astype(np.uint64)) if n > 0 else h
    return h


class Index:
    """Template windows of a block of benchmark items, typed, plain and open."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width, self.ids = width, {}
        codes, postings = Codes(self.ids, grow=True), (defaultdict(list), defaultdict(list), defaultdict(list))
        self.items: tuple[dict, dict, dict] = ({}, {}, {})
        for item, text in items:
            *kinds, raw, at = template(text, codes)
            for kind, ids in enumerate(kinds):
                if not len(ids):
                    continue
                # names at sentence beginnings: only where there are any, and where at least half of the item and a window's worth of words stay words
                if kind == 2 and (np.array_equal(ids, kinds[0]) or (ids >= FIRST).sum() < max(width, len(ids) / 2)):
                    continue
                size, places = min(width, len(ids)), {}
                for i, h in enumerate(window_hashes(ids, size).tolist()):
                    places.setdefault(h, i)
                self.items[kind][item] = (len(places), len(ids), ids, [bare(raw[k]).lower() for k in at])
                for h, i in places.items():
                    postings[kind][size, h].append((item, i))
        self.postings = tuple(map(dict, postings))
        self.keys = tuple({size: np.array(sorted(h for s, h in p if s == size), np.uint64) for size in {s for s, _ in p}} for p in self.postings)

    def search(self, text: str | None, codes: Codes, share: float) -> list[tuple]:
        """(item, share found, first word, last word + 1, changed slots) of every item that leaks into the text; words of its template."""
        typed, plain, opened, raw, at = template(text, codes)
        return sorted({x[0]: x for kind, ids in ((2, opened), (1, plain), (0, typed)) for x in self.leaks(kind, ids, raw, at, share)}.values())

    def leaks(self, kind: int, ids: np.ndarray, raw: list[bytes], at: np.ndarray, share: float) -> list[tuple]:
        met = defaultdict(list)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, keys in self.keys[kind].items():
            if len(ids) < size:
                continue
            full = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(full):
                continue
            h = np.full(len(full), np.uint64(size))
            for k in range(size):
                h = mix(h * M1 + ids[full + k].astype(np.uint64))
            spot = np.searchsorted(keys, h)
            spot[spot == len(keys)] = 0
            for j in np.flatnonzero(keys[spot] == h).tolist():
                for item, i in self.postings[kind][size, int(h[j])]:
                    met[item].append((i, int(full[j])))
        out = []
        for item, hits in met.items():
            windows, length, item_ids, item_words = self.items[kind][item]
            if len({i for i, _ in hits}) < share * windows:
                continue
            found = self.best_diagonal(hits, length)
            got = len({i for i, _ in found})
            if got < share * windows:
                continue
            changed = self.slots(item_ids, item_words, ids, raw, at, found, min(self.width, length))
            if changed is not None:
                out.append((item, got / windows, min(j for _, j in found), max(j for _, j in found) + min(self.width, length), changed))
        return out

    @staticmethod
    def best_diagonal(hits: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
        """The hits of the band of diagonals, a quarter of the item wide, that holds most distinct item windows."""
        hits = sorted(hits, key=lambda x: (x[1] - x[0], x[0]))
        best: list = []
        low, inside, most = 0, Counter(), 0
        for k, (i, j) in enumerate(hits):
            inside[i] += 1
            while j - i - (hits[low][1] - hits[low][0]) > length // 4:
                inside[hits[low][0]] -= 1
                inside += Counter()
                low += 1
            if len(inside) > most:
                most, best = len(inside), [low, k + 1]
        return hits[best[0] : best[1]]

    @staticmethod
    def slots(item_ids, item_words, ids, raw, at, found, size) -> int | None:
        """Item slots with another value in the document; None if the values don't map one to one."""
        pairs = Counter()
        for i, j in found:
            for k in range(size):
                if item_ids[i + k] in SLOT:
                    pairs[i + k, item_words[i + k], bare(raw[at[j + k]]).lower()] += 1
        value: dict[int, tuple[str, str, int]] = {}
        for (slot, a, b), n in pairs.items():
            if slot not in value or n > value[slot][2]:
                value[slot] = (a, b, n)
        there, back = {}, {}
        for a, b, _ in value.values():
            if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                return None
        return sum(a != b for a, b, _ in value.values())


LEAK = "struct<item_id:bigint,share:double,first_word:int,last_word:int,changed_slots:int>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, share: float = 0.8, text_col: str = "text", block_rows: int = 20_000, block_bytes: int = 16 << 20) -> DataFrame:
    """docs with one more column, leaks: for every benchmark item that leaks into the whole text, item_id, share of its windows found,
    its place in words, and how many number, name and unit slots changed. Empty where none does.

    The benchmark is taken in blocks of about block_rows items and block_bytes of text, each of which is broadcast; all
    documents pass all blocks, so any size of benchmark is searched whole. One block's index is in memory at a time: where there are
    several, each is searched by itself, and what leaks is joined back by the hash of the text. Null and empty texts leak nothing; items without
    words, text or id are ignored, of items that share an id the longest text counts. Items of fewer words than the width
    are one window. Rows are never dropped; other columns pass through, except that a column leaks is replaced.
    """
    docs = docs.drop("leaks")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.groupBy("item_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    total = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-total["n"] // block_rows), -(-total["b"] // block_bytes))

    def block(b: int):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        return docs.sparkSession.sparkContext.broadcast(Index(sorted((r["item_id"], r["text"]) for r in rows), width))

    if blocks == 1:
        return search(docs, text_col, block(0), share)
    found = None
    for b in range(blocks):
        index = block(b)
        texts = docs.where(F.col(text_col).isNotNull()).select(text_key(text_col).alias("__t"), F.col(text_col).cast("string").alias("text"))
        held = materialise(search(texts, "text", index, share).where(F.size("leaks") > 0).select("__t", "leaks"), "leaks")
        index.destroy()
        found = held if found is None else found.unionByName(held)
    # rows of equal texts have equal leaks, a list for each block
    by_text = found.groupBy("__t").agg(F.array_sort(F.flatten(F.collect_set("leaks"))).alias("leaks"))
    joined = docs.withColumn("__t", text_key(text_col)).join(by_text, "__t", "left").drop("__t")
    return joined.withColumn("leaks", F.coalesce("leaks", F.expr(f"cast(array() as array<{LEAK}>)")))


def search(docs: DataFrame, text_col: str, index, share: float) -> DataFrame:
    """docs with their leaks from the items of one broadcast index."""
    names, at = docs.columns, docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("changed_slots", pa.int32())]))

    def look(batch: pa.RecordBatch, codes: Codes) -> pa.RecordBatch:
        found = [[dict(zip(("item_id", "share", "first_word", "last_word", "changed_slots"), x, strict=True)) for x in index.value.search(text, codes, share)] for text in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*names, "leaks"])

    return map_arrow(docs, look, f"{fields}, leaks array<{LEAK}>", lambda: Codes(index.value.ids))
