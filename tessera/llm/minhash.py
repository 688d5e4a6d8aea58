"""Near duplicates by MinHash with a multi-index Hamming join.

Every document's set of word shingles gives a signature of `positions` MinHash values of `bits` bits. Two sets of
similarity s differ in a position with chance 1 - s, so the distance threshold is the smallest d with
P(Binomial(positions, 1 - s) > d) <= miss: pairs of at least that similarity lie within it but for that chance. The
signature is split into chunks; with `errors` errors allowed in each, the pigeonhole principle has every pair within the
threshold agree up to `errors` positions in some chunk. Those errors are enumerated: a chunk gives a key for each set of
positions left out, and pairs meet on equal keys. Candidates are confirmed on the full sets.

Equal sets are one representative from the start, so copies are never paired. In a bucket, all members meet its smallest
one first, which links large groups with as many pairs as members. Only buckets whose members are then still of several
components are looked at again: there members outside the component of the smallest meet those of the other components,
if a prefix of their shingles shows that they may be similar; before that, where they are many, all members meet a few of them. So no link between components is lost and none inside one is made twice.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import HashCache, ascii_lower_words, delete, discard, map_arrow, materialise
from tessera.llm.components import components

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Rounds in which sets of crowded buckets meet so many that agree with them in more positions, the pairs of different components a member that make a bucket
#: crowded, and the pairs a link at which rounds end. The rest is paired up whatever they leave.
HUB_ROUNDS, HUBS, PAIRS_A_MEMBER, LEAST_LINKED = 3, 3, 4, 10


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int, hashes: HashCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle, one without words none."""
    found = ascii_lower_words(text)
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    size = min(width, n)
    h = np.full(n - size + 1, np.uint64(size))
    for k in range(size):
        h = mix(h * M1 + w[k : n - size + 1 + k])
    return np.unique(h)


class Scheme:
    """Positions, threshold, chunks and the keys of a signature."""

    def __init__(self, similarity: float, positions: int = 64, bits: int = 16, errors: int = 1, miss: float = 1e-5):
        self.positions, self.bits, self.errors = positions, bits, errors
        p, tail, d = 1 - similarity, 1.0, -1
        while tail > miss and d < positions:
            d += 1
            tail -= comb(positions, d) * p**d * (1 - p) ** (positions - d)
        self.threshold = d
        n_chunks = d // (errors + 1) + 1  # more than threshold / (errors + 1), so one chunk has at most `errors`
        self.chunks = [c for c in np.array_split(np.arange(positions), n_chunks) if len(c)]
        if min(map(len, self.chunks)) <= errors:
            raise ValueError("too few positions for this similarity: a chunk would be left without any")
        self.keys = [np.array([x for x in c if x not in set(out)]) for c in self.chunks for out in combinations(c.tolist(), errors)]
        random = np.random.RandomState(20240229)
        self.a = random.randint(0, 2**63, positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = random.randint(0, 2**63, positions, dtype=np.uint64)

    def signature(self, h: np.ndarray) -> np.ndarray:
        """`positions` values of `bits` bits (uint16) of a set that isn't empty."""
        low = np.full(self.positions, np.iinfo(np.uint64).max)
        for at in range(0, len(h), 4096):
            low = np.minimum(low, (h[at : at + 4096, None] * self.a + self.b).min(axis=0))
        return (mix(low) & np.uint64(2**self.bits - 1)).astype(np.uint16)

    def bucket_keys(self, signatures: np.ndarray) -> np.ndarray:
        """A 64-bit key for each row of signatures and each way to leave `errors` positions out of a chunk."""
        return np.stack([self.hashed(signatures, kept, j) for j, kept in enumerate(self.keys)], axis=1)

    @staticmethod
    def hashed(signatures: np.ndarray, kept: np.ndarray, j: int) -> np.ndarray:
        """The j-th key: a hash of j and the values of the positions kept."""
        h = np.full(len(signatures), np.uint64(j + 1))
        for x in kept:
            h = mix(h * M1 + signatures[:, x].astype(np.uint64))
        return h

    def close_keys(self, signatures: np.ndarray, turn: int, keys: int = 32, kept: int = 8) -> np.ndarray:
        """For each row of signatures, so many 64-bit keys of some positions each, other ones each turn. Similar sets share several of them; they select no candidates of their own."""
        random = np.random.RandomState(turn)
        return np.stack([self.hashed(signatures, random.permutation(self.positions)[:kept], j) for j in range(keys)], axis=1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def text_key(text_col: str) -> Column:
    """Tells the texts of rows apart: the md5 of the text in 16 bytes, null for null."""
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


def linked_sets(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme | None = None) -> DataFrame:
    """A row a document: id (long), t (its text_key), n_shingles, component (a number for the sets reachable from its own over links; null without words).

    Every distinct set has a number of its own, whatever ids its documents have, so rows that share an id are judged each by its own text.
    """
    scheme = scheme or Scheme(percent / 100)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("t"), F.col(text_col).cast("string").alias("text"))

    def sketch(batch: pa.RecordBatch, hashes: HashCache) -> pa.RecordBatch:
        sizes, prints, signatures = [], [], []
        for text in batch.column(2).to_pylist():
            h = shingles(text, width, hashes)
            sizes.append(len(h))
            prints.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            signatures.append(scheme.signature(h).tobytes() if len(h) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())], ["id", "t", "n_shingles", "print", "signature"])

    sets = materialise(map_arrow(chosen, sketch, "id long, t binary, n_shingles long, print binary, signature binary", HashCache), "sets")
    # a set's number is fixed once the table is written; its text is that of the smallest (id, t)
    distinct = sets.where("print is not null").groupBy("print").agg(F.min(F.struct("id", "t")).alias("at"), F.first("signature").alias("signature"))
    reps = materialise(distinct.select("print", F.monotonically_increasing_id().alias("rep"), "at.id", "at.t", "signature"), "reps")

    def keys_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        keys = scheme.bucket_keys(signatures).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1]))], ["key", "rep"])

    all_keys = map_arrow(reps.select("rep", "signature"), keys_of, "key long, rep long")
    shared = all_keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key", "low")
    buckets = materialise(all_keys.join(shared, "key"), "buckets")

    wanted = reps.select("rep", "id", "t").join(buckets.select("rep").distinct(), "rep").alias("w")
    held = chosen.alias("c").join(wanted, F.col("c.id").eqNullSafe(F.col("w.id")) & (F.col("c.t") == F.col("w.t")))
    texts = materialise(held.select("w.rep", "c.text"), "texts")
    if texts.groupBy("rep").count().where("count > 1").limit(1).count():  # rows that agree in id and text
        twice, texts = texts, materialise(texts.groupBy("rep").agg(F.first("text").alias("text")), "texts")
        delete(twice)

    def confirm(pairs: DataFrame, texts: DataFrame = texts) -> DataFrame:
        def run(batch: pa.RecordBatch, state: list) -> pa.RecordBatch:
            ids_a, ids_b, texts_a, texts_b = (batch.column(k) for k in range(4))
            yes = []
            for k in range(batch.num_rows):
                a = texts_a[k].as_py()
                if state[1] != a:
                    state[1:] = [a, shingles(a, width, state[0])]
                yes.append(similar(state[2], shingles(texts_b[k].as_py(), width, state[0]), percent))
            return pa.RecordBatch.from_arrays([ids_a, ids_b], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

        met = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
        return materialise(map_arrow(met.select("a", "b", "text_a", "text_b"), run, "a long, b long", lambda: [HashCache(), None, None]), "links")

    first = confirm(buckets.groupBy("rep").agg(F.min("low").alias("low")).where("low < rep").select(F.col("low").alias("a"), F.col("rep").alias("b")))
    labels = components(first)

    def opened(held: DataFrame) -> DataFrame:
        """(key, rep, component) of the buckets of held whose members are of several components."""
        named = held.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        several = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        return materialise(named.join(several, "key"), "open")

    joined = lambda links: components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
    members = opened(buckets)
    # where buckets hold many more pairs of different components than members, their members meet a few that agree with them in more positions: near copies come together without being paired up
    counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own"))
    crowd = materialise(members.join(counts.where(f"`all` * `all` - own > {2 * PAIRS_A_MEMBER} * `all`").select("key"), "key").select("rep").distinct().join(reps.select("rep", "signature"), "rep"), "crowd")
    some = materialise(texts.join(crowd.select("rep"), "rep"), "some")
    for turn in range(HUB_ROUNDS):

        def closer(batch: pa.RecordBatch, turn: int = turn) -> pa.RecordBatch:
            signatures = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keys = scheme.close_keys(signatures, turn).view(np.int64)
            rep, component = (pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), keys.shape[1])) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), rep, component], ["key", "rep", "component"])

        named = crowd.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "signature")
        close = map_arrow(named, closer, "key long, rep long, component long")
        hubs = close.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("o"), F.col("rep").alias("hub"), F.col("component").alias("other"))).alias("low")).select("key", "low.hub", "low.other")
        shared = close.join(hubs, "key").where("component <> other").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        best = shared.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "hub")), False), 1, HUBS).alias("best")).select("rep", F.explode("best.hub").alias("hub"))
        meeting = materialise(best.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "meeting")
        links = confirm(meeting, some)
        found, asked = links.count(), meeting.count()
        labels = joined(links) if found else labels
        delete(meeting, links)
        if found * LEAST_LINKED <= asked:
            break
    old, members = members, opened(members)
    discard(old, crowd, some)
    rest = materialise(members.select("rep", "component").distinct(), "rest")

    def rows_of(batch: pa.RecordBatch, hashes: HashCache) -> pa.RecordBatch:
        sets_of = [shingles(t, width, hashes) for t in batch.column(1).to_pylist()]
        sets_of = [np.unique(h.astype(np.uint32)) for h in sets_of]  # 32 bits each do: shingles that fall together only add candidates
        sizes = np.array([len(h) for h in sets_of], np.int64)
        rep, component = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), sizes) for k in (0, 2))
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(component), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets_of).view(np.int32))], ["rep", "component", "n", "shingle"])

    # of two sets that similar, ordered by one rule, the first n - ceil(percent / 100 * n) + 1 shingles of each have one in common
    exploded = materialise(map_arrow(texts.join(rest, "rep"), rows_of, "rep long, component long, n long, shingle int", HashCache), "shingles")
    common = exploded.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ranked = exploded.join(common, "shingle").withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle")))
    loose = percent - 1  # sizes of 32-bit sets may be a little too small
    length = F.col("n") - F.expr(f"(n * {loose} + 99) div 100") + 1
    head = ranked.where(F.col("at") <= length).groupBy("rep", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("head"))
    head = head.select("rep", "component", "n", length.alias("m"), F.transform(F.filter("head", lambda x: x["df"] > 1), lambda x: x["shingle"]).alias("head"))
    prefix = materialise(head.where(F.size("head") > 0).select("rep", "component", "n", "m", "head"), "prefix")
    postings = lambda k: prefix.select(F.explode("head").alias("shingle"), F.col("rep").alias(k), *(F.col(c).alias(c[0] + k) for c in ("component", "n", "m", "head")))
    alike = f"least(na, nb) * 100 >= greatest(na, nb) * {loose}"
    # only if what their prefixes share and what may follow is enough
    enough = f"(na + nb) * {loose}L <= {100 + loose}L * (size(array_intersect(ha, hb)) + greatest(na - ma, nb - mb))"
    # every pair of different components that is left; a pair is made at its first common shingle alone
    pairs = materialise(postings("a").join(postings("b"), "shingle").where("a < b and ca <> cb").where(alike).where("element_at(array_intersect(ha, hb), 1) = shingle").where(enough).select("a", "b"), "pairs")
    second = confirm(pairs)
    discard(texts, buckets, members, rest, exploded, prefix, pairs)
    if second.limit(1).count():
        labels = joined(second)

    by_print = reps.select("print", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    return sets.select("id", "t", "n_shingles", "print").join(by_print, "print", "left").select("id", "t", "n_shingles", "component")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme | None = None) -> DataFrame:
    """A row a document: id, n_shingles, component_id (smallest id reachable over links, its own included), kept (it is that one).

    Links: shingle sets (lower-cased A-Z, words [^\\x20\\x09-\\x0D]+, whole texts) with 100 * intersection >= percent * union.
    Documents without words (null and empty texts too) have an empty set and no links. Rows that share an id are linked by
    their own texts alone and may so differ in component_id. A row without id links as any other; its component_id is null and it is
    kept only if no id is reachable from it. An empty table gives no rows; other columns are ignored.
    """
    found = materialise(linked_sets(docs, width, percent, id_col, text_col, scheme), "linked")
    least = found.where("component is not null").groupBy("component").agg(F.min("id").alias("low"))
    named = found.join(least, "component", "left").select("id", "n_shingles", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id"))
    return named.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: that with the smallest (id, text_key), ids before nulls; every row without words.

    Rows are judged by their own texts, also where they share an id. Of rows that agree in id and text one stays, with the other columns of any of them.
    """
    found = materialise(linked_sets(docs, width, percent, id_col, text_col).where("component is not null").select("id", "t", "component"), "linked")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("best"))
    gone = found.join(best, "component").where("not (id <=> best.id and t = best.t)").select("id", "t").distinct().alias("g")
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__t": text_key(text_col)})
    match = lambda right: F.col("__id").eqNullSafe(F.col(f"{right}.id")) & (F.col("__t") == F.col(f"{right}.t"))
    kept = keyed.join(gone, match("g"), "left_anti")
    twice = found.groupBy("id", "t").count().where("count > 1").select("id", "t")
    if not twice.limit(1).count():
        return kept.select(*docs.columns)
    twice = materialise(twice, "twice").alias("w")
    one = kept.join(twice, match("w"), "left_semi").groupBy("__id", "__t").agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return kept.join(twice, match("w"), "left_anti").select(*docs.columns).unionByName(one)
