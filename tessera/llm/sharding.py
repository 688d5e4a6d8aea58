"""Sharding by extendible hashing.

A directory maps hash prefixes to shards. It starts with one bucket; a bucket over the byte limit splits on the next bit of
the hash, and only such buckets do, until every bucket fits, so shards have prefixes of different lengths. A round takes the eight
bits (two hexadecimal digits) that follow: bytes of the open buckets are summed by those bits, 256 cells at most a bucket, and each
bucket is split within its own cells. Cells whose bucket still has too many bytes after eight splits are the next round's
buckets; rows of buckets that are closed take no more part. Bits that all open buckets have in common are passed over.

The hash is the md5 of the key. Rows whose key is equal can't be told apart by it; where such rows are too many for one shard, the
md5 of their text follows, and where text and key are equal too, their number among the rows that are the same. So a row's
shard hangs on the rows alone, never on their place in the input. A single row over the limit is a shard of its own, marked oversize.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import delete, materialise

#: Hexadecimal digits that a round splits on, and those of a key's hash.
STEP, DIGITS = 2, 32


def hexed(value: Column) -> Column:
    return F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def to_bits(digits: str) -> str:
    return "".join(f"{int(c, 16):04b}" for c in digits)


def split(prefix: str, cells: dict[str, tuple[int, int]], limit: int, step: int = STEP) -> list[tuple[str, str, int, str]]:
    """Split a bucket: (cell, shard, bytes of the shard, state) of its cells {digits: (bytes, rows)}; state is closed, oversize, or open for a cell that needs more bits."""
    out, base = [], to_bits(prefix)
    numbered = sorted((int(digits, 16), digits, *sums) for digits, sums in cells.items())

    def cut(members: list, bits: str, width: int) -> None:
        total, rows = sum(m[2] for m in members), sum(m[3] for m in members)
        if total <= limit or rows == 1 or width == 0:
            state = "closed" if total <= limit else "oversize" if rows == 1 else "open"
            out.extend((prefix + m[1], base + bits, total, state) for m in members)
            return
        for bit in (0, 1):
            if half := [m for m in members if m[0] >> width - 1 & 1 == bit]:
                cut(half, bits + str(bit), width - 1)

    cut(numbered, "", 4 * step)
    return out


def halves(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Splits the buckets of (bucket, cell, bytes, rows), which lie together; no more than one bucket's cells are held."""
    held, cells, out = None, {}, []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["cell", "shard", "shard_bytes", "state"])
        out.clear()
        return batch

    for batch in batches:
        for bucket, cell, size, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != held and cells:
                out += split(held, cells, limit)
                cells = {}
                if len(out) > 4096:
                    yield flush()
            held = bucket
            cells[cell[len(bucket) :]] = (size, rows)
    if cells:
        out += split(held, cells, limit)
    if out:
        yield flush()


def directory(ledger: DataFrame, limit: int, start: int, width: int) -> tuple[list[tuple[int, DataFrame]], tuple[int, DataFrame] | None]:
    """The directory of ledger (h: width hexadecimal digits, n_bytes), whose open buckets are told apart by their first start digits.

    Returns (digits, table) pairs of tables (cell, shard, shard_bytes, oversize), one a round that closed a bucket: a row belongs to the shard of the
    one cell that its hash begins with. And, if rows of equal hashes have more than limit bytes, (width, table) of those hashes as (cell).
    """
    closed, opened, at = [], None, start
    while True:
        deep = at + STEP
        rows = ledger
        if opened is not None:  # rows of closed buckets take no more part
            n, table = opened
            rows = rows.withColumn("__cell", F.substring("h", 1, n)).join(table.select(F.col("cell").alias("__cell")), "__cell", "left_semi")
        cells = rows.groupBy(F.substring("h", 1, deep).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("h").alias("low"), F.max("h").alias("high"))
        cells = materialise(cells.withColumn("bucket", F.substring("cell", 1, at)), "cells")

        together = cells.select("bucket", "cell", "bytes", "rows").repartition("bucket").sortWithinPartitions("bucket")
        found = materialise(together.mapInArrow(lambda batches: halves(batches, limit), "cell string, shard string, shard_bytes long, state string"), "split")
        states = {r["state"]: r["count"] for r in found.groupBy("state").count().collect()}
        if states.get("closed", 0) + states.get("oversize", 0):
            closed.append((deep, found.where("state <> 'open'").select("cell", "shard", "shard_bytes", (F.col("state") == "oversize").alias("oversize"))))
        if not states.get("open"):
            return closed, None
        still = found.where("state = 'open'").select("cell")
        if states.get("closed", 0) + states.get("oversize", 0) or opened is not None:
            opened = (deep, still)
        # digits in which the rows of every open bucket agree split nothing
        spread = still.join(cells.select("cell", "low", "high"), "cell").select(F.length(F.regexp_extract(F.concat("low", F.lit("|"), "high"), r"^([^|]*)[^|]*\|\1", 1)).alias("n")).agg(F.min("n")).first()[0]
        if spread >= width:
            return closed, (deep, still)
        if spread > deep:
            opened = (deep, still)
        at = spread


def place(rows: DataFrame, closed: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows with shard, shard_bytes and oversize from the directory, by their column h; those of no closed bucket are left out."""
    out = None
    for digits, table in closed:
        found = rows.withColumn("cell", F.substring("h", 1, digits)).join(table, "cell").drop("cell")
        out = found if out is None else out.unionByName(found)
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """rows, written, with h extended by 16 digits: the row's number among those with an equal h, in no order. Counted a partition first, so no task gets all rows of a hash."""
    parts = materialise(rows.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "same")
    before = parts.groupBy("h", "__part").count().withColumn("__before", F.sum("count").over(Window.partitionBy("h").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    own = parts.withColumn("__own", F.row_number().over(Window.partitionBy("h", "__part").orderBy("__row")) - 1)
    every = own.join(before.drop("count"), ["h", "__part"]).withColumn("h", F.concat("h", F.lower(F.lpad(F.hex(F.col("__own") + F.coalesce("__before", F.lit(0))), 16, "0"))))
    out = materialise(every.drop("__part", "__row", "__own", "__before"), "numbered")
    delete(parts)
    return out


def with_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8 of the text, 0 for null), shard (its hash prefix, a string of 0 and 1), shard_bytes and oversize; columns of these names are replaced.

    Every shard holds at most limit bytes, unless it is one row that alone has more (oversize). Null ids share a key, as
    repeated ids do. The same rows get the same shards under any partitioning; of rows that agree in id and text, which of them goes to which shard is left open.
    """
    docs = docs.drop("n_bytes", "shard", "shard_bytes", "oversize")
    rows = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long"), "h": hexed(F.col(id_col))})
    ledger = materialise(rows.select("h", "n_bytes"), "ledger")
    closed, crowded = directory(ledger, limit, 0, DIGITS)
    parts = [place(rows, closed)] if closed else []
    if crowded:  # equal keys: bits of the text's hash follow
        digits, cells = crowded
        one = rows.withColumn("cell", F.substring("h", 1, digits)).join(cells, "cell", "left_semi").drop("cell").withColumn("h", F.concat("h", hexed(F.col(text_col))))
        closed, crowded = directory(materialise(one.select("h", "n_bytes"), "ledger"), limit, DIGITS, 2 * DIGITS)
        parts += [place(one, closed)] if closed else []
        if crowded:  # equal rows: their number follows
            digits, cells = crowded
            same = numbered(one.withColumn("cell", F.substring("h", 1, digits)).join(cells, "cell", "left_semi").drop("cell"))
            closed, _ = directory(same.select("h", "n_bytes"), limit, 2 * DIGITS, 2 * DIGITS + 16)
            parts.append(place(same, closed))
    out = parts[0] if parts else rows.withColumns({"shard": F.lit(""), "shard_bytes": F.lit(0).cast("long"), "oversize": F.lit(False)})
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.drop("h")


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, n_bytes, shard, shard_bytes, oversize, as with_shards gives them. An empty table gives no rows; other columns are ignored."""
    return with_shards(docs.select(id_col, text_col), limit, id_col, text_col).select(id_col, "n_bytes", "shard", "shard_bytes", "oversize")


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet, a folder for each shard (s and its bits); rows of a shard go to one task, and so one file. Ids may repeat or be null."""
    placed = with_shards(docs, limit, id_col, text_col).drop("n_bytes", "shard_bytes", "oversize")
    placed.withColumn("shard", F.concat(F.lit("s"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)
