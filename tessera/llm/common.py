"""What the training-data operators share: shared work folders, word splitting, Arrow plumbing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tessera.tables import load

#: Rows of a batch that are turned into Python objects at a time; bounds a worker's memory on long texts.
SLICE = 256
#: Rows of a batch between the JVM and Python.
BATCH_ROWS = 512
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where that is unset, a temporary one in local mode, as in tests, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("tessera.work.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="tessera-work-")
            spark.conf.set("tessera.work.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. batch_rows: rows that Python gets at a time meanwhile."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(RECORDS)
    if batch_rows:
        spark.conf.set(RECORDS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(RECORDS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialised_at = path
    return out


def delete(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.materialised_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished queries.

    Spark frees shuffle files when the driver collects the objects that stand for them, which may be long after; asking for a
    collection keeps the disk that a chain of large shuffles needs to about one of them.
    """
    for _ in range(2):  # what the first collection frees may hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again, and free finished shuffles."""
    delete(*tables)
    free(tables[0].sparkSession)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents and pages, if they come in fewer splits than there are cores, dealt out to all of them."""
    return load(spark, sf_dir, name)


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session that hands Python at most BATCH_ROWS rows at a time, so that batches of long texts fit in memory."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(RECORDS)) <= BATCH_ROWS:
        conf.set(RECORDS, str(BATCH_ROWS))
    return df


def map_arrow(df: DataFrame, per_slice: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, setup: Callable | None = None) -> DataFrame:
    """mapInArrow over slices of at most SLICE rows. With setup, per_slice also gets what setup() returned, made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = per_slice(batch.slice(at, SLICE), *state)
                if out is not None and out.num_rows:
                    yield out

    return bounded(df).mapInArrow(run, schema)


class HashCache(dict):
    """Word (bytes) -> 64-bit hash; emptied when full, so its memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def ascii_lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; bytes.lower and bytes.split touch ASCII alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words(text: str | None) -> list[bytes]:
    """UTF-8 words [^\\x20\\x09-\\x0D]+."""
    return (text or "").encode("utf-8", "surrogatepass").split()
