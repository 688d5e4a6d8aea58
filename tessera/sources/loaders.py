"""Reading and writing documents: (doc_id, content, source, filename, file_type, created_at, metadata map)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions of text files and the types they stand for.
FILE_TYPES = {"txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "log": "text/plain", "json": "application/json", "csv": "text/csv", "html": "text/html"}
ALL_EXTENSIONS = tuple(FILE_TYPES)


def file_type(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    out = F.lit("text/plain")
    for e, kind in FILE_TYPES.items():
        out = F.when(extension == e, F.lit(kind)).otherwise(out)
    return out


def load_texts(spark: SparkSession, path: str, extensions: tuple[str, ...] = ALL_EXTENSIONS, recursive: bool = False, trim: bool = True, metadata: dict[str, str] | None = None) -> DataFrame:
    """A row a file below path (a file or a folder); with trim, empty files give none. metadata entries come last and so win."""
    reader = spark.read.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").option("recursiveFileLookup", str(recursive).lower())
    raw = reader.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_modification_time").alias("created_at"))
    return described(raw, trim, metadata)


def described(raw: DataFrame, trim: bool, metadata: dict[str, str] | None) -> DataFrame:
    content = F.regexp_replace("content", r"^\s+|\s+$", "") if trim else F.col("content")
    out = raw.withColumn("content", content)
    if trim:
        out = out.where("content <> ''")
    own = F.create_map(F.lit("source"), F.col("source"), F.lit("filename"), F.col("filename"))
    extra = F.create_map(*(F.lit(x) for kv in (metadata or {}).items() for x in kv)) if metadata else None
    merged = own if extra is None else F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(*metadata)), extra)
    return out.select(F.sha2(F.concat_ws("\0", "source", "content"), 256).alias("doc_id"), "content", "source", "filename", file_type(F.col("filename")).alias("file_type"), "created_at", merged.alias("metadata"))


def load_markdown(spark: SparkSession, path: str, recursive: bool = True, **options) -> DataFrame:
    """Markdown and text files; all are markdown."""
    return load_texts(spark, path, ("md", "txt"), recursive, **options).withColumn("file_type", F.lit("markdown"))


def inline(spark: SparkSession, texts: list[str], metadata: dict[str, str] | None = None) -> DataFrame:
    """Documents from texts that are already here."""
    raw = spark.createDataFrame([(t,) for t in texts], "content string").select("content", F.lit("inline").alias("source"), F.lit("inline.txt").alias("filename"), F.current_timestamp().alias("created_at"))
    return described(raw, True, metadata)


CORPUS = T.StructType([T.StructField("id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("metadata", T.StructType([T.StructField("title", T.StringType()), T.StructField("category", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("section", T.StringType()), T.StructField("tenant_id", T.StringType()), T.StructField("department", T.StringType()), T.StructField("file_type", T.StringType()), T.StructField("document_type", T.StringType()), T.StructField("created_at", T.StringType()), T.StructField("access_level", T.IntegerType()), T.StructField("is_public", T.BooleanType()), T.StructField("language", T.StringType())]))])


def load_corpus(spark: SparkSession, path: str, schema: T.StructType = CORPUS) -> DataFrame:
    """A JSON array of {id, content, metadata}; the schema is given, never inferred."""
    return spark.read.schema(schema).json(path, multiLine=True)


def upsert(current: DataFrame, fresh: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """current with the rows of fresh in place of those with their keys; of fresh rows that share a key, the last by order (or any column values) stays."""
    best = fresh.groupBy(key).agg(F.max_by(F.struct(*fresh.columns), F.struct(*([order] if order else [c for c in fresh.columns if not isinstance(fresh.schema[c].dataType, T.MapType)]))).alias("r")).select("r.*")
    return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(best)


def delete(current: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return current.join(gone.select(key), key, "left_anti")


def save_index(tables: dict[str, DataFrame], path: str, config: dict | None = None, version: str = "1.0.0") -> None:
    """Write an index's tables as Parquet below path, and its config as one JSON row."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(json.dumps({"version": version, "config": config or {}, "tables": sorted(tables)})).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/_config")


def load_index(spark: SparkSession, path: str, version: str = "1.0.0") -> tuple[dict[str, DataFrame], dict]:
    """(tables, config) as save_index wrote them; another version is an error."""
    head = json.loads(spark.read.text(f"{path}/_config").first()[0])
    if head["version"] != version:
        raise ValueError(f"index version {head['version']}, expected {version}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in head["tables"]}, head["config"]


def save_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings in folders by a hash of the term, so that a query reads only its terms' buckets."""
    postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_postings(spark: SparkSession, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """The postings of terms; partitions are pruned before anything is read."""
    wanted = spark.range(1).select(F.array_distinct(F.array(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in terms)))).first()[0]
    return spark.read.parquet(path).where(F.col("bucket").isin(*wanted)).where(F.col("term").isin(*terms)).drop("bucket")


def snippets(df: DataFrame, id_col: str, text_col: str, length: int = 100) -> DataFrame:
    return df.select(id_col, F.substring(text_col, 1, length).alias("snippet"), F.length(text_col).alias("n_chars"))
