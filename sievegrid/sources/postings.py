"""A stored inverted index that grows by deltas: postings by collection and term bucket, chunk lengths beside them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import term_frequencies
from ..operators.retrieve import bm25
from ..operators.versions import live_rows
from ..session import materialize

_POSTINGS = "term string, chunk_id string, tf bigint, dl bigint, version int, collection string, bucket int"
_TOUCHED = "chunk_id string, at timestamp_ntz, version int"
_MANIFEST = "version int, buckets int, tag string"


@dataclass
class StoredIndex:
    """``postings(collection, bucket, term, chunk_id, tf, dl)`` of the chunks as they are now, and the statistics of their collections."""

    postings: DataFrame
    stats: DataFrame
    buckets: int
    version: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str) -> list:
    """One row a delta: the list of loads, not of data."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifest").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def append_index(postings: DataFrame, touched: DataFrame, path: str, tag: str = "", buckets: int = 16) -> bool:
    """Adds the postings of new chunk texts as a delta. ``touched(chunk_id, at)`` are all chunks the load says anything about, with the time of
    what it says: chunks without postings among them are deleted. A load arriving late does not replace a later one.

    The manifest is written last, so a delta cut off by a failure is never read; a ``tag`` that is already in it writes nothing, so a batch that is
    repeated counts once. The number of buckets is that of the first delta. Large buckets are split over several files.
    """
    spark = postings.sparkSession
    known = _manifest(spark, path)
    if tag and any(m.tag == tag for m in known):
        return False
    version = max((m.version for m in known), default=0) + 1
    buckets = known[0].buckets if known else buckets
    laid = postings.select("term", "chunk_id", "tf", "dl", F.lit(version).alias("version"), "collection", _bucket(buckets).alias("bucket"))
    laid = laid.hint("rebalance", "collection", "bucket").sortWithinPartitions("collection", "bucket", "term")
    laid.write.mode("overwrite").partitionBy("collection", "bucket").parquet(f"{path}/postings/v{version}")
    lengths = spark.read.schema(_POSTINGS).parquet(f"{path}/postings/v{version}").select("collection", "chunk_id", "dl", "version").distinct()
    lengths.write.mode("overwrite").parquet(f"{path}/lengths/v{version}")
    named = touched.groupBy("chunk_id").agg(F.max(F.col("at").cast("timestamp_ntz")).alias("at")).withColumn("version", F.lit(version))
    named.write.mode("overwrite").parquet(f"{path}/touched/v{version}")
    spark.range(1).select(F.lit(version).alias("version"), F.lit(buckets).alias("buckets"), F.lit(tag).alias("tag")).write.mode("append").json(f"{path}/manifest")
    return True


def read_index(spark: SparkSession, path: str) -> StoredIndex:
    """The index at ``path``; a folder without a manifest, or with postings of another form, is an error."""
    known = _manifest(spark, path)
    if not known:
        raise ValueError(f"no index at {path}")
    versions = sorted(m.version for m in known)
    folders = {kind: [f"{path}/{kind}/v{v}" for v in versions] for kind in ("postings", "lengths", "touched")}
    for folder in folders["postings"]:
        try:
            have = set(spark.read.parquet(folder).columns)
        except AnalysisException as e:
            if "UNABLE_TO_INFER_SCHEMA" in str(e):  # a delta of deletions only
                continue
            raise ValueError(f"{folder} is not there") from e
        if not {"term", "chunk_id", "tf", "dl", "version"} <= have:
            raise ValueError(f"{folder} holds no postings")
    touched = spark.read.schema(_TOUCHED).parquet(*folders["touched"])
    last = touched.groupBy("chunk_id").agg(F.max(F.struct("at", "version")).alias("s")).select("chunk_id", F.col("s.version").alias("version"))
    parts = [spark.read.schema(_POSTINGS).parquet(f) for f in folders["postings"]]
    postings = parts[0]
    for p in parts[1:]:
        postings = postings.unionByName(p)
    lengths = spark.read.schema("collection string, chunk_id string, dl bigint, version int").parquet(*folders["lengths"]).join(last, ["chunk_id", "version"])
    stats = lengths.groupBy("collection").agg(F.count("*").alias("num_docs"), F.avg("dl").alias("avg_doc_length"))
    return StoredIndex(postings.join(last, ["chunk_id", "version"], "left_semi").drop("version"), stats, known[0].buckets, versions[-1])


def compact_index(spark: SparkSession, path: str, target: str) -> None:
    """The index at ``path`` as one delta in the new folder ``target``."""
    idx = read_index(spark, path)
    kept = materialize(idx.postings, "postings")
    at = spark.read.schema(_TOUCHED).parquet(*[f"{path}/touched/v{m.version}" for m in _manifest(spark, path)])
    append_index(kept, at.select("chunk_id", "at"), target, buckets=idx.buckets)


def stored_bm25(queries: DataFrame, idx: StoredIndex, k: int = 10) -> DataFrame:
    """BM25 of ``queries(query_id, collection, keywords)`` on a stored index. The asked terms name their buckets, which are folders, so the scan of
    the postings can leave out the others; the texts of the chunks are not read."""
    wanted = queries.select("collection", F.explode("keywords").alias("term")).distinct().withColumn("bucket", _bucket(idx.buckets))
    return bm25(queries, idx.postings.join(wanted, ["collection", "bucket", "term"], "left_semi").drop("bucket"), k, stats=idx.stats)


def index_stream(stream: DataFrame, path: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Keeps the index at ``path`` up to date with a stream of chunk rows ``(chunk_id, collection, text, loaded_at, deleted_at)``, until the input is used up."""

    def write(batch: DataFrame, n: int) -> None:
        rows = materialize(batch.select("chunk_id", "collection", "text", "loaded_at", "deleted_at"), "batch")
        postings = term_frequencies(live_rows(rows, ["chunk_id"]))
        append_index(postings, rows.select("chunk_id", F.col("loaded_at").alias("at")), path, tag=f"{checkpoint}#{n}", buckets=buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
