"""Inverted index: term frequencies, statistics, merges and removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_tokens


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """``(collection, term, chunk_id, tf, dl)`` of ``chunks(collection, chunk_id, text)``; chunks without a term have no rows.

    The chunk length rides along with the exploded terms, so one aggregation with map-side combine gives postings without a join. Terms are exploded with their
    nulls, which are dropped behind it: a plain explode would have the optimizer test for empty arrays first, and so take the texts apart twice more in the scan.
    """
    t = chunks.select("collection", "chunk_id", index_tokens("text").alias("terms"))
    t = t.select("collection", "chunk_id", F.size("terms").cast("long").alias("dl"), F.explode_outer("terms").alias("term")).where("term is not null")
    return t.groupBy("collection", "term", "chunk_id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def chunk_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("collection", "chunk_id").agg(F.max("dl").alias("doc_length"), F.count("*").alias("unique_terms"))


def corpus_stats(postings: DataFrame) -> DataFrame:
    c = chunk_stats(postings)
    return c.groupBy("collection").agg(F.count("*").alias("num_docs"), F.avg("doc_length").alias("avg_doc_length"), F.sum("unique_terms").alias("n_postings"))


def stats_of_chunks(chunks: DataFrame) -> DataFrame:
    """``corpus_stats`` straight from the texts: one row a chunk is made where it is read, so no postings are shuffled for it."""
    t = chunks.select("collection", index_tokens("text").alias("terms"))
    t = t.select("collection", F.size("terms").alias("n"), F.size(F.array_distinct("terms")).cast("long").alias("u"))
    some = F.col("n") > 0  # tested behind the reading, as in term_frequencies
    each = t.groupBy("collection").agg(F.count(F.when(some, 1)).alias("num_docs"), F.avg(F.when(some, F.col("n"))).alias("avg_doc_length"), F.sum(F.when(some, F.col("u"))).alias("n_postings"))
    return each.where("num_docs > 0")


def idf(n: Column, df: Column) -> Column:
    """May be negative where a term is in more than half of the chunks."""
    return F.log((n - df + 0.5) / (df + 0.5))


def term_stats(postings: DataFrame) -> DataFrame:
    """``(collection, term, df, idf)``; the statistics of a collection are one row each and joined to its terms."""
    df = postings.groupBy("collection", "term").agg(F.count("*").alias("df"))
    return df.join(corpus_stats(postings).select("collection", "num_docs"), "collection").select("collection", "term", "df", idf(F.col("num_docs"), F.col("df")).alias("idf"))


def merge_postings(old: DataFrame, new: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """The old index with the chunks of ``new`` replaced, and without those of ``touched(chunk_id)`` that are not in ``new``: chunks that were deleted or lost their terms.
    A chunk belongs to one collection at a time."""
    ids = new.select("chunk_id")
    ids = (ids if touched is None else ids.unionByName(touched.select("chunk_id"))).distinct()
    return old.join(ids, "chunk_id", "left_anti").select(*old.columns).unionByName(new)


def remove_by_prefix(postings: DataFrame, prefix: str) -> DataFrame:
    return postings.where(~F.col("chunk_id").startswith(prefix))


def remove_documents(postings: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Without the chunks of ``doc_ids(doc_id)``: chunk ids are the document id, an index and a hash joined by ``_``."""
    owner = F.regexp_extract("chunk_id", r"^(.*)_\d{4,}_[0-9a-fA-F]{8}$", 1)
    return postings.withColumn("doc_id", owner).join(doc_ids, "doc_id", "left_anti").drop("doc_id")
