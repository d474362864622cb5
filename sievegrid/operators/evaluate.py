"""Ranking quality against relevance judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_query(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Metrics of every query with judgements: hit_rate and mrr over the whole list, precision (by k), recall and ndcg at k.

    ``qrels(query_id, chunk_id)``; queries with judgements and no results get zeros. Repeated chunks of a ranking count at their first rank
    for precision, recall is cut before it is made unique.
    """
    rel = qrels.distinct()
    size = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = ranking.select("query_id", "chunk_id", "rank").join(rel, ["query_id", "chunk_id"], "left_semi").groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    near = F.col("rank") <= k
    agg = hits.groupBy("query_id").agg(
        F.min("rank").alias("first"),
        F.count(F.when(near, 1)).alias("n_hit"),
        F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    j = size.join(agg, "query_id", "left")
    zero = F.lit(0.0)
    return j.select(
        "query_id",
        F.when(F.col("first").isNull(), 0.0).otherwise(1.0).alias("hit_rate"),
        F.coalesce(1 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("n_hit") / k, zero).alias("precision"),
        F.coalesce(F.col("n_hit") / F.col("n_rel"), zero).alias("recall"),
        F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"),
    )


METRICS = ("hit_rate", "mrr", "precision", "recall", "ndcg")


def aggregate(metrics: DataFrame) -> DataFrame:
    """Means over queries; a missing metric counts as 0."""
    return metrics.agg(F.count("*").alias("n_queries"), *[F.avg(F.coalesce(m, F.lit(0.0))).alias(m) for m in METRICS])


def strict_means(metrics: DataFrame) -> DataFrame:
    """Means over queries; no queries, or a query without one of the metrics, are an error."""
    def mean(m: str):
        return F.when((F.count("*") == 0) | (F.count(m) < F.count("*")), F.raise_error(F.lit(f"{m}: no queries, or queries without it"))).otherwise(F.avg(m))

    return metrics.agg(*[mean(m).alias(m) for m in METRICS])


def success_rates(outcomes: DataFrame) -> DataFrame:
    """Of ``outcomes(got, judged)``, one row a query: the share with results, and the share with results that can be judged."""
    return outcomes.agg(
        F.count("*").alias("n_queries"),
        F.avg(F.col("got").cast("double")).alias("retrieval_success_rate"), F.avg((F.col("got") & F.col("judged")).cast("double")).alias("evaluation_success_rate"),
    )


def same_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(query_id, same)``: whether two rankings hold the same chunks for a query."""
    x, y = (r.select("query_id", "chunk_id").distinct().withColumn(c, F.lit(1)) for r, c in ((a, "x"), (b, "y")))
    j = x.join(y, ["query_id", "chunk_id"], "full")
    return j.groupBy("query_id").agg((F.count("x") == F.count("*")) & (F.count("y") == F.count("*"))).toDF("query_id", "same")


def composite(parts: Sequence[DataFrame]) -> DataFrame:
    """``(query_id, metric, value)`` of several tables of metrics by query; of a metric in several of them the last counts. A query without any metric has no row."""
    if not parts:
        raise ValueError("no metrics to merge")
    out = None
    for i, p in enumerate(parts):
        names = [c for c in p.columns if c != "query_id"]
        long = p.select("query_id", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))).withColumn("at", F.lit(i))
        out = long if out is None else out.unionByName(long)
    return out.where("value is not null").groupBy("query_id", "metric").agg(F.max_by("value", "at").alias("value"))


#: Names that the id of a record may go by, the first one wins.
ID_FIELDS = ("id", "chunk_id", "document_id", "doc_id")


def record_ids(c) -> Column:
    """The ids of a JSON array of records, plain strings or objects with one of ``ID_FIELDS``, in order; an entry without an id is an error, null has no ids."""
    entries = F.from_json(c, "array<string>")

    def ident(x: Column) -> Column:
        found = F.coalesce(*[F.get_json_object(x, f"$.{f}") for f in ID_FIELDS])
        return F.when(~F.startswith(F.ltrim(x), F.lit("{")), x).when(found.isNotNull(), found).otherwise(F.raise_error(F.lit("a record without an id")))

    return F.coalesce(F.transform(entries, ident), F.array().cast("array<string>"))


def compare(before: DataFrame, after: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """How many queries improved, stayed or degraded, by metric."""
    b = before.select("query_id", F.stack(F.lit(len(METRICS)), *[x for m in METRICS for x in (F.lit(m), F.col(m))]).alias("metric", "x"))
    a = after.select("query_id", F.stack(F.lit(len(METRICS)), *[x for m in METRICS for x in (F.lit(m), F.col(m))]).alias("metric", "y"))
    d = F.col("y") - F.col("x")
    return b.join(a, ["query_id", "metric"]).groupBy("metric").agg(
        F.count(F.when(d > tolerance, 1)).alias("improved"), F.count(F.when(F.abs(d) <= tolerance, 1)).alias("unchanged"), F.count(F.when(d < -tolerance, 1)).alias("degraded"), F.avg(d).alias("mean_delta")
    )


def expected_ranks(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """The rank of every judged chunk, null where it was not retrieved; of a repeated chunk the last rank."""
    last = ranking.groupBy("query_id", "chunk_id").agg(F.max("rank").alias("rank"))
    return qrels.distinct().join(last, ["query_id", "chunk_id"], "left")


def gates(aggregated: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``(metric, value, threshold, passed)`` for each threshold."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(t)).alias("threshold")) for m, t in thresholds.items()])
    return aggregated.select(F.inline(rows)).withColumn("passed", F.col("value") >= F.col("threshold"))
