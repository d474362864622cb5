"""Fusion of rankings, demotion, reranking and conservative fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieve import top_k


def stacked(rankings: Sequence[DataFrame]) -> DataFrame:
    """All rankings below one another, with ``list_no`` from 0."""
    if not rankings:
        raise ValueError("no rankings to fuse")
    out = None
    for i, r in enumerate(rankings):
        part = r.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), "rank", F.lit(i).alias("list_no"))
        out = part if out is None else out.unionByName(part)
    return out


def rrf(rankings: Sequence[DataFrame], k: int = 60, top: int | None = 10, weights: Sequence[float] | None = None) -> DataFrame:
    """Sum of weight / (k + rank) over the rankings that hold a chunk; a weight of 0 keeps the row with score 0."""
    if weights is not None and (len(weights) != len(rankings) or min(weights) < 0):
        raise ValueError("one weight of at least 0 for each ranking")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in (weights or [1.0] * len(rankings))]), F.col("list_no") + 1)
    return top_k(stacked(rankings).groupBy("query_id", "chunk_id").agg(F.sum(w / (k + F.col("rank"))).alias("score")), top)


def fuse(rankings: Sequence[DataFrame], k: int = 60, top: int | None = 10) -> DataFrame:
    """As ``rrf``, but a query with results from one ranking only keeps that ranking's own scores and order."""
    s = stacked(rankings)
    lists = F.size(F.collect_set("list_no").over(Window.partitionBy("query_id")))
    s = s.withColumn("lists", lists)
    g = s.groupBy("query_id", "chunk_id").agg(F.max("lists").alias("lists"), F.sum(1.0 / (k + F.col("rank"))).alias("fused"), F.max("score").alias("own"), F.min("rank").alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.when(F.col("lists") == 1, F.col("first")).otherwise(0), F.round("fused", 9).desc(), "chunk_id")
    out = g.select("query_id", "chunk_id", F.when(F.col("lists") == 1, F.col("own")).otherwise(F.col("fused")).alias("score"), F.row_number().over(w).alias("rank"))
    return out if top is None else out.where(F.col("rank") <= top)


def interleave(rankings: Sequence[DataFrame], top: int = 10) -> DataFrame:
    """Turn by turn from each ranking, first list first; a chunk already taken uses up its turn."""
    s = stacked(rankings).withColumn("turn", F.struct("rank", "list_no"))
    g = s.groupBy("query_id", "chunk_id").agg(F.min("turn").alias("turn"), F.min_by("score", "turn").alias("score"))
    w = Window.partitionBy("query_id").orderBy("turn")
    return g.select("query_id", "chunk_id", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= top)


def demote(ranking: DataFrame, kinds: DataFrame, weight: float = 0.3, kind: str = "reference") -> DataFrame:
    """Scores of chunks of ``kind`` times ``weight``, ranked again; ``kinds`` is ``(chunk_id, chunk_type)``. A weight of 1 or more changes nothing."""
    if weight >= 1:
        return ranking
    w = max(0.0, weight)
    j = ranking.join(kinds, "chunk_id", "left")
    score = F.when(F.coalesce(F.col("chunk_type") == kind, F.lit(False)), F.col("score") * w).otherwise(F.col("score"))
    return top_k(j.select("query_id", "chunk_id", score.alias("score")), None)


def rerank(ranking: DataFrame, scores: DataFrame, top: int | None = None, recall_safe: bool = False) -> DataFrame:
    """Ordered by ``scores(query_id, chunk_id, rerank_score)``, then by the rank before. Unscored chunks are lost unless ``recall_safe``; then
    they follow behind. Queries with a single result keep it."""
    j = ranking.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).join(scores, ["query_id", "chunk_id"], "left")
    if not recall_safe:
        j = j.where("rerank_score is not null or n = 1")
    w = Window.partitionBy("query_id").orderBy(F.round("rerank_score", 9).desc_nulls_last(), "rank")
    out = j.select("query_id", "chunk_id", F.col("score").alias("original_score"), F.coalesce("rerank_score", "score").alias("score"), F.row_number().over(w).alias("rank"))
    return out if top is None else out.where(F.col("rank") <= top)


def normalised(c: str) -> Column:
    w = Window.partitionBy("query_id")
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(c) - low) / (high - low))


def conservative(ranking: DataFrame, scores: DataFrame, weight: float = 0.5, top: int = 10) -> DataFrame:
    """weight * normalised score + (1 - weight) * normalised rerank score, min-max within the query; missing rerank scores count 0."""
    a = ranking.select("query_id", "chunk_id", normalised("score").alias("a"))
    b = scores.join(ranking, ["query_id", "chunk_id"], "left_semi").select("query_id", "chunk_id", normalised("rerank_score").alias("b"))
    j = a.join(b, ["query_id", "chunk_id"], "left")
    return top_k(j.select("query_id", "chunk_id", (weight * F.col("a") + (1 - weight) * F.coalesce("b", F.lit(0.0))).alias("score")), top)
