"""Rankings: every operator gives ``(query_id, chunk_id, score, rank)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import index_tokens
from ..session import broadcast_if_small, materialize
from .index import corpus_stats, idf


def top_k(scored: DataFrame, k: int | None, score: str = "score") -> DataFrame:
    """Ranks within each query by score to nine places, then id; the limit reaches below the shuffle as a window group limit."""
    w = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), F.col("chunk_id"))
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def bm25(queries: DataFrame, postings: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, stats: DataFrame | None = None) -> DataFrame:
    """BM25 of ``queries(query_id, collection, keywords)`` against the postings of their collection; terms are matched as given.

    Only postings of asked terms are read into the scoring: the query terms are the small side of the first join, what it leaves is written down
    once, and document frequencies are counted on it. ``stats`` are the statistics of the collections where they are stored, else they are counted.
    """
    terms = queries.select("query_id", "collection", F.explode("keywords").alias("term"))
    asked = materialize(postings.join(terms.select("collection", "term").distinct(), ["collection", "term"], "left_semi"), "asked")
    stats = (corpus_stats(postings) if stats is None else stats).select("collection", "num_docs", "avg_doc_length")
    df = asked.groupBy("collection", "term").agg(F.count("*").alias("df")).join(stats, "collection")
    weight = df.select("collection", "term", "avg_doc_length", idf(F.col("num_docs"), F.col("df")).alias("idf"))
    avg = F.when(F.col("avg_doc_length") == 0, 1.0).otherwise(F.col("avg_doc_length"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    hits = asked.join(terms, ["collection", "term"]).join(weight, ["collection", "term"])
    return top_k(hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")), k)


def bm25_of_texts(queries: DataFrame, chunks: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, block: int = 65536, part: int = 32768) -> DataFrame:
    """``bm25`` straight from ``chunks(collection, chunk_id, text)``, one row a chunk, without postings.

    Queries meet far more chunks than there are chunks, as one hit a query and chunk grows with the square of the data, so hits are not shuffled: the texts are taken
    apart once and written down, the queries of a collection are dealt to blocks of about ``block``, its chunks to parts of about ``part``, and each block meets each part in
    one task, which keeps the best ``k`` of a query. All terms of a chunk lie in one part, so its score is whole there. Chunks without an asked term are no
    results; a null collection matches nothing.
    """
    ids = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    terms = materialize(queries.where("collection is not null").select("query_id", "collection", F.explode("keywords").alias("term")), "terms")
    texts = materialize(chunks.select("collection", "chunk_id", index_tokens("text").alias("terms")), "tokens").where("collection is not null and size(terms) > 0")
    stats = texts.groupBy("collection").agg(F.count("*").alias("num_docs"), F.avg(F.size("terms")).alias("avg_doc_length"))
    wanted = broadcast_if_small(materialize(terms.select("collection", "term").distinct(), "wanted"), 60)
    df = texts.select("collection", F.explode(F.array_distinct("terms")).alias("term")).join(wanted, ["collection", "term"], "left_semi").groupBy("collection", "term").agg(F.count("*").alias("df"))
    dealt = terms.groupBy("collection").agg(F.ceil(F.count_distinct("query_id") / block).cast("int").alias("blocks"))
    cells = materialize(stats.join(dealt, "collection").withColumn("parts", F.ceil(F.col("num_docs") / part).cast("int")), "cells")
    few = broadcast_if_small(cells, 80)
    left = terms.join(df, ["collection", "term"]).join(few, "collection").select(
        "query_id", "term", idf(F.col("num_docs"), F.col("df")).alias("idf"), "avg_doc_length", "collection", F.pmod(F.xxhash64("query_id"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = texts.join(few, "collection").select("chunk_id", "terms", "collection", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("chunk_id"), "parts").alias("part"))

    def score(a: pa.Table, b_: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if a.num_rows and b_.num_rows:
            a, b_ = a.sort_by("query_id"), b_.sort_by("chunk_id")  # so that ties at the edge go by id
            words = pc.unique(a.column("term"))
            lists = b_.column("terms").combine_chunks()
            dl, n = np.diff(lists.offsets.to_numpy()), b_.num_rows
            at = pc.index_in(lists.flatten(), value_set=words).to_numpy(zero_copy_only=False)
            hit = ~np.isnan(at)
            pair, tf = np.unique(at[hit].astype(np.int64) * n + np.repeat(np.arange(n), dl)[hit], return_counts=True)
            word, chunk = pair // n, pair % n
            first = np.searchsorted(word, np.arange(len(words) + 1))
            avg = a.column("avg_doc_length")[0].as_py()  # above 0, as chunks without a term are left out
            share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[chunk] / avg))
            asked, weight = pc.index_in(a.column("term"), value_set=words).to_numpy(), a.column("idf").to_numpy()
            code = pc.rank(a.column("query_id"), tiebreaker="dense").to_numpy().astype(np.int64)
            begins = np.flatnonzero(np.diff(code, prepend=0))
            for i, j in zip(begins, [*begins[1:], len(code)]):
                where = [slice(first[w], first[w + 1]) for w in asked[i:j]]
                to = np.concatenate([chunk[x] for x in where])
                if not len(to):
                    continue
                sums = np.bincount(to, weights=np.concatenate([weight[i + m] * share[x] for m, x in enumerate(where)]), minlength=n)
                got = np.flatnonzero(np.bincount(to, minlength=n))
                near = np.round(sums[got], 9)
                if len(got) > k:  # all that tie with the edge are looked at, and the best k by score and id stay
                    keep = near >= np.partition(near, -k)[-k]
                    got, near = got[keep], near[keep]
                got = got[np.lexsort((got, -near))][:k]
                found.append((np.full(len(got), i), got, sums[got]))
        i, j, s = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.Table.from_arrays([a.column("query_id").take(pa.array(i)), b_.column("chunk_id").take(pa.array(j)), pa.array(s)], names=["query_id", "chunk_id", "score"])

    key = ["collection", "block", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, f"query_id {ids[0]}, chunk_id {ids[1]}, score double")
    return top_k(found, k)


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _usable(c: str) -> Column:
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def dense(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 4096, part: int = 8192) -> DataFrame:
    """Exact cosine top-k of ``queries(query_id, scope, vector)`` among ``vectors(chunk_id, scope, vector)`` of the same scope and length.

    A query does not find the chunk named in its column ``self_id``; without that column it does not find the chunk of its own id. The queries of a scope are dealt
    to blocks of about ``block``, its vectors to parts of about ``part``, and each block meets each part in one task as a matrix product that keeps the
    best ``k`` of a query, so neither side passes the driver or has to fit a task. Score is (1 + cos) / 2; ties go by id. Null, all-zero and
    non-finite vectors match nothing, nor does a null scope.
    """
    key = ["scope", "dim"]
    own = F.col("self_id" if "self_id" in queries.columns else "query_id").cast("string")
    q = queries.where(_usable("vector")).select("query_id", own.alias("self_id"), "scope", F.size("vector").alias("dim"), F.col("vector").cast("array<double>").alias("vector"))
    v = vectors.where(_usable("vector")).select("chunk_id", "scope", F.size("vector").alias("dim"), F.col("vector").cast("array<double>").alias("vector"))
    cells = q.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(v.groupBy(*key).agg(F.ceil(F.count("*") / part).cast("int").alias("parts")), key)
    left = q.join(cells, key).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    right = v.join(cells, key).withColumn("part", F.pmod(F.xxhash64("chunk_id"), "parts")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]

    def units(t: pa.Table) -> np.ndarray:
        m = t.column("vector").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if a.num_rows and b.num_rows:
            b = b.sort_by("chunk_id")  # so that ties at the edge go by id
            x, y, ids = units(a), units(b), np.array(b.column("chunk_id").cast(pa.string()).to_pylist(), dtype=object)
            selves = np.array(a.column("self_id").to_pylist(), dtype=object)
            at = {i: n for n, i in enumerate(ids)}
            for begin in range(0, len(x), 512):
                sim = np.round((1 + x[begin : begin + 512] @ y.T) / 2, 12)
                for row, me in enumerate(selves[begin : begin + 512]):
                    if me in at:
                        sim[row, at[me]] = -1
                top = min(k, sim.shape[1])
                edge = np.partition(np.round(sim, 9), -top, axis=1)[:, -top]
                for row in range(len(sim)):  # all that tie with the edge are looked at, and the best k by score and id stay
                    near = np.flatnonzero((np.round(sim[row], 9) >= edge[row]) & (sim[row] >= 0))
                    near = near[np.lexsort((near, -np.round(sim[row, near], 9)))][:k]
                    parts.append((np.full(len(near), begin + row), near, sim[row, near]))
        i, j, s = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.Table.from_arrays([a.column("query_id").take(pa.array(i)), b.column("chunk_id").take(pa.array(j)), pa.array(s)], names=["query_id", "chunk_id", "score"])

    def celled(side: DataFrame, mark: str, *keep: str):  # new names, as both sides may come from one table
        named = side.select(*keep, "vector", *[F.col(c).alias(f"{mark}_{c}") for c in (*key, "block", "part")])
        return named.groupBy(*[f"{mark}_{c}" for c in (*key, "block", "part")])

    found = celled(left, "q", "query_id", "self_id").cogroup(celled(right, "v", "chunk_id"))
    return top_k(found.applyInArrow(score, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"), k)
