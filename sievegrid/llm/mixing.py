"""One mixture of several sources at target shares, by pivotal dependent rounding."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_ROWS = "source string, id {kind}, n_tokens bigint, base int, p double, bucket bigint"


def pivot(items: list[tuple[float, float]], rng: random.Random) -> tuple[list[float], int | None]:
    """Rounds ``(probability, weight)`` pairs. Two open items trade weighted mass, up or down at random without bias, until one is 0 or 1; the sum of weight times
    probability stays what it was. Returns the probabilities and the index of the one item that may be left open."""
    p = [x for x, _ in items]
    open_: int | None = None
    for j, (_, w) in enumerate(items):
        if not 0 < p[j] < 1:
            continue
        if open_ is None:
            open_ = j
            continue
        i, v = open_, items[open_][1]
        up, down = min(1 - p[i], p[j] * w / v), min(p[i], (1 - p[j]) * w / v)
        move = up if rng.random() * (up + down) < down else -down
        p[i] += move
        p[j] -= move * v / w
        for k in (i, j):
            if p[k] < 1e-12 or p[k] > 1 - 1e-12:
                p[k] = float(round(p[k]))
        open_ = next((k for k in (i, j) if 0 < p[k] < 1), None)
    return p, open_


def budgets(found: dict[str, int], targets: list[tuple[str, float, int]], total: float | None) -> dict[str, float]:
    """Tokens to take from each source. Sources without tokens cannot reach their share; the others share in proportion to their
    targets. Without ``total`` the mixture is as large as the repeat limits allow at these shares."""
    usable = {s: (share, reps) for s, share, reps in targets if share > 0 and reps > 0 and found.get(s, 0) > 0}
    whole = sum(share for share, _ in usable.values())
    if not usable:
        return {}
    most = min(reps * found[s] * whole / share for s, (share, reps) in usable.items())
    size = most if total is None else min(total, most)
    return {s: size * share / whole for s, (share, _) in usable.items()}


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, bucket_rows: int = 20000, fan: int = 64, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """Copies of every document of ``docs(id, source, n_tokens)`` so that the sources reach their shares.

    ``targets(source, target_share, max_repeats)`` is one row a source, a table of settings that does not grow; null entries count as 0, of repeated
    rows the first in order counts. Documents of a null source, of a source without a target, and without tokens are not taken. With q the ratio of a source's budget to its
    tokens, each of its documents gets floor(q) copies and one more with probability q - floor(q), at most ``max_repeats`` as q is. The last copy is decided by pivotal
    rounding, which keeps a source's sum of tokens: within buckets of about ``bucket_rows`` documents, then among the one open document each bucket
    leaves, ``fan`` to one, until one is left a source and decided by chance. The result depends on the seed only.

    Returns the mixture ``(id, source, n_tokens, copies)``, copies at least 1, and the report
    ``(source, target_share, max_repeats, n_docs, n_copies, most_copies, n_tokens, actual_share)`` with all sources of the targets.
    """
    rows = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).where("source is not null").distinct().collect()
    aims: dict[str, tuple[float, int]] = {}
    for r in sorted(rows):
        aims.setdefault(r.source, (r.target_share, r.max_repeats))
    spark = docs.sparkSession
    aimed = spark.createDataFrame([(s, a, b) for s, (a, b) in aims.items()] or [("", 0.0, 0)], "source string, target_share double, max_repeats int")
    held = materialize(docs.where("n_tokens > 0").join(F.broadcast(aimed.select("source")), "source", "left_semi").select("source", "id", F.col("n_tokens").cast("long").alias("n_tokens")), "held")
    totals = {r.source: (r.t, r.n) for r in held.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    wanted = budgets({s: t for s, (t, _) in totals.items()}, [(s, *a) for s, a in aims.items()], total_tokens)

    quota = []
    for s, tokens in wanted.items():
        q = min(tokens / totals[s][0], float(aims[s][1]))
        base = int(q + 1e-9)
        quota.append((s, base, max(0.0, q - base), -(-totals[s][1] // bucket_rows)))
    per = spark.createDataFrame(quota or [("", 0, 0.0, 1)], "source string, base int, p double, buckets bigint")
    kind = dict(held.dtypes)["id"]
    laid = held.join(F.broadcast(per), "source").withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(seed)), "buckets")).select("source", "id", "n_tokens", "base", "p", "bucket")

    def settle(last: bool, level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["n_tokens", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)  # so that a short one is left open
            rng = random.Random(int.from_bytes(hashlib.sha256(f"{seed}|{level}|{pdf['source'][0]}|{pdf['bucket'][0]}".encode()).digest()[:8], "big"))
            p, left = pivot(list(zip(pdf["p"], pdf["n_tokens"])), rng)
            if last and left is not None:
                p[left] = float(rng.random() < p[left])
            pdf["p"] = p
            return pdf

        return run

    most = max((b for *_, b in quota), default=1)
    level, done, todo = 0, None, laid
    while True:
        last = most <= 1
        part = materialize(todo.groupBy("source", "bucket").applyInPandas(settle(last, level), _ROWS.format(kind=kind)), "settled")
        closed = part.where("p = 0 or p = 1")
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        most, level = -(-most // fan), level + 1
        todo = part.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / fan))
    mixture = done.select("id", "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("copies")).where("copies > 0")
    got = mixture.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"))
    zero = {c: 0 for c in ("n_docs", "n_copies", "most_copies", "n_tokens")}
    report = aimed.join(got, "source", "left").fillna(zero).crossJoin(got.agg(F.sum("n_tokens").alias("all_tokens")))  # one row beside one row a source
    return mixture, report.select("source", "target_share", "max_repeats", "n_docs", "n_copies", "most_copies", "n_tokens", (F.col("n_tokens") / F.col("all_tokens")).alias("actual_share"))
