"""Filling sequences of one capacity with documents, by a configuration linear program over the lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize


def best_configuration(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size so that the sum of prices is largest within ``capacity``: the knapsack by dynamic programming.

    A size that a smaller one outbids is never needed, so only sizes dearer than all smaller ones are priced in. Each of those comes in bundles of
    1, 2, 4 and so on, and a bundle is weighed for all capacities at once.
    """
    order = np.argsort(sizes, kind="stable")
    s, p = sizes[order], price[order]
    dearer = np.flatnonzero((p > np.concatenate(([0.0], np.maximum.accumulate(p)[:-1]))) & (s <= capacity))
    value, steps = np.zeros(capacity + 1), []
    for i in dearer:
        n = 1
        while n * s[i] <= capacity:
            w = int(n * s[i])
            with_it = value[:-w] + n * p[i]
            better = with_it > value[w:]
            value[w:] = np.where(better, with_it, value[w:])
            steps.append((i, n, w, better))
            n *= 2
    taken, c = np.zeros(len(sizes), dtype=np.int64), capacity
    for i, n, w, better in reversed(steps):
        if c >= w and better[c - w]:
            taken[order[i]] += n
            c -= w
    return taken


def fractional_plan(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, rate: float = 0.5) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, in fractions, so that no size is covered more than its demand.

    Multiplicative weights: each size has a weight that falls as it is covered; its price is its weight by its demand; the
    best configuration at these prices is used until one of its sizes is covered once over. At the end all uses are scaled by
    the size covered most.
    """
    log_w, cover = np.zeros(len(sizes)), np.zeros(len(sizes))
    used: dict[bytes, float] = {}
    for _ in range(rounds):
        w = np.exp(log_w - log_w.max())
        a = best_configuration(sizes, w / demand, capacity)
        has = a > 0
        step = float((demand[has] / a[has]).min())
        gain = step * a / demand
        cover += gain
        log_w -= rate * gain
        key = a.tobytes()
        used[key] = used.get(key, 0.0) + step
    scale = 1 / max(1e-12, cover.max())
    return [(np.frombuffer(k, dtype=np.int64), x * scale) for k, x in used.items()]


def whole_plan(histogram: dict[int, int], capacity: int, rounds: int = 100, passes: int = 2) -> list[tuple[dict[int, int], int]]:
    """Configurations ``{size: times}`` with the number of sequences each fills, covering ``histogram`` exactly.

    The fractional plan is rounded down, the rest of the demand is planned again, ``passes`` times in all; what is still left is laid out largest
    first, each configuration being repeated as long as its sizes last.
    """
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    plan: dict[bytes, int] = {}

    def use(a: np.ndarray, n: int) -> None:
        nonlocal left
        if n > 0:
            left = left - a * n
            plan[a.tobytes()] = plan.get(a.tobytes(), 0) + n

    for _ in range(passes):
        on = np.flatnonzero(left)
        if len(on) < 2 or left.sum() < 4 * len(on):
            break
        for part, x in fractional_plan(sizes[on], left[on].astype(float), capacity, rounds):
            a = np.zeros(len(sizes), dtype=np.int64)
            a[on] = part
            has = a > 0
            use(a, min(int(x), int((left[has] // a[has]).min())))
    while left.any():
        a, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            if left[i] and sizes[i] <= room:
                a[i] = min(int(left[i]), room // int(sizes[i]))
                room -= int(a[i]) * int(sizes[i])
        has = a > 0
        use(a, int((left[has] // a[has]).min()))
    return [({int(s): int(n) for s, n in zip(sizes, np.frombuffer(k, dtype=np.int64)) if n}, m) for k, m in plan.items()]


def pack(items: DataFrame, capacity: int, part: int = 200_000, rounds: int = 100) -> DataFrame:
    """``(id, piece_no, start_token, n_tokens, bin_id, bin_offset)`` for ``items(id, n_tokens)``.

    An item longer than ``capacity`` is divided into full pieces, a sequence each, and a rest; no other item is divided. Items of null or no length are left out;
    equal ids are items of their own. Only the histogram of lengths, at most ``capacity`` numbers, comes to the driver, where the
    configuration program is solved on it; its size does not depend on the data. Spark ranks the items within their length; a length with more
    than ``part`` items is ranked in as many parts as it needs, so that one shared by a third of all items is not sorted in one task, and every item finds its sequence from
    its length and rank.
    """
    spark = items.sparkSession
    whole = F.floor(F.col("n_tokens") / capacity)
    pieces = items.where("n_tokens > 0").select("id", F.col("n_tokens").alias("all"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, whole * 0))).alias("piece"))
    pieces = pieces.select("id", (F.col("piece") + 1).cast("int").alias("piece_no"), (F.col("piece") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("all") - F.col("piece") * capacity).cast("long").alias("n_tokens"))
    pieces = materialize(pieces, "pieces")

    histogram = {r.n_tokens: r.n for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    plan = whole_plan(histogram, capacity, rounds)
    places: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    base = 0
    for config, times in plan:
        for s, n in config.items():
            places.setdefault(s, []).append((filled.get(s, 0), n, base))
            filled[s] = filled.get(s, 0) + n * times
        base += times
    shared = spark.sparkContext.broadcast({s: np.array(v) for s, v in places.items()})

    per = spark.createDataFrame([(int(s), -(-int(n) // part)) for s, n in histogram.items()], "n_tokens long, salts long")  # at most capacity rows
    salted = pieces.join(F.broadcast(per), "n_tokens").withColumn("salt", F.pmod(F.xxhash64("id", "piece_no"), "salts").cast("int"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    offsets = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("n_tokens", "salt", "before"), "offsets")
    at = Window.partitionBy("n_tokens", "salt").orderBy("id", "piece_no")
    ranked = salted.withColumn("r", F.row_number().over(at) - 1).join(broadcast_if_small(offsets, 40), ["n_tokens", "salt"])
    ranked = ranked.select("id", "piece_no", "start_token", "n_tokens", (F.col("r") + F.col("before")).alias("rank"))

    def place(batches):
        for b in batches:
            size, rank = b.column("n_tokens").to_numpy(), b.column("rank").to_numpy()
            out = np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                i, t = np.flatnonzero(size == s), shared.value[int(s)]
                first, n, start = t[np.searchsorted(t[:, 0], rank[i], "right") - 1].T
                out[i] = start + (rank[i] - first) // n
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], names=["id", "piece_no", "start_token", "n_tokens", "bin_id"])

    placed = ranked.mapInArrow(place, f"id {dict(items.dtypes)['id']}, piece_no int, start_token bigint, n_tokens bigint, bin_id bigint")
    inside = Window.partitionBy("bin_id").orderBy(F.desc("n_tokens"), "id", "piece_no").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("bin_offset", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Sequences by how full they are, in steps of a hundredth: ``(fill_percent, n_bins, n_items, n_tokens)``."""
    bins = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_items"))
    return bins.groupBy(F.floor(F.col("n_tokens") * 100 / capacity).cast("int").alias("fill_percent")).agg(F.count("*").alias("n_bins"), F.sum("n_items").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
