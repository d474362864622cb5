"""The most similar vectors of every vector, by cross-polytope hashing and exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize


class CrossPolytope:
    """Hash tables of signed axes under fast pseudo-rotations.

    A rotation is three rounds of random signs and a Walsh-Hadamard transform over the dimension padded to a power of two;
    a vector falls to the axis, with its sign, on which the rotated vector is largest. A table joins
    ``functions`` of these; ``probes`` buckets per table are asked, in the order of the coordinates lost.
    Up to 256 dimensions the rotation is kept as the matrix it makes of the unit vectors, as one product then beats the rounds.
    """

    def __init__(self, dim: int, tables: int, functions: int = 1, probes: int = 1, seed: int = 11) -> None:
        self.wide = 1 << max(1, (dim - 1).bit_length())
        self.dim, self.tables, self.functions, self.probes = dim, tables, functions, probes
        self.per_table, self.kept = (2 * self.wide) ** functions, min(probes, min(probes, self.wide) ** functions)
        self.signs = np.random.default_rng(seed).choice(np.float32([-1, 1]), size=(tables, functions, 3, self.wide))
        self.turns = None
        if self.wide <= 256:
            axes = np.eye(dim, self.wide, dtype=np.float32)
            self.turns = [[self._rotate(axes, s) for s in t] for t in self.signs]

    def _rotate(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x = x * s
            h = 1
            while h < self.wide:
                y = x.reshape(len(x), -1, 2, h)
                x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), -1)
                h *= 2
        return x / np.float32(self.wide**1.5)

    def _turned(self, x: np.ndarray, table: int, f: int) -> np.ndarray:
        if self.turns is not None:
            return x @ self.turns[table][f]
        pad = np.zeros((len(x), self.wide), dtype=np.float32)
        pad[:, : self.dim] = x
        return self._rotate(pad, self.signs[table, f])

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        """(n, kept) buckets of the unit vectors ``x``, the own one first; ``kept`` is ``probes`` or as many as there are."""
        key, loss = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1), dtype=np.float32)
        for f in range(self.functions):
            y = self._turned(x, table, f)
            size = np.abs(y)  # of an axis and its opposite only one can be near
            m = min(self.probes, self.wide)
            ax = np.argpartition(-size, m - 1, axis=1)[:, :m] if m > 1 else size.argmax(axis=1)[:, None]
            at = np.take_along_axis(size, ax, axis=1)
            lost = (at.max(axis=1, keepdims=True) - at) ** 2
            ax = ax + self.wide * (np.take_along_axis(y, ax, axis=1) < 0)
            key = (key[:, :, None] * (2 * self.wide) + ax[:, None, :]).reshape(len(x), -1)
            loss = (loss[:, :, None] + lost[:, None, :]).reshape(len(x), -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, : self.probes]
            key, loss = np.take_along_axis(key, best, axis=1), np.take_along_axis(loss, best, axis=1)
        return key


def _largest(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest entries of every row; the width is a multiple of 64. They lie in the ``k`` blocks of 64 with the largest maxima,
    so only these are looked at closely."""
    n, blocks = len(s), s.reshape(len(s), -1, 64)
    m = blocks.shape[1]
    if m > k:
        pick = np.argpartition(-blocks.max(axis=2), k - 1, axis=1)[:, :k]
    else:
        pick = np.broadcast_to(np.arange(m), (n, m))
    near = blocks[np.arange(n)[:, None], pick].reshape(n, -1)
    in_near = np.argpartition(-near, k - 1, axis=1)[:, :k] if near.shape[1] > k else np.broadcast_to(np.arange(near.shape[1]), near.shape)
    return np.take_along_axis(pick, in_near // 64, axis=1) * 64 + in_near % 64


def _unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _small(unit: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes of a 127th of their largest entry; a cosine of two of them is off by some thousandths at most."""
    return np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, at: str | None) -> DataFrame:
    """``(id, v)``: the current vector of every id as the bytes of its floats. A vector is usable if it is not null, has
    ``dim`` entries, all finite, and not all of them zero; ids whose current vector is not usable are left out."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), (F.col(at) if at else F.lit(0)).alias("at"), F.col(vec_col).cast("array<float>").alias("vec"))
    kind = dict(rows.dtypes)["at"]

    def encode(batches):
        for b in batches:
            size = pc.fill_null(pc.list_value_length(b.column("vec")), 0).to_numpy()
            flat = b.column("vec").flatten().to_numpy(zero_copy_only=False)
            starts, whole = np.cumsum(size) - size, np.flatnonzero(size == dim)
            a = flat[starts[whole][:, None] + np.arange(dim)].astype(np.float32)
            out: list[bytes | None] = [None] * b.num_rows
            for i, ok, row in zip(whole, np.isfinite(a).all(axis=1) & a.any(axis=1), a):
                if ok:
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("at"), pa.array(out, pa.binary())], names=["id", "at", "v"])

    coded = rows.mapInArrow(encode, f"id string, at {kind}, v binary")
    return coded.groupBy("id").agg(F.max(F.struct("at", "v")).alias("s")).select("id", F.col("s.v").alias("v")).where("v is not null")


_NEAR = np.dtype([("other", "<i8"), ("cos", "<f4")])


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def _whole_runs(batches, key: str):
    """Sorted batches as tables that end where a run of equal keys ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        last = _runs(keys)[-2]
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def nearest_vectors(
    df: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 64, tables: int = 10, functions: int = 1, probes: int = 2, tile: int = 16384, at: str | None = None,
    least: float = -1.0, slack: int = 2,
) -> DataFrame:
    """``(id, rank, other, cosine)``: the ``k`` vectors most similar to every usable current vector, best first, ties by id; only those with a cosine of ``least`` or more.

    Equal vectors are one class and hashed once; their mates and the members of neighbouring classes are filled in from
    the first ``k + 1`` ids of each class, so a class of any size stays linear. A vector lies in its own bucket of each of the ``tables`` and asks
    ``probes`` buckets there. Through the tables go the vectors in a byte an entry; the pairs of a bucket are scored as matrix products, in tiles
    of at most ``tile`` vectors a side. Buckets with more owners or more asking are dealt to several tiles, none is cut off; probes
    of buckets without an owner are dropped before the shuffle. The best ``k + slack`` over all tables, by these rounded vectors, get exact cosines in double
    precision from the vectors themselves, and the best ``k`` of those stay.

    With ten tables of one function and two probes about a fifth of the collection is scored for a vector, so the work grows with the square of
    the collection: neighbours may be any distance away. Where only near vectors matter, ``functions=2`` makes buckets about 128 times smaller and still brings pairs
    of a cosine of 0.9 together in some table. The sizes of buckets are a table of at most ``tables * (2 * dim) ** functions`` rows.
    """
    maker = CrossPolytope(dim, tables, functions, probes)
    vectors = materialize(usable_vectors(df, id_col, vec_col, dim, at), "vectors")
    classes = materialize(vectors.groupBy("v").agg(F.min("id").alias("class_id")).withColumn("cid", F.monotonically_increasing_id()), "classes")

    def hash_(batches):
        for b in batches:
            if b.num_rows:
                u = _unit(_floats(b.column("v"), dim)).astype(np.float32)
                keys = np.concatenate([maker.buckets(u, t) + t * maker.per_table for t in range(tables)], axis=1)
                offsets = pa.array(np.arange(len(u) + 1, dtype=np.int32) * keys.shape[1])
                q = pa.array([row.tobytes() for row in _small(u)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("cid"), q, pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))], names=["cid", "q", "slots"])

    hashed = materialize(classes.select("cid", "v").mapInArrow(hash_, "cid bigint, q binary, slots array<bigint>"), "hashed")
    own = (F.col("pos") % maker.kept) == 0
    sizes = hashed.select(F.posexplode("slots").alias("pos", "slot")).groupBy("slot").agg(F.count(F.when(own, 1)).alias("owners"), F.count("*").alias("asking"))
    sizes = sizes.where("owners > 0 and asking > 1").select("slot", F.ceil(F.col("owners") / tile).cast("int").alias("nx"), F.ceil(F.col("asking") / tile).cast("int").alias("nq"))
    sizes = broadcast_if_small(materialize(sizes, "sizes"), 40)
    # a tile holds rows of role 0: query and candidate, 1: query, 2: candidate
    asks = F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda j: F.struct((F.pmod(F.xxhash64("cid"), "nq") * F.col("nx") + j).cast("long").alias("part"), F.lit(1).alias("role")))
    owns = F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda i: F.struct((i * F.col("nx") + F.pmod(F.xxhash64("cid"), "nx")).cast("long").alias("part"), F.lit(2).alias("role")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.when(own, 0).otherwise(1).alias("role")))
    legs = F.when((F.col("nx") == 1) & (F.col("nq") == 1), whole).when(own, F.concat(asks, owns)).otherwise(asks)
    spots = hashed.select("cid", "q", F.posexplode("slots").alias("pos", "slot")).join(sizes, "slot")
    laid = spots.select("cid", "q", "slot", F.explode(legs).alias("leg")).select(F.xxhash64("slot", "leg.part").alias("tile"), (F.col("cid") * 4 + F.col("leg.role")).alias("who"), "q")

    def unit8(column: pa.Array) -> np.ndarray:
        v = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(-1, dim).astype(np.float32)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    most, floor = k + slack, least - 0.02

    def score_tile(v: np.ndarray, cid: np.ndarray, role: np.ndarray):
        q, x = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
        both = not role.any()  # queries and candidates are the same rows
        top = min(most, len(x))
        if not top:
            return
        right = np.zeros((-(-len(x) // 64) * 64, dim), dtype=np.float32)
        right[: len(x)] = v[x]
        for at_ in range(0, len(q), 512):
            rows = q[at_ : at_ + 512]
            s = v[rows] @ right.T
            s[:, len(x) :] = -3
            if both:
                s[np.arange(len(rows)), at_ + np.arange(len(rows))] = -3
            else:
                s[:, : len(x)][cid[rows][:, None] == cid[x][None, :]] = -3
            best = _largest(s, top)
            yield cid[rows], cid[x[np.minimum(best, len(x) - 1)]], np.take_along_axis(s, best, axis=1)

    def score_alike(v: np.ndarray, cid: np.ndarray, role: np.ndarray, at_: np.ndarray, m: int):  # all tiles of m rows as one batched product
        rows = at_[:, None] + np.arange(m)
        s = np.matmul(v[rows], v[rows].transpose(0, 2, 1))
        ids, roles = cid[rows], role[rows]
        s[(ids[:, :, None] == ids[:, None, :]) | (roles[:, :, None] == 2) | (roles[:, None, :] == 1)] = -3
        top = min(most, m)
        best = np.argpartition(-s, top - 1, axis=2)[:, :, :top] if top < m else np.broadcast_to(np.arange(m), s.shape)
        yield ids.reshape(-1), np.take_along_axis(np.broadcast_to(ids[:, None, :], s.shape), best, axis=2).reshape(-1, top), np.take_along_axis(s, best, axis=2).reshape(-1, top)

    def score(batches):  # rows come sorted, so a tile is a run of equal keys; a task holds one tile and one batch
        for t in _whole_runs(batches, "tile"):
            who = t.column("who").to_numpy()
            v, cid, role = unit8(t.column("q")), who >> 2, who & 3
            ends = _runs(t.column("tile").to_numpy())
            starts, n = ends[:-1], np.diff(ends)
            found = [r for a, m in zip(starts[n > 32], n[n > 32]) for r in score_tile(v[a : a + m], cid[a : a + m], role[a : a + m])]
            found += [r for m in range(2, 33) if (n == m).any() for r in score_alike(v, cid, role, starts[n == m], m)]
            for ids, other, cos in found:
                keep = cos >= max(floor, -2)
                some = keep.any(axis=1)
                near = np.zeros(int(keep.sum()), dtype=_NEAR)
                near["other"], near["cos"] = other[keep], cos[keep]
                cut, raw = np.cumsum(keep[some].sum(axis=1)) * _NEAR.itemsize, near.tobytes()
                lists = [raw[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(lists, pa.binary())], names=["cid", "near"])

    def merge(batches):  # the best of a vector over all its tiles
        for t in _whole_runs(batches, "cid"):
            lists = t.column("near").to_pylist()
            near = np.frombuffer(b"".join(lists), dtype=_NEAR)
            cid = np.repeat(t.column("cid").to_numpy(), [len(x) // _NEAR.itemsize for x in lists])
            order = np.lexsort((near["other"], cid))
            cid, near = cid[order], near[order]
            new = np.ones(len(cid), dtype=bool)
            new[1:] = (cid[1:] != cid[:-1]) | (near["other"][1:] != near["other"][:-1])
            cid, near = cid[new], near[new]
            order = np.lexsort((-near["cos"], cid))
            cid, near = cid[order], near[order]
            ends = _runs(cid)
            keep = np.arange(len(cid)) - np.repeat(ends[:-1], np.diff(ends)) < most
            yield pa.RecordBatch.from_arrays([pa.array(cid[keep]), pa.array(near["other"][keep])], names=["cid", "other"])

    def cosines(batches):
        for b in batches:
            if b.num_rows:
                exact = np.einsum("ij,ij->i", _unit(_floats(b.column("v"), dim)), _unit(_floats(b.column("w"), dim)))
                keep = exact >= least
                yield pa.RecordBatch.from_arrays([b.column("cid").filter(pa.array(keep)), pa.array(-exact[keep]), b.column("other").filter(pa.array(keep))], names=["cid", "loss", "other_cid"])

    scored = laid.repartition("tile").sortWithinPartitions("tile").mapInArrow(score, "cid bigint, near binary")
    near = materialize(scored.repartition("cid").sortWithinPartitions("cid").mapInArrow(merge, "cid bigint, other bigint"), "near")
    both = near.join(classes.select(F.col("cid").alias("other"), F.col("v").alias("w")), "other").join(classes.select("cid", "v"), "cid")
    best = both.select("cid", "other", "v", "w").mapInArrow(cosines, "cid bigint, loss double, other_cid bigint")

    first = Window.partitionBy("class_id").orderBy("id")
    members = vectors.join(classes, "v").select("id", "class_id", "cid")
    heads = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("cid").agg(F.sort_array(F.collect_list("id")).alias("heads"))
    others = best.join(heads.select(F.col("cid").alias("other_cid"), "heads"), "other_cid").select("cid", "loss", F.explode("heads").alias("other"))
    mates = heads.where(F.size("heads") > 1).select("cid", F.lit(-1.0).alias("loss"), F.explode("heads").alias("other"))
    pool = others.unionByName(mates).groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("loss", "other"))), 1, k + 1).alias("pool"))
    mine = members.join(pool, "cid").select("id", F.slice(F.filter("pool", lambda n: n["other"] != F.col("id")), 1, k).alias("pool"))
    return mine.select("id", F.posexplode("pool").alias("pos", "n")).select("id", (F.col("pos") + 1).alias("rank"), F.col("n.other").alias("other"), (-F.col("n.loss")).alias("cosine"))
