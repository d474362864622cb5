"""Near-duplicate texts: banded MinHash candidates, odd-sketch estimates, exact word overlap."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import broadcast_if_small, materialize, spread
from .arrow import map_columns

WORD = re.compile(r"[^\W_]+")
_MASK = (1 << 64) - 1


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


def bag_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller counts over the sum of the larger counts; 0 where both are empty."""
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[w]) for w, n in a.items() if w in b)
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """MinHash samples over the multiset of words, as band keys and an odd sketch."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 7) -> None:
        self.bands, self.rows, self.bits = bands, rows, bits
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1 << 31, size=bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(1 << 32, size=bands * rows, dtype=np.uint32)
        self.fold = rng.integers(1 << 63, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[str, int] = {}

    def _hashes(self, text: str) -> list[int]:
        known, out = self.known, []
        for w in words(text):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        if len(known) > 1 << 20:
            known.clear()
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts with at least one word: bag hashes (n, 2), word counts, band hashes (n, bands) and odd
        sketches (n, bits/64)."""
        each = [self._hashes(t) for t in texts]
        sizes = np.array([len(x) for x in each])
        h = np.fromiter((v for x in each for v in x), dtype=np.uint64, count=int(sizes.sum()))
        doc = np.repeat(np.arange(len(each)), sizes)
        h = h[np.lexsort((h, doc))]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        n = np.arange(len(h))
        nth = n - np.maximum.accumulate(np.where(first, n, 0))
        x = _mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        bag = np.stack([np.add.reduceat(_mix(x ^ np.uint64(s)), starts) for s in (0x51ED270B, 0xC2B2AE3D27D4EB4F)], axis=1)
        low = (x >> np.uint64(32)).astype(np.uint32)
        band = np.empty((len(each), self.bands), dtype=np.int32)
        odd = np.zeros((len(each), self.bits), dtype=np.uint8)
        who = np.arange(len(each))
        for j in range(self.bands):
            acc = np.zeros(len(each), dtype=np.uint64)
            for r in range(self.rows):
                i = j * self.rows + r
                low_i = np.minimum.reduceat(low * self.a[i] + self.b[i], starts).astype(np.uint64)
                acc = _mix(acc + low_i * self.fold[r])
                bit = _mix(low_i + np.uint64(((i + 1) * 0x9E3779B97F4A7C15) & _MASK)) % np.uint64(self.bits)
                odd[who, bit.astype(np.int64)] ^= 1
            band[:, j] = (acc >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return bag, sizes, band, np.packbits(odd, axis=1).view(np.int64)


def sketch_texts(df: DataFrame, id_col: str, text_col: str, keep: list[str], bands: int, rows: int, bits: int) -> DataFrame:
    """``id``, the columns of ``keep``, two halves of a hash of the text's bag of words, band hashes and odd
    sketch. Texts without a word get no row. Of equal bags in one Arrow batch only the first carries
    bands and sketch, which thins a group of copies before anything is shuffled."""
    kinds = dict(df.dtypes)
    schema = ", ".join(["id string", *[f"`{k}` {kinds[k]}" for k in keep], "lo bigint, hi bigint, bands array<int>, odd array<bigint>"])
    maker: list[Sketcher] = []

    def run(b: dict[str, list]) -> dict[str, list]:
        if not maker:
            maker.append(Sketcher(bands, rows, bits))
        use = [i for i, t in enumerate(b["__text"]) if t is not None and WORD.search(t)]
        out: dict[str, list] = {k: [b[k][i] for i in use] for k in ("id", *keep)}
        lo, hi, band, odd, seen = [], [], [], [], set()
        for at in range(0, len(use), 1000):
            bag, _, bd, od = maker[0]([b["__text"][i] for i in use[at : at + 1000]])
            for (x, y), p, q in zip(bag.view(np.int64).tolist(), bd, od):
                new = (x, y) not in seen
                seen.add((x, y))
                lo.append(x)
                hi.append(y)
                band.append(p if new else None)
                odd.append(q if new else None)
        return out | {"lo": lo, "hi": hi, "bands": band, "odd": odd}

    return map_columns(df.select(F.col(id_col).cast("string").alias("id"), *keep, F.col(text_col).alias("__text")), run, schema)


def _shared_keys(laid: DataFrame, hot: int) -> DataFrame:
    """Pairs ``lo_a < lo_b`` that share a key of ``laid(key, lo)``, whose rows are distinct.

    Keys are counted once, combined map-side, and only those with company are written down; a key of two members already
    holds its pair in that row. The members of larger keys are looked up again; up to ``hot`` of them join as they lie, and of more one
    side is dealt to blocks of ``hot`` members and the other repeated per block."""
    g = laid.groupBy("key").agg(F.count("*").alias("n"), F.min("lo").alias("lo_a"), F.max("lo").alias("lo_b")).where("n > 1")
    shared = materialize(g, "shared")
    crowd = broadcast_if_small(materialize(shared.where("n > 2").select("key", "n"), "crowd"), 40)
    crowded = materialize(laid.join(crowd, "key"), "crowded")
    cold, many = crowded.where(F.col("n") <= hot), crowded.where(F.col("n") > hot).withColumn("blocks", F.ceil(F.col("n") / hot).cast("int"))
    a, b = cold.select("key", F.col("lo").alias("lo_a")), cold.select("key", F.col("lo").alias("lo_b"))
    few = a.join(b, "key").where("lo_a < lo_b").select("lo_a", "lo_b")
    a = many.select("key", F.col("lo").alias("lo_a"), F.pmod(F.xxhash64("lo"), "blocks").cast("int").alias("block"))
    b = many.select("key", F.col("lo").alias("lo_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    far = a.join(b, ["key", "block"]).where("lo_a < lo_b").select("lo_a", "lo_b")
    return shared.where("n = 2").select("lo_a", "lo_b").unionByName(few).unionByName(far).distinct()


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float = 0.7,
    bands: int = 40,
    rows: int = 8,
    bits: int = 512,
    slack: float = 0.15,
    hot: int = 2000,
    at: str | None = None,
    deleted: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal bags of words, and the pairs of classes that are at least ``threshold`` alike.

    Similarity is that of the words as multisets. Every text gets ``bands * rows`` MinHash samples over
    (word, occurrence). Two classes that agree in a whole band are candidates; the odd sketches of their samples
    estimate the similarity, estimates below ``threshold - slack`` are dropped, and the rest are compared word
    by word, so no pair below the threshold comes out. A pair at similarity s is missed with
    probability (1 - s**rows)**bands, about 9 % at 0.70, 1.5 % at 0.75 and 0.1 % at 0.80.

    ``at`` and ``deleted`` name the version columns of an append log: only current rows that are not deleted
    count. Null ids, and texts that are null or without a word, belong to no class. Equal rows count once.

    Returns members ``(id, class_id, class_size, same)``, class_id being the least id and same a hash of the text, and pairs
    ``(class_a, class_b, similarity)`` with class_a < class_b.
    """
    src = df.where(F.col(id_col).isNotNull())
    src = src.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(text_col).alias("text"),
        (F.col(at) if at else F.lit(0)).alias("at"),
        (F.col(deleted).isNotNull() if deleted else F.lit(False)).alias("gone"),
        F.xxhash64(text_col).alias("same"),
    )
    sk = materialize(sketch_texts(spread(src), "id", "text", ["at", "gone", "same"], bands, rows, bits), "sketches")
    # a current row without a word has no sketch, so the versions are taken from the table itself
    states = src.groupBy("id").agg(F.max("at").alias("now"), F.max(F.when(F.col("gone"), F.col("at"))).alias("gone_at"))
    alive = states.where("gone_at is null or gone_at < now").select(F.col("id").alias("live_id"), "now")
    members = (
        sk.select("id", "at", "lo", "hi", "same")
        .join(alive, (F.col("id") == F.col("live_id")) & (F.col("at") == F.col("now")), "left_semi")
        .dropDuplicates(["id"])
    )
    members = materialize(members, "members")
    classes = members.groupBy("lo", "hi").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))

    # one sketch a class, and none of a class whose texts are all dead or outdated
    alive_lo = materialize(classes.select("lo").distinct(), "alive")
    one = materialize(sk.where("bands is not null").select("lo", "bands", "odd").join(broadcast_if_small(alive_lo, 32), "lo", "left_semi").dropDuplicates(["lo"]), "one")
    key = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    candidates = _shared_keys(one.select("lo", F.posexplode("bands")).select(key.alias("key"), "lo"), hot)

    samples = bands * rows
    far = bits / 2 * (1 - math.exp(-4 * samples * (1 - max(threshold - slack, 0.0)) / bits))  # of the differing bits
    odd = one.select("lo", "odd")
    apart = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    likely = (
        candidates.join(odd.select(F.col("lo").alias("lo_a"), F.col("odd").alias("odd_a")), "lo_a")
        .join(odd.select(F.col("lo").alias("lo_b"), F.col("odd").alias("odd_b")), "lo_b")
        .where(apart <= far)
        .select("lo_a", "lo_b")
    )
    side = classes.select("lo", "class_id")
    likely = materialize(
        likely.join(side.select(F.col("lo").alias("lo_a"), F.col("class_id").alias("x")), "lo_a")
        .join(side.select(F.col("lo").alias("lo_b"), F.col("class_id").alias("y")), "lo_b")
        .select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")).distinct(),
        "likely",
    )
    needed = likely.select(F.col("class_a").alias("id")).unionByName(likely.select(F.col("class_b").alias("id"))).distinct()
    needed = materialize(needed.join(members.select("id", "at"), "id"), "needed")
    texts = src.join(broadcast_if_small(needed, 80), ["id", "at"], "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    both = likely.join(texts.select(F.col("id").alias("class_a"), F.col("text").alias("text_a")), "class_a").join(
        texts.select(F.col("id").alias("class_b"), F.col("text").alias("text_b")), "class_b"
    )

    def compare(b: dict[str, list]) -> dict[str, list]:
        bags: dict[str, Counter] = {}

        def bag(i: str, t: str) -> Counter:
            if i not in bags:
                bags[i] = Counter(words(t))
            return bags[i]

        sims = [bag(i, s) and bag_similarity(bag(i, s), bag(j, t)) for i, s, j, t in zip(b["class_a"], b["text_a"], b["class_b"], b["text_b"])]
        ok = [k for k, s in enumerate(sims) if s >= threshold]
        return {"class_a": [b["class_a"][k] for k in ok], "class_b": [b["class_b"][k] for k in ok], "similarity": [sims[k] for k in ok]}

    pairs = materialize(map_columns(both.select("class_a", "text_a", "class_b", "text_b"), compare, "class_a string, class_b string, similarity double"), "pairs")
    return materialize(members.join(classes, ["lo", "hi"]).select("id", "class_id", "class_size", "same"), "classes"), pairs


def member_pairs(members: DataFrame, pairs: DataFrame, expand: int | None = None, hot: int = 2000) -> DataFrame:
    """All pairs ``(id_a, id_b)`` of members, id_a < id_b, of one class or of two classes in ``pairs``. Their number grows with the square of a class.

    With ``expand``, copies of one and the same text in a class of more members are paired only with the least id among them, so a group of copies of
    any size stays linear and its other pairs follow from these; different texts are always paired in full. A class is a unit of its own, and so is each
    group of such copies; units are dealt to blocks of ``hot`` members, and each two blocks joined on their own, so no task holds a large class."""
    own = members.select("id", "class_id", F.lit("").alias("unit"), F.col("class_size").alias("size"))
    if expand is not None:
        copies = members.where(F.col("class_size") > expand).groupBy("class_id", "same").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
        copies = broadcast_if_small(materialize(copies, "copies"), 120)
        named = F.coalesce(F.concat(F.lit("="), "first"), F.lit(""))
        own = members.join(copies, ["class_id", "same"], "left").select("id", "class_id", named.alias("unit"), F.coalesce("n", "class_size").alias("size"))
    blocks = F.ceil(F.col("size") / hot).cast("int")
    # a class of one member needs no row here: it is one unit of one block
    units = own.where("size > 1").groupBy("class_id", "unit").agg(F.max("size").alias("size")).withColumn("blocks", blocks)
    one, two = (units.select(F.col("class_id").alias(f"class_{s}"), F.col("unit").alias(f"unit_{s}"), F.col("blocks").alias(f"blocks_{s}")) for s in "ab")
    within = one.join(two, F.col("class_a") == F.col("class_b")).where("unit_a < unit_b or (unit_a = unit_b and unit_a = '')")
    between = pairs.select("class_a", "class_b").join(one, "class_a", "left").join(two, "class_b", "left").na.fill("", ["unit_a", "unit_b"]).na.fill(1, ["blocks_a", "blocks_b"])
    keys = [f"{c}_{s}" for s in "ab" for c in ("class", "unit", "block")]
    cells = within.unionByName(between)
    for s in "ab":
        cells = cells.withColumn(f"block_{s}", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{s}") - 1)))
    cells = cells.select(keys)
    dealt = own.select("id", "class_id", "unit", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    x, y = (cells.join(dealt.toDF(f"{s}_id", *keys[at : at + 3]), keys[at : at + 3]) for s, at in (("a", 0), ("b", 3)))
    both = x.join(y, keys).where("class_a <> class_b or unit_a <> unit_b or a_id < b_id")
    out = both.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"))
    if expand is None:
        return out
    first = F.substring("unit", 2, 1 << 30)
    return out.unionByName(own.where(F.col("unit") != "").select(first.alias("id_a"), F.col("id").alias("id_b")).where("id_a <> id_b"))


def duplicate_groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per text: ``id``, ``class_id``, ``class_size``, ``n_links`` to other classes, ``group_id``: the least class id
    of its connected component."""
    links = pairs.select(F.col("class_a").alias("class_id")).unionByName(pairs.select(F.col("class_b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("n_links"))
    found = connected_components(pairs.select(F.col("class_a").alias("src"), F.col("class_b").alias("dst"))).withColumnRenamed("node", "class_id")
    return members.join(links, "class_id", "left").join(found, "class_id", "left").select(
        "id", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "class_id").alias("group_id")
    )
