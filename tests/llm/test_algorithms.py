"""Splitting, near duplicates and vector neighbours on small cases, against brute force."""

import datetime as dt
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievegrid.llm import neardup, split, vectors

# ---- splitting


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é。.,\n ", max_size=400), st.integers(5, 60), st.data())
def test_pieces_cover_the_text_and_overlap(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    spans = split.spans(text, limit, overlap)
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    assert all(a[1] - b[0] == overlap and b[1] > a[1] for a, b in zip(spans, spans[1:]))


def test_cuts_prefer_stronger_pauses():
    text = "aaa bbb ccc. ddd eee\n\nfff ggg hhh iii jjj"
    assert text[slice(*split.spans(text, 26, 0)[0])] == "aaa bbb ccc. ddd eee\n\n"
    assert split.spans("x" * 25, 10, 3) == [(0, 10), (7, 17), (14, 24), (21, 25)]


def test_word_units():
    text = "one two  three four five"
    spans = split.spans(text, 3, 1, "words")
    assert [text[a:b].split() for a, b in spans] == [["one", "two", "three"], ["three", "four", "five"]]


def test_split_edge_rows(spark):
    long = "word " * 500
    df = spark.createDataFrame([("t", "1", long, 1), ("t", "1", long, 1), ("t", "2", None, 2), ("t", "3", "", 3), ("t", "4", "x" * 100, 4)], "record_table string, record_key string, text string, piece int")
    got = split.split_oversized(df, "text", 100, 10)
    assert {r.record_key for r in got.collect()} == {"1"} and got.where("piece_no = 1").count() == 2
    assert split.split_oversized(df.where("false"), "text", 100, 10).count() == 0


# ---- near duplicates

WORDS = [f"w{i}" for i in range(400)]


def _chunk(rng, n=80):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _brute(texts, threshold):
    bags = {k: Counter(neardup.words(t)) for k, t in texts.items()}
    keys = sorted(texts)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if neardup.bag_similarity(bags[a], bags[b]) >= threshold}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    texts = {f"c{i:03d}": _chunk(rng) for i in range(60)}
    for i in range(30):
        w = texts[f"c{i:03d}"].split()
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = "new" + str(rng.random())
        if i % 3 == 0:
            rng.shuffle(w)
        texts[f"d{i:03d}"] = " ".join(w)
    texts["copy"] = texts["c005"].upper()
    texts["tiny1"], texts["tiny2"] = "One.", "one"
    rows = [(k, t, dt.datetime(2031, 1, 1), None, 0) for k, t in texts.items()]
    rows += [("c001", texts["c001"], dt.datetime(2031, 1, 1), None, 0)]  # a repeated row
    rows += [("old", texts["c002"], dt.datetime(2031, 1, 1), None, 0), ("old", "something else now", dt.datetime(2031, 1, 2), None, 0)]
    rows += [("dead", texts["c003"], dt.datetime(2031, 1, 1), None, 0), ("dead", texts["c003"], dt.datetime(2031, 1, 3), dt.datetime(2031, 1, 3), 0)]
    rows += [("blanked", texts["c004"], dt.datetime(2031, 1, 1), None, 0), ("blanked", None, dt.datetime(2031, 1, 4), None, 0)]
    rows += [(None, texts["c001"], dt.datetime(2031, 1, 1), None, 0), ("nul", None, dt.datetime(2031, 1, 1), None, 0), ("punct", "...", dt.datetime(2031, 1, 1), None, 0)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, lo int").repartition(3)
    members, pairs = neardup.near_duplicates(df, "chunk_id", "text", 0.7, at="loaded_at", deleted="deleted_at")
    got = {tuple(r) for r in neardup.member_pairs(members, pairs).collect()}
    want = _brute(texts | {"old": "something else now"}, 0.7)
    assert got <= want and len(want - got) <= 0.05 * len(want) and ("tiny1", "tiny2") in got and ("c005", "copy") in got
    groups = {r.id: r for r in neardup.duplicate_groups(members, pairs).collect()}
    assert groups["copy"].group_id == "c005" and groups["c059"].n_links == 0 and "nul" not in groups and "dead" not in groups


def test_large_classes_stay_linear(spark):
    rng = random.Random(5)
    text = _chunk(rng)
    other = text + " tail"
    df = spark.createDataFrame([(f"a{i:03d}", text) for i in range(300)] + [(f"b{i}", other) for i in range(3)], "id string, text string")
    members, pairs = neardup.near_duplicates(df, "id", "text", 0.7)
    assert pairs.count() == 1
    got = {tuple(r) for r in neardup.member_pairs(members, pairs, expand=10).collect()}
    assert {("a000", f"a{i:03d}") for i in range(1, 300)} <= got and {(f"a{i:03d}", f"b{j}") for i in range(300) for j in range(3)} <= got
    assert len(got) == 299 + 900 + 3


def test_large_classes_lose_no_pair_of_texts(spark):
    rng = random.Random(8)
    w = _chunk(rng).split()
    texts = {f"c{i:02d}": text for i, text in enumerate([" ".join(w)] * 50 + [" ".join(rng.sample(w, len(w))) for _ in range(30)])}
    texts |= {f"d{i}": text + " tail" for i, text in enumerate(list(texts.values())[45:80])}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    members, pairs = neardup.near_duplicates(df, "id", "text", 0.7)
    want = _brute(texts, 0.7)
    assert len(want) == 115 * 114 // 2
    for hot in (2000, 9):
        got = [tuple(r) for r in neardup.member_pairs(members, pairs, hot=hot).collect()]
        assert len(got) == len(want) and set(got) == want
    got = {tuple(r) for r in neardup.member_pairs(members, pairs, expand=10).collect()}
    assert got == {(a, b) for a, b in want if texts[a] != texts[b] or a == "c00" or a == "d0"}


def test_hundred_thousand_copies(spark):
    n = 100_000
    copies = spark.range(n).selectExpr("printf('c%06d', id) as id", "'c000000' as class_id", f"{n + 3}L as class_size", "1L as same")
    others = spark.createDataFrame([("c100000", "c000000", n + 3, 2), ("c100001", "c000000", n + 3, 3), ("c100002", "c000000", n + 3, 3), ("", "", 1, 4)], copies.schema)
    pairs = spark.createDataFrame([("", "c000000", 0.9)], "class_a string, class_b string, similarity double")
    got = neardup.member_pairs(copies.unionByName(others), pairs, expand=1000)
    at = got.groupBy("id_a").count().collect()
    assert {(r.id_a, r["count"]) for r in at if r["count"] > 3} == {("c000000", n - 1 + 3), ("", n + 3)}
    assert got.count() == got.distinct().count() == (n - 1) + 3 * n + 1 + 2 + (n + 3)


def test_hot_bands_in_blocks_lose_nothing(spark):
    rng = random.Random(6)
    base = _chunk(rng).split()
    texts = {}
    for i in range(40):
        w = list(base)
        w[i % len(w)] = f"own{i}"
        texts[f"t{i:02d}"] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    members, pairs = neardup.near_duplicates(df, "id", "text", 0.7, hot=7)
    assert {tuple(r) for r in neardup.member_pairs(members, pairs).collect()} == _brute(texts, 0.7)


def test_no_rows_no_pairs(spark):
    df = spark.createDataFrame([], "id string, text string")
    members, pairs = neardup.near_duplicates(df, "id", "text")
    assert members.count() == 0 and neardup.member_pairs(members, pairs).count() == 0


# ---- vectors


def _vectors(n, dim=16, seed=7):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n // 8, dim))
    return (c[rng.integers(0, len(c), n)] + 0.35 * rng.normal(size=(n, dim))).astype(np.float32)


def _truth(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype(float) @ u.T.astype(float)
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1)[:, :k]


def _recall(got, truth):
    near = {}
    for r in got:
        near.setdefault(r.id, set()).add(r.other)
    return np.mean([len(near.get(f"v{i:04d}", set()) & {f"v{j:04d}" for j in row}) / len(row) for i, row in enumerate(truth)])


def test_recall_against_brute_force_whatever_the_tiles(spark):
    x = _vectors(600)
    df = spark.createDataFrame([(f"v{i:04d}", [float(f) for f in v]) for i, v in enumerate(x)], "id string, vec array<float>").repartition(3)
    truth = _truth(x, 5)
    a = vectors.nearest_vectors(df, "id", "vec", 5, 16, tables=10, probes=1).collect()
    b = vectors.nearest_vectors(df, "id", "vec", 5, 16, tables=10, probes=1, tile=20).collect()
    assert _recall(a, truth) >= 0.9 and {(r.id, r.rank, r.other) for r in a} == {(r.id, r.rank, r.other) for r in b}
    c = vectors.nearest_vectors(df, "id", "vec", 5, 16, tables=10, functions=2, probes=12).collect()
    assert _recall(c, truth) >= 0.9


def test_one_dense_cluster_with_probes(spark):
    rng = np.random.default_rng(9)
    x = (rng.normal(size=16) + 0.15 * rng.normal(size=(500, 16))).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:04d}", [float(f) for f in v]) for i, v in enumerate(x)], "id string, vec array<float>").repartition(3)
    got = {}
    for tile in (16384, 30):  # nearly all own and ask the same buckets, so with small tiles every one of them is split
        got[tile] = {(r.id, r.rank, r.other) for r in vectors.nearest_vectors(df, "id", "vec", 5, 16, tables=6, functions=2, probes=3, tile=tile).collect()}
    assert got[16384] == got[30]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in row}
    assert len(want & {(a, b) for a, _, b in got[30]}) >= 0.95 * len(want)


def test_least_cosine(spark):
    x = _vectors(300)
    df = spark.createDataFrame([(f"v{i:04d}", [float(f) for f in v]) for i, v in enumerate(x)], "id string, vec array<float>").repartition(2)
    all_ = {(r.id, r.other): r.cosine for r in vectors.nearest_vectors(df, "id", "vec", 5, 16).collect()}
    near = {(r.id, r.other): r.cosine for r in vectors.nearest_vectors(df, "id", "vec", 5, 16, least=0.9).collect()}
    assert near == {k: c for k, c in all_.items() if c >= 0.9} and 0 < len(near) < len(all_)


def test_copies_versions_and_unusable_vectors(spark):
    t = [dt.datetime(2031, 1, d) for d in (1, 2)]
    one, two = [1.0, 0.0, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0]
    rows = [(f"c{i:02d}", one, t[0], 1) for i in range(30)] + [("n", two, t[0], 1), ("n", two, t[0], 1)]
    rows += [("null", None, t[0], 1), ("zero", [0.0] * 4, t[0], 1), ("nan", [float("nan"), 1.0, 0.0, 0.0], t[0], 1), ("inf", [float("inf"), 1.0, 0.0, 0.0], t[0], 1), ("short", [1.0], t[0], 1), ("hole", [1.0, None, 0.0, 0.0], t[0], 1)]
    rows += [("late", one, t[0], 1), ("late", None, t[1], 1), (None, one, t[0], 1), ("huge", [3e38, 3e38, 0.0, 0.0], t[0], 1)]
    df = spark.createDataFrame(rows, "id string, v array<float>, loaded_at timestamp_ntz, cid int")
    got = {}
    for r in vectors.nearest_vectors(df, "id", "v", 5, 4, tables=8, at="loaded_at").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.other, round(r.cosine, 6)))
    assert set(got) == {f"c{i:02d}" for i in range(30)} | {"n", "huge"}
    assert [o for o, _ in got["c00"]] == ["c01", "c02", "c03", "c04", "c05"] and [o for o, _ in got["c29"]] == ["c00", "c01", "c02", "c03", "c04"]
    assert [o for o, _ in got["n"]] == ["c00", "c01", "c02", "c03", "c04"]
    assert vectors.nearest_vectors(df.where("false"), "id", "v", 5, 4, at="loaded_at").count() == 0
