"""Small cases with known results for the core operators."""

import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievegrid.functions import text as T
from sievegrid.operators import chunking, components, evaluate, evidence, fuse, index, lifecycle, references, retrieve
from sievegrid.operators.versions import key_states, live_rows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def ranking(spark, items):
    return spark.createDataFrame([("q", c, float(s), i + 1) for i, (c, s) in enumerate(items)], "query_id string, chunk_id string, score double, rank int")


def test_rrf_takes_ranks_not_scores(spark):
    dense, sparse = ranking(spark, [("a", 0.95), ("b", 0.85), ("c", 0.7)]), ranking(spark, [("b", 5.2), ("c", 4.1), ("d", 3.5)])
    got = {r.chunk_id: (r.rank, r.score) for r in fuse.rrf([dense, sparse]).collect()}
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1][0])] == ["b", "c", "a", "d"]
    assert got["b"][1] == pytest.approx(1 / 62 + 1 / 61)
    assert got["d"][1] == pytest.approx(1 / 63)


def test_rrf_rejects_bad_input(spark):
    with pytest.raises(ValueError):
        fuse.rrf([])
    with pytest.raises(ValueError):
        fuse.rrf([ranking(spark, [("a", 1)])], weights=[-1.0])


def test_weight_zero_keeps_rows(spark):
    got = {r.chunk_id: r.score for r in fuse.rrf([ranking(spark, [("a", 1)]), ranking(spark, [("b", 1)])], weights=[1.0, 0.0]).collect()}
    assert got["b"] == 0.0


def test_single_list_keeps_its_scores(spark):
    empty = ranking(spark, [("x", 1)]).where("false")
    assert rows(fuse.fuse([empty, ranking(spark, [("b", 5.0), ("a", 5.0)])]).select("chunk_id", "score", "rank")) == [("a", 5.0, 2), ("b", 5.0, 1)]


def test_interleave_uses_up_turns(spark):
    got = fuse.interleave([ranking(spark, [("a", 1), ("b", 1), ("c", 1)]), ranking(spark, [("a", 1), ("d", 1)])], 4)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == ["a", "b", "d", "c"]


def test_conservative_fusion_keeps_unscored(spark):
    scores = spark.createDataFrame([("q", "b", 0.9), ("q", "a", 0.1)], "query_id string, chunk_id string, rerank_score double")
    got = {r.chunk_id: r.score for r in fuse.conservative(ranking(spark, [("a", 0.03), ("b", 0.02), ("c", 0.01)]), scores, 0.7).collect()}
    assert got == {"a": pytest.approx(0.7), "b": pytest.approx(0.65), "c": pytest.approx(0.0)}


def test_demotion_of_weight_one_changes_nothing(spark):
    r = ranking(spark, [("a", 1.0), ("b", 0.9)])
    kinds = spark.createDataFrame([("a", "reference"), ("b", None)], "chunk_id string, chunk_type string")
    assert fuse.demote(r, kinds, 1.0) is r
    assert [x.chunk_id for x in fuse.demote(r, kinds, 0.3).orderBy("rank").collect()] == ["b", "a"]


def test_metrics_known_values(spark):
    r = ranking(spark, [("x", 3), ("a", 2), ("b", 1)])
    q = spark.createDataFrame([("q", "a"), ("q", "b"), ("q2", "z")], "query_id string, chunk_id string")
    got = {m.query_id: m for m in evaluate.per_query(r, q, 3).collect()}
    assert got["q"].ndcg == pytest.approx(0.6934264036)
    assert got["q"].mrr == 0.5 and got["q"].recall == 1.0 and got["q"].precision == pytest.approx(2 / 3)
    assert got["q2"].hit_rate == 0.0 and got["q2"].ndcg == 0.0


def test_idf_is_the_unsmoothed_form(spark):
    c = spark.createDataFrame([("c", "1", "rare common"), ("c", "2", "common"), ("c", "3", "common"), ("c", "4", None), ("c", "5", " ")], "collection string, chunk_id string, text string")
    got = {r.term: r.idf for r in index.term_stats(index.term_frequencies(c)).collect()}
    assert got["rare"] == pytest.approx(math.log(2.5 / 1.5)) and got["common"] < 0


def test_removal_by_document_and_merge(spark):
    c = spark.createDataFrame([("c", "d1_0000_aaaaaaaa", "one two"), ("c", "d10_0000_bbbbbbbb", "two")], "collection string, chunk_id string, text string")
    p = index.term_frequencies(c)
    left = index.remove_documents(p, spark.createDataFrame([("d1",)], "doc_id string"))
    assert {r.chunk_id for r in left.collect()} == {"d10_0000_bbbbbbbb"}
    new = index.term_frequencies(spark.createDataFrame([("c", "d10_0000_bbbbbbbb", "three")], "collection string, chunk_id string, text string"))
    assert {(r.chunk_id[:3], r.term) for r in index.merge_postings(p, new).collect()} == {("d1_", "one"), ("d1_", "two"), ("d10", "three")}


def test_dense_matches_brute_force_and_skips_bad_vectors(spark):
    rng = random.Random(1)
    vs = [(f"c{i}", "s", [rng.gauss(0, 1) for _ in range(8)]) for i in range(50)] + [("n", "s", None), ("z", "s", [0.0] * 8), ("w", "s", [1.0] * 7), ("i", "s", [float("inf")] * 8)]
    v = spark.createDataFrame(vs, "chunk_id string, scope string, vector array<double>").repartition(3)
    q = spark.createDataFrame(vs[:3] + vs[-4:], "query_id string, scope string, vector array<double>")
    got = {}
    for r in retrieve.dense(q, v, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for i, _, a in vs[:3]:
        want = [c for c, _ in sorted(((c, cos(a, b)) for c, _, b in vs[:50] if c != i), key=lambda x: -x[1])][:4]
        assert [c for _, c in sorted(got[i])] == want
    assert set(got) == {"c0", "c1", "c2"}


def test_dense_of_nothing(spark):
    v = spark.createDataFrame([], "chunk_id string, scope string, vector array<double>")
    q = spark.createDataFrame([], "query_id string, scope string, vector array<double>")
    assert retrieve.dense(q, v).count() == 0


def test_query_language(spark):
    q = spark.createDataFrame([("  How does Foo-Bar  c:lab tags:a,b Lang:de foo-bar 如何 检索abc ",), (None,), ("",)], "q string")
    r = q.select(T.keywords("q").alias("k"), T.filter_pairs("q").alias("f")).collect()
    assert r[0].k == ["foo-bar", "检索", "abc"]
    assert [(x.key, x.value) for x in r[0].f] == [("collection", "lab"), ("tags", "a,b"), ("Lang", "de")]
    assert r[1].k is None and r[2].k == []


def test_refine_shields_code(spark):
    t = "──────────────\nPage 3 | x\n──────────────\nA  <b>bold</b>  <!-- gone\n --> text   \n\n\n\n```\nkeep   <this>\n```\nend  "
    assert spark.range(1).select(T.refine(F.lit(t))).first()[0] == "A bold text\n\n```\nkeep   <this>\n```\nend"


def test_title_summary_tags(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.title(F.lit("## Head \nbody"))) == "Head"
    assert one(T.title(F.lit("A sentence ends here. And more follows, up to a length, that is no title."))) == "A sentence ends here"
    assert one(T.title(F.lit(None).cast("string"))) == "Untitled"
    assert one(T.summary(F.lit("One. Two! Three? Four."))) == "One. Two! Three?"
    assert one(T.tags(F.lit("Rayleigh Number of camelCase and snake_case **bold**"))) == ["Rayleigh Number", "bold", "camelCase", "snake_case"]


def test_sections_and_tables(spark):
    d = spark.createDataFrame([(1, "s", "pre\n# A\nx\n\n## B\n| h | i |\n|---|---|\n| 1 | 2 |\nend"), (2, "s", "no heads"), (3, "s", None), (4, "s", "")], "doc_id int, source_path string, text string")
    got = {(r.doc_id, r.section_no): (r.heading, r.body) for r in chunking.sections(d.where("text is not null")).collect()}
    assert got[(1, 0)] == ("", "pre") and got[(1, 1)] == ("A", "x") and got[(2, 0)] == ("", "no heads") and (4, 0) in got
    t = chunking.tables(d).collect()
    assert len(t) == 1 and t[0].csv == "h,i\n1,2" and t[0].n_rows == 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n;", max_size=300), st.integers(10, 40), st.integers(0, 9))
def test_recursive_split_keeps_limits_and_words(text, size, overlap):
    parts = chunking.recursive_split(text, size, overlap)
    assert all(0 < len(p) <= size for p in parts)
    assert "".join(text.split()) == "" or "".join(parts)
    at = 0
    for p in parts:  # every piece lies in the text, in order
        at = text.find(p, max(0, at - size))
        assert at >= 0


def test_parent_groups_against_a_loop(spark):
    rng = random.Random(3)
    data = [(d, f"{d}-{i}", i, rng.choice("ab"), "x" * rng.randint(0, 500)) for d in ("p", "q") for i in range(30)]
    got = {r.chunk_id: r.group_no for r in chunking.parent_groups(spark.createDataFrame(data, "doc_id string, chunk_id string, chunk_index int, section string, text string"), 900).collect()}
    for d in ("p", "q"):
        g, size, last = -1, 0, None
        for _, c, _, s, t in [x for x in data if x[0] == d]:
            if last != s or size + len(t) > 900:
                g, size = g + 1, 0
            size, last = size + len(t), s
            assert got[c] == g


def test_greedy_deduplication(spark):
    data = [("q", "c0", 1, "t0", "p"), ("q", "c1", 2, "t1", "p"), ("q", "c2", 3, "t2", "p"), ("q", "c3", 4, "t2", "r"), ("q", "c4", 5, " T0 ", None), ("q", "c5", 6, None, None)]
    r = spark.createDataFrame(data, "query_id string, chunk_id string, rank int, text string, parent_id string")
    assert [x.chunk_id for x in evidence.deduplicate(r, 10).orderBy("rank").collect()] == ["c0", "c1", "c3", "c5"]


def test_upsert_and_filters(spark):
    old = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    new = spark.createDataFrame([(None, 3)], "k string, v int")
    assert rows(lifecycle.upsert(old, new, ["k"])) == rows(spark.createDataFrame([("a", 1), (None, 3)], "k string, v int"))
    assert old.where(lifecycle.where({"v": {"$gte": 2}, "k": None})).count() == 1
    assert lifecycle.delete_where(old, {"k": "a"}).count() == 1


def ts(day):
    return dt.datetime(2031, 1, day)


def test_versions_with_repeats_nulls_and_clashing_names(spark):
    s = "k string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, first_at int, n int"
    data = [("a", ts(1), None, 1, 1), ("a", ts(2), ts(2), 1, 1), ("b", ts(1), ts(1), 1, 1), ("b", ts(3), None, 1, 1), ("b", ts(3), None, 1, 1), (None, ts(1), None, 1, 1)]
    df = spark.createDataFrame(data, s)
    assert {r.k for r in live_rows(df, ["k"]).collect()} == {"b", None}
    assert live_rows(df, ["k"]).count() == 2
    assert {(r.k, r.is_deleted) for r in key_states(df, ["k"]).collect()} == {("a", True), ("b", False), (None, False)}
    assert live_rows(df.where("false"), ["k"]).count() == 0


def test_orphans_by_kind(spark):
    known = spark.createDataFrame([("x", ts(5), None), ("gone", ts(1), ts(2)), ("back", ts(1), ts(2)), ("back", ts(3), None)], "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    refs = spark.createDataFrame([("r1", "x", ts(6)), ("r1", "x", ts(4)), ("r2", "gone", ts(9)), ("r3", "back", ts(9)), ("r4", "none", None), ("r5", "", ts(1)), ("r6", None, ts(1)), ("r7", "x", ts(7))], "r string, ref string, at timestamp_ntz")
    m = references.references(refs, "refs", "t", F.col("r"), F.col("ref"), F.col("at"))
    got = rows(references.orphan_cascade(m, references.targets(known, "t", "id"))[0].select("record_key", "kind", "period"))
    assert got == [("r1", "late", "2031-01"), ("r2", "deleted", "2031-01"), ("r4", "missing", None)]
    assert references.orphan_cascade(m.where("false"), references.targets(known, "t", "id"))[0].count() == 0


def test_cascade_reaches_a_fixpoint_in_cycles(spark):
    e = spark.createDataFrame([("t", "b", "t", "a"), ("t", "c", "t", "b"), ("t", "a", "t", "c"), ("t", "z", "t", "y"), ("t", None, "t", "a")], "record_table string, record_key string, parent_table string, parent_key string")
    o = spark.createDataFrame([("t", "a"), ("t", "a")], "record_table string, record_key string")
    assert rows(references.inherited(o, e).select("record_key", "level", "kind")) == [("a", 0, "direct"), ("b", 1, "inherited"), ("c", 2, "inherited")]


def test_cascade_from_references_to_the_end_of_a_long_chain(spark):
    known = spark.createDataFrame([("x", ts(5), None), ("gone", ts(1), ts(2))], "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    refs = spark.createDataFrame([("c0", "gone", ts(9)), ("late", "x", ts(1)), ("z", "x", ts(9))], "r string, ref string, at timestamp_ntz")
    n = 70
    e = spark.createDataFrame([("t", f"c{i + 1}", "t", f"c{i}") for i in range(n)] + [("t", "under late", "t", "late")], "record_table string, record_key string, parent_table string, parent_key string")
    m = references.references(refs, "t", "k", F.col("r"), F.col("ref"), F.col("at"))
    direct, all_ = references.orphan_cascade(m, references.targets(known, "k", "id"), e.coalesce(1))
    assert {(r.record_key, r.kind) for r in direct.collect()} == {("c0", "deleted"), ("late", "late")}
    assert {r.record_key: r.level for r in all_.collect()} == {f"c{i}": i for i in range(n + 1)}


def test_components_of_a_long_path(spark):
    n = 10000
    e = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = components.connected_components(e)
    assert got.count() == n + 1 and got.where("component <> 0").count() == 0


def test_utc_spellings(spark):
    d = spark.createDataFrame([("2032-05-10T08:32:45.000000+00:00",), ("2032-05-10T08:32:45Z",), ("2032-05-10 08:32:45",), ("what",), (None,)], "s string")
    assert [r[0] for r in d.select(references.utc_text("s")).collect()] == [dt.datetime(2032, 5, 10, 8, 32, 45)] * 3 + [None, None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=25))
def test_components_against_union_find(spark, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_bm25_of_texts_equals_bm25_of_postings_however_dealt(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    texts = [(rnd.choice("ab"), f"c{i:03}", " ".join(rnd.choices(words, k=rnd.randint(1, 9)))) for i in range(120)]
    texts += [("a", f"t{i}", "w1 w2 w2") for i in range(9)] + [("a", "null", None), ("a", "blank", " x "), (None, "nowhere", "w1 w2"), ("c", "unasked", "w1")]
    chunks = spark.createDataFrame(texts, "collection string, chunk_id string, text string")
    asks = [(f"q{i}", rnd.choice("ab"), rnd.sample(words, 3)) for i in range(30)] + [("none", "a", []), ("far", "b", ["absent"]), ("null", None, ["w1"]), ("empty", "z", ["w1"]), ("twice", "a", ["w1", "w1", "absent"])]
    queries = spark.createDataFrame(asks, "query_id string, collection string, keywords array<string>")
    cut = ["query_id", "chunk_id", F.round("score", 9).alias("score"), "rank"]
    want = rows(retrieve.bm25(queries, index.term_frequencies(chunks), 5).select(*cut))
    assert len(want) == 31 * 5
    for size in ({}, {"block": 4, "part": 7}):
        assert rows(retrieve.bm25_of_texts(queries, chunks, 5, **size).select(*cut)) == want
    assert retrieve.bm25_of_texts(queries, chunks.where("false"), 5).count() == 0
    assert retrieve.bm25_of_texts(queries.where("false"), chunks, 5).count() == 0
