"""Stored indexes, context, metadata, structured papers and stores on small cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sievegrid.functions import text as T
from sievegrid.operators import chunking, evaluate, evidence, index, lifecycle
from sievegrid.operators import records as M
from sievegrid.operators.versions import live_rows
from sievegrid.sources import files, postings

CHUNKS = "chunk_id string, collection string, text string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def ts(day):
    return dt.datetime(2031, 1, day)


def one(spark, c):
    return spark.range(1).select(c).first()[0]


LOADS = [
    [("a", "c", "one two two", ts(1), None), ("b", "c", "two three", ts(1), None), ("n", "c", None, ts(1), None), (None, None, "lost", ts(1), None)],
    [("a", "c", "four four", ts(3), None), ("b", "c", "two three", ts(3), ts(3)), ("d", "e", "one", ts(2), None), ("d", "e", "one", ts(2), None)],
    [("a", "c", "late old words", ts(2), None), ("b", "e", "back again", ts(4), None)],
]


def _postings(df):
    return {(r.collection, r.chunk_id, r.term, r.tf, r.dl) for r in df.collect()}


def test_an_index_of_deltas_is_the_index_of_all(spark, tmp_path):
    whole = spark.createDataFrame([r for load in LOADS for r in load], CHUNKS)
    want = _postings(index.term_frequencies(live_rows(whole, ["chunk_id"])))
    path = str(tmp_path / "index")
    with pytest.raises(ValueError):
        postings.read_index(spark, path)
    for n, load in enumerate(LOADS):
        rows = spark.createDataFrame(load, CHUNKS)
        tf, touched = index.term_frequencies(live_rows(rows, ["chunk_id"])), rows.select("chunk_id", F.col("loaded_at").alias("at"))
        assert postings.append_index(tf, touched, path, tag=str(n), buckets=4)
        assert not postings.append_index(tf, touched, path, tag=str(n), buckets=4)
    idx = postings.read_index(spark, path)
    assert idx.buckets == 4 and idx.version == 3 and {x for x in _postings(idx.postings) if x[1]} == {x for x in want if x[1]}
    assert {(r.collection, r.num_docs, r.avg_doc_length) for r in idx.stats.where("collection is not null").collect()} == {("c", 1, 2.0), ("e", 2, 1.5)}
    q = spark.createDataFrame([("q", "e", ["one", "again", "nowhere"])], "query_id string, collection string, keywords array<string>")
    assert {r.chunk_id for r in postings.stored_bm25(q, idx, 5).collect()} == {"d", "b"}
    postings.compact_index(spark, path, str(tmp_path / "compact"))
    assert _postings(postings.read_index(spark, str(tmp_path / "compact")).postings) == _postings(idx.postings)


def test_an_index_follows_a_stream(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "index", "cp"))
    for load in LOADS:
        spark.createDataFrame([r for r in load if r[0]], CHUNKS).coalesce(1).write.mode("append").parquet(source)
        postings.index_stream(spark.readStream.schema(CHUNKS).parquet(source), path, checkpoint, 4).awaitTermination(120)
    whole = spark.createDataFrame([r for load in LOADS for r in load if r[0]], CHUNKS)
    assert _postings(postings.read_index(spark, path).postings) == _postings(index.term_frequencies(live_rows(whole, ["chunk_id"])))


def test_postings_of_another_form_are_refused(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame(LOADS[0][:2], CHUNKS)
    postings.append_index(index.term_frequencies(rows), rows.select("chunk_id", F.col("loaded_at").alias("at")), path)
    spark.range(3).write.mode("overwrite").parquet(f"{path}/postings/v1")
    with pytest.raises(ValueError):
        postings.read_index(spark, path)


def test_live_rows_of_files(spark, tmp_path):
    s = "k string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, at int, gone string, n int"
    data = [("a", ts(1), None, 1, "x", 1), ("a", ts(2), ts(2), 1, "x", 1), ("b", ts(1), ts(1), 1, "x", 1), ("b", ts(3), None, 1, "x", 7), ("b", ts(3), None, 1, "x", 7), (None, ts(1), None, 1, "x", 1), ("t", ts(4), None, 1, "x", 1), ("t", ts(4), ts(4), 1, "x", 1), ("u", None, None, 1, "x", 2)]
    df = spark.createDataFrame(data, s)
    df.repartition(3).write.parquet(str(tmp_path / "rows"))
    read = spark.read.parquet(str(tmp_path / "rows"))
    want = sorted(map(str, map(tuple, live_rows(df, ["k"]).collect())))
    assert sorted(map(str, map(tuple, live_rows(read, ["k"]).collect()))) == want and len(want) == 3
    assert live_rows(read, ["k"]).columns == read.columns and live_rows(read.where("false"), ["k"]).count() == 0
    assert [r.k for r in live_rows(read, ["k"], F.col("n") == 7).collect()] == ["b"]


def test_adaptive_context_against_a_loop(spark):
    ranked = [("q", "c1", 1, "p1"), ("q", "c2", 2, "p2"), ("q", "c3", 3, None), ("q", "c4", 4, "p1"), ("q", "c5", 5, "none"), ("r", "c1", 1, "p2")]
    parents, near = {"p1": "x" * 30, "p2": "y" * 80}, {("q", "c2"): "n" * 25, ("q", "c3"): "", ("q", "c4"): "m" * 50, ("q", "c5"): "o" * 90}
    r = spark.createDataFrame(ranked, "query_id string, chunk_id string, rank int, parent_key string")
    p = spark.createDataFrame(list(parents.items()), "parent_key string, parent_text string")
    n = spark.createDataFrame([(*k, v) for k, v in near.items()], "query_id string, chunk_id string, near_text string")
    for mode in ("none", "parent", "neighbors", "adaptive"):
        got = {(x.query_id, x.chunk_id): (x.kind, x.context) for x in evidence.expand_context(r, p, n, mode, 100).collect()}
        left = {}
        for q, c, _, key in ranked:
            room, parent = left.setdefault(q, 100), parents.get(key)
            kind = ("parent" if parent is not None and len(parent) <= room else "neighbors") if mode == "adaptive" else mode
            text = {"parent": parent, "neighbors": near.get((q, c))}.get(kind)
            cut = text[:room] if text and room > 0 else None
            left[q] -= len(cut or "")
            assert got[(q, c)] == ((kind, cut) if cut else (None, None)), (mode, q, c)
    with pytest.raises(ValueError):
        evidence.expand_context(r, p, n, "other")


def test_filters_counts_and_modes(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "x/zotero/y", "c", None), (2, ["c"], "x", "c", "d"), (3, None, None, None, "c")], "i int, tags array<string>, source_path string, collection string, source_collection string")
    hit = lambda f, **k: {r.i for r in df.where(evidence.post_filter(f, **k)).collect()}
    assert hit({"tags": ["b", "z"]}) == {1} and hit({"source_path": "zotero"}) == {1} and hit({"collection": "c"}, collections=("collection", "source_collection")) == {1, 2, 3} and hit({"i": 2, "tags": "c"}) == {2}
    assert evidence.candidate_count(5, 4, 15) == 15 and evidence.candidate_count(5, 0, 15) == 5 and evidence.result_count(None) == 5 and evidence.result_count(99) == 20
    q = spark.createDataFrame([("q", "t")], "query_id string, query string")
    assert tuple(evidence.handoff(q, None, enabled=False).first()) == ("q", "not_evaluated", "")
    m = spark.createDataFrame([("section",), ("evidence",), ("hybrid",), (None,)], "m string").select(evidence.selected_mode(F.col("m"), False).alias("s"), evidence.selected_mode(F.col("m"), True).alias("t"), evidence.default_mode(F.col("m")).alias("d")).collect()
    assert [tuple(r.s) for r in m] == [("hybrid", True), ("evidence", False), ("hybrid", False), (None, False)] and tuple(m[0].t) == ("section", False) and [r.d for r in m] == ["parent", "none", "adaptive", "adaptive"]


def test_metadata_attach_and_views(spark):
    df = spark.createDataFrame([({"a": "1", "_p": "2", "title": "t"}, {"a": "9", "b": "3"}), (None, None)], "m map<string,string>, e map<string,string>")
    got = df.select(M.attach_metadata("m", "e").alias("x"), M.shown_metadata("m").alias("y")).collect()
    assert got[0].x == {"a": "9", "_p": "2", "title": "t", "b": "3"} and got[0].y == {"a": "1"} and got[1].x == {} and got[1].y is None
    for bad in ("source_path", " "):
        with pytest.raises(Exception, match="must not set"):
            spark.createDataFrame([({}, {bad: "x"})], df.schema).select(M.attach_metadata("m", "e")).collect()


def test_document_views(spark):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, M.document_title(lit("T"), lit("# H"), lit("a/b.pdf"))) == "T"
    assert one(spark, M.document_title(lit(""), lit("x\n  # Head \ny"), lit("a/b.pdf"))) == "Head"
    assert one(spark, M.document_title(lit(None), lit("x\n" * 11 + "# late"), lit("a/my_file-name.v2.pdf"))) == "My File Name.v2"
    assert one(spark, M.document_title(lit(None), lit(None), lit(None))) == "Untitled Document"
    assert one(spark, M.document_preview(lit(None), lit("# H\n  one \n\ntwo"))) == "one two" and one(spark, M.document_preview(lit("s"), lit("t"))) == "s"
    assert one(spark, M.document_preview(lit(None), lit("w" * 600))) == "w" * 497 + "..." and one(spark, M.document_preview(lit(None), lit("# H"))) == "No content preview available." and one(spark, M.document_preview(lit(None), lit(None))) == "No summary available."
    assert one(spark, M.document_tags(lit("a, b,, PDF "), lit("pdf"))) == ["a", "b", "PDF"] and one(spark, M.document_tags(lit(None), lit(None))) == []
    i = M.identifiers(F.lit("Journal of X 12\nKeywords: a b; c, d\ndoi 10.1234/ab.C-1. arXiv: 2001.01234v2 in 2019"))
    assert [one(spark, i[k]) for k in ("doi", "arxiv", "year", "venue", "keywords")] == ["10.1234/ab.C-1", "2001.01234", 2001, "Journal of X 12", ["a b", "c", "d"]]
    assert one(spark, M.captions(lit('[{"id": "a", "caption": "x"}, {"image_id": "b", "caption": "y"}, {"id": "c"}, {"id": "a", "caption": "z"}]'))) == {"b": "y", "a": "z"}
    assert one(spark, M.captions(lit('{"a": "x"}'))) == {"a": "x"} and one(spark, M.captions(lit(None))) == {} and one(spark, M.captions(lit("no json"))) == {}
    assert one(spark, T.section_path(lit('["A", " B ", ""]'))) == ["A", "B"] and one(spark, T.section_path(lit("A / B/"))) == ["A", "B"] and one(spark, T.section_path(lit(None))) == []
    assert one(spark, T.first_page(lit(None), lit("12"), lit("3"))) == 12 and one(spark, T.first_page(lit("x"))) is None
    assert one(spark, T.filter_map(lit("c:one tag:x c:two"))) == {"tags": "x", "collection": "two"}


def test_record_ids(spark):
    assert one(spark, evaluate.record_ids(F.lit(json.dumps(["a", {"id": "b"}, {"doc_id": "x", "chunk_id": "c"}])))) == ["a", "b", "c"]
    assert one(spark, evaluate.record_ids(F.lit(None).cast("string"))) == []
    with pytest.raises(Exception, match="without an id"):
        one(spark, evaluate.record_ids(F.lit('[{"name": "x"}]')))


def test_strict_means_and_composites(spark):
    m = "query_id string, hit_rate double, mrr double, precision double, recall double, ndcg double"
    assert tuple(evaluate.strict_means(spark.createDataFrame([("q", 1.0, 0.5, 0.1, 1.0, 0.6), ("r", 0.0, 0.0, 0.0, 0.0, 0.0)], m)).first()) == (0.5, 0.25, 0.05, 0.5, 0.3)
    for rows in ([], [("q", None, 0.5, 0.1, 1.0, 0.6)]):
        with pytest.raises(Exception, match="no queries"):
            evaluate.strict_means(spark.createDataFrame(rows, m)).collect()
    a, b = spark.createDataFrame([("q", 1.0, 2.0)], "query_id string, x double, y double"), spark.createDataFrame([("q", 5.0), ("r", None)], "query_id string, y double")
    assert {tuple(r) for r in evaluate.composite([a, b]).collect()} == {("q", "x", 1.0), ("q", "y", 5.0)}
    with pytest.raises(ValueError):
        evaluate.composite([])


def test_structured_papers_in_order(spark):
    schema = f"doc_id string, title string, abstract string, figures {chunking._ASSET}, tables {chunking._ASSET}, sections array<struct<heading:string,level:int,paragraphs:array<string>>>, references string, text string"
    rows = [
        ("p", "T", "a" * 990, [("f1", "cap", None)], [("t1", None, "d")], [("Intro", 1, ["See Figure 1.", "And Table 1."]), ("Empty", 1, []), (None, None, ["y" * 1500])], "[1] A ref.", "clash"),
        ("s", "T", "short", None, None, None, None, None), ("n", None, None, None, None, None, None, None),
    ]
    got = {}
    for r in chunking.split_papers(spark.createDataFrame(rows, schema)).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.chunk_type, r.section, r.text))
    assert [x[:3] for x in got["p"]] == [(0, "title", None), (1, "abstract", None), (2, "figure", None), (3, "table", None), (4, "body", "Intro"), (5, "body", None), (6, "body", None), (7, "reference", "References")]
    assert got["p"][2][3] == "[FIGURE: f1]\nCaption: cap\nDescription: " and got["p"][3][3] == "[TABLE_DATA: t1]\nCaption: \nContent:\nd" and got["p"][4][3] == "## Intro\n\nSee [FIG_REF: f1].\n\nAnd [TABLE_REF: t1]."
    assert got["s"] == [(0, "title_abstract", None, "# T\n\n## Abstract\nshort")] and "n" not in got


def test_parent_texts_and_placeholders(spark):
    c = spark.createDataFrame([("d", "c1", 0, "A", "one", 3), ("d", "c2", 1, "A", "two", None), ("d", "c3", 2, "B", None, 5)], "doc_id string, chunk_id string, chunk_index int, section string, text string, page int")
    got = sorted((r.text, r.child_ids, r.page_start, r.page_end) for r in chunking.parents(c, 10).collect())
    assert got == [("", ["c3"], 5, 5), ("one\n\ntwo", ["c1", "c2"], 3, 3)]
    lost = spark.createDataFrame([(None, "n1", 0, "A", "x"), (None, "n2", 1, "A", "y")], "doc_id string, chunk_id string, chunk_index int, section string, text string")
    assert sorted((r.chunk_id, r.group_no) for r in chunking.parent_groups(lost).collect()) == [("n1", 0), ("n2", 0)]
    assert chunking.parents(lost.withColumn("page", F.lit(1))).count() == 2
    assert {(r.previous_chunk_id, r.next_chunk_id) for r in evidence.neighbours(lost).collect()} == {("", "")}
    d = spark.createDataFrame([(1, "s", "a\n| h |\n|---|\n| 1 |\nb\n| no table |"), (2, None, "plain"), (3, "s", None), (4, "s", "")], "doc_id int, source_path string, text string")
    texts = {r.doc_id: r.text for r in chunking.with_placeholders(d).collect()}
    ident = chunking.tables(d).first().table_id
    assert texts == {1: f"a\n[TABLE: {ident}]\nb\n| no table |", 2: "plain", 4: ""}


def test_golden_lists_are_refused_unless_allowed(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"query": "q?", "expected_chunk_ids": ["a"]}]')
    with pytest.raises(Exception, match="allow_list"):
        files.read_golden(spark, str(tmp_path / "g.json")).collect()
    assert [r.query for r in files.read_golden(spark, str(tmp_path / "g.json"), allow_list=True).collect()] == ["q?"]


def test_run_history_and_table_files(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"run_id": "1", "metrics": {"mrr": 0.5}}\nnot json\n\n{"run_id": "2"}\n')
    assert [(r.run_id, r.metrics) for r in files.read_history(spark, str(tmp_path / "h.jsonl")).collect()] == [("1", {"mrr": 0.5})]
    t = spark.createDataFrame([("c", "t1", "a,b"), ("e", "t2", "x")], "collection string, table_id string, csv string")
    files.write_tables(t, str(tmp_path / "tables"))
    assert sorted(p.name for p in (tmp_path / "tables").iterdir() if p.is_dir()) == ["collection=c", "collection=e"]
    with pytest.raises(Exception):
        files.write_tables(t, str(tmp_path / "tables"))


def test_plans_are_executed_and_documents_deleted(spark):
    s = "k string, status string, file_sha256 string, source_version string"
    source = spark.createDataFrame([("new", "synced", "n", "1"), ("same", "synced", "s", "1"), ("changed", "synced", "c2", "1")], s)
    state = spark.createDataFrame([("same", "synced", "s", "1"), ("changed", "error", "c", "1"), ("lost", "synced", "l", "1")], s)
    got = {(r.k, r.file_sha256, r.status) for r in lifecycle.execute_plan(lifecycle.sync_plan(source, state, ["k"]), state, ["k"]).collect()}
    assert got == {("new", "n", "synced"), ("same", "s", "synced"), ("changed", "c2", "synced"), ("lost", "l", "inactive")}
    gone = spark.createDataFrame([("d1",), ("d1",), (None,)], "doc_id string")
    left, report = lifecycle.delete_documents({"x": spark.createDataFrame([("d1", 1), ("d2", 2), (None, 3)], "doc_id string, gone int"), "y": spark.createDataFrame([], "doc_id string")}, gone)
    assert {r.doc_id for r in left["x"].collect()} == {"d2", None} and {tuple(r) for r in report.collect()} == {("x", 3, 1), ("y", 0, 0)}
    docs = spark.createDataFrame([("a", "k")], "doc_id string, item_key string")
    assert lifecycle.by_identity(docs, doc_id="a", item_key=None).count() == 1
    with pytest.raises(ValueError):
        lifecycle.by_identity(docs, doc_id="a", item_key="k")


def test_images_and_checks(spark):
    c = spark.createDataFrame([("c1", "d", 0, "[IMAGE: ab_7_1] x [IMAGE: plain]", "k", ts(1)), ("c2", "d", 1, None, "k", ts(1)), ("c3", None, None, "no", "k", ts(1))], "chunk_id string, doc_id string, chunk_index int, text string, collection string, loaded_at timestamp_ntz")
    images = M.chunk_images(c)
    assert {(r.image_id, r.page) for r in images.collect()} == {("ab_7_1", 7), ("plain", None)}
    d = spark.createDataFrame([("d", {"images": "many", "title": "t"})], "doc_id string, metadata map<string,string>")
    got = {r.chunk_id: r for r in M.inherit_metadata(c, d, images).collect()}
    assert got["c1"].metadata == {"title": "t", "chunk_index": "0", "source_ref": "d"} and got["c1"].image_refs == ["ab_7_1", "plain"] and got["c1"].n_images == 2 and got["c1"].page_num == 7
    assert got["c2"].image_refs == [] and got["c3"].metadata == {"chunk_index": None, "source_ref": None}
    assert {tuple(r) for r in M.violations(c, {"no_text": F.col("text").isNull(), "no_id": F.col("chunk_id").isNull()}).collect()} == {("no_text", 1), ("no_id", 0)}
