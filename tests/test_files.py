"""Files in and out, and text rules that the tables hardly show."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sievegrid.functions import text as T
from sievegrid.sources import files


def test_discovery_and_hashes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"one")
    (tmp_path / "y.PDF").write_bytes(b"two")
    (tmp_path / "z.txt").write_bytes(b"three")
    assert {r.path.rsplit("/", 1)[1] for r in files.discover_files(spark, str(tmp_path)).collect()} == {"x.pdf", "y.PDF"}
    got = {r.file_sha256: r.doc_id for r in files.file_hashes(spark, str(tmp_path), "*.txt").collect()}
    digest = hashlib.sha256(b"three").hexdigest()
    assert got == {digest: "doc_" + digest[:16]}


def test_tolerant_logs_and_golden_sets(spark, tmp_path):
    log = tmp_path / "t.jsonl"
    log.write_text('{"trace_id": "1", "trace_type": "query", "stages": [{"stage": "a", "elapsed_ms": 2.5}]}\n\nnot json\n')
    assert [r.stages[0].elapsed_ms for r in files.read_traces(spark, str(log)).collect()] == [2.5]
    gold = tmp_path / "g.json"
    gold.write_text(json.dumps({"test_cases": [{"id": "1", "question": "q?", "supporting_chunk_ids": ["a"], "answer": "b"}, {"query": "r?"}, {"id": "3"}]}))
    assert sorted((r.query, len(r.expected_chunk_ids)) for r in files.read_golden(spark, str(gold)).collect()) == [("q?", 1), ("r?", 0)]


def test_runs_are_never_overwritten(spark, tmp_path):
    files.write_run(spark.range(2), str(tmp_path / "run"))
    with pytest.raises(Exception):
        files.write_run(spark.range(2), str(tmp_path / "run"))
    files.append_traces(spark.range(2), str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run")).count() == 4


def test_structured_papers(spark):
    xml = "<TEI><teiHeader><fileDesc><titleStmt><title> A title </title></titleStmt><sourceDesc><author><persName><surname>Ay</surname></persName></author><idno type='DOI'>10.1/x</idno></sourceDesc></fileDesc><abstract><p>Short.</p></abstract></teiHeader><text><body><div><head>One</head></div></body></text></TEI>"
    df = files.papers(spark.createDataFrame([(1, xml), (2, None)], "doc_id int, xml string"))
    a, b = df.orderBy("doc_id").collect()
    assert (a.title, a.authors, a.abstract, a.heads, a.doi) == ("A title", ["Ay"], "Short.", ["One"], "10.1/x") and b.title is None
    other = spark.createDataFrame([(1, "other", "x"), (2, "found", None), (3, "third", None)], "doc_id int, title string, doi string")
    assert {r.doc_id: r.title for r in files.prefer_structured(df, other, "doc_id", ["title", "doi"]).collect()} == {1: "A title", 2: "found", 3: "third"}


def test_asset_references_and_contexts(spark):
    df = spark.createDataFrame([("See Figure 1, Fig. 2 and Figure 12; Table 1.", ["f1", "f2"], ["t1"]), (None, None, None)], "t string, f array<string>, tb array<string>")
    got = [r[0] for r in df.select(T.asset_references("t", "f", "tb")).collect()]
    assert got == ["See [FIG_REF: f1], [FIG_REF: f2] and Figure 12; [TABLE_REF: t1].", None]
    assert spark.range(1).select(T.citation_contexts(F.lit("a [1] b"))).first()[0] == ["a [1] b"]
