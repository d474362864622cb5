"""Named queries against their SQL on the smallest data, and as streams against the batch answer."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from parity import compare, duck
from sievegrid.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
HEADLINE = ("L1_bm25_topk", "L5_hybrid", "L10_conservative", "P_metrics", "P10_ablation", "L12_parent_budget", "C1_filter_syntax", "N1_refine", "M3_sections", "M7_tables", "A7_get_by_ids", "B1_upsert", "D9_sync_plan", "Q8_stage_timings", "J4_sessions", "p5_found", "p5_report", "p5_cascade")


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", HEADLINE)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, DATA, name, catalog.QUERIES[name], catalog.SQL[name]).startswith("ok")


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_window_counts_as_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from sievegrid.streaming import incremental

    events = spark.read.parquet(f"{DATA}/events.parquet")
    folder = str(tmp_path / "events")
    events.repartition(3).write.parquet(folder)
    stream = incremental.window_counts(incremental.event_stream(spark, folder, events.schema, 1))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = incremental.window_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    cut = ["window_start", "event_type", "n"]
    assert sorted(map(tuple, spark.sql("select * from win").select(cut).collect())) == sorted(map(tuple, batch.select(cut).collect()))


def test_ingest_writes_each_key_once(spark, tmp_path):
    from sievegrid.streaming import incremental

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "file_sha256 string, v int"
    for run, data in enumerate(([("a", 1), ("b", 2)], [("b", 3), ("c", 4), ("c", 5)])):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.ingest_new(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.file_sha256 for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("name", ("L17_evidence_rows", "L17_coverage"))
def test_evidence_ranks_once_and_without_shuffling_hits(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 60 and "regexp_extract_all" not in plan  # the rankings are read, not computed once more for every reader
    assert compare(spark, con, DATA, name, lambda *_: df, catalog.SQL[name]).startswith("ok")
