"""Queries on dangling references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import inherited, orphan_cascade, orphan_report, references, targets, utc_text
from ..sources.tables import table


def _joined_key(*cols: str):
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    children, golden, state = (table(spark, d, t) for t in ("section_children", "golden_test_set", "zotero_sync_state"))
    refs = (
        references(children, "section_children", "sections", _joined_key("collection", "child_id"), F.col("parent_id"), F.col("loaded_at"), F.col("collection"))
        .unionByName(references(golden.withColumn("__ref", F.explode("expected_chunk_ids")), "golden_test_set", "chunks", F.col("query_id"), F.col("__ref"), F.col("loaded_at")))
        .unionByName(references(state, "zotero_sync_state", "documents", _joined_key("item_key", "attachment_key", "target_collection"), F.col("document_id"), utc_text("last_synced_at")))
    )
    known = (
        targets(table(spark, d, "sections"), "sections", "parent_id", "collection")
        .unionByName(targets(table(spark, d, "chunks"), "chunks", "chunk_id"))
        .unionByName(targets(table(spark, d, "documents"), "documents", "document_id"))
    )
    return orphan_cascade(refs, known)[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Level 0 of the cascade: the columns and cases asked for are the direct orphans only, so it is not run further here."""
    return _orphans(spark, d).select("ref_table", "period", "record_key", "ref_value", "kind").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def p5_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct orphans are the records whose target is missing or deleted; the rest is inherited down
    documents, sections, section children and documents, chunks, golden cases."""
    children, golden, state = (table(spark, d, t) for t in ("section_children", "golden_test_set", "zotero_sync_state"))
    sections, chunks = table(spark, d, "sections"), table(spark, d, "chunks")

    def edge(df, record_table, key, parent_table, parent):
        return df.select(F.lit(record_table).alias("record_table"), key.alias("record_key"), F.lit(parent_table).alias("parent_table"), parent.alias("parent_key"))

    edges = (
        edge(sections, "sections", _joined_key("collection", "parent_id"), "documents", F.col("document_id"))
        .unionByName(edge(chunks, "chunks", F.col("chunk_id"), "documents", F.col("source_ref")))
        .unionByName(edge(children.where("parent_id <> ''"), "section_children", _joined_key("collection", "child_id"), "sections", _joined_key("collection", "parent_id")))
        .unionByName(edge(golden.withColumn("__ref", F.explode("expected_chunk_ids")), "golden_test_set", F.col("query_id"), "chunks", F.col("__ref")))
        .unionByName(edge(state, "zotero_sync_state", _joined_key("item_key", "attachment_key", "target_collection"), "documents", F.col("document_id")))
    )
    refs = (
        references(sections, "sections", "documents", _joined_key("collection", "parent_id"), F.col("document_id"), F.col("loaded_at"))
        .unionByName(references(chunks, "chunks", "documents", F.col("chunk_id"), F.col("source_ref"), F.col("loaded_at")))
    )
    docs = targets(table(spark, d, "documents"), "documents", "document_id")
    hanging = _orphans(spark, d).unionByName(orphan_cascade(refs, docs)[0]).where("kind <> 'late'")
    return inherited(hanging.select(F.col("ref_table").alias("record_table"), "record_key"), edges.distinct())


_TARGETS = """
refs as (
  select 'section_children' ref_table, 'sections' target_table, coalesce(collection,'') scope, coalesce(collection,'')||'|'||coalesce(child_id,'') record_key, parent_id ref_value, loaded_at ref_at from section_children
  union all select 'golden_test_set', 'chunks', '', query_id, unnest(expected_chunk_ids), loaded_at from golden_test_set
  union all select 'zotero_sync_state', 'documents', '', coalesce(item_key,'')||'|'||coalesce(attachment_key,'')||'|'||coalesce(target_collection,''), document_id,
    try_cast(regexp_replace(trim(last_synced_at), '(Z|[+-]00(:?00)?)$', '') as timestamp) from zotero_sync_state
),
rows_ as (
  select 'sections' t, coalesce(collection,'') scope, parent_id k, loaded_at, deleted_at from sections
  union all select 'chunks', '', chunk_id, loaded_at, deleted_at from chunks
  union all select 'documents', '', document_id, loaded_at, deleted_at from documents
),
known as (
  select t, scope, k, min(loaded_at) first_at, coalesce(max(case when deleted_at is not null then loaded_at end) >= max(loaded_at), false) is_deleted from rows_ group by all
),
once as (
  select ref_table, target_table, scope, record_key, ref_value, min(ref_at) ref_at from refs where ref_value is not null and ref_value <> '' group by all
),
orphans as (
  select o.ref_table, strftime(o.ref_at, '%Y-%m') period, o.record_key, o.ref_value,
    case when k.k is null then 'missing' when k.is_deleted then 'deleted' when k.first_at > o.ref_at then 'late' end kind
  from once o left join known k on k.t = o.target_table and k.scope = o.scope and k.k = o.ref_value
)
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_cascade": p5_cascade}
SQL = {
    "p5_found": f"with {_TARGETS} select distinct ref_table, period, record_key, ref_value, kind from orphans where kind is not null",
    "p5_report": f"with {_TARGETS} select ref_table, period, kind, count(*) n_refs, count(distinct record_key) n_records from orphans where kind is not null group by all",
    "p5_cascade": f"""with recursive {_TARGETS},
e as (
  select distinct 'sections' record_table, coalesce(collection,'')||'|'||coalesce(parent_id,'') record_key, 'documents' parent_table, document_id parent_key from sections where document_id is not null
  union select 'chunks', chunk_id, 'documents', source_ref from chunks where source_ref is not null and chunk_id is not null
  union select 'section_children', coalesce(collection,'')||'|'||coalesce(child_id,''), 'sections', coalesce(collection,'')||'|'||parent_id from section_children where parent_id <> ''
  union select * from (select 'golden_test_set', query_id, 'chunks', unnest(expected_chunk_ids) x from golden_test_set) where x is not null
  union select 'zotero_sync_state', coalesce(item_key,'')||'|'||coalesce(attachment_key,'')||'|'||coalesce(target_collection,''), 'documents', document_id from zotero_sync_state where document_id is not null
),
direct as (
  select distinct ref_table record_table, record_key from orphans where kind in ('missing','deleted')
  union select e.record_table, e.record_key from e left join known k on k.t = 'documents' and k.k = e.parent_key
    where e.record_table in ('sections','chunks') and e.parent_key <> '' and (k.k is null or k.is_deleted)
),
walk as (
  select record_table, record_key, 0 as level from direct
  union
  select e.record_table, e.record_key, w.level + 1 from walk w join e on e.parent_table = w.record_table and e.parent_key = w.record_key
)
select record_table, record_key, min(level)::int as level, case when min(level) = 0 then 'direct' else 'inherited' end kind from walk group by 1, 2""",
}
