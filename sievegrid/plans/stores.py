"""Queries on stores, lifecycle, sync state and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators import traces
from ..operators.references import utc_text
from ..operators.versions import live_rows
from ..sources.tables import table
from ..streaming import incremental
from .retrieval import GOLD, LIVE, golden, live_chunks

KEYS = ["item_key", "attachment_key", "target_collection"]
CUT = "2032-01-01"


def state_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zotero_sync_state").withColumn("synced_at", utc_text("last_synced_at"))


def state_now(spark, d) -> DataFrame:
    return live_rows(state_rows(spark, d), KEYS, at="synced_at", deleted=None)


def state_before(spark, d) -> DataFrame:
    return live_rows(state_rows(spark, d).where(F.col("synced_at") < F.lit(CUT).cast("timestamp_ntz")), KEYS, at="synced_at", deleted=None)


def seen_after(spark, d) -> DataFrame:
    return live_rows(state_rows(spark, d).where(F.col("synced_at") >= F.lit(CUT).cast("timestamp_ntz")), KEYS, at="synced_at", deleted=None)


def A7_get_by_ids(spark, d):
    asked = golden(spark, d).select(F.col("query_id").alias("request_id"), F.col("expected_chunk_ids").alias("ids"))
    return L.get_by_ids(asked, live_chunks(spark, d).select("chunk_id", "chunk_index"), "chunk_id").select("request_id", "pos", "chunk_id", "found", "chunk_index")


def A8_where(spark, d):
    return live_chunks(spark, d).where(L.where({"collection": "soft_matter", "chunk_index": {"$gte": 2}, "chunk_type": {"$in": ["text", "table"]}})).select("chunk_id", "chunk_index", "chunk_type")


def B1_upsert(spark, d):
    rows = table(spark, d, "section_children")
    cut = F.lit("2031-10-01").cast("timestamp_ntz")
    old, new = (live_rows(rows.where(c), ["collection", "child_id"], deleted=None) for c in (F.col("loaded_at") < cut, F.col("loaded_at") >= cut))
    return L.upsert(old, new, ["collection", "child_id"]).select("collection", "child_id", "parent_id", "loaded_at")


def B2_delete(spark, d):
    gone = table(spark, d, "documents").where("deleted_at is not null").select(F.col("document_id").alias("source_ref"))
    left = L.delete_keys(L.delete_where(live_chunks(spark, d), {"collection": "inbox"}), gone, ["source_ref"])
    return left.groupBy("collection").agg(F.count("*").alias("n_chunks"))


def B3_update_metadata(spark, d):
    x = table(spark, d, "documents").select("doc_id", "collection", F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("reviewed"), F.lit("no")), lambda k, v: v.isNotNull()).alias("props"))
    m = L.merge_metadata(x, {"collection": "vesicles"}, {"reviewed": "yes"})
    return m.select("doc_id", F.col("props")["lang"].alias("lang"), F.col("props")["reviewed"].alias("reviewed"))


def B8_history(spark, d):
    return state_rows(spark, d).groupBy(*KEYS).agg(F.min("synced_at").alias("processed_at"), F.max("synced_at").alias("updated_at"), F.count("*").alias("n_rows"))


def B15_bibtex(spark, d):
    x = table(spark, d, "documents").select(
        F.col("document_id").alias("id"), "title", F.array_compact(F.array("source")).alias("authors"), F.date_format("loaded_at", "yyyy").alias("year"),
        F.when(F.col("doc_type") == "paper", F.col("collection")).alias("venue"), F.lit("").alias("doi"), F.col("source_path").alias("url"))
    return L.bibtex(x)


def C6_skip(spark, d):
    return L.skip_known(seen_after(spark, d), state_before(spark, d)).select(*KEYS, "file_sha256")


def D4_parent(spark, d):
    ch = live_rows(table(spark, d, "section_children"), ["collection", "child_id"], deleted=None).select("collection", "child_id", "parent_id")
    s = live_rows(table(spark, d, "sections"), ["collection", "parent_id"]).select("collection", "parent_id", "document_id", "page_start", "section_path_json")
    return ch.join(s, ["collection", "parent_id"])


def D8_document_lookup(spark, d):
    """Chunks of a document by equality, else by the document id at the start of the chunk id."""
    docs = table(spark, d, "documents").select("document_id")
    c = live_chunks(spark, d).select("chunk_id", "source_ref", F.regexp_extract("chunk_id", r"^(.*)_\d{4,}_[0-9a-fA-F]{8}$", 1).alias("owner"))
    exact = docs.join(c, F.col("document_id") == F.col("source_ref")).select("document_id", "chunk_id")
    rest = docs.join(exact, "document_id", "left_anti").join(c, F.col("document_id") == F.col("owner")).select("document_id", "chunk_id")
    return exact.withColumn("how", F.lit("exact")).unionByName(rest.withColumn("how", F.lit("prefix")))


def D9_sync_plan(spark, d):
    return L.sync_plan(seen_after(spark, d), state_before(spark, d), KEYS).select(*KEYS, "action")


def D10_inactive(spark, d):
    return L.missing_from(state_before(spark, d), seen_after(spark, d), KEYS).select(*KEYS, "status")


def D11_document_counts(spark, d):
    c = live_chunks(spark, d).select(F.col("source_ref").alias("document_id"), "text")
    images = c.select("document_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[IMAGE: ([^\]]+)\]"), F.lit(1))).alias("image_id")).distinct()
    return L.document_counts(table(spark, d, "documents").select("document_id", "title"), c, images)


def D12_stale_chunks(spark, d):
    keep = table(spark, d, "chroma_store").select(F.col("id").alias("chunk_id")).distinct()
    return L.missing_from(live_chunks(spark, d).select("chunk_id", "source_ref"), keep, ["chunk_id"])


def E10_collection_stats(spark, d):
    c = live_chunks(spark, d)
    return c.groupBy("collection").agg(F.countDistinct("source_ref").alias("n_documents"), F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.floor(F.sum(F.length("text")) / F.count("*")).alias("avg_chunk"))


def E11_source_stats(spark, d):
    x = table(spark, d, "documents")
    return x.groupBy(F.coalesce("source", F.lit("manual")).alias("source_type")).agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("n_documents"), F.array_join(F.array_sort(F.collect_set("collection")), ",").alias("collections"))


def E12_status_summary(spark, d):
    return state_now(spark, d).groupBy("target_collection", "status").agg(F.count("*").alias("n"), F.max("synced_at").alias("last_at"))


def E16_section_pages(spark, d):
    return live_rows(table(spark, d, "sections"), ["collection", "parent_id"]).groupBy("document_id").agg(F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"), F.count("*").alias("n_sections"))


def I27_section_path(spark, d):
    s = live_rows(table(spark, d, "sections"), ["collection", "parent_id"])
    path = F.from_json("section_path_json", "array<string>")
    return s.select("collection", "parent_id", F.array_join(path, "/").alias("path"), F.size(F.from_json("child_ids_json", "array<string>")).alias("n_children"), F.get_json_object("metadata_json", "$.title").alias("title"))


def Q5_list_collections(spark, d):
    docs = table(spark, d, "documents").groupBy("collection").agg(F.count("*").alias("n_documents"))
    chunks = live_chunks(spark, d).groupBy("collection").agg(F.count("*").alias("n_chunks"))
    return docs.join(chunks, "collection", "full").select("collection", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def Q4_document_summary(spark, d):
    """The first chunk in order stands for the document."""
    c = live_chunks(spark, d)
    order = F.struct(F.coalesce("chunk_index", F.lit(0)), "chunk_id")
    return c.groupBy("source_ref").agg(F.count("*").alias("n_chunks"), F.min_by("chunk_id", order).alias("first_chunk"), F.sum(F.length("text")).alias("n_chars"))


def _events(spark, d):
    return table(spark, d, "events")


def J4_sessions(spark, d):
    return incremental.sessions(_events(spark, d)).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


def J4_window_counts(spark, d):
    return incremental.window_counts(_events(spark, d)).withColumn("mean_value", F.round("mean_value", 6)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def Q8_stage_timings(spark, d):
    t = traces.stage_timings(_events(spark, d))
    return t.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("total_ms", "mean_ms", "median_ms", "p95_ms")])


QUERIES = {
    "A7_get_by_ids": A7_get_by_ids,
    "A8_where": A8_where,
    "A9_json_scan": lambda s, d: traces.parsed(_events(s, d)).select("event_id", "event_type", "k"),
    "A10_golden_scan": lambda s, d: golden(s, d).select("query_id", F.coalesce("query_type", F.lit("unknown")).alias("query_type"), F.explode_outer("expected_chunk_ids").alias("chunk_id")),
    "A13_history": lambda s, d: state_now(s, d).where("status = 'synced'").select(*KEYS, "file_sha256", "synced_at").orderBy("synced_at", *KEYS),
    "B1_upsert": B1_upsert,
    "B2_delete": B2_delete,
    "B3_update_metadata": B3_update_metadata,
    "B8_history": B8_history,
    "B13_sync_state": lambda s, d: state_now(s, d).select(*KEYS, "status", "source_version", "document_id", "synced_at"),
    "B15_bibtex": B15_bibtex,
    "C6_skip": C6_skip,
    "C10_trace_search": lambda s, d: traces.search(_events(s, d), '"K": 7').select("event_id"),
    "D4_parent": D4_parent,
    "D8_document_lookup": D8_document_lookup,
    "D9_sync_plan": D9_sync_plan,
    "D10_inactive": D10_inactive,
    "D11_document_counts": D11_document_counts,
    "D12_stale_chunks": D12_stale_chunks,
    "E10_collection_stats": E10_collection_stats,
    "E11_source_stats": E11_source_stats,
    "E12_status_summary": E12_status_summary,
    "E16_section_pages": E16_section_pages,
    "I27_section_path": I27_section_path,
    "Q4_document_summary": Q4_document_summary,
    "Q5_list_collections": Q5_list_collections,
    "Q7_latest_stage": lambda s, d: traces.latest_stage(_events(s, d)),
    "Q8_stage_timings": Q8_stage_timings,
    "Q8_recent_traces": lambda s, d: traces.recent_traces(_events(s, d)),
    "J4_window_counts": J4_window_counts,
    "J4_sessions": J4_sessions,
}

_AT = "try_cast(regexp_replace(trim(last_synced_at), '(Z|[+-]00(:?00)?)$', '') as timestamp)"
_K = ", ".join(KEYS)
STATE = f"""st as (select *, {_AT} as synced_at from zotero_sync_state),
now_ as (select * from (select *, row_number() over (partition by {_K} order by synced_at desc) rn from st) where rn = 1),
before_ as (select * from (select *, row_number() over (partition by {_K} order by synced_at desc) rn from st where synced_at < timestamp '{CUT}') where rn = 1),
after_ as (select * from (select *, row_number() over (partition by {_K} order by synced_at desc) rn from st where synced_at >= timestamp '{CUT}') where rn = 1)"""
_SEC = "sec as (select * from (select *, row_number() over (partition by collection, parent_id order by loaded_at desc) rn from sections) where rn = 1 and deleted_at is null)"
_CH = "ch as (select * from (select *, row_number() over (partition by collection, child_id order by loaded_at desc) rn from section_children) where rn = 1)"
_SAME = " and ".join(f"a.{k} = b.{k}" for k in KEYS)

SQL = {
    "A7_get_by_ids": f"with {GOLD}, {LIVE}, q as (select query_id request_id, unnest(expected_chunk_ids) chunk_id, unnest(range(len(expected_chunk_ids)))::int pos from gold) select request_id, pos, q.chunk_id, live.chunk_id is not null found, chunk_index from q left join live on q.chunk_id = live.chunk_id",
    "A8_where": f"with {LIVE} select chunk_id, chunk_index, chunk_type from live where collection = 'soft_matter' and chunk_index >= 2 and chunk_type in ('text', 'table')",
    "A9_json_scan": "select event_id, event_type, (props::json->>'k')::bigint k from events where json_valid(props) and trim(props) <> ''",
    "A10_golden_scan": f"with {GOLD} select query_id, coalesce(query_type, 'unknown') query_type, unnest(case when expected_chunk_ids is null or len(expected_chunk_ids) = 0 then [null::varchar] else expected_chunk_ids end) chunk_id from gold",
    "A13_history": f"with {STATE} select {_K}, file_sha256, synced_at from now_ where status = 'synced'",
    "B1_upsert": f"with {_CH} select collection, child_id, parent_id, loaded_at from ch",
    "B2_delete": f"with {LIVE} select collection, count(*) n_chunks from live where collection is distinct from 'inbox' and (source_ref is null or source_ref not in (select document_id from documents where deleted_at is not null and document_id is not null)) group by 1",
    "B3_update_metadata": "select doc_id, lang, case when collection = 'vesicles' then 'yes' else 'no' end reviewed from documents",
    "B8_history": f"with {STATE} select {_K}, min(synced_at) processed_at, max(synced_at) updated_at, count(*) n_rows from st group by all",
    "B13_sync_state": f"with {STATE} select {_K}, status, source_version, document_id, synced_at from now_",
    "B15_bibtex": """select document_id id, concat_ws(chr(10), '@' || case when doc_type = 'paper' and coalesce(collection, '') <> '' then 'article' else 'misc' end || '{' || document_id || ',', case when coalesce(title, '') <> '' then '  title={ ' || title || ' }' end,
 case when coalesce(source, '') <> '' then '  author={ ' || source || ' }' end, '  year={ ' || strftime(loaded_at, '%Y') || ' }', case when doc_type = 'paper' and coalesce(collection, '') <> '' then '  journal={ ' || collection || ' }' end,
 case when coalesce(source_path, '') <> '' then '  url={ ' || source_path || ' }' end, '}') entry from documents""",
    "C6_skip": f"with {STATE} select {_K}, file_sha256 from after_ where file_sha256 is null or file_sha256 not in (select file_sha256 from before_ where status in ('success', 'synced') and file_sha256 is not null)",
    "C10_trace_search": """select event_id from events where contains(lower(props), '"k": 7') or contains(lower(event_type), '"k": 7')""",
    "D4_parent": f"with {_CH}, {_SEC} select ch.collection, ch.child_id, ch.parent_id, sec.document_id, sec.page_start, sec.section_path_json from ch join sec using (collection, parent_id)",
    "D8_document_lookup": f"""with {LIVE}, ex as (select document_id, chunk_id from documents join live on document_id = source_ref)
select document_id, chunk_id, 'exact' how from ex union all select document_id, chunk_id, 'prefix' from documents join live on document_id = regexp_extract(chunk_id, '^(.*)_[0-9]{{4,}}_[0-9a-fA-F]{{8}}$', 1) where document_id not in (select document_id from ex)""",
    "D9_sync_plan": f"with {STATE} select {', '.join('a.' + k for k in KEYS)}, case when b.item_key is null then 'add' when b.status = 'synced' and b.file_sha256 is not distinct from a.file_sha256 and b.source_version is not distinct from a.source_version then 'skip' else 'update' end action from after_ a left join before_ b on {_SAME}",
    "D10_inactive": f"with {STATE} select {_K}, status from before_ a where not exists (select 1 from after_ b where {_SAME})",
    "D11_document_counts": f"""with {LIVE}, c as (select source_ref document_id, count(*) n from live group by 1), i as (select document_id, count(distinct image_id) n from (select source_ref document_id, unnest(regexp_extract_all(text, '\\[IMAGE: ([^\\]]+)\\]', 1)) image_id from live) group by 1)
select document_id, title, coalesce(c.n, 0) n_chunks, coalesce(i.n, 0) n_images from documents left join c using (document_id) left join i using (document_id)""",
    "D12_stale_chunks": f"with {LIVE} select chunk_id, source_ref from live where chunk_id not in (select id from chroma_store where id is not null)",
    "E10_collection_stats": f"with {LIVE} select collection, count(distinct source_ref) n_documents, count(*) n_chunks, sum(length(text))::bigint n_chars, floor(sum(length(text)) / count(*)::double)::bigint avg_chunk from live group by 1",
    "E11_source_stats": "select coalesce(source, 'manual') source_type, count(*) n, count(distinct document_id) n_documents, string_agg(distinct collection, ',' order by collection) collections from documents group by 1",
    "E12_status_summary": f"with {STATE} select target_collection, status, count(*) n, max(synced_at) last_at from now_ group by all",
    "E16_section_pages": f"with {_SEC} select document_id, min(page_start) first_page, max(page_end) last_page, count(*) n_sections from sec group by 1",
    "I27_section_path": f"with {_SEC} select collection, parent_id, array_to_string(from_json(section_path_json, '[\"VARCHAR\"]'), '/') path, len(from_json(child_ids_json, '[\"VARCHAR\"]'))::int n_children, metadata_json::json->>'title' title from sec",
    "Q4_document_summary": f"with {LIVE} select source_ref, count(*) n_chunks, (array_agg(chunk_id order by coalesce(chunk_index, 0), chunk_id))[1] first_chunk, sum(length(text))::bigint n_chars from live group by 1",
    "Q5_list_collections": f"with {LIVE}, a as (select collection, count(*) n from documents group by 1), b as (select collection, count(*) n from live group by 1) select coalesce(a.collection, b.collection) collection, coalesce(a.n, 0) n_documents, coalesce(b.n, 0) n_chunks from a full join b on a.collection = b.collection",
    "Q7_latest_stage": "select user_id, event_type, arg_max(value, (ts, event_id)) as value, max(ts) ts from events group by all",
    "Q8_stage_timings": "select event_type, count(value) n, round(sum(value), 4) total_ms, round(avg(value), 4) mean_ms, round(quantile_cont(value, 0.5), 4) median_ms, round(quantile_cont(value, 0.95), 4) p95_ms from events group by 1",
    "Q8_recent_traces": "select user_id, min(ts) started_at, max(ts) finished_at, count(*) n_stages from events group by 1 order by started_at desc, user_id limit 100",
    "J4_window_counts": "select time_bucket(interval '1 day', ts) window_start, event_type, count(*) n, round(avg(value), 6) mean_value from events group by all",
    "J4_sessions": """with a as (select *, case when ts >= lag(ts) over w + interval '30 minutes' or lag(ts) over w is null then 1 else 0 end new_ from events window w as (partition by user_id order by ts, event_id)),
b as (select *, sum(new_) over (partition by user_id order by ts, event_id) s from a) select user_id, min(ts) session_start, count(*) n from b group by user_id, s""",
}
