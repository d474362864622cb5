"""Queries on metadata, document views, images, stores and stage counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, evaluate, index
from ..operators import lifecycle as L
from ..operators import records as M
from ..operators.versions import live_rows
from ..session import scratch_dir
from ..sources import files
from ..sources.tables import table
from . import stores as S
from .retrieval import GOLD, LIVE, TF, golden, live_chunks
from .texts import SQL as TEXT_SQL
from .texts import docs

OWNER = r"^(.*)_\d{4,}_[0-9a-fA-F]{8}$"


def chunks(spark, d):
    return live_chunks(spark, d).withColumnRenamed("source_ref", "doc_id")


def _first_chunks(spark, d):
    c = chunks(spark, d)
    order = F.struct(F.coalesce("chunk_index", F.lit(0)), "chunk_id")
    return c.groupBy("doc_id").agg(F.min_by("text", order).alias("first_text"), F.min("source_path").alias("path"))


def C7_metadata(spark, d):
    s = live_rows(table(spark, d, "sections"), ["collection", "parent_id"])
    return s.select("collection", "parent_id", F.explode(M.shown_metadata(F.from_json("metadata_json", "map<string,string>"), ("source_path",))).alias("key", "value"))


def C8_inherited(spark, d):
    c = chunks(spark, d)
    named = F.map_filter(F.create_map(F.lit("title"), "title", F.lit("doc_type"), "doc_type", F.lit("images"), F.lit("none")), lambda k, v: v.isNotNull())
    x = M.inherit_metadata(c, table(spark, d, "documents").select(F.col("document_id").alias("doc_id"), named.alias("metadata")), M.chunk_images(c))
    keys = F.array_join(F.array_sort(F.map_keys("metadata")), ",")
    return x.select("chunk_id", keys.alias("keys"), F.col("metadata")["title"].alias("title"), F.array_join("image_refs", ",").alias("image_refs"), "n_images", "page_num")


def C9_source_metadata(spark, d):
    """Item keys and versions of the reference manager beside the documents they name."""
    s = S.state_now(spark, d).where("document_id is not null").groupBy("document_id").agg(F.min(F.struct("item_key", F.coalesce("source_version", F.lit("")).alias("v"))).alias("s"))
    extra = F.create_map(F.lit("item_key"), F.col("s.item_key"), F.lit("source_version"), F.col("s.v"), F.lit("title"), F.lit("synced"))
    x = table(spark, d, "documents").select("document_id", F.create_map(F.lit("title"), F.coalesce("title", F.lit("")), F.lit("source_path"), F.coalesce("source_path", F.lit(""))).alias("metadata"))
    m = x.join(s.select("document_id", extra.alias("extra")), "document_id", "left").select("document_id", M.attach_metadata("metadata", "extra").alias("m"))
    return m.select("document_id", F.explode("m").alias("key", "value"))


def C11_violations(spark, d):
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return M.violations(table(spark, d, "chroma_store"), {
        "no_id": F.coalesce(F.col("id"), F.lit("")) == "", "no_vector": v.isNull(), "wrong_length": F.size(v) != 64, "not_finite": v.isNotNull() & ~finite, "all_zero": F.forall(v, lambda x: x == 0)})


def A14_images(spark, d):
    i = M.chunk_images(chunks(spark, d))
    return i.where("collection in ('soft_matter', 'vesicles')").select("image_id", "doc_id", "page", "collection", "created_at").orderBy("created_at", "image_id", "doc_id")


def E13_image_stats(spark, d):
    return M.chunk_images(chunks(spark, d)).groupBy("collection").agg(F.count("*").alias("n_images"), F.countDistinct("doc_id").alias("n_documents"), F.max("page").alias("last_page"))


def E14_stage_summary(spark, d):
    return M.stage_summary(chunks(spark, d), {"n_typed": F.col("chunk_type").isNotNull(), "n_with_images": F.size(M.image_refs("text")) > 0})


def E15_ingest_totals(spark, d):
    s = S.state_now(spark, d)
    n = live_chunks(spark, d).groupBy(F.col("source_ref").alias("document_id")).agg(F.count("*").alias("n"))
    j = s.join(n, "document_id", "left")
    ok = F.col("status") == "synced"
    return j.agg(
        F.count("*").alias("n_files"), F.count(F.when(ok, 1)).alias("n_successful"), F.count(F.when(F.col("status") == "error", 1)).alias("n_failed"),
        F.count(F.when(F.col("status") == "inactive", 1)).alias("n_skipped"), F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("n_chunks"))


def B7_section_store(spark, d):
    """Sections of before a time, those since put over them, documents deleted, and a mark merged into the metadata of one collection."""
    rows, cut = table(spark, d, "sections"), F.lit("2031-10-01").cast("timestamp_ntz")
    old, new = (live_rows(rows.where(c), ["collection", "parent_id"]) for c in (F.col("loaded_at") < cut, F.col("loaded_at") >= cut))
    s = L.upsert(old, new, ["collection", "parent_id"]).withColumn("props", F.create_map(F.lit("reviewed"), F.lit("no")))
    gone = table(spark, d, "documents").where("deleted_at is not null").select("document_id")
    s = L.merge_metadata(L.delete_keys(s, gone, ["document_id"]), {"collection": "vesicles"}, {"reviewed": "yes"})
    return s.select("collection", "parent_id", "document_id", F.sha2("text", 256).alias("text_hash"), F.col("props")["reviewed"].alias("reviewed"))


def B10_table_files(spark, d):
    folder = f"{scratch_dir(spark)}/tables-{uuid.uuid4().hex}"
    named = table(spark, d, "documents").select("doc_id", F.coalesce("collection", F.lit("default")).alias("collection"))
    files.write_tables(chunking.tables(docs(spark, d)).join(named, "doc_id"), folder)
    back = spark.read.schema("collection string, doc_id bigint, table_id string, n_columns int, n_rows int, csv string").json(folder)
    return back.groupBy("collection").agg(F.count("*").alias("n_tables"), F.sum("n_rows").alias("n_rows"))


def _plan(spark, d):
    return L.sync_plan(S.seen_after(spark, d), S.state_before(spark, d), S.KEYS)


def B14_manifest(spark, d):
    folder = f"{scratch_dir(spark)}/manifest-{uuid.uuid4().hex}"
    files.write_manifest(_plan(spark, d), folder, S.KEYS)
    return spark.read.schema("target_collection string, action string").json(folder).groupBy("target_collection", "action").agg(F.count("*").alias("n"))


def Q6_execute(spark, d):
    return L.execute_plan(_plan(spark, d), S.state_before(spark, d), S.KEYS).select(*S.KEYS, "file_sha256", "source_version", "status")


def I18_titles(spark, d):
    """Only the titles of papers are taken as given, so the others fall back on their first chunk and file name."""
    x = table(spark, d, "documents").select(F.col("document_id").alias("doc_id"), F.when(F.col("doc_type") == "paper", F.col("title")).alias("title"))
    return _first_chunks(spark, d).join(x, "doc_id", "left").select("doc_id", M.document_title("title", "first_text", "path").alias("title"))


def I19_previews(spark, d):
    return _first_chunks(spark, d).select("doc_id", M.document_preview(F.lit(None).cast("string"), "first_text").alias("summary"))


def I20_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(M.document_tags(F.concat_ws(", ", "collection", "source"), "doc_type"), "|").alias("tags"))


def I21_identifiers(spark, d):
    i = M.identifiers("text")
    return docs(spark, d).where("text is not null").select("doc_id", *[i[k].alias(k) for k in ("doi", "arxiv", "year", "venue")], F.array_join(i["keywords"], "|").alias("keywords"))


def I24_section_pages(spark, d):
    s = live_rows(table(spark, d, "sections"), ["collection", "parent_id"])
    return s.select("collection", "parent_id", F.array_join(T.section_path("section_path_json"), ">").alias("path"), T.first_page("page_start", "page_end").alias("page"))


def I30_years(spark, d):
    return S.state_rows(spark, d).groupBy(F.regexp_extract("last_synced_at", r"\b((?:19|20)[0-9]{2})", 1).alias("year")).agg(F.count("*").alias("n"))


def I33_display(spark, d):
    one = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ")
    title = F.when(F.length(one) > 60, F.concat(F.substring(one, 1, 60), F.lit("…"))).otherwise(one)
    return live_chunks(spark, d).select("chunk_id", title.alias("shown"), F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 3)).alias("tokens"))


def P6_record_ids(spark, d):
    s = live_rows(table(spark, d, "sections"), ["collection", "parent_id"])
    return s.select("collection", "parent_id", F.posexplode(evaluate.record_ids("child_ids_json")).alias("pos", "chunk_id"))


def M5_papers(spark, d):
    """Documents as structured papers: the section before the first heading is the abstract, one named references the references, images in the text figures."""
    s = chunking.sections(docs(spark, d).where("text is not null"))
    kind = F.when(F.col("section_no") == 0, "abstract").when(F.lower("heading").rlike("^(references?|bibliography)$"), "references").otherwise("body")
    item = F.struct(F.col("section_no").alias("no"), "heading", F.lit(1).alias("level"), F.split("body", "\n\n").alias("paragraphs"))
    g = s.withColumn("kind", kind).groupBy("doc_id").agg(
        F.max(F.when(F.col("kind") == "abstract", F.col("body"))).alias("abstract"), F.max(F.when(F.col("kind") == "references", F.col("body"))).alias("references"),
        F.array_sort(F.collect_list(F.when((F.col("kind") == "body") & (F.col("body") != ""), item))).alias("sections"))
    x = table(spark, d, "documents")
    figures = F.transform(F.array_distinct(M.image_refs("text")), lambda i: F.struct(i.alias("id"), F.lit("").alias("caption"), F.lit("").alias("description")))
    p = x.select("doc_id", "title", F.coalesce(figures, F.array().cast(chunking._ASSET)).alias("figures"), F.array().cast(chunking._ASSET).alias("tables")).join(g, "doc_id")
    return chunking.split_papers(p).select("doc_id", "chunk_index", "chunk_id", "chunk_type", F.length("text").alias("n_chars"))


def M6_parents(spark, d):
    c = chunks(spark, d).select("doc_id", "chunk_id", "chunk_index", F.col("chunk_type").alias("section"), "text", F.col("page_num").alias("page"))
    return chunking.parents(c).select("parent_id", "document_id", F.size("child_ids").alias("n_children"), F.sha2("text", 256).alias("text_hash"), "page_start", "page_end")


def M7_placeholders(spark, d):
    return chunking.with_placeholders(docs(spark, d)).select("doc_id", F.sha2("text", 256).alias("text_hash"))


def Q2_document_detail(spark, d):
    pages = live_rows(table(spark, d, "sections"), ["collection", "parent_id"]).groupBy("document_id").agg(F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))
    n = live_chunks(spark, d).groupBy(F.col("source_ref").alias("document_id")).agg(F.count("*").alias("n_chunks"), F.min("chunk_index").alias("first_index"))
    x = table(spark, d, "documents").where("collection = 'soft_matter'").select("document_id", "title", "source_path")
    return x.join(n, "document_id", "left").join(pages, "document_id", "left").fillna(0, ["n_chunks"])


def Q3_delete(spark, d):
    gone = table(spark, d, "documents").where("deleted_at is not null").select(F.col("document_id").alias("doc_id"))
    held = {
        "chunks": live_chunks(spark, d).select(F.col("source_ref").alias("doc_id")),
        "vectors": live_rows(table(spark, d, "chroma_store"), ["id"], deleted=None).select(F.regexp_extract("id", OWNER, 1).alias("doc_id")),
        "sections": live_rows(table(spark, d, "sections"), ["collection", "parent_id"]).select(F.col("document_id").alias("doc_id")),
        "section_children": live_rows(table(spark, d, "section_children"), ["collection", "child_id"], deleted=None).select(F.col("document_id").alias("doc_id")),
    }
    return L.delete_documents(held, gone)[1]


def Q4_by_item(spark, d):
    """Documents that the reference manager's items name, with their first chunk."""
    s = S.state_now(spark, d).where("document_id is not null").select("item_key", "document_id").distinct()
    order = F.struct(F.coalesce("chunk_index", F.lit(0)), "chunk_id")
    c = live_chunks(spark, d).groupBy(F.col("source_ref").alias("document_id")).agg(F.min_by("chunk_id", order).alias("first_chunk"), F.count("*").alias("n_chunks"))
    return s.join(c, "document_id").select("item_key", "document_id", "first_chunk", "n_chunks")


def E14_top_terms(spark, d):
    return M.top_terms(index.term_frequencies(live_chunks(spark, d)), 10)


QUERIES = {f.__name__: f for f in (
    C7_metadata, C8_inherited, C9_source_metadata, C11_violations, A14_images, E13_image_stats, E14_stage_summary, E14_top_terms, E15_ingest_totals, B7_section_store, B10_table_files, B14_manifest,
    Q6_execute, I18_titles, I19_previews, I20_tags, I21_identifiers, I24_section_pages, I30_years, I33_display, P6_record_ids, M5_papers, M6_parents, M7_placeholders, Q2_document_detail, Q3_delete, Q4_by_item)}

_IMG = """refs as (select chunk_id, source_ref doc_id, collection, loaded_at, unnest(rs) image_id, unnest(range(len(rs))) pos
 from (select *, list_transform(regexp_extract_all(text, '\\[IMAGE:\\s*([^\\]]+)\\]', 1), lambda x: trim(x)) rs from live)),
img as (select doc_id, image_id, try_cast(nullif(regexp_extract(image_id, '^[0-9a-fA-F]+_(\\d+)_\\d+$', 1), '') as int) page, min(collection) collection, min(loaded_at) created_at from refs group by all)"""
_FIRST = "fc as (select source_ref doc_id, arg_min(text, (coalesce(chunk_index, 0), chunk_id)) first_text, min(source_path) path from live group by 1)"
_LINES = r"list_transform(string_split(first_text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g'))"
_GONE = "(select document_id from documents where deleted_at is not null and document_id is not null)"
_K = S._K
_TABLE_CTES = TEXT_SQL["M7_tables"][: TEXT_SQL["M7_tables"].index(",\ne as (")]

SQL = {
    "C7_metadata": f"with {S._SEC} select collection, parent_id, key, json_extract_string(metadata_json, '$.\"' || key || '\"') as value from (select *, unnest(json_keys(metadata_json)) as key from sec) where key <> 'source_path' and not starts_with(key, '_') and json_extract_string(metadata_json, '$.\"' || key || '\"') is not null",
    "C8_inherited": f"""with {LIVE}, {_IMG}, f as (select chunk_id, string_agg(image_id, ',' order by pos) image_refs, count(page_of.image_id) n_images, arg_min(page_of.page, pos) filter (page_of.image_id is not null) page_num
 from refs left join img page_of using (doc_id, image_id) group by 1)
select live.chunk_id, 'chunk_index' || case when document_id is not null and doc_type is not null then ',doc_type' else '' end || ',source_ref' || case when title is not null then ',title' else '' end keys, title,
 coalesce(image_refs, '') image_refs, coalesce(n_images, 0) n_images, f.page_num from live left join documents on source_ref = document_id left join f using (chunk_id)""",
    "C9_source_metadata": f"""with {S.STATE}, s as (select document_id, min((item_key, coalesce(source_version, ''))) s from now_ where document_id is not null group by 1)
select document_id, 'title' as key, case when s is null then coalesce(title, '') else 'synced' end as value from documents left join s using (document_id) union all select document_id, 'source_path', coalesce(source_path, '') from documents
 union all select document_id, 'item_key', s[1] from documents join s using (document_id) union all select document_id, 'source_version', s[2] from documents join s using (document_id)""",
    "C11_violations": """with v as (select *, len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) n_bad, len(list_filter(vector, lambda x: x is null or x <> 0)) n_other from chroma_store)
select unnest(['no_id', 'no_vector', 'wrong_length', 'not_finite', 'all_zero']) as rule, unnest([count(*) filter (coalesce(id, '') = ''), count(*) filter (vector is null), count(*) filter (len(vector) <> 64),
 count(*) filter (n_bad > 0), count(*) filter (n_other = 0)]) n_rows from v""",
    "A14_images": f"with {LIVE}, {_IMG} select image_id, doc_id, page, collection, created_at from img where collection in ('soft_matter', 'vesicles')",
    "E13_image_stats": f"with {LIVE}, {_IMG} select collection, count(*) n_images, count(distinct doc_id) n_documents, max(page) last_page from img group by 1",
    "E14_stage_summary": f"""with {LIVE} select source_ref doc_id, count(*) chunk_count, (sum(length(coalesce(text, ''))) // count(*))::bigint avg_chunk_size, count(chunk_type) n_typed,
 count(*) filter (regexp_matches(text, '\\[IMAGE:\\s*([^\\]]+)\\]')) n_with_images from live group by 1""",
    "E14_top_terms": f"with {LIVE}, {TF} select chunk_id, row_number() over (partition by collection, chunk_id order by tf desc, term)::int as rank, term, tf from tf qualify rank <= 10",
    "E15_ingest_totals": f"""with {S.STATE}, {LIVE}, n as (select source_ref document_id, count(*) n from live group by 1)
select count(*) n_files, count(*) filter (status = 'synced') n_successful, count(*) filter (status = 'error') n_failed, count(*) filter (status = 'inactive') n_skipped,
 coalesce(sum(n) filter (status = 'synced'), 0)::bigint n_chunks from now_ left join n using (document_id)""",
    "B7_section_store": f"""with a as (select *, loaded_at >= timestamp '2031-10-01' late from sections), b as (select * from (select *, row_number() over (partition by collection, parent_id, late order by loaded_at desc) rn from a) where rn = 1 and deleted_at is null),
c as (select * from b where late or not exists (select 1 from b n where n.late and n.collection is not distinct from b.collection and n.parent_id is not distinct from b.parent_id))
select collection, parent_id, document_id, sha256(text) text_hash, case when collection = 'vesicles' then 'yes' else 'no' end reviewed from c where document_id is null or document_id not in {_GONE}""",
    "B10_table_files": f"with t as ({TEXT_SQL['M7_tables']}) select coalesce(collection, 'default') collection, count(*) n_tables, sum(n_rows)::bigint n_rows from t join documents using (doc_id) group by 1",
    "B14_manifest": f"with p as ({S.SQL['D9_sync_plan']}) select target_collection, action, count(*) n from p group by all",
    "Q6_execute": f"""with {S.STATE}, p as (select a.*, case when b.item_key is null then 'add' when b.status = 'synced' and b.file_sha256 is not distinct from a.file_sha256
 and b.source_version is not distinct from a.source_version then 'skip' else 'update' end action from after_ a left join before_ b on {S._SAME})
select {_K}, file_sha256, source_version, 'synced' status from p where action <> 'skip' union all select {_K}, file_sha256, source_version, status from before_ b where exists (select 1 from p a where action = 'skip' and {S._SAME})
 union all select {_K}, file_sha256, source_version, 'inactive' from before_ b where not exists (select 1 from p a where {S._SAME})""",
    "I18_titles": f"""with {LIVE}, {_FIRST}, a as (select fc.*, case when doc_type = 'paper' then title end title, list_filter({_LINES}[1:10], lambda s: starts_with(s, '# '))[1] head,
 regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), '[_-]', ' ', 'g') stem from fc left join documents on fc.doc_id = document_id)
select doc_id, coalesce(nullif(title, ''), trim(substr(head, 3)), nullif(array_to_string(list_transform(string_split(stem, ' '), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' '), ''), 'Untitled Document') title from a""",
    "I19_previews": f"""with {LIVE}, {_FIRST}, a as (select doc_id, first_text, array_to_string(list_filter({_LINES}, lambda s: s <> '' and not starts_with(s, '#')), ' ') t from fc)
select doc_id, case when coalesce(first_text, '') = '' then 'No summary available.' when t = '' then 'No content preview available.' when length(t) > 500 then substr(t, 1, 497) || '...' else t end summary from a""",
    "I20_tags": """with a as (select doc_id, doc_type, list_filter(list_transform(string_split(concat_ws(', ', collection, source), ','), lambda t: trim(t)), lambda t: t <> '') g from documents)
select doc_id, array_to_string(case when coalesce(doc_type, '') <> '' and not list_contains(g, upper(doc_type)) then list_append(g, upper(doc_type)) else g end, '|') tags from a""",
    "I21_identifiers": r"""select doc_id, nullif(regexp_replace(regexp_extract(text, '(?i)(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)', 1), '[.,;:]+$', ''), '') doi, nullif(regexp_extract(text, '(?i)arXiv:\s*([0-9]{4}\.[0-9]{4,5})', 1), '') arxiv,
 try_cast(nullif(regexp_extract(text, '\b(19[0-9]{2}|20[0-9]{2})\b', 1), '') as int) as year, nullif(regexp_extract(text, '\b((?:Proceedings|Conference|Journal)\b[^\n]+)', 1), '') venue,
 array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(text, '(?im)^\s*keywords\s*[:：]\s*(.+)$', 1), '[,;]'), lambda x: trim(x)), lambda x: x <> ''), '|') keywords from documents where text is not null""",
    "I24_section_pages": f"with {S._SEC} select collection, parent_id, coalesce(array_to_string(list_filter(list_transform(from_json(section_path_json, '[\"VARCHAR\"]'), lambda x: trim(x)), lambda x: x <> ''), '>'), '') path, coalesce(page_start, page_end)::int page from sec",
    "I30_years": "select regexp_extract(last_synced_at, '\\b((?:19|20)[0-9]{2})', 1) as year, count(*) n from zotero_sync_state group by 1",
    "I33_display": f"with {LIVE}, a as (select chunk_id, replace(coalesce(text, ''), chr(10), ' ') t from live) select chunk_id, case when length(t) > 60 then substr(t, 1, 60) || '…' else t end shown, greatest(1, length(t) // 3)::bigint tokens from a",
    "P6_record_ids": f"with {S._SEC}, a as (select collection, parent_id, from_json(child_ids_json, '[\"VARCHAR\"]') ids from sec) select collection, parent_id, (unnest(range(len(ids))))::int pos, unnest(ids) chunk_id from a",
    "M6_parents": f"""with recursive {LIVE}, o as (select source_ref doc_id, chunk_id, coalesce(chunk_type, '') s, coalesce(text, '') text, page_num, row_number() over (partition by source_ref order by coalesce(chunk_index, 0), chunk_id, coalesce(chunk_type, '')) i from live),
w as (select doc_id, i, chunk_id, s, text, page_num, 0 g, length(text) n from o where i = 1 union all
 select o.doc_id, o.i, o.chunk_id, o.s, o.text, o.page_num, w.g + case when w.s <> o.s or w.n + length(o.text) > 1200 then 1 else 0 end, case when w.s <> o.s or w.n + length(o.text) > 1200 then length(o.text) else w.n + length(o.text) end
 from w join o on o.doc_id is not distinct from w.doc_id and o.i = w.i + 1)
select concat_ws('_', 'section', doc_id, lpad(g::varchar, 4, '0'), substr(sha256(concat_ws(':', doc_id, g::varchar, max(s))), 1, 12)) parent_id, doc_id document_id, count(*)::int n_children,
 sha256(string_agg(text, chr(10) || chr(10) order by i)) text_hash, min(page_num) page_start, max(page_num) page_end from w group by doc_id, g""",
    "M7_placeholders": f"""{_TABLE_CTES}, f as (select *, table_no > 0 and stop = first and bar inside from d)
select doc_id, sha256(string_agg(case when starts and inside then '[TABLE: ' || substr(sha256(coalesce(source_path, '')), 1, 8) || '_table_' || lpad(table_no::varchar, 2, '0') || ']' else line end, chr(10) order by pos)) text_hash
 from f where line is not null and (not inside or starts or inside is null) group by doc_id""",
    "Q2_document_detail": f"""with {LIVE}, {S._SEC}, n as (select source_ref document_id, count(*) n_chunks, min(chunk_index) first_index from live group by 1), p as (select document_id, min(page_start) first_page, max(page_end) last_page from sec group by 1)
select document_id, title, source_path, coalesce(n_chunks, 0) n_chunks, first_index, first_page, last_page from documents left join n using (document_id) left join p using (document_id) where collection = 'soft_matter'""",
    "Q3_delete": f"""with {LIVE}, {S._SEC}, {S._CH}, v as (select regexp_extract(id, '{OWNER}', 1) doc from (select *, row_number() over (partition by id order by loaded_at desc) rn from chroma_store) where rn = 1),
x as (select 'chunks' store, source_ref doc from live union all select 'vectors', doc from v union all select 'sections', document_id from sec union all select 'section_children', document_id from ch)
select store, count(*) n_before, count(*) filter (doc in {_GONE}) n_deleted from x group by 1""",
    "Q4_by_item": f"""with {S.STATE}, {LIVE}, c as (select source_ref document_id, arg_min(chunk_id, (coalesce(chunk_index, 0), chunk_id)) first_chunk, count(*) n_chunks from live group by 1)
select distinct item_key, document_id, first_chunk, n_chunks from now_ join c using (document_id)""",
}
SQL["M6_parent_groups"] = SQL["M6_parents"][: SQL["M6_parents"].index("select concat_ws")] + "select doc_id, chunk_id, g group_no from w"
