"""Queries on text rules, chunking, transforms and query parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..session import spread
from ..sources.tables import table
from .retrieval import GOLD, LIVE, TOKENS, golden, live_chunks


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _typed(spark, d):
    """Golden queries with filters written into them."""
    g = golden(spark, d)
    return g.select("query_id", F.concat_ws(" ", "query", F.concat(F.lit("c:"), "collection"), F.concat(F.lit("tags:"), "query_type", F.lit(",x")), F.lit("Lang:de")).alias("query"))


def C1_filter_syntax(spark, d):
    q = _typed(spark, d).select("query_id", F.explode(T.filter_pairs("query")).alias("p"))
    return q.select("query_id", "p.key", "p.value")


def I3_query_tokens(spark, d):
    return golden(spark, d).select("query_id", F.posexplode(T.query_tokens(T.without_filters("query"))).alias("pos", "token"))


def I4_keywords(spark, d):
    return golden(spark, d).select("query_id", F.posexplode(T.keywords("query")).alias("pos", "keyword"))


def N1_refine(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.refine("text"), 256).alias("refined_hash"))


def N3_enrich(spark, d):
    """Titles, summaries and tags of live chunks; the LLM variant replaces them with ``coalesce(llm, rule)``."""
    return live_chunks(spark, d).select("chunk_id", T.title("text").alias("title"), T.summary("text").alias("summary"), F.array_join(T.tags("text"), "|").alias("tags"))


def M3_sections(spark, d):
    s = chunking.sections(docs(spark, d).where("text is not null"))
    return s.select("doc_id", "section_no", "heading", F.sha2("body", 256).alias("body_hash"))


def M4_reference_sections(spark, d):
    s = chunking.sections(docs(spark, d).where("text is not null"))
    return s.groupBy(F.when(F.lower(F.trim("heading")).rlike(r"^(references?|bibliography|参考文献|引用文献|参考)$"), "reference").otherwise("text").alias("chunk_type")).agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("n_chars"))


def M1_split(spark, d):
    c = chunking.split_documents(docs(spark, d).select("doc_id", "text"))
    return c.select("doc_id", "chunk_index", "chunk_id", F.length("text").alias("n_chars"))


def M6_parent_groups(spark, d):
    return chunking.parent_groups(live_chunks(spark, d).select(F.col("source_ref").alias("doc_id"), "chunk_id", "chunk_index", F.col("chunk_type").alias("section"), "text"))


def M7_tables(spark, d):
    return chunking.tables(docs(spark, d))


def I10_chunk_ids(spark, d):
    return live_chunks(spark, d).select("chunk_id", T.chunk_id("source_ref", F.coalesce("chunk_index", F.lit(0)), "text").alias("expected_id"))


def I21_paper_fields(spark, d):
    t = F.col("text")
    return docs(spark, d).select(
        "doc_id", F.size(T.extract_all(t, r"\[\d+(?:, ?\d+)*\]")).alias("n_citations"), F.regexp_extract(t, r"\b((?:19|20)\d\d)\b", 1).alias("year"),
        F.size(T.extract_all(t, r"(?m)^#{1,6}\s+\S[^\n]*$")).alias("n_headings"), F.size(T.extract_all(t, r"\$[^$\n]+\$")).alias("n_equations"),
    ).where("n_citations >= 0")


def C2_merged_filters(spark, d):
    """Filters written into the query, under those given beside it."""
    given = F.when(F.col("query_type").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("tags"), "query_type"))
    q = _typed(spark, d).join(golden(spark, d).select("query_id", given.alias("explicit")), "query_id").select("query_id", T.filter_map("query").alias("parsed"), "explicit")
    return q.select("query_id", F.explode(T.merged_filters("parsed", "explicit")).alias("key", "value"))


def I22_annotations(spark, d):
    c = live_chunks(spark, d)
    return c.select("chunk_id", F.size(T.extract_all("text", r"\[IMAGE: [^\]]+\]")).alias("n_images"), F.size(T.extract_all("text", r"\$[^$\n]+\$")).alias("n_equations"), F.size(T.citation_contexts("text")).alias("n_contexts"), F.size(T.extract_all("text", r"\[[0-9,\s]+\]")).alias("n_citations")).where("n_images >= 0")


QUERIES = {
    "C2_merged_filters": C2_merged_filters,
    "I22_annotations": I22_annotations,
    "C1_filter_syntax": C1_filter_syntax,
    "I3_query_tokens": I3_query_tokens,
    "I4_keywords": I4_keywords,
    "I1_normalize": lambda s, d: docs(s, d).select("doc_id", F.sha2(T.collapse("text"), 256).alias("normal_hash")),
    "I12_fingerprint": lambda s, d: docs(s, d).select("doc_id", T.fingerprint("text").alias("fingerprint")),
    "I13_snippet": lambda s, d: docs(s, d).select("doc_id", T.snippet("text").alias("snippet")),
    "I14_title": lambda s, d: docs(s, d).select("doc_id", T.title("text").alias("title")),
    "I15_summary": lambda s, d: docs(s, d).select("doc_id", T.summary("text").alias("summary")),
    "I10_chunk_ids": I10_chunk_ids,
    "I25_locator": lambda s, d: table(s, d, "sections").select("parent_id", T.locator("page_start", "page_end").alias("locator")).distinct(),
    "I21_paper_fields": I21_paper_fields,
    "N1_refine": N1_refine,
    "N3_enrich": N3_enrich,
    "M1_split": M1_split,
    "M3_sections": M3_sections,
    "M4_reference_sections": M4_reference_sections,
    "M6_parent_groups": M6_parent_groups,
    "M7_tables": M7_tables,
}

_C = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_S = _C.format("text")
_ALIAS = " ".join(f"when '{k}' then '{v}'" for k, v in T.ALIASES.items())
_SECTIONS = """ls as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos from documents where text is not null),
nb as (select *, regexp_matches(line, '^#+\\s+\\S') h, sum(regexp_matches(line, '^#+\\s+\\S')::int) over (partition by doc_id order by pos)::int section_no from ls),
sx as (select doc_id, section_no, coalesce(max(case when h then trim(regexp_replace(line, '^#+\\s+', '')) end), '') heading,
  coalesce(regexp_replace(string_agg(line, chr(10) order by pos) filter (not h), '^\\s+|\\s+$', '', 'g'), '') body from nb group by all),
sc as (select * from (select *, max(section_no) over (partition by doc_id) = 0 only_ from sx) where section_no > 0 or body <> '' or only_)"""
_CLEANED = "regexp_replace({}, '(?is)─{{10,}}.*?(?:page \\d+|footer|section \\d+|©|confidential).*?─{{10,}}', '', 'g')"
_CLEANED = f"regexp_replace({_CLEANED}, '─{{{{10,}}}}', '', 'g')"
for _p, _r in (("(?s)<!--.*?-->", "''"), ("<[^>]+>", "''"), (" {{2,}}", "' '"), ("\\n{{3,}}", "chr(10) || chr(10)"), ("[^\\S\\n]+\\n", "chr(10)")):
    _CLEANED = f"regexp_replace({_CLEANED}, '{_p}', {_r}, 'g')"
_FENCE = "(?s)```.*?```"

SQL = {
    "C2_merged_filters": f"""with {GOLD}, q as (select query_id, query_type, concat_ws(' ', query, 'c:' || collection, 'tags:' || query_type || ',x', 'Lang:de') query from gold),
a as (select query_id, query_type, regexp_extract_all({_C.format('query')}, '{T.FILTER}', 1) ks, regexp_extract_all({_C.format('query')}, '{T.FILTER}', 2) vs from q),
p as (select query_id, query_type, unnest(ks) k, unnest(vs) v, unnest(range(len(ks))) pos from a),
l as (select query_id, query_type, coalesce(case lower(k) {_ALIAS} end, k) as key, arg_max(v, pos) as value from p group by all)
select query_id, key, value from l where key <> 'collection' and not (key = 'tags' and query_type is not null) union all select query_id, 'tags', query_type from gold where query_type is not null""",
    "I22_annotations": f"""with {LIVE} select chunk_id, len(regexp_extract_all(text, '\\[IMAGE: [^\\]]+\\]'))::int n_images, len(regexp_extract_all(text, '\\$[^$\\n]+\\$'))::int n_equations,
 len(regexp_extract_all(text, '(?s).{{0,40}}\\[[0-9,\\s]+\\].{{0,40}}'))::int n_contexts, len(regexp_extract_all(text, '\\[[0-9,\\s]+\\]'))::int n_citations from live where text is not null""",
    "C1_filter_syntax": f"""with {GOLD}, q as (select query_id, concat_ws(' ', query, 'c:' || collection, 'tags:' || query_type || ',x', 'Lang:de') query from gold),
p as (select query_id, unnest(regexp_extract_all({_C.format('query')}, '{T.FILTER}', 1)) k, unnest(regexp_extract_all({_C.format('query')}, '{T.FILTER}', 2)) v from q)
select query_id, coalesce(case lower(k) {_ALIAS} end, k) as key, v as value from p""",
    "I3_query_tokens": f"with {GOLD}, {TOKENS} select query_id, (pos - 1)::int pos, t token from qtok",
    "I4_keywords": f"with {GOLD}, {TOKENS} select query_id, (pos - 1)::int pos, term keyword from kw",
    "I1_normalize": f"select doc_id, sha256({_S}) normal_hash from documents",
    "I12_fingerprint": f"select doc_id, sha256(lower({_S})) fingerprint from documents",
    "I13_snippet": f"select doc_id, case when length({_S}) <= 200 then {_S} else regexp_replace(substr({_S}, 1, 200), ' [^ ]*$', '') || '...' end snippet from documents",
    "I14_title": r"""with a as (select doc_id, text, trim(string_split(text, chr(10))[1]) line, regexp_replace(trim(regexp_replace(text, '(?s)[.!?]\s.*$', '')), '[.!?]+$', '') fs from documents)
select doc_id, case when text is null or text = '' then 'Untitled' when regexp_matches(text, '^#{1,6}\s+[^\n]') then trim(regexp_extract(text, '^#{1,6}\s+([^\n]+)', 1))
 when line <> '' and length(line) <= 100 and not regexp_matches(line, '[.,;]$') then line when fs <> '' then case when length(fs) <= 150 then fs else substr(fs, 1, 147) || '...' end
 else trim(substr(text, 1, 100)) || case when length(text) > 100 then '...' else '' end end title from a""",
    "I15_summary": r"""with a as (select doc_id, trim(array_to_string(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:3], ' ')) s from documents)
select doc_id, coalesce(case when length(s) > 500 then substr(s, 1, 497) || '...' else s end, '') summary from a""",
    "I10_chunk_ids": f"with {LIVE} select chunk_id, source_ref || '_' || lpad(coalesce(chunk_index, 0)::varchar, 4, '0') || '_' || substr(sha256(text), 1, 8) expected_id from live",
    "I25_locator": "select distinct parent_id, case when page_start is null then null when page_end is null or page_start = page_end then 'p. ' || page_start else 'pp. ' || page_start || '–' || page_end end locator from sections",
    "I21_paper_fields": r"""select doc_id, len(regexp_extract_all(text, '\[\d+(?:, ?\d+)*\]'))::int n_citations, regexp_extract(text, '\b((?:19|20)\d\d)\b', 1) as year,
 len(regexp_extract_all(text, '(?m)^#{1,6}\s+\S[^\n]*$'))::int n_headings, len(regexp_extract_all(text, '\$[^$\n]+\$'))::int n_equations from documents where text is not null""",
    "N1_refine": f"""with a as (select doc_id, regexp_extract_all(text, '{_FENCE}') fences, string_split({_CLEANED.format(f"regexp_replace(text, '{_FENCE}', chr(1), 'g')")}, chr(1)) parts from documents),
b as (select doc_id, array_to_string(list_transform(parts, lambda p, i: p || coalesce(fences[i], '')), '') t from a)
select doc_id, sha256(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) refined_hash from b""",
    "M3_sections": f"with {_SECTIONS} select doc_id, section_no, heading, sha256(body) body_hash from sc",
    "M4_reference_sections": f"with {_SECTIONS} select case when regexp_matches(lower(trim(heading)), '^(references?|bibliography|参考文献|引用文献|参考)$') then 'reference' else 'text' end chunk_type, count(*) n, sum(length(body))::bigint n_chars from sc group by 1",
    "M7_tables": r"""with ls as (select doc_id, source_path, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos from documents),
a as (select *, contains(line, '|') bar, contains(line, '|') and regexp_matches(line, '^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$') is_rule from ls),
b as (select *, bar and not is_rule and coalesce(lead(is_rule) over (partition by doc_id order by pos), false) starts from a),
c as (select *, sum(starts::int) over w::int table_no, sum((not bar)::int) over w stop from b window w as (partition by doc_id order by pos)),
d as (select *, max(case when starts then stop end) over (partition by doc_id, table_no) first from c),
e as (select *, list_transform(string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|'), lambda x: trim(x)) cells from d where table_no > 0 and stop = first and bar and not is_rule)
select doc_id, table_no, substr(sha256(coalesce(source_path, '')), 1, 8) || '_table_' || lpad(table_no::varchar, 2, '0') table_id, len(arg_min(cells, pos))::int n_columns, (count(*) - 1)::int n_rows,
 string_agg(array_to_string(cells, ','), chr(10) order by pos) csv from e group by doc_id, source_path, table_no""",
}
