"""Queries on stored indexes, filtered and degraded search, context, evidence and evaluation details."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, evidence, fuse, index, retrieve
from ..operators.versions import live_rows
from ..session import materialize, scratch_dir
from ..sources import postings as stored
from ..sources.tables import table
from . import retrieval as R

TAGS = ["soft_matter", "table", "vesicles"]
EXTRA_STOPWORDS, DROPPED_STOPWORDS = ["said", "regime"], ["what", "is"]


def _index(spark, d):
    """An index written in two loads, the second with changed, new and deleted chunks."""
    path = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    rows, cut = table(spark, d, "chunks"), F.lit("2031-10-01").cast("timestamp_ntz")
    for part in (rows.where(F.col("loaded_at") < cut), rows.where(F.col("loaded_at") >= cut)):
        stored.append_index(index.term_frequencies(live_rows(part, ["chunk_id"])), part.select("chunk_id", F.col("loaded_at").alias("at")), path)
    return stored.read_index(spark, path)


def A6_stored_index(spark, d):
    idx = _index(spark, d)
    return index.term_stats(idx.postings).select("collection", "term", "df", F.round("idf", 9).alias("idf"))


def J2_stored_stats(spark, d):
    return _index(spark, d).stats.select("collection", "num_docs", F.round("avg_doc_length", 6).alias("avg_doc_length"))


def L1_bm25_stored(spark, d):
    return R.shown(stored.stored_bm25(R.asked(spark, d), _index(spark, d), 10))


def _tagged(spark, d, ranked):
    c = R.live_chunks(spark, d).select("chunk_id", "source_path", "chunk_type", "collection", F.array_compact(F.array("chunk_type", "collection")).alias("tags"))
    return ranked.join(c, "chunk_id")


def C4_tags(spark, d):
    r = _tagged(spark, d, fuse.rrf(R.lists(spark, d)))
    return R.shown(r.where(evidence.post_filter({"tags": TAGS, "source_path": "zotero"})))


def L5_hybrid_filtered(spark, d):
    """The whole chain: over-fetch, fuse, filter, demote, cut."""
    wide = fuse.fuse(R.lists(spark, d), top=evidence.candidate_count(10, 3, 25))
    kept = _tagged(spark, d, wide).where(evidence.post_filter({"tags": TAGS}))
    ranked = fuse.demote(kept.select("query_id", "chunk_id", "score", "rank"), R.live_chunks(spark, d).select("chunk_id", "chunk_type"))
    return R.shown(ranked.where(F.col("rank") <= evidence.result_count(None)))


def L7_degraded(spark, d):
    return evidence.degraded(R.golden(spark, d), *R.lists(spark, d))


def _asked_mode(c: str = "query_type"):
    return F.when(F.col(c) == "comparison", "section").when(F.col(c) == "method", "evidence").otherwise("hybrid")


def L13_modes(spark, d):
    """The type of a query stands for the mode asked for; the store of sections is taken as absent, so that section search falls back."""
    g = R.golden(spark, d).select("query_id", _asked_mode().alias("asked"))
    s = g.select("query_id", "asked", evidence.selected_mode(F.col("asked"), False).alias("s"), evidence.default_mode(F.col("asked")).alias("expansion"))
    return s.select("query_id", "asked", "s.mode", "s.fallback", "expansion")


def _context(spark, d, mode, budget):
    key = F.concat_ws("|", "collection", "parent_id")
    ranked = materialize(fuse.rrf(R.lists(spark, d)), "ranking")  # read three times
    r = R.with_chunks(spark, d, ranked).join(R._parents(spark, d), ["collection", "chunk_id"], "left").withColumn("parent_key", F.when(F.col("parent_id").isNotNull(), key))
    s = live_rows(table(spark, d, "sections"), ["collection", "parent_id"]).select(key.alias("parent_key"), F.col("text").alias("parent_text"))
    c = R.live_chunks(spark, d).select(F.col("source_ref").alias("doc_id"), "chunk_id", "chunk_index", "text")
    near = evidence.neighbour_context(ranked, c).withColumnRenamed("context", "near_text")
    out = evidence.expand_context(r.select("query_id", "chunk_id", "rank", "parent_key"), s, near, mode, budget)
    return out.select("query_id", "chunk_id", "rank", "kind", F.sha2(F.coalesce("context", F.lit("")), 256).alias("context_hash"))


def _cited(spark, d, lists):
    """Results with the section they lie in."""
    key = F.concat_ws("|", "collection", "parent_id")
    r = R.with_chunks(spark, d, fuse.rrf(lists)).join(R._parents(spark, d), ["collection", "chunk_id"], "left")
    s = live_rows(table(spark, d, "sections"), ["collection", "parent_id"]).select(
        key.alias("parent_key"), "page_start", "page_end", F.array_join(T.section_path("section_path_json"), "/").alias("section_path"))
    return r.withColumn("parent_key", F.when(F.col("parent_id").isNotNull(), key)), s


def L16_citation_pages(spark, d):
    r, s = _cited(spark, d, R.lists(spark, d))
    return evidence.citations(r.join(s, "parent_key", "left")).select("query_id", "index", "chunk_id", "locator")


def _evidence(spark, d):
    """The evidence rows, and the ranking they are made of; both rankings and the fused one are read several times, so they are written down, without the texts."""
    sparse, dense = (materialize(x, "list") for x in R.lists(spark, d))
    r, s = _cited(spark, d, [sparse, dense])
    r = materialize(r.select("query_id", "chunk_id", "rank", "score", "doc_id", "page_num", "parent_key"), "ranking")
    return evidence.evidence_rows(r, {"dense": dense, "bm25": sparse}, s), r


def L17_evidence_rows(spark, d):
    return _evidence(spark, d)[0]


def L17_coverage(spark, d):
    rows, r = _evidence(spark, d)
    b = evidence.evidence_bundle(R.golden(spark, d), rows, evidence.handoff(R.asked(spark, d), r))
    return b.select("query_id", "n_evidence", "coverage", "action", F.size(F.from_json("bundle", "array<struct<chunk_id:string>>")).alias("n_in_bundle"))


def E5_success_rates(spark, d):
    got = fuse.rrf(R.lists(spark, d)).select("query_id").distinct().withColumn("got", F.lit(True))
    rel = R.qrels(spark, d).select("query_id").distinct().withColumn("judged", F.lit(True))
    j = R.golden(spark, d).select("query_id").join(got, "query_id", "left").join(rel, "query_id", "left")
    m = evaluate.success_rates(j.select(F.coalesce("got", F.lit(False)).alias("got"), F.coalesce("judged", F.lit(False)).alias("judged")))
    return m.select("n_queries", *[F.round(c, 6).alias(c) for c in ("retrieval_success_rate", "evaluation_success_rate")])


def E7_strict_mean(spark, d):
    m = evaluate.strict_means(evaluate.per_query(fuse.rrf(R.lists(spark, d)), R.qrels(spark, d)))
    return m.select(*[F.round(c, 6).alias(c) for c in evaluate.METRICS])


def H6_same_candidates(spark, d):
    r, s = R._overlap(spark, d)
    return evaluate.same_candidates(r, fuse.rerank(r, s))


def P7_composite(spark, d):
    """Metrics of the fused and of the reranked ranking, merged by name; where both have one, that of the reranked counts."""
    r, s = R._overlap(spark, d)
    q = R.qrels(spark, d)
    first = evaluate.per_query(r, q).select("query_id", *[F.col(m) for m in ("hit_rate", "mrr")])
    second = evaluate.per_query(fuse.rerank(r, s, recall_safe=True), q).select("query_id", "mrr", "ndcg")
    return evaluate.composite([first, second]).withColumn("value", F.round("value", 6))


def P13_candidates(spark, d):
    r = R.with_chunks(spark, d, fuse.rrf(R.lists(spark, d), top=15))
    return r.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), T.snippet("text").alias("snippet"))


def H2_keywords_edited(spark, d):
    k = T.keywords("query", stopwords=T.edited_stopwords(EXTRA_STOPWORDS, DROPPED_STOPWORDS))
    return R.golden(spark, d).select("query_id", F.posexplode(k).alias("pos", "keyword"))


QUERIES = {
    "A6_stored_index": A6_stored_index,
    "J2_stored_stats": J2_stored_stats,
    "L1_bm25_stored": L1_bm25_stored,
    "C4_tags": C4_tags,
    "L5_hybrid_filtered": L5_hybrid_filtered,
    "L7_degraded": L7_degraded,
    "L13_modes": L13_modes,
    "L12_adaptive": lambda s, d: _context(s, d, "adaptive", 2500),
    "L12_neighbors": lambda s, d: _context(s, d, "neighbors", 2500),
    "L16_citation_pages": L16_citation_pages,
    "L17_evidence_rows": L17_evidence_rows,
    "L17_coverage": L17_coverage,
    "E5_success_rates": E5_success_rates,
    "E7_strict_mean": E7_strict_mean,
    "H6_same_candidates": H6_same_candidates,
    "P7_composite": P7_composite,
    "P13_candidates": P13_candidates,
    "H2_keywords_edited": H2_keywords_edited,
}

_TAGGED = f"tg as (select chunk_id, source_path, chunk_type, collection, list_has_any([chunk_type, collection], {TAGS}) hit from live)"
_EDITED = R.TOKENS.replace(R._STOP, ", ".join(f"'{w}'" for w in [w for w in R.T.STOPWORDS if w not in DROPPED_STOPWORDS] + EXTRA_STOPWORDS))
_SECP = """secp as (select collection || '|' || parent_id parent_key, text ptext, page_start, page_end, array_to_string(from_json(section_path_json, '["VARCHAR"]'), '/') section_path
 from (select *, row_number() over (partition by collection, parent_id order by loaded_at desc) rn from sections) where rn = 1 and deleted_at is null)"""
_CITED = f"""{R._TOP}, {R._CHUNKS}, {R._PAR}, {_SECP},
cp as (select ck.*, ck.collection || '|' || par.parent_id parent_key from ck left join par on par.collection = ck.collection and par.chunk_id = ck.chunk_id),
ce as (select cp.*, page_start, page_end, section_path, ptext from cp left join secp using (parent_key))"""
_NEARTEXT = """nt as (select rt.query_id, rt.chunk_id, coalesce(p.text, '') || case when p.text is not null and n.text is not null then chr(10) || chr(10) else '' end || coalesce(n.text, '') near_text
 from rt join near using (chunk_id) left join live p on p.chunk_id = previous_chunk_id left join live n on n.chunk_id = next_chunk_id)"""


def _walk(mode: str, budget: int) -> str:
    choose = "case when length(ptext) <= room then 'parent' else 'neighbors' end" if mode == "adaptive" else f"'{mode}'"
    return f"""with recursive {R.BOTH.removeprefix('with ')}, {_CITED}, {R._NEAR}, {_NEARTEXT},
it as (select ce.query_id, ce.chunk_id, ce.rank, ptext, near_text, row_number() over (partition by ce.query_id order by ce.rank) o from ce left join nt using (query_id, chunk_id)),
wk as (
  select query_id, 0::bigint o, null::varchar chunk_id, null::int as rank, null::varchar kind, null::varchar context, {budget}::bigint room from (select distinct query_id from it)
  union all
  select query_id, o, chunk_id, rank, case when length(body) > 0 and room > 0 then kind end, case when length(body) > 0 and room > 0 then substr(body, 1, room::int) end, room - least(coalesce(length(body), 0), greatest(room, 0))
  from (select it.query_id, it.o, it.chunk_id, it.rank, room, {choose} kind, case when {choose} = 'parent' then ptext else near_text end body from wk join it on it.query_id = wk.query_id and it.o = wk.o + 1)
)
select query_id, chunk_id, rank, kind, sha256(coalesce(context, '')) context_hash from wk where o > 0"""


SQL = {
    "A6_stored_index": f"with {R.LIVE}, {R.TF} select collection, term, df, round({R._IDF}, 9) idf from dfs join cs using (collection)",
    "J2_stored_stats": f"with {R.LIVE}, {R.TF} select collection, num_docs, round(avgdl, 6) avg_doc_length from cs",
    "L1_bm25_stored": R.SQL["L1_bm25_topk"],
    "C4_tags": f"{R.BOTH}, {R._TOP}, {_TAGGED} select {R._SHOW} from rt join tg using (chunk_id) where hit and contains(source_path, 'zotero')",
    "L5_hybrid_filtered": f"""{R.BOTH}, {R.FUSED.replace('qualify rank <= 10', 'qualify rank <= 25')}, {_TAGGED},
dm as (select query_id, chunk_id, case when chunk_type = 'reference' then score * 0.3::double else score end score from fr join tg using (chunk_id) where hit)
select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank, round(score, 6) score from dm qualify rank <= 5""",
    "L7_degraded": f"""{R.BOTH} select query_id, coalesce(a.n, 0) n_sparse, coalesce(b.n, 0) n_dense, (coalesce(a.n, 0) = 0) <> (coalesce(b.n, 0) = 0) used_fallback
 from gold left join (select query_id, count(*) n from bmr group by 1) a using (query_id) left join (select query_id, count(*) n from dnr group by 1) b using (query_id)""",
    "L13_modes": f"""with {R.GOLD}, a as (select query_id, case query_type when 'comparison' then 'section' when 'method' then 'evidence' else 'hybrid' end asked from gold)
select query_id, asked, case asked when 'section' then 'hybrid' else asked end as mode, asked = 'section' fallback, case asked when 'section' then 'parent' when 'evidence' then 'none' else 'adaptive' end expansion from a""",
    "L12_adaptive": _walk("adaptive", 2500),
    "L12_neighbors": _walk("neighbors", 2500),
    "L16_citation_pages": f"{R.BOTH}, {_CITED} select query_id, rank as index, chunk_id, 'p. ' || coalesce(page_num, page_start) locator from ce",
    "L17_evidence_rows": f"""{R.BOTH}, {_CITED} select query_id, chunk_id, ce.rank, doc_id document_id, parent_key, section_path, coalesce(page_start, page_num) page_start, coalesce(page_end, page_start, page_num) page_end,
 round(dnr.score, 6) dense_score, round(bmr.score, 6) bm25_score, round(ce.score, 6) final_score from ce left join dnr using (query_id, chunk_id) left join bmr using (query_id, chunk_id)""",
    "L17_coverage": f"""with h as ({R.SQL['L15_handoff']}), e as ({R.BOTH}, {_CITED} select query_id, count(*) n from ce group by 1)
select query_id, coalesce(n, 0) n_evidence, signal coverage, case when documents <> '' then 'read_fulltext' end as action, coalesce(n, 0)::int n_in_bundle from h left join e using (query_id)""",
    "E5_success_rates": f"""{R.BOTH}, {R.QREL} select count(*) n_queries, round(avg(case when g.query_id is not null then 1.0::double else 0 end), 6) retrieval_success_rate,
 round(avg(case when g.query_id is not null and q.query_id is not null then 1.0::double else 0 end), 6) evaluation_success_rate
 from gold left join (select distinct query_id from rr) g using (query_id) left join (select distinct query_id from qrel) q using (query_id)""",
    "E7_strict_mean": f"{R.BOTH}, {R.QREL}, {R._TOP}, {R._metrics('rt', 'm')} select {R._AVGS} from m",
    "H6_same_candidates": f"""{R.BOTH}, {R.OVERLAP}, n as (select query_id, count(*) n from rt group by 1),
x as (select query_id, count(*) n_left, count(*) filter (s is not null or n = 1) n_kept from rt join n using (query_id) left join ov using (query_id, chunk_id) group by 1)
select query_id, n_left = n_kept same from x""",
    "P7_composite": f"""{R.BOTH}, {R.QREL}, {R.OVERLAP}, re as (select query_id, chunk_id, row_number() over (partition by query_id order by round(s, 9) desc nulls last, rank)::int as rank from rt left join ov using (query_id, chunk_id)),
{R._metrics('rt', 'm')}, {R._metrics('re', 'k')} select query_id, metric, round(v, 6) as value from (select query_id, 'hit_rate' metric, hit_rate v from m union all select query_id, 'mrr', mrr from k union all select query_id, 'ndcg', ndcg from k)""",
    "P13_candidates": f"""{R.BOTH} select query_id, rank, chunk_id, round(score, 6) score,
 case when length({R._SNIP}) <= 200 then {R._SNIP} else regexp_replace(substr({R._SNIP}, 1, 200), ' [^ ]*$', '') || '...' end snippet from rr join live using (chunk_id) where rank <= 15""",
    "H2_keywords_edited": f"with {R.GOLD}, {_EDITED} select query_id, (pos - 1)::int pos, term keyword from kw",
}

_FP = f"coalesce(sha256(lower({R._SNIP})), 'null:' || chunk_id)"
SQL["L11_dedupe"] = f"""with recursive {R.BOTH.removeprefix('with ')}, {R._PAR},
it as (select query_id, chunk_id, rank, {_FP} fp, parent_id, row_number() over (partition by query_id order by rank) o
 from (select rr.*, text, collection from rr join live using (chunk_id) where rank <= 20) left join par using (collection, chunk_id)),
wk as (
  select query_id, 0::bigint o, []::varchar[] ids, []::varchar[] fps, []::varchar[] ps from (select distinct query_id from it)
  union all
  select query_id, o, case when keep then list_append(ids, chunk_id) else ids end, case when keep then list_append(fps, fp) else fps end, case when keep then list_append(ps, parent_id) else ps end
  from (select it.query_id, it.o, ids, fps, ps, chunk_id, fp, parent_id, len(ids) < 5 and not list_contains(ids, chunk_id) and not list_contains(fps, fp)
    and (parent_id is null or len(list_filter(ps, lambda p: p = parent_id)) < 2) keep from wk join it on it.query_id = wk.query_id and it.o = wk.o + 1)
),
en as (select query_id, arg_max(ids, o) ids from wk group by 1),
ou as (select query_id, unnest(ids) chunk_id, unnest(range(1, len(ids) + 1))::int as rank from en)
select ou.query_id, ou.chunk_id, it.rank old_rank, ou.rank from ou join it using (query_id, chunk_id)"""
