"""Queries on retrieval, fusion, evidence and ranking quality over chunks, vectors and golden queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, evidence, fuse, index, retrieve
from ..operators.lifecycle import where
from ..operators.versions import live_rows
from ..session import materialize
from ..sources.tables import table

DIM = 64


def live_chunks(spark: SparkSession, d: str) -> DataFrame:
    return live_rows(table(spark, d, "chunks"), ["chunk_id"])


def golden(spark: SparkSession, d: str) -> DataFrame:
    return live_rows(table(spark, d, "golden_test_set"), ["query_id"], deleted=None)


def asked(spark: SparkSession, d: str) -> DataFrame:
    return golden(spark, d).select("query_id", "query", "collection", T.keywords("query").alias("keywords"))


def current_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = live_rows(table(spark, d, "chroma_store"), ["id"], deleted=None)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where((F.size("vector") == DIM) & finite & F.exists("vector", lambda x: x != 0)).select(F.col("id").alias("chunk_id"), F.col("collection").alias("scope"), "vector")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vector of the first expected chunk that has one stands for the query, as no text encoder is at hand; that chunk itself is
    no result of the query."""
    e = golden(spark, d).select("query_id", "collection", F.posexplode("expected_chunk_ids").alias("pos", "chunk_id"))
    j = e.join(current_vectors(spark, d).select("chunk_id", "vector"), "chunk_id")
    first = j.groupBy("query_id").agg(F.min_by(F.struct("collection", "vector", "chunk_id"), F.col("pos")).alias("s"))
    return first.select("query_id", F.col("s.collection").alias("scope"), F.col("s.vector").alias("vector"), F.col("s.chunk_id").alias("self_id"))


def sparse_list(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return retrieve.bm25_of_texts(asked(spark, d), live_chunks(spark, d), k)


def dense_list(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return retrieve.dense(query_vectors(spark, d), current_vectors(spark, d), k)


def lists(spark: SparkSession, d: str) -> list[DataFrame]:
    return [sparse_list(spark, d), dense_list(spark, d)]


def shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def overlap_scores(spark: SparkSession, d: str, ranking: DataFrame) -> DataFrame:
    """Share of the keywords that occur in the chunk: a stand-in for a cross-encoder with the same inputs."""
    c = live_chunks(spark, d).select("chunk_id", "text")
    j = ranking.select("query_id", "chunk_id").join(asked(spark, d).select("query_id", "keywords"), "query_id").join(c, "chunk_id")
    shared = F.size(F.array_intersect("keywords", T.index_tokens("text")))  # behind the join, so only texts in the ranking are taken apart
    return j.where(F.size("keywords") > 0).select("query_id", "chunk_id", (shared / F.size("keywords")).alias("rerank_score"))


def qrels(spark: SparkSession, d: str) -> DataFrame:
    return golden(spark, d).select("query_id", F.explode("expected_chunk_ids").alias("chunk_id")).where("chunk_id is not null").distinct()


def with_chunks(spark: SparkSession, d: str, ranking: DataFrame) -> DataFrame:
    c = live_chunks(spark, d).select("chunk_id", "text", F.col("source_ref").alias("doc_id"), "source_path", "page_num", "chunk_type", "collection")
    return ranking.join(c, "chunk_id")


def L5_hybrid(spark, d):
    ranked = fuse.fuse(lists(spark, d), top=10)
    kinds = live_chunks(spark, d).select("chunk_id", "chunk_type")
    return shown(fuse.demote(ranked, kinds))


def L6_single_list(spark, d):
    """Fusion before demotion; queries without a query vector, or without a keyword in the index, keep the scores of their one list."""
    return shown(fuse.fuse(lists(spark, d), top=10))


def embeddings(spark, d):
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("chunk_id"), F.lit("all").alias("scope"), F.col("embedding").alias("vector"), "label")
    return v, v.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "scope", "vector", "label")


def L2_dense_topk(spark, d):
    v, q = embeddings(spark, d)
    return shown(retrieve.dense(q, v, 10))


def L2_dense_filtered(spark, d):
    v, q = embeddings(spark, d)
    v = v.where(where({"label": {"$in": [1, 2, 3]}}))
    return shown(retrieve.dense(q, v, 10))


def _overlap(spark, d):
    r = materialize(fuse.rrf(lists(spark, d)), "ranking")  # read three times
    return r, overlap_scores(spark, d, r)


def L9_rerank_overlap(spark, d):
    r, s = _overlap(spark, d)
    return shown(fuse.rerank(r, s))


def L10_conservative(spark, d):
    r, s = _overlap(spark, d)
    return shown(fuse.conservative(r, s, 0.5, 10))


def C4_post_filter(spark, d):
    r = with_chunks(spark, d, fuse.rrf(lists(spark, d)))
    return shown(r.where(where({"chunk_type": "text"}) & F.col("source_path").contains("zotero")))


def C5_scope(spark, d):
    r = with_chunks(spark, d, fuse.rrf(lists(spark, d)))
    wanted = table(spark, d, "zotero_sync_state").where("status = 'synced'").select(F.col("document_id").alias("doc_id")).where("doc_id is not null").distinct()
    return shown(r.join(wanted, "doc_id", "left_semi"))


def _parents(spark, d):
    ch = live_rows(table(spark, d, "section_children"), ["collection", "child_id"], deleted=None)
    return ch.select("collection", F.col("child_id").alias("chunk_id"), "parent_id")


def L11_dedupe(spark, d):
    r = with_chunks(spark, d, fuse.rrf(lists(spark, d), top=20)).join(_parents(spark, d), ["collection", "chunk_id"], "left")
    return evidence.deduplicate(r, 5)


def L12_parent_budget(spark, d):
    r = with_chunks(spark, d, fuse.rrf(lists(spark, d))).join(_parents(spark, d), ["collection", "chunk_id"], "left")
    key = F.concat_ws("|", "collection", "parent_id")
    s = live_rows(table(spark, d, "sections"), ["collection", "parent_id"]).select(key.alias("parent_key"), F.col("text").alias("parent_text"))
    out = evidence.parent_context(r.withColumn("parent_key", F.when(F.col("parent_id").isNotNull(), key)), s, 1500)
    return out.select("query_id", "chunk_id", "rank", F.length("context").alias("n_context"), F.sha2(F.coalesce("context", F.lit("")), 256).alias("context_hash"))


def D5_neighbor_text(spark, d):
    c = live_chunks(spark, d).select(F.col("source_ref").alias("doc_id"), "chunk_id", "chunk_index", "text")
    out = evidence.neighbour_context(fuse.rrf(lists(spark, d), top=5), c)
    return out.select("query_id", "chunk_id", F.length("context").alias("n_context"), F.sha2("context", 256).alias("context_hash"))


def F2_neighbors(spark, d):
    return evidence.neighbours(live_chunks(spark, d).select(F.col("source_ref").alias("doc_id"), "chunk_id", "chunk_index"))


def L15_handoff(spark, d):
    return evidence.handoff(asked(spark, d), with_chunks(spark, d, fuse.rrf(lists(spark, d))))


def L16_citations(spark, d):
    return evidence.citations(with_chunks(spark, d, fuse.rrf(lists(spark, d))))


def L17_bundle(spark, d):
    b = evidence.bundle(L16_citations(spark, d))
    return b.select("query_id", "n_evidence", F.sha2("evidence", 256).alias("evidence_hash"))


def D6_linked_assets(spark, d):
    c = live_chunks(spark, d)
    links = c.select("chunk_id", F.col("source_ref").alias("doc_id"), F.explode(T.extract_all("text", r"\[(?:IMAGE|TABLE): ([^\]]+)\]", 1)).alias("asset_id"))
    assets = links.groupBy("doc_id", "asset_id").agg(F.min("chunk_id").alias("asset_text"))
    return evidence.linked_assets(fuse.rrf(lists(spark, d)), links, assets)


def _rounded(df):
    return df.select("query_id", *[F.round(m, 6).alias(m) for m in evaluate.METRICS])


def P_metrics(spark, d):
    return _rounded(evaluate.per_query(fuse.rrf(lists(spark, d)), qrels(spark, d)))


def P9_eval_aggregate(spark, d):
    m = evaluate.aggregate(evaluate.per_query(fuse.rrf(lists(spark, d)), qrels(spark, d)))
    return m.select("n_queries", *[F.round(x, 6).alias(x) for x in evaluate.METRICS])


def E6_status_counts(spark, d):
    g, r = golden(spark, d).select("query_id"), fuse.rrf(lists(spark, d)).select("query_id").distinct().withColumn("got", F.lit(1))
    q = qrels(spark, d).select("query_id").distinct().withColumn("rel", F.lit(1))
    s = F.when(F.col("rel").isNull(), "missing_ground_truth").when(F.col("got").isNull(), "no_results").otherwise("ok")
    return g.join(r, "query_id", "left").join(q, "query_id", "left").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


def P10_ablation(spark, d):
    r, s = _overlap(spark, d)
    q = qrels(spark, d)
    c = evaluate.compare(evaluate.per_query(r, q), evaluate.per_query(fuse.rerank(r, s, recall_safe=True), q))
    return c.withColumn("mean_delta", F.round("mean_delta", 6))


def P11_expected_ranks(spark, d):
    return evaluate.expected_ranks(fuse.rrf(lists(spark, d)), qrels(spark, d))


def P12_gates(spark, d):
    g = evaluate.gates(evaluate.aggregate(evaluate.per_query(fuse.rrf(lists(spark, d)), qrels(spark, d))), {"hit_rate": 0.5, "mrr": 0.9})
    return g.withColumn("value", F.round("value", 6))


def _post(spark, d):
    return index.term_frequencies(live_chunks(spark, d))


def _index_parts(spark, d):
    """An index of what was loaded before a time, the chunks loaded since, and the ids of all chunks that any row since names, deletions too."""
    rows, cut = table(spark, d, "chunks"), F.lit("2031-10-01").cast("timestamp_ntz")
    old, new = (live_rows(rows.where(c), ["chunk_id"]) for c in (F.col("loaded_at") < cut, F.col("loaded_at") >= cut))
    return index.term_frequencies(old), index.term_frequencies(new), rows.where(F.col("loaded_at") >= cut).select("chunk_id").distinct()


def B4_merge(spark, d):
    """Merging what was loaded later into an older index gives the index of all."""
    return index.term_stats(index.merge_postings(*_index_parts(spark, d))).select("collection", "term", "df", F.round("idf", 9).alias("idf"))


def B5_remove(spark, d):
    gone = table(spark, d, "documents").where("deleted_at is not null").select(F.col("document_id").alias("doc_id"))
    return index.corpus_stats(index.remove_documents(_post(spark, d), gone)).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


QUERIES = {
    "L1_bm25_topk": lambda s, d: shown(sparse_list(s, d, 10)),
    "L2_dense_topk": L2_dense_topk,
    "L2_dense_filtered": L2_dense_filtered,
    "L2_dense_chunks": lambda s, d: shown(dense_list(s, d, 10)),
    "L3_rrf": lambda s, d: shown(fuse.rrf(lists(s, d))),
    "L4_weighted_rrf": lambda s, d: shown(fuse.rrf(lists(s, d), weights=[0.7, 0.3])),
    "L5_hybrid": L5_hybrid,
    "L6_single_list": L6_single_list,
    "H1_interleave": lambda s, d: shown(fuse.interleave(lists(s, d)[::-1], 10)),
    "L9_rerank_overlap": L9_rerank_overlap,
    "L10_conservative": L10_conservative,
    "C4_post_filter": C4_post_filter,
    "C5_scope": C5_scope,
    "L11_dedupe": L11_dedupe,
    "L12_parent_budget": L12_parent_budget,
    "D5_neighbor_text": D5_neighbor_text,
    "F2_neighbors": F2_neighbors,
    "D6_linked_assets": D6_linked_assets,
    "L15_handoff": L15_handoff,
    "L16_citations": L16_citations,
    "L17_bundle": L17_bundle,
    "P_metrics": P_metrics,
    "P9_eval_aggregate": P9_eval_aggregate,
    "E6_status_counts": E6_status_counts,
    "P10_ablation": P10_ablation,
    "P11_expected_ranks": P11_expected_ranks,
    "P12_gates": P12_gates,
    "E1_term_freq": _post,
    "E1_chunk_stats": lambda s, d: index.chunk_stats(_post(s, d)),
    "E2_corpus_stats": lambda s, d: index.corpus_stats(_post(s, d)).withColumn("avg_doc_length", F.round("avg_doc_length", 6)),
    "I6_idf": lambda s, d: index.term_stats(_post(s, d)).withColumn("idf", F.round("idf", 9)),
    "B4_merge": B4_merge,
    "B5_remove": B5_remove,
}

# ------------------------------------------------------------------------------------------------ SQL

LIVE = "live as (select * from (select *, row_number() over (partition by chunk_id order by loaded_at desc) rn from chunks) where rn = 1 and deleted_at is null)"
GOLD = "gold as (select * from (select *, row_number() over (partition by query_id order by loaded_at desc) rn from golden_test_set) where rn = 1)"
_COLLAPSE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_CLEAN = _COLLAPSE.format("regexp_replace(" + _COLLAPSE.format("query") + f", '{T.FILTER}', ' ', 'g')")
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TOKENS = f"""qtok as (
  select query_id, collection, unnest(ts) t, unnest(range(1, len(ts) + 1)) pos from (
    select query_id, collection, flatten(list_transform(regexp_extract_all({_CLEAN}, '{T.QUERY_TOKEN}'),
      lambda t: case when regexp_matches(t, '{T.HAN}') then regexp_extract_all(t, '{T.HAN_OR_LATIN}') else [t] end)) ts from gold)
),
kw as (
  select query_id, collection, term, row_number() over (partition by query_id order by pos) pos
  from (select query_id, collection, lower(t) term, min(pos) pos from qtok where lower(t) not in ({_STOP}) group by all) qualify pos <= 20
)"""
TF = f"""tf as (
  select collection, term, chunk_id, count(*) tf, any_value(dl) dl from (
    select collection, chunk_id, len(ts) dl, unnest(ts) term from (
      select collection, chunk_id, list_filter(regexp_extract_all(lower(text), '{T.INDEX_TOKEN}'), lambda x: length(x) >= 2) ts from live)) group by all
),
cs as (select collection, count(*) num_docs, avg(dl) avgdl, sum(u) n_postings from (select collection, chunk_id, max(dl) dl, count(*) u from tf group by all) group by 1),
dfs as (select collection, term, count(*) df from tf group by all)"""
_IDF = "ln((num_docs - df + 0.5::double) / (df + 0.5::double))"
BM = f"""bm as (
  select query_id, chunk_id, sum({_IDF} * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) score
  from kw join tf using (collection, term) join dfs using (collection, term) join cs using (collection) group by all
),
bmr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from bm qualify rank <= 20)"""
VEC = f"""vec as (
  select id, collection, vector::double[] v from (select *, row_number() over (partition by id order by loaded_at desc) rn from chroma_store)
  where rn = 1 and len(vector) = {DIM} and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0
),
qv as (
  select query_id, g.collection, v, vec.id from (select query_id, collection, unnest(expected_chunk_ids) id, unnest(range(len(expected_chunk_ids))) pos from gold) g join vec on vec.id = g.id
  qualify row_number() over (partition by query_id order by pos) = 1
),
dn as (select query_id, vec.id chunk_id, (1 + list_cosine_similarity(qv.v, vec.v)) / 2 score from qv join vec on qv.collection = vec.collection and vec.id <> qv.id),
dnr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from dn qualify rank <= 20)"""
LISTS = "lists as (select query_id, chunk_id, score, rank, 0 l from bmr union all select query_id, chunk_id, score, rank, 1 from dnr)"
RRF = """rrf as (select query_id, chunk_id, sum(1::double / (60 + rank)) score from lists group by all),
rr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from rrf)"""
BASE = f"with {LIVE}, {GOLD}, {TOKENS}, {TF}, {BM}"
BOTH = f"{BASE}, {VEC}, {LISTS}, {RRF}"
FUSED = """fu as (
  select query_id, chunk_id, count(distinct l) over_, sum(1::double / (60 + rank)) fused, max(score) own, min(rank) first from lists group by all
),
fl as (select query_id, count(distinct l) n from lists group by all),
fr as (select query_id, chunk_id, case when n = 1 then own else fused end score,
  row_number() over (partition by query_id order by case when n = 1 then first else 0 end, round(fused, 9) desc, chunk_id)::int as rank from fu join fl using (query_id) qualify rank <= 10)"""
OVERLAP = """nk as (select query_id, count(*) n from kw group by 1),
rt as (select * from rr where rank <= 10),
ov as (select rt.query_id, rt.chunk_id, count(tf.term)::double / any_value(nk.n) s from rt join nk using (query_id) join live using (chunk_id) join kw on kw.query_id = rt.query_id
  left join tf on tf.chunk_id = rt.chunk_id and tf.term = kw.term and tf.collection = live.collection group by all)"""
QREL = "qrel as (select distinct * from (select query_id, unnest(expected_chunk_ids) chunk_id from gold) where chunk_id is not null)"


def _metrics(ranking: str, name: str) -> str:
    return f"""{name}_n as (select query_id, count(*) n_rel from qrel group by 1),
{name} as (select query_id, case when min(r.rank) is null then 0.0::double else 1.0::double end hit_rate, coalesce(1.0::double / min(r.rank), 0) mrr,
  count(*) filter (r.rank <= 10) / 10.0::double "precision", count(*) filter (r.rank <= 10) / any_value(n_rel)::double recall,
  coalesce(sum(1.0::double / log2(r.rank + 1.0::double)) filter (r.rank <= 10), 0) / any_value(list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1.0::double / log2(i + 1.0::double)))) ndcg
  from qrel join {name}_n using (query_id) left join {ranking} r using (query_id, chunk_id) group by 1)"""


_SHOW = "query_id, chunk_id, rank, round(score, 6) score"
_TOP = "rt as (select * from rr where rank <= 10)"
_CHUNKS = "ck as (select rt.*, text, source_ref doc_id, source_path, page_num, chunk_type, collection from rt join live using (chunk_id))"
_AVGS = ", ".join(f'round(avg("{m}"), 6) "{m}"' for m in evaluate.METRICS)
_ROUND = ", ".join(f'round("{m}", 6) "{m}"' for m in evaluate.METRICS)
_EMB = """select q.vec_id query_id, v.vec_id chunk_id, (1 + list_cosine_similarity(q.embedding::double[], v.embedding::double[])) / 2 score
 from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0"""
_EMB_OUT = "select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank, round(score, 6) score from ({}) qualify rank <= 10"
_NEAR = "near as (select source_ref doc_id, chunk_id, coalesce(lag(chunk_id) over w, '') previous_chunk_id, coalesce(lead(chunk_id) over w, '') next_chunk_id from live window w as (partition by source_ref order by coalesce(chunk_index, 0), chunk_id))"
_PAR = "par as (select collection, child_id chunk_id, parent_id from (select *, row_number() over (partition by collection, child_id order by loaded_at desc) rn from section_children) where rn = 1)"
_SEC = "sec as (select collection, parent_id, text ptext from (select *, row_number() over (partition by collection, parent_id order by loaded_at desc) rn from sections) where rn = 1 and deleted_at is null)"
_SNIP = _COLLAPSE.format("text")
_CITE = f"""select query_id, rank as index, '[' || rank || ']' marker, chunk_id, coalesce(source_path, 'unknown') source, 'p. ' || page_num locator, round(score, 4) score,
 case when length({_SNIP}) <= 200 then {_SNIP} else regexp_replace(substr({_SNIP}, 1, 200), ' [^ ]*$', '') || '...' end snippet from ck"""

SQL = {
    "L1_bm25_topk": f"{BASE} select {_SHOW} from bmr where rank <= 10",
    "L2_dense_topk": _EMB_OUT.format(_EMB),
    "L2_dense_filtered": _EMB_OUT.format(_EMB + " and v.label in (1, 2, 3)"),
    "L2_dense_chunks": f"with {GOLD}, {VEC} select {_SHOW} from dnr where rank <= 10",
    "L3_rrf": f"{BOTH} select {_SHOW} from rr where rank <= 10",
    "L4_weighted_rrf": f"{BASE}, {VEC}, {LISTS}, w as (select query_id, chunk_id, sum(case l when 0 then 0.7::double else 0.3::double end / (60 + rank)) score from lists group by all) select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank, round(score, 6) score from w qualify rank <= 10",
    "L5_hybrid": f"{BOTH}, {FUSED}, dm as (select query_id, chunk_id, case when chunk_type = 'reference' then score * 0.3::double else score end score from fr left join live using (chunk_id)) select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank, round(score, 6) score from dm",
    "L6_single_list": f"{BOTH}, {FUSED} select {_SHOW} from fr",
    "H1_interleave": f"{BASE}, {VEC}, lists as (select query_id, chunk_id, score, rank, 1 l from bmr union all select query_id, chunk_id, score, rank, 0 from dnr), g as (select query_id, chunk_id, min(rank * 2 + l) turn, arg_min(score, rank * 2 + l) score from lists group by all) select query_id, chunk_id, row_number() over (partition by query_id order by turn)::int as rank, round(score, 6) score from g qualify rank <= 10",
    "L9_rerank_overlap": f"{BOTH}, {OVERLAP}, n as (select query_id, count(*) n from rt group by 1) select query_id, chunk_id, row_number() over (partition by query_id order by round(s, 9) desc nulls last, rank)::int as rank, round(coalesce(s, score), 6) score from rt join n using (query_id) left join ov using (query_id, chunk_id) where s is not null or n = 1",
    "L10_conservative": f"""{BOTH}, {OVERLAP}, a as (select query_id, chunk_id, case when max(score) over w = min(score) over w then 1 else (score - min(score) over w) / (max(score) over w - min(score) over w) end a from rt window w as (partition by query_id)),
b as (select query_id, chunk_id, case when max(s) over w = min(s) over w then 1 else (s - min(s) over w) / (max(s) over w - min(s) over w) end b from ov window w as (partition by query_id)),
c as (select query_id, chunk_id, 0.5::double * a + 0.5::double * coalesce(b, 0) score from a left join b using (query_id, chunk_id))
select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank, round(score, 6) score from c qualify rank <= 10""",
    "C4_post_filter": f"{BOTH}, {_TOP}, {_CHUNKS} select {_SHOW} from ck where chunk_type = 'text' and contains(source_path, 'zotero')",
    "C5_scope": f"{BOTH}, {_TOP}, {_CHUNKS} select {_SHOW} from ck where doc_id in (select document_id from zotero_sync_state where status = 'synced' and document_id is not null)",
    "L12_parent_budget": f"""{BOTH}, {_TOP}, {_CHUNKS}, {_PAR}, {_SEC}, j as (select ck.*, ptext from ck left join par using (collection, chunk_id) left join sec on sec.collection = ck.collection and sec.parent_id = par.parent_id),
u as (select *, greatest(0, 1500 - coalesce(sum(length(ptext)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0)) room from j)
select query_id, chunk_id, rank, length(substr(ptext, 1, room::int))::int n_context, sha256(coalesce(substr(ptext, 1, room::int), '')) context_hash from u""",
    "D5_neighbor_text": f"""{BOTH}, {_NEAR}, c as (select query_id, rr.chunk_id, coalesce(p.text, '') a, coalesce(n.text, '') b, p.text pt, n.text nt from rr join near using (chunk_id) left join live p on p.chunk_id = previous_chunk_id left join live n on n.chunk_id = next_chunk_id where rank <= 5),
t as (select query_id, chunk_id, a || case when pt is not null and nt is not null then chr(10) || chr(10) else '' end || b context from c) select query_id, chunk_id, length(context)::int n_context, sha256(context) context_hash from t""",
    "F2_neighbors": f"with {LIVE}, {_NEAR} select * from near",
    "D6_linked_assets": f"{BOTH}, {_TOP}, ln_ as (select chunk_id, source_ref doc_id, unnest(regexp_extract_all(text, '\\[(?:IMAGE|TABLE): ([^\\]]+)\\]', 1)) asset_id from live), a as (select doc_id, asset_id, min(chunk_id) asset_text from ln_ group by all) select distinct query_id, rt.chunk_id, asset_id, asset_text from rt join ln_ using (chunk_id) join a using (doc_id, asset_id)",
    "L15_handoff": f"""{BOTH}, {_TOP}, {_CHUNKS}, f as (select query_id, doc_id, min(rank) rank from ck where doc_id is not null group by all), f3 as (select *, row_number() over (partition by query_id order by rank, doc_id) r from f qualify r <= 3),
ds as (select query_id, string_agg(doc_id, ',' order by r) docs from f3 group by 1), b as (select query_id, max(score) best from ck group by 1),
s as (select query_id, docs, case when best is null then 'insufficient_evidence' when docs is not null and (coalesce(regexp_matches(query, '{evidence.GLOBAL_INTENT}'), false) or best < 0.01) then 'needs_fulltext' else 'evidence_available' end signal from gold left join b using (query_id) left join ds using (query_id))
select query_id, signal, case when signal = 'needs_fulltext' then docs else '' end documents from s""",
    "L16_citations": f"{BOTH}, {_TOP}, {_CHUNKS} {_CITE}",
    "L17_bundle": f"""{BOTH}, {_TOP}, {_CHUNKS}, ci as ({_CITE}) select query_id, count(*) n_evidence, sha256('[' || string_agg('{{"index":' || index || ',"chunk_id":"' || chunk_id || '","source":"' || source || '"}}', ',' order by index) || ']') evidence_hash from ci group by 1""",
    "P_metrics": f"{BOTH}, {QREL}, {_TOP}, {_metrics('rt', 'm')} select query_id, {_ROUND} from m",
    "P9_eval_aggregate": f"{BOTH}, {QREL}, {_TOP}, {_metrics('rt', 'm')} select count(*) n_queries, {_AVGS} from m",
    "E6_status_counts": f"{BOTH}, {QREL} select case when not exists (select 1 from qrel q where q.query_id = gold.query_id) then 'missing_ground_truth' when not exists (select 1 from rr where rr.query_id = gold.query_id) then 'no_results' else 'ok' end status, count(*) n from gold group by 1",
    "P10_ablation": f"""{BOTH}, {QREL}, {OVERLAP}, re as (select query_id, chunk_id, row_number() over (partition by query_id order by round(s, 9) desc nulls last, rank)::int as rank from rt left join ov using (query_id, chunk_id)),
{_metrics('rt', 'm')}, {_metrics('re', 'k')}, x as (unpivot m on {', '.join(f'"{m}"' for m in evaluate.METRICS)} into name metric value x), y as (unpivot k on {', '.join(f'"{m}"' for m in evaluate.METRICS)} into name metric value y)
select metric, count(*) filter (y - x > 1e-12) improved, count(*) filter (abs(y - x) <= 1e-12) unchanged, count(*) filter (y - x < -1e-12) degraded, round(avg(y - x), 6) mean_delta from x join y using (query_id, metric) group by 1""",
    "P11_expected_ranks": f"{BOTH}, {QREL}, {_TOP} select query_id, chunk_id, rank from qrel left join rt using (query_id, chunk_id)",
    "P12_gates": f"{BOTH}, {QREL}, {_TOP}, {_metrics('rt', 'm')} select 'hit_rate' metric, round(avg(hit_rate), 6) as value, 0.5::double threshold, avg(hit_rate) >= 0.5 passed from m union all select 'mrr', round(avg(mrr), 6), 0.9::double, avg(mrr) >= 0.9 from m",
    "E1_term_freq": f"with {LIVE}, {TF} select collection, term, chunk_id, tf, dl from tf",
    "E1_chunk_stats": f"with {LIVE}, {TF} select collection, chunk_id, max(dl) doc_length, count(*) unique_terms from tf group by all",
    "E2_corpus_stats": f"with {LIVE}, {TF} select collection, num_docs, round(avgdl, 6) avg_doc_length, n_postings::bigint n_postings from cs",
    "I6_idf": f"with {LIVE}, {TF} select collection, term, df, round({_IDF}, 9) idf from dfs join cs using (collection)",
    "B4_merge": f"with {LIVE}, {TF} select collection, term, df, round({_IDF}, 9) idf from dfs join cs using (collection)",
    "B5_remove": f"with {LIVE}, {TF}, t2 as (select * from tf where regexp_extract(chunk_id, '^(.*)_[0-9]{{4,}}_[0-9a-fA-F]{{8}}$', 1) not in (select document_id from documents where deleted_at is not null and document_id is not null)) select collection, count(*) num_docs, round(avg(dl), 6) avg_doc_length, sum(u)::bigint n_postings from (select collection, chunk_id, max(dl) dl, count(*) u from t2 group by all) group by 1",
}
