"""Named queries on the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import live_rows
from ..sources.tables import table
from . import mixing, neardup, packing, pages, residue, split, tokens, vectors

#: Limit and overlap in characters.
LIMITS = {"documents": (4000, 200), "chunks": (1000, 200), "sections": (1200, 50)}


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks, sections = (table(spark, d, t) for t in LIMITS)
    longer = {t: F.length("text") > n for t, (n, _) in LIMITS.items()}
    rows = {
        "documents": docs.where(longer["documents"]).select(F.lit("documents").alias("record_table"), F.col("doc_id").cast("string").alias("record_key"), "text"),
        "chunks": live_rows(chunks, ["chunk_id"], longer["chunks"]).select(F.lit("chunks").alias("record_table"), F.col("chunk_id").alias("record_key"), "text"),
        "sections": live_rows(sections, ["collection", "parent_id"], longer["sections"]).select(
            F.lit("sections").alias("record_table"), F.concat_ws("|", F.coalesce("collection", F.lit("")), F.coalesce("parent_id", F.lit(""))).alias("record_key"), "text"
        ),
    }
    a, b, c = (split.split_oversized(rows[t], "text", *LIMITS[t]) for t in LIMITS)
    return a.unionByName(b).unionByName(c)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("piece_no = 1").select("record_table", "record_key").distinct()


def p1_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, each piece without the overlap it repeats: a round trip, and the number of pieces over the limit."""
    of = {t: F.col("record_table") == t for t in LIMITS}
    limit, overlap = (F.coalesce(*[F.when(of[t], LIMITS[t][i]) for t in LIMITS]) for i in (0, 1))
    own = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.substring("piece", overlap + 1, F.length("piece")))
    g = p1_pieces(spark, d).groupBy("record_table", "record_key").agg(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("ps"), F.count(F.when(F.length("piece") > limit, 1)).alias("n_too_long"))
    return g.select("record_table", "record_key", "n_too_long", F.sha2(F.array_join(F.transform("ps", lambda p: p["own"]), ""), 256).alias("text_hash"))


def _alike(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, d, "chunks"), "chunk_id", "text", threshold=0.7, at="loaded_at", deleted="deleted_at")


#: Copies of one text in a class of more chunks than this are paired with their least id only.
COPIES = 1000


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.member_pairs(*_alike(spark, d), expand=COPIES).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_groups(*_alike(spark, d)).withColumnRenamed("id", "chunk_id")


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_vectors(table(spark, d, "chroma_store"), "id", "vector", k=5, dim=64, tables=10, functions=1, probes=2, at="loaded_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Only neighbours of a cosine of 0.9 or more are asked for, which buckets of two functions bring together."""
    near = vectors.nearest_vectors(table(spark, d, "chroma_store"), "id", "vector", k=5, dim=64, tables=16, functions=2, probes=2, at="loaded_at", least=0.9)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_scores(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id").withColumn("coverage", F.round("coverage", 4))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_scores(table(spark, d, "documents"), "doc_id", "text").where("coverage >= 0.4").select(F.col("id").alias("doc_id")).distinct()


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay: all rows but those of p8_found, blank ones too."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n_chars"))
    return docs.join(p8_found(spark, d), "doc_id", "left_anti")


def _page_rows(spark: SparkSession, d: str) -> DataFrame:
    return pages.records({"documents": (table(spark, d, "documents"), "doc_id", "text"), "noisy_chunks": (table(spark, d, "noisy_chunks"), "noise_id", "input")})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lines, _ = pages.find_damage(_page_rows(spark, d))
    return lines.select("record_table", "record_key", "line_no", "kind").distinct()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    rows = _page_rows(spark, d).distinct()
    return pages.repair_pages(rows, pages.find_damage(rows)[0])


#: Tokens of a training sequence.
CAPACITY = 2048


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    sized = tokens.count_tokens(table(spark, d, "documents"), "doc_id", "text", [])
    return packing.pack(sized, CAPACITY).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, d), CAPACITY)


def p6_audit(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing: every document with tokens is placed with all of them, no sequence is over its capacity, and only longer documents are divided."""
    sized = tokens.count_tokens(table(spark, d, "documents"), "doc_id", "text", []).where("n_tokens > 0").select(F.col("id").alias("doc_id"), F.col("n_tokens").alias("whole"))
    packed = packing.pack(sized.select(F.col("doc_id").alias("id"), F.col("whole").alias("n_tokens")), CAPACITY).withColumnRenamed("id", "doc_id")
    per_doc = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("n_pieces"))
    wrong = (F.col("placed").isNull()) | (F.col("placed") != F.col("whole")) | ((F.col("n_pieces") > 1) & (F.col("whole") <= CAPACITY))
    zero = F.lit(0).cast("long")
    docs = sized.join(per_doc, "doc_id", "left").agg(F.count("*").alias("n_docs"), F.count(F.when(wrong, 1)).alias("n_wrong"), zero.alias("n_bad_sequences"))
    over = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("bin_offset") + F.col("n_tokens")).alias("end")).where((F.col("n") > CAPACITY) | (F.col("end") != F.col("n")))
    both = docs.unionByName(over.agg(zero.alias("n_docs"), zero.alias("n_wrong"), F.count("*").alias("n_bad_sequences")))
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = tokens.count_tokens(table(spark, d, "documents"), "doc_id", "text", ["source"])
    return mixing.mix_sources(sized, table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a mixture: no document more often than its source allows, and each source with documents within its longest document of its share."""
    sized = tokens.count_tokens(table(spark, d, "documents"), "doc_id", "text", ["source"])
    _, report = mixing.mix_sources(sized, table(spark, d, "mix_targets"))
    longest = sized.where("n_tokens > 0").groupBy("source").agg(F.max("n_tokens").alias("longest"))
    r = report.join(longest, "source", "left")
    one = F.lit(1).alias("one")
    whole = r.where("longest is not null").agg(one, F.sum("target_share").alias("share"), F.sum("n_tokens").alias("all_tokens"))
    aim = F.col("target_share") / F.col("share") * F.col("all_tokens")
    at = F.when(F.col("longest").isNull(), F.col("n_tokens") == 0).otherwise(F.abs(F.col("n_tokens") - aim) <= F.col("longest"))
    return r.withColumn("one", F.lit(1)).join(whole, "one").select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), at.alias("at_share"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_nearest": p3_nearest, "p4_found": p4_found, "p4_repaired": p4_repaired, "p6_packed": p6_packed, "p6_fill": p6_fill, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_scores": p8_scores, "p8_kept": p8_kept, "p1_rejoined": p1_rejoined, "p6_audit": p6_audit, "p7_audit": p7_audit}

SQL = {
    "p1_found": """
select 'documents' record_table, cast(doc_id as varchar) record_key from documents where length(text) > 4000
union select 'chunks', chunk_id from (select chunk_id, text, deleted_at, loaded_at = max(loaded_at) over (partition by chunk_id) cur from chunks) where cur and deleted_at is null and length(text) > 1000
union select 'sections', coalesce(collection,'')||'|'||coalesce(parent_id,'') from (select collection, parent_id, text, deleted_at, loaded_at = max(loaded_at) over (partition by collection, parent_id) cur from sections)
  where cur and deleted_at is null and length(text) > 1200""",
    # every pair of chunks of like length by their common words
    "p2_found": """
with live as (select chunk_id, any_value(text) as text from (select *, loaded_at = max(loaded_at) over (partition by chunk_id) cur from chunks) where cur and deleted_at is null and chunk_id is not null group by 1),
w as (select chunk_id, w, count(*) n from (select chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) w from live) group by all),
s as (select chunk_id, sum(n) size from w group by 1),
ws as (select * from w join s using (chunk_id)),
i as (select a.chunk_id a, b.chunk_id b, sum(least(a.n, b.n)) common, any_value(a.size + b.size) sizes
  from ws a join ws b on a.w = b.w and a.chunk_id < b.chunk_id and a.size * 0.7 <= b.size and b.size * 0.7 <= a.size group by all)
select a chunk_id_a, b chunk_id_b from i where common >= 0.7 * (sizes - common)""",
    # every pair of vectors
    "p3_found": """
with vec as (select id, vector::double[] v from (select *, row_number() over (partition by id order by loaded_at desc) rn from chroma_store where id is not null)
  where rn = 1 and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
c as (select a.id a, b.id b, list_cosine_similarity(a.v, b.v) cos from vec a join vec b on a.id <> b.id),
t as (select a, b, cos from c qualify row_number() over (partition by a order by round(cos, 12) desc, b) <= 5)
select distinct least(a, b) id_a, greatest(a, b) id_b from t where cos >= 0.9""",
    "p1_rejoined": """
select 'documents' record_table, cast(doc_id as varchar) record_key, 0::bigint n_too_long, sha256(text) text_hash from documents where length(text) > 4000
union select 'chunks', chunk_id, 0, sha256(text) from (select chunk_id, text, deleted_at, loaded_at = max(loaded_at) over (partition by chunk_id) cur from chunks) where cur and deleted_at is null and length(text) > 1000
union select 'sections', coalesce(collection, '') || '|' || coalesce(parent_id, ''), 0, sha256(text)
 from (select collection, parent_id, text, deleted_at, loaded_at = max(loaded_at) over (partition by collection, parent_id) cur from sections) where cur and deleted_at is null and length(text) > 1200""",
    "p6_audit": "select count(*) n_docs, 0::bigint n_wrong, 0::bigint n_bad_sequences from documents where text <> '' and doc_id is not null",
    "p7_audit": "select source, true within_repeats, true at_share from mix_targets",
}
