"""From rankings to evidence: neighbours, parents, de-duplication, context budgets, citations, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, locator, snippet


def neighbours(chunks: DataFrame) -> DataFrame:
    """``previous_chunk_id`` and ``next_chunk_id`` in the order of ``chunk_index`` within a document, empty at its ends.

    One document is one window partition: documents bound it, a corpus does not. A chunk without a document has no neighbours.
    """
    w = Window.partitionBy(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("without: "), "chunk_id"))).orderBy(F.coalesce("chunk_index", F.lit(0)), "chunk_id")
    return chunks.select("doc_id", "chunk_id", F.lag("chunk_id", 1, "").over(w).alias("previous_chunk_id"), F.lead("chunk_id", 1, "").over(w).alias("next_chunk_id"))


def deduplicate(ranked: DataFrame, k: int = 10, per_parent: int = 2) -> DataFrame:
    """Greedy over the ranks of a query: a row is kept unless its id or text was kept before, or its parent has ``per_parent`` kept rows; the first ``k`` stay.

    ``ranked`` has ``(query_id, chunk_id, rank, text, parent_id)``. Whether a row stays depends on earlier decisions, so the ranking of a query, which its
    retrieval limit bounds, is folded as an array. Null parents have no quota; a null text has no fingerprint to collide.
    """
    item = F.struct("rank", "chunk_id", F.coalesce(fingerprint("text"), F.concat(F.lit("null:"), "chunk_id")).alias("fp"), "parent_id")
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    kept_type = "array<struct<rank:int,chunk_id:string,fp:string,parent_id:string>>"

    def step(kept, x):
        same = F.exists(kept, lambda y: (y["chunk_id"] == x["chunk_id"]) | (y["fp"] == x["fp"]))
        full = x["parent_id"].isNotNull() & (F.size(F.filter(kept, lambda y: y["parent_id"].eqNullSafe(x["parent_id"]))) >= per_parent)
        return F.when(same | full | (F.size(kept) >= k), kept).otherwise(F.concat(kept, F.array(x)).cast(kept_type))

    folded = rows.select("query_id", F.aggregate("rows", F.array().cast(kept_type), step).alias("kept"))
    return folded.select("query_id", F.posexplode("kept").alias("pos", "x")).select("query_id", F.col("x.chunk_id").alias("chunk_id"), F.col("x.rank").alias("old_rank"), (F.col("pos") + 1).alias("rank"))


def parent_context(ranked: DataFrame, parents: DataFrame, budget: int = 6000) -> DataFrame:
    """Parent text of every result, cut to what the results before it left of one budget of characters a query.

    ``ranked(query_id, chunk_id, rank, parent_key)``, ``parents(parent_key, parent_text)``. Results without a parent use nothing and get null; results that
    find the budget used up get an empty text.
    """
    j = ranked.join(parents, "parent_key", "left")
    used = F.coalesce(F.sum(F.length("parent_text")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), F.lit(budget) - used).cast("int")
    return j.select("query_id", "chunk_id", "rank", "parent_key", F.substring("parent_text", F.lit(1), room).alias("context"))


def neighbour_context(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The texts before and behind every result, joined by a blank line; results without neighbours get an empty text."""
    near = neighbours(chunks)
    text = chunks.select(F.col("chunk_id").alias("n_id"), "text")
    legs = ranked.join(near, "chunk_id").select("query_id", "chunk_id", F.posexplode(F.array("previous_chunk_id", "next_chunk_id")).alias("side", "n_id"))
    return legs.join(text, "n_id", "left").groupBy("query_id", "chunk_id").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("side", "text")))), lambda x: x["text"])).alias("context"))


MODES = ("none", "parent", "neighbors", "adaptive")


def expand_context(ranked: DataFrame, parents: DataFrame, near: DataFrame, mode: str = "adaptive", budget: int = 6000) -> DataFrame:
    """``(query_id, chunk_id, rank, kind, context)``: what is shown around every result, out of one budget of characters a query, best results first.

    ``ranked(query_id, chunk_id, rank, parent_key)``, ``parents(parent_key, parent_text)``, ``near(query_id, chunk_id, near_text)``. ``adaptive`` takes the parent where it fits into what is
    left, else the neighbours; texts are cut to what is left. Without a text, or with nothing left, kind and context are null. As each result depends on what those before took, the
    lengths of a query's results, which its retrieval limit bounds, are folded as an array; the texts are cut afterwards.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    j = ranked.join(parents, "parent_key", "left").join(near, ["query_id", "chunk_id"], "left")
    if mode == "none":
        return j.select("query_id", "chunk_id", "rank", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("context"))
    j = j.withColumn("n_parent", F.length("parent_text")).withColumn("n_near", F.length("near_text"))
    rows = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "n_parent", "n_near"))).alias("rows"))
    out = "array<struct<chunk_id:string,kind:string,n:int>>"
    state = f"struct<left:int,out:{out}>"

    def step(a, x):
        left = a["left"]
        if mode == "adaptive":
            kind = F.when(x["n_parent"] <= left, "parent").otherwise("neighbors")
        else:
            kind = F.lit("neighbors" if mode == "neighbors" else "parent")
        has = F.when(kind == "parent", x["n_parent"]).otherwise(x["n_near"])
        n = F.when((left > 0) & (has > 0), F.least(has, left)).otherwise(0)
        item = F.struct(x["chunk_id"].alias("chunk_id"), F.when(n > 0, kind).alias("kind"), n.alias("n"))
        return F.struct((left - n).alias("left"), F.concat(a["out"], F.array(item)).alias("out")).cast(state)

    start = F.struct(F.lit(budget).alias("left"), F.array().cast(out).alias("out")).cast(state)
    folded = rows.select("query_id", F.inline(F.aggregate("rows", start, step)["out"]))
    text = F.when(F.col("kind") == "parent", F.col("parent_text")).when(F.col("kind") == "neighbors", F.col("near_text"))
    return j.join(folded, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "rank", "kind", F.substring(text, F.lit(1), F.col("n")).alias("context"))


def default_mode(retrieval: Column, configured: str = "adaptive") -> Column:
    """How context is expanded by default: section search shows parents, evidence search nothing, others what is configured."""
    return F.when(retrieval == "section", "parent").when(retrieval == "evidence", "none").otherwise(configured)


def selected_mode(requested: Column, has_sections: bool) -> Column:
    """``(mode, fallback)``: section search without a section store becomes hybrid search."""
    lost = (requested == "section") & F.lit(not has_sections)
    return F.struct(F.when(lost, "hybrid").otherwise(requested).alias("mode"), F.coalesce(lost, F.lit(False)).alias("fallback"))


def candidate_count(top_k: int, multiplier: int, most: int) -> int:
    """How many candidates are fetched for ``top_k`` results."""
    return min(max(top_k, top_k * multiplier), most)


def result_count(top_k: int | None, default: int = 5, most: int = 20) -> int:
    return min(top_k or default, most)


def degraded(queries: DataFrame, sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """``(query_id, n_sparse, n_dense, used_fallback)`` of every query: whether its results come from one ranking alone because the other had none. A query without
    results from either has no fallback."""
    counts = [r.groupBy("query_id").agg(F.count("*").alias(n)) for r, n in ((sparse, "n_sparse"), (dense, "n_dense"))]
    j = queries.select("query_id").join(counts[0], "query_id", "left").join(counts[1], "query_id", "left").fillna(0)
    return j.withColumn("used_fallback", (F.col("n_sparse") == 0) != (F.col("n_dense") == 0))


def post_filter(filters: dict, collections: tuple[str, ...] = ("collection",)) -> Column:
    """The test of results behind the fusion: ``tags`` share a value, ``source_path`` contains the value, ``collection`` is that of the first of
    ``collections`` that is set; all else is equal. A missing value matches nothing."""
    out = F.lit(True)
    for name, value in filters.items():
        if name == "tags":
            test = F.arrays_overlap("tags", F.array(*[F.lit(v) for v in (value if isinstance(value, (list, tuple)) else [value])]))
        elif name == "source_path":
            test = F.col(name).contains(value)
        elif name == "collection":
            test = F.coalesce(*[F.col(c) for c in collections]) == value
        else:
            test = F.col(name) == value
        out = out & F.coalesce(test, F.lit(False))
    return out


def linked_assets(ranked: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets that results link to: ``links(chunk_id, doc_id, asset_id)`` against ``assets(doc_id, asset_id, asset_text)`` of the same document."""
    return ranked.select("query_id", "chunk_id").join(links, "chunk_id").join(assets, ["doc_id", "asset_id"]).select("query_id", "chunk_id", "asset_id", "asset_text").distinct()


# Fixed value: queries that ask for reading the whole text.
GLOBAL_INTENT = r"(?i)(全文|整体|主要贡献|完整论证|通篇|总结.*论文|比较.*论文|full\s*text|overall|main contributions?|entire (paper|article)|summari[sz]e (the )?(paper|article))"


def handoff(queries: DataFrame, ranked: DataFrame, low_score: float = 0.01, most: int = 3, enabled: bool = True) -> DataFrame:
    """``(query_id, signal, documents)``: whether the evidence suffices. ``ranked(query_id, rank, score, doc_id)``; the first ``most`` distinct documents are named
    where the full text is needed. Where the policy is not ``enabled`` nothing is evaluated."""
    if not enabled:
        return queries.select("query_id", F.lit("not_evaluated").alias("signal"), F.lit("").alias("documents"))
    first = ranked.where("doc_id is not null").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    docs = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))).where(F.col("r") <= most)
    docs = docs.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"]), ",").alias("docs"))
    best = ranked.groupBy("query_id").agg(F.max("score").alias("best"))
    j = queries.select("query_id", "query").join(best, "query_id", "left").join(docs, "query_id", "left")
    needs = F.col("docs").isNotNull() & (F.coalesce(F.col("query").rlike(GLOBAL_INTENT), F.lit(False)) | (F.col("best") < low_score))
    signal = F.when(F.col("best").isNull(), "insufficient_evidence").when(needs, "needs_fulltext").otherwise("evidence_available")
    return j.select("query_id", signal.alias("signal"), F.when(signal == "needs_fulltext", F.col("docs")).otherwise("").alias("documents"))


def citations(ranked: DataFrame) -> DataFrame:
    """Numbered citations of ``ranked(query_id, chunk_id, rank, score, text, source_path, page_num)``; with a column ``page_start`` that page stands in where ``page_num`` is null."""
    page = F.coalesce("page_num", "page_start") if "page_start" in ranked.columns else F.col("page_num")
    return ranked.select(
        "query_id", F.col("rank").alias("index"), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")).alias("marker"), "chunk_id",
        F.coalesce("source_path", F.lit("unknown")).alias("source"), locator(page, page).alias("locator"), F.round("score", 4).alias("score"), snippet("text").alias("snippet"),
    )


def bundle(cited: DataFrame) -> DataFrame:
    """One JSON document a query with its citations in order."""
    item = F.struct("index", "chunk_id", "source")
    return cited.groupBy("query_id").agg(F.count("*").alias("n_evidence"), F.to_json(F.array_sort(F.collect_list(item))).alias("evidence"))


def evidence_rows(ranked: DataFrame, scores: dict[str, DataFrame], sections: DataFrame) -> DataFrame:
    """The evidence of every result: ids, section, pages, and where its score came from.

    ``ranked(query_id, chunk_id, rank, score, doc_id, page_num, parent_key)``, ``scores`` by name ``(query_id, chunk_id, score)``, ``sections(parent_key, section_path, page_start, page_end)``.
    Pages are those of the section, else that of the chunk; a missing last page is the first.
    """
    j = ranked.join(sections, "parent_key", "left")
    for name, s in scores.items():
        j = j.join(s.select("query_id", "chunk_id", F.col("score").alias(f"{name}_score")), ["query_id", "chunk_id"], "left")
    first = F.coalesce("page_start", "page_num")
    return j.select(
        "query_id", "chunk_id", "rank", F.col("doc_id").alias("document_id"), "parent_key", "section_path", first.alias("page_start"), F.coalesce("page_end", first).alias("page_end"),
        *[F.round(f"{n}_score", 6).alias(f"{n}_score") for n in scores], F.round("score", 6).alias("final_score"),
    )


def evidence_bundle(queries: DataFrame, rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``(query_id, n_evidence, coverage, action, bundle)``: the evidence rows of a query as one JSON document, with the decision of ``handoff`` and the action it recommends, if any."""
    item = F.struct("rank", *[c for c in rows.columns if c not in ("query_id", "rank")])
    e = rows.groupBy("query_id").agg(F.count("*").alias("n_evidence"), F.to_json(F.array_sort(F.collect_list(item))).alias("bundle"))
    action = F.when(F.col("documents") != "", "read_fulltext")
    return queries.select("query_id").join(e, "query_id", "left").join(decided, "query_id", "left").select(
        "query_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.col("signal").alias("coverage"), action.alias("action"), F.coalesce("bundle", F.lit("[]")).alias("bundle")
    )
