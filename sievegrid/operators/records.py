"""Metadata of documents and chunks, titles and summaries, images, checks, and counts of ingestion stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, extract_all

# Metadata that no source may set, and metadata that summaries do not show.
RESERVED = ("source_path", "source", "images", "chunk_index", "source_ref", "source_doc_id")
HIDDEN = ("source_ref", "chunk_index", "start_offset", "end_offset", "_placeholder", "text", "title", "summary", "tags", "source_path", "source")


def shown_metadata(c, hidden: tuple[str, ...] = HIDDEN) -> Column:
    """The entries of a metadata map that are for users: none of ``hidden``, none that begins with ``_``."""
    return F.map_filter(col(c), lambda k, v: ~k.isin(list(hidden)) & ~k.startswith("_"))


def attach_metadata(base, extra) -> Column:
    """The map ``base`` with the entries of ``extra`` over it. A blank or reserved key in ``extra`` is an error; null maps are empty."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(col(base), none), F.coalesce(col(extra), none)
    bad = F.filter(F.map_keys(new), lambda k: k.isin(list(RESERVED)) | (F.trim(k) == ""))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("source metadata must not set: "), F.array_join(bad, ", ")))).otherwise(merged)


def image_refs(c) -> Column:
    """Ids of the image markers in a text, in order."""
    return F.transform(extract_all(c, r"\[IMAGE:\s*([^\]]+)\]", 1), lambda x: F.trim(x))


def chunk_images(chunks: DataFrame) -> DataFrame:
    """``(doc_id, image_id, page, collection, created_at)``: one row an image that chunks of a document name. Ids are a hash, a page and a number joined by ``_``; other ids have no page."""
    named = chunks.select("doc_id", "collection", "loaded_at", F.explode(image_refs("text")).alias("image_id"))
    page = F.regexp_extract("image_id", r"^[0-9a-fA-F]+_(\d+)_\d+$", 1).try_cast("int")
    return named.groupBy("doc_id", "image_id").agg(F.first(page, True).alias("page"), F.min("collection").alias("collection"), F.min("loaded_at").alias("created_at"))


def inherit_metadata(chunks: DataFrame, documents: DataFrame, images: DataFrame) -> DataFrame:
    """``(chunk_id, metadata, image_refs, n_images, page_num)`` of ``chunks(chunk_id, doc_id, chunk_index, text)``: the metadata map of ``documents(doc_id, metadata)`` without its images, with
    the chunk's place, and the images it names. ``n_images`` counts those that ``images(doc_id, image_id, page)`` knows; ``page_num`` is the page of the first of them.
    Chunks without a document keep their own fields."""
    own = F.map_from_arrays(F.array(F.lit("chunk_index"), F.lit("source_ref")), F.array(F.col("chunk_index").cast("string"), F.col("doc_id")))
    old = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("images", "chunk_index", "source_ref"))
    base = chunks.join(documents.select("doc_id", "metadata"), "doc_id", "left").select("doc_id", "chunk_id", F.map_concat(old, own).alias("metadata"), F.coalesce(image_refs("text"), F.array().cast("array<string>")).alias("image_refs"))
    found = base.select("doc_id", "chunk_id", F.posexplode("image_refs").alias("pos", "image_id")).join(images.select("doc_id", "image_id", "page"), ["doc_id", "image_id"])
    seen = found.groupBy("chunk_id").agg(F.count("*").alias("n_images"), F.min_by("page", "pos").alias("page_num"))
    return base.join(seen, "chunk_id", "left").select("chunk_id", "metadata", "image_refs", F.coalesce("n_images", F.lit(0)).alias("n_images"), "page_num")


def document_title(title, first_text, path) -> Column:
    """The title given, else the first ``# `` heading among the first ten lines, else the file name with its words capitalised, else ``Untitled Document``."""
    lines = F.transform(F.slice(F.split(col(first_text), "\n"), 1, 10), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    heads = F.filter(lines, lambda s: s.startswith("# "))
    stem = F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    words = F.initcap(F.regexp_replace(stem, "[_-]", " "))
    given = F.when(col(title) != "", col(title))
    return F.coalesce(given, F.trim(F.substring(F.get(heads, F.lit(0)), F.lit(3), F.length(col(first_text)))), F.when(words != "", words), F.lit("Untitled Document"))


def document_preview(summary, first_text, most: int = 500) -> Column:
    """The summary given, else the first chunk without headings on one line, cut to ``most`` characters with ``...``."""
    lines = F.filter(F.transform(F.split(col(first_text), "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: (s != "") & ~s.startswith("#"))
    text = F.array_join(lines, " ")
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
    preview = F.when(F.coalesce(col(first_text), F.lit("")) == "", "No summary available.").when(cut == "", "No content preview available.").otherwise(cut)
    return F.coalesce(F.when(col(summary) != "", col(summary)), preview)


def document_tags(tags, doc_type) -> Column:
    """The tags of a comma-separated text, stripped, and the type of the document in capitals."""
    given = F.filter(F.transform(F.split(F.coalesce(col(tags), F.lit("")), ","), lambda x: F.trim(x)), lambda t: t != "")
    kind = F.when(col(doc_type) != "", F.upper(col(doc_type)))
    return F.when(kind.isNotNull() & ~F.array_contains(given, kind), F.concat(given, F.array(kind))).otherwise(given)


def identifiers(c) -> dict[str, Column]:
    """DOI, arXiv id, year, venue line and keywords of a paper's text; null or empty where there is none."""
    # The five patterns.
    t, some = col(c), lambda x: F.when(x != "", x)
    doi = F.regexp_replace(F.regexp_extract(t, r"(?i)(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)", 1), r"[.,;:]+$", "")
    line = F.regexp_extract(t, r"(?im)^\s*keywords\s*[:：]\s*(.+)$", 1)
    return {
        "doi": some(doi), "arxiv": some(F.regexp_extract(t, r"(?i)arXiv:\s*([0-9]{4}\.[0-9]{4,5})", 1)),
        "year": F.regexp_extract(t, r"\b(19[0-9]{2}|20[0-9]{2})\b", 1).try_cast("int"), "venue": some(F.regexp_extract(t, r"\b((?:Proceedings|Conference|Journal)\b[^\n]+)", 1)),
        "keywords": F.filter(F.transform(F.split(line, "[,;]"), lambda x: F.trim(x)), lambda x: x != ""),
    }


def captions(c) -> Column:
    """Image captions, written as a JSON object or as an array of ``{id or image_id, caption}``, as a map; entries without both are left out, of a repeated id the last counts."""
    raw = F.trim(col(c))
    items = F.from_json(raw, "array<struct<id:string,image_id:string,caption:string>>")
    pairs = F.transform(items, lambda x: F.struct(F.coalesce(x["id"], x["image_id"]).alias("key"), x["caption"].alias("value")))
    full = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    last = F.filter(full, lambda p, i: ~F.exists(F.slice(full, i + 2, F.size(full)), lambda q: q["key"] == p["key"]))
    return F.coalesce(F.when(raw.startswith("["), F.map_from_entries(last)).otherwise(F.from_json(raw, "map<string,string>")), F.create_map().cast("map<string,string>"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, n_rows)``: how many rows break each rule, a condition that is true for a bad row. One pass over the table."""
    counts = df.agg(*[F.count(F.when(test, 1)).alias(name) for name, test in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_rows")) for n in rules])))


def stage_summary(chunks: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Per document: number of chunks, their mean length without the fraction, and how many have each of ``flags``."""
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"), F.floor(F.sum(F.length(F.coalesce("text", F.lit("")))) / F.count("*")).alias("avg_chunk_size"), *[F.count(F.when(t, 1)).alias(n) for n, t in flags.items()]
    )


def top_terms(postings: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent terms of every chunk, ties by term."""
    w = Window.partitionBy("collection", "chunk_id").orderBy(F.desc("tf"), "term")
    return postings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("chunk_id", "rank", "term", "tf")
