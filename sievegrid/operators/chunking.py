"""Cutting documents into sections, chunks and tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import map_columns
from ..functions.text import asset_references, chunk_id

# Fixed value: separators from the strongest to the weakest.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")


def sections(docs: DataFrame) -> DataFrame:
    """``(doc_id, section_no, heading, body)``: a section starts at each Markdown heading, section 0 is what stands before the first.

    A document without headings is one section with an empty heading; an empty section 0 of a document that starts with a heading is left out.
    Lines are numbered by their position and summed up within the document, which bounds the window.
    """
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).where("pos is not null")
    head = F.col("line").rlike(r"^#+\s+\S")
    numbered = lines.withColumn("is_head", head).withColumn("section_no", F.sum(head.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos")))
    g = numbered.groupBy("doc_id", "section_no").agg(
        F.max(F.when(F.col("is_head"), F.trim(F.regexp_replace("line", r"^#+\s+", "")))).alias("heading"),
        F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("pos", "line")))).alias("ls"),
    )
    body = F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    out = g.select("doc_id", F.col("section_no").cast("int").alias("section_no"), F.coalesce("heading", F.lit("")).alias("heading"), body.alias("body"))
    only = F.max("section_no").over(Window.partitionBy("doc_id")) == 0
    return out.withColumn("only", only).where("section_no > 0 or body <> '' or only").drop("only")


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the strongest separator that occurs, merged up to ``size`` with up to ``overlap`` characters carried over.

    Separators stay at the start of the piece behind them. Pieces are stripped and empty ones dropped.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    sep = next((s for s in separators if s == "" or s in text), "")
    weaker = separators[separators.index(sep) + 1 :] if sep in separators else ()
    if sep:
        raw = re.split(f"(?={re.escape(sep)})", text)
    else:
        raw = [text[i : i + 1] for i in range(len(text))]
    out: list[str] = []
    held: list[str] = []
    width = 0

    def close() -> None:
        nonlocal held, width
        piece = "".join(held).strip()
        if piece:
            out.append(piece)
        while held and (width > overlap):
            width -= len(held.pop(0))

    for part in raw:
        if len(part) > size:
            close()
            held, width = [], 0
            out.extend(recursive_split(part, size, overlap, weaker or ("",)))
            continue
        if width + len(part) > size:
            close()
            while held and width + len(part) > size:
                width -= len(held.pop(0))
        held.append(part)
        width += len(part)
    piece = "".join(held).strip()
    if piece:
        out.append(piece)
    return out


def split_documents(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """``(doc_id, chunk_index, text, chunk_id)`` of ``docs(doc_id, text)``; null and blank texts have no chunks."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(b: dict[str, list]) -> dict[str, list]:
        rows = [(d, i, p) for d, t in zip(b["doc_id"], b["text"]) for i, p in enumerate(recursive_split(t, size, overlap))]
        return {c: [r[n] for r in rows] for n, c in enumerate(("doc_id", "chunk_index", "text"))}

    pieces = map_columns(docs.select("doc_id", "text").where("text is not null"), run, f"doc_id {kind}, chunk_index int, text string")
    return pieces.withColumn("chunk_id", chunk_id(F.col("doc_id").cast("string"), "chunk_index", "text"))


_ASSET = "array<struct<id:string,caption:string,description:string>>"


def split_papers(papers: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks ``(doc_id, chunk_index, chunk_id, chunk_type, section, text)`` of structured papers, in this order: title and abstract, one a figure, one a table, the body, the references.

    ``papers`` has ``(doc_id, title, abstract, figures, tables, sections, references)``, figures and tables being arrays of ``(id, caption, description)`` and sections one of ``(heading, level,
    paragraphs)``. Title and abstract are one chunk unless both are there and together longer than ``size``. Body texts begin with their heading, figures and tables they name become
    references, and only they and the references are split. Missing fields give no chunks; a paper that has none has no rows.
    """
    none = F.lit(None).cast("string")

    def piece(kind: str, text: Column, section: Column = none, cut: bool = False) -> Column:
        return F.struct(F.lit(kind).alias("kind"), section.alias("section"), text.alias("text"), F.lit(cut).alias("cut"))

    empty = F.array().cast("array<struct<kind:string,section:string,text:string,cut:boolean>>")
    has_title, has_abstract = (F.coalesce(F.col(c), F.lit("")) != "" for c in ("title", "abstract"))
    title, abstract = F.concat(F.lit("# "), "title"), F.concat(F.lit("## Abstract\n"), "abstract")
    both = F.concat_ws("\n\n", F.when(has_title, title), F.when(has_abstract, abstract))
    head = (
        F.when(has_title & has_abstract & (F.length(both) > size), F.array(piece("title", title), piece("abstract", abstract)))
        .when(has_title | has_abstract, F.array(piece("title_abstract", both))).otherwise(empty)
    )

    def assets(c: str, kind: str, form: str) -> Column:
        blank = lambda x: F.coalesce(x, F.lit(""))
        return F.coalesce(F.transform(c, lambda x: piece(kind, F.format_string(form, x["id"], blank(x["caption"]), blank(x["description"])))), empty)

    ids = {c: F.transform(F.coalesce(c, F.array().cast(_ASSET)), lambda x: x["id"]) for c in ("figures", "tables")}

    def body(x: Column) -> Column:
        text = F.array_join(x["paragraphs"], "\n\n")
        marks = F.repeat(F.lit("#"), F.least(F.coalesce(x["level"], F.lit(1)) + 1, F.lit(6)))
        text = F.when(F.coalesce(x["heading"], F.lit("")) != "", F.concat(marks, F.lit(" "), x["heading"], F.lit("\n\n"), text)).otherwise(text)
        return piece("body", asset_references(text, ids["figures"], ids["tables"]), x["heading"], True)

    sections_ = F.coalesce(F.transform(F.filter("sections", lambda x: F.size(x["paragraphs"]) > 0), body), empty)
    refs = F.when(F.coalesce(F.col("references"), F.lit("")) != "", F.array(piece("reference", F.col("references"), F.lit("References"), True))).otherwise(empty)
    figures = assets("figures", "figure", "[FIGURE: %s]\nCaption: %s\nDescription: %s")
    tables_ = assets("tables", "table", "[TABLE_DATA: %s]\nCaption: %s\nContent:\n%s")
    laid = papers.select("doc_id", F.posexplode(F.concat(head, figures, tables_, sections_, refs)).alias("pos", "p")).select("doc_id", "pos", "p.*")
    kind = dict(papers.dtypes)["doc_id"]

    def run(b: dict[str, list]) -> dict[str, list]:
        rows = []
        for d, pos, k, s, t, cut in zip(*[b[c] for c in ("doc_id", "pos", "kind", "section", "text", "cut")]):
            rows += [(d, pos, n, k, s, x) for n, x in enumerate(recursive_split(t, size, overlap) if cut else [t])]
        return {c: [r[n] for r in rows] for n, c in enumerate(("doc_id", "pos", "piece", "chunk_type", "section", "text"))}

    cut_ = map_columns(laid, run, f"doc_id {kind}, pos int, piece int, chunk_type string, section string, text string")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "piece")) - 1
    out = cut_.withColumn("chunk_index", at)
    return out.select("doc_id", "chunk_index", chunk_id(F.col("doc_id").cast("string"), "chunk_index", "text").alias("chunk_id"), "chunk_type", "section", "text")


def parent_groups(chunks: DataFrame, limit: int = 1200) -> DataFrame:
    """``(doc_id, chunk_id, group_no)``: neighbouring chunks of a document share a parent while their section stays the same and their lengths add up to
    ``limit`` at most. ``chunks(doc_id, chunk_id, chunk_index, section, text)``; the fold runs over one document's lengths, not texts. A chunk
    without a document is a group of its own."""
    item = F.struct(F.coalesce("chunk_index", F.lit(0)).alias("i"), "chunk_id", F.coalesce("section", F.lit("")).alias("s"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    alone = F.when(F.col("doc_id").isNull(), F.col("chunk_id"))
    rows = chunks.groupBy("doc_id", alone.alias("alone")).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    kind = "struct<g:int,s:string,n:int,out:array<struct<chunk_id:string,group_no:int>>>"
    zero = F.struct(F.lit(-1).alias("g"), F.lit("").alias("s"), F.lit(0).alias("n"), F.array().cast("array<struct<chunk_id:string,group_no:int>>").alias("out")).cast(kind)

    def step(a, x):
        new = (a["g"] < 0) | (a["s"] != x["s"]) | (a["n"] + x["n"] > limit)
        g = a["g"] + new.cast("int")
        return F.struct(
            g.alias("g"), x["s"].alias("s"), (F.when(new, x["n"]).otherwise(a["n"] + x["n"])).alias("n"),
            F.concat(a["out"], F.array(F.struct(x["chunk_id"].alias("chunk_id"), g.alias("group_no")))).alias("out"),
        ).cast(kind)

    return rows.select("doc_id", F.explode(F.aggregate("rows", zero, step)["out"]).alias("o")).select("doc_id", "o.chunk_id", "o.group_no")


def parents(chunks: DataFrame, limit: int = 1200) -> DataFrame:
    """``(parent_id, document_id, section_path, child_ids, text, page_start, page_end)``: the texts of the chunks that ``parent_groups`` puts together, in order, a blank line between them.

    ``chunks(doc_id, chunk_id, chunk_index, section, text, page)``. One parent is bounded by ``limit``, or by its only chunk."""
    groups = parent_groups(chunks, limit).select(F.col("doc_id").alias("__doc"), F.col("chunk_id").alias("__chunk"), "group_no")
    c = chunks.join(groups, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("chunk_id") == F.col("__chunk"))).withColumn("alone", F.when(F.col("doc_id").isNull(), F.col("chunk_id")))
    item = F.struct(F.coalesce("chunk_index", F.lit(0)).alias("i"), "chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    g = c.groupBy("doc_id", "alone", "group_no").agg(
        F.array_sort(F.collect_list(item)).alias("rows"), F.max(F.coalesce("section", F.lit(""))).alias("section_path"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    number = F.col("group_no").cast("string")
    digest = F.substring(F.sha2(F.concat_ws(":", "doc_id", number, "section_path"), 256), 1, 12)
    return g.select(
        F.concat_ws("_", F.lit("section"), "doc_id", F.lpad(number, 4, "0"), digest).alias("parent_id"), F.col("doc_id").alias("document_id"), "section_path",
        F.transform("rows", lambda r: r["chunk_id"]).alias("child_ids"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n").alias("text"), "page_start", "page_end")


def _table_lines(docs: DataFrame) -> DataFrame:
    """Lines of texts with the number of the table they may belong to: ``rule``, ``starts`` and ``inside`` mark the separator, the header and all lines of a table."""
    lines = docs.select("doc_id", "source_path", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).where("pos is not null")
    w = Window.partitionBy("doc_id").orderBy("pos")
    bar = F.col("line").contains("|")
    rule = bar & F.col("line").rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
    marked = lines.withColumn("bar", bar).withColumn("rule", rule).withColumn("starts", bar & ~rule & F.coalesce(F.lead(rule).over(w), F.lit(False)))
    marked = marked.withColumn("table_no", F.sum(F.col("starts").cast("int")).over(w)).withColumn("stop", F.sum((~F.col("bar")).cast("int")).over(w))
    first = F.max(F.when(F.col("starts"), F.col("stop"))).over(Window.partitionBy("doc_id", "table_no"))
    return marked.withColumn("inside", (F.col("table_no") > 0) & (F.col("stop") == first) & F.col("bar"))


def _table_id(source: str = "source_path", number: str = "table_no") -> Column:
    return F.concat(F.substring(F.sha2(F.coalesce(source, F.lit("")), 256), 1, 8), F.lit("_table_"), F.lpad(F.col(number).cast("string"), 2, "0"))


def with_placeholders(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of ``docs(doc_id, source_path, text)`` with every Markdown table replaced by a line that names it; null texts are left out."""
    line = F.when(F.col("starts") & F.col("inside"), F.concat(F.lit("[TABLE: "), _table_id(), F.lit("]"))).otherwise(F.col("line"))
    kept = _table_lines(docs.where("text is not null")).where("not inside or starts").select("doc_id", "pos", line.alias("line"))
    g = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return g.select("doc_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


def tables(docs: DataFrame) -> DataFrame:
    """Markdown tables of ``docs(doc_id, source_path, text)``: ``(doc_id, table_no, table_id, n_columns, n_rows, csv)``.

    A table is a run of lines with ``|`` whose second line is a separator line. Cells are joined by commas as they are.
    """
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = _table_lines(docs).where("inside and not rule").withColumn("cells", cells)
    g = rows.groupBy("doc_id", "source_path", "table_no").agg(F.array_sort(F.collect_list(F.struct("pos", "cells"))).alias("rs"))
    return g.select(
        "doc_id", F.col("table_no").cast("int").alias("table_no"),
        _table_id().alias("table_id"),
        F.size(F.get("rs", F.lit(0))["cells"]).alias("n_columns"), (F.size("rs") - 1).alias("n_rows"),
        F.array_join(F.transform("rs", lambda r: F.array_join(r["cells"], ",")), "\n").alias("csv"),
    )
