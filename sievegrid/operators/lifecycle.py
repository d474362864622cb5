"""Upserts, deletes, sync plans, skips and the counts of collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
}


def where(filters: dict) -> Column:
    """A conjunction: ``{column: value}`` or ``{column: {"$gte": value, ...}}``. A missing value matches nothing but ``None``."""
    out = F.lit(True)
    for name, v in filters.items():
        tests = v if isinstance(v, dict) else {"$eq": v}
        for op, value in tests.items():
            out = out & (F.col(name).isNull() if value is None and op == "$eq" else F.coalesce(OPERATORS[op](F.col(name), value), F.lit(False)))
    return out


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in the place of rows of the same keys; null keys equal null keys."""
    n = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = [old[k].eqNullSafe(n[f"__{k}"]) for k in keys]
    return old.join(n, on, "left_anti").unionByName(new)


def delete_where(df: DataFrame, filters: dict) -> DataFrame:
    return df.where(~where(filters))


def delete_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def merge_metadata(df: DataFrame, filters: dict, updates: dict[str, str], column: str = "props") -> DataFrame:
    """The map ``column`` of the matching rows with ``updates`` merged in, the new value winning."""
    fresh = F.create_map(*[F.lit(x) for kv in updates.items() for x in kv])
    old = F.coalesce(F.map_filter(column, lambda k, v: ~k.isin(list(updates))), F.create_map().cast("map<string,string>"))
    return df.withColumn(column, F.when(where(filters), F.map_concat(old, fresh)).otherwise(F.col(column)))


def get_by_ids(ids: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """``ids(request_id, ids)`` against the store: one row an asked id, in the asked order, ``found`` false where it is missing."""
    asked = ids.select("request_id", F.posexplode("ids").alias("pos", key))
    return asked.join(store.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def skip_known(incoming: DataFrame, history: DataFrame, key: str = "file_sha256") -> DataFrame:
    """Rows whose hash is not yet recorded as a success; a null hash is never known."""
    return incoming.join(history.where("status in ('success', 'synced')").select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def sync_plan(source: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``add``, ``update`` or ``skip`` for every source row, by its hash and version against the state."""
    s = state.select(*keys, F.col("status").alias("__status"), F.col("file_sha256").alias("__sha"), F.col("source_version").alias("__version"), F.lit(True).alias("__known"))
    same = (F.col("__status") == "synced") & F.col("__sha").eqNullSafe(F.col("file_sha256")) & F.col("__version").eqNullSafe(F.col("source_version"))
    action = F.when(F.col("__known").isNull(), "add").when(F.coalesce(same, F.lit(False)), "skip").otherwise("update")
    return source.join(s, list(keys), "left").withColumn("action", action).drop("__status", "__sha", "__version", "__known")


def execute_plan(plan: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state after a sync plan: added and updated rows are ``synced`` with the source's hash and version, skipped rows stay as they are, and rows the source no
    longer lists become ``inactive``. ``plan`` comes from ``sync_plan``; both have ``(*keys, status, file_sha256, source_version)``."""
    cols = [*keys, "file_sha256", "source_version", "status"]
    done = plan.where("action <> 'skip'").select(*keys, "file_sha256", "source_version", F.lit("synced").alias("status"))
    kept = state.join(plan.where("action = 'skip'").select(*keys).distinct(), list(keys), "left_semi").select(*cols)
    lost = missing_from(state, plan, keys).select(*keys, "file_sha256", "source_version", F.lit("inactive").alias("status"))
    return done.unionByName(kept).unionByName(lost)


def delete_documents(stores: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every store ``(doc_id, ...)`` without the documents of ``gone(doc_id)``, and ``(store, n_before, n_deleted)``. Rows without a document stay."""
    ids = gone.select("doc_id").where("doc_id is not null").distinct().withColumn("__gone", F.lit(True))
    left = {n: df.join(ids.select("doc_id"), "doc_id", "left_anti") for n, df in stores.items()}
    report = None
    for n, df in stores.items():
        r = df.join(ids, "doc_id", "left").agg(F.lit(n).alias("store"), F.count("*").alias("n_before"), F.count("__gone").alias("n_deleted"))
        report = r if report is None else report.unionByName(r)
    return left, report


def by_identity(documents: DataFrame, **identity: str | None) -> DataFrame:
    """The documents with one identity, say ``item_key="X"``; none or several at once are an error."""
    given = {k: v for k, v in identity.items() if v is not None}
    if len(given) != 1:
        raise ValueError(f"exactly one of {', '.join(identity)}")
    return documents.where(where(given))


def missing_from(state: DataFrame, active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State rows whose keys the source no longer lists."""
    return state.join(active.select(*keys).distinct(), list(keys), "left_anti")


def document_counts(documents: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Documents with the numbers of their chunks and images; both sides are counted before they are joined."""
    c = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    i = images.groupBy("document_id").agg(F.count("*").alias("n_images"))
    return documents.join(c, "document_id", "left").join(i, "document_id", "left").fillna(0, ["n_chunks", "n_images"])


def bibtex(df: DataFrame) -> DataFrame:
    """``(id, entry)`` of ``df(id, title, authors array, year, venue, doi, url)``; empty fields are left out, an entry with a venue is an article."""
    def field(name: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {name}={{ "), c, F.lit(" }")))

    kind = F.when(F.coalesce("venue", F.lit("")) != "", "article").otherwise("misc")
    head = F.concat(F.lit("@"), kind, F.lit("{"), F.col("id"), F.lit(","))
    fields = [field("title", F.col("title")), field("author", F.array_join("authors", " and ")), field("year", F.col("year")), field("journal", F.col("venue")), field("doi", F.col("doi")), field("url", F.col("url"))]
    return df.select("id", F.concat_ws("\n", head, *fields, F.lit("}")).alias("entry"))
