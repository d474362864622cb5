"""References to records that are absent, deleted or loaded later, and what hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .versions import key_states

#: Columns of a reference table: one row per mention.
REF_COLUMNS = ("ref_table", "target_table", "target_scope", "record_key", "ref_value", "ref_at")


def references(df: DataFrame, ref_table: str, target_table: str, record_key, ref_value, ref_at, target_scope=None) -> DataFrame:
    """Mentions of keys of ``target_table`` in ``df``; null and empty references are none."""
    return df.select(
        F.lit(ref_table).alias("ref_table"),
        F.lit(target_table).alias("target_table"),
        (F.lit("") if target_scope is None else F.coalesce(target_scope, F.lit(""))).alias("target_scope"),
        record_key.alias("record_key"),
        ref_value.alias("ref_value"),
        ref_at.cast("timestamp_ntz").alias("ref_at"),
    ).where(F.col("ref_value").isNotNull() & (F.col("ref_value") != ""))


def targets(df: DataFrame, target_table: str, key: str, scope: str | None = None, deleted: str | None = "deleted_at") -> DataFrame:
    """First load and deletion state of every key of ``df``."""
    named = df.select(
        F.lit(target_table).alias("target_table"),
        (F.coalesce(F.col(scope), F.lit("")) if scope else F.lit("")).alias("target_scope"),
        F.col(key).alias("target_key"),
        F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"),
        *([F.col(deleted).alias("deleted_at")] if deleted else []),
    )
    return key_states(named, ["target_table", "target_scope", "target_key"], deleted="deleted_at" if deleted else None)


def utc_text(col: str):
    """An ISO 8601 UTC text, with ``T`` or a blank, with ``Z``, an offset of zero or none, as a
    timestamp without zone; anything else is null."""
    return F.regexp_replace(F.trim(F.col(col)), r"(Z|[+-]00(:?00)?)$", "").try_cast("timestamp_ntz")


def _direct(refs: DataFrame, known: DataFrame) -> DataFrame:
    """The first round of the cascade: references whose target is not at hand. Mentions are reduced map-side to one row per record and value before
    the join, and the target side has one row per key, so a target that a third of all records name skews one side only, which
    adaptive execution splits."""
    once = refs.groupBy("ref_table", "target_table", "target_scope", "record_key", "ref_value").agg(F.min("ref_at").alias("ref_at"))
    t = known.withColumnsRenamed({"target_table": "t_table", "target_scope": "t_scope"})
    joined = once.join(t, (F.col("target_table") == F.col("t_table")) & (F.col("target_scope") == F.col("t_scope")) & (F.col("ref_value") == F.col("target_key")), "left")
    kind = (
        F.when(F.col("target_key").isNull(), "missing")
        .when(F.col("is_deleted"), "deleted")
        .when(F.col("first_at") > F.col("ref_at"), "late")
    )
    return joined.select("ref_table", F.date_format("ref_at", "yyyy-MM").alias("period"), "record_key", "ref_value", kind.alias("kind"), "target_table", "target_scope").where("kind is not null")


def orphan_cascade(refs: DataFrame, known: DataFrame, edges: DataFrame | None = None, gone: tuple[str, ...] = ("missing", "deleted")) -> tuple[DataFrame, DataFrame | None]:
    """References whose target is not at hand, and everything that hangs on the records that hold them.

    Round 0 gives the direct orphans ``(ref_table, period, record_key, ref_value, kind, target_table, target_scope)``, one row per record and
    value. ``kind`` is ``missing`` (the target has no row), else ``deleted`` (its current row is a deletion), else ``late``
    (first loaded after the earliest mention). ``period`` is the month of the earliest mention, null where no mention has a time;
    such a reference is never late.

    With ``edges(record_table, record_key, parent_table, parent_key)``, the foreign keys of all tables, records with a direct orphan of a kind in
    ``gone`` start the cascade: each round semi-joins the edges with the records the round before reached, leaves out those already
    reached, and the rounds go on until one adds none, however many that takes; cycles cannot keep it from ending. Returns also
    ``(record_table, record_key, level, kind)``, kind being ``direct`` at level 0 and ``inherited`` above; a record reached
    twice keeps its least level. Without ``edges`` round 0 is all there is, and nothing is computed but what it reports.
    Each round is written to the shared folder; every 16 rounds all that was reached is written as one table, so the plan
    stays short and a lost executor costs one round. Null keys take no part.
    """
    direct = _direct(refs, known)
    if edges is None:
        return direct, None
    direct = materialize(direct, "direct")
    e = edges.where(F.col("record_key").isNotNull() & F.col("parent_key").isNotNull()).distinct()
    first = direct.where(F.col("kind").isin(list(gone))).select(F.col("ref_table").alias("record_table"), "record_key").distinct()
    return direct, inherited(first, e)


def inherited(first: DataFrame, edges: DataFrame) -> DataFrame:
    """The fixpoint of ``orphan_cascade`` from the records ``first(record_table, record_key)``."""
    e = edges.where(F.col("record_key").isNotNull() & F.col("parent_key").isNotNull())
    reached = materialize(first.select("record_table", "record_key").distinct().withColumn("level", F.lit(0)), "orphans")
    frontier, level = reached, 0
    while True:
        level += 1
        up = frontier.select(F.col("record_table").alias("parent_table"), F.col("record_key").alias("parent_key"))
        new = (
            e.join(up, ["parent_table", "parent_key"], "left_semi").select("record_table", "record_key").distinct()
            .join(reached, ["record_table", "record_key"], "left_anti").withColumn("level", F.lit(level))
        )
        frontier = materialize(new, "orphans")
        if frontier.isEmpty():
            return reached.withColumn("kind", F.when(F.col("level") == 0, "direct").otherwise("inherited"))
        reached = reached.unionByName(frontier)
        if level % 16 == 0:
            reached = materialize(reached, "orphans")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of orphan references per table, month and kind."""
    return orphans.groupBy("ref_table", "period", "kind").agg(F.count("*").alias("n_refs"), F.countDistinct("record_key").alias("n_records"))
