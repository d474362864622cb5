"""Current and live rows of append-log tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread


def key_states(df: DataFrame, keys: Sequence[str], at: str = "loaded_at", deleted: str | None = "deleted_at") -> DataFrame:
    """One narrow row per key: ``first_at``, ``current_at`` and ``is_deleted`` of its current row.

    The current row is the one with the greatest ``at``; of rows that share it, a deletion wins.
    Only fixed-width columns are aggregated, so the texts never take part in the shuffle and the
    aggregation combines map-side. Null keys form a key of their own.
    """
    gone = F.col(deleted).isNotNull() if deleted else F.lit(False)
    return df.groupBy(*keys).agg(
        F.min(at).alias("first_at"),
        F.max(at).alias("current_at"),
        (F.max(F.when(gone, F.col(at))) >= F.max(at)).alias("is_deleted"),
    ).withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))


def _identified(df: DataFrame) -> DataFrame | None:
    """``df`` with the place of every row in its files, if it is read from Parquet files."""
    try:
        return df.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return None


def live_rows(df: DataFrame, keys: Sequence[str], where: Column | None = None, at: str = "loaded_at", deleted: str | None = "deleted_at") -> DataFrame:
    """The current rows of the keys that are not deleted, one row per key, all columns kept.

    Of rows that share the greatest ``at`` a deletion wins, else one of them is taken. ``where`` is tested on the current row only; rows that fail it are
    dropped before the join, so a selective predicate keeps the wide columns out of the shuffle. Rows read from Parquet are known by their place
    in the files: one narrow row a key is aggregated, and the wide columns meet it in a single semi-join, without being grouped themselves;
    ``df`` must not hold a shuffle then.
    """
    placed = _identified(df)
    if placed is not None:
        gone = F.col(deleted).isNotNull() if deleted else F.lit(False)
        newest = F.max(F.struct(F.col(at).alias("at"), gone.alias("gone"), "__file", "__row")).alias("s")
        taken = placed.groupBy(*keys).agg(newest).where("not s.gone").select(F.col("s.__file").alias("__f"), F.col("s.__row").alias("__r"))
        wide = spread(placed if where is None else placed.where(where))
        return wide.join(taken, (F.col("__file") == F.col("__f")) & (F.col("__row") == F.col("__r")), "left_semi").drop("__file", "__row")
    states = key_states(df, keys, at, deleted).where(~F.col("is_deleted")).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("current_at").alias("__at"))
    wide = df if where is None else df.where(where)
    on = [wide[k].eqNullSafe(F.col(f"__{k}")) for k in keys] + [wide[at].eqNullSafe(F.col("__at"))]
    return wide.join(states, on, "left_semi").dropDuplicates(list(keys))
