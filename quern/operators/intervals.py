"""Half-open time windows: assignment, overlaps, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFFSET = r"(Z|[+-]\d\d:?\d\d)$"


def rfc3339(c: Column) -> Column:
    """The instant of an RFC3339 string; null where it can't be read or has no offset."""
    return F.when(c.rlike(OFFSET), F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")))


def assign_windows(rows: DataFrame, windows: DataFrame, key: list[str], at: str, row_id: list[str], order: str = "_ord", value: str = "split") -> DataFrame:
    """rows that lie in a window of the same key, start <= at < end, with the value of the first such window.

    windows: key, start, end, order, value. Rows outside all windows are dropped. Windows of one key
    are equi-joined and the times are a residual condition; the join's fan-out is that of
    overlapping windows, and the first is taken per row.
    """
    w = windows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("start").alias("_s"), F.col("end").alias("_e"), F.struct(order, value).alias("_w"))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(key)]
    hit = rows.join(w, [*on, F.col(at) >= F.col("_s"), F.col(at) < F.col("_e")])
    rest = [c for c in rows.columns if c not in row_id]
    return hit.groupBy(*row_id).agg(*[F.first(c).alias(c) for c in rest], F.min("_w").alias("_w")).select(*rows.columns, F.col(f"_w.{value}").alias(value))


def overlaps(windows: DataFrame, key: list[str], window_id: str, strict: bool = False) -> DataFrame:
    """(key, window_id, previous_end): windows that start before the previous one of their key ends.

    Sorted by start. Not strict, only the window just before counts; strict, all earlier ones do.
    """
    w = Window.partitionBy(*key).orderBy("start", "end", window_id)
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) if strict else F.lag("end").over(w)
    return windows.withColumn("previous_end", before).where("start < previous_end").select(*key, window_id, "start", "previous_end")


def split_summary(windows: DataFrame, splits: list[str], split: str = "split", repo: str = "repo", target: str = "target_records") -> DataFrame:
    """(split, repos, windows, target_records, missing_targets): a row for every named split, also without windows."""
    per = windows.groupBy(split).agg(F.count_distinct(repo).alias("repos"), F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum(target), F.lit(0)).alias("target_records"), F.max(F.col(target).isNull()).alias("missing_targets"))
    all_splits = windows.sparkSession.createDataFrame([(s,) for s in splits], f"{split} string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return all_splits.join(per, split, "left").select(split, zero("repos"), zero("windows"), zero("target_records"), F.coalesce("missing_targets", F.lit(False)).alias("missing_targets"))


def largest_share(df: DataFrame, group: str, weight: Column | None = None) -> DataFrame:
    """One row: total, largest and share (6 digits; null without any weight)."""
    per = df.groupBy(group).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("total"), F.max("n").alias("largest")).withColumn("share", F.round(F.try_divide(F.col("largest"), F.col("total")), 6))
