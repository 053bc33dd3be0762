"""Keys seen before: last and first rows, duplicates, merges of several inputs, limits by group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import valid_rows
from quern.session import materialize

last_rows = valid_rows


def first_rows(df: DataFrame, key: str, order: str = "_ord") -> DataFrame:
    """The first row of every key (a null key is a key)."""
    row = F.struct(order, *[c for c in df.columns if c not in (key, order)])
    best = df.groupBy(key).agg(F.min(row).alias("_v"))
    return best.select(*[F.col(key) if c == key else F.col(f"_v.{c}").alias(c) for c in df.columns])


def duplicates(df: DataFrame, key: str, order: str = "_ord") -> DataFrame:
    """(key, n, first): keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")


def limit_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n per group and task before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def limit_two_levels(df: DataFrame, group: list[str], order: list[Column], per_group: int, keep: Column, overall: int, by: list[Column]) -> DataFrame:
    """At most per_group candidates of each group, of which those that satisfy keep, at most overall in the order by."""
    return limit_per_group(df, group, order, per_group).where(keep).orderBy(*by).limit(overall)


def new_rows(existing: DataFrame, incoming: DataFrame, key: str, order: str = "_ord") -> DataFrame:
    """Rows to append when a run is resumed: the first of every key that isn't there yet."""
    return first_rows(incoming, key, order).join(existing.select(key).distinct(), key, "left_anti")


def merge_inputs(inputs: list[DataFrame], primary: str, secondary: str, order: str = "_ord") -> tuple[DataFrame, DataFrame]:
    """(kept, report): inputs in turn, each row kept unless its primary or secondary key was kept before.

    A skipped row registers neither key, so a row depends on all earlier rows that share a key with
    it, directly or not. Of a primary and a secondary that only go with each other the first row is
    kept. The other rows are brought together by passing on the smallest label along shared keys, and
    only these groups are folded in order. Rows without one of the keys are left out. The report has
    (input, rows, kept, skipped).
    """
    rows = None
    for i, df in enumerate(inputs):
        one = df.withColumn("_input", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    rows = materialize(rows.withColumn("_at", F.struct("_input", order)), "merge")
    several = lambda a, b: rows.groupBy(a).agg((F.min(b) != F.max(b)).alias(f"_several_{a}"))
    marked = rows.join(several(primary, secondary), primary).join(several(secondary, primary), secondary)
    marked = materialize(marked.withColumn("_tangled", F.col(f"_several_{primary}") | F.col(f"_several_{secondary}")).select(*rows.columns, "_tangled"), "marked")
    plain = marked.where("not _tangled").drop("_tangled")
    at = plain.groupBy(primary).agg(F.min("_at").alias("_first"))
    kept = plain.join(at, primary).where(F.col("_at") == F.col("_first")).select(*rows.columns)
    tangled = marked.where("_tangled").drop("_tangled")
    if tangled.limit(1).count():
        keys = tangled.select("_input", order, F.col(primary).alias("p"), F.col(secondary).alias("s"))
        label = materialize(keys.withColumn("label", F.xxhash64("p")), "label")
        while True:
            low_p = label.groupBy("p").agg(F.min("label").alias("lp"))
            low_s = label.groupBy("s").agg(F.min("label").alias("ls"))
            after = label.join(low_p, "p").join(low_s, "s").select("_input", order, "p", "s", F.least("lp", "ls").alias("next"), "label")
            after = materialize(after, "label")
            moved = after.where("next <> label").limit(1).count()
            label = after.select("_input", order, "p", "s", F.col("next").alias("label"))
            if not moved:
                break

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_input", order], kind="stable")
            p_seen, s_seen, keep = set(), set(), []
            for p, s in zip(pdf["p"], pdf["s"], strict=True):
                ok = p not in p_seen and s not in s_seen
                keep.append(ok)
                if ok:
                    p_seen.add(p)
                    s_seen.add(s)
            return pdf.loc[keep, ["_input", order]]

        chosen = label.groupBy("label").applyInPandas(fold, f"_input int, {order} {dict(rows.dtypes)[order]}")
        kept = kept.unionByName(tangled.join(chosen, ["_input", order], "left_semi"))
    kept = materialize(kept.drop("_at"), "kept")
    report = rows.groupBy(F.col("_input").alias("input")).agg(F.count(F.lit(1)).alias("rows"))
    got = kept.groupBy(F.col("_input").alias("input")).agg(F.count(F.lit(1)).alias("kept"))
    zero = F.coalesce("kept", F.lit(0).cast("bigint"))
    return kept.select(*inputs[0].columns), report.join(got, "input", "left").select("input", "rows", zero.alias("kept"), (F.col("rows") - zero).alias("skipped"))
