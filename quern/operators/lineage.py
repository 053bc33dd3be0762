"""Joins between stages: comparing a row with what it refers to, updates, and all-or-nothing gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(rows: DataFrame, reference: DataFrame, key: str, reference_key: str, fields: dict[str, str]) -> DataFrame:
    """rows with errors: unknown reference, or every field that differs from the reference's (null equals null).

    fields: column of rows -> column of the reference, which has one row per key.
    """
    r = reference.select(F.col(reference_key).alias("_k"), *[F.col(b).alias(f"_r_{b}") for b in set(fields.values())])
    j = rows.join(r, rows[key] == F.col("_k"), "left")
    checks = [F.when(~F.col(a).eqNullSafe(F.col(f"_r_{b}")), F.lit(f"{a} does not match")) for a, b in fields.items()]
    errors = F.when(F.col("_k").isNull(), F.array(F.lit(f"unknown {key}"))).otherwise(F.array_compact(F.array(*checks)))
    return j.select(*[rows[c] for c in rows.columns], errors.alias("errors"))


def missing(expected: DataFrame, present: DataFrame, key: str, present_key: str | None = None) -> DataFrame:
    """The keys of expected that present hasn't got, once each."""
    p = present.select(F.col(present_key or key).alias(key))
    return expected.select(key).where(F.col(key).isNotNull()).distinct().join(p, key, "left_anti")


def update(rows: DataFrame, changes: DataFrame, key: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """rows with the columns of their change where there is one and `where` holds; other rows as they are.

    changes has one row per key. A change may set a column to null.
    """
    c = changes.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_n_{x}") for x in columns])
    j = rows.join(c, rows[key] == F.col("_k"), "left")
    hit = F.col("_k").isNotNull() & (where if where is not None else F.lit(True))
    return j.select(*[F.when(hit, F.col(f"_n_{x}")).otherwise(rows[x]).alias(x) if x in columns else rows[x] for x in rows.columns])


def all_or_nothing(rows: DataFrame, errors: str = "errors", most: int = 20) -> DataFrame:
    """rows without the column of errors; raises if any row has one, so that nothing partial is written."""
    bad = rows.where(F.size(errors) > 0)
    sample = bad.select(errors).limit(most).collect()
    if sample:
        raise ValueError("; ".join(e for r in sample for e in r[0]))
    return rows.drop(errors)


def rule_errors(rules: list[tuple[Column, str]]) -> Column:
    """array<string> of the messages whose condition is not true, in order; a null condition is a failure (see records for rules that give their message)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in rules]))


def filled(c: str, prefix: str | None = None) -> Column:
    """A string that isn't empty, with the prefix if one is given."""
    ok = F.length(F.col(c)) > 0
    return ok & F.startswith(F.col(c), F.lit(prefix)) if prefix else ok


def gates(table: DataFrame, bounds: list[tuple[str, Column, str, float]]) -> DataFrame:
    """(name, actual, op, bound, status) of a one-row table: min, max or exact; a null actual is unknown."""
    rows = []
    for name, actual, op, bound in bounds:
        a = actual.cast("double")
        ok = {"min": a >= bound, "max": a <= bound, "exact": a == bound}[op]
        rows.append(F.struct(F.lit(name).alias("name"), a.alias("actual"), F.lit(op).alias("op"), F.lit(float(bound)).alias("bound"), F.when(a.isNull(), "unknown").when(ok, "pass").otherwise("fail").alias("status")))
    return table.select(F.explode(F.array(*rows)).alias("g")).select("g.*")
