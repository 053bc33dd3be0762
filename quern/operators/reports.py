"""Counts over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tri_state(rows: DataFrame, signals: list[str], by: list[str], total: bool = True) -> DataFrame:
    """(by, signal, n_true, n_false, n_null) for every signal; with total also over all values of the first of by, which is null then.

    One pass: all signals are counted together, totals are sums of the groups' rows, and the counts
    are unpivoted at the end.
    """
    counts = [f"{s}__{k}" for s in signals for k in "tfn"]
    kinds = {"t": lambda s: F.count_if(s), "f": lambda s: F.count_if(~F.col(s)), "n": lambda s: F.count_if(F.col(s).isNull())}
    grouped = rows.groupBy(*by).agg(*[kinds[c[-1]](c[:-3]).cast("bigint").alias(c) for c in counts])
    if total:
        kind = dict(rows.dtypes)[by[0]]
        # the groups' rows are read twice, a few rows; an empty table has no total either
        every = grouped.groupBy(*by[1:]).agg(*[F.sum(c).alias(c) for c in counts]).where(F.col(counts[0]).isNotNull())
        grouped = grouped.unionByName(every.withColumn(by[0], F.lit(None).cast(kind)))
    entries = F.array(*[F.struct(F.lit(s).alias("signal"), *[F.col(f"{s}__{k}").alias(n) for k, n in (("t", "n_true"), ("f", "n_false"), ("n", "n_null"))]) for s in signals])
    return grouped.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")


def top(rows: DataFrame, value: str, n: int, out: str = "n") -> DataFrame:
    """The n most frequent values, ties by value."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), F.asc(value)).limit(n)


def fixture_results(rows: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """(key, passed): expected is map<string, boolean>, actual a struct; only the keys that are given count."""
    got = F.from_json(F.to_json(actual), "map<string,string>")
    ok = F.forall(F.map_entries(expected), lambda e: F.element_at(got, e["key"]).eqNullSafe(e["value"].cast("string")))
    return rows.select(key, ok.alias("passed"))
