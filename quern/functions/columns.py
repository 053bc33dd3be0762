"""Column helpers shared by all operators: blanks, repository keys, splits, valid rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks of any kind: white space, separators, controls and invisible format characters.
BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}]"


def strip(c: Column | str) -> Column:
    """The value without surrounding blanks of any kind; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def folded(c: Column | str) -> Column:
    return F.lower(strip(c))


def split_name(c: Column | str) -> Column:
    """DEV, REPORT or HELD_OUT; null for anything else."""
    u = F.upper(strip(c))
    return F.when(u.isin("DEV", "REPORT", "HELD_OUT"), u)


def repo_key(c: Column | str) -> Column:
    """host/owner/name in lower case; null where the URL is missing or blank.

    Scheme, user, www., port, fragment, query, .git and slashes at the end don't matter; both
    host:owner/name and host/owner/name are read.
    """
    u = F.regexp_replace(folded(c), r"[#?].*$", "")
    u = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"^[^/@]*@", "")
    u = F.regexp_replace(u, r"^www\.", "")
    u = F.regexp_replace(u, r"^([^/:]+):(\d+/)?/*", "$1/")
    u = F.regexp_replace(u, r"/+", "/")
    u = F.regexp_replace(u, r"(/|\.git)+$", "")
    return F.when(F.length(u) > 0, u)


#: The same as repo_key in SQL that DuckDB runs; {c} is the column.
REPO_KEY_SQL = (
    "nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    r"lower(regexp_replace({c}, '^[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+$', '', 'g')),"
    r" '[#?].*$', ''), '^[a-z][a-z0-9+.-]*://', ''), '^[^/@]*@', ''), '^www\.', ''), '^([^/:]+):([0-9]+/)?/*', '\1/'),"
    r" '/+', '/', 'g'), '(/|\.git)+$', ''), '')"
)

STRIP_SQL = r"regexp_replace({c}, '^[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+$', '', 'g')"


def norm_path(c: Column | str) -> Column:
    """A path with / for \\ and without leading ./ (any number of them)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./+)+", "")


def valid_rows(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Of several rows with one key the one with the highest _ord; rows without a key are dropped.

    One shuffle on the key that carries only the named columns, combined before it. A missing _ord
    loses against any other; rows equal in key and _ord are decided by their values, so the result
    doesn't depend on the order of reading.
    """
    newest = F.max(F.struct("_ord", *[F.col(c) for c in columns]))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(newest.alias("_v"))
        .select(key, *[F.col(f"_v.{c}").alias(c) for c in columns])
    )
