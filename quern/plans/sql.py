"""The SQL surface: all tables of a folder as views, and SQL functions for what SQL lacks."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from quern.functions.columns import BLANK
from quern.functions.commits import HEADER
from quern.functions.tokens import TOKEN


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: name(arguments) -> type, and its body.
FUNCTIONS = {
    "strip_blanks(s STRING)": ("STRING", f"regexp_replace(s, {_quoted(f'^{BLANK}+|{BLANK}+$')}, '')"),
    "repo_key(url STRING)": (
        "STRING",
        "nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_blanks(url)), '[#?].*$', ''),"
        f" '^[a-z][a-z0-9+.-]*://', ''), '^[^/@]*@', ''), {_quoted(r'^www\.')}, ''), {_quoted(r'^([^/:]+):(\d+/)?/*')}, '$1/'), '/+', '/'), {_quoted(r'(/|\.git)+$')}, ''), '')",
    ),
    "norm_path(p STRING)": ("STRING", f"regexp_replace(replace(p, '\\\\', '/'), {_quoted(r'^(\./+)+')}, '')"),
    "code_tokens(t STRING)": ("ARRAY<STRING>", f"transform(regexp_extract_all(coalesce(t, ''), {_quoted('(?U)' + TOKEN)}, 0), x -> if(x = '\\n', '<nl>', x))"),
    "commit_type(header STRING)": ("STRING", f"nullif(regexp_extract(header, {_quoted(HEADER)}, 1), '')"),
    "commit_scope(header STRING)": ("STRING", f"nullif(regexp_extract(header, {_quoted(HEADER)}, 2), '')"),
}


def register(spark: SparkSession, folder: str | None = None, tables: list[str] | None = None) -> list[str]:
    """Temporary functions, and a view per table if a folder is given; the names of the views."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    views = []
    for t in tables or []:
        name = PurePosixPath(t).name.removesuffix(".parquet")
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
        views.append(name)
    return views
