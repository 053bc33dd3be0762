"""JSON lines, JSON documents, checksums and templates."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.dedup import new_rows


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of a JSON lines file, blank lines skipped, with _ord; a line that is no object fails when it is read.

    _ord grows with the file name and the position in it, so it orders rows as the files do.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_ord")).where(F.trim("value") != "")
    parsed = F.from_json("value", kind, {"mode": "PERMISSIVE"})
    is_object = F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$", "string").startswith("{") | (F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT")), F.lit(False))
    checked = F.when(is_object, parsed).otherwise(F.raise_error(F.concat("_file", F.lit(": invalid JSON object: "), F.substring("value", 1, 80))))
    return lines.select(checked.alias("r"), "_ord").select("r.*", "_ord")


def read_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object as one row; its arrays become tables by explode."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def sorted_columns(df: DataFrame, skip: tuple[str, ...] = ("_ord",)) -> DataFrame:
    return df.select(*sorted(c for c in df.columns if c not in skip))


def write_jsonl(df: DataFrame, path: str, order: str = "_ord") -> None:
    """One object a line, keys sorted, null fields kept, ordered over the part files' names."""
    sorted_columns(df.repartitionByRange(order).sortWithinPartitions(order)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_new(df: DataFrame, path: str, key: str, schema: str | T.StructType) -> int:
    """Append the rows whose key isn't in the files at path yet; the number of rows added. Safe to run again."""
    spark = df.sparkSession
    try:
        there = read_jsonl(spark, path, schema).select(key)
    except Exception as e:  # the path is created by the first call
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = spark.createDataFrame([], df.select(key).schema)
    fresh = new_rows(there, df, key).cache()
    n = fresh.count()
    if n:
        sorted_columns(fresh).write.mode("append").option("ignoreNullFields", False).json(path)
    fresh.unpersist()
    return n


def write_report(report: dict, path: str) -> Path:
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(report, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return out


def matching_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(full, bytes) of the files that match, those in a matching folder included; empty files too, which no Spark scan shows."""
    rows = []
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in system.globStatus(path) or []:
            rows += [(str(f.getPath().toUri().getPath()), f.getLen()) for f in (system.listStatus(found.getPath()) if found.isDirectory() else [found]) if f.isFile()]
    return spark.createDataFrame(rows, "full string, bytes bigint")


def checksums(spark: SparkSession, patterns: list[str], root: str = "") -> DataFrame:
    """(path, sha256, bytes) of all files that match, paths relative to root.

    Names and lengths are listed on the driver; each task streams its files, so their size doesn't
    matter. Files are read through the local file system or a mount.
    """
    files = matching_files(spark, patterns)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = []
            for name in pdf["full"]:
                with open(name, "rb") as f:
                    sums.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pdf.assign(sha256=sums)

    hashed = files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(digest, "full string, bytes bigint, sha256 string")
    path = F.when(F.startswith("full", F.lit(root)), F.substr("full", F.lit(len(root) + 1))).otherwise(F.col("full"))
    return hashed.select(F.regexp_replace(path, "^/", "").alias("path"), "sha256", "bytes")


def verify_checksums(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """manifest (path, sha256) with status: ok, changed or missing."""
    a = actual.select("path", F.col("sha256").alias("_now"))
    return manifest.join(a, "path", "left").withColumn("status", F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("sha256"), "ok").otherwise("changed")).drop("_now")


def fenced_template(text: str, marker: str) -> str:
    """The first fenced block after a marker line of a Markdown text."""
    at = text.find(marker)
    found = re.search(r"```[^\n]*\n(.*?)\n```", text[at + len(marker) :], re.S) if at >= 0 else None
    if not found:
        raise ValueError(f"no fenced block after {marker!r}")
    return found.group(1)


def _bare_json(value: F.Column) -> F.Column:
    """The value as JSON: it is written inside a list, whose brackets go."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def json_list(values: F.Column) -> F.Column:
    """A list of strings as JSON with a blank after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, _bare_json), ", "), F.lit("]"))


def render_template(template: str, values: dict[str, F.Column]) -> F.Column:
    """The template with every {name} replaced by a column, in turn; null is empty, arrays are written as JSON (see json_list for its blanks)."""
    out = F.lit(template)
    for name, value in values.items():
        text = F.when(F.startswith(F.typeof(value), F.lit("array")), _bare_json(value)).otherwise(value.cast("string"))
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(text, F.lit("")))
    return out


def write_checksums(spark: SparkSession, patterns: list[str], path: str, root: str = "") -> int:
    """A text file of lines "<sha256>  <path>", by path, for all files that match; the number of lines. A pattern without a file is an error."""
    rows = checksums(spark, patterns, root).select(F.concat_ws("  ", "sha256", "path").alias("value"), "path")
    lines = [r["value"] for r in rows.orderBy("path").select("value").toLocalIterator()]
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text("".join(line + "\n" for line in lines), encoding="utf-8")
    return len(lines)


def file_entries(names: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, exists, sha256, bytes) of the named paths; null where there is no file. actual: checksums()."""
    a = actual.select(F.col("path").alias("_p"), "sha256", "bytes")
    return names.select("path").distinct().join(a, F.col("path") == F.col("_p"), "left").select("path", F.col("_p").isNotNull().alias("exists"), "sha256", "bytes")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Fixture cases (id, split, message, context, expected) of a JSON lines file; what a context lacks is empty, null or false."""
    context = "changed_paths array<string>, expected_type string, expected_scope string, expect_body boolean, expect_footer boolean, expect_mixed_change_warning boolean, expect_breaking_change boolean, forbidden_claims array<string>"
    schema = f"id string, split string, message string, context struct<{context.replace(' ', ': ').replace(',: ', ', ')}>, expected map<string, boolean>"
    rows = read_jsonl(spark, path, schema)
    none = F.array().cast("array<string>")
    c = lambda f: F.col(f"context.{f}")
    given = [F.coalesce(c(f), none).alias(f) if f in ("changed_paths", "forbidden_claims") else F.coalesce(c(f), F.lit(False)).alias(f) if f.startswith("expect_") else c(f).alias(f) for f in (x.split()[0] for x in context.split(", "))]
    return rows.select("id", "split", "message", F.struct(*given).alias("context"), "expected", "_ord")


def stable_sha256(document: dict) -> str:
    """SHA-256 of a document as JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode("utf-8")).hexdigest()
