"""Evaluation of messages side by side, and summaries of a training table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import repo_key
from quern.functions.commits import with_score
from quern.operators.reports import tri_state

SIGNALS = ["format_validity", "scope_quality", "specificity", "brevity"]
SPLITS = ["DEV", "REPORT", "HELD_OUT"]


def scored_messages(rows: DataFrame, messages: dict[str, str], keep: list[str], paths: str = "changed_paths") -> DataFrame:
    """(keep, message, signals, type, errors): a row per row and kind of message. messages: kind -> column; null ones don't count."""
    kinds = F.array(*[F.struct(F.lit(k).alias("message"), F.col(c).alias("text")) for k, c in messages.items()])
    each = rows.select(*keep, F.col(paths).alias("_paths"), F.explode(kinds).alias("m")).select(*keep, "_paths", "m.message", "m.text").where("text is not null")
    scored = with_score(each, "text", "s", paths="_paths")
    return scored.select(*keep, "message", *[f"s.{c}" for c in SIGNALS], F.col("s.parsed.type").alias("type"), "s.errors")


def signal_counts(scored: DataFrame, split: str = "data_split") -> DataFrame:
    """(split, message, signal, n_true, n_false, n_null), per split and over all (null)."""
    return tri_state(scored, SIGNALS, [split, "message"])


def type_counts(scored: DataFrame) -> DataFrame:
    """(message, type, n) of messages that parse."""
    return scored.where("type is not null").groupBy("message", "type").agg(F.count(F.lit(1)).alias("n"))


def top_errors(scored: DataFrame, n: int = 10) -> DataFrame:
    """(message, error, n): the most frequent errors of each kind of message, ties by text."""
    counts = scored.select("message", F.explode_outer("errors").alias("error")).where("error is not null").groupBy("message", "error").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("message").orderBy(F.desc("n"), "error"))
    return counts.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def group_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(measure, key, n): how often every value of the columns occurs; one pass over rows for all of them."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("key")) for c in columns])).alias("e")).select("e.*")
    return each.groupBy("measure", "key").agg(F.count(F.lit(1)).alias("n"))


def changed(rows: DataFrame, target: str = "target_message", teacher: str = "teacher_message") -> DataFrame:
    """One row: records, and changed, those whose target isn't the teacher's message."""
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col(target).eqNullSafe(F.col(teacher))).alias("changed"))


def match_report(predictions: DataFrame) -> DataFrame:
    """One row: records, exact_match and type_match of predictions with those flags."""
    return predictions.agg(F.count(F.lit(1)).alias("records"), F.count_if("exact_match").alias("exact_match"), F.count_if("type_match").alias("type_match"))


def artifact_summary(rows: DataFrame, manifest: DataFrame, columns: list[str], split: str = "data_split", url: str = "source_repo_url") -> DataFrame:
    """(measure, key, value double) of a training table: what a readiness gate reads.

    records; split (all three, also without rows); repos of a split; top_repo, the ten largest
    repositories of DEV, ties by name; max_repo_fraction of DEV (null without any); the values of
    columns; ecosystem, those that the repositories have (value 1); missing_repo, repositories
    outside the manifest (value 1). manifest: (repo, ecosystem), one row per repository.
    """
    spark = rows.sparkSession
    per = rows.groupBy(F.col(split).alias("split"), repo_key(url).alias("repo")).agg(F.count(F.lit(1)).alias("n"))
    row = lambda df, measure, key, value: df.select(F.lit(measure).alias("measure"), key.alias("key"), value.cast("double").alias("value"))
    names = spark.createDataFrame([(s,) for s in SPLITS], "name string")
    sums = per.groupBy("split").agg(F.sum("n").alias("n"), F.count("repo").alias("repos"))
    seeded = names.join(sums, names.name == sums.split, "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("repos", F.lit(0)).alias("repos"))
    dev = per.where(F.col("split") == "DEV")
    own = per.where("repo is not null").groupBy("repo").agg(F.sum("n").alias("n")).join(manifest.select(F.col("repo").alias("_m"), "ecosystem"), F.col("repo") == F.col("_m"), "left")
    none = F.lit(None).cast("string")
    parts = [
        row(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "records", none, F.col("n")), row(seeded, "split", F.col("name"), F.col("n")), row(seeded, "repos", F.col("name"), F.col("repos")), row(dev.orderBy(F.desc("n"), "repo").limit(10), "top_repo", F.col("repo"), F.col("n")),
        row(dev.agg(F.round(F.max("n") / F.sum("n"), 6).alias("f")), "max_repo_fraction", none, F.col("f")), row(group_counts(rows, columns).select(F.concat_ws(":", "measure", F.coalesce("key", F.lit(""))).alias("k"), "n"), "count", F.col("k"), F.col("n")),
        row(own.where("length(ecosystem) > 0").select("ecosystem").distinct(), "ecosystem", F.col("ecosystem"), F.lit(1)), row(own.where("_m is null").select("repo").distinct(), "missing_repo", F.col("repo"), F.lit(1)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def baseline_errors(summary: DataFrame, reported: dict[str, float]) -> DataFrame:
    """(measure, key, reported, value): measures of a report ("measure" or "measure:key" -> number) that aren't what the summary has."""
    want = summary.sparkSession.createDataFrame([(*k.partition(":")[::2], float(v)) for k, v in reported.items()], "measure string, key string, reported double")
    have = summary.select(F.col("measure").alias("_m"), F.coalesce("key", F.lit("")).alias("_k"), "value")
    j = want.join(have, (F.col("measure") == F.col("_m")) & (F.col("key") == F.col("_k")), "left")
    return j.where(~F.col("value").eqNullSafe(F.col("reported"))).select("measure", "key", "reported", "value")


def decision_report(reviews: DataFrame, split: str = "data_split", decision: str = "decision", reasons: str = "reasons") -> DataFrame:
    """(measure, split, key, n): decisions per split, and every reason given, counted per element."""
    d = reviews.groupBy(F.col(split).alias("split"), F.col(decision).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("decision").alias("measure"), "split", "key", "n")
    r = reviews.select(F.explode_outer(reasons).alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return d.unionByName(r.select(F.lit("reason").alias("measure"), F.lit(None).cast("string").alias("split"), "key", "n"))


def extraction_report(candidates: DataFrame, repo: str = "repo", status: str = "status") -> DataFrame:
    """(repo, records, skipped_existing, skipped_split, errors) and their totals (repo null). status: written, existing, split or error; others don't count."""
    one = lambda value, out: F.count_if(F.col(status) == value).alias(out)
    names = ["records", "skipped_existing", "skipped_split", "errors"]
    per = candidates.groupBy(F.col(repo).alias("repo")).agg(*[one(v, n) for v, n in zip(("written", "existing", "split", "error"), names, strict=True)])
    return per.unionByName(per.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).select(F.lit(None).cast("string").alias("repo"), *names))
