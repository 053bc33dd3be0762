"""Problem 6: at most so many records of each contributor, the best ones.

A histogram of quality per contributor, mergeable and so combined before its shuffle, gives the bin
in which the cap falls. Records above that bin stay, records below go, and only the records of that
bin are ranked. These may still be many for a large contributor, so their rank is a count over
sorted ranges: ranges are fixed first, each range counts its rows, and no task gets more than one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import repo_key, valid_rows
from quern.session import materialize

BINS = 1000


def ranked(rows: DataFrame, group: str, order: list) -> DataFrame:
    """rows with rank (from 1) within group by order, without ever collecting a group into one task.

    Rows are range-partitioned by group and order and written with their range, so that counting and
    ranking see the same ranges; a row's rank is what earlier ranges of its group hold plus its
    place in its own.
    """
    cut = materialize(rows.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = cut.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    placed = cut.withColumn("_own", own)
    return placed.join(before, [group, "_range"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")


def beyond_cap(records: DataFrame, group: str, key: str, quality: str, cap: DataFrame) -> DataFrame:
    """Records beyond their contributor's cap: (key, group).

    cap: one row with the column cap. Best is the highest quality in 0..1, then the smaller key;
    quality that is null, NaN or out of range comes last. Records without a contributor (null
    group) are one contributor. Repeated keys are separate records, ranked in any order.
    """
    q = F.col(quality).cast("double")
    good = q.isNotNull() & ~F.isnan(q) & (q >= 0) & (q <= 1)
    rows = records.select(F.coalesce(F.col(group), F.lit("")).alias("_group"), F.col(key).alias("_key"), F.when(good, q).otherwise(-1.0).alias("_q"))
    rows = materialize(rows.withColumn("_bin", F.when(F.col("_q") < 0, -1).otherwise(F.floor(F.col("_q") * BINS)).cast("int")), "quality")
    histogram = rows.groupBy("_group", "_bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_group").orderBy(F.desc("_bin"))  # at most BINS + 2 bins a group
    bins = histogram.withColumn("upto", F.sum("n").over(w)).crossJoin(F.broadcast(cap.select(F.col("cap").alias("cap"))))
    cutoff = bins.where("upto > cap and upto - n <= cap").select("_group", F.col("_bin").alias("cut"), (F.col("cap") - F.col("upto") + F.col("n")).alias("room"))
    over = rows.join(cutoff, "_group").where(F.col("_bin") <= F.col("cut"))
    below = over.where(F.col("_bin") < F.col("cut")).select("_key", "_group")
    border = over.where(F.col("_bin") == F.col("cut")).select("_group", "_key", "_q", "room")
    late = ranked(border, "_group", [F.desc("_q"), F.asc("_key")]).where(F.col("rank") > F.col("room")).select("_key", "_group")
    return below.unionByName(late).select(F.col("_key").alias(key), F.col("_group").alias(group))


def labels_beyond_cap(labels: DataFrame) -> DataFrame:
    """(label_id, repo) beyond the cap of a hundredth of the number of different labels, rounded down."""
    rows = valid_rows(labels.select("id", "_ord", repo_key("source_repo_url").alias("repo"), "confidence"), "id", "repo", "confidence")
    rows = materialize(rows, "labels")
    cap = rows.agg(F.floor(F.count(F.lit(1)) / 100).alias("cap"))
    return beyond_cap(rows, "repo", "id", "confidence", cap).withColumnRenamed("id", "label_id")


def report(labels: DataFrame) -> DataFrame:
    """(repo, labels, beyond): per repository."""
    rows = valid_rows(labels.select("id", "_ord", F.coalesce(repo_key("source_repo_url"), F.lit("")).alias("repo")), "id", "repo")
    beyond = labels_beyond_cap(labels).groupBy("repo").agg(F.count(F.lit(1)).alias("beyond"))
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("labels")).join(beyond, "repo", "left").select("repo", "labels", F.coalesce("beyond", F.lit(0)).alias("beyond"))
