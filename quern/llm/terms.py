"""Problem 1: how often every distinct term occurs, and in how many records.

Pairs of term and record are range-partitioned and sorted, and one pass over the sorted runs counts
occurrences and records. The range covers (field, term, record), so a term that a third of all
records hold spreads over many partitions; each adds one partial row for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import folded, valid_rows

#: Marks: a term that fewer records hold is rare, one that a larger part of all records holds is common.
RARE_RECORDS, COMMON_SHARE = 3, 0.05


def label_terms(labels: DataFrame) -> DataFrame:
    """(id, terms array<struct<field, term>>) of valid labels; a term may repeat within a label.

    Null or blank type and scope give no term, the label still counts as a record.
    """
    kind = F.regexp_replace(F.regexp_replace(folded("type"), r"!+$", ""), r"[\s\p{Z}\p{Cc}\p{Cf}]+$", "")
    parts = F.transform(F.split(F.coalesce(F.col("scope"), F.lit("")), "[,/+]"), folded)
    terms = F.concat(
        F.array(F.struct(F.lit("type").alias("field"), F.coalesce(kind, F.lit("")).alias("term"))),
        F.transform(parts, lambda p: F.struct(F.lit("scope").alias("field"), p.alias("term"))),
    )
    return valid_rows(labels, "id", "type", "scope").select("id", F.filter(terms, lambda t: t["term"] != "").alias("terms"))


def term_frequency(records: DataFrame, key: str = "id", terms: str = "terms") -> DataFrame:
    """(field, term, occurrences, records) for every distinct term.

    records: one row per record and its array of (field, term). Occurrences within a record are
    added up before anything is shuffled. Null arrays hold no terms; an empty table gives no rows.
    """
    own = F.array_distinct(F.col(terms))
    pairs = records.select(
        F.col(key).alias("_record"),
        F.explode(
            F.transform(own, lambda t: F.struct(t["field"].alias("field"), t["term"].alias("term"), F.size(F.filter(F.col(terms), lambda x: x == t)).cast("long").alias("n")))
        ).alias("_t"),
    ).select("_t.field", "_t.term", "_record", "_t.n")
    runs = pairs.repartitionByRange("field", "term", "_record").sortWithinPartitions("field", "term", "_record")
    # max() of a string can't be kept in a hash map's fixed rows, so Spark scans the sorted runs here, without another exchange or sort.
    per_record = runs.groupBy("field", "term", "_record").agg(F.sum("n").alias("n"), F.max("term").alias("_scan"))
    return per_record.groupBy("field", "term").agg(F.sum("n").alias("occurrences"), F.count("_scan").alias("records"))


def marked_terms(frequency: DataFrame, total: DataFrame, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """Adds mark: rare, common, or useful. total: one row with n, the number of all records."""
    mark = F.when(F.col("records") < rare, "rare").when(F.col("records") > F.col("n") * common, "common").otherwise("useful")
    return frequency.crossJoin(F.broadcast(total)).select("field", "term", "occurrences", "records", mark.alias("mark"))


def label_term_marks(labels: DataFrame) -> DataFrame:
    total = labels.where(F.col("id").isNotNull()).groupBy("id").agg(F.lit(1).alias("x")).agg(F.count("x").alias("n"))
    return marked_terms(term_frequency(label_terms(labels)), total)
