"""Vocabulary, coverage, sequence plans and accounting over token streams.

Token arrays stay per record; corpus counts go through explode and a combined group count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tokens import SPECIAL, decision


def exploded(records: DataFrame, tokens: str, *columns: str) -> DataFrame:
    """(columns, token). Outer and then filtered: an inner explode computes its array again in an inferred filter."""
    return records.select(*columns, F.explode_outer(tokens).alias("token")).where("token is not null")


def token_counts(records: DataFrame, tokens: str = "tokens") -> DataFrame:
    return exploded(records, tokens).groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def build(counts: DataFrame, size: int = 32_000, least: int = 2) -> DataFrame:
    """(id, token, count): the special tokens, then the most frequent ones, ties by token; `size` in all.

    The ids come from ranking at most `size` rows, which is the vocabulary's bound.
    """
    spark = counts.sparkSession
    best = counts.where(~F.col("token").isin(SPECIAL) & (F.col("count") >= least)).orderBy(F.desc("count"), "token").limit(max(0, size - len(SPECIAL)))
    ranked = best.withColumn("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), "token")) - 1 + len(SPECIAL))
    known = spark.createDataFrame(list(enumerate(SPECIAL)), "id int, token string").join(counts, "token", "left").select("id", "token", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))
    return known.unionByName(ranked.select("id", "token", "count"))


def coverage(records: DataFrame, vocabulary: DataFrame, split: str = "data_split", tokens: str = "tokens") -> DataFrame:
    """(split, records, tokens, known, unknown, known_fraction). Counts per split and token before the join."""
    sizes = records.groupBy(split).agg(F.count(F.lit(1)).alias("records"))
    per = exploded(records, tokens, split).groupBy(split, "token").agg(F.count(F.lit(1)).alias("n"))
    hit = per.join(vocabulary.select("token", "id"), "token", "left").groupBy(split).agg(F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n"))), F.lit(0)).alias("known"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    out = sizes.join(hit, split, "left").select(split, "records", zero("tokens").alias("tokens"), zero("known").alias("known"))
    return out.withColumn("unknown", F.col("tokens") - F.col("known")).withColumn("known_fraction", F.coalesce(F.round(F.try_divide("known", "tokens"), 6), F.lit(0.0)))


def encode(records: DataFrame, vocabulary: DataFrame, key: str, tokens: str = "tokens", unknown: int = 1) -> DataFrame:
    """records with ids and unknown_tokens: token -> id, `unknown` for tokens outside the vocabulary.

    The vocabulary has a bound (its size), so AQE may broadcast it; positions are put back per record.
    """
    each = records.select(key, F.posexplode(tokens).alias("pos", "token"))
    known = vocabulary.select("token", F.col("id").alias("_v"))
    ids = each.join(known, "token", "left").groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_v", F.lit(unknown)).alias("v")))), lambda x: x["v"]).alias("ids"), F.count_if(F.col("_v").isNull()).alias("unknown_tokens")
    )
    return records.join(ids, key, "left")


def plan(records: DataFrame, context: int, most: int, tokens: str = "tokens") -> DataFrame:
    """records with raw_token_count, raw_sequences_at_context, decision, reason, trainer_context_tokens and trainer_tokens."""
    n = F.size(tokens).cast("bigint")
    d = records.withColumn("raw_token_count", n).withColumn("raw_sequences_at_context", F.ceil(n / context)).withColumn("decision", decision(n, context, most))
    kept = F.when(F.col("decision") == "exclude_oversize", 0).when(F.col("decision") == "use_truncated", context).otherwise(n)
    # fixed values: the reasons of the decisions
    reason = F.when(F.col("decision") == "exclude_oversize", "raw_token_count exceeds max_raw_record_tokens").when(F.col("decision") == "use_truncated", "raw_token_count exceeds context_tokens").otherwise("raw_token_count fits context_tokens")
    return d.withColumns({"reason": reason, "trainer_context_tokens": F.lit(context).cast("bigint"), "trainer_tokens": kept.cast("bigint")})


def with_unknown(records: DataFrame, vocabulary: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """records with unknown_token_count: their tokens outside the vocabulary. A record's equal tokens are counted before the join."""
    per = exploded(records, tokens, key).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    lost = per.join(vocabulary.select("token"), "token", "left_anti").groupBy(key).agg(F.sum("n").alias("unknown_token_count"))
    return records.join(lost, key, "left").withColumn("unknown_token_count", F.coalesce("unknown_token_count", F.lit(0).cast("bigint")))


def accounting(plans: DataFrame, split: str = "data_split", splits: tuple[str, ...] = ("DEV", "REPORT", "HELD_OUT")) -> DataFrame:
    """Per split and over all (null): records, raw and kept tokens, the longest record, full, truncated and excluded ones, tokens cut off.

    Splits without a record have a row of zeros. The totals are sums of the splits' rows.
    """
    kinds = ("use_full", "use_truncated", "exclude_oversize")
    own = lambda d, c: F.coalesce(F.sum(F.when(F.col("decision") == d, c)), F.lit(0))
    per = plans.groupBy(split).agg(
        F.count(F.lit(1)).alias("records"), F.sum("raw_token_count").alias("raw_tokens"), F.sum("trainer_tokens").alias("kept_tokens"), F.max("raw_token_count").alias("longest"), *[F.count_if(F.col("decision") == d).alias(d) for d in kinds],
        own("use_truncated", F.col("raw_token_count") - F.col("trainer_tokens")).alias("truncated_tokens"), own("exclude_oversize", F.col("raw_token_count")).alias("excluded_tokens"),
    )
    numbers = [c for c in per.columns if c != split]
    seeds = plans.sparkSession.createDataFrame([(s,) for s in splits], f"{split} string").join(per.select(split), split, "left_anti").select(split, *[F.lit(0).cast("bigint").alias(c) for c in numbers])
    every = per.agg(*[(F.max if c == "longest" else F.sum)(c).alias(c) for c in numbers]).select(F.lit(None).cast("string").alias(split), *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers])
    return per.unionByName(seeds).unionByName(every)


def blockers(accounts: DataFrame, least_train: int, train: str = "DEV", evaluation: str = "REPORT", split: str = "data_split") -> DataFrame:
    """(split, kept, excluded, blocker) of accounting() rows that stop a run: records excluded from evaluation, too few kept for training."""
    kept = F.col("records") - F.col("exclude_oversize")
    why = F.when((F.col(split) == evaluation) & (F.col("exclude_oversize") > 0), F.lit(f"{evaluation} contains excluded oversize records")).when((F.col(split) == train) & (kept < least_train), F.lit(f"kept {train} records fall below minimum"))
    return accounts.withColumn("blocker", why).where("blocker is not null").select(split, kept.alias("kept"), F.col("exclude_oversize").alias("excluded"), "blocker")
