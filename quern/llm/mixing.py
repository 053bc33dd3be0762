"""Problem 9: drawing documents so that every source has its share of all tokens.

Sizes are exact counts of a public byte-level tokenizer. Each source's documents, shuffled by hash
and read again up to max_repeats times, are one stream, which is cut at exactly the source's share
of the total: the documents whose middle lies before the cut are drawn, so a source misses its share
by half a document at most. Slot i of the mix takes point i of the golden-ratio sequence, which
spreads evenly at every length, and the cumulative weights map it to a source. The slots of a
source, ranked, take equal-token blocks of its stream in turn, whatever their number.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import folded
from quern.session import materialize

GOLDEN = 0.6180339887498949
#: Tokens of a slot at most, slots of the smallest source at least; slots that are ranked together; cells that index the sources.
SLOT_TOKENS, LEAST_SLOTS, CHUNK, CELLS = 8192, 16, 1 << 16, 4096


def default_ranks() -> str:
    """The path of the rank file that is used where none is named."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def exact_counter(ranks: str | None = None):
    """A column function: text -> exact number of tokens (bigint) of a byte-level vocabulary; null and empty texts have 0."""
    import public_tokenizers

    with open(ranks or default_ranks(), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for part in texts:
            yield part.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count


def _ordered(docs: DataFrame, rows: int) -> DataFrame:
    """docs with start: the tokens before the document in its source, in the order of hashes.

    Sums of hash ranges first, then sums within a range; a range holds some 50,000 rows at most.
    """
    bits = max(4, (rows // 50_000).bit_length())
    d = docs.withColumn("_h", F.xxhash64("doc_id", F.lit(9))).withColumn("_r", F.shiftright("_h", 64 - bits))
    sums = d.groupBy("source", "_r").agg(F.sum("tokens").alias("s"))
    before = sums.withColumn("_before", F.sum("s").over(Window.partitionBy("source").orderBy("_r")) - F.col("s")).drop("s")
    own = F.sum("tokens").over(Window.partitionBy("source", "_r").orderBy("_h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    return d.withColumn("_own", own).join(before, ["source", "_r"]).withColumn("start", F.col("_own") + F.col("_before")).drop("_own", "_before", "_r", "_h")


def source_plan(have: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, have, most, want, lo, hi): tokens wanted of each source, and its stretch of the unit interval.

    have: source, have. One row per source with a target; total: tokens to draw, by default as many
    as the targets and max_repeats allow at the exact shares.
    """
    plan = have.join(targets, "source")
    whole = plan.agg(F.sum("share").alias("whole"), F.min(F.col("have") * F.col("most") / F.col("share")).alias("room"))
    share = F.col("share") / F.col("whole")
    most = F.col("room") * F.col("whole") if total is None else F.lit(float(total))
    sized = plan.crossJoin(F.broadcast(whole)).select("source", "have", "most", "share", share.alias("part"), F.least(share * most, (F.col("have") * F.col("most")).cast("double")).alias("want"))
    upto = F.sum("part").over(Window.partitionBy(F.lit(0)).orderBy("source").rowsBetween(Window.unboundedPreceding, 0))  # a row per target
    return sized.withColumn("hi", upto).select("source", "have", "most", "want", (F.col("hi") - F.col("part")).alias("lo"), F.when(F.col("hi") > 1 - 1e-9, 1.0).otherwise(F.col("hi")).alias("hi"))


def _slots(spark, slots: int, plan: DataFrame) -> DataFrame:
    """(slot, source, rank): the sources of the golden-ratio points, and the place of a slot among its source's."""
    cell = lambda c: F.floor(c * CELLS).cast("int")
    last = F.least(cell(F.col("hi")), F.lit(CELLS - 1))
    # the sources of a cell are few: a point looks at those of its own cell only
    cells = plan.select("source", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), F.greatest(cell(F.col("lo")), last))).alias("_cell"))
    u = (F.col("id") + 1) * F.lit(GOLDEN) % 1.0
    points = spark.range(slots).select(F.col("id").alias("slot"), u.alias("_u")).withColumn("_cell", cell(F.col("_u")))
    drawn = points.join(cells, "_cell").where("_u >= lo and _u < hi").select("slot", "source", F.floor(F.col("slot") / CHUNK).alias("_c"))
    drawn = drawn.withColumn("_own", F.row_number().over(Window.partitionBy("source", "_c").orderBy("slot")) - 1)
    counts = drawn.groupBy("source", "_c").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("source").orderBy("_c")) - F.col("n")).drop("n")
    return drawn.join(before, ["source", "_c"]).select("slot", "source", (F.col("_own") + F.col("_before")).alias("rank"))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, size: Column | None = None, slot_tokens: int = SLOT_TOKENS, ranks: str | None = None) -> DataFrame:
    """(slot, source, repeat, doc_id, tokens), in the order of slots.

    total: tokens to draw; by default as many as the targets and max_repeats allow at these exact
    shares. size: a document's tokens, by default counted exactly with the rank file `ranks`. Documents without a source, of a
    source without a target, or without tokens are never drawn, and the first two kinds aren't
    tokenised; a source with a target but no documents leaves its share to the others. Of repeated
    targets the largest share holds; a missing max_repeats is 1. A slot that lies within a long
    document is empty.
    """
    spark = documents.sparkSession
    goal = targets.select(folded("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most")).where("source is not null and share > 0 and most > 0")
    goal = goal.groupBy("source").agg(F.max_by(F.struct("share", "most"), "share").alias("g")).select("source", "g.share", "g.most")
    named = documents.where("doc_id is not null").select("doc_id", folded("source").alias("source"), *([size.alias("tokens")] if size is not None else ["text"]))
    named = named.join(goal.select("source"), "source", "left_semi")
    if size is None:
        named = named.select("doc_id", "source", exact_counter(ranks)("text").alias("tokens"))
    # written before it is filtered: a filter on the count would count twice
    docs = materialize(named, "tokens").where("tokens > 0")
    have = docs.groupBy("source").agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("rows"))
    plan = materialize(source_plan(have.drop("rows"), goal, total), "plan")
    sums = plan.agg(F.sum("want").alias("want"), F.min(F.col("hi") - F.col("lo")).alias("part")).crossJoin(have.agg(F.sum("rows").alias("rows"))).first()
    slots = math.ceil(max((sums["want"] or 0) / slot_tokens, LEAST_SLOTS / (sums["part"] or 1.0)))
    drawn = materialize(_slots(spark, slots, plan), "slots")
    per = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("slots"))
    facts = plan.join(per, "source", "left").select("source", "have", "most", "want", F.coalesce("slots", F.lit(0)).alias("slots"))

    passes = F.least(F.ceil(F.col("want") / F.col("have")), F.col("most")).cast("int")
    stream = _ordered(docs, sums["rows"] or 0).join(facts, "source").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1)))
    at = F.col("repeat") * F.col("have") + F.col("start")
    stream = stream.where((at + F.col("tokens") / 2 <= F.col("want")) & (F.col("slots") > 0))
    rank = F.least(F.floor(at * F.col("slots") / F.col("want")), F.col("slots") - 1)
    placed = stream.select("source", rank.alias("rank"), F.col("repeat").cast("bigint").alias("repeat"), "doc_id", "tokens")
    return drawn.join(placed, ["source", "rank"]).select("slot", "source", "repeat", "doc_id", "tokens")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, documents, tokens, repeats): what the mix reached, a row per target."""
    per = drawn.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    got = per.groupBy("source").agg(F.sum("n").alias("documents"), F.sum("t").alias("tokens"), F.max("n").alias("repeats"))
    got = got.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    goal = targets.groupBy(folded("source").alias("source")).agg(F.max("target_share").alias("target_share"))
    zero = F.lit(0).cast("bigint")
    return goal.join(got, "source", "left").select("source", "target_share", F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"), F.coalesce("documents", zero).alias("documents"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("repeats", zero).alias("repeats"))
