"""Problem 7: records into sequences of fixed capacity, by deficit round-robin over source queues.

Records of a group are spread over blocks of bounded size by hash. In a block every source is a
queue with a deficit: each new sequence adds its target share of the capacity. The source that lacks
most opens the sequence with its longest record; then, until nothing fits, the source that lacks most
of those that still have one gives its longest record that fits. A record may put its source in
debt, which carries over from sequence to sequence.
Sequences that stay below FULL are opened again: their records and the block's deficits go to a
second round of blocks over the whole group.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import folded, repo_key, split_name, valid_rows
from quern.session import materialize

BLOCK, FULL = 20_000, 0.99

GROUP = ["materialization_id", "data_split", "capacity"]
ITEM = "materialization_id string, data_split string, capacity bigint, block bigint, sequence bigint, open boolean, record_id string, first_piece bigint, length bigint, source string, share double, deficit double"


def fill(queues: dict[str, list[tuple[int, int]]], share: dict[str, float], capacity: int, owed: dict[str, float]) -> list[list[int]]:
    """Sequences as lists of item numbers. queues: per source (length, number), ascending; emptied. owed: deficits, updated."""
    out: list[list[int]] = []
    live = sorted(s for s in queues if queues[s])
    for s in share:
        owed.setdefault(s, 0.0)
    while live:
        weight = sum(share.get(s, 0.0) for s in live) or 1.0
        for s in live:
            owed[s] += capacity * share.get(s, 0.0) / weight
        room, taken = capacity, []
        opener = max(live, key=lambda s: (owed[s], queues[s][-1][0]))
        while opener is not None:
            q = queues[opener]
            length, number = q.pop(bisect_right(q, (room, 1 << 62)) - 1)
            room -= length
            owed[opener] -= length
            taken.append(number)
            opener, most = None, 0.0
            for s in live:  # then the source that lacks most gives its longest record that fits
                if queues[s] and queues[s][0][0] <= room and (opener is None or owed[s] > most):
                    opener, most = s, owed[s]
        out.append(taken)
        live = [s for s in live if queues[s]]
    return out


def _packer(reopen: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["record_id", "first_piece"], na_position="first", kind="stable").reset_index(drop=True)
        credit = pdf["record_id"].isna()
        owed = pdf[credit].groupby("source")["deficit"].sum().to_dict()
        items = pdf[~credit].reset_index(drop=True)
        if items.empty:
            return items
        capacity = int(items["capacity"].iloc[0])
        share = items.groupby("source")["share"].first().to_dict()
        lengths, sources = items["length"].tolist(), items["source"].tolist()
        queues: dict[str, list[tuple[int, int]]] = {}
        for i, (n, s) in enumerate(zip(lengths, sources, strict=True)):
            queues.setdefault(s, []).append((n, i))
        for q in queues.values():
            q.sort()
        done = fill(queues, share, capacity, owed)
        at, is_open = [0] * len(items), [False] * len(items)
        for k, taken in enumerate(done):
            low = reopen and sum(lengths[i] for i in taken) < FULL * capacity
            for i in taken:
                at[i], is_open[i] = k, low
        items["sequence"], items["open"] = at, is_open
        if reopen and any(is_open):
            first = items.iloc[[0] * len(owed)].copy()
            first["record_id"], first["first_piece"], first["length"], first["open"] = None, None, None, True
            first["source"], first["deficit"] = list(owed), [float(v) for v in owed.values()]
            items = pd.concat([items, first], ignore_index=True)
        return items

    return pack


def _blocks(items: DataFrame) -> DataFrame:
    """items with block: as many blocks per group as its rows need."""
    sizes = items.groupBy(*GROUP).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    spread = F.pmod(F.xxhash64(F.coalesce("record_id", "source"), "first_piece"), F.col("_blocks")).cast("bigint")
    return items.join(sizes, GROUP).withColumn("block", spread).drop("_blocks")


def pack(records: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(group columns, sequence, record_id, first_piece, pieces, length, source) of all records.

    records: group columns, record_id, length, source. Rows whose length or capacity is null or not
    positive can't be packed and are left out. Only a record longer than a whole sequence is
    divided: its full pieces, one row with their number, fill a sequence each, and the rest is packed
    like a short record. Equal records are packed each. targets: group columns, source, share; without
    it a source's share of the group's tokens holds. A null source is the source ''.
    """
    ok = records.where("length > 0 and capacity > 0 and record_id is not null").withColumn("source", F.coalesce("source", F.lit("")))
    if targets is None:
        tokens = ok.groupBy(*GROUP, "source").agg(F.sum("length").alias("t"))
        whole = tokens.groupBy(*GROUP).agg(F.sum("t").alias("all"))
        targets = tokens.join(whole, GROUP).select(*GROUP, "source", (F.col("t") / F.col("all")).alias("share"))
    full = F.floor(F.col("length") / F.col("capacity")).cast("bigint")
    rest = F.col("length") % F.col("capacity")
    wholes = ok.where(full > 0).select(*GROUP, F.concat(F.lit("w:"), "record_id").alias("sequence"), "record_id", F.lit(0).cast("bigint").alias("first_piece"), full.alias("pieces"), "capacity", "source")
    wholes = wholes.select(*GROUP, "sequence", "record_id", "first_piece", "pieces", F.col("capacity").alias("length"), "source")
    short = ok.where(rest > 0).select(*GROUP, "record_id", full.alias("first_piece"), rest.cast("bigint").alias("length"), "source")
    short = short.join(targets, [*GROUP, "source"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    blank = {"sequence": F.lit(0).cast("bigint"), "open": F.lit(False), "deficit": F.lit(0.0)}
    fields = [f.split()[0] for f in ITEM.split(", ")]

    def packed(items: DataFrame, reopen: bool) -> DataFrame:
        rows = _blocks(items).withColumns(blank | ({} if reopen else {"deficit": F.col("deficit")})).select(*fields)
        return rows.groupBy(*GROUP, "block").applyInPandas(_packer(reopen), ITEM)

    first = materialize(packed(materialize(short.withColumn("deficit", F.lit(0.0)), "items"), True), "packed")
    # a row of deficits follows its block's open records into some block of the second round
    second = packed(first.where("open").drop("block", "sequence", "open"), False)
    name = lambda df, level: df.select(*GROUP, F.concat_ws(":", F.lit(level), "block", "sequence").alias("sequence"), "record_id", "first_piece", F.lit(1).cast("bigint").alias("pieces"), "length", "source")
    return wholes.unionByName(name(first.where("not open"), "a")).unionByName(name(second, "b"))


def sequence_records(meta: DataFrame, runs: DataFrame, labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """The valid rows of sequence_metadata as records; source is the ecosystem of the label's repository.

    context_tokens that is missing or not positive comes from the run; splits that are unknown are ''.
    """
    own = F.when(F.col("context_tokens") > 0, F.col("context_tokens"))
    rows = valid_rows(meta.select("record_id", "_ord", "materialization_id", split_name("data_split").alias("data_split"), own.alias("own"), "input_length", "source_diff_id"), "record_id", "materialization_id", "data_split", "own", "input_length", "source_diff_id")
    run = runs.where("context_tokens > 0").groupBy("materialization_id").agg(F.max("context_tokens").alias("run"))
    rows = rows.join(run, "materialization_id", "left")
    repo = valid_rows(labels.select("id", "_ord", repo_key("source_repo_url").alias("repo")), "id", "repo").select(F.regexp_replace("id", "^generated-", "").alias("source_diff_id"), "repo")
    eco = valid_rows(manifest.select(repo_key("repo_url").alias("repo"), folded("ecosystem").alias("ecosystem"), "_ord"), "repo", "ecosystem")
    rows = rows.join(repo, "source_diff_id", "left").join(eco, "repo", "left")
    return rows.select(F.coalesce("materialization_id", F.lit("")).alias("materialization_id"), F.coalesce("data_split", F.lit("")).alias("data_split"), F.coalesce("own", "run").alias("capacity"), "record_id", F.col("input_length").alias("length"), F.coalesce("ecosystem", F.lit("")).alias("source"))


def divided(packed: DataFrame) -> DataFrame:
    """(record_id) of records in more than one piece."""
    return packed.groupBy("record_id").agg(F.sum("pieces").alias("n")).where("n > 1").select("record_id")


def report(packed: DataFrame) -> DataFrame:
    """Per group: sequences, tokens, the part of their room that is used, and the fewest sequences possible."""
    many = packed.groupBy(*GROUP, "sequence").agg(F.max("pieces").alias("k"), F.sum(F.col("pieces") * F.col("length")).alias("t"))
    out = many.groupBy(*GROUP).agg(F.sum("k").alias("sequences"), F.sum("t").alias("tokens"))
    return out.withColumn("used", F.round(F.col("tokens") / F.col("sequences") / F.col("capacity"), 6)).withColumn("fewest", F.ceil(F.col("tokens") / F.col("capacity")))


def mixture(packed: DataFrame) -> DataFrame:
    """(group columns, source, share, tokens, sequences, distance).

    share: the source's part of the group's tokens in undivided sequences; sequences: those that hold
    the source; distance: the mean over the group's sequences of the total variation between a
    sequence's mixture and the group's, the same for all sources of a group. Sequences of a divided
    record's full pieces hold one source by need and don't count.
    """
    own = packed.where(~F.startswith("sequence", F.lit("w:")))
    per = own.groupBy(*GROUP, "sequence", "source").agg(F.sum("length").alias("t"))
    inside = per.groupBy(*GROUP, "sequence").agg(F.sum("t").alias("whole"), F.collect_list(F.struct("source", "t")).alias("parts"))
    tokens = per.groupBy(*GROUP, "source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("sequences"))
    goal = tokens.groupBy(*GROUP).agg(F.sum("tokens").alias("all"), F.map_from_entries(F.collect_list(F.struct("source", "tokens"))).alias("goal"))
    # |a - b| / 2 over all sources = the sum over the sequence's own sources of what exceeds the goal
    over = F.aggregate("parts", F.lit(0.0), lambda a, x: a + F.greatest(x["t"] / F.col("whole") - F.element_at("goal", x["source"]) / F.col("all"), F.lit(0.0)))
    far = inside.join(goal, GROUP).groupBy(*GROUP).agg(F.avg(over).alias("distance"), F.max("all").alias("all"))
    return tokens.join(far, GROUP).select(*GROUP, "source", F.round(F.col("tokens") / F.col("all"), 6).alias("share"), "tokens", "sequences", F.round("distance", 6).alias("distance"))
