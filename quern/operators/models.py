"""Small deterministic models over changed paths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.commits import TYPES
from quern.functions.paths import is_docs, is_tests, tokens, topic
from quern.functions.tokens import hashed_bucket

# Subject patterns by type; {} is the topic.
SUBJECTS = {"docs": "update {} documentation", "test": "update {} tests", "fix": "handle {} behavior", "feat": "add {} support", "perf": "improve {} performance", "refactor": "update {} implementation"}
SUBJECTS_SOFTMAX = SUBJECTS | {"test": "cover {} behavior", "build": "update {} build", "ci": "update {} automation", "style": "format {} code", "revert": "revert {} change"}
DEFAULT_SUBJECT = "update {} maintenance"


def subject(kind: Column, about: Column, table: dict[str, str] = SUBJECTS) -> Column:
    fill = lambda t: F.concat(F.lit(t.split("{}")[0]), about, F.lit(t.split("{}")[1]))
    out = None
    for k, t in table.items():
        out = F.when(kind == k, fill(t)) if out is None else out.when(kind == k, fill(t))
    return out.otherwise(fill(DEFAULT_SUBJECT))


def train_path_types(rows: DataFrame, paths: str = "changed_paths", kind: str = "type") -> DataFrame:
    """(token, type, n): how often a path token goes with a type, repeats counted; token null has the types' own counts."""
    pairs = rows.select(F.explode_outer(tokens(F.col(paths))).alias("token"), F.col(kind).alias("type")).where("token is not null").groupBy("token", "type").agg(F.count(F.lit(1)).alias("n"))
    own = rows.groupBy(F.col(kind).alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("token"), "type", "n")
    return pairs.unionByName(own)


def predict_path_types(rows: DataFrame, model: DataFrame, key: str, paths: str = "changed_paths") -> DataFrame:
    """(key, predicted, subject): the type with the highest sum over the row's tokens; priors where no token is known.

    Paths of documentation add 3 to docs, of tests 2 to test. Ties go to the type whose token comes
    first, then to the name. Types outside the known ones become chore.
    """
    d = rows.select(key, F.col(paths).alias("_p")).withColumn("_t", tokens(F.col("_p")))
    # a token has one row with its counts of all types, and a row's equal tokens are one row before the join
    types = [r["type"] for r in model.where("token is null").select("type").orderBy("type").collect()]  # a row per type
    if not types:
        return d.limit(0).select(key, F.lit("").alias("predicted"), F.lit("").alias("subject"))
    counts = model.where("token is not null").groupBy("token").agg(*[F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, t in enumerate(types)])
    priors = model.where("token is null").agg(*[F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, t in enumerate(types)]).first()
    each = d.select(key, F.posexplode("_t").alias("pos", "token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("m"), F.min("pos").alias("pos"))
    sums = each.join(counts, "token").groupBy(key).agg(*[F.sum(F.col("m") * F.col(f"n{i}")).alias(f"s{i}") for i in range(len(types))], *[F.min(F.when(F.col(f"n{i}") > 0, F.col("pos"))).alias(f"p{i}") for i in range(len(types))])
    j = d.join(sums, key, "left")
    known = F.col("s0").isNotNull()
    none_p = F.coalesce("_p", F.array().cast("array<string>"))
    bonus = {"docs": F.when(F.exists(none_p, is_docs), 3).otherwise(0), "test": F.when(F.exists(none_p, is_tests), 2).otherwise(0)}
    late = 1 << 30
    options = []
    for i, t in enumerate(types):
        own = F.when(known, F.col(f"s{i}")).otherwise(F.lit(priors[f"n{i}"]))
        at = F.when(known, F.coalesce(F.col(f"p{i}"), F.lit(late))).otherwise(F.lit(0))
        score = own + bonus.get(t, F.lit(0))
        options.append(F.when(score > 0, F.struct((-score).cast("bigint").alias("a"), at.alias("b"), F.lit(t).alias("type"))))
    options += [F.when(b > 0, F.struct((-b).cast("bigint").alias("a"), F.lit(late).alias("b"), F.lit(t).alias("type"))) for t, b in bonus.items() if t not in types]
    best = F.array_min(F.array_compact(F.array(*options)))["type"]
    out = j.withColumn("_w", best).where("_w is not null")
    named = F.when(F.col("_w").isin(TYPES), F.col("_w")).otherwise("chore")
    return out.select(key, named.alias("predicted"), subject(named, topic(F.col("_t"))).alias("subject"))


def features(rows: DataFrame, key: str, paths: str = "changed_paths") -> DataFrame:
    """(key, feature, value): bias, top folder, extension, path tokens and flags, scaled to a sum of 1 per row."""
    none = F.array().cast("array<string>")
    p = F.transform(F.coalesce(paths, none), lambda x: F.regexp_replace(F.lower(F.replace(x, F.lit("\\"), F.lit("/"))), "^/+|/+$", ""))
    name = lambda x: F.substring_index(x, "/", -1)
    tag = lambda prefix, arr: F.transform(arr, lambda x: F.concat(F.lit(prefix), x))
    d = rows.select(key, F.col(paths).alias("_raw"), p.alias("_p"))
    own = F.coalesce("_raw", none)
    every = F.concat(
        F.array(F.lit("bias")),
        tag("topdir:", F.transform("_p", lambda x: F.substring_index(x, "/", 1))),
        tag("ext:", F.transform(F.filter("_p", lambda x: F.contains(name(x), F.lit("."))), lambda x: F.substring_index(name(x), ".", -1))),
        tag("path:", tokens(F.col("_raw"))),
        F.array_compact(F.array(F.when(F.exists(own, is_docs), "flag:docs"), F.when(F.exists(own, is_tests), "flag:tests"))),
    )
    d = d.select(key, every.alias("f")).withColumn("total", F.size("f"))
    return d.select(key, "total", F.explode("f").alias("feature")).groupBy(key, "feature").agg((F.count(F.lit(1)) / F.first("total")).alias("value"))


def train_softmax(rows: DataFrame, key: str, kind: str, paths: str = "changed_paths", epochs: int = 25, rate: float = 0.35, l2: float = 1e-4, limit: int = 200_000) -> DataFrame:
    """(feature, weights array<double> in the order of TYPES): sequential gradient steps over rows sorted by key.

    Each step depends on the one before, so the fold runs in one task, on hashes of features instead
    of their names. `limit` bounds its rows: of more, those with the smallest hashes of their keys
    are taken, a fixed sample. The feature "" holds the biases, "loss" the mean loss of every epoch.
    """
    rows = rows.orderBy(F.xxhash64(key), key).limit(limit)
    f = features(rows, key, paths).withColumn("h", F.xxhash64("feature"))
    packed = f.groupBy(key).agg(F.collect_list("h").alias("h"), F.collect_list("value").alias("v")).join(rows.select(key, F.col(kind).alias("_kind")), key)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        ids, at = np.unique(np.concatenate(pdf["h"].tolist()), return_inverse=True)
        ends = np.cumsum([len(x) for x in pdf["h"]])
        data = [(at[e - len(v) : e], np.asarray(v), TYPES.index(k)) for e, v, k in zip(ends, pdf["v"], pdf["_kind"], strict=True)]
        w, bias, history = np.zeros((len(ids), len(TYPES))), np.zeros(len(TYPES)), []
        for _ in range(epochs):
            loss = 0.0
            for own, value, target in data:
                logits = bias + value @ w[own]
                p = np.exp(logits - logits.max())
                p /= p.sum()
                loss -= math.log(max(p[target], 1e-12))
                p[target] -= 1.0
                bias -= rate * p
                w[own] -= rate * (value[:, None] * p + l2 * w[own])
            history.append(loss / max(1, len(data)))
        hashes = pd.array([None, None, *ids.tolist()], dtype="Int64")  # a plain list would become floats
        return pd.DataFrame({"h": hashes, "special": ["", "loss", *[None] * len(ids)], "weights": [bias.tolist(), history, *w.tolist()]})

    out = packed.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(fold, "h bigint, special string, weights array<double>")
    names = f.select("h", "feature").distinct()
    return out.join(names, "h", "left").select(F.coalesce("special", "feature").alias("feature"), "weights")


def predict_softmax(rows: DataFrame, model: DataFrame, key: str, paths: str = "changed_paths") -> DataFrame:
    """(key, predicted, probability): the class with the highest logit, the lowest number on ties.

    A row per feature holds all classes: their weighted sums are added up as arrays.
    """
    f = features(rows, key, paths)
    bias = model.where("feature = ''").select(F.col("weights").alias("bias"))
    scaled = f.join(model.where("feature <> 'loss'"), "feature").select(key, *[(F.get("weights", F.lit(c)) * F.col("value")).alias(f"x{c}") for c in range(len(TYPES))])
    dot = scaled.groupBy(key).agg(F.array(*[F.sum(f"x{c}") for c in range(len(TYPES))]).alias("x"))
    logits = dot.crossJoin(F.broadcast(bias)).select(key, F.zip_with("x", "bias", lambda x, b: x + b).alias("all"))  # one row of biases
    top = F.array_max("all")
    at = F.array_position("all", top).cast("int")
    total = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return logits.select(key, F.element_at(F.array(*map(F.lit, TYPES)), at).alias("predicted"), (1 / total).alias("probability"))


def train_margin(sequences: DataFrame, buckets: int, rate: int = 1, scale: int = 1000, start: DataFrame | None = None) -> DataFrame:
    """(bucket, weight, loss, steps, tokens): integer hinge updates in the order of rows and positions.

    sequences: _ord, ids, loss_mask. A step touches one bucket only, so every bucket is folded by
    itself over its sorted steps; start (bucket, weight) resumes from earlier weights.
    """
    steps = sequences.select("_ord", "ids", F.posexplode("loss_mask").alias("pos", "on")).where("on = 1")
    previous = F.when(F.col("pos") > 0, F.get("ids", F.col("pos") - 1)).otherwise(0)
    target = F.get("ids", F.col("pos"))
    steps = steps.select("_ord", "pos", hashed_bucket(previous, target, F.col("pos"), buckets).alias("bucket"), F.when(target % 2 != 0, 1).otherwise(-1).alias("sign"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_ord", "pos"])
        w, loss, n = int(pdf["weight"].iloc[0]), 0, 0
        for sign in pdf["sign"].tolist():
            short = scale - sign * w
            if short > 0:
                loss += short
                w += rate * sign
                n += 1
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "weight": [w], "loss": [loss], "steps": [n], "tokens": [len(pdf)]})

    if start is not None:
        steps = steps.join(start.select("bucket", "weight"), "bucket", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("bigint")))
    else:
        steps = steps.withColumn("weight", F.lit(0).cast("bigint"))
    return steps.groupBy("bucket").applyInPandas(fold, "bucket int, weight bigint, loss bigint, steps bigint, tokens bigint")
