"""Connected components by frontier search, and splits that keep components together (problem 4).

Components: every vertex whose hash is smaller than its neighbours' is a seed. All seeds expand at
once; a vertex takes the smallest label that reaches it first and is never visited again. The
frontier is what the last step reached, and only its edges are followed. Where two labels meet, an
edge between labels remains; these edges are a graph of at most half the vertices, which is solved
the same way, until none is left. Every vertex has a path of falling hashes to a seed, so a level
ends after a few steps; nothing is ever collected.

Splits: all components of a plan lie on a circle in the order of their hashes, each with an arc of
its weight, and the splits are consecutive stretches of the circle, as long as their shares. A
component goes where the middle of its arc lies. Which hash gives the order and where the stretches
begin is free: of SEEDS hashes and TURNS fixed starting points those whose shares come closest hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import repo_key, split_name, valid_rows
from quern.session import materialize

#: Hashes tried, starting points tried on each one's circle, hash ranges per plan within which running sums are taken.
SEEDS, TURNS, RANGES = 32, 100, 1024
#: Steps of the search between two tables written.
STEPS = 2


def _rank(c: str) -> Column:
    return F.struct(F.xxhash64(c), F.col(c))


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of the undirected edges (a, b): component is some vertex of it.

    Edges with a null end are ignored, loops name a vertex, repeated edges don't matter. A hub's
    edges are combined before each shuffle; the join onto them is left to adaptive skew splitting.
    """
    e = edges.where("a is not null and b is not null").select("a", "b").distinct()
    both = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    found = _level(both)
    return found if found is not None else both.select(F.col("a").alias("vertex"), F.col("a").alias("component"))


def _level(both: DataFrame) -> DataFrame | None:
    """components() of edges given in both directions and written; None without any edge."""
    if not both.limit(1).count():
        return None
    least = both.groupBy("a").agg(F.min(_rank("b")).alias("low"))
    labels, step = least.select(F.col("a").alias("vertex"), F.when(F.col("low") >= _rank("a"), F.col("a")).alias("label"), F.lit(0).alias("step")), 0
    links = both.where("a <> b")
    while True:
        for _ in range(STEPS):
            frontier = labels.where(F.col("step") == step).where("label is not null").select(F.col("vertex").alias("b"), "label")
            reached = links.join(frontier, "b").groupBy("a").agg(F.min("label").alias("new"))
            step += 1
            joined = labels.join(reached, labels.vertex == reached.a, "left")
            fresh = F.col("label").isNull() & F.col("new").isNotNull()
            labels = joined.select("vertex", F.coalesce("label", "new").alias("label"), F.when(fresh, step).otherwise(F.col("step")).alias("step"))
        labels = materialize(labels, "labels")
        if not labels.where("label is null").limit(1).count():
            break
    labels = labels.drop("step")
    one, two = labels.select(F.col("vertex").alias("a"), F.col("label").alias("la")), labels.select(F.col("vertex").alias("b"), F.col("label").alias("lb"))
    met = both.join(one, "a").join(two, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    upper = _level(materialize(met, "edges"))
    if upper is None:
        return labels.withColumnRenamed("label", "component")
    return labels.join(upper, labels.label == upper.vertex, "left").select(labels.vertex, F.coalesce("component", "label").alias("component"))


def windows(plan: DataFrame) -> DataFrame:
    """Valid windows: (window_id, plan_id, repo, split, target); a missing or negative target is 0.

    A window without a repository is an entity of its own.
    """
    slim = plan.select("id", "_ord", "plan_id", F.coalesce(repo_key("repo_url"), F.concat(F.lit("window:"), "id")).alias("repo"), split_name("split").alias("split"), F.greatest(F.coalesce("target_records", F.lit(0)), F.lit(0)).alias("target"))
    return valid_rows(slim, "id", "plan_id", "repo", "split", "target").withColumnRenamed("id", "window_id")


def entity_windows(plan: DataFrame, alias: DataFrame) -> DataFrame:
    """windows() with entity: the first by name of the repositories that are one with it over all aliases, else the repository."""
    links = alias.select(repo_key("alias_url").alias("a"), repo_key("repo_url").alias("b"))
    parts = components(links)
    names = parts.groupBy(F.col("component").alias("c")).agg(F.min("vertex").alias("name"))
    parts = parts.join(names, F.col("component") == F.col("c")).select("vertex", F.col("name").alias("component"))
    w = windows(plan)
    return w.join(parts, w.repo == parts.vertex, "left").drop("vertex").withColumn("entity", F.coalesce("component", "repo")).drop("component")


def torn(entities: DataFrame) -> DataFrame:
    """(plan_id, entity, splits, windows): entities with windows of two or more splits in a plan."""
    both = entities.groupBy("plan_id", "entity").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.count(F.lit(1)).alias("windows"))
    return both.where(F.size("splits") > 1)


def torn_windows(plan: DataFrame, alias: DataFrame) -> DataFrame:
    """(window_id) of torn entities; a plan_id of null is a plan as well."""
    e = materialize(entity_windows(plan, alias), "windows")
    t = torn(e).select(F.col("plan_id").alias("p"), F.col("entity").alias("en"))
    return e.join(t, e.plan_id.eqNullSafe(t.p) & (e.entity == t.en), "left_semi").select("window_id")


def assign(entities: DataFrame, shares: DataFrame) -> DataFrame:
    """(plan_id, entity, weight, split): every entity of a plan whole in one split, near the shares.

    shares: (split, share), the few splits there are. All entities follow the order of their hashes;
    running totals are sums of hash ranges plus sums within a range. Each hash and start of the
    stretches is tried on the entities' arcs, the sums combine before their shuffle, and the one with
    the smallest largest error holds (of equals the first). Plans without any weight count windows
    instead. An empty shares table gives a null split.
    """
    per = entities.groupBy("plan_id", "entity").agg(F.sum("target").alias("t"), F.count(F.lit(1)).alias("n"))
    total = per.groupBy(F.col("plan_id").alias("tp")).agg(F.sum("t").alias("total"), F.sum("n").alias("count"))
    sized = per.join(total, F.col("plan_id").eqNullSafe(F.col("tp"))).select(
        "plan_id", "entity", F.when(F.col("total") > 0, F.col("t")).otherwise(F.col("n")).cast("double").alias("weight"), F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("count")).cast("double").alias("total")
    )
    digest = F.conv(F.substring(F.sha2(F.concat_ws(":", "entity", F.col("seed").cast("string")), 256), 1, 15), 16, 10).cast("bigint")  # 60 bits
    hashed = sized.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1)))).withColumn("h", digest).withColumn("range", F.shiftright("h", 60 - RANGES.bit_length() + 1))
    sums = hashed.groupBy("plan_id", "seed", "range").agg(F.sum("weight").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("plan_id", "seed").orderBy("range")) - F.col("s")).drop("s")
    run = hashed.alias("l").join(before.alias("b"), F.col("l.plan_id").eqNullSafe(F.col("b.plan_id")) & (F.col("l.seed") == F.col("b.seed")) & (F.col("l.range") == F.col("b.range"))).select("l.*", "b.before")
    middle = F.col("before") + F.sum("weight").over(Window.partitionBy("plan_id", "seed", "range").orderBy("h", "entity").rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight") / 2
    run = materialize(run.select("plan_id", "seed", "entity", "weight", "total", (middle / F.col("total")).alias("middle")), "entities")
    goal = shares.where("share > 0").groupBy(split_name("split").alias("split")).agg(F.max("share").alias("share")).where("split is not null")
    want = [(r["split"], float(r["share"])) for r in goal.orderBy("split").collect()]  # three splits exist
    whole = sum(x for _, x in want)
    if not want:
        return run.where("seed = 0").select("plan_id", "entity", "weight", F.lit(None).cast("string").alias("split"))
    ends = [sum(x for _, x in want[: k + 1]) / whole for k in range(len(want))]

    def placed(turn: Column) -> Column:
        """The number of the split in which the middle lies when the first stretch begins at turn / TURNS."""
        at = F.pmod(F.col("middle") - turn / TURNS, F.lit(1.0))
        return sum([(at >= e).cast("int") for e in ends[:-1]], F.lit(0))

    tried = run.select("plan_id", "seed", "weight", "total", "middle", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("turn"))
    # weights are whole numbers, so their sums are the same in any order
    got = tried.groupBy("plan_id", "seed", "turn").agg(F.max("total").alias("total"), *[F.sum(F.when(placed(F.col("turn")) == k, F.col("weight")).otherwise(0.0)).alias(f"s{k}") for k in range(len(want))])
    error = F.greatest(F.lit(0.0), *[F.abs(F.col(f"s{k}") / F.col("total") - x / whole) for k, (_, x) in enumerate(want)])
    best = got.groupBy(F.col("plan_id").alias("bp")).agg(F.min(F.struct(F.round(error, 9).alias("e"), "seed", "turn")).alias("b")).select("bp", F.col("b.seed").alias("bs"), F.col("b.turn").alias("turn"))
    turned = run.join(best, F.col("plan_id").eqNullSafe(F.col("bp")) & (F.col("seed") == F.col("bs")))
    return turned.select("plan_id", "entity", "weight", F.element_at(F.array(*[F.lit(s) for s, _ in want]), placed(F.col("turn")) + 1).alias("split"))


def plan_splits(plan: DataFrame, alias: DataFrame, shares: DataFrame) -> DataFrame:
    """(plan_id, window_id, repo, entity, split_now, split): the split of every valid window."""
    e = materialize(entity_windows(plan, alias), "windows")
    a = assign(e, shares)
    return e.join(a, e.plan_id.eqNullSafe(a.plan_id) & (e.entity == a.entity), "left").select(e.plan_id, "window_id", "repo", e.entity, e.split.alias("split_now"), a.split.alias("split"), "target")


def plan_report(plan: DataFrame, alias: DataFrame, shares: DataFrame) -> DataFrame:
    """(plan_id, split, target, part): the share of a plan's targets that each split gets."""
    rows = plan_splits(plan, alias, shares).groupBy("plan_id", "split").agg(F.sum("target").alias("target"))
    return rows.withColumn("part", F.try_divide("target", F.sum("target").over(Window.partitionBy("plan_id"))))
