"""Problem 3: the same or nearly the same change in a training and an evaluation split.

A record's text is its set of paths in their order. Equal sets are one class, and every class has
one text. The suffixes of all texts are range-partitioned and sorted; the range covers the record
too, so that a beginning that a third of all records share spreads over many partitions. Neighbours
with SPAN common paths or more form a run; suffixes are compared to that depth only, as a longer
common prefix is the union of the runs that start inside it. Suffixes in runs of both splits are
shared spans, and a record's spans, merged, are its coverage.

Records covered well enough and in a common run are candidates, which are verified on whole sets of
strings. Classes, links between them and membership stay apart; only found() makes pairs of labels.

Why no pair is lost: two different sets of at least 5 paths with Jaccard J >= 0.8 have a union of u
paths of which d <= u/5 are in one set only. The u - d common ones, in order, are cut into at most
d + 1 stretches, so the longest holds at least (u - d)/(d + 1) paths: 5/2 for u = 6..9 (5 paths on
both sides must be equal), 8/3 for u = 10..14, 12/4 for 15..19 and more than 3 beyond, hence SPAN 3.
Stretches below 3 leave at most 2d common paths without a span, so u - 3d >= 0.4u paths are covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import folded, norm_path, repo_key, split_name, valid_rows
from quern.session import materialize

SPAN, MIN_PATHS = 3, 5
#: Runs with more than so many pairs of classes don't pair their members; these meet by their rarest paths instead (exact as well).
HOT_PAIRS = 20_000
#: Parts into which the larger side of a join by one value is salted.
SALTS = 8
KEY = [f"k{i}" for i in range(SPAN)]


def changes(labels: DataFrame) -> DataFrame:
    """(id, repo, split, commit, names, cls) of valid labels with a known split.

    commit is null unless it has 7 or more hexadecimal digits and nothing else. names: the different
    normalised paths, sorted; empty and null paths don't count. cls: 128 bits of their SHA-256, null
    for fewer than MIN_PATHS.
    """
    own = F.transform(F.filter(F.coalesce("changed_paths", F.array().cast("array<string>")), lambda p: F.length(p) > 0), norm_path)
    slim = labels.select("id", "_ord", repo_key("source_repo_url").alias("repo"), split_name("data_split").alias("split"), folded("source_commit").alias("commit"), F.array_sort(F.array_distinct(own)).alias("names"))
    commit = F.when(F.col("commit").rlike("^[0-9a-f]{7,}$"), F.col("commit"))
    cls = F.when(F.size("names") >= MIN_PATHS, F.unhex(F.left(F.sha2(F.array_join("names", "\0"), 256), F.lit(32))))
    return valid_rows(slim, "id", "repo", "split", "commit", "names").where(F.col("split").isNotNull()).withColumns({"commit": commit, "cls": cls})


def _sides(n: DataFrame, by: Column, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """The DEV rows with a salt each, and the other rows once per salt."""
    dev = n.where("dev").withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    held = n.where("held").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dev, held


def _candidates(spans: DataFrame, key: list[str], salts: int = 1) -> DataFrame:
    """Pairs of classes that share a key at places which sets this similar allow."""
    dev, held = _sides(spans, F.col("cls"), salts)
    d, h = dev.alias("d"), held.alias("h")
    on = [F.col(f"d.{k}") == F.col(f"h.{k}") for k in [*key, "_salt"]]
    dn, hn = F.col("d.n"), F.col("h.n")
    pairs = d.join(h, on).where((F.col("d.cls") != F.col("h.cls")) & (dn * 5 >= hn * 4) & (hn * 5 >= dn * 4))
    if "at" in spans.columns:
        # before the span, and after it, the sets differ in at most a fifth of the union
        most = F.floor((dn + hn) / 9)
        pairs = pairs.where((F.abs(F.col("d.at") - F.col("h.at")) <= most) & (F.abs((dn - F.col("d.at")) - (hn - F.col("h.at"))) <= most))
    return pairs.select(F.col("d.cls").alias("cls_dev"), F.col("h.cls").alias("cls_held"))


def path_classes(ch: DataFrame) -> DataFrame:
    """(cls, dev, held, id, paths): different path sets, one of their labels, and the hashes of the paths in order."""
    ids = F.first(F.transform("names", lambda p: F.xxhash64(p)))
    every = ch.where(F.col("cls").isNotNull())
    return every.groupBy("cls").agg(F.max(F.col("split") == "DEV").alias("dev"), F.max(F.col("split") != "DEV").alias("held"), F.min("id").alias("id"), ids.alias("paths"))


def suffix_array(classes: DataFrame) -> DataFrame:
    """(k0, k1, k2, cls, at, n, dev, held): the suffixes of all texts in order, to the depth of SPAN."""
    at = F.explode(F.sequence(F.lit(0), F.size("paths") - SPAN)).alias("at")
    each = classes.select("cls", "dev", "held", F.size("paths").alias("n"), at, "paths").select(*[F.get("paths", F.col("at") + i).alias(k) for i, k in enumerate(KEY)], "cls", "at", "n", "dev", "held")
    return each.repartitionByRange(*KEY, "cls", "at").sortWithinPartitions(*KEY, "cls", "at")


def shared_spans(suffixes: DataFrame) -> DataFrame:
    """The suffixes in runs of both splits; hot: the run has more than HOT_PAIRS pairs."""
    runs = suffixes.groupBy(*KEY).agg(F.count_if("dev").alias("nd"), F.count_if("held").alias("nh"), F.count(F.lit(1)).alias("k")).where("nd > 0 and nh > 0")
    return suffixes.join(runs.select(*KEY, "k", (F.col("nd") * F.col("nh") > HOT_PAIRS).alias("hot")), KEY)


def coverage(shared: DataFrame) -> DataFrame:
    """(cls, n, dev, held, spans, covered): a class's shared spans, and how many of its paths lie in them when they are merged."""
    own = F.array_sort(F.collect_list(F.struct("at", *KEY, "k", "hot"))).alias("spans")
    per = shared.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n", "dev", "held")], own)
    after = F.slice("spans", F.lit(2), F.size("spans"))
    steps = F.zip_with(after, "spans", lambda b, a: F.least(F.coalesce(b["at"] - a["at"], F.lit(SPAN)), F.lit(SPAN)))
    return per.withColumn("covered", F.aggregate(steps, F.lit(0), lambda a, x: a + x))


def _by_rarest(hot: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates among classes that are in hot runs, by the prefix filter.

    Two sets this similar share one of the first n - ceil(0.8 n) + 1 paths of each in any fixed order;
    the order is the rarest first, and a class has one row per path of that prefix.
    """
    own = hot.select("cls").distinct().join(classes, "cls")
    each = own.select("cls", F.explode("paths").alias("path"))
    ranked = each.join(each.groupBy("path").agg(F.count(F.lit(1)).alias("k")), "path").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("k", "path"))).alias("order"))
    n = F.size("order")
    first = F.slice("order", F.lit(1), (n - F.ceil(n * 4 / 5) + 1).cast("int"))
    prefix = ranked.select("cls", n.alias("n"), F.explode(F.transform(first, lambda x: x["path"])).alias("path"))
    return _candidates(prefix.join(own.select("cls", "dev", "held"), "cls"), ["path"], SALTS)


def path_links(ch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls_dev, cls_held): sets of both sides with Jaccard >= 0.8, equal ones included, each pair once; and coverage()."""
    classes = materialize(path_classes(ch), "classes")
    suffixes = materialize(suffix_array(classes), "suffixes")
    covered = materialize(coverage(shared_spans(suffixes)), "spans")
    well = covered.where(F.col("covered") * 5 >= F.col("n") * 2).select("cls", "n", "dev", "held", F.explode("spans").alias("s")).where("s.k > 1").select("cls", "n", "dev", "held", "s.*")
    # tables that are written have a known size, so that the large sides of the joins below may stay where they are
    pairs = materialize(_candidates(well.where("not hot"), KEY).unionByName(_by_rarest(well.where("hot"), classes)).distinct(), "pairs")
    # on hashes first, which can only find too much, then on the strings of what is left
    alike = lambda a, b: (lambda c: c * 5 >= (F.size(a) + F.size(b) - c) * 4)(F.size(F.array_intersect(a, b)))
    side = lambda k: classes.select(F.col("cls").alias(f"cls_{k}"), F.col("id").alias(f"id_{k}"), F.col("paths").alias(f"p_{k}"))
    likely = pairs.join(side("dev"), "cls_dev").join(side("held"), "cls_held").where(alike("p_dev", "p_held")).drop("p_dev", "p_held")
    likely = materialize(likely, "likely")
    names = lambda k: ch.select(F.col("id").alias(f"id_{k}"), F.col("names").alias(f"n_{k}"))
    near = likely.join(names("dev"), "id_dev").join(names("held"), "id_held").where(alike("n_dev", "n_held")).select("cls_dev", "cls_held")
    same = classes.where("dev and held").select(F.col("cls").alias("cls_dev"), F.col("cls").alias("cls_held"))
    return near.unionByName(same), covered


def commit_links(ch: DataFrame) -> DataFrame:
    """(cls_dev, cls_held): different spellings of commits of both sides of which one begins the other."""
    c = ch.where(F.col("commit").isNotNull()).groupBy("commit").agg(F.max(F.col("split") == "DEV").alias("dev"), F.max(F.col("split") != "DEV").alias("held")).withColumn("head", F.substring("commit", 1, 7))
    dev, held = _sides(c, F.col("commit"))
    d, h = dev.alias("d"), held.alias("h")
    both = d.join(h, (F.col("d.head") == F.col("h.head")) & (F.col("d._salt") == F.col("h._salt")))
    begins = F.startswith(F.col("d.commit"), F.col("h.commit")) | F.startswith(F.col("h.commit"), F.col("d.commit"))
    return both.where(begins).select(F.col("d.commit").alias("cls_dev"), F.col("h.commit").alias("cls_held"))


def _expanded(links: DataFrame, member: DataFrame) -> DataFrame:
    """(dev_id, held_id): the labels of linked classes; a class that many labels hold is salted. member: (cls, id, split)."""
    ones = member.where("split = 'DEV'").select(F.col("cls").alias("cls_dev"), F.col("id").alias("dev_id"))
    others = member.where("split <> 'DEV'").select(F.col("cls").alias("cls_held"), F.col("id").alias("held_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    half = ones.join(links, "cls_dev").withColumn("_salt", F.pmod(F.xxhash64("dev_id"), F.lit(SALTS)).cast("int"))
    return half.join(others, ["cls_held", "_salt"]).select("dev_id", "held_id")


def found(labels: DataFrame) -> DataFrame:
    """(label_id_a, label_id_b): the pairs of labels. Labels without id, split, commit or paths find no partner by what they lack."""
    ch = materialize(changes(labels), "changes")
    by_path = _expanded(path_links(ch)[0], ch.where(F.col("cls").isNotNull()).select("cls", "id", "split"))
    by_commit = _expanded(commit_links(ch), ch.where(F.col("commit").isNotNull()).select(F.col("commit").alias("cls"), "id", "split"))
    both = by_path.unionByName(by_commit)
    return both.select(F.least("dev_id", "held_id").alias("label_id_a"), F.greatest("dev_id", "held_id").alias("label_id_b")).distinct()


def report(labels: DataFrame) -> DataFrame:
    """(split, repo, labels, leaked, by_commit, by_paths, paths, covered) of the evaluation splits, without any pair of labels.

    paths: those of labels with MIN_PATHS or more; covered: those of them inside spans that DEV shares.
    """
    ch = materialize(changes(labels), "changes")
    links, covered = path_links(ch)
    yes = F.lit(True)
    near = links.select(F.col("cls_held").alias("cls")).distinct().withColumn("p", yes)
    same = commit_links(ch).select(F.col("cls_held").alias("commit")).distinct().withColumn("c", yes)
    held = ch.where("split <> 'DEV'").join(near, "cls", "left").join(same, "commit", "left").join(covered.select("cls", "covered"), "cls", "left")
    zero = F.lit(0).cast("bigint")
    return held.groupBy("split", "repo").agg(
        F.count(F.lit(1)).alias("labels"), F.count_if(F.coalesce("p", "c")).alias("leaked"), F.count_if("c").alias("by_commit"), F.count_if("p").alias("by_paths"),
        F.coalesce(F.sum(F.when(F.col("cls").isNotNull(), F.size("names"))), zero).alias("paths"), F.coalesce(F.sum("covered"), zero).alias("covered"),
    )
