"""Problem 2: files that nobody wrote by hand, told by path.

The tables hold paths and no file contents, so a file's tokens are its neighbours: the names in one
folder of a repository, normalised and in order, are a token stream. Winnowing keeps of every WINDOW
neighbouring GRAM-grams the smallest as a fingerprint. A folder whose fingerprints largely recur in
many unrelated repositories (aliases count as one) is a copy, wherever it lies, and all its files are
flagged.

What was vendored once, and what isn't a copy at all (lock files, generated, minified and bundled
files, build output, data saved as code), no recurrence can show. There the exact check of a path's
name and place decides, and the repository's own globs. report() says what each criterion adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import norm_path, repo_key, valid_rows
from quern.functions.globs import globs_regex
from quern.llm.components import components
from quern.session import materialize

#: Names in a gram, grams in a window, and when a folder recurs: the share of its fingerprints, the number of repositories that hold them.
GRAM, WINDOW, RECUR_SHARE, RECUR_REPOS = 3, 2, 0.8, 20

# Names as tools and package managers write them; all are compared in lower case.
THIRD_PARTY_FOLDERS = ["vendor", "vendors", "vendored", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "node_modules", "bower_components", "jspm_packages", "godeps", "site-packages", "dist-packages", "pods", "carthage", "externals"]
BUILD_FOLDERS = ["dist", "build", "target", "out", "obj", "_build", ".next", ".nuxt", "__pycache__", "coverage", "htmlcov", "deriveddata", "cmakefiles"]
GENERATED_FOLDERS = ["generated", "__generated__", "autogenerated", "auto_generated", "autogen", "gen-src", "generated-src", "generated-sources", "generated_sources", "src-gen", "codegen-out"]
LOCK_FILES = ["package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "pnpm-lock.yml", "yarn.lock", "go.sum", "go.work.sum", "packages.lock.json", "gradle.lockfile", "package.resolved", "bun.lockb", "mix.lock", "cargo.lock", "gopkg.lock"]

#: Kind of a file and the pattern of its name, in the order of the kinds.
NAME_RULES = [
    ("lock", r"\.lock$"),
    ("minified", r"[.-]min\.(js|mjs|cjs|css|html)$|[.-]min\.(js|css)\.map$"),
    ("bundled", r"\.(bundle|chunk|packed)\.(js|mjs|css)$|\.(js|mjs|css|ts)\.map$|[.-](?=[0-9a-f]*[0-9])[0-9a-f]{8,}\.(js|mjs|css)$"),
    ("generated", r"\.(generated|gen|g|freezed)\.[a-z]+$|_generated\.[a-z]+$|^zz_generated\.|_pb2(_grpc)?\.pyi?$|\.pb(\.gw|\.validate)?\.(go|cc|h|swift|dart)$|_grpc\.pb\.(go|cc|h)$|\.designer\.(cs|vb)$|^(moc|qrc|ui)_[^/]*\.(cpp|cxx|cc|h|py)$|\.tab\.(c|h|cc|cpp|hh)$|^lex\.yy\.c$|\.yy\.(c|cc|cpp)$|\.graphql\.(js|ts|tsx)$|\.(swagger|openapi)\.json$"),
    ("data", r"\.bin\.(h|c|hpp|inc)$|[_.-](wasm_binary|wasm|base64|b64|blob|binary|font|hexdump)\.(js|ts|mjs|py|go|c|h|rs|java)$|\.(wasm|bin|dat|ttf|woff2?|eot)\.(js|ts|h|c|go|py)$"),
    ("library", r"^[a-z0-9_.+-]+[-.]v?[0-9]+\.[0-9]+(\.[0-9]+)*\.(js|mjs|css)$"),
]


def path_kind(path: Column) -> Column:
    """What the name or the place of a normalised path says; null for what reads as written by hand."""
    low = F.lower(path)
    parts = F.split(low, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    within = lambda names: F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    kind = F.when(name.isin(LOCK_FILES), "lock")
    for what, pattern in NAME_RULES:
        kind = kind.when(name.rlike(pattern), what)
    return (
        kind.when(within(GENERATED_FOLDERS), "generated")
        .when(within(THIRD_PARTY_FOLDERS) | low.rlike(r"(^|/)deps/[^/]+-v?[0-9]+\.[0-9][^/]*/"), "third_party")
        .when(within(BUILD_FOLDERS), "build")
    )


def repo_globs(manifest: DataFrame) -> DataFrame:
    """(repo, globs): one regex per repository, of its valid row; repositories without globs have none."""
    rows = manifest.select(repo_key("repo_url").alias("repo"), "exclude_globs", "_ord")
    return valid_rows(rows, "repo", "exclude_globs").select("repo", globs_regex("exclude_globs").alias("globs")).where("globs is not null")


def label_paths(labels: DataFrame) -> DataFrame:
    """(label_id, repo, raw, path): the different paths of every valid label as written, and normalised; empty ones don't count."""
    slim = labels.select("id", repo_key("source_repo_url").alias("repo"), "changed_paths", "_ord")
    return (
        valid_rows(slim, "id", "repo", "changed_paths")
        .select(F.col("id").alias("label_id"), "repo", F.explode(F.array_distinct("changed_paths")).alias("raw"))
        .where(F.length("raw") > 0)
        .select("label_id", "repo", "raw", norm_path("raw").alias("path"))
    )


def owners(alias: DataFrame) -> DataFrame:
    """(repo, owner): the repositories that stand for one entity; others are their own owners."""
    links = alias.select(repo_key("alias_url").alias("a"), repo_key("repo_url").alias("b"))
    return components(links).select(F.col("vertex").alias("repo"), F.col("component").alias("owner"))


def folder_prints(files: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(owner, folder, print): the fingerprints of every folder. files: (owner, path).

    Names are in lower case with digits as one class; a folder with fewer than k different names has
    no fingerprint. The names of a folder stream through a window; nothing is collected.
    """
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_replace(F.lower(F.regexp_extract("path", "([^/]*)$", 1)), "[0-9]+", "0")
    names = files.where(F.col("owner").isNotNull() & F.contains("path", F.lit("/"))).select("owner", folder.alias("folder"), name.alias("name"))
    names = names.repartition("owner", "folder").distinct()
    order = Window.partitionBy("owner", "folder").orderBy("name")
    gram = F.when(F.lead("name", k - 1).over(order).isNotNull(), F.concat_ws("/", "name", *[F.lead("name", i).over(order) for i in range(1, k)]))
    grams = names.withColumn("gram", gram).where("gram is not null")
    least = F.min("gram").over(order.rowsBetween(0, w - 1))
    return grams.select("owner", "folder", F.xxhash64(least).alias("print")).distinct()


def recurrence(prints: DataFrame) -> DataFrame:
    """(print, repos): how many unrelated repositories hold a fingerprint; combined before the shuffle."""
    return prints.select("print", "owner").distinct().groupBy("print").agg(F.count(F.lit(1)).alias("repos"))


def recurring(prints: DataFrame, share: float = RECUR_SHARE, least: int = RECUR_REPOS) -> DataFrame:
    """(owner, folder, part): folders of which `share` of the fingerprints are held by `least` unrelated repositories or more."""
    many = recurrence(prints).where(F.col("repos") >= least).select("print", F.lit(1).alias("hit"))
    each = prints.join(many, "print", "left").groupBy("owner", "folder").agg((F.count("hit") / F.count(F.lit(1))).alias("part"))
    return each.where(F.col("part") >= share)


def classify(labels: DataFrame, manifest: DataFrame, alias: DataFrame) -> DataFrame:
    """(label_id, repo, path, kind): kind is null for paths written by hand.

    kind is copy (the folder recurs), else what name or place says, else glob (the repository's own
    globs). Labels without a repository or a manifest row have no globs and no copies. The path comes
    as written; a path that a label names twice comes once.
    """
    every = label_paths(labels).join(owners(alias), "repo", "left").withColumn("owner", F.coalesce("owner", "repo"))
    every = materialize(every, "paths")
    # copies are written, so that their size is known and all paths stay where they are if it is small
    copies = materialize(recurring(materialize(folder_prints(every), "prints")).select("owner", "folder", F.lit("copy").alias("copy")), "copies")
    named = every.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).join(copies, ["owner", "folder"], "left")
    joined = named.withColumn("kind", F.coalesce("copy", path_kind(F.col("path")))).join(repo_globs(manifest), "repo", "left")
    kind = F.coalesce(F.col("kind"), F.when(F.rlike("path", F.col("globs")), "glob"))
    return joined.select("label_id", "repo", F.col("raw").alias("path"), kind.alias("kind"))


def found(labels: DataFrame, manifest: DataFrame, alias: DataFrame) -> DataFrame:
    return classify(labels, manifest, alias).where("kind is not null").select("label_id", "path")


def report(labels: DataFrame, manifest: DataFrame, alias: DataFrame) -> DataFrame:
    """(kind, paths, labels): what each criterion adds; the null kind is written by hand."""
    return classify(labels, manifest, alias).groupBy("kind").agg(F.count(F.lit(1)).alias("paths"), F.count_distinct("label_id").alias("labels"))


def recurrence_report(labels: DataFrame, alias: DataFrame) -> DataFrame:
    """(repos, prints): how many fingerprints are held by so many unrelated repositories."""
    every = label_paths(labels).join(owners(alias), "repo", "left").select(F.coalesce("owner", "repo").alias("owner"), "path")
    return recurrence(folder_prints(every)).groupBy("repos").agg(F.count(F.lit(1)).alias("prints"))
