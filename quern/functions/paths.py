"""Paths, diff statistics and keys made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that name no topic; the softmax model's set lacks "bin".
GENERIC_TOKENS = ["a", "app", "apps", "bin", "core", "file", "files", "lib", "libs", "main", "module", "modules", "package", "packages", "py", "python", "src", "test", "tests", "util", "utils"]


def trimmed_url(url: Column) -> Column:
    """A URL without slashes at the end and one .git."""
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")


def repo_slug(url: Column, host: str = "github.com/") -> Column:
    return F.replace(F.substring_index(trimmed_url(url), host, -1), F.lit("/"), F.lit("-"))


def change_id(url: Column, commit: Column) -> Column:
    """slug-<first 12 digits of the commit>."""
    return F.concat_ws("-", repo_slug(url), F.substring(commit, 1, 12))


def without_prefix(key: Column, prefix: str = "generated-") -> Column:
    return F.when(F.startswith(key, F.lit(prefix)), F.substr(key, F.lit(len(prefix) + 1))).otherwise(key)


def extension(path: Column) -> Column:
    """The extension with its dot; '' without one."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"(\.[^.]*)$", 1)


def has_part(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def _folded(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def is_docs(path: Column) -> Column:
    p = _folded(path)
    return p.startswith("docs/") | p.endswith(".md") | F.contains(p, F.lit("/docs/"))


def is_tests(path: Column) -> Column:
    return _folded(path).rlike(r"^tests?/|/tests?/|test_|_test\.")


# Subjects that name no change of code, parts, names and extensions of paths that hold none, and those that do.
NOISE_SUBJECT = r"(?iU)\b(merge|revert|release|bump|deps?|dependenc|changelog|change log|pre-commit|version)\b"
NOISE_PARTS = [".github", "docs", "doc", "documentation", "changelog", "changes", "news", "release", "releases", "vendor", "generated", "dist", "build", "coverage"]
CONFIG_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "cargo.lock", "go.sum", "package.json", ".pre-commit-config.yaml"]
DOC_EXTENSIONS = [".md", ".rst", ".txt", ".adoc", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico"]
CODE_EXTENSIONS = [".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".rs", ".go", ".java", ".kt", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".rb", ".php", ".swift", ".vue", ".svelte"]
TEST_PARTS = ["test", "tests", "testing", "spec", "specs", "cases"]
SNAPSHOT_PARTS = ["baselines", "snapshots", "snapshot"]
#: A change of snapshots is bulk above so many files or changed lines.
BULK_FILES, BULK_LINES = 8, 800


def is_noise_subject(subject: Column) -> Column:
    return F.coalesce(F.rlike(subject, F.lit(NOISE_SUBJECT)), F.lit(False))


def is_noise(path: Column) -> Column:
    """Whether a path is documentation, configuration, a lock file, or lies in a folder of such."""
    p = F.lower(path)
    return has_part(p, NOISE_PARTS) | F.substring_index(p, "/", -1).isin(CONFIG_NAMES) | extension(p).isin(DOC_EXTENSIONS)


def all_noise(paths: Column) -> Column:
    """An empty list is all noise."""
    return F.forall(paths, is_noise)


def has_code_or_tests(paths: Column) -> Column:
    return F.exists(paths, lambda p: extension(F.lower(p)).isin(CODE_EXTENSIONS) | has_part(F.lower(p), TEST_PARTS))


def is_snapshot_bulk(paths: Column, files: Column, lines: Column) -> Column:
    """A change of expected output that is large by its files or by its inserted and deleted lines."""
    return F.exists(paths, lambda p: has_part(F.lower(p), SNAPSHOT_PARTS)) & ((files > BULK_FILES) | (lines > BULK_LINES))


def local_path(url: Column, host: str = "https://github.com/", root: str = "sources/github.com/") -> Column:
    """Where a repository lies below the data folder; an error for a URL of another host. One .git and slashes at the end don't count."""
    own = trimmed_url(url)
    return F.when(F.startswith(own, F.lit(host)), F.concat(F.lit(root), F.substr(own, F.lit(len(host) + 1)))).when(url.isNotNull(), F.raise_error(F.concat(F.lit("unsupported repo URL: "), url)))


def tokens(paths: Column) -> Column:
    """Lower-case words of every path segment without its last extension; null lists have none."""
    own = F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.regexp_replace(_folded(p), "^/+|/+$", ""))
    stems = F.transform(F.flatten(F.transform(own, lambda p: F.split(p, "/"))), lambda s: F.regexp_replace(F.regexp_replace(s, r"\.[^.]*$", ""), "^_+", ""))
    return F.filter(F.flatten(F.transform(stems, lambda s: F.split(s, "[^a-z0-9]+"))), lambda t: t != "")


def topic(words: Column, generic: list[str] = GENERIC_TOKENS) -> Column:
    return F.coalesce(F.get(F.filter(words, lambda t: ~t.isin(generic)), F.lit(0)), F.lit("project"))


def diff_counts(stat: Column, paths: Column) -> Column:
    """struct(files, insertions, deletions) of a diff statistic; files falls back to the number of paths."""
    stat = F.coalesce(stat, F.lit(""))
    total = lambda word: F.aggregate(
        F.regexp_extract_all(stat, F.lit(rf"(\d[\d,]*) {word}"), 1), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.replace(x, F.lit(",")).try_cast("bigint"), F.lit(0))
    )
    files = F.coalesce(F.regexp_extract(stat, r"(\d+) files? changed", 1).try_cast("bigint"), F.size(paths).cast("bigint"))
    return F.struct(files.alias("files"), total("insertion").alias("insertions"), total("deletion").alias("deletions"))


def evidence_path(path: Column) -> Column:
    """A path without a trailing line reference (#L12-L20, :12, :12:3)."""
    return F.regexp_replace(path, r"(#L\d+(?:-L?\d+)?|:\d+(?::\d+)?)$", "")


def evidence(cited: Column, changed: Column) -> Column:
    """struct(kept, dropped): cited paths that are among the changed ones, once each in order, and the others sorted."""
    bare = F.transform(cited, evidence_path)
    kept = F.array_distinct(F.filter(bare, lambda p: F.array_contains(changed, p)))
    dropped = F.array_sort(F.filter(cited, lambda p: ~F.array_contains(changed, evidence_path(p))))
    return F.struct(kept.alias("kept"), dropped.alias("dropped"))
