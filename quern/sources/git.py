"""A data source for the commits of local Git repositories: one partition per repository."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions.paths import change_id
from quern.operators.intervals import assign_windows, rfc3339

SCHEMA = "repo string, rank int, commit string, parents array<string>, committed_at string, subject string, changed_paths array<string>, excluded_paths array<string>, diff_stat string, stat_calls int, diff string"
#: Bytes of path names that one call of git takes; longer lists are divided.
CALL_BYTES = 100_000
TOTAL = re.compile(r"^ ?(\d+) files? changed(?:, (\d+) insertions?\(\+\))?(?:, (\d+) deletions?\(-\))?$")


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def divided(paths: list[str], most: int = CALL_BYTES) -> list[list[str]]:
    """paths in stretches of at most `most` bytes; a longer name is a stretch of its own."""
    out: list[list[str]] = []
    size = 0
    for p in paths:
        n = len(p.encode()) + 1
        if not out or size + n > most:
            out.append([])
            size = 0
        out[-1].append(p)
        size += n
    return out


def added(stats: list[str]) -> str:
    """The statistics of several calls as one: all lines of files, and the sum of the totals."""
    if len(stats) < 2:
        return stats[0] if stats else ""
    lines, files, plus, minus = [], 0, 0, 0
    for s in stats:
        *own, last = s.split("\n")
        m = TOTAL.match(last)
        if m:
            files, plus, minus = files + int(m[1]), plus + int(m[2] or 0), minus + int(m[3] or 0)
        lines += own if m else [*own, last]
    plural = lambda n, word: f"{n} {word}{'' if n == 1 else 's'}"
    total = [f"{plural(files, 'file')} changed"] + ([f"{plural(plus, 'insertion')}(+)"] if plus else []) + ([f"{plural(minus, 'deletion')}(-)"] if minus else [])
    return "\n".join([*lines, " " + ", ".join(total)])


class _Repo(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.revision, self.limit = options.get("revision", "HEAD"), int(options.get("limit", "1000"))
        self.diff = options.get("diff", "false").lower() == "true"
        self.exclude = json.loads(options.get("exclude", "{}"))

    def partitions(self) -> list[InputPartition]:
        return [_Repo(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        repo = partition.path
        commits = git(repo, "rev-list", "--no-merges", f"--max-count={self.limit}", self.revision).split()
        for rank, commit in enumerate(commits):
            head = git(repo, "show", "-s", "--format=%P%x00%cI%x00%s", commit).rstrip("\n").split("\0")
            parents = head[0].split()
            if len(parents) != 1:
                continue  # roots have nothing to be compared with
            names = [n for n in git(repo, "diff", "--name-only", "--no-renames", "-z", parents[0], commit).split("\0") if n]
            globs = self.exclude.get(repo, [])
            out = [n for n in names if any(fnmatchcase(n, g) for g in globs)]
            paths = [n for n in names if n not in set(out)]
            parts = divided(paths)
            stats = [git(repo, "diff", "--no-ext-diff", "--stat", "--find-renames", parents[0], commit, "--", *p).strip("\n") for p in parts]
            diff = None
            if self.diff:
                diff = "".join(git(repo, "diff", "--no-ext-diff", "--find-renames", parents[0], commit, "--", *p) for p in parts)
            yield repo, rank, commit, parents, head[1], head[2], paths, out, added(stats).strip(), len(parts), diff


class GitCommits(DataSource):
    """spark.dataSource.register(GitCommits); spark.read.format("git_commits").option("path", "repo1,repo2").load()

    Options: revision (HEAD), limit (latest commits per repository, merges not counted), diff (false),
    exclude (JSON object: repository -> shell-style globs; paths that one covers are excluded_paths
    and in neither statistics nor diff). rank is the position in the log, newest first. Roots and
    merges give no row. Renames are found whatever git's configuration says; a list of paths too long
    for one call is divided, and the statistics are added up (stat_calls > 1).
    """

    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def probe(rows: DataFrame, key: str, repo: str, revisions: list[str]) -> DataFrame:
    """(key, problem): rows whose repository folder or one of whose revisions isn't there; problem says which."""

    def missing(path: str | None, names: list[str | None]) -> str | None:
        if not path or not os.path.isdir(path):
            return "no repository"
        for n in names:
            if not n or subprocess.run(["git", "-C", path, "cat-file", "-e", n + "^{commit}"], capture_output=True, check=False).returncode:
                return f"no revision {n}"
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [missing(r[0], list(r[1:])) for r in pdf[[repo, *revisions]].itertuples(index=False)]
            out = pd.DataFrame({key: pdf[key], "problem": found})
            yield out[out["problem"].notna()]

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, repo, *revisions).mapInPandas(run, f"{key} {kind}, problem string")


def source_diffs(commits: DataFrame, manifest: DataFrame, windows: DataFrame | None = None, split: str = "DEV") -> DataFrame:
    """Rows of source diffs (14 columns) and _ord of the commits of GitCommits.

    manifest: (repo, the folder; repo_url, source_license, source_revision, _ord), one row per folder.
    windows: (repo, start, end, _ord, split); a commit takes the split of its repository's first
    window that holds its time, and is dropped outside all of them. Commits whose paths are all
    excluded are dropped as well.
    """
    m = manifest.select(F.col("repo").alias("_repo"), "repo_url", "source_license", "source_revision", F.col("_ord").alias("_m"))
    rows = commits.where(F.size("changed_paths") > 0).join(m, F.col("repo") == F.col("_repo")).withColumn("_at", rfc3339(F.col("committed_at")))
    rows = assign_windows(rows, windows, ["repo"], "_at", ["repo", "commit"]) if windows is not None else rows.withColumn("split", F.lit(split))
    command = lambda scope: F.lit(f"git diff --stat --find-renames <parent> <commit>{scope}")
    return rows.select(
        change_id(F.col("repo_url"), F.col("commit")).alias("id"), F.col("repo_url").alias("source_repo_url"), "source_license", F.col("source_revision").alias("manifest_revision"), F.col("commit").alias("source_commit"), F.col("committed_at").alias("source_commit_timestamp"),
        F.get("parents", F.lit(0)).alias("parent_commit"), F.col("split").alias("data_split"), "changed_paths", "excluded_paths", "diff_stat", F.col("subject").alias("historical_subject"), command(" -- <included_paths>").alias("extraction_command"), F.lit("not_reviewed").alias("review_status"),
        F.struct("_m", "rank").alias("_ord"),
    )


def candidates(rows: DataFrame, existing: DataFrame, allowed: list[str] | None, per_repo: int, overall: int) -> DataFrame:
    """rows with status: existing, split, written, or null beyond the limits.

    Of each repository the first per_repo rows are candidates. Those whose id exists already or whose
    split isn't allowed are skipped; of the others the first `overall` are written, in the order of
    _ord. What comes after the last one written isn't looked at.
    """
    w = Window.partitionBy("source_repo_url").orderBy("_ord")
    j = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_repo).drop("_n").join(existing.select(F.col("id").alias("_e")).distinct(), F.col("id") == F.col("_e"), "left")
    status = F.when(F.col("_e").isNotNull(), "existing").when(~F.col("data_split").isin(allowed), "split") if allowed else F.when(F.col("_e").isNotNull(), "existing")
    j = j.withColumn("status", status).drop("_e")
    last = j.where("status is null").orderBy("_ord").limit(overall).agg(F.max("_ord").alias("_last"), F.count(F.lit(1)).alias("_k"))
    j = j.crossJoin(F.broadcast(last))  # one row
    inside = (F.col("_k") < overall) | (F.col("_ord") <= F.col("_last"))
    return j.withColumn("status", F.when(inside, F.coalesce("status", F.lit("written")))).drop("_last", "_k")
