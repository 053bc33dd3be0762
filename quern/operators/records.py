"""Contracts of records: rules per field, and rules between rows.

A rule is a column: the message of its error, or null where it holds. Rules never raise and never
drop a row; with_errors puts a row's messages into an array in the order of the rules. Rules whose
value is missing say nothing, but for those that ask for a value. What a field's type rules out (a
number where a string should be) can't occur in a typed table and has no rule. Vocabularies that
belong to a project's policy (licences, review states) are arguments; without them their rules are
not applied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import repo_key
from quern.functions.commits import format_message
from quern.operators.intervals import rfc3339

# The splits, and what separates a revision, a digest and a prompt's name from other strings.
SPLITS = ["DEV", "REPORT", "HELD_OUT"]
DIGEST, PROMPT, DATE = r"^[0-9a-f]{64}$", r"^[a-z0-9][a-z0-9_.-]*$", r"^\d{4}-\d{2}-\d{2}T"

Rule = Column


def said(values: Column) -> Column:
    """A list of strings as errors write it: ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))


def filled(name: str, prefix: tuple[str, ...] | None = None, at: Column | None = None) -> Rule:
    """A string that isn't empty, with one of the prefixes if there are any. at: stands before the name in the message."""
    c = F.col(name)
    text = lambda s: F.concat(at, F.lit(s)) if at is not None else F.lit(s)
    rule = F.when(F.coalesce(F.length(c), F.lit(0)) == 0, text(f"{name} must be a non-empty string"))
    if prefix:
        known = F.lit(False)
        for p in prefix:
            known = known | F.startswith(c, F.lit(p))
        rule = rule.when(~known, text(f"{name} must start with one of {prefix}"))
    return rule


def one_of(name: str, allowed: list[str], say: str | None = None) -> Rule:
    c = F.col(name)
    return F.when(c.isNotNull() & ~c.isin(allowed), F.concat(F.lit(say or f"invalid {name}: "), c))


def never(name: str, value: str, say: str) -> Rule:
    return F.when(F.col(name) == value, F.lit(say))


def matching(name: str, pattern: str, say: str) -> Rule:
    c = F.col(name)
    return F.when(c.isNotNull() & ~c.rlike(pattern), F.lit(say))


def revision(name: str, most: int = 40) -> Rule:
    return matching(name, f"^[0-9a-f]{{7,{most}}}$", f"{name} must be a 7-{most} character lowercase hex revision")


def listed(name: str, least: int = 0) -> Rule:
    c = F.col(name)
    rule = F.when(c.isNull(), F.lit(f"{name} must be a list"))
    return rule.when(F.size(c) < least, F.lit(f"{name} must contain at least {least} item(s)")) if least else rule


def strings(name: str) -> Rule:
    c = F.col(name)
    return F.when(c.isNull() | F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False)), F.lit(f"{name} must be a list of strings"))


def fraction(name: str) -> Rule:
    c = F.col(name)
    return F.when(~F.coalesce((c >= 0) & (c <= 1), F.lit(False)), F.lit(f"{name} must be a number from 0.0 to 1.0"))


def present(name: str, say: str = "must be an object") -> Rule:
    return F.when(F.col(name).isNull(), F.lit(f"{name} {say}"))


def _split() -> Rule:
    return one_of("data_split", SPLITS)


def manifest_rules(licenses: list[str] | None = None, statuses: list[str] | None = None) -> list[Rule]:
    names = ["default_branch", "source_license"], ["license_review_date", "reviewer", "review_status", "source_revision"]
    wrong = F.filter("allowed_splits", lambda s: ~s.isin(SPLITS))
    return [
        filled("repo_url", ("https://", "git@")), *map(filled, names[0]), filled("license_url", ("https://",)), *map(filled, names[1]),
        *([one_of("source_license", licenses, "source_license is not in the allow/review list: ")] if licenses else []),
        *([one_of("review_status", statuses)] if statuses else []),
        revision("source_revision"),
        F.when(F.coalesce(F.size("allowed_splits"), F.lit(0)) < 1, F.lit("allowed_splits must be a non-empty list")).when(F.size(wrong) > 0, F.concat(F.lit("invalid allowed_splits: "), said(wrong))),
        F.when(F.col("ecosystem") == "", F.lit("ecosystem must be a non-empty string when present")),
    ]


def source_rules(statuses: list[str] | None = None) -> list[Rule]:
    texts = ["id", "source_repo_url", "source_license", "manifest_revision", "source_commit", "parent_commit", "data_split", "historical_subject", "extraction_command", "review_status"]
    return [
        *map(filled, texts), _split(), *map(revision, ("manifest_revision", "source_commit", "parent_commit")), matching("source_commit_timestamp", DATE, "source_commit_timestamp must be an RFC3339 string when present"),
        *([one_of("review_status", statuses)] if statuses else []), listed("changed_paths", 1), listed("excluded_paths"), present("diff_stat", "must be a string"),
    ]


def source_review_rules(decisions: list[str] | None = None) -> list[Rule]:
    texts = ["id", "source_diff_id", "source_repo_url", "source_commit", "parent_commit", "data_split", "decision", "reviewer", "review_timestamp", "review_protocol"]
    return [*map(filled, texts), _split(), *([one_of("decision", decisions)] if decisions else []), *map(revision, ("source_commit", "parent_commit")), listed("changed_paths", 1), listed("reasons"), present("notes", "must be a string")]


def input_rules(statuses: list[str] | None = None) -> list[Rule]:
    texts = ["id", "source_diff_id", "review_decision_id", "source_repo_url", "source_license", "source_commit", "parent_commit", "data_split", "teacher_model_id", "teacher_revision", "teacher_license", "prompt_version", "prompt_path", "system_message", "user_message", "diff", "diff_sha256", "input_status"]
    return [
        *map(filled, texts), _split(), never("data_split", "HELD_OUT", "teacher inputs must not be generated for HELD_OUT records"), *map(revision, ("source_commit", "parent_commit", "teacher_revision")),
        matching("prompt_version", PROMPT, "prompt_version must be a stable lowercase identifier"), matching("diff_sha256", DIGEST, "diff_sha256 must be a lowercase sha256 hex digest"),
        *([one_of("input_status", statuses)] if statuses else []), listed("changed_paths", 1), present("decoding_config"),
    ]


def label_rules(statuses: list[str] | None = None) -> list[Rule]:
    texts = ["id", "source_repo_url", "source_license", "source_commit", "parent_commit", "data_split", "teacher_model_id", "teacher_runtime", "teacher_runtime_model_id", "teacher_revision", "teacher_license", "teacher_size", "teacher_context_length", "prompt_version", "generation_timestamp", "header", "human_review_status"]
    return [
        *map(filled, texts), _split(), never("data_split", "HELD_OUT", "teacher-generated labels must not be stored as HELD_OUT labels"), *map(revision, ("source_commit", "parent_commit")), revision("teacher_revision", 64),
        matching("prompt_version", PROMPT, "prompt_version must be a stable lowercase identifier"), *([one_of("human_review_status", statuses)] if statuses else []),
        listed("changed_paths", 1), *map(listed, ("body", "footers", "warnings", "evidence_paths")), fraction("confidence"), fraction("verifier_score"), present("decoding_config"), present("parser_result"),
    ]


def label_review_rules(decisions: list[str] | None = None, issues: list[str] | None = None) -> list[Rule]:
    texts = ["id", "generated_label_id", "source_repo_url", "source_commit", "teacher_model_id", "prompt_version", "header", "decision", "reviewer", "review_timestamp", "review_protocol"]
    wrong = F.array_sort(F.array_distinct(F.filter("issues", lambda x: ~x.isin(issues or []))))
    return [
        *map(filled, texts), present("notes", "must be a string"), revision("source_commit"), matching("prompt_version", PROMPT, "prompt_version must be a stable lowercase identifier"),
        *([one_of("decision", decisions)] if decisions else []), listed("issues"), *([F.when(F.size(wrong) > 0, F.concat(F.lit("invalid issues: "), said(wrong)))] if issues else []),
        F.when(F.exists("edited_body", lambda x: x.isNull()), F.lit("edited_body must be a list of strings or null")),
    ]


def training_rules(instruction: str, sources: list[str], decisions: list[str]) -> list[Rule]:
    texts = [
        "id", "artifact_name", "artifact_version", "source_diff_id", "teacher_input_id", "generated_label_id", "generated_label_review_id", "source_repo_url", "source_license", "source_commit", "parent_commit", "data_split", "instruction", "diff", "diff_sha256", "target_header", "target_message",
        "label_source", "review_decision", "reviewer", "review_timestamp", "teacher_model_id", "teacher_runtime", "teacher_runtime_model_id", "teacher_revision", "teacher_license", "prompt_version", "generation_timestamp",
    ]
    roles = F.transform("messages", lambda m: m["role"])
    none = lambda name: F.coalesce(F.col(name), F.lit("None"))
    whole = format_message(F.col("target_header"), F.col("target_body"), F.col("target_footers"))
    complete = F.col("target_header").isNotNull() & F.col("target_body").isNotNull() & F.col("target_footers").isNotNull()
    return [
        *map(filled, texts), never("data_split", "HELD_OUT", "training examples must not come from HELD_OUT teacher labels"),
        F.when(~F.col("instruction").eqNullSafe(F.lit(instruction)), F.lit("instruction does not match the training artifact contract")),
        F.when(~F.coalesce(F.col("label_source").isin(sources), F.lit(False)), F.concat(F.lit("invalid label_source: "), none("label_source"))),
        F.when(~F.coalesce(F.col("review_decision").isin(decisions), F.lit(False)), F.concat(F.lit("invalid review_decision: "), none("review_decision"))),
        *map(strings, ("changed_paths", "target_body", "target_footers", "review_issues", "evidence_paths", "warnings")), present("decoding_config"), present("parser_result"),
        F.when(F.coalesce(F.size("messages"), F.lit(0)) != 3, F.lit("messages must contain system, user, and assistant messages"))
        .when(~roles.eqNullSafe(F.array(*map(F.lit, ("system", "user", "assistant")))), F.lit("messages roles must be system, user, assistant"))
        .when(~F.get("messages", F.lit(2))["content"].eqNullSafe(F.col("target_message")), F.lit("assistant message does not match target_message")),
        digest_rule(), F.when(complete & ~F.col("target_message").eqNullSafe(whole), F.lit("target_message does not match target fields")),
    ]


def digest_rule() -> Rule:
    return F.when(F.col("diff").isNotNull() & (F.sha2("diff", 256) != F.col("diff_sha256")), F.lit("diff_sha256 does not match diff"))


def with_errors(rows: DataFrame, rules: list[Rule], out: str = "errors") -> DataFrame:
    """Adds out: the messages of the rules that don't hold. Columns that a rule asks for must be there (see completed)."""
    return rows.withColumn(out, F.array_compact(F.array(*rules)))


def completed(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """rows with a null column for every field (name -> type) that it lacks."""
    return rows.select("*", *[F.lit(None).cast(t).alias(n) for n, t in fields.items() if n not in rows.columns])


def repeated(rows: DataFrame, key: Column, say: Column, order: str = "_ord", out: str = "repeated") -> DataFrame:
    """Adds out: the message for the second and later rows of a key in the order of _ord; a null key never repeats."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn(out, F.when(key.isNotNull() & (n > 1), say))


def failures(rows: DataFrame, *keys: str, errors: str = "errors") -> DataFrame:
    """(keys, error): one row per error."""
    return rows.select(*keys, F.explode_outer(errors).alias("error")).where("error is not null")


def unequal(fields: list[str] | dict[str, str], other: Callable[[str], Column], what: str) -> list[Rule]:
    """A message per field that differs from the other record's; null equals null."""
    pairs = fields.items() if isinstance(fields, dict) else [(f, f) for f in fields]
    return [F.when(~F.col(a).eqNullSafe(other(b)), F.lit(f"{a} does not match {what}")) for a, b in pairs]


def manifest_errors(manifest: DataFrame, licenses: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """manifest with errors; the later rows of a repository, however its URL is spelled, are duplicates."""
    key = repo_key("repo_url")
    rows = with_errors(repeated(manifest, key, F.concat(F.lit("duplicate repo_url: "), "repo_url")), manifest_rules(licenses, statuses))
    return rows.withColumn("errors", F.when(F.col("repeated").isNotNull(), F.array_append("errors", F.col("repeated"))).otherwise(F.col("errors"))).drop("repeated")


def plan_errors(windows: DataFrame, plan: str = "plan_id", order: str = "_ord") -> DataFrame:
    """windows with errors, and the overlap with the window of its repository and plan before it.

    windows: plan, plan_version, created_at, id, repo_url, split, start, end, reason, target_records.
    Messages number a plan's windows from 0 in their order. Only windows without errors of their own
    are compared for overlaps, sorted by start.
    """
    at = F.row_number().over(Window.partitionBy(plan).orderBy(order)) - 1
    rows = windows.withColumn("_at", F.concat(F.lit("windows["), at.cast("string"), F.lit("]"))).withColumns({"_s": rfc3339(F.col("start")), "_e": rfc3339(F.col("end"))})
    dot = F.concat("_at", F.lit("."))
    rows = repeated(rows.withColumn("_key", F.struct(plan, "id")), F.when(F.col("id").isNotNull(), F.col("_key")), F.concat(dot, F.lit("id is duplicated: "), "id"), order)
    rules = [
        *[filled(n, at=dot) for n in ("id", "repo_url", "split", "start", "end", "reason")], F.col("repeated"), F.when(F.col("split").isNotNull() & ~F.col("split").isin(SPLITS), F.concat(dot, F.lit("split is invalid: "), "split")),
        F.when(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("_s").isNull() | F.col("_e").isNull()), F.concat("_at", F.lit(" has invalid timestamp"))).when(F.col("_s") >= F.col("_e"), F.concat(dot, F.lit("start must be earlier than end"))),
        F.when(F.col("target_records") < 0, F.concat(dot, F.lit("target_records must be a non-negative integer"))),
    ]
    rows = with_errors(rows, rules)
    good = F.size("errors") == 0
    before = Window.partitionBy(plan, repo_key("repo_url"), good).orderBy("_s", "_e", "id")
    overlap = F.when(good & (F.col("_s") < F.lag("_e").over(before)), F.concat(F.lit("overlapping split windows for "), repo_key("repo_url"), F.lit(": "), F.lag("id").over(before), F.lit(" overlaps "), "id"))
    return rows.withColumn("errors", F.when(overlap.isNotNull(), F.array(overlap)).otherwise(F.col("errors"))).drop("_at", "_s", "_e", "_key", "repeated")


def window_manifest_errors(windows: DataFrame, manifest: DataFrame, reserved: tuple[str, str, str] | None = None) -> DataFrame:
    """windows (repo, split) with errors against the manifest (repo, allowed_splits, review_status), one row per repository.

    reserved: (split, state, message): windows of that split need a source in that review state.
    """
    m = manifest.select(F.col("repo").alias("_repo"), F.col("allowed_splits").alias("_allowed"), F.col("review_status").alias("_state"))
    rows = windows.join(m, F.col("repo") == F.col("_repo"), "left")
    there = F.col("_repo").isNotNull()
    rules = [F.when(~there, F.lit("repo_url is not present in source manifest")), F.when(there & ~F.coalesce(F.array_contains("_allowed", F.col("split")), F.lit(False)), F.concat(F.lit("split "), "split", F.lit(" is not allowed by source manifest")))]
    if reserved:
        rules.append(F.when(there & (F.col("split") == reserved[0]) & ~F.col("_state").eqNullSafe(F.lit(reserved[1])), F.lit(reserved[2])))
    return with_errors(rows, rules).drop("_repo", "_allowed", "_state")


def vocabulary_errors(vocabulary: DataFrame, special: list[str]) -> DataFrame:
    """(id, token, error) of a vocabulary (id, token): ids that leave a gap or repeat, tokens that are empty or repeat, special tokens elsewhere.

    A vocabulary is bounded by its size, so one task looks at its order.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("id", "token")
    place = F.row_number().over(w) - 1
    again = F.row_number().over(Window.partitionBy("token").orderBy("id")) > 1
    rows = vocabulary.withColumns({"_place": place, "_again": again})
    p = F.col("_place").cast("string")
    rules = [
        F.when(~F.col("id").eqNullSafe(F.col("_place")), F.concat(F.lit("vocab entry "), p, F.lit(" has a non-contiguous id"))),
        F.when(F.coalesce(F.length("token"), F.lit(0)) == 0, F.concat(F.lit("vocab entry "), p, F.lit(" has an invalid token"))).when(F.col("_again"), F.concat(F.lit("duplicate vocab token: "), "token")),
    ]
    own = failures(with_errors(rows, rules), "id", "token")
    want = vocabulary.sparkSession.createDataFrame(list(enumerate(special)), "_want int, _special string")
    at = want.join(vocabulary.groupBy("token").agg(F.min("id").alias("id")), F.col("_special") == F.col("token"), "left")
    lost = at.where(~F.col("id").eqNullSafe(F.col("_want"))).select("id", F.col("_special").alias("token"), F.concat(F.lit("special token "), "_special", F.lit(" must have id "), F.col("_want").cast("string")).alias("error"))
    return own.unionByName(lost)


def sequence_errors(metadata: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(record_id, error) of sequence metadata: lengths above the context, and records without loss. runs: (materialization_id, context_tokens) where a row has none."""
    rows = metadata
    if runs is not None:
        rows = rows.join(runs.select("materialization_id", F.col("context_tokens").alias("_run")), "materialization_id", "left").withColumn("context_tokens", F.coalesce("context_tokens", "_run")).drop("_run")
    rules = [F.when(F.col("input_length") > F.col("context_tokens"), F.lit("input_length exceeds context_tokens")), F.when(F.coalesce("loss_tokens", F.lit(0)) <= 0, F.lit("missing loss tokens"))]
    return failures(with_errors(rows, rules), "record_id")
