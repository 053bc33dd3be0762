"""Queries of the record contracts, the joins between stages and the evaluation, on the driver's tables.

The tables hold labels only, so the records around them are views of the labels' deliveries: reviews
and inputs of the first delivery of a label meet labels and sources of the last one, and where a
label was delivered again with other values, the contracts have something to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import commits, paths
from quern.functions.columns import repo_key, split_name, valid_rows
from quern.operators import evaluation, lineage, records, sft
from quern.operators.dedup import first_rows, limit_two_levels
from quern.session import materialize
from quern.tables import table

Query = Callable[[SparkSession, str], DataFrame]

# What the views write where the labels have nothing, and how a label's state reads as a decision.
INSTRUCTION = "Write a Conventional Commit message for the changed paths."
DECISIONS = {"accept_as_is": "accept", "accept_with_light_edit": "edit", "reject": "reject", "not_reviewed": "needs_review"}
ACCEPTED = "accepted_for_teacher_labeling"
SHARED = ["source_repo_url", "source_license", "source_commit", "parent_commit", "data_split", "changed_paths"]


def _labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "generated_label")


def _first(s: SparkSession, d: str, *more: str) -> DataFrame:
    """The first delivery of every label."""
    names = ["id", *SHARED, "header", "human_review_status", "teacher_model_id", "prompt_version", "generation_timestamp", *more]
    return first_rows(_labels(s, d).select(*names, "_ord"), "id")


def _sources(rows: DataFrame) -> DataFrame:
    given = {"manifest_revision": F.col("parent_commit"), "historical_subject": F.col("header"), "extraction_command": F.lit("git diff --stat"), "review_status": F.lit("not_reviewed"), "source_commit_timestamp": F.col("generation_timestamp")}
    stat = F.concat(F.size("changed_paths").cast("string"), F.lit(" files changed"))
    return rows.select(paths.without_prefix(F.col("id")).alias("id"), *SHARED, *[c.alias(n) for n, c in given.items()], F.array().cast("array<string>").alias("excluded_paths"), stat.alias("diff_stat"), "_ord")


def _source_reviews(rows: DataFrame) -> DataFrame:
    key = paths.without_prefix(F.col("id"))
    decision = F.when(F.col("human_review_status") == "reject", "rejected").otherwise(ACCEPTED)
    return rows.select(
        F.concat(F.lit("review-"), key).alias("id"), key.alias("source_diff_id"), "source_repo_url", "source_commit", "parent_commit", "data_split", "changed_paths", decision.alias("decision"), F.array(F.col("human_review_status")).alias("reasons"), F.lit("").alias("notes"),
        F.lit("r").alias("reviewer"), F.col("generation_timestamp").alias("review_timestamp"), F.lit("v0").alias("review_protocol"), "_ord",
    )


def _inputs(rows: DataFrame) -> DataFrame:
    """Inputs of rows that have the teacher's fields too."""
    key = paths.without_prefix(F.col("id"))
    given = {"prompt_path": F.lit("p.md"), "system_message": F.lit("Commit messages."), "user_message": F.array_join("changed_paths", "\n"), "diff": F.col("header"), "diff_sha256": F.sha2("header", 256), "input_status": F.lit("ready_for_generation"), "diff_stat": F.concat(F.size("changed_paths").cast("string"), F.lit(" files changed")), "historical_subject": F.col("header")}
    return rows.select(F.concat(F.lit("teacher-input-"), key).alias("id"), key.alias("source_diff_id"), F.concat(F.lit("review-"), key).alias("review_decision_id"), *SHARED, *sft.TEACHER_FIELDS, *[c.alias(n) for n, c in given.items()], "_ord")


def _label_reviews(rows: DataFrame) -> DataFrame:
    decision = F.element_at(F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv]), F.col("human_review_status"))
    edited = F.when(decision == "edit", F.concat("header", F.lit(" again")))
    return rows.select(
        F.concat(F.lit("review-"), "id").alias("id"), F.col("id").alias("generated_label_id"), "source_repo_url", "source_commit", "teacher_model_id", "prompt_version", "header", decision.alias("decision"), F.array().cast("array<string>").alias("issues"), F.lit("").alias("notes"),
        edited.alias("edited_header"), F.lit(None).cast("array<string>").alias("edited_body"), F.lit("r").alias("reviewer"), F.col("generation_timestamp").alias("review_timestamp"), F.lit("v0").alias("review_protocol"), "_ord",
    )


def _with_teacher(s: SparkSession, d: str) -> DataFrame:
    """First deliveries with the teacher's fields. A map can't be compared, so the row is picked by its number."""
    at = _labels(s, d).groupBy("id").agg(F.min("_ord").alias("_ord"))
    return _labels(s, d).join(at, ["id", "_ord"], "left_semi")


def manifest_errors(s: SparkSession, d: str) -> DataFrame:
    return records.failures(records.manifest_errors(table(s, d, "source_manifest")), "repo_url", "_ord")


def label_errors(s: SparkSession, d: str) -> DataFrame:
    return records.failures(records.with_errors(_labels(s, d), records.label_rules()), "id", "_ord")


def plan_errors(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "split_plan").withColumnsRenamed({"start_at": "start", "end_at": "end"})
    return records.failures(records.plan_errors(w), "plan_id", "id", "_ord")


def _manifest(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "source_manifest").select(repo_key("repo_url").alias("repo"), "allowed_splits", "review_status", "ecosystem", "_ord")
    return valid_rows(m, "repo", "allowed_splits", "review_status", "ecosystem")


def window_manifest_errors(s: SparkSession, d: str) -> DataFrame:
    w = valid_rows(table(s, d, "split_plan").select("id", "_ord", repo_key("repo_url").alias("repo"), split_name("split").alias("split")), "id", "repo", "split")
    return records.failures(records.window_manifest_errors(w, _manifest(s, d)), "id")


def plan_ecosystems(s: SparkSession, d: str) -> DataFrame:
    """The ecosystems of each split's windows, sorted, and how many windows name a repository outside the manifest."""
    w = valid_rows(table(s, d, "split_plan").select("id", "_ord", repo_key("repo_url").alias("repo"), split_name("split").alias("split")), "id", "repo", "split")
    m = _manifest(s, d).select(F.col("repo").alias("_r"), F.nullif(F.lower(F.trim("ecosystem")), F.lit("")).alias("ecosystem"))
    j = w.join(m, F.col("repo") == F.col("_r"), "left")
    return j.groupBy("split").agg(F.array_join(F.array_sort(F.collect_set("ecosystem")), ",").alias("ecosystems"), F.count_if(F.col("_r").isNull()).alias("outside"))


def source_errors(s: SparkSession, d: str) -> DataFrame:
    """Every delivery as a source row, against its rules and the manifest's URLs as they are written."""
    rows = records.with_errors(_sources(_labels(s, d)), records.source_rules())
    known = table(s, d, "source_manifest").select(F.col("repo_url").alias("_url")).distinct()
    j = rows.join(known, F.col("source_repo_url") == F.col("_url"), "left")
    outside = F.when(F.col("_url").isNull(), F.concat(F.lit("source_repo_url is not present in the source manifest: "), F.coalesce("source_repo_url", F.lit("None"))))
    return records.failures(j.withColumn("errors", F.array_compact(F.array_append("errors", outside))), "id", "_ord")


def source_review_errors(s: SparkSession, d: str) -> DataFrame:
    out = sft.review_errors(_source_reviews(_first(s, d)), _sources(_labels(s, d)), "source_diff_id", ["source_repo_url", "source_commit", "parent_commit", "data_split", "changed_paths"], records.source_review_rules(), "source diff record")
    return records.failures(out, "id")


def label_review_errors(s: SparkSession, d: str) -> DataFrame:
    labels = _labels(s, d)
    out = sft.review_errors(_label_reviews(_first(s, d)), labels, "generated_label_id", ["source_repo_url", "source_commit", "teacher_model_id", "prompt_version", "header"], records.label_review_rules(), "generated label")
    return records.failures(out, "id")


def teacher_input_errors(s: SparkSession, d: str) -> DataFrame:
    """Every delivery as an input, against the sources of the last deliveries and the reviews of the first ones."""
    accepted = _source_reviews(_first(s, d)).where(F.col("decision") == ACCEPTED)
    return records.failures(sft.input_errors(_inputs(_labels(s, d)), _sources(_labels(s, d)), accepted), "id", "_ord")


def label_input_errors(s: SparkSession, d: str) -> DataFrame:
    out, _ = sft.label_input_errors(_labels(s, d), _inputs(_with_teacher(s, d)))
    return records.failures(out, "id", "_ord")


def _trained(s: SparkSession, d: str) -> DataFrame:
    labels = _labels(s, d)
    last = labels.join(labels.groupBy("id").agg(F.max("_ord").alias("_ord")), ["id", "_ord"], "left_semi")
    return sft.sft_rows(_label_reviews(_first(s, d)), labels, _inputs(last), _sources(labels), "gx", "v0", INSTRUCTION)


def sft_errors(s: SparkSession, d: str) -> DataFrame:
    return records.failures(_trained(s, d), "generated_label_review_id")


def training_rows(s: SparkSession, d: str) -> DataFrame:
    good = _trained(s, d).where(F.size("errors") == 0)
    return good.select("id", "source_diff_id", "generated_label_id", "generated_label_review_id", "teacher_input_id", "data_split", "label_source", "review_decision", "teacher_model_id", "teacher_size", "diff_sha256", "target_header", F.sha2("target_message", 256).alias("target_sha256"), F.sha2(F.get("messages", F.lit(1))["content"], 256).alias("user_sha256"), F.size("messages").cast("bigint").alias("messages"), "confidence")


def lineage_errors(s: SparkSession, d: str) -> DataFrame:
    """Training rows of the last deliveries against labels, reviews and inputs of the first ones."""
    rows = materialize(_trained(s, d).where(F.size("errors") == 0).drop("errors").withColumn("_ord", F.xxhash64("id")), "trained")
    first = _with_teacher(s, d)
    rules = records.training_rules(INSTRUCTION, list(sft.LABEL_SOURCES.values()), list(sft.LABEL_SOURCES))
    out = sft.lineage_errors(rows, first, _label_reviews(_first(s, d)), _inputs(first), rules)
    return records.failures(out, "id")


def _side_by_side(s: SparkSession, d: str) -> DataFrame:
    """A label's last message as target, its first one as the teacher's, and its first path's name as the historical subject."""
    m = commits.plain_message(F.col("header"), F.col("body"), F.col("footers"))
    last = valid_rows(_labels(s, d), "id", "header", "body", "footers", "changed_paths", "data_split").select("id", F.coalesce(split_name("data_split"), F.lit("NONE")).alias("data_split"), "changed_paths", m.alias("target"))
    first = first_rows(_labels(s, d).select("id", "header", "body", "footers", "_ord"), "id").select(F.col("id").alias("_id"), m.alias("teacher"))
    return last.join(first, F.col("id") == F.col("_id")).withColumn("historical", F.concat(F.lit("update "), F.coalesce(F.get("changed_paths", F.lit(0)), F.lit("")))).drop("_id")


def _scored(s: SparkSession, d: str) -> DataFrame:
    return evaluation.scored_messages(_side_by_side(s, d), {"target": "target", "teacher": "teacher", "historical": "historical"}, ["id", "data_split"])


def eval_signals(s: SparkSession, d: str) -> DataFrame:
    return evaluation.signal_counts(_scored(s, d)).withColumn("data_split", F.coalesce("data_split", F.lit("ALL")))


def eval_types(s: SparkSession, d: str) -> DataFrame:
    return evaluation.type_counts(_scored(s, d))


def eval_errors(s: SparkSession, d: str) -> DataFrame:
    return evaluation.top_errors(_scored(s, d))


def changed_labels(s: SparkSession, d: str) -> DataFrame:
    return evaluation.changed(_side_by_side(s, d), "target", "teacher")


def artifact_summary(s: SparkSession, d: str) -> DataFrame:
    names = ["source_license", "human_review_status", "prompt_version"]
    rows = valid_rows(_labels(s, d), "id", "data_split", "source_repo_url", *names).withColumn("data_split", split_name("data_split"))
    return evaluation.artifact_summary(rows, _manifest(s, d).select("repo", F.lower(F.trim("ecosystem")).alias("ecosystem")), names)


def decision_report(s: SparkSession, d: str) -> DataFrame:
    rows = _source_reviews(_first(s, d)).withColumn("data_split", F.coalesce(split_name("data_split"), F.lit("NONE")))
    return evaluation.decision_report(rows)


def noise_paths(s: SparkSession, d: str) -> DataFrame:
    """The path and subject predicates of every label; a statistic made of its paths stands for the diff's."""
    p = F.col("changed_paths")
    stat = F.concat(F.lit(" "), (F.size(p) * 2).cast("string"), F.lit(" files changed, 1,0"), (F.size(p) + 10).cast("string"), F.lit(" insertions(+), 7 deletions(-)"))
    rows = valid_rows(_labels(s, d), "id", "header", "changed_paths").withColumn("c", paths.diff_counts(stat, p))
    lines = F.col("c.insertions") + F.col("c.deletions")
    return rows.select(
        "id", paths.is_noise_subject(F.col("header")).alias("noise_subject"), paths.all_noise(p).alias("all_noise"), F.size(F.filter(p, paths.is_noise)).cast("bigint").alias("noise"), paths.has_code_or_tests(p).alias("code_or_tests"), paths.is_snapshot_bulk(p, F.col("c.files"), lines).alias("snapshot_bulk"),
        F.col("c.files").alias("files"), lines.alias("lines"),
    )


def sequence_errors(s: SparkSession, d: str) -> DataFrame:
    return records.sequence_errors(valid_rows(table(s, d, "sequence_metadata"), "record_id", "materialization_id", "context_tokens", "input_length", "loss_tokens"), table(s, d, "sequence_run"))


def missing_reviews(s: SparkSession, d: str) -> DataFrame:
    """Labels without a review that decides."""
    decided = _label_reviews(_first(s, d)).where("decision <> 'needs_review'")
    return lineage.missing(_labels(s, d).select(F.col("id").alias("generated_label_id")), decided, "generated_label_id")


def updated_reviews(s: SparkSession, d: str) -> DataFrame:
    """Open reviews get a decision from the last delivery's score; those decided already keep theirs."""
    last = valid_rows(_labels(s, d), "id", "verifier_score").select(F.col("id").alias("generated_label_id"), F.when(F.col("verifier_score") == 1.0, "accept").otherwise("reject").alias("decision"), F.lit("by score").alias("notes"))
    out = lineage.update(_label_reviews(_first(s, d)), last, "generated_label_id", ["decision", "notes"], F.col("decision") == "needs_review")
    return out.groupBy("decision", "notes").agg(F.count(F.lit(1)).alias("reviews"))


def generated_rows(s: SparkSession, d: str) -> DataFrame:
    """Labels made again from replies that hold their own fields as JSON, behind thoughts and inside a fence."""
    names = ["header", "body", "footers", "type", "scope", "warnings", "evidence_paths"]
    labels = _labels(s, d)
    last = labels.join(labels.groupBy("id").agg(F.max("_ord").alias("_ord")), ["id", "_ord"], "left_semi")
    confidence = F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence")
    reply = F.concat(F.lit("<think>{no}</think>\n```json\n"), F.to_json(F.struct(*names, confidence)), F.lit("\n```"))
    replies = last.select(paths.without_prefix(F.col("id")).alias("source_diff_id"), reply.alias("reply"))
    out = sft.label_rows(_inputs(last), replies, F.lit("now"))
    return out.select("id", "header", F.size("body").cast("bigint").alias("n_body"), "type", "scope", "confidence", F.size("evidence_paths").cast("bigint").alias("n_evidence"), F.size("warnings").cast("bigint").alias("n_warnings"), F.round("verifier_score", 6).alias("verifier_score"), F.size("parser_result.errors").cast("bigint").alias("n_errors"), "error")


def two_level_limit(s: SparkSession, d: str) -> DataFrame:
    """The first 20 deliveries of every repository are candidates; of those in DEV the first 500 are taken."""
    rows = _labels(s, d).select("id", "_ord", F.coalesce(repo_key("source_repo_url"), F.lit("")).alias("repo"), split_name("data_split").alias("split"))
    return limit_two_levels(rows, ["repo"], [F.asc("_ord")], 20, F.col("split") == "DEV", 500, [F.asc("_ord")]).select("id", "_ord")


def first_sequences(s: SparkSession, d: str) -> DataFrame:
    """The first 64 kept sequences of DEV."""
    rows = valid_rows(table(s, d, "sequence_metadata").withColumn("at", F.col("_ord")), "record_id", "at", "data_split", "decision")
    return rows.where((split_name("data_split") == "DEV") & (F.col("decision") != "exclude_oversize")).orderBy("at").limit(64).select("record_id")


def queries() -> dict[str, Query]:
    own = [
        manifest_errors, label_errors, plan_errors, window_manifest_errors, plan_ecosystems, source_errors, source_review_errors, label_review_errors, teacher_input_errors, label_input_errors, sft_errors, training_rows, lineage_errors,
        eval_signals, eval_types, eval_errors, changed_labels, artifact_summary, decision_report, noise_paths, sequence_errors, missing_reviews, updated_reviews, generated_rows, two_level_limit, first_sequences,
    ]
    return {f.__name__: f for f in own}
