"""Queries of the core operators on the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import commits, paths, tokens
from quern.functions.columns import folded, repo_key, split_name, valid_rows
from quern.functions.globs import globs_regex, split_by_globs
from quern.operators import dedup, intervals, lineage, models, records, reports, training, vocabulary
from quern.session import materialize
from quern.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def label(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return valid_rows(table(s, d, "generated_label"), "id", *columns)


def messages(s: SparkSession, d: str, *columns: str) -> DataFrame:
    m = commits.plain_message(F.col("header"), F.col("body"), F.col("footers"))
    return label(s, d, "header", "body", "footers", *columns).withColumn("message", m)


def commit_parse(s: SparkSession, d: str) -> DataFrame:
    p = commits.with_parsed(messages(s, d), "message")
    return p.select("id", "parsed.type", "parsed.scope", "parsed.subject", F.size("parsed.body").cast("bigint").alias("n_body"), F.size("parsed.footers").cast("bigint").alias("n_footers"), "parsed.breaking", "parsed.error")


def _scored(s: SparkSession, d: str) -> DataFrame:
    return commits.with_score(messages(s, d, "changed_paths", "data_split", "evidence_paths"), "message", paths="changed_paths")


def commit_score(s: SparkSession, d: str) -> DataFrame:
    """All ten signals. What is expected comes from the label's other columns: its type and scope, its warnings, its score and its first path's words."""
    rows = messages(s, d, "changed_paths", "type", "scope", "verifier_score", "confidence")
    rows = rows.withColumns({
        "want_type": folded("type"), "want_scope": F.when(F.col("confidence") > 0.9, F.col("scope")), "want_body": F.col("confidence") > 0.7, "want_footer": F.col("confidence") < 0.5, "want_mixed": F.col("verifier_score") < 0.7, "want_breaking": F.col("type").endswith("!"),
        "claims": F.slice(paths.tokens(F.col("changed_paths")), 1, 1),
    })
    scored = commits.with_score(rows, "message", paths="changed_paths", expected_type="want_type", expected_scope="want_scope", expect_body="want_body", expect_footer="want_footer", expect_mixed="want_mixed", expect_breaking="want_breaking", forbidden="claims")
    return scored.select("id", *[f"score.{c}" for c in commits.SIGNALS], F.size("score.errors").cast("bigint").alias("n_errors"))


def mixed_messages(s: SparkSession, d: str) -> DataFrame:
    """Messages that mention a mixed change, by each phrase, put before the labels' own headers."""
    phrases = F.array(*map(F.lit, ("", "Mixed: ", "split of ", "a separate commit: ", "separate ")))
    rows = label(s, d, "header").select("id", F.posexplode(phrases).alias("phrase", "p"), "header").withColumns({"message": F.concat(F.lit("fix: "), "p", F.coalesce("header", F.lit(""))), "want": F.lit(True)})
    scored = commits.with_score(rows, "message", expect_mixed="want")
    return scored.groupBy(F.col("phrase").cast("bigint").alias("phrase"), F.col("score.mixed_change_warning").alias("mixed")).agg(F.count(F.lit(1)).alias("labels"))


def score_report(s: SparkSession, d: str) -> DataFrame:
    rows = _scored(s, d).select(F.coalesce(split_name("data_split"), F.lit("NONE")).alias("split"), "score.*")
    return reports.tri_state(rows, ["format_validity", "scope_quality", "specificity", "brevity"], ["split"]).withColumn("split", F.coalesce("split", F.lit("ALL")))


def verifier(s: SparkSession, d: str) -> DataFrame:
    rows = _scored(s, d).withColumn("e", paths.evidence(F.col("evidence_paths"), F.col("changed_paths")))
    return rows.select("id", F.round(commits.verifier_score(F.col("score"), F.col("e.kept"), F.col("changed_paths")), 6).alias("verifier"), F.size("e.kept").cast("bigint").alias("kept"), F.size("e.dropped").cast("bigint").alias("dropped"))


def top_errors(s: SparkSession, d: str) -> DataFrame:
    # an inner explode would have its array computed again in an inferred filter
    return reports.top(_scored(s, d).select(F.explode_outer("score.errors").alias("error")).where("error is not null"), "error", 10)


def path_tokens(s: SparkSession, d: str) -> DataFrame:
    rows = label(s, d, "changed_paths").select(F.explode_outer(paths.tokens(F.col("changed_paths"))).alias("token")).where("token is not null")
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def path_flags(s: SparkSession, d: str) -> DataFrame:
    p = F.col("changed_paths")
    return label(s, d, "changed_paths").select(
        "id", F.exists(p, paths.is_docs).alias("docs"), F.exists(p, paths.is_tests).alias("tests"), F.exists(p, lambda x: paths.has_part(F.lower(x), ["snapshot", "snapshots", "baselines"])).alias("snapshots"),
        F.size(F.array_distinct(F.transform(p, paths.extension))).cast("bigint").alias("extensions"), paths.topic(paths.tokens(p)).alias("topic"),
    )


def glob_partition(s: SparkSession, d: str) -> DataFrame:
    globs = valid_rows(table(s, d, "source_manifest").select(repo_key("repo_url").alias("repo"), "exclude_globs", "_ord"), "repo", "exclude_globs").select("repo", globs_regex("exclude_globs").alias("rx"))
    rows = valid_rows(table(s, d, "generated_label").select("id", "_ord", repo_key("source_repo_url").alias("repo"), "changed_paths"), "id", "repo", "changed_paths").join(globs, "repo", "left")
    both = split_by_globs(F.col("changed_paths"), F.col("rx"))
    return rows.withColumn("b", both).select("id", F.size("b.included").cast("bigint").alias("included"), F.size("b.excluded").cast("bigint").alias("excluded"))


def repo_keys(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "generated_label")
    return rows.groupBy(repo_key("source_repo_url").alias("repo")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source_repo_url").alias("spellings"))


def change_ids(s: SparkSession, d: str) -> DataFrame:
    rows = label(s, d, "source_repo_url", "source_commit")
    return rows.select("id", paths.change_id(F.col("source_repo_url"), F.col("source_commit")).alias("change_id"), paths.without_prefix(F.col("id")).alias("source_diff_id"))


def _windows(s: SparkSession, d: str) -> DataFrame:
    cols = ("plan_id", "repo_url", "split", "start_at", "end_at", "target_records")
    w = valid_rows(table(s, d, "split_plan"), "id", *cols)
    start, end = (intervals.rfc3339(F.col(c)).alias(n) for c, n in (("start_at", "start"), ("end_at", "end")))
    return w.select("id", "plan_id", repo_key("repo_url").alias("repo"), split_name("split").alias("split"), start, end, "target_records")


def window_overlaps(s: SparkSession, d: str) -> DataFrame:
    return intervals.overlaps(_windows(s, d), ["plan_id", "repo"], "id").select("plan_id", "repo", "id")


def split_assign(s: SparkSession, d: str) -> DataFrame:
    """Labels by their generation time and the windows of their repository in all plans; the first window by plan and id holds."""
    w = _windows(s, d).withColumn("_ord", F.concat_ws("/", "plan_id", "id"))
    rows = valid_rows(table(s, d, "generated_label").select("id", "_ord", repo_key("source_repo_url").alias("repo"), intervals.rfc3339(F.col("generation_timestamp")).alias("at")), "id", "repo", "at")
    return intervals.assign_windows(rows, w, ["repo"], "at", ["id"]).groupBy("split").agg(F.count(F.lit(1)).alias("labels"), F.count_distinct("repo").alias("repos"))


def split_summary(s: SparkSession, d: str) -> DataFrame:
    return intervals.split_summary(_windows(s, d), ["DEV", "REPORT", "HELD_OUT"])


def repo_share(s: SparkSession, d: str) -> DataFrame:
    rows = valid_rows(table(s, d, "generated_label").select("id", "_ord", repo_key("source_repo_url").alias("repo")), "id", "repo")
    return intervals.largest_share(rows, "repo")


def gate_table(s: SparkSession, d: str) -> DataFrame:
    rows = valid_rows(table(s, d, "generated_label").select("id", "_ord", repo_key("source_repo_url").alias("repo"), split_name("data_split").alias("split")), "id", "repo", "split")
    one = rows.agg(F.count_if(F.col("split") == "DEV").alias("dev"), F.count_if(F.col("split") == "REPORT").alias("report"), F.count_distinct("repo").alias("repos"), F.sum(F.lit(None).cast("bigint")).alias("nothing"))
    bounds = [("dev_records", F.col("dev"), "min", 1000), ("report_records", F.col("report"), "min", 1_000_000), ("repos", F.col("repos"), "max", 1000), ("unmeasured", F.col("nothing"), "min", 1)]
    return lineage.gates(one, bounds)


def label_reference(s: SparkSession, d: str) -> DataFrame:
    """sequence_metadata against the labels it refers to: unknown labels, differing splits."""
    meta = valid_rows(table(s, d, "sequence_metadata"), "record_id", "source_diff_id", "data_split")
    ref = label(s, d, "data_split").select(paths.without_prefix(F.col("id")).alias("diff_id"), F.col("data_split").alias("label_split"))
    out = lineage.compare(meta, ref, "source_diff_id", "diff_id", {"data_split": "label_split"})
    return out.groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count(F.lit(1)).alias("records"))


def missing_sequences(s: SparkSession, d: str) -> DataFrame:
    want = label(s, d).select(paths.without_prefix(F.col("id")).alias("source_diff_id"))
    return lineage.missing(want, table(s, d, "sequence_metadata"), "source_diff_id")


def duplicate_labels(s: SparkSession, d: str) -> DataFrame:
    return dedup.duplicates(table(s, d, "generated_label"), "id")


def first_labels(s: SparkSession, d: str) -> DataFrame:
    return dedup.first_rows(table(s, d, "generated_label").select("id", "_ord", "header"), "id")


def merged_labels(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "generated_label").select("id", "source_commit", "_ord")
    kept, _ = dedup.merge_inputs([rows.where(F.col("_ord") % 2 == 1), rows.where(F.col("_ord") % 2 == 0)], "id", "source_commit")
    return kept.select("id", "source_commit", "_ord")


def per_repo_limit(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "generated_label").select(F.coalesce(repo_key("source_repo_url"), F.lit("")).alias("repo"), "id", "_ord")
    return dedup.limit_per_group(rows, ["repo"], [F.asc("_ord")], 5)


def doc_token_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.size(tokens.tokenize(F.col("text"))).cast("bigint").alias("tokens"))


def _streams(s: SparkSession, d: str) -> DataFrame:
    """Two-message records: a label's paths as the user's text, its message as the assistant's."""
    m = messages(s, d, "changed_paths", "data_split")
    user, reply = F.array_join("changed_paths", "\n"), F.col("message")
    chat = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), reply.alias("content")))
    return m.select("id", F.coalesce(split_name("data_split"), F.lit("NONE")).alias("data_split"), user.alias("user"), reply.alias("reply"), tokens.record_stream(chat).alias("tokens"))


#: The production sizes: a vocabulary of 32,000 (the default of build), contexts of 8,192 tokens, records of 65,536 at most.
CONTEXT, MOST = 8192, 65_536
#: The smallest context of a run, where documents are long enough to be cropped.
CROP_CONTEXT = 2048


def _vocabulary(rows: DataFrame) -> DataFrame:
    return vocabulary.build(vocabulary.token_counts(rows.where("data_split = 'DEV'")))


def vocabulary_top(s: SparkSession, d: str) -> DataFrame:
    return _vocabulary(_streams(s, d)).select("id", "token", "count")


def vocabulary_errors(s: SparkSession, d: str) -> DataFrame:
    """Contract of a vocabulary whose ids are shifted from the hundredth on and whose tokens are in lower case."""
    v = _vocabulary(_streams(s, d)).select((F.col("id") + F.when(F.col("id") >= 100, 1).otherwise(0)).alias("id"), F.lower("token").alias("token"))
    return records.vocabulary_errors(v, tokens.SPECIAL)


def token_coverage(s: SparkSession, d: str) -> DataFrame:
    rows = materialize(_streams(s, d).select("data_split", "tokens"), "streams")
    return vocabulary.coverage(rows, _vocabulary(rows))


def sequence_plan(s: SparkSession, d: str) -> DataFrame:
    rows = materialize(_streams(s, d).select("id", "data_split", "tokens"), "streams")
    planned = vocabulary.plan(vocabulary.with_unknown(rows, _vocabulary(rows), "id"), CONTEXT, MOST)
    return planned.select("id", "data_split", "raw_token_count", "unknown_token_count", "raw_sequences_at_context", "decision", "reason", "trainer_context_tokens", "trainer_tokens")


def sequence_accounting(s: SparkSession, d: str) -> DataFrame:
    """Documents as records: those of a repository train, the others evaluate."""
    rows = _documents(s, d).select(F.when(F.col("repo_url").isNotNull(), "DEV").otherwise("REPORT").alias("data_split"), "tokens")
    out = vocabulary.accounting(vocabulary.plan(rows, CROP_CONTEXT, CONTEXT))
    return out.withColumn("data_split", F.coalesce("data_split", F.lit("ALL")))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "repo_url", tokens.tokenize(F.col("text")).alias("tokens"))


def sequence_crop(s: SparkSession, d: str) -> DataFrame:
    """What a context of 2,048 tokens leaves of a document behind a system message and before its source's name, and the loss."""
    words = lambda c: tokens.tokenize(c)
    rows = table(s, d, "documents").select("doc_id", words(F.lit("Name the source.")).alias("s"), words(F.col("text")).alias("u"), words(F.coalesce("source", F.lit("none"))).alias("a"))
    r = rows.withColumn("c", tokens.crop(F.col("u"), F.lit(CROP_CONTEXT) - F.size("s") - F.size("a") - 8)).withColumn("r", tokens.render(F.col("s"), F.col("c"), F.col("a")))
    return r.select("doc_id", F.size("c").cast("bigint").alias("kept"), F.size("r.tokens").cast("bigint").alias("length"), F.aggregate("r.loss_mask", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("loss"), F.sha2(F.array_join("r.tokens", " "), 256).alias("sha256"))


def sequence_rows(s: SparkSession, d: str) -> DataFrame:
    """Labels as encoded sequences: the real materialiser with the vocabulary of DEV."""
    rows = _streams(s, d)
    chat = training.chat(F.lit("Commit messages."), F.col("user"), F.col("reply"))
    made = training.sequences(rows.select("id", chat.alias("messages")), _vocabulary(rows), CONTEXT, MOST)
    return made.select("id", "decision", F.col("raw_token_count").cast("bigint").alias("raw_token_count"), F.col("input_length").cast("bigint").alias("input_length"), F.col("loss_tokens").cast("bigint").alias("loss_tokens"), "unknown_tokens", "input_ids_sha256", "loss_mask_sha256", "crop.policy")


def input_hashes(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "sequence_metadata")
    ids = F.array(*[F.coalesce(F.col(c), F.lit(-1)).cast("int") for c in ("input_length", "loss_tokens", "unknown_tokens")])
    return rows.select("record_id", "_ord", tokens.ints_sha256(ids).alias("ids_sha256"), F.sha2("record_id", 256).alias("record_sha256"), tokens.hashed_bucket(F.col("_ord"), F.col("_ord") + 1, F.lit(0), 1000).alias("bucket"))


def type_matrix(s: SparkSession, d: str) -> DataFrame:
    rows = commits.with_parsed(messages(s, d, "changed_paths", "data_split"), "message").where((split_name("data_split") == "DEV") & F.col("parsed.type").isin(commits.TYPES))
    return models.train_path_types(rows.select("changed_paths", "parsed.type"))


def _typed(s: SparkSession, d: str) -> DataFrame:
    rows = commits.with_parsed(messages(s, d, "changed_paths", "data_split"), "message").where(F.col("parsed.type").isin(commits.TYPES))
    return materialize(rows.select("id", split_name("data_split").alias("split"), "changed_paths", "parsed.type"), "typed")


def predicted_types(s: SparkSession, d: str) -> DataFrame:
    rows = _typed(s, d)
    model = materialize(models.train_path_types(rows.where("split = 'DEV'")), "model")
    got = models.predict_path_types(rows.where("split = 'REPORT'"), model, "id")
    return got.join(rows.select("id", "type"), "id").select("id", "predicted", "subject", (F.col("predicted") == F.col("type")).alias("type_match"))


def prediction_report(s: SparkSession, d: str) -> DataFrame:
    """Predicted messages against the labels' own: exact and type matches, and valid predictions."""
    rows = commits.with_parsed(messages(s, d, "changed_paths", "data_split"), "message").where(F.col("parsed.type").isin(commits.TYPES)).withColumn("split", split_name("data_split"))
    rows = materialize(rows.select("id", "split", "changed_paths", "message", "parsed.type"), "typed")
    model = materialize(models.train_path_types(rows.where("split = 'DEV'")), "model")
    held = rows.where("split = 'REPORT'")
    made = models.predict_path_types(held, model, "id").select("id", F.concat("predicted", F.lit(": "), "subject").alias("prediction_message"))
    pairs = training.prediction_rows(held.withColumnRenamed("message", "target_message"), made)
    return pairs.agg(F.count(F.lit(1)).alias("records"), F.count_if("exact_match").alias("exact_match"), F.count_if("type_match").alias("type_match"), F.count_if("prediction_score.format_validity").alias("valid"), F.count_if("target_score.scope_quality").alias("target_scopes"))


def merge_report(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "generated_label").select("id", "source_commit", "_ord")
    return dedup.merge_inputs([rows.where(F.col("_ord") % 2 == 1), rows.where(F.col("_ord") % 2 == 0)], "id", "source_commit")[1]


def softmax_types(s: SparkSession, d: str) -> DataFrame:
    rows = _typed(s, d)
    model = materialize(models.train_softmax(rows.where("split = 'DEV'"), "id", "type"), "model")
    return models.predict_softmax(rows.where("split = 'REPORT'"), model, "id").join(rows.select("id", "type"), "id").select("id", "predicted", F.round("probability", 6).alias("probability"), (F.col("predicted") == F.col("type")).alias("type_match"))


def margin_weights(s: SparkSession, d: str) -> DataFrame:
    """The margin model of DEV's messages over the vocabulary's ids: 256 buckets, steps of 3, rows by their id."""
    rows = materialize(_streams(s, d).where("data_split = 'DEV'").select("id", "data_split", "tokens", tokens.tokenize(F.col("reply")).alias("a")), "streams")
    coded = vocabulary.encode(rows.select("id", "a"), _vocabulary(rows), "id", "a")
    return models.train_margin(coded.select(F.col("id").alias("_ord"), "ids", F.transform("ids", lambda _: F.lit(1)).alias("loss_mask")), 256, 3)


def queries() -> dict[str, Query]:
    own = [
        commit_parse, commit_score, mixed_messages, score_report, verifier, top_errors, path_tokens, path_flags, glob_partition, repo_keys, change_ids, window_overlaps, split_assign, split_summary, repo_share, gate_table, label_reference, missing_sequences,
        duplicate_labels, first_labels, merged_labels, merge_report, per_repo_limit, doc_token_counts, vocabulary_top, vocabulary_errors, token_coverage, sequence_plan, sequence_accounting, sequence_crop, sequence_rows, input_hashes, type_matrix, predicted_types, prediction_report, softmax_types, margin_weights,
    ]
    from quern.plans import stages

    return {f.__name__: f for f in own} | stages.queries()


def oracle_sql() -> dict[str, str]:
    from quern.plans import oracle, oracle_stages

    return oracle.SQL | oracle_stages.SQL
