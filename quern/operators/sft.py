"""From reviewed labels to training rows: the four-way join with its checks, and the lineage of what it made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.commits import format_message, verifier_score, with_score
from quern.functions.paths import evidence, without_prefix
from quern.functions.replies import with_candidate
from quern.operators import records
from quern.operators.training import chat

# The fields that rows of neighbouring stages share, and where a reviewed label comes from.
DIFF_FIELDS = ["source_repo_url", "source_license", "source_commit", "parent_commit", "data_split", "changed_paths"]
TEACHER_FIELDS = ["teacher_model_id", "teacher_runtime", "teacher_runtime_model_id", "teacher_revision", "teacher_license", "teacher_size", "teacher_context_length", "prompt_version", "decoding_config"]
LABEL_SOURCES = {"accept": "teacher_generated_human_accepted", "edit": "teacher_generated_human_edited"}


def _of(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name struct): the last row of every key by _ord, equal ones decided by their values' hash; null keys are left out."""
    columns = [c for c in rows.columns if c != "_ord"]
    hashed = [c for c, t in rows.dtypes if "map<" not in t]
    last = F.max_by(F.struct(*columns), F.struct("_ord", F.xxhash64(*hashed)))
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{name}_key")).agg(last.alias(name))


def _checked(rows: DataFrame, rules: list[Column], out: str) -> DataFrame:
    """rows with their own errors in out, found before any join so that each row is checked once."""
    return records.with_errors(rows, rules, out)


def review_errors(reviews: DataFrame, source: DataFrame, key: str, fields: list[str], rules: list[Column], what: str) -> DataFrame:
    """reviews with errors: their own, a second review of a row, an unknown row, or every field that isn't the row's.

    key: the review's column that names a row of source (by id). Of rows with one id the last counts.
    """
    say = F.concat(F.lit(f"duplicate review for {key}: "), key)
    r = records.repeated(_checked(reviews, rules, "_own"), F.col(key), say)
    j = r.join(_of(source.select("id", "_ord", *fields), "id", "_s"), F.col(key) == F.col("__s_key"), "left")
    unknown = F.when(F.col("__s_key").isNull(), F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key), F.lit("None"))))
    differ = [F.when(F.col("__s_key").isNotNull(), d) for d in records.unequal(fields, lambda f: F.col(f"_s.{f}"), what)]
    return j.withColumn("errors", F.concat("_own", F.array_compact(F.array(F.col("repeated"), unknown, *differ)))).drop("_own", "repeated", "_s", "__s_key")


def input_errors(inputs: DataFrame, sources: DataFrame, accepted: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Teacher inputs with errors against the source rows (id) and the accepted ids (source_diff_id).

    A row of an unknown or not accepted source isn't compared field by field.
    """
    fields = [*DIFF_FIELDS, "diff_stat", "historical_subject"]
    say = F.concat(F.lit("duplicate teacher input for source_diff_id: "), "source_diff_id")
    r = records.repeated(_checked(inputs, records.input_rules(statuses), "_own"), F.col("source_diff_id"), say)
    ok = accepted.select(F.col("source_diff_id").alias("_ok")).where("_ok is not null").distinct()
    j = r.join(_of(sources.select("id", "_ord", *fields), "id", "_s"), F.col("source_diff_id") == F.col("__s_key"), "left").join(ok, F.col("source_diff_id") == F.col("_ok"), "left")
    known, taken = F.col("__s_key").isNotNull(), F.col("_ok").isNotNull()
    name = F.coalesce(F.col("source_diff_id"), F.lit("None"))
    first = F.when(~known, F.concat(F.lit("unknown source_diff_id: "), name)).when(~taken, F.concat(F.lit("source_diff_id is not accepted for teacher labeling: "), name))
    differ = [F.when(known & taken, d) for d in records.unequal(fields, lambda f: F.col(f"_s.{f}"), "source diff record")]
    return j.withColumn("errors", F.concat("_own", F.array_compact(F.array(first, *differ, F.col("repeated"), records.digest_rule())))).drop("_own", "repeated", "_s", "__s_key", "_ok")


def _against_input(inp: str) -> list[Column]:
    """A label's messages against its input, a struct column."""
    i = lambda f: F.col(f"{inp}.{f}")
    same = [F.when(~_same(f, F.col(f), i(f)), F.lit(f"{f} does not match teacher input")) for f in [*DIFF_FIELDS, *TEACHER_FIELDS]]
    strange = F.array_sort(F.array_distinct(F.array_except("evidence_paths", i("changed_paths"))))
    wrong_id = F.when(F.col("id") != F.concat(F.lit("generated-"), i("source_diff_id")), F.lit("id does not match teacher input source_diff_id"))
    return [wrong_id, *same, F.when(F.size(strange) > 0, F.concat(F.lit("evidence_paths not present in changed_paths: "), records.said(strange)))]


def _same(field: str, a: Column, b: Column) -> Column:
    """Null-safe equality; maps are compared as sorted entries."""
    if field == "decoding_config":
        a, b = (F.array_sort(F.map_entries(x)) for x in (a, b))
    return a.eqNullSafe(b)


def label_input_errors(labels: DataFrame, inputs: DataFrame, statuses: list[str] | None = None, complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """(labels with errors, ids that have no label): labels against the inputs they answer, and the other way round.

    complete: an input without a label counts as missing; otherwise the second table is empty.
    """
    fields = ["source_diff_id", *DIFF_FIELDS, *TEACHER_FIELDS]
    r = records.repeated(_checked(labels, records.label_rules(statuses), "_own"), F.col("id"), F.concat(F.lit("duplicate generated label id: "), "id"))
    j = r.join(_of(inputs.select("_ord", *fields), "source_diff_id", "_i"), without_prefix(F.col("id")) == F.col("__i_key"), "left")
    known = F.col("__i_key").isNotNull()
    unknown = F.when(~known, F.lit("no matching teacher input"))
    out = j.withColumn("errors", F.concat("_own", F.array_compact(F.array(unknown, *[F.when(known, e) for e in _against_input("_i")], F.col("repeated"))))).drop("_own", "repeated", "_i", "__i_key")
    want = inputs.where("source_diff_id is not null").select(F.concat(F.lit("generated-"), "source_diff_id").alias("id")).distinct()
    return out, want.join(labels.select("id"), "id", "left_anti") if complete else want.limit(0)


def sft_rows(reviews: DataFrame, labels: DataFrame, inputs: DataFrame, sources: DataFrame, artifact: str, version: str, instruction: str, label_sources: dict[str, str] | None = None) -> DataFrame:
    """Training rows of reviewed labels, with errors: a row per review.

    Reviews are joined with their label, the input it answers and the source row, of each the last
    with its key. errors has the review's own, those of every joined row and those between them, in
    that order. Rows without errors whose decision isn't in label_sources are no training rows and
    are left out; rows with errors always stay, so that all_or_nothing can refuse the whole table.
    Labels that nobody reviewed are found with lineage.missing.
    """
    taken = label_sources or LABEL_SOURCES
    r = records.repeated(_checked(reviews, records.label_review_rules(), "_own"), F.col("generated_label_id"), F.concat(F.lit("duplicate review for generated_label_id: "), "generated_label_id"))
    r = r.select(F.struct(*reviews.columns).alias("r"), "_own", "repeated")
    l = _of(_checked(labels, records.label_rules(), "_own"), "id", "l")  # noqa: E741
    i = _of(_checked(inputs, records.input_rules(), "_own"), "source_diff_id", "i")
    s = _of(_checked(sources, records.source_rules(), "_own"), "id", "s")
    j = r.join(l, F.col("r.generated_label_id") == F.col("_l_key"), "left").withColumn("_diff", without_prefix(F.col("l.id")))
    j = j.join(i, F.col("_diff") == F.col("_i_key"), "left").join(s, F.col("_diff") == F.col("_s_key"), "left")
    label_there, input_there, source_there = (F.col(f"_{k}_key").isNotNull() for k in "lis")
    missing = lambda what: F.concat(F.lit(f"missing {what} for source_diff_id: "), "_diff")
    none = F.array().cast("array<string>")
    named = j.withColumns({c: F.col(f"l.{c}") for c in ("id", "evidence_paths", *DIFF_FIELDS, *TEACHER_FIELDS)})
    decision, header, body = F.col("r.decision"), F.col("r.edited_header"), F.col("r.edited_body")
    edited = header.isNotNull() | body.isNotNull()
    errors = F.concat(
        F.col("_own"), F.array_compact(F.array(F.col("repeated"), F.when(~label_there, F.concat(F.lit("unknown generated_label_id: "), F.coalesce("r.generated_label_id", F.lit("None")))))),
        F.when(
            label_there,
            F.concat(
                F.array_compact(F.array(F.when(~input_there, missing("teacher input")), F.when(~source_there, missing("source diff")))),
                F.when(input_there, F.concat(F.col("i._own"), F.col("l._own"), F.array_compact(F.array(*_against_input("i"))))).otherwise(none), F.when(source_there, F.col("s._own")).otherwise(none),
                F.array_compact(F.array(
                    F.when(decision == "needs_review", F.lit("generated label review is still needs_review")), F.when((decision == "edit") & ~edited, F.lit("edit review must provide edited_header or edited_body")),
                    F.when((decision == "accept") & edited, F.lit("accept review must not include edited text")),
                )),
            ),
        ).otherwise(none),
    )
    j = named.withColumn("errors", errors).where((F.size("errors") > 0) | decision.isin(list(taken)))
    source_of = F.element_at(F.create_map(*[F.lit(x) for kv in taken.items() for x in kv]), decision)
    j = j.withColumns({"target_header": F.coalesce(header, "l.header"), "target_body": F.coalesce(body, "l.body"), "target_footers": F.col("l.footers")})
    j = j.withColumn("target_message", format_message(F.col("target_header"), F.col("target_body"), F.col("target_footers")))
    given = {"artifact_name": F.lit(artifact), "artifact_version": F.lit(version), "instruction": F.lit(instruction), "label_source": source_of, "review_decision": decision}
    ids = {"id": F.concat(F.lit("sft-"), "s.id"), "source_diff_id": F.col("s.id"), "teacher_input_id": F.col("i.id"), "generated_label_id": F.col("r.generated_label_id"), "generated_label_review_id": F.col("r.id")}
    taken_over = {f"s.{c}": c for c in (*DIFF_FIELDS, "diff_stat", "historical_subject")} | {f"i.{c}": c for c in ("diff", "diff_sha256")} | {f"r.{c}": n for c, n in (("issues", "review_issues"), ("notes", "review_notes"), ("reviewer", "reviewer"), ("review_timestamp", "review_timestamp"))}
    taken_over |= {f"l.{c}": c for c in (*TEACHER_FIELDS, "generation_timestamp", "confidence", "verifier_score", "evidence_paths", "warnings", "parser_result")}
    talk = chat(F.col("i.system_message"), F.col("i.user_message"), F.col("target_message"))
    return j.select(*[c.alias(n) for n, c in (ids | given).items()], *[F.col(c).alias(n) for c, n in taken_over.items()], talk.alias("messages"), "target_header", "target_body", "target_footers", "target_message", "errors")


def lineage_errors(rows: DataFrame, labels: DataFrame, reviews: DataFrame, inputs: DataFrame, rules: list[Column]) -> DataFrame:
    """(id, errors) of training rows: their own rules, repeated ids, unknown label, review or input, and every field that differs from theirs.

    Training rows carry _ord. Fields are compared only where label, review and input are all known.
    """
    r = records.repeated(_checked(rows, rules, "_own"), F.col("id"), F.concat(F.lit("duplicate training id: "), "id"), out="_again")
    r = records.repeated(r, F.col("generated_label_id"), F.concat(F.lit("duplicate generated_label_id: "), "generated_label_id"), out="_twice")
    l = _of(labels, "id", "l")  # noqa: E741
    v = _of(reviews, "generated_label_id", "v")
    i = _of(inputs, "source_diff_id", "i")
    j = r.join(l, F.col("generated_label_id") == F.col("_l_key"), "left").join(v, F.col("generated_label_id") == F.col("_v_key"), "left").join(i, F.col("source_diff_id") == F.col("_i_key"), "left")
    there = {k: F.col(f"_{k}_key").isNotNull() for k in "lvi"}
    every = there["l"] & there["v"] & there["i"]
    name = lambda c: F.coalesce(F.col(c), F.lit("None"))
    fields = [f for f in [*DIFF_FIELDS, *TEACHER_FIELDS] if f not in ("teacher_size", "teacher_context_length")]
    of = lambda k, a, b, say: F.when(~F.col(a).eqNullSafe(F.col(f"{k}.{b}")), F.lit(say))
    decision = F.col("v.decision")
    found = [
        F.col("_again"), F.col("_twice"), F.when(~there["l"], F.concat(F.lit("unknown generated_label_id: "), name("generated_label_id"))),
        F.when(~there["v"], F.concat(F.lit("missing review for generated_label_id: "), name("generated_label_id"))).when(~F.col("v.id").eqNullSafe(F.col("generated_label_review_id")), F.lit("generated_label_review_id does not match review record")),
        F.when(~there["i"], F.concat(F.lit("unknown source_diff_id: "), name("source_diff_id"))).when(~F.col("i.id").eqNullSafe(F.col("teacher_input_id")), F.lit("teacher_input_id does not match teacher input")),
    ]
    compared = [
        *[F.when(~_same(f, F.col(f), F.col(f"l.{f}")), F.lit(f"{f} does not match generated label")) for f in fields], *[of("i", f, f, f"{f} does not match teacher input") for f in ("diff", "diff_sha256")],
        of("v", "review_decision", "decision", "review_decision does not match review"), of("v", "reviewer", "reviewer", "reviewer does not match review"), of("v", "review_timestamp", "review_timestamp", "review_timestamp does not match review"),
        F.when(decision == "accept", of("l", "target_header", "header", "accepted target_header does not match generated label")),
        F.when((decision == "edit") & F.col("v.edited_header").isNotNull(), of("v", "target_header", "edited_header", "edited target_header does not match review")),
        F.when((decision == "edit") & F.col("v.edited_body").isNotNull(), of("v", "target_body", "edited_body", "edited target_body does not match review")), of("l", "target_footers", "footers", "target_footers does not match generated label"),
    ]
    errors = F.concat("_own", F.array_compact(F.array(*found, *[F.when(every, c) for c in compared])))
    return j.select("id", errors.alias("errors"))


def label_rows(inputs: DataFrame, replies: DataFrame, stamp: Column) -> DataFrame:
    """Labels from a model's replies (source_diff_id, reply): the candidate read leniently, its evidence cut to the changed paths, scored and verified.

    error says why a reply gave no label; its other fields are null then. stamp: the time of generation.
    """
    own = [*DIFF_FIELDS, *TEACHER_FIELDS]
    j = with_candidate(inputs.select("source_diff_id", *own).join(replies.select("source_diff_id", "reply"), "source_diff_id"), "reply", "c")
    none = F.array().cast("array<string>")
    j = j.withColumn("e", evidence(F.coalesce("c.evidence_paths", none), F.col("changed_paths")))
    lines = lambda c: F.coalesce(F.col(c), none)
    j = j.withColumn("_message", F.array_join(F.concat(F.array(F.coalesce("c.header", F.lit(""))), lines("c.body"), lines("c.footers")), "\n"))
    j = with_score(j, "_message", "s", paths="changed_paths")
    dropped = F.when(F.size("e.dropped") > 0, F.array(F.concat(F.lit("dropped evidence_paths not present in changed_paths: "), F.array_join("e.dropped", ", ")))).otherwise(none)
    ok = lambda c: F.when(F.col("c.error").isNull(), c)
    signals = ["body_presence", "breaking_change_detection", "brevity", "errors", "factuality", "format_validity", "footer_presence", "mixed_change_warning", "scope_quality", "specificity", "type_accuracy"]
    return j.select(
        F.concat(F.lit("generated-"), "source_diff_id").alias("id"), *own, stamp.alias("generation_timestamp"), ok(F.col("c.header")).alias("header"), ok(lines("c.body")).alias("body"), ok(lines("c.footers")).alias("footers"),
        ok(F.coalesce(F.nullif("c.type", F.lit("")), "s.parsed.type", F.lit(""))).alias("type"), ok(F.col("c.scope")).alias("scope"), ok(F.col("c.confidence")).alias("confidence"), ok(F.concat(lines("c.warnings"), dropped)).alias("warnings"), ok(F.col("e.kept")).alias("evidence_paths"),
        ok(F.struct(*[F.col(f"s.{x}").alias(x) for x in signals])).alias("parser_result"), ok(verifier_score(F.col("s"), F.col("e.kept"), F.col("changed_paths"))).alias("verifier_score"), F.lit("not_reviewed").alias("human_review_status"), F.col("c.error").alias("error"),
    )


def generation_report(inputs: DataFrame, existing: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: input, generated, skipped_existing and failed records. labels: label_rows of the inputs that had none."""
    there = existing.select("id").distinct().withColumn("_there", F.lit(True))
    made = labels.select("id", F.col("error").isNull().alias("_made"))
    j = inputs.select(F.concat(F.lit("generated-"), "source_diff_id").alias("id")).join(there, "id", "left").join(made, "id", "left")
    return j.agg(F.count(F.lit(1)).alias("input_records"), F.count_if("_made").alias("generated_records"), F.count_if(F.col("_there").isNotNull()).alias("skipped_existing_records"), F.count_if(F.col("_there").isNull() & ~F.coalesce("_made", F.lit(False))).alias("failed_records"))


def review_rows(rows: DataFrame, kind: str, fields: list[str], name: str, reviewer: str, edits: bool = False) -> DataFrame:
    """Rows for a review to fill in: an open decision for every row. kind: the column that names the reviewed row's id."""
    none = F.array().cast("array<string>")
    more = {"issues": none, "edited_header": F.lit(None).cast("string"), "edited_body": F.lit(None).cast("array<string>")} if edits else {"reasons": none}
    prefix = "generated-label" if edits else "source-diff"
    return rows.select(
        F.concat(F.lit("review-"), "id").alias("id"), F.col("id").alias(kind), *fields, F.lit("needs_review").alias("decision"), *[c.alias(n) for n, c in more.items()], F.lit("").alias("notes"), F.lit(reviewer).alias("reviewer"), F.lit("TBD").alias("review_timestamp"), F.lit(f"{prefix}-{name}-review-v0.1").alias("review_protocol"),
    )


def teacher_inputs(reviews: DataFrame, sources: DataFrame, diffs: DataFrame, message: Column, accepted: str, teacher: dict[str, Column], system: str) -> DataFrame:
    """Inputs of accepted reviews: the source row, its diff and the rendered message, with errors where the source or diff is missing.

    diffs: (id, diff); message: the user's message over columns repository, source_license,
    changed_paths, diff_stat and diff; teacher: the fields of the model that will answer.
    """
    fields = [*DIFF_FIELDS, "diff_stat", "historical_subject"]
    r = reviews.where(F.col("decision") == accepted).select(F.col("id").alias("review_decision_id"), "source_diff_id")
    j = r.join(_of(sources.select("id", "_ord", *fields), "id", "s"), F.col("source_diff_id") == F.col("_s_key"), "left").join(diffs.select(F.col("id").alias("_d"), "diff"), F.col("source_diff_id") == F.col("_d"), "left")
    j = j.select("review_decision_id", "source_diff_id", *[F.col(f"s.{f}").alias(f) for f in fields], "diff", F.col("s.source_repo_url").alias("repository"), F.col("_s_key").isNotNull().alias("_known"))
    errors = F.array_compact(F.array(F.when(~F.col("_known"), F.concat(F.lit("unknown source_diff_id: "), "source_diff_id")), F.when(F.col("diff").isNull(), F.concat(F.lit("no diff for source_diff_id: "), "source_diff_id"))))
    given = {"system_message": F.lit(system), "user_message": message, "diff_sha256": F.sha2("diff", 256), "input_status": F.lit("ready_for_generation")}
    return j.select(F.concat(F.lit("teacher-input-"), "source_diff_id").alias("id"), "source_diff_id", "review_decision_id", *fields, *[c.alias(n) for n, c in teacher.items()], "diff", *[c.alias(n) for n, c in given.items()], errors.alias("errors"))
