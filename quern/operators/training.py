"""Training rows from labels and their inputs, and token sequences from training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.commits import format_message, with_score
from quern.functions.tokens import ROLES, decision, ints_sha256, tokenize
from quern.operators.vocabulary import encode

STRING = "array<string>"


def chat(system: Column, user: Column, assistant: Column) -> Column:
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(one("system", system), one("user", user), one("assistant", assistant))


def training_rows(labels: DataFrame, inputs: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """Labels joined with the inputs they answer, edits over labels, as chat rows with an errors column.

    labels: id = generated-<source_diff_id>, header, body, footers. inputs: source_diff_id, system,
    user and further columns, one row per id. edits: label_id, edited_header, edited_body,
    edited_footers; null fields change nothing. errors says what is missing; see all_or_nothing.
    """
    key = F.regexp_replace("id", "^generated-", "")
    rows = labels.select(key.alias("source_diff_id"), F.col("id").alias("label_id"), "header", "body", "footers")
    if edits is not None:
        rows = rows.join(edits.select("label_id", "edited_header", "edited_body", "edited_footers"), "label_id", "left")
    else:
        rows = rows.withColumns({"edited_header": F.lit(None).cast("string"), "edited_body": F.lit(None).cast(STRING), "edited_footers": F.lit(None).cast(STRING)})
    given = inputs.withColumn("_there", F.lit(True))
    j = rows.join(given, "source_diff_id", "left")
    target = format_message(F.coalesce("edited_header", "header"), F.coalesce("edited_body", "body"), F.coalesce("edited_footers", "footers"))
    errors = F.array_compact(F.array(F.when(F.col("_there").isNull(), F.concat(F.lit("no input for "), "label_id")), F.when(F.coalesce(F.length("header"), F.lit(0)) == 0, F.concat(F.lit("no header in "), "label_id"))))
    j = j.withColumn("target_message", target).withColumn("messages", chat(F.col("system"), F.col("user"), F.col("target_message")))
    more = [c for c in inputs.columns if c not in ("source_diff_id", "system", "user")]
    return j.select(F.concat(F.lit("sft-"), "source_diff_id").alias("id"), "source_diff_id", "label_id", "target_message", "messages", *more, errors.alias("errors"))


def inspection_rows(rows: DataFrame, labels: DataFrame, paths: str = "changed_paths") -> DataFrame:
    """Training rows with the scores of their target, the label's own message and the historical subject, side by side."""
    own = labels.select(F.col("id").alias("label_id"), format_message(F.col("header"), F.col("body"), F.col("footers")).alias("teacher_message"))
    j = rows.join(own, "label_id", "left")
    for message, out in (("target_message", "target_score"), ("teacher_message", "teacher_score"), ("historical_subject", "historical_score")):
        if message in j.columns:
            j = with_score(j, message, out, paths=paths)
    return j.withColumn("changed_from_teacher", ~F.col("target_message").eqNullSafe(F.col("teacher_message")))


def sequences(rows: DataFrame, vocabulary: DataFrame, context: int, most: int, key: str = "id") -> DataFrame:
    """(key, decision, input_ids, loss_mask, hashes, counts, crop, error) of chat rows.

    Messages of roles other than system, user and assistant make a row an error, as does a row
    without an assistant, or one to be cropped without exactly one user message or with more system
    and assistant tokens than the context holds. Rows above `most` tokens are excluded. A crop keeps
    the first half of the budget, rounded up, and the last half of the user's tokens.
    """
    blocks = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), tokenize(m["content"]).alias("t")))
    d = rows.select(key, blocks.alias("b"))
    add = lambda cond: F.aggregate("b", F.lit(0), lambda a, x: a + F.when(cond(x), F.size(x["t"])).otherwise(0))
    d = d.withColumns({"raw": add(lambda x: F.lit(True)) + 2 * F.size("b") + 2, "user_raw": add(lambda x: x["role"] == "user"), "users": F.size(F.filter("b", lambda x: x["role"] == "user"))})
    d = d.withColumn("decision", decision(F.col("raw"), context, most)).withColumn("budget", F.lit(context) - (F.col("raw") - F.col("user_raw")))
    cut = F.col("decision") == "use_truncated"
    error = (
        F.when(F.exists("b", lambda x: ~F.coalesce(x["role"].isin(ROLES), F.lit(False))), "message with an unknown role")
        .when(~F.exists("b", lambda x: x["role"] == "assistant"), "record has no assistant message")
        .when(cut & (F.col("users") != 1), "truncated records must contain exactly one user message")
        .when(cut & (F.col("budget") < 0), "preserved system and assistant tokens exceed context_tokens")
    )
    d = d.withColumn("error", error)
    head = F.floor((F.greatest("budget", F.lit(0)) + 1) / 2).cast("int")
    tail = (F.greatest("budget", F.lit(0)) - head).cast("int")
    d = d.withColumns({"prefix": F.when(cut, head).otherwise(F.col("user_raw")), "suffix": F.when(cut, tail).otherwise(0)})

    def words(x: Column) -> Column:
        cropped = F.concat(F.slice(x["t"], F.lit(1), F.col("prefix")), F.when(F.col("suffix") > 0, F.slice(x["t"], -F.greatest(F.col("suffix"), F.lit(1)), F.col("suffix"))).otherwise(F.array().cast(STRING)))
        return F.when(cut & (x["role"] == "user"), cropped).otherwise(x["t"])

    kept = d.where(F.col("error").isNull() & (F.col("decision") != "exclude_oversize"))
    kept = kept.withColumn("w", F.transform("b", lambda x: F.struct(x["role"].alias("role"), words(x).alias("t"))))
    marker = lambda x: F.array(F.concat(F.lit("<"), x["role"], F.lit(">")))
    stream = F.concat(F.array(F.lit("<bos>")), F.flatten(F.transform("w", lambda x: F.concat(marker(x), x["t"], F.array(F.lit("<sep>"))))), F.array(F.lit("<eos>")))
    on = lambda x: (x["role"] == "assistant").cast("int")
    mask = F.concat(F.array(F.lit(0)), F.flatten(F.transform("w", lambda x: F.concat(F.array(F.lit(0)), F.array_repeat(on(x), F.size(x["t"]) + 1)))), F.array(F.lit(1)))
    made = encode(kept.select(key, stream.alias("tokens"), mask.alias("loss_mask")), vocabulary, key)
    made = made.select(key, F.col("ids").alias("input_ids"), "loss_mask", "unknown_tokens", F.size("tokens").alias("input_length"), F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x).alias("loss_tokens"), ints_sha256(F.col("ids")).alias("input_ids_sha256"), ints_sha256(F.col("loss_mask")).alias("loss_mask_sha256"))
    crop = F.struct(F.when(F.col("suffix") + F.col("prefix") < F.col("user_raw"), "deterministic_prefix_suffix").otherwise("full").alias("policy"), F.col("user_raw").alias("user_raw_tokens"), (F.col("prefix") + F.col("suffix")).alias("user_kept_tokens"), F.col("prefix").alias("user_prefix_tokens"), F.col("suffix").alias("user_suffix_tokens"))
    return d.select(key, F.col("raw").alias("raw_token_count"), "decision", "error", F.when(F.col("error").isNull(), crop).alias("crop")).join(made, key, "left")


def stale(rows: DataFrame, recorded: DataFrame, key: str = "id") -> DataFrame:
    """(key, reason) of sequences whose recorded hashes or lengths aren't what they are now, or that aren't recorded."""
    r = recorded.select(key, *[F.col(c).alias(f"_{c}") for c in ("input_ids_sha256", "loss_mask_sha256", "input_length", "loss_tokens")], F.lit(True).alias("_there"))
    j = rows.where("input_ids is not null").join(r, key, "left")
    reason = F.when(F.col("_there").isNull(), "not recorded")
    for c in ("input_length", "loss_tokens", "input_ids_sha256", "loss_mask_sha256"):
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"{c} differs")
    return j.withColumn("reason", reason).where("reason is not null").select(key, "reason")


def prediction_rows(rows: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """(key, target_message, prediction_message, exact_match, type_match, both scores): a missing type matches a missing one."""
    j = rows.join(predictions.select(key, "prediction_message"), key)
    j = with_score(with_score(j, "target_message", "target_score", paths="changed_paths"), "prediction_message", "prediction_score", paths="changed_paths")
    same = F.col("prediction_score.parsed.type").eqNullSafe(F.col("target_score.parsed.type"))
    return j.select(key, "target_message", "prediction_message", (F.col("prediction_message") == F.col("target_message")).alias("exact_match"), same.alias("type_match"), "target_score", "prediction_score")
