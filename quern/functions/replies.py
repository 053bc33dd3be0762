"""Model replies: JSON objects inside text, and plain commit messages as a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.commits import HEADER, lines_of, with_parsed

# The fields of a reply and the warning that goes with a plain message; below, the marks of fences and think tags.
SCHEMA = "header string, body string, footers string, type string, scope string, confidence double, warnings string, evidence_paths array<string>"
RECOVERED = "teacher output was plain Conventional Commit text; normalized to JSON candidate"


def _unfenced(text: Column) -> Column:
    t = F.trim(text)
    inner = F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, "^```(?:[a-zA-Z0-9_-]+)?", "")), "```$", ""))
    return F.when(t.startswith("```"), inner).otherwise(t)


def _lines(value: Column) -> Column:
    """A list of strings, or a string's lines without blank ones; null for anything else."""
    listed = F.from_json(value, "array<string>")
    split = F.filter(F.transform(lines_of(value), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(value.rlike(r"(?s)^\s*\[.*\]\s*$"), listed).otherwise(split)


def with_candidate(df: DataFrame, reply: str, out: str = "candidate") -> DataFrame:
    """Adds out: struct(header, body, footers, type, scope, confidence, warnings, evidence_paths, error).

    Text between think tags and code fences don't count. The JSON object from the first { to the last
    } is read; without one, the first stretch of lines that parses as a commit message is taken, with
    confidence 0.5 and a warning. error says what is wrong with what is left; a null reply is empty.
    """
    text = _unfenced(F.regexp_replace(F.coalesce(F.col(reply), F.lit("")), r"(?s)<think>.*?</think>", ""))
    d = df.withColumn("_text", text).withColumn("_json", F.regexp_extract("_text", r"(?s)(\{.*\})", 1))
    d = d.withColumn("_obj", F.when(F.col("_json") != "", F.from_json("_json", SCHEMA)))
    decoded = F.get_json_object(F.concat(F.lit('{"v":'), F.col("_text"), F.lit("}")), "$.v")
    plain = F.when(F.col("_text").rlike(r'(?s)^".*"$'), F.trim(F.coalesce(decoded, F.col("_text")))).otherwise(F.col("_text"))
    d = d.withColumn("_lines", lines_of(plain))
    at = F.array_position(F.transform("_lines", lambda x: F.trim(x).rlike(HEADER)), True)
    message = F.when(at > 0, _unfenced(F.array_join(F.concat(F.array(F.trim(F.get("_lines", (at - 1).cast("int")))), F.slice("_lines", (at + 1).cast("int"), F.size("_lines"))), "\n")))
    # a fence may close after the message
    d = with_parsed(d.withColumn("_message", F.regexp_replace(message, r"\s*```\s*$", "")), "_message", "_parsed")
    p = F.col("_parsed")
    found = F.when((F.col("_json") == "") & p["error"].isNull(), True).otherwise(False)
    o = F.col("_obj")
    pick = lambda a, b: F.when(found, a).otherwise(b)
    none = F.array().cast("array<string>")
    header = pick(F.get(lines_of(F.col("_message")), F.lit(0)), o["header"])
    error = (
        F.when((F.col("_json") == "") & ~found, "teacher output did not contain a JSON object")
        .when(~found & (o.isNull() | (F.coalesce(o["header"], F.lit("")) == "")), "teacher output header must be a non-empty string")
        .when(~found & o["confidence"].isNull(), "teacher output confidence must be numeric")
    )
    cand = F.struct(
        header.alias("header"), pick(p["body"], _lines(o["body"])).alias("body"), pick(p["footers"], _lines(o["footers"])).alias("footers"), pick(p["type"], o["type"]).alias("type"), pick(p["scope"], o["scope"]).alias("scope"),
        pick(F.lit(0.5), F.when(o["confidence"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), o["confidence"])))).alias("confidence"), pick(F.array(F.lit(RECOVERED)), _lines(o["warnings"])).alias("warnings"), pick(none, F.coalesce(o["evidence_paths"], none)).alias("evidence_paths"), error.alias("error"),
    )
    return d.withColumn(out, cand).drop("_text", "_json", "_obj", "_lines", "_message", "_parsed")
