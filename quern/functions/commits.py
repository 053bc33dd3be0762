"""Commit messages: parsing and scoring as column expressions, no Python in the data path.

A message is a header `type(scope)!: subject`, then body lines, then footer lines from the first line
that looks like a footer. Signals are true, false, or null where nothing is expected of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grammar, the known types and the phrases that say nothing.
HEADER = r"^([a-z][a-z0-9-]*)(?:\(([^()\r\n]+)\))?(!)?: ([^\r\n]+)$"
FOOTER = r"^(BREAKING CHANGE|[A-Za-z-]+)(: | #).+"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
TYPES = ["build", "chore", "ci", "docs", "feat", "fix", "perf", "refactor", "revert", "style", "test"]
VAGUE = ["change files", "changes", "fix", "fix bug", "fix issue", "misc", "update", "update files", "updates", "wip", "work in progress"]
MAX_SUBJECT = 72

SIGNALS = ["format_validity", "type_accuracy", "scope_quality", "factuality", "specificity", "brevity", "body_presence", "footer_presence", "mixed_change_warning", "breaking_change_detection"]

_SPACES = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def lines_of(text: Column) -> Column:
    """The lines of a text under every line separator; a separator at the end starts no line."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def format_message(header: Column, body: Column, footers: Column) -> Column:
    """header, and body and footers behind a blank line each where they have lines (null lists have none)."""
    none = F.array().cast("array<string>")
    section = lambda c: F.when(F.size(F.coalesce(c, none)) > 0, F.concat(F.array(F.lit("")), c)).otherwise(none)
    return F.array_join(F.concat(F.array(header), section(body), section(footers)), "\n")


def plain_message(header: Column, body: Column, footers: Column) -> Column:
    """header, body and footers line by line without blank lines between them."""
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(header), F.coalesce(body, none), F.coalesce(footers, none)), "\n")


def with_parsed(df: DataFrame, message: str, out: str = "parsed") -> DataFrame:
    """Adds out: struct(raw, type, scope, subject, body, footers, breaking, error).

    error is null for a parsed message; otherwise it says why and the other fields but raw are null.
    A null message is an empty one.
    """
    raw = F.regexp_replace(F.coalesce(F.col(message), F.lit("")), r"^\n+|\n+$", "")
    d = df.withColumn("_raw", raw).withColumn("_lines", lines_of(F.col("_raw")))
    d = d.withColumn("_head", F.coalesce(F.get("_lines", F.lit(0)), F.lit("")))
    d = d.withColumn("_rest", F.slice("_lines", F.lit(2), F.greatest(F.size("_lines"), F.lit(1))))
    d = d.withColumn("_foot", F.array_position(F.transform("_rest", lambda x: x.rlike(FOOTER)), True))
    error = F.when(F.size("_lines") == 0, "empty commit message").when(~F.col("_head").rlike(HEADER), "invalid Conventional Commit header")
    d = d.withColumn("_error", error)
    ok = lambda c: F.when(F.col("_error").isNull(), c)
    none = F.array().cast("array<string>")
    body = F.when(F.col("_foot") == 0, F.col("_rest")).otherwise(F.slice("_rest", F.lit(1), F.greatest(F.col("_foot") - 1, F.lit(0)).cast("int")))
    d = d.withColumn("_footers", F.when(F.col("_foot") > 0, F.slice("_rest", F.greatest(F.col("_foot"), F.lit(1)).cast("int"), F.size("_rest"))).otherwise(none))
    part = lambda i: F.regexp_extract("_head", HEADER, i)
    breaking = (part(3) == "!") | F.exists("_footers", lambda x: x.startswith("BREAKING CHANGE:"))
    parsed = F.struct(
        F.col("_raw").alias("raw"),
        ok(part(1)).alias("type"),
        ok(F.nullif(part(2), F.lit(""))).alias("scope"),
        ok(F.regexp_replace(part(4), _SPACES, "")).alias("subject"),
        ok(body).alias("body"),
        ok(F.col("_footers")).alias("footers"),
        ok(breaking).alias("breaking"),
        F.col("_error").alias("error"),
    )
    return d.withColumn(out, parsed).drop("_raw", "_lines", "_head", "_rest", "_foot", "_footers", "_error")


def scope_visible(scope: Column, paths: Column) -> Column:
    """Whether the scope names a path, a part of one, or the end of one with or without its extension."""
    s = F.replace(F.regexp_replace(F.regexp_replace(scope, _SPACES, ""), "^/+|/+$", ""), F.lit("\\"), F.lit("/"))

    def shows(path: Column) -> Column:
        p = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), "^/|/$", "")
        stem = F.regexp_replace(p, r"\.[^.]*$", "")
        base = F.regexp_replace(F.substring_index(p, "/", -1), r"\.[^.]*$", "")
        folders = F.split(F.regexp_replace(p, "/?[^/]*$", ""), "/")
        ends = lambda x: (x == s) | F.endswith(x, F.concat(F.lit("/"), s))
        bare = lambda x: F.regexp_replace(x, "^_+", "") == s
        return (p != "") & (ends(p) | ends(stem) | bare(base) | F.exists(folders, lambda f: (f == s) | bare(f)))

    return F.when(s == "", F.lit(False)).otherwise(F.exists(paths, shows))


def with_score(
    df: DataFrame,
    message: str,
    out: str = "score",
    *,
    paths: str | None = None,
    expected_type: str | None = None,
    expected_scope: str | None = None,
    expect_body: str | None = None,
    expect_footer: str | None = None,
    expect_mixed: str | None = None,
    expect_breaking: str | None = None,
    forbidden: str | None = None,
    types: list[str] = TYPES,
    max_subject: int = MAX_SUBJECT,
) -> DataFrame:
    """Adds out: struct of the ten signals, parsed, and errors in a fixed order.

    The other arguments name columns with the context; a missing or null one expects nothing.
    """
    d = with_parsed(df, message, "_p")
    p = lambda f: F.col("_p")[f]
    col = lambda name, kind: F.col(name) if name else F.lit(None).cast(kind)
    failed = p("error").isNotNull()
    want_type, want_scope = col(expected_type, "string"), col(expected_scope, "string")
    none = F.array().cast("array<string>")
    claims, own = F.coalesce(col(forbidden, "array<string>"), none), F.coalesce(col(paths, "array<string>"), none)
    wants = {k: F.coalesce(col(c, "boolean"), F.lit(False)) for k, c in (("body", expect_body), ("footer", expect_footer), ("mixed", expect_mixed), ("breaking", expect_breaking))}
    known = p("type").isin(types)
    subject = F.lower(F.regexp_replace(F.regexp_replace(p("subject"), r"(?U)[\s\x1C-\x1F]+", " "), "^ | $", ""))
    low = F.lower(p("raw"))
    judged = {
        "format_validity": known,
        "type_accuracy": F.when(want_type.isNotNull(), p("type") == want_type),
        "scope_quality": F.when(want_scope.isNotNull(), p("scope").eqNullSafe(want_scope)).when((F.size(own) > 0) & p("scope").isNotNull(), scope_visible(p("scope"), own)),
        "factuality": F.when(F.size(claims) > 0, ~F.exists(claims, lambda c: F.contains(low, F.lower(c)))),
        "specificity": ~subject.isin(VAGUE) & (F.size(F.split(subject, " ")) >= 2),
        "brevity": F.length(p("subject")).between(1, max_subject),
        "body_presence": F.when(wants["body"], F.exists(p("body"), lambda x: F.regexp_replace(x, _SPACES, "") != "")),
        "footer_presence": F.when(wants["footer"], F.size(p("footers")) > 0),
        "mixed_change_warning": F.when(wants["mixed"], F.contains(low, F.lit("mixed")) | F.contains(low, F.lit("split")) | F.contains(low, F.lit("separate commit"))),
        "breaking_change_detection": F.when(wants["breaking"], p("breaking")),
    }
    expected = {
        "format_validity": F.lit(True), "type_accuracy": want_type.isNotNull(), "scope_quality": want_scope.isNotNull(), "factuality": F.size(claims) > 0, "specificity": F.lit(True), "brevity": F.lit(True),
        "body_presence": wants["body"], "footer_presence": wants["footer"], "mixed_change_warning": wants["mixed"], "breaking_change_detection": wants["breaking"],
    }
    d = d.withColumns({f"_{k}": F.when(failed, F.when(expected[k], False)).otherwise(v) for k, v in judged.items()})
    # fixed values: the texts of the errors
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    got_scope = F.coalesce(quoted(p("scope")), F.lit("None"))
    texts = [
        ("format_validity", F.concat(F.lit("unknown type: "), p("type"))),
        ("type_accuracy", F.concat(F.lit("expected type "), quoted(want_type), F.lit(", got "), quoted(p("type")))),
        ("scope_quality", F.when(want_scope.isNotNull(), F.concat(F.lit("expected scope "), quoted(want_scope), F.lit(", got "), got_scope)).otherwise(F.concat(F.lit("scope "), quoted(p("scope")), F.lit(" is not visible in changed paths")))),
        ("factuality", F.lit("message contains claims not grounded in the fixture")),
        ("specificity", F.lit("subject is too vague")),
        ("brevity", F.lit("subject length is outside the configured limit")),
        ("body_presence", F.lit("expected commit body")),
        ("footer_presence", F.lit("expected commit footer")),
        ("mixed_change_warning", F.lit("expected mixed-change warning")),
        ("breaking_change_detection", F.lit("expected breaking-change marker")),
    ]
    errors = F.when(failed, F.array(p("error"))).otherwise(F.array_compact(F.array(*[F.when(~F.col(f"_{k}"), t) for k, t in texts])))
    return d.withColumn(out, F.struct(*[F.col(f"_{k}").alias(k) for k in SIGNALS], F.col("_p").alias("parsed"), errors.alias("errors"))).drop("_p", *[f"_{k}" for k in SIGNALS])


def verifier_score(score: Column, evidence: Column, paths: Column) -> Column:
    """The mean of six checks: format, specificity, brevity, no error but invisible scopes, evidence, and evidence within the paths."""
    hidden = lambda e: e.startswith("scope ") & F.contains(e, F.lit(" is not visible in changed paths"))
    checks = [score["format_validity"], score["specificity"], score["brevity"], F.forall(score["errors"], hidden), F.size(evidence) > 0, F.size(F.array_except(evidence, paths)) == 0]
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in checks]) / F.lit(6.0)
