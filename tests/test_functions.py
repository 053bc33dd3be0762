import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from quern.functions import commits, globs, paths, replies, tokens
from quern.functions.columns import norm_path, repo_key, split_name, strip, valid_rows

CASES = "id string, message string, paths array<string>, etype string, escope string, body boolean, footer boolean, mixed boolean, breaking boolean, claims array<string>"


def scored(spark, *rows):
    df = spark.createDataFrame(rows, CASES)
    s = commits.with_score(df, "message", paths="paths", expected_type="etype", expected_scope="escope", expect_body="body", expect_footer="footer", expect_mixed="mixed", expect_breaking="breaking", forbidden="claims")
    return {r["id"]: r["score"] for r in s.collect()}


def test_score_goldens(spark):
    got = scored(
        spark,
        ("scoped", "fix(parser): handle empty input", ["src/parser.py"], "fix", "parser", None, None, None, None, None),
        ("no_header", "just words", None, "fix", None, True, None, None, None, None),
        ("vague", "fix: update", None, None, None, None, None, None, None, None),
        ("breaking", "feat(api)!: drop old route", None, None, None, None, None, None, True, None),
        ("claim", "feat(auth): add OAuth login", None, None, None, None, None, None, None, ["OAuth"]),
        ("body", "fix: a thing\n\nbecause", None, None, None, True, None, None, None, None),
        ("nobody", "fix: a thing", None, None, None, True, None, None, None, None),
        ("footer", "fix: a thing\n\nbody\n\nRefs: #123", None, None, None, True, True, None, None, None),
        ("mixed", "chore: split mixed work", None, None, None, None, None, True, None, None),
        ("long", "fix: " + "x " * 40, None, None, None, None, None, None, None, None),
        ("unknown", "foo: some thing", None, None, None, None, None, None, None, None),
        ("null", None, None, None, None, None, None, None, None, None),
    )
    s = got["scoped"]
    assert (s.format_validity, s.type_accuracy, s.scope_quality, s.specificity, s.brevity, list(s.errors)) == (True, True, True, True, True, [])
    assert not got["no_header"].format_validity and got["no_header"].type_accuracy is False and got["no_header"].body_presence is False and got["no_header"].scope_quality is None
    assert got["vague"].format_validity and not got["vague"].specificity
    assert got["breaking"].breaking_change_detection and got["claim"].factuality is False
    assert got["body"].body_presence and got["nobody"].body_presence is False and list(got["nobody"].errors) == ["expected commit body"]
    assert got["footer"].body_presence and got["footer"].footer_presence and got["mixed"].mixed_change_warning
    assert got["long"].format_validity and not got["long"].brevity
    assert not got["unknown"].format_validity and got["unknown"].specificity and list(got["unknown"].errors) == ["unknown type: foo"]
    assert list(got["null"].errors) == ["empty commit message"]


def test_parse_lines_and_footers(spark):
    df = spark.createDataFrame([("a", "\nfeat: x y\n\none\ntwo\n"), ("b", "feat: x y\nNote: z\nmore"), ("c", "fix: a b\r\n\r\nbody\n\nBREAKING CHANGE: gone")], "id string, m string")
    got = {r["id"]: r["parsed"] for r in commits.with_parsed(df, "m").collect()}
    assert got["a"].body == ["", "one", "two"] and got["a"].footers == []
    assert got["b"].body == [] and got["b"].footers == ["Note: z", "more"]
    assert got["c"].breaking and got["c"].body == ["", "body", ""]


@pytest.mark.parametrize(("scope", "path", "ok"), [("termui", "src/click/_termui_impl.py", False), ("_termui_impl", "src/click/_termui_impl.py", True), ("termui_impl", "src/click/_termui_impl.py", True), ("models.py", "src/requests/models.py", True), ("models", "src/requests/models.py", True), ("requests/sessions", "src/requests/sessions.py", True), ("request", "src/requests/sessions.py", False), ("internal", "src/_internal/a.py", True), ("src\\requests", "src/requests", True), ("/", "a/b", False), ("a", "", False)])
def test_scope_visibility(spark, scope, path, ok):
    df = spark.createDataFrame([(scope, [path])], "s string, p array<string>")
    assert df.select(commits.scope_visible(F.col("s"), F.col("p"))).first()[0] is ok


def test_message_formats(spark):
    df = spark.createDataFrame([("h", ["b"], ["f"]), ("h", [], None)], "h string, b array<string>, f array<string>")
    c = (F.col("h"), F.col("b"), F.col("f"))
    assert [tuple(r) for r in df.select(commits.format_message(*c), commits.plain_message(*c)).collect()] == [("h\n\nb\n\nf", "h\nb\nf"), ("h", "h")]


def test_verifier_score(spark):
    got = {}
    df = spark.createDataFrame([("a", "fix(zzz): do a thing", ["src/a.py"], ["src/a.py"]), ("b", "bad", ["src/a.py"], [])], "id string, m string, p array<string>, e array<string>")
    for r in commits.with_score(df, "m", paths="p").select("id", commits.verifier_score(F.col("score"), F.col("e"), F.col("p")).alias("v")).collect():
        got[r["id"]] = r["v"]
    assert got["a"] == 1.0 and got["b"] == pytest.approx(1 / 6)


def test_repository_keys(spark):
    same = ["https://H.example/O/n", "http://www.h.example/o/N.git/", "git@h.example:o/n.git", "ssh://git@h.example/o/n.git", "git+https://h.example/o/n.git", " h.example/o/n#readme ", "https://h.example:443/o/n/", "HTTPS://u@h.example/o//n "]
    df = spark.createDataFrame([(u,) for u in [*same, "", None]], "u string")
    assert [r[0] for r in df.select(repo_key("u")).collect()] == ["h.example/o/n"] * len(same) + [None, None]


def test_small_columns(spark):
    df = spark.createDataFrame([("  a​\t", " dev\n", ".\\x\\y", "https://github.com/o/n.git/", "abcdef0123456789")], "a string, s string, p string, u string, c string")
    assert tuple(df.select(strip("a"), split_name("s"), norm_path("p"), paths.change_id(F.col("u"), F.col("c"))).first()) == ("a", "DEV", "x/y", "o-n-abcdef012345")
    df = spark.createDataFrame([("10 files changed, 1,200 insertions(+), 3 deletions(-)",), ("",), (None,)], "s string")
    assert [tuple(r[0]) for r in df.select(paths.diff_counts(F.col("s"), F.array(F.lit("a")))).collect()] == [(10, 1200, 3), (1, 0, 0), (1, 0, 0)]


def test_paths(spark):
    df = spark.createDataFrame([(["src\\My_App/__init__.py", "docs/a-b.md", "test_x/y.tar.gz"],), ([],), (None,)], "p array<string>")
    got = [r[0] for r in df.select(paths.tokens(F.col("p"))).collect()]
    assert got == [["src", "my", "app", "init", "docs", "a", "b", "test", "x", "y", "tar"], [], []]
    assert [r[0] for r in df.select(paths.topic(paths.tokens(F.col("p")))).collect()] == ["my", "project", "project"]
    one = df.limit(1).select(F.transform("p", paths.extension), F.transform("p", paths.is_docs), F.transform("p", paths.is_tests)).first()
    assert one[0][0] == ".py" and one[1] == [False, True, False] and one[2] == [False, False, True]
    e = spark.createDataFrame([(["tests/a.py#L12-L20", "missing.py", "tests/a.py:3", "b.py:1:2"], ["tests/a.py", "b.py"])], "e array<string>, c array<string>")
    assert tuple(e.select(paths.evidence(F.col("e"), F.col("c"))).first()[0]) == (["tests/a.py", "b.py"], ["missing.py"])


@pytest.mark.parametrize(("glob", "path", "ok"), [("vendor/**", "vendor/a/b.py", True), ("*.min.js", "a/b.min.js", True), ("*.min.js", "a/bxminxjs", False), ("src/*/fixtures/*", "src/a/b/fixtures/c/d", True), ("schema/[a-m]*.json", "schema/b.json", True), ("schema/[!a-m]*.json", "schema/b.json", False), ("examples/??_*", "examples/12_a.py", True), ("Legacy/*", "legacy/a", False), ("a[", "a[", True), ("[]]x", "]x", True), ("a+(b)", "a+(b)", True)])
def test_globs(spark, glob, path, ok):
    import fnmatch
    import re

    assert bool(re.match("(?s)^(?:" + globs.glob_regex(glob) + ")$", path)) is ok is fnmatch.fnmatchcase(path, glob)
    df = spark.createDataFrame([([glob], [path])], "g array<string>, p array<string>").withColumn("rx", globs.globs_regex("g"))
    assert (df.select(globs.split_by_globs(F.col("p"), F.col("rx"))["excluded"]).first()[0] == [path]) is ok


def test_tokenizer_and_streams(spark):
    df = spark.createDataFrame([("feat(api): add foo_bar()\n+ return value >= 1",), (None,), ("a b\x1cc 12.5 8a1b1a33d ü",)], "t string")
    got = [r[0] for r in df.select(tokens.tokenize(F.col("t"))).collect()]
    assert got == ["feat ( api ) : add foo_bar ( ) <nl> + return value >= 1".split(), [], ["a", "b", "c", "12.5", "8a1b1a33d", "ü"]]
    m = spark.createDataFrame([([("system", "s"), ("user", "u v"), ("tool", "x"), ("assistant", "a")],)], "m array<struct<role string, content string>>")
    assert m.select(tokens.record_stream(F.col("m"))).first()[0] == "<bos> <system> s <sep> <user> u v <sep> x <sep> <assistant> a <sep> <eos>".split()


def test_crop_render_hash(spark):
    df = spark.range(1).select(F.array(*[F.lit(str(i)) for i in range(9)]).alias("w"))
    cut = lambda b: df.select(tokens.crop(F.col("w"), F.lit(b))).first()[0]
    assert cut(9) == [str(i) for i in range(9)] and cut(5) == ["0", "1", "2", "7", "8"] and cut(1) == ["0"] and cut(0) == [] and cut(-3) == []
    r = df.select(tokens.render(F.array().cast("array<string>"), F.col("w"), F.array(F.lit("x"), F.lit("y")))).first()[0]
    assert len(r.tokens) == len(r.loss_mask) == 19 and sum(r.loss_mask) == 4 and r.tokens[-1] == "<eos>"
    ids = [1, -2, 300, 70000, -(1 << 31), (1 << 31) - 1]
    one = spark.createDataFrame([(ids,), ([],)], "a array<int>").select(tokens.ints_sha256(F.col("a"))).collect()
    assert one[0][0] == hashlib.sha256(struct.pack("<6i", *ids)).hexdigest() and one[1][0] == hashlib.sha256(b"").hexdigest()
    got = [r[0] for r in spark.range(300).select(tokens.hashed_bucket(F.col("id"), F.col("id") * 7, F.col("id") - 3, 4096)).collect()]
    assert got == [int.from_bytes(hashlib.sha256(f"{i}:{i * 7}:{i - 3}".encode()).digest()[:8], "little") % 4096 for i in range(300)]


def test_replies(spark):
    data = [('<think>{"a":1}</think>```json\n{"header":"fix: a b","body":"l1\\n\\n l2","footers":["f"],"type":"fix","scope":null,"confidence":1.4,"warnings":[],"evidence_paths":["a.py"]}\n```',), ("Sure:\n\nfix(x): do it now\n\nbody\n```",), ('"feat: add y z"',), ("nothing",), (None,), ('{"header":"","confidence":0.2}',), ('{"header":"fix: a","body":[],"footers":[],"warnings":[]}',)]
    got = [r["candidate"] for r in replies.with_candidate(spark.createDataFrame(data, "r string"), "r").collect()]
    assert (got[0].header, got[0].body, got[0].footers, got[0].confidence, got[0].error) == ("fix: a b", ["l1", "l2"], ["f"], 1.0, None)
    assert (got[1].header, got[1].scope, got[1].confidence, got[1].body) == ("fix(x): do it now", "x", 0.5, ["", "body"]) and got[2].header == "feat: add y z"
    assert [g.error is None for g in got] == [True, True, True, False, False, False, False]


def test_valid_rows(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), ("b", 0, "w"), (None, 1, "n")], "k string, _ord bigint, v string")
    assert rows(valid_rows(df, "k", "v")) == [("a", "y"), ("b", "w")]
    assert valid_rows(df.limit(0), "k", "v").count() == 0
