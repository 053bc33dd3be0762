import http.server
import json
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from quern.functions import paths
from quern.operators import documents, evaluation, lineage, records, sft, vocabulary
from quern.sources import files, git, teacher

MANIFEST = "repo_url string, default_branch string, source_license string, license_url string, license_review_date string, reviewer string, review_status string, source_revision string, allowed_splits array<string>, ecosystem string, errors string, _ord bigint"


def errors_of(df, key, column="errors"):
    return {r[key]: list(r[column]) for r in df.collect()}


def test_manifest_rules(spark):
    good = ("https://h/o/a", "main", "MIT", "https://h/l", "2025-01-01", "r", "pending", "abcdef1", ["DEV"], "go", "clash", 1)
    bad = ("ftp://h/o/b", "", None, "http://x", "d", "r", "odd", "ABCDEF1", ["DEV", "TEST"], "", None, 2)
    none = (None,) * 11 + (3,)
    df = spark.createDataFrame([good, bad, none, ("https://H/o/a.git/", *good[1:11], 4)], MANIFEST)
    got = errors_of(records.manifest_errors(df, ["MIT"], ["pending"]), "_ord")
    assert got[1] == [] and got[4] == ["duplicate repo_url: https://H/o/a.git/"]
    assert got[2] == ["repo_url must start with one of ('https://', 'git@')", "default_branch must be a non-empty string", "source_license must be a non-empty string", "license_url must start with one of ('https://',)", "invalid review_status: odd", "source_revision must be a 7-40 character lowercase hex revision", "invalid allowed_splits: ['TEST']", "ecosystem must be a non-empty string when present"]
    assert len(got[3]) == 9 and got[3][-1] == "allowed_splits must be a non-empty list"
    assert records.manifest_errors(df.limit(0)).count() == 0


def test_plan_rules(spark):
    w = "plan_id string, plan_version string, created_at string, id string, repo_url string, split string, start string, end string, reason string, target_records bigint, _ord bigint, errors string"
    rows = [
        ("p", "v", "c", "a", "https://h/o/x", "DEV", "2025-01-01T00:00:00Z", "2025-08-01T00:00:00Z", "r", 1, 1, None),
        ("p", "v", "c", "b", "https://h/o/x.git", "REPORT", "2025-07-01T02:00:00+02:00", "2026-01-01T00:00:00Z", "r", None, 2, None),
        ("p", "v", "c", "a", "https://h/o/y", "TEST", "2025-01-01", "2025-08-01T00:00:00Z", "", -1, 3, None),
        ("q", "v", "c", "a", "https://h/o/x", "DEV", "2025-02-01T00:00:00Z", "2025-01-01T00:00:00Z", "r", 1, 4, None),
        (None, None, None, None, None, None, None, None, None, None, 5, None),
    ]
    got = errors_of(records.plan_errors(spark.createDataFrame(rows, w)), "_ord")
    assert got[1] == [] and got[2] == ["overlapping split windows for h/o/x: a overlaps b"]
    assert got[3] == ["windows[2].reason must be a non-empty string", "windows[2].id is duplicated: a", "windows[2].split is invalid: TEST", "windows[2] has invalid timestamp", "windows[2].target_records must be a non-negative integer"]
    assert got[4] == ["windows[0].start must be earlier than end"] and len(got[5]) == 6
    m = spark.createDataFrame([("h/o/x", ["DEV", "HELD_OUT"], "pending")], "repo string, allowed_splits array<string>, review_status string")
    win = spark.createDataFrame([("1", "h/o/x", "DEV"), ("2", "h/o/x", "REPORT"), ("3", "h/o/z", "DEV"), ("4", "h/o/x", "HELD_OUT"), ("5", None, None)], "id string, repo string, split string")
    got = errors_of(records.window_manifest_errors(win, m, ("HELD_OUT", "approved", "HELD_OUT windows require an approved source")), "id")
    assert got == {"1": [], "2": ["split REPORT is not allowed by source manifest"], "3": ["repo_url is not present in source manifest"], "4": ["HELD_OUT windows require an approved source"], "5": ["repo_url is not present in source manifest"]}


TEACH = "teacher_model_id string, teacher_runtime string, teacher_runtime_model_id string, teacher_revision string, teacher_license string, teacher_size string, teacher_context_length string, prompt_version string, decoding_config map<string,string>"
SHARED = "source_repo_url string, source_license string, source_commit string, parent_commit string, data_split string, changed_paths array<string>"
SHARE = ("https://h/o/n", "MIT", "a" * 40, "b" * 40, "DEV", ["src/parser.py", "tests/test_parser.py"])
MODEL = ("m", "run", "m:1", "abcdef1", "MIT", "7B", "32K", "v0.1", {"t": "0", "p": "1"})


def tables(spark):
    """Reviews, labels, inputs and sources of three changes, one accepted, one edited, one rejected."""
    ids = ["x-1", "x-2", "x-3"]
    label = f"id string, {SHARED}, {TEACH}, generation_timestamp string, header string, body array<string>, footers array<string>, confidence double, verifier_score double, warnings array<string>, evidence_paths array<string>, parser_result struct<errors: array<string>>, human_review_status string, _ord bigint"
    labels = [(f"generated-{i}", *SHARE, *MODEL, "2025-01-01T00:00:00Z", "fix(parser): keep blanks", ["Why"], [], 0.9, 1.0, [], ["src/parser.py"], ([],), "not_reviewed", n) for n, i in enumerate(ids)]
    inp = f"id string, source_diff_id string, review_decision_id string, {SHARED}, {TEACH}, prompt_path string, system_message string, user_message string, diff string, diff_sha256 string, input_status string, diff_stat string, historical_subject string, _ord bigint"
    inputs = spark.createDataFrame([(f"teacher-input-{i}", i, f"review-{i}", *SHARE, *MODEL, "p", "S", "U", "+ x", None, "ready", "1 file changed", "old", n) for n, i in enumerate(ids)], inp).withColumn("diff_sha256", F.sha2("diff", 256))
    src = f"id string, {SHARED}, manifest_revision string, historical_subject string, extraction_command string, review_status string, source_commit_timestamp string, excluded_paths array<string>, diff_stat string, _ord bigint"
    sources = [(i, *SHARE, "c" * 40, "old subject", "git", "not_reviewed", "2025-01-01T00:00:00+00:00", [], "1 file changed", n) for n, i in enumerate(ids)]
    rev = "id string, generated_label_id string, source_repo_url string, source_commit string, teacher_model_id string, prompt_version string, header string, decision string, issues array<string>, notes string, edited_header string, edited_body array<string>, reviewer string, review_timestamp string, review_protocol string, _ord bigint"
    reviews = [(f"review-generated-{i}", f"generated-{i}", SHARE[0], SHARE[2], "m", "v0.1", "fix(parser): keep blanks", d, [], "", h, None, "r", "t", "p", n) for n, (i, d, h) in enumerate(zip(ids, ("accept", "edit", "reject"), (None, "fix(parser): keep all blanks", None), strict=True))]
    return spark.createDataFrame(reviews, rev), spark.createDataFrame(labels, label), inputs, spark.createDataFrame(sources, src)


def test_sft_rows_and_lineage(spark):
    reviews, labels, inputs, sources = tables(spark)
    out = sft.sft_rows(reviews, labels, inputs, sources, "art", "v0", "Do it.")
    got = {r["id"]: r for r in lineage.all_or_nothing(out).collect()}
    assert set(got) == {"sft-x-1", "sft-x-2"} and len(out.columns) - 1 == 45 - 1
    edited = got["sft-x-2"]
    assert edited["target_message"] == "fix(parser): keep all blanks\n\nWhy" and edited["label_source"] == "teacher_generated_human_edited"
    assert [m["role"] for m in edited["messages"]] == ["system", "user", "assistant"] and edited["messages"][2]["content"] == edited["target_message"]
    assert edited["decoding_config"] == MODEL[-1] and edited["historical_subject"] == "old subject"
    open_one = reviews.withColumn("decision", F.when(F.col("_ord") == 0, "needs_review").otherwise(F.col("decision")))
    with pytest.raises(ValueError, match="still needs_review"):
        lineage.all_or_nothing(sft.sft_rows(open_one, labels, inputs, sources, "art", "v0", "Do it."))
    more = reviews.unionByName(reviews.where("_ord = 0").withColumn("_ord", F.lit(9))).unionByName(reviews.where("_ord = 1").withColumns({"generated_label_id": F.lit("generated-y"), "_ord": F.lit(10), "id": F.lit("r-y")}))
    bad = {r["generated_label_review_id"]: r["errors"] for r in sft.sft_rows(more, labels, inputs.where("source_diff_id <> 'x-2'"), sources.where("id <> 'x-3'"), "art", "v0", "Do it.").where(F.size("errors") > 0).orderBy(F.desc(F.size("errors"))).collect()}
    assert bad["r-y"] == ["unknown generated_label_id: generated-y"] and bad["review-generated-x-1"] == ["duplicate review for generated_label_id: generated-x-1"]
    assert bad["review-generated-x-2"] == ["missing teacher input for source_diff_id: x-2"] and bad["review-generated-x-3"] == ["missing source diff for source_diff_id: x-3"]
    assert sft.sft_rows(reviews.limit(0), labels, inputs, sources, "a", "v", "i").count() == 0
    rules = records.training_rules("Do it.", list(sft.LABEL_SOURCES.values()), ["accept", "edit"])
    rows = out.drop("errors").withColumn("_ord", F.lit(1))
    assert all(not e for e in errors_of(sft.lineage_errors(rows, labels, reviews, inputs, rules), "id").values())
    turned = rows.withColumns({"diff": F.lit("+ y"), "target_header": F.lit("fix: other"), "data_split": F.lit("HELD_OUT"), "decoding_config": F.create_map(F.lit("p"), F.lit("1"), F.lit("t"), F.lit("0"))})
    e = errors_of(sft.lineage_errors(turned, labels, reviews.where("_ord > 0"), inputs, rules), "id")
    assert e["sft-x-1"] == ["training examples must not come from HELD_OUT teacher labels", "diff_sha256 does not match diff", "target_message does not match target fields", "missing review for generated_label_id: generated-x-1"]
    assert "data_split does not match generated label" in e["sft-x-2"] and "edited target_header does not match review" in e["sft-x-2"] and not any("decoding_config" in x for x in e["sft-x-2"])
    twice = sft.lineage_errors(rows.unionByName(rows.withColumn("_ord", F.lit(2))), labels, reviews, inputs, rules).where(F.size("errors") > 0)
    assert twice.count() == 2


def test_reviews_inputs_and_labels_against_each_other(spark):
    reviews, labels, inputs, sources = tables(spark)
    fields = ["source_repo_url", "source_commit", "teacher_model_id", "prompt_version", "header"]
    turned = reviews.withColumn("header", F.when(F.col("_ord") == 1, "x").otherwise(F.col("header")))
    got = errors_of(sft.review_errors(turned, labels, "generated_label_id", fields, records.label_review_rules(["accept", "edit"], ["scope_issue"]), "generated label"), "id")
    assert got["review-generated-x-1"] == [] and got["review-generated-x-2"] == ["header does not match generated label"] and got["review-generated-x-3"] == ["invalid decision: reject"]
    odd = inputs.withColumn("diff", F.when(F.col("_ord") == 0, "other").otherwise(F.col("diff"))).unionByName(inputs.where("_ord = 1").withColumns({"_ord": F.lit(7), "id": F.lit("again")})).unionByName(inputs.where("_ord = 2").withColumns({"source_diff_id": F.lit("zz"), "id": F.lit("z")}))
    src = sources.withColumn("historical_subject", F.lit("old"))
    got = errors_of(sft.input_errors(odd, src, spark.createDataFrame([("x-1",), ("x-2",), (None,)], "source_diff_id string")), "id")
    assert got == {"teacher-input-x-1": ["diff_sha256 does not match diff"], "teacher-input-x-2": [], "again": ["duplicate teacher input for source_diff_id: x-2"], "teacher-input-x-3": ["source_diff_id is not accepted for teacher labeling: x-3"], "z": ["unknown source_diff_id: zz"]}
    strange = labels.withColumn("evidence_paths", F.when(F.col("_ord") == 0, F.array(F.lit("q"), F.lit("src/parser.py"))).otherwise(F.col("evidence_paths"))).where("_ord < 2").withColumn("teacher_size", F.when(F.col("_ord") == 1, "8B").otherwise(F.col("teacher_size")))
    out, missing = sft.label_input_errors(strange, inputs)
    assert errors_of(out, "id") == {"generated-x-1": ["evidence_paths not present in changed_paths: ['q']"], "generated-x-2": ["teacher_size does not match teacher input"]}
    assert [r[0] for r in missing.collect()] == ["generated-x-3"]
    assert sft.label_input_errors(strange, inputs, complete=False)[1].count() == 0


def test_label_rows_from_replies(spark):
    _, _, inputs, _ = tables(spark)
    replies = spark.createDataFrame([
        ("x-1", json.dumps({"header": "fix(parser): keep blanks", "body": "Why\n\nWhat", "footers": [], "type": "fix", "scope": "parser", "confidence": 7, "warnings": [], "evidence_paths": ["tests/test_parser.py#L12", "tests/missing.py"]})),
        ("x-2", "```\nfeat(parser): read more\n\nBody.\n```"), ("x-3", "no"),
    ], "source_diff_id string, reply string")
    got = {r["id"]: r for r in sft.label_rows(inputs, replies, F.lit("now")).collect()}
    one = got["generated-x-1"]
    assert one["evidence_paths"] == ["tests/test_parser.py"] and one["warnings"] == ["dropped evidence_paths not present in changed_paths: tests/missing.py"] and one["confidence"] == 1.0 and one["body"] == ["Why", "What"] and one["verifier_score"] == 1.0
    assert got["generated-x-2"]["type"] == "feat" and got["generated-x-2"]["confidence"] == 0.5 and abs(got["generated-x-2"]["verifier_score"] - 5 / 6) < 1e-9
    assert got["generated-x-3"]["error"] and got["generated-x-3"]["header"] is None
    made = sft.label_rows(inputs.where("source_diff_id <> 'x-2'"), replies, F.lit("now"))
    report = sft.generation_report(inputs, spark.createDataFrame([("generated-x-2",)], "id string"), made).first()
    assert tuple(report) == (3, 1, 1, 1)


def test_review_rows_and_teacher_inputs(spark):
    _, labels, _, sources = tables(spark)
    r = sft.review_rows(sources, "source_diff_id", ["source_repo_url"], "art", "me").first()
    assert (r["id"], r["source_diff_id"], r["decision"], r["reasons"], r["review_protocol"]) == ("review-x-1", "x-1", "needs_review", [], "source-diff-art-review-v0.1")
    assert sft.review_rows(labels, "generated_label_id", ["header"], "art", "me", edits=True).columns[-8:] == ["decision", "issues", "edited_header", "edited_body", "notes", "reviewer", "review_timestamp", "review_protocol"]
    decided = spark.createDataFrame([("r1", "x-1", "yes"), ("r2", "x-2", "no"), ("r3", "q", "yes")], "id string, source_diff_id string, decision string")
    diffs = spark.createDataFrame([("x-1", "+ a")], "id string, diff string")
    message = files.render_template("{repository}: {changed_paths}\n{diff}", {"repository": F.col("repository"), "changed_paths": files.json_list(F.col("changed_paths")), "diff": F.col("diff")})
    got = {x["source_diff_id"]: x for x in sft.teacher_inputs(decided, sources, diffs, message, "yes", {"teacher_model_id": F.lit("m")}, "S").collect()}
    assert got["x-1"]["user_message"] == 'https://h/o/n: ["src/parser.py", "tests/test_parser.py"]\n+ a' and got["x-1"]["errors"] == []
    assert set(got) == {"x-1", "q"} and got["q"]["errors"] == ["unknown source_diff_id: q", "no diff for source_diff_id: q"]


def test_templates_write_arrays(spark):
    df = spark.createDataFrame([(["a", 'b"c'], None, 3)], "p array<string>, n string, k int")
    assert df.select(files.render_template("{p} {n}{k}", {"p": F.col("p"), "n": F.col("n"), "k": F.col("k")})).first()[0] == '["a","b\\"c"] 3'
    assert df.select(files.json_list(F.col("p"))).first()[0] == '["a", "b\\"c"]'


def test_evaluation(spark, rows):
    df = spark.createDataFrame([("1", "DEV", ["src/a.py"], "fix(a): keep one", "fix(a): keep one", "stuff"), ("2", "REPORT", ["src/b.py"], "feat(b): add two", "feat(zz): add two", None)], "id string, data_split string, changed_paths array<string>, target string, teacher string, historical string")
    scored = evaluation.scored_messages(df, {"target": "target", "teacher": "teacher", "historical": "historical"}, ["id", "data_split"])
    counts = {(r["data_split"], r["message"], r["signal"]): (r["n_true"], r["n_false"], r["n_null"]) for r in evaluation.signal_counts(scored).collect()}
    assert counts[None, "target", "format_validity"] == (2, 0, 0) and counts[None, "historical", "format_validity"] == (0, 1, 0) and counts["REPORT", "teacher", "scope_quality"] == (0, 1, 0)
    assert tuple(evaluation.changed(df, "target", "teacher").first()) == (2, 1)
    assert rows(evaluation.type_counts(scored)) == [("target", "feat", 1), ("target", "fix", 1), ("teacher", "feat", 1), ("teacher", "fix", 1)]
    assert rows(evaluation.top_errors(scored, 1)) == [("historical", "invalid Conventional Commit header", 1), ("teacher", "scope 'zz' is not visible in changed paths", 1)]
    assert evaluation.signal_counts(scored.limit(0)).count() == 0
    t = spark.createDataFrame([("DEV", "https://h/o/a", "MIT"), ("DEV", "https://h/o/A.git", "MIT"), ("DEV", "https://h/o/b", None), (None, None, "ISC")], "data_split string, source_repo_url string, source_license string")
    m = spark.createDataFrame([("h/o/a", "go")], "repo string, ecosystem string")
    s = {(r["measure"], r["key"]): r["value"] for r in evaluation.artifact_summary(t, m, ["source_license"]).collect()}
    assert s["records", None] == 4 and s["split", "DEV"] == 3 and s["split", "REPORT"] == 0 and s["repos", "DEV"] == 2 and s["top_repo", "h/o/a"] == 2 and abs(s["max_repo_fraction", None] - 0.666667) < 1e-9
    assert s["count", "source_license:MIT"] == 2 and s["ecosystem", "go"] == 1 and s["missing_repo", "h/o/b"] == 1
    summary = evaluation.artifact_summary(t, m, ["source_license"])
    assert rows(evaluation.baseline_errors(summary, {"records": 4, "split:DEV": 5, "split:TEST": 1})) == [("split", "DEV", 5.0, 3.0), ("split", "TEST", 1.0, None)]
    c = spark.createDataFrame([("a", "written"), ("a", "existing"), ("b", "split"), ("b", None)], "repo string, status string")
    assert rows(evaluation.extraction_report(c)) == [(None, 1, 1, 1, 0), ("a", 1, 1, 0, 0), ("b", 0, 0, 1, 0)]


def test_path_predicates(spark):
    df = spark.createDataFrame([(["docs/a.py", "README.md"],), (["src/a.py"],), ([],), (["x/package.json"],), (["a/spec/b.txt"],)], "p array<string>")
    got = [tuple(r) for r in df.select(paths.all_noise(F.col("p")), paths.has_code_or_tests(F.col("p"))).collect()]
    assert got == [(True, True), (False, True), (True, False), (True, False), (True, True)]
    s = spark.createDataFrame([("Bump parser",), ("fix merged thing",), ("merge it",), (None,), ("dependency x",)], "s string").select(paths.is_noise_subject(F.col("s")))
    assert [r[0] for r in s.collect()] == [True, False, True, False, False]
    b = spark.createDataFrame([(["t/Snapshots/a"], 9, 1), (["t/snapshots/a"], 8, 800), (["t/baselines/a"], 1, 801), (["src/a"], 99, 9999)], "p array<string>, f int, n int")
    assert [r[0] for r in b.select(paths.is_snapshot_bulk(F.col("p"), F.col("f"), F.col("n"))).collect()] == [True, False, True, False]
    u = spark.createDataFrame([("https://github.com/o/n.git/",), (None,)], "u string").select(paths.local_path(F.col("u")))
    assert [r[0] for r in u.collect()] == ["sources/github.com/o/n", None]


def test_vocabulary_and_sequence_contracts(spark, rows):
    v = spark.createDataFrame([(0, "<pad>"), (1, "a"), (3, "a"), (4, "")], "id int, token string")
    assert rows(records.vocabulary_errors(v, ["<pad>", "<unk>"])) == [(None, "<unk>", "special token <unk> must have id 1"), (3, "a", "duplicate vocab token: a"), (3, "a", "vocab entry 2 has a non-contiguous id"), (4, "", "vocab entry 3 has a non-contiguous id"), (4, "", "vocab entry 3 has an invalid token")]
    m = spark.createDataFrame([("a", "m", 10, 11, 1), ("b", "m", None, 9, 0), ("c", "m", None, 7, None), ("d", "m", None, 8, 3)], "record_id string, materialization_id string, context_tokens bigint, input_length bigint, loss_tokens bigint")
    run = spark.createDataFrame([("m", 8)], "materialization_id string, context_tokens bigint")
    assert rows(records.sequence_errors(m, run)) == [("a", "input_length exceeds context_tokens"), ("b", "input_length exceeds context_tokens"), ("b", "missing loss tokens"), ("c", "missing loss tokens")]
    t = spark.createDataFrame([("1", "DEV", ["a"] * 3), ("2", "REPORT", ["a"] * 30), ("3", "DEV", ["a", "b"] * 4)], "id string, data_split string, tokens array<string>")
    plan = vocabulary.plan(vocabulary.with_unknown(t, spark.createDataFrame([("a", 9)], "token string, id int"), "id"), 5, 20)
    assert {r["id"]: (r["unknown_token_count"], r["reason"]) for r in plan.collect()} == {"1": (0, "raw_token_count fits context_tokens"), "2": (0, "raw_token_count exceeds max_raw_record_tokens"), "3": (4, "raw_token_count exceeds context_tokens")}
    acc = vocabulary.accounting(plan)
    got = {r["data_split"]: (r["records"], r["kept_tokens"], r["truncated_tokens"], r["excluded_tokens"]) for r in acc.collect()}
    assert got == {"DEV": (2, 8, 3, 0), "REPORT": (1, 0, 0, 30), "HELD_OUT": (0, 0, 0, 0), None: (3, 8, 3, 30)}
    assert rows(vocabulary.blockers(acc, 3)) == [("DEV", 2, 0, "kept DEV records fall below minimum"), ("REPORT", 0, 1, "REPORT contains excluded oversize records")]


def test_documents():
    assert documents.decoder_parameters(10, 4, 2, 2, 1, 8) == 40 + 2 * (32 + 16 + 96 + 8) + 4
    assert documents.within_band(93_000_000, "50M-150M") and not documents.within_band(3, "50M-150M") and documents.within_band(10**9, "0.5B-1B") and not documents.within_band(1, "some")
    doc = {"data": {"splits": ["DEV"], "n": True}, "context": 4096}
    assert documents.document_errors(doc, {"data.splits": ["DEV"], "data.n": int, "context": lambda v: v >= 8192, "x.y": str}) == ["data.n must be of type int", "context is not allowed: 4096", "x.y is missing"]
    assert documents.unknown_keys(doc, ["data"]) == ["context"] and documents.resume_errors({"run_id": 1}, {"run_id": 2}) == ["checkpoint run_id does not match the run"]
    assert [documents.run_status(b, d, 5) for b, d in ((["x"], 5), ([], 5), ([], 4))] == ["blocked", "trained", "partial"]
    assert files.stable_sha256({"b": 1, "a": [2]}) == files.stable_sha256({"a": [2], "b": 1})


def test_git_source_with_globs_renames_and_divided_calls(spark, tmp_path):
    repo = str(tmp_path / "r")
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=a", "-c", "user.email=a@b", "-c", "diff.renames=false", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", repo], check=True)
    body = "\n".join(f"line {i}" for i in range(30))
    for name in ("a.py", "gen/x.py"):
        (tmp_path / "r" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "r" / name).write_text(body)
    run("add", "-A")
    run("commit", "-qm", "root")
    (tmp_path / "r" / "a.py").rename(tmp_path / "r" / "b.py")
    (tmp_path / "r" / "gen/x.py").write_text("x")
    run("add", "-A")
    run("commit", "-qm", "rename a")
    (tmp_path / "r" / "gen/x.py").write_text("y")
    run("add", "-A")
    run("commit", "-qm", "only generated")
    spark.dataSource.register(git.GitCommits)
    read = spark.read.format("git_commits").option("path", repo).option("diff", "true").option("exclude", json.dumps({repo: ["gen/*"]})).load()
    got = {r["subject"]: r for r in read.collect()}
    one = got["rename a"]
    assert one["changed_paths"] == ["a.py", "b.py"] and one["excluded_paths"] == ["gen/x.py"] and "a.py => b.py" in one["diff_stat"] and "1 file changed, 0 insertions(+), 0 deletions(-)" in one["diff_stat"] and "rename from a.py" in one["diff"]
    m = spark.createDataFrame([(repo, "https://github.com/o/n", "MIT", "abcdef1", 1)], "repo string, repo_url string, source_license string, source_revision string, _ord bigint")
    rows = git.source_diffs(read, m)
    assert [c for c in rows.columns if c != "_ord"] == ["id", "source_repo_url", "source_license", "manifest_revision", "source_commit", "source_commit_timestamp", "parent_commit", "data_split", "changed_paths", "excluded_paths", "diff_stat", "historical_subject", "extraction_command", "review_status"]
    only = rows.collect()
    assert len(only) == 1 and only[0]["id"] == "o-n-" + one["commit"][:12] and errors_of(records.with_errors(rows, records.source_rules()), "id") == {only[0]["id"]: []}
    w = spark.createDataFrame([(repo, 1, "REPORT")], "repo string, _ord int, split string").withColumns({"start": F.lit("2000-01-01").cast("timestamp"), "end": F.lit("2100-01-01").cast("timestamp")})
    assert [r["data_split"] for r in git.source_diffs(read, m, w).collect()] == ["REPORT"] and git.source_diffs(read, m, w.limit(0)).count() == 0
    assert git.divided(["aa", "b", "cccc", "d"], 5) == [["aa", "b"], ["cccc"], ["d"]]
    assert git.added([" a | 2 +-\n 1 file changed, 1 insertion(+), 1 deletion(-)", " b | 1 +\n 1 file changed, 1 insertion(+)"]) == " a | 2 +-\n b | 1 +\n 2 files changed, 2 insertions(+), 1 deletion(-)"


def test_candidates_follow_both_limits(spark):
    df = spark.createDataFrame([(f"{r}{i}", r, "REPORT" if i == 1 else "DEV", n * 10 + i) for n, r in enumerate("abc") for i in range(4)], "id string, source_repo_url string, data_split string, _ord int")
    old = spark.createDataFrame([("a0",), ("b0",)], "id string")
    got = {r["id"]: r["status"] for r in git.candidates(df, old, ["DEV"], 3, 2).collect()}
    assert got == {"a0": "existing", "a1": "split", "a2": "written", "b0": "existing", "b1": "split", "b2": "written", "c0": None, "c1": None, "c2": None}
    assert {r["status"] for r in git.candidates(df, old.limit(0), None, 3, 99).collect()} == {"written"}


def test_files_and_checksums(spark, tmp_path, rows):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text("{}")
    (tmp_path / "m" / "b.json").write_text("")
    n = files.write_checksums(spark, [str(tmp_path / "m" / "*.json")], str(tmp_path / "sums" / "sha256.txt"), str(tmp_path))
    assert n == 2 and (tmp_path / "sums" / "sha256.txt").read_text().split("\n")[0].endswith("  m/a.json")
    entries = files.file_entries(spark.createDataFrame([("m/b.json",), ("m/c.json",)], "path string"), files.checksums(spark, [str(tmp_path / "m")], str(tmp_path)))
    assert [(r[0], r[1], r[3]) for r in sorted(entries.collect())] == [("m/b.json", True, 0), ("m/c.json", False, None)]
    (tmp_path / "c.jsonl").write_text(json.dumps({"id": "1", "split": "DEV", "message": "fix: a b", "context": {"changed_paths": ["a"]}, "expected": {"format_validity": True}}) + "\n")
    case = files.read_cases(spark, str(tmp_path / "c.jsonl")).first()
    assert case["context"]["changed_paths"] == ["a"] and case["context"]["forbidden_claims"] == [] and case["context"]["expect_body"] is False and case["expected"] == {"format_validity": True}


def test_http_caller(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            out = json.dumps({"r": asked["p"].upper()} if asked["p"] != "bad" else [1]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = teacher.http_caller(f"http://127.0.0.1:{server.server_port}", lambda p: {"p": p}, lambda a: a["r"], 10)
    df = spark.createDataFrame([("1", "hi"), ("2", "bad")], "id string, prompt string")
    got = {r["id"]: (r["reply"], r["error"]) for r in teacher.call_model(df, "id", "prompt", call).collect()}
    server.shutdown()
    assert got["1"] == ("HI", None) and got["2"][1].startswith("ValueError")
    assert teacher.decoding_options({"max_new_tokens": 9, "t": 0}) == {"t": 0, "num_predict": 9}
