import hashlib
import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from quern.functions import tokens
from quern.functions.commits import TYPES
from quern.operators import dedup, intervals, lineage, models, reports, vocabulary
from quern.sources import files, git, teacher
from quern.streaming import ingest


def greedy(rows):
    p, s, kept = set(), set(), []
    for r in rows:
        if r[0] not in p and r[1] not in s:
            kept.append(r)
            p.add(r[0])
            s.add(r[1])
    return kept


@pytest.mark.parametrize("span", [6, 400])
def test_merge_keeps_what_a_fold_keeps(spark, span):
    rng = random.Random(span)
    one = [(f"p{rng.randrange(span)}", f"s{rng.randrange(span)}", i) for i in range(60)]
    two = [(f"p{rng.randrange(span)}", f"s{rng.randrange(span)}", i) for i in range(60)]
    schema = "p string, s string, _ord bigint"
    kept, report = dedup.merge_inputs([spark.createDataFrame(x, schema) for x in (one, two)], "p", "s")
    want = greedy(one + two)
    assert sorted(map(tuple, kept.collect())) == sorted(want)
    assert sum(r["kept"] for r in report.collect()) == len(want) and sum(r["rows"] for r in report.collect()) == 120


def test_merge_one_to_one(spark):
    schema = "p string, s string, _ord bigint"
    a, b = [("1", "x", 1), ("2", "y", 2), ("3", "z", 3)], [("1", "x", 1), ("4", "u", 2), ("5", "v", 3)]
    kept, report = dedup.merge_inputs([spark.createDataFrame(x, schema) for x in (a, b)], "p", "s")
    assert sorted(r["p"] for r in kept.collect()) == ["1", "2", "3", "4", "5"]
    assert {(r["input"], r["skipped"]) for r in report.collect()} == {(0, 0), (1, 1)}


def test_limits_and_resume(spark, rows):
    df = spark.createDataFrame([("a", i, i % 2 == 0) for i in range(6)] + [("b", i, True) for i in range(3)], "g string, _ord bigint, ok boolean")
    assert dedup.limit_per_group(df, ["g"], [F.asc("_ord")], 2).count() == 4
    got = dedup.limit_two_levels(df, ["g"], [F.asc("_ord")], 4, F.col("ok"), 4, [F.asc("g"), F.asc("_ord")])
    assert rows(got.select("g", "_ord")) == [("a", 0), ("a", 2), ("b", 0), ("b", 1)]
    there = spark.createDataFrame([("a",)], "g string")
    assert rows(dedup.new_rows(there, df, "g").select("g", "_ord")) == [("b", 0)]
    assert rows(dedup.duplicates(df, "g")) == [("a", 6, 0), ("b", 3, 0)]


def test_intervals(spark, rows):
    w = spark.createDataFrame([("r", "2025-01-01T00:00:00Z", "2025-07-01T00:00:00+00:00", "DEV", 1), ("r", "2025-06-01T00:00:00+02:00", "2026-01-01T00:00:00Z", "REPORT", 2), ("q", "bad", None, "DEV", 3), ("q", "2025-01-01T00:00:00", "2025-02-01T00:00:00", "DEV", 4)], "repo string, s string, e string, split string, _ord bigint")
    w = w.select("repo", intervals.rfc3339(F.col("s")).alias("start"), intervals.rfc3339(F.col("e")).alias("end"), "split", "_ord", F.col("_ord").alias("target_records"))
    c = spark.createDataFrame([("a", "r", "2025-06-15T00:00:00Z"), ("b", "r", "2025-08-01T00:00:00Z"), ("c", "r", "2026-01-01T00:00:00Z"), ("d", "q", "2025-01-15T00:00:00Z"), ("e", None, None)], "id string, repo string, t string").withColumn("at", intervals.rfc3339(F.col("t"))).drop("t")
    assert rows(intervals.assign_windows(c, w, ["repo"], "at", ["id"]).select("id", "split")) == [("a", "DEV"), ("b", "REPORT")]
    assert [r["_ord"] for r in intervals.overlaps(w, ["repo"], "_ord").collect()] == [2]
    nested = spark.createDataFrame([(1, "k", 0, 100), (2, "k", 10, 20), (3, "k", 50, 60)], "id bigint, k string, start bigint, end bigint")
    assert rows(intervals.overlaps(nested, ["k"], "id").select("id")) == [(2,)]
    assert rows(intervals.overlaps(nested, ["k"], "id", strict=True).select("id")) == [(2,), (3,)]
    s = {r["split"]: r for r in intervals.split_summary(w, ["DEV", "REPORT", "HELD_OUT"]).collect()}
    assert s["DEV"]["windows"] == 3 and s["HELD_OUT"]["windows"] == 0 and s["HELD_OUT"]["missing_targets"] is False
    assert tuple(intervals.largest_share(w, "repo").first()) == (4, 2, 0.5)
    assert intervals.largest_share(w.limit(0), "repo").first()["share"] is None


def test_lineage(spark, rows):
    ref = spark.createDataFrame([("s1", "DEV", None), ("s2", "REPORT", "x")], "sid string, split string, lic string")
    r = spark.createDataFrame([("a", "s1", "DEV", None), ("b", "s2", "DEV", "x"), ("c", "s9", "DEV", "x"), ("d", None, "DEV", None)], "id string, source string, split string, lic string")
    got = {x["id"]: x["errors"] for x in lineage.compare(r, ref, "source", "sid", {"split": "split", "lic": "lic"}).collect()}
    assert got == {"a": [], "b": ["split does not match"], "c": ["unknown source"], "d": ["unknown source"]}
    assert rows(lineage.missing(ref, r.where("source = 's1'"), "sid", "source")) == [("s2",)]
    new = spark.createDataFrame([("a", "NEW", None), ("b", "NEW", "z")], "id string, split string, lic string")
    done = {x["id"]: (x["split"], x["lic"]) for x in lineage.update(r, new, "id", ["split"], F.col("source") == "s1").collect()}
    assert done == {"a": ("NEW", None), "b": ("DEV", "x"), "c": ("DEV", "x"), "d": ("DEV", None)}
    checked = r.withColumn("errors", lineage.rule_errors([(lineage.filled("source", "s"), "no source"), (F.col("lic") == "x", "bad licence")]))
    assert {x["id"]: x["errors"] for x in checked.collect()}["d"] == ["no source", "bad licence"]
    with pytest.raises(ValueError, match="no source"):
        lineage.all_or_nothing(checked)
    assert lineage.all_or_nothing(checked.where("id = 'b'")).columns == r.columns
    g = lineage.gates(spark.range(3).agg(F.count("id").alias("n"), F.sum(F.lit(None).cast("int")).alias("z")), [("n", F.col("n"), "min", 3), ("m", F.col("n"), "max", 2), ("e", F.col("n"), "exact", 3), ("z", F.col("z"), "min", 1)])
    assert [x["status"] for x in g.collect()] == ["pass", "fail", "pass", "unknown"]


def test_reports(spark, rows):
    df = spark.createDataFrame([("a", True, None), ("a", False, None), ("b", True, True)], "g string, x boolean, y boolean")
    got = {(r["g"], r["signal"]): (r["n_true"], r["n_false"], r["n_null"]) for r in reports.tri_state(df, ["x", "y"], ["g"]).collect()}
    assert got["a", "x"] == (1, 1, 0) and got[None, "y"] == (1, 0, 2) and got[None, "x"] == (2, 1, 0)
    assert rows(reports.top(df, "g", 1)) == [("a", 2)]
    f = spark.createDataFrame([("1", {"x": True}, (True, None)), ("2", {"x": True, "y": False}, (True, True))], "id string, e map<string,boolean>, s struct<x boolean, y boolean>")
    assert rows(reports.fixture_results(f, "id", "e", "s")) == [("1", True), ("2", False)]


def test_vocabulary(spark):
    df = spark.createDataFrame([("1", "DEV", ["a", "b", "a", "<nl>"]), ("2", "REPORT", ["b", "c", "a"]), ("3", "REPORT", [])], "id string, data_split string, tokens array<string>")
    v = vocabulary.build(vocabulary.token_counts(df.where("data_split = 'DEV'")), 10, 1)
    got = {r["token"]: (r["id"], r["count"]) for r in v.collect()}
    assert got["a"] == (9, 2) and got["<nl>"] == (8, 1) and len(got) == 10 and "b" not in got
    cov = {r["data_split"]: r for r in vocabulary.coverage(df, v).collect()}
    assert (cov["REPORT"]["records"], cov["REPORT"]["tokens"], cov["REPORT"]["known"], cov["REPORT"]["known_fraction"]) == (2, 3, 1, 0.333333)
    enc = {r["id"]: (r["ids"], r["unknown_tokens"]) for r in vocabulary.encode(df, v, "id").collect()}
    assert enc["1"] == ([9, 1, 9, 8], 1) and enc["3"] == (None, None)
    plan = vocabulary.plan(df, 3, 3)
    assert {r["id"]: (r["decision"], r["trainer_tokens"]) for r in plan.collect()} == {"1": ("exclude_oversize", 0), "2": ("use_full", 3), "3": ("use_full", 0)}
    total = [r for r in vocabulary.accounting(plan).collect() if r["data_split"] is None][0]
    assert (total["records"], total["use_full"], total["exclude_oversize"], total["raw_tokens"]) == (3, 2, 1, 7)


def test_models(spark):
    train = spark.createDataFrame([(f"d{i}", ["docs/guide.md"], "docs") for i in range(6)] + [(f"f{i}", ["src/parser.py"], "fix") for i in range(6)], "id string, changed_paths array<string>, type string")
    new = spark.createDataFrame([("x", ["docs/other.md"]), ("y", ["lib/parser.rs"]), ("z", ["q.q"]), ("n", None)], "id string, changed_paths array<string>")
    got = {r["id"]: (r["predicted"], r["subject"]) for r in models.predict_path_types(new, models.train_path_types(train), "id").collect()}
    assert got == {"x": ("docs", "update docs documentation"), "y": ("fix", "handle parser behavior"), "z": ("docs", "update q documentation"), "n": ("docs", "update project documentation")}
    model = models.train_softmax(train, "id", "type", epochs=6).cache()
    assert {r["feature"] for r in model.collect()} == {"", "loss", *(r["feature"] for r in models.features(train, "id").select("feature").distinct().collect())}
    loss = model.where("feature = 'loss'").first()["weights"]
    assert loss[-1] < loss[0] and len(model.where("feature = ''").first()["weights"]) == len(TYPES)
    got = {r["id"]: r["predicted"] for r in models.predict_softmax(new, model, "id").collect()}
    assert got["x"] == "docs" and got["y"] == "fix"
    # of a larger training set those with the smallest hashes are taken
    few = [r["id"] for r in train.orderBy(F.xxhash64("id"), "id").limit(3).collect()]
    seen = {r["feature"] for r in models.train_softmax(train, "id", "type", epochs=1, limit=3).collect()}
    assert seen == {"", "loss", *(r["feature"] for r in models.features(train.where(F.col("id").isin(few)), "id").collect())}
    assert models.train_softmax(train.limit(0), "id", "type", epochs=1).count() == 0


def reference_margin(seqs, buckets, rate, scale, w=None):
    w = dict(w or {})
    for _, ids, mask in sorted(seqs):
        for p, on in enumerate(mask):
            if on:
                prev, target = (ids[p - 1] if p else 0), ids[p]
                b = int.from_bytes(hashlib.sha256(f"{prev}:{target}:{p}".encode()).digest()[:8], "little") % buckets
                sign = 1 if target % 2 else -1
                w.setdefault(b, 0)
                if scale - sign * w[b] > 0:
                    w[b] += rate * sign
    return w


def test_margin_trainer_resumes(spark):
    rng = random.Random(1)
    seqs = [(i, [rng.randrange(50) for _ in range(20)], [rng.randrange(2) for _ in range(20)]) for i in range(30)]
    df = spark.createDataFrame(seqs, "_ord bigint, ids array<int>, loss_mask array<int>")
    whole = {r["bucket"]: r["weight"] for r in models.train_margin(df, 16, 7, 40).collect()}
    assert whole == reference_margin(seqs, 16, 7, 40)
    first = models.train_margin(df.where("_ord < 10"), 16, 7, 40).cache()
    rest = {r["bucket"]: r["weight"] for r in models.train_margin(df.where("_ord >= 10"), 16, 7, 40, start=first).collect()}
    assert {**{r["bucket"]: r["weight"] for r in first.collect()}, **rest} == whole


def test_files(spark, tmp_path, rows):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id":"1","v":2}\n\n{"id":"2","v":null}\n')
    df = files.read_jsonl(spark, str(p), "id string, v bigint")
    assert rows(df.select("id", "v")) == [("1", 2), ("2", None)] and [r["id"] for r in df.orderBy("_ord").collect()] == ["1", "2"]
    for bad in ("[1]", "{oops", "3"):
        p.write_text('{"id":"1"}\n' + bad + "\n")
        with pytest.raises(Exception, match="invalid JSON object"):
            files.read_jsonl(spark, str(p), "id string, v bigint").collect()
    files.write_jsonl(df.limit(0).union(spark.createDataFrame([("9", 1, 5), ("8", None, 4)], df.schema)), str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [{"id": "8", "v": None}, {"id": "9", "v": 1}]
    new = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 3)], "id string, v bigint, _ord bigint")
    assert [files.append_new(new, str(tmp_path / "log"), "id", "id string, v bigint") for _ in range(2)] == [2, 0]
    doc = tmp_path / "d.json"
    doc.write_text(json.dumps({"id": "x", "windows": [{"a": 1}, {"a": 2}]}, indent=1))
    assert files.read_document(spark, str(doc), "id string, windows array<struct<a int>>").select(F.explode("windows")).count() == 2
    sums = files.checksums(spark, [str(doc)], str(tmp_path))
    assert tuple(sums.first()) == ("d.json", hashlib.sha256(doc.read_bytes()).hexdigest(), doc.stat().st_size)
    m = spark.createDataFrame([("d.json", "0"), ("none", "1")], "path string, sha256 string")
    assert rows(files.verify_checksums(m, sums).select("path", "status")) == [("d.json", "changed"), ("none", "missing")]
    assert files.fenced_template("x\n## User\n```text\nHi {name}: {paths}\n```\n", "## User") == "Hi {name}: {paths}"
    assert spark.range(1).select(files.render_template("Hi {name}: {paths}", {"name": F.lit("A"), "paths": F.to_json(F.array(F.lit("b")))})).first()[0] == 'Hi A: ["b"]'
    assert json.loads(files.write_report({"b": 1, "a": 2}, str(tmp_path / "r" / "x.json")).read_text()) == {"a": 2, "b": 1}


def test_git_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(3):
        (tmp_path / f"f{i}.py").write_text(f"x = {i}\n")
        run("add", ".")
        run("commit", "-qm", f"feat: add f{i}")
    spark.dataSource.register(git.GitCommits)
    got = spark.read.format("git_commits").option("path", str(tmp_path)).option("diff", "true").load().orderBy("rank").collect()
    assert [(r["subject"], r["changed_paths"]) for r in got] == [("feat: add f2", ["f2.py"]), ("feat: add f1", ["f1.py"])]
    assert "1 file changed" in got[0]["diff_stat"] and "+x = 2" in got[0]["diff"]


def test_teacher(spark, rows):
    def call(p):
        if p == "bad":
            raise RuntimeError("no")
        return p.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad")], "id bigint, prompt string")
    assert rows(teacher.call_model(df, "id", "prompt", call)) == [(1, "A", None), (2, None, "RuntimeError: no")]


def test_streaming_append_resumes(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id string, repo string, at timestamp"
    w = spark.createDataFrame([("r", "2025-01-01", "2026-01-01", "DEV")], "repo string, s string, e string, split string").select("repo", F.to_timestamp("s").alias("start"), F.to_timestamp("e").alias("end"), "split")

    def run():
        s = ingest.once_per_key(ingest.read_stream(spark, src, schema, "parquet"), "id", "at")
        ingest.append(ingest.assign(s, w, "repo", "at"), out, check).awaitTermination()

    mk = lambda *r: spark.createDataFrame(r, "id string, repo string, t string").select("id", "repo", F.to_timestamp("t").alias("at")).write.mode("append").parquet(src)
    mk(("a", "r", "2025-03-01"), ("a", "r", "2025-03-01"), ("b", "x", "2025-03-01"), ("c", "r", "2026-01-01"))
    run()
    mk(("d", "r", "2025-12-31 12:00:00"), ("a", "r", "2025-03-01"))
    run()
    got = spark.read.parquet(out)
    assert {r["id"] for r in got.collect()} == {"a", "d"}


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(f"k{rng.randrange(40)}", i, rng.random()) for i in range(400)], "k string, _ord bigint, v double")
    a = sorted(map(tuple, dedup.last_rows(df, "k", "v").collect()))
    assert a == sorted(map(tuple, dedup.last_rows(df.repartition(13), "k", "v").collect()))
    assert sorted(map(tuple, dedup.first_rows(df, "k").collect())) == sorted(map(tuple, dedup.first_rows(df.repartition(7, "v"), "k").collect()))


def test_session_scratch_and_tokens(spark):
    from quern.session import materialize, scratch_dir

    assert scratch_dir(spark)
    df = spark.range(5).select("id", tokens.tokenize(F.lit("a b")).alias("t"))
    assert materialize(df).count() == 5 and materialize(df.limit(0)).dtypes == df.dtypes


def test_margin_weights_train_on_dev(spark):
    from quern.plans import core

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    dev = core._streams(spark, d).where("data_split = 'DEV'").select(F.size(tokens.tokenize(F.col("reply"))).alias("n")).agg(F.sum("n")).first()[0]
    assert core.margin_weights(spark, d).agg(F.sum("tokens")).first()[0] == dev
