import subprocess

import pytest
from pyspark.sql import functions as F

from quern.plans import sql
from quern.session import materialize, release
from quern.sources import catalog, git
from quern.streaming import ingest


def test_sql_functions(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "t.parquet"))
    assert sql.register(spark, str(tmp_path), ["t.parquet"]) == ["t"]
    r = spark.sql(r"select repo_key(' git@H.example:o/n.git ') a, norm_path('.\\x\\y') b, code_tokens('a>=b\nc') c, commit_type('feat(x)!: y') d, commit_scope('feat(x)!: y') e, commit_type('no') f, (select count(*) from t) n").first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.n) == ("h.example/o/n", "x/y", ["a", ">=", "b", "<nl>", "c"], "feat", "x", None, 4)


def test_catalog():
    assert str(catalog.artifact_path("eval", "pilot-1", "v0", "REPORT")) == "artifacts/eval/pilot-1.v0.REPORT.json"
    for bad in ("../x", "", "-", "a b"):
        with pytest.raises(ValueError):
            catalog.artifact_path("train", bad)
    with pytest.raises(ValueError):
        catalog.split_argument("dev")
    assert catalog.relative_to("/d/a/b.json", "/d") == "$DATA_DIR/a/b.json" and catalog.relative_to("a/b", "/d") == "a/b"


def test_probe(spark, tmp_path, rows):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("commit", "-q", "--allow-empty", "-m", "x")
    df = spark.createDataFrame([(1, str(tmp_path), "HEAD"), (2, str(tmp_path), "nope"), (3, str(tmp_path / "none"), "HEAD"), (4, None, None)], "id bigint, repo string, rev string")
    assert rows(git.probe(df, "id", "repo", ["rev"])) == [(2, "no revision nope"), (3, "no repository"), (4, "no repository")]


def test_release(spark):
    df = materialize(spark.range(3))
    assert df.count() == 3 and release(spark) >= 1 and release(spark) == 0


def test_window_counts_drop_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    put = lambda *t: spark.createDataFrame([("a", x) for x in t], "k string, t string").select("k", F.to_timestamp("t").alias("at")).coalesce(1).write.mode("append").parquet(src)

    def run():
        s = ingest.counts(ingest.read_stream(spark, src, "k string, at timestamp", "parquet"), "at", ["k"])
        ingest.append(s, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    put("2025-01-01 00:05:00", "2025-01-01 00:55:00", "2025-01-01 03:00:00")
    run()
    put("2025-01-01 00:10:00", "2025-01-01 05:00:00")
    run()
    got = {str(r["start"]): r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2025-01-01 00:00:00": 2, "2025-01-01 03:00:00": 1}
