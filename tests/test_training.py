import hashlib
import random
import struct

from pyspark.sql import functions as F

from quern.functions.tokens import record_stream
from quern.operators import lineage, training, vocabulary


def inputs(spark):
    return spark.createDataFrame([("a", "sys", "user text", ["src/a.py"]), ("b", "sys", "more", ["b.py"])], "source_diff_id string, system string, user string, changed_paths array<string>")


def test_training_rows(spark, rows):
    labels = spark.createDataFrame([("generated-a", "fix: a thing", ["why"], []), ("generated-b", "feat: b thing", [], ["Refs: #1"])], "id string, header string, body array<string>, footers array<string>")
    edits = spark.createDataFrame([("generated-b", "feat: better thing", None, None)], "label_id string, edited_header string, edited_body array<string>, edited_footers array<string>")
    got = lineage.all_or_nothing(training.training_rows(labels, inputs(spark), edits))
    assert rows(got.select("id", "target_message")) == [("sft-a", "fix: a thing\n\nwhy"), ("sft-b", "feat: better thing\n\nRefs: #1")]
    assert [m["role"] for m in got.first()["messages"]] == ["system", "user", "assistant"]
    seen = {r["id"]: r for r in training.inspection_rows(got, labels).collect()}
    assert not seen["sft-a"]["changed_from_teacher"] and seen["sft-b"]["changed_from_teacher"] and seen["sft-b"]["teacher_score"]["format_validity"]
    bad = training.training_rows(labels.union(spark.createDataFrame([("generated-z", None, None, None)], labels.schema)), inputs(spark))
    assert rows(bad.where("size(errors) > 0").select("errors")) == [(["no input for generated-z", "no header in generated-z"],)]
    p = spark.createDataFrame([("sft-a", "fix: other thing"), ("sft-b", "nope")], "id string, prediction_message string")
    assert {r["id"]: (r["exact_match"], r["type_match"]) for r in training.prediction_rows(got, p).collect()} == {"sft-a": (False, True), "sft-b": (False, False)}


def test_sequences(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    data = [(f"r{i}", [("system", say(3)), ("user", say(n)), ("assistant", say(4))]) for i, n in enumerate([0, 1, 20, 32, 33, 40, 75, 200])]
    data += [("two", [("user", say(30)), ("user", say(30)), ("assistant", "a")]), ("tool", [("tool", "x"), ("assistant", "a")]), ("mute", [("user", "a")]), ("big", [("system", say(60)), ("user", "a"), ("assistant", "b")]), ("bare", [("assistant", "a")])]
    df = spark.createDataFrame(data, "id string, messages array<struct<role string, content string>>")
    v = vocabulary.build(vocabulary.token_counts(df.select(record_stream(F.col("messages")).alias("tokens"))), 14, 1)
    ids = {r["token"]: r["id"] for r in v.collect()}
    out = training.sequences(df, v, 48, 120).cache()
    got = {r["id"]: r for r in out.collect()}
    for name, messages in data[:7]:
        w = {r: c.split() for r, c in messages}
        budget = 48 - 8 - len(w["system"]) - len(w["assistant"])
        user = w["user"]
        if len(user) > budget:
            head = (budget + 1) // 2
            user = user[:head] + user[len(user) - (budget - head) :]
        stream = ["<bos>", "<system>", *w["system"], "<sep>", "<user>", *user, "<sep>", "<assistant>", *w["assistant"], "<sep>", "<eos>"]
        r = got[name]
        assert r["input_ids"] == [ids.get(t, 1) for t in stream] and r["input_length"] == len(stream) <= 48
        assert sum(r["loss_mask"]) == r["loss_tokens"] == 6 and len(r["loss_mask"]) == len(stream)
        assert r["input_ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(stream)}i", *r["input_ids"])).hexdigest()
        assert r["crop"]["policy"] == ("full" if len(w["user"]) <= budget else "deterministic_prefix_suffix")
    assert got["r7"]["decision"] == "exclude_oversize" and got["r7"]["input_ids"] is None
    assert [got[k]["error"] is None for k in ("two", "tool", "mute", "big", "bare")] == [False, False, False, False, True]
    assert training.stale(out, out).count() == 0
    old = out.withColumn("loss_mask_sha256", F.when(F.col("id") == "r1", "0").otherwise(F.col("loss_mask_sha256"))).where("id <> 'r2'")
    assert {tuple(r) for r in training.stale(out, old).collect()} == {("r1", "loss_mask_sha256 differs"), ("r2", "not recorded")}
    assert training.sequences(df.limit(0), v, 48, 120).count() == 0
