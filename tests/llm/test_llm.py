import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import capping, components, handwritten, leaks, mixing, overlap, packing, stuffing, terms, tokens

LABEL = "id string, source_repo_url string, source_commit string, data_split string, changed_paths array<string>, type string, scope string, confidence double, _ord bigint, term string, n bigint, _key string, _group string"


def labels(spark, *rows):
    """Rows as dicts; the columns term, n, _key and _group clash with names used inside."""
    names = [c.split()[0] for c in LABEL.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], LABEL)


# 1 terms


def test_terms_count_occurrences_and_records(spark, rows):
    t = labels(
        spark,
        {"id": "a", "type": " Fix!", "scope": "Core, core/api", "_ord": 1},
        {"id": "a", "type": "feat", "scope": "x", "_ord": 0},
        {"id": "b", "type": "fix ", "scope": None, "_ord": 1},
        {"id": "b", "type": "fix ", "scope": None, "_ord": 1},
        {"id": "c", "type": None, "scope": " , +", "_ord": None},
        {"id": None, "type": "fix", "_ord": 9},
    )
    assert rows(terms.term_frequency(terms.label_terms(t))) == [("scope", "api", 1, 1), ("scope", "core", 2, 1), ("type", "fix", 2, 2)]
    assert rows(terms.label_term_marks(t).select("term", "mark")) == [("api", "rare"), ("core", "rare"), ("fix", "rare")]


def test_terms_marks_and_hot_term(spark):
    t = spark.range(2000).select(F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") < 900, "hot").when(F.col("id") < 1000, F.concat(F.lit("edge"), F.floor(F.col("id") / 4))).otherwise(F.concat(F.lit("t"), F.col("id") % 20)).alias("type"), F.lit(None).cast("string").alias("scope"), F.lit(1).alias("_ord"))
    got = {r["term"]: (r["records"], r["mark"]) for r in terms.label_term_marks(t).collect()}
    assert got["hot"] == (900, "common") and got["edge225"] == (4, "useful") and got["t3"] == (50, "useful")


# 2 hand-written files


@pytest.mark.parametrize("path", ["a/yarn.lock", "go.sum", "X/package-lock.json", "a/b.min.js", "p/x-min.js", "public/1.0a9f8b7c.chunk.js", "static/app.9f8b7c01.js", "s/a.js.map", "api/v1/zz_generated.deep.go", "x_pb2.py", "a/b.pb.go", "lib/a.g.dart", "F/M.Designer.cs", "ui/moc_a.cpp", "src/p.tab.c", "src/__generated__/a.ts", "gen-src/a.js", "dist/a.py", "web/dist/js/a.js", "build/x.go", "Vendor/a/b.go", "src/_vendor/x.py", "ThirdParty/a.c", "third_party/a.py", "web/node_modules/a/i.js", "deps/foo-1.2.3/src/a.c", "static/lib/foo-4.8.7.js", "ios/Pods/A/a.m", "env/lib/site-packages/a.py", "fw/a.bin.h", "web/a_wasm_binary.js", "src/a_base64.ts"])
def test_made_by_tools(spark, path):
    assert spark.createDataFrame([(path,)], "p string").select(handwritten.path_kind(F.col("p"))).first()[0] is not None


@pytest.mark.parametrize("path", ["src/vendor_portal/a.ts", "distributed/a.go", "packages/bundler/a.ts", "src/locking/a_lock.py", "scripts/lock_a.py", "tools/gen_a.py", "src/codegen/a.rs", "tests/test_minify_a.py", "lib/minimum_a.js", "src/proto_reader_a.go", "docs/third-party-a.md", "proto/a.proto", "src/builder/a.py", "src/sourcemap/a.js", "src/blobstore/a.ts", "examples/09_a.js", "a.py", ""])
def test_written_by_hand(spark, path):
    assert spark.createDataFrame([(path,)], "p string").select(handwritten.path_kind(F.col("p"))).first()[0] is None


def test_globs_and_spelling(spark, rows):
    t = labels(
        spark,
        {"id": "a", "source_repo_url": "git@H.example:o/n.git", "changed_paths": ["./legacy\\x\\y.py", "src/a.py", "schema/b.json", "schema/z.json", "src/a.py", None, ""], "_ord": 1},
        {"id": "b", "source_repo_url": None, "changed_paths": ["legacy/y.py", "vendor/a.py"], "_ord": 1},
        {"id": "c", "source_repo_url": "https://h.example/o/n", "changed_paths": None, "_ord": 1},
    )
    m = spark.createDataFrame([("https://www.h.example/O/N/", ["legacy/**", "schema/[a-m]*.json", "", None], 2), ("https://h.example/o/n", ["src/*"], 1), (None, ["*"], 5)], "repo_url string, exclude_globs array<string>, _ord bigint")
    none = spark.createDataFrame([], "alias_url string, repo_url string")
    assert handwritten.found(t.limit(0), m.limit(0), none).count() == 0
    assert {r["kind"]: r["paths"] for r in handwritten.report(t, m, none).collect()} == {"glob": 2, "third_party": 1, None: 3}
    assert rows(handwritten.found(t, m, none)) == [("a", "./legacy\\x\\y.py"), ("a", "schema/b.json"), ("b", "vendor/a.py")]


def test_winnowing_finds_copies_in_many_repositories(spark):
    copy = ["tables_v2.c", "tables_v2.h", "core.c", "lexer.c", "README"]
    data = [(f"https://h/o/r{i}", [f"ext{i}/libfoo/{n}" for n in copy] + [f"src/{chr(97 + i)}own_{j}.c" for j in "abcde"] + ["index.js", "src/main.c"]) for i in range(25)]
    data += [(f"https://h/o/alias{i}", [f"pkg/few/{n}" for n in ("a.c", "b.c", "c.c")]) for i in range(19)] + [(f"https://h/o/same{i}", [f"pkg/few/{n}" for n in ("a.c", "b.c", "c.c")]) for i in range(8)]
    t = labels(spark, *({"id": f"l{i}", "source_repo_url": u, "changed_paths": p, "_ord": 1} for i, (u, p) in enumerate(data)), {"id": "n", "source_repo_url": None, "changed_paths": ["x/a", "x/b", "x/c"], "_ord": 1})
    m = spark.createDataFrame([], "repo_url string, exclude_globs array<string>, _ord bigint")
    a = spark.createDataFrame([(f"https://h/o/same{i}", "https://h/o/alias0") for i in range(8)], "alias_url string, repo_url string")
    got = handwritten.classify(t, m, a).where("kind is not null").collect()
    assert {r["kind"] for r in got} == {"copy"} and len(got) == 25 * 5 and all("libfoo" in r["path"] for r in got)
    assert {r["repos"]: r["prints"] for r in handwritten.recurrence_report(t, a).collect()}[19] == 1
    assert handwritten.recurrence_report(t.limit(0), a.limit(0)).count() == 0


# 3 overlap


def brute_overlap(data):
    out = set()
    for (a, x), (b, y) in itertools.permutations(data.items(), 2):
        if x["data_split"] == "DEV" and y["data_split"] != "DEV":
            p, q = set(x["changed_paths"]), set(y["changed_paths"])
            c, d = x["source_commit"], y["source_commit"]
            if (len(c) >= 7 and len(d) >= 7 and (c.startswith(d) or d.startswith(c))) or (min(len(p), len(q)) >= 5 and len(p & q) * 5 >= len(p | q) * 4):
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("hot", [20_000, 0])
def test_overlap_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT_PAIRS", hot)
    rng = random.Random(5)
    pool = [f"src/f{i}.py" for i in range(60)]
    common = pool[:4]
    data = {}
    for i in range(260):
        base = rng.sample(pool, rng.randint(1, 14)) if rng.random() < 0.5 else common + rng.sample(pool[4:16], rng.randint(1, 6))
        if i and rng.random() < 0.4:
            base = list(data[f"id{rng.randrange(i)}"]["changed_paths"])
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(pool)
        commit = f"{rng.getrandbits(160):040x}"
        if i and rng.random() < 0.15:
            commit = data[f"id{rng.randrange(i)}"]["source_commit"][: rng.choice([6, 7, 9, 40])]
        data[f"id{i}"] = {"id": f"id{i}", "changed_paths": base, "data_split": rng.choice(["DEV", "DEV", "REPORT", "HELD_OUT"]), "source_commit": commit, "_ord": 1}
    t = labels(spark, *data.values())
    got = {tuple(r) for r in overlap.found(t).collect()}
    assert got == brute_overlap(data) and got
    leaked = {x for pair in got for x in pair if data[x]["data_split"] != "DEV"}
    assert sum(r["leaked"] for r in overlap.report(t).collect()) == len(leaked)


def test_overlap_of_long_changes_and_coverage(spark):
    own = [f"p{i:04d}" for i in range(3000)]
    near = own[:1400] + own[1500:] + ["q1", "q2"]
    far = own[:1500] + [f"r{i}" for i in range(1500)]
    data = [("a", "DEV", own), ("b", "REPORT", near), ("c", "HELD_OUT", far), ("d", "REPORT", ["x1", "p0000", "p0001", "p0002", "x2", "p0009", "x3"])]
    t = labels(spark, *({"id": i, "data_split": s, "source_commit": None, "changed_paths": p, "_ord": 1} for i, s, p in data))
    assert [tuple(r) for r in overlap.found(t).collect()] == [("a", "b")]
    got = {r["split"]: (r["paths"], r["covered"]) for r in overlap.report(t).collect()}
    assert got == {"REPORT": (len(near) + 7, len(near) - 2 + 3), "HELD_OUT": (3000, 1500)}


def test_overlap_nulls_spelling_and_empty(spark, rows):
    t = labels(
        spark,
        {"id": "a", "data_split": " dev", "source_commit": "ABCDEF1234", "changed_paths": ["./a", "b", "c\\d", "e", "f"], "_ord": 1},
        {"id": "b", "data_split": "report ", "source_commit": "abcdef1", "changed_paths": None, "_ord": 1},
        {"id": "c", "data_split": "HELD_OUT", "source_commit": None, "changed_paths": ["a", "b", "c/d", "e", "./f", "f", ""], "_ord": 1},
        {"id": "d", "data_split": None, "source_commit": "abcdef1234", "changed_paths": ["a", "b", "c/d", "e", "f"], "_ord": 1},
        {"id": "e", "data_split": "REPORT", "source_commit": "", "changed_paths": [], "_ord": 1},
        {"id": "a", "data_split": "REPORT", "source_commit": "abcdef1", "_ord": 0},
    )
    assert rows(overlap.found(t)) == [("a", "b"), ("a", "c")]
    assert {(r["split"], r["labels"], r["leaked"]) for r in overlap.report(t).collect()} == {("REPORT", 2, 1), ("HELD_OUT", 1, 1)}
    assert overlap.found(t.limit(0)).count() == 0


# 4 components and splits


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(f"v{rng.randrange(300)}", f"v{rng.randrange(300)}") for _ in range(220)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)] + [(None, "x"), ("y", "y")]
    got = {r["vertex"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            parent[find(a)] = find(b)
    assert set(got) == set(parent)
    for a, b in itertools.combinations(sorted(parent), 2):
        assert (got[a] == got[b]) == (find(a) == find(b))


PLAN = "id string, plan_id string, repo_url string, split string, target_records bigint, _ord bigint, entity string"


def test_torn_entities_and_assignment(spark, rows):
    p = spark.createDataFrame(
        [("w1", "p", "https://h/o/a", "DEV", 10, 1, None), ("w2", "p", "https://h/o/B.git", " report", 5, 1, None), ("w3", "p", "https://h/o/c", "DEV", None, 1, None), ("w4", "q", "https://h/o/b", "DEV", 0, 1, None), ("w4", "q", "https://h/o/z", "DEV", 0, 0, None), ("w5", None, None, "DEV", -4, 1, None), ("w6", None, None, "REPORT", 4, 1, None)],
        PLAN,
    )
    a = spark.createDataFrame([("http://h/o/a", "git@h:o/x", "rename"), ("https://h/o/x", "https://h/O/b/", "fork"), (None, "https://h/o/c", "mirror")], "alias_url string, repo_url string, relation string")
    assert rows(components.torn_windows(p, a)) == [("w1",), ("w2",)]
    t = spark.createDataFrame([("DEV", 0.8), ("REPORT", 0.1), ("HELD_OUT", 0.1)], "split string, share double")
    got = components.plan_splits(p, a, t).collect()
    assert len(got) == 6 and len({r["split"] for r in got if r["window_id"] in ("w1", "w2")}) == 1
    assert components.plan_splits(p.limit(0), a.limit(0), t).count() == 0
    assert {r["split"] for r in components.plan_splits(p, a, t.limit(0)).collect()} == {None}


def test_splits_come_close_to_the_shares(spark):
    p = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("id"), F.lit("p").alias("plan_id"), F.concat(F.lit("https://h/o/r"), F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 1500)).alias("repo_url"), F.lit("DEV").alias("split"), (F.col("id") % 90).alias("target_records"), F.lit(1).alias("_ord"))
    a = spark.createDataFrame([], "alias_url string, repo_url string")
    t = spark.createDataFrame([("DEV", 0.8), ("REPORT", 0.1), ("HELD_OUT", 0.1)], "split string, share double")
    part = {r["split"]: r["part"] for r in components.plan_report(p, a, t).collect()}
    assert abs(part["DEV"] - 0.8) < 0.01 and abs(part["REPORT"] - 0.1) < 0.01
    whole = components.plan_splits(p, a, t).groupBy("entity").agg(F.count_distinct("split").alias("k")).where("k > 1")
    assert whole.count() == 0


# 5 tokens


def test_trie_count_is_the_cheapest_path():
    costs = {b"a": 1.0, b"b": 1.2, b"ab": 1.5, b"abc": 4.0, b"c": 2.0, "ü".encode(): 1.0}
    trie = tokens.DoubleArray(costs)
    assert [trie.count(s.encode()) for s in ("", "ab", "abc", "abab", "ü", "x", "axb")] == [0, 1, 2, 2, 1, 1, 3]


def test_token_estimate_is_near_the_tokenizer(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=tokens.default_model())
    texts = ["The matrix now has to render late visitors before the diff is built.", "Je préfère charger le grammar une seule fois.\n\n- a  b", "fix(parser): handle `foo_bar()` in src/a.py"] * 5
    counter = tokens.Counter(tokens.DoubleArray(tokens.vocabulary(tokens.default_model())))
    mine, exact = sum(map(counter.tokens, texts)), sum(len(x) for x in sp.encode(texts))
    assert abs(mine / exact - 1) < 0.08 and counter.tokens(None) == counter.tokens("") == 0
    texts += [None, "", "  two  spaces ", "\x00 odd \u2028 é ﬁ <s>", "x" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.token_counter()("t").alias("c"), "t")
    for r in df.collect():
        assert r["c"]["exact"] == (len(sp.encode(r["t"])) if r["t"] else 0)
        # a run of one letter is where merges and best paths differ most: a third here
        assert abs(r["c"]["tokens"] - r["c"]["exact"]) <= (0.34 if r["t"] and r["t"][0] == "x" else 0.2) * r["c"]["exact"] + 2


def test_document_tokens_and_loss_tokens(spark, rows):
    d = spark.createDataFrame([(1, "a b", " EN", "S ", "https://h/o/n.git"), (2, None, None, "", None), (3, "", "en", "s", "https://h/o/n")], "doc_id bigint, text string, lang string, source string, repo_url string")
    got = rows(tokens.document_tokens(d))
    assert got == [(None, None, None, 1, 0, 0), ("s", "en", "h/o/n", 2, got[1][4], got[1][5])] and got[1][4] > 0 and got[1][5] > 0
    m = spark.createDataFrame([("r1", "x", 5, 9, 1), ("r1", "x", 7, 9, 2), ("r2", "x", 10, 9, 1), ("r3", None, 3, None, 1), ("r4", "x", None, 5, 1)], "record_id string, source_diff_id string, loss_tokens bigint, input_length bigint, _ord bigint")
    t = labels(spark, {"id": "generated-x", "source_repo_url": "https://h/o/n", "_ord": 1})
    e = spark.createDataFrame([("https://h/o/N/", " Java ", 1)], "repo_url string, ecosystem string, _ord bigint")
    assert rows(tokens.loss_tokens(m, t, e)) == [(None, None, 1, 0, 3), ("h/o/n", "java", 3, 2, 7)]
    assert tokens.budget(d.limit(0), m.limit(0), t.limit(0), e.limit(0)).count() == 0


# 6 capping


def test_capping_equals_sorting(spark):
    rng = random.Random(3)
    data = [(f"k{i:04d}", rng.choice(["a", "a", "a", "b", None, "c"]), rng.choice([0.5, 0.5, 0.9, 0.95, 1.0, 0.0, float("nan"), None, 1.5, -0.1, rng.random()])) for i in range(900)]
    df = spark.createDataFrame(data, "key string, who string, quality double")
    for cap in (0, 7, 100, 5000):
        one = spark.createDataFrame([(cap,)], "cap bigint")
        groups = {}
        for k, g, q in data:
            groups.setdefault(g or "", []).append((-(q if q is not None and 0 <= q <= 1 else -1), k))
        want = {k for v in groups.values() for _, k in sorted(v)[cap:]}
        assert {r["key"] for r in capping.beyond_cap(df, "who", "key", "quality", one).collect()} == want
    assert capping.beyond_cap(df.limit(0), "who", "key", "quality", one).count() == 0


def test_labels_beyond_cap(spark, rows):
    t = spark.range(300).select(F.format_string("l%03d", "id").alias("id"), F.lit("https://h/o/n").alias("source_repo_url"), F.lit(0.5).alias("confidence"), F.lit(1).alias("_ord"), F.lit(1).alias("repo"), F.lit(2).alias("rank"))
    got = rows(capping.labels_beyond_cap(t.unionByName(t)))
    assert len(got) == 297 and got[0][0] == "l003"


# 7 packing


def test_packing_keeps_every_token_once(spark, rows):
    rng = random.Random(4)
    data = [("m", "DEV", 100, f"r{i}", rng.choice([5, 20, 60, 99, 100, 101, 250, rng.randint(1, 99)]), rng.choice(["a", "b", None])) for i in range(700)] + [("m", "DEV", 100, "z", None, "a"), ("m", "DEV", 100, "y", 0, "a"), ("m", "DEV", None, "x", 5, "a"), ("m", "DEV", 100, None, 5, "a")]
    df = spark.createDataFrame(data, "materialization_id string, data_split string, capacity bigint, record_id string, length bigint, source string")
    out = packing.pack(df)
    got = out.collect()
    size, per = {}, {}
    for r in got:
        per[r["record_id"]] = per.get(r["record_id"], 0) + r["pieces"] * r["length"]
        size[r["sequence"]] = size.get(r["sequence"], 0) + r["length"]
    assert per == {r[3]: r[4] for r in data[:700]} and max(size.values()) <= 100
    assert {r[0] for r in packing.divided(out).collect()} == {r[3] for r in data[:700] if r[4] > 100}
    mixed = {r["source"]: r for r in packing.mixture(out).collect()}
    assert abs(sum(r["share"] for r in mixed.values()) - 1) < 1e-5 and len({r["distance"] for r in mixed.values()}) == 1
    inside = {}
    for r in got:
        if not r["sequence"].startswith("w:"):
            inside.setdefault(r["sequence"], {}).setdefault(r["source"], 0)
            inside[r["sequence"]][r["source"]] += r["length"]
    far = [sum(abs(v.get(s, 0) / sum(v.values()) - r["share"]) for s, r in mixed.items()) / 2 for v in inside.values()]
    assert abs(sum(far) / len(far) - mixed["a"]["distance"]) < 1e-4
    report = packing.report(out).first()
    assert report["sequences"] <= report["fewest"] * 1.1
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_follows_targets():
    rng = random.Random(1)
    queues = {s: sorted((rng.randint(5, 40), i) for i in range(n * 100, n * 100 + 100)) for n, s in enumerate("ab")}
    lengths = {i: (n, s) for s, q in queues.items() for n, i in q}
    first = packing.fill(queues, {"a": 0.75, "b": 0.25}, 200, {})[:10]
    part = sum(lengths[i][0] for t in first for i in t if lengths[i][1] == "a") / sum(lengths[i][0] for t in first for i in t)
    assert abs(part - 0.75) < 0.1


# 8 leaks


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(5, 60)))) for i in range(20)] + [(None, "a"), (50, None)]
    docs = []
    for d in range(120):
        text = rng.choices(words, k=rng.randint(0, 80))
        if rng.random() < 0.5:
            w = rng.choice(items[:20])[1].split()
            k = rng.randint(8, 20)
            at = rng.randint(0, max(0, len(w) - k))
            text[10:10] = [rng.choice(["*{}*", "{}­", "{},", "\n{}", "<{}>"]).format(x.upper()) for x in w[at : at + k]]
        docs.append((d, rng.choice([" ", " ", "_"]).join(text)))
    docs.append((500, None))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for d, t in docs:
        w = leaks.words_of(t) if t else []
        grams = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        for i, x in items:
            v = leaks.words_of(x) if x else []
            if i is not None and any(tuple(v[k : k + 13]) in grams for k in range(len(v) - 12)):
                want.add((d, i))
    got = {tuple(r) for r in leaks.found(df, it).collect()}
    assert got == want and len(got) > 5
    assert leaks.found(df, it.limit(0)).count() == leaks.found(df.limit(0), it).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_index_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(0)
    (prints,) = leaks.WordBits().fingerprints([f"x{i}" for i in range(200)])
    index = leaks.NearIndex(prints, radius)
    for bits in range(10):
        a = prints[rng.integers(0, len(prints), 100)].copy()
        for row in range(len(a)):
            for b in rng.choice(64, bits, replace=False):
                a[row] ^= np.uint64(1) << np.uint64(b)
        assert set(index.near(a)[0].tolist()) == {i for i, x in enumerate(a) if np.bitwise_count(prints ^ x).min() <= radius}


def test_fingerprints_of_long_texts_and_several_sizes():
    rng = random.Random(3)
    words = [f"w{rng.randrange(50)}" for _ in range(leaks.CHUNK + 700)]
    bits = leaks.WordBits()
    for size, prints in zip((13, 192), bits.fingerprints(words, (13, 192)), strict=True):
        assert len(prints) == len(words) - size + 1
        for at in (0, leaks.CHUNK - 1, leaks.CHUNK, len(prints) - 1):
            assert prints[at] == bits.fingerprints(words[at : at + size], (size,))[0][0]


def test_near_copies_recall_on_planted_edits(spark):
    rng = random.Random(12)
    words = ["the", "of", "and", "to", "in"] * 60 + [f"word{i}" for i in range(900)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([20, 40, 60, 110, 150, 220])))) for i in range(60)]
    docs, planted = [], []
    for d in range(300):
        i = rng.randrange(60)
        own = items[i][1].split()
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[], [rng.choice(words)], [own[k], rng.choice(words)]])
        docs.append((d, " ".join(rng.choices(words, k=rng.randint(0, 60)) + own + rng.choices(words, k=rng.randint(0, 60)))))
        planted.append((d, i))
    docs += [(1000 + d, " ".join(rng.choices(words, k=200))) for d in range(50)] + [(2000, None), (None, items[0][1])]
    want = set()
    for d, i in planted:
        w, own = docs[d][1].split(), items[i][1].split()
        size = max(s for s in leaks.SIZES if s <= len(own))
        at = sorted({*range(0, len(own) - size + 1, size // 2), len(own) - size})
        if max(leaks.similarity(own[a : a + size], w[k : k + size]) for a in at for k in range(len(w) - size + 1)) >= leaks.SIMILAR:
            want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(3)).withColumn("similarity", F.lit(2))
    it = spark.createDataFrame(items + [(None, "a"), (99, None), (98, "too short")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.near_copies(df, it).collect()}
    recall = len(got & want) / len(want)
    print("recall", recall, len(want))
    assert len(want) > 100 and got <= set(planted) and recall >= 0.9
    assert leaks.near_copies(df, it.limit(0)).count() == leaks.near_copies(df.limit(0), it).count() == 0
    r = leaks.report(df.withColumn("source", F.lit(" A ")), it).collect()
    assert {x["source"] for x in r} == {"a"} and sum(x["near"] for x in r) == len(got)


# 9 mixing


def test_mix_reaches_the_shares(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "Big ").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("source"), F.when(F.col("id") % 50 == 3, None).otherwise(F.repeat(F.lit("word and more "), (F.col("id") % 7 + 1).cast("int"))).alias("text"), F.lit(1).alias("rank"))
    t = spark.createDataFrame([("big", 0.5, 1), ("MID", 0.3, 2), ("small", 0.2, 3), ("none", 0.1, 5), (None, 0.3, 1)], "source string, target_share double, max_repeats bigint")
    drawn = mixing.mix(docs, t)
    assert drawn.where("doc_id % 50 = 3").count() == 0
    got = {r["source"]: r for r in mixing.shares(drawn, t).collect()}
    assert abs(got["big"]["share"] - 0.5) < 0.002 and abs(got["mid"]["share"] - 0.3) < 0.002 and abs(got["small"]["share"] - 0.2) < 0.002
    assert got["small"]["repeats"] <= 3 and got["mid"]["repeats"] <= 2 and got["big"]["repeats"] == 1 and got["none"]["tokens"] == 0
    assert drawn.groupBy("doc_id", "repeat").count().where("count > 1").count() == 0
    assert mixing.mix(docs.limit(0), t).count() == mixing.mix(docs, t.limit(0)).count() == 0


def test_mix_counts_tokens_exactly_and_spreads_them(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers

    with open(mixing.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "fix(parser): handle `foo_bar()`\n\n", "Größe  über\u00a0alles", "<|endoftext|> x" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r[0] for r in df.select(mixing.exact_counter()("text"), "doc_id").orderBy("doc_id").collect()] == [len(e.encode_ordinary(t)) if t else 0 for t in texts]
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), (F.col("id") % 40 + 1).alias("text"))
    t = spark.createDataFrame([("a", 0.4, 2), ("b", 0.6, 1), ("b", 0.1, 9)], "source string, target_share double, max_repeats bigint")
    drawn = mixing.mix(docs, t, size=F.col("text"), slot_tokens=500).collect()
    slots = max(r["slot"] for r in drawn) + 1
    half = sum(r["tokens"] for r in drawn if r["slot"] < slots / 2 and r["source"] == "a") / sum(r["tokens"] for r in drawn if r["slot"] < slots / 2)
    assert abs(half - 0.4) < 0.02 and {r["repeat"] for r in drawn if r["source"] == "a"} <= {0, 1}


# 10 stuffing


def test_stuffing_marks_lists_and_salad(spark):
    rng = random.Random(8)
    nouns = [f"noun{i}" for i in range(200)]
    sentence = lambda: f"The {rng.choice(nouns)} keeps its old {rng.choice(nouns)} because the {rng.choice(nouns)} was moved before the {rng.choice(nouns)} could start."
    good = [" ".join(sentence() for _ in range(8)) for _ in range(300)]
    keys = ["git hooks", "code search", "build cache", "merge bot"]
    bad = [
        ", ".join(f"{rng.choice(['best', 'free', 'buy'])} {rng.choice(keys)}" for _ in range(60)),
        "\n".join(f"https://best-{i}.example/p/{i}" for i in range(40)),
        " ".join(f"#{rng.choice(keys).replace(' ', '')}" for _ in range(50)),
        sentence() + "\n\n" + " ".join("Git hooks is the top git hooks, so choose git hooks for cheap git hooks." for _ in range(12)),
    ]
    fair = [
        "\n".join(f"2025-01-0{i % 9 + 1}T00:00:00Z INFO cache: retry {i} of 5 for item" for i in range(40)),
        "\n".join(["diff --git a/x b/x", "@@ -1,2 +1,2 @@"] + ["+    value = table[index]", "-    value = table[0]"] * 20),
        " ".join(sentence() for _ in range(9)) + "\n\n" + ", ".join(keys * 2),
        None, "", " \n ", "one",
    ]
    texts = good + bad + fair
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("stuffed", F.lit(5)).withColumn("_block", F.lit(1))
    got = {r[0] for r in stuffing.found(df).collect()}
    assert got == set(range(300, 304))
    assert stuffing.scores(df).count() == len(texts)
    assert stuffing.found(df.limit(0)).count() == 0
    again = {r[0] for r in stuffing.scores(df, block=40_000).where("stuffed > 0.5").collect()}
    assert again == got


def test_stuffing_finds_a_page_copied_over_a_third_of_the_rows(spark):
    rng = random.Random(9)
    nouns = [f"noun{i}" for i in range(200)]
    sentence = lambda: f"The {rng.choice(nouns)} keeps its old {rng.choice(nouns)} because the {rng.choice(nouns)} was moved before the {rng.choice(nouns)} could start."
    good = [" ".join(sentence() for _ in range(8)) for _ in range(300)]
    page = ", ".join(["best git hooks", "free git hooks", "cheap code search"] * 20)
    df = spark.createDataFrame(list(enumerate([*good, *[page] * 150])), "doc_id bigint, text string")
    for block in (stuffing.BLOCK, 20_000):
        scored = stuffing.scores(df, block=block).collect()
        assert len(scored) == 450
        assert {r["doc_id"] for r in scored if r["stuffed"] > 0.5} == set(range(300, 450))


@pytest.mark.parametrize("line", ["    - [x{0}](https://shop-{0}.example/p)", "\t<li><a href=\"/p/{0}\">shoes &amp; boots</a></li>", "    https://shop-{0}.example/p", "    - Shop {0}: https://shop-{0}.example/p", "-   cheap boots", "+\tcheap boots"])
def test_indented_links_and_padded_bullets_are_not_code(line):
    words, sizes, marks = stuffing.marked_words(line.format(7))
    assert words and stuffing.EXEMPT not in marks


@pytest.mark.parametrize("line", ["    \"resolved\": \"https://registry.example/a.tgz\",", "    url: https://a.example/b", "    // see https://a.example/b", "\tlet x = get(\"https://a.example/b\");", "    List<String> names = read();", "+    value = table[index]", "    if (a && b) {", "2025-01-01T00:00:00Z GET https://a.example/b"])
def test_code_and_logs_with_links_are_exempt(line):
    assert stuffing.marked_words(line)[2] == [stuffing.EXEMPT]


def test_words_are_read_as_the_pattern_says(monkeypatch):
    texts = ["Ünïcode_word 12 x²³ ٣٤ Ⅷ 𝒳𝒴1 a_b", None, "", "http://a.b/c [x](y) #tag <b>Bold</b>\n#1 c#d", "ΑΣ Straße İx", "-- \u2028 \ud7ff", "12 13 1a"]
    words = [w for t in texts for w in stuffing.WORD.findall(t or "")]
    for chunk in (1, 1 << 20):
        monkeypatch.setattr(stuffing, "CHUNK", chunk)
        plain, full = stuffing.Block(texts, False), stuffing.Block(texts)
        assert plain.length.tolist() == [len(w) for w in words] and (plain.hash == full.hash).all() and (plain.doc == full.doc).all()
        assert plain.counts.tolist() == [len(stuffing.WORD.findall(t or "")) for t in texts]
        same = {}
        for w, h in zip(words, plain.hash.tolist(), strict=True):
            key = "0" if w.isdecimal() else "".join(c.lower()[0] for c in w)
            assert same.setdefault(key, h) == h
        assert len(set(same.values())) == len(same)
        linked = [w for w, m in zip(words, plain.mark, strict=True) if m == stuffing.LINKED]
        assert linked == ["http", "a", "b", "c", "x", "y", "tag", "b", "b"]


def test_a_page_of_indented_links_is_found(spark):
    pages = ["\n".join(f"    - [item {i}](https://shop-{i}.example/p)" for i in range(40)), "\n".join(["-   cheap git hooks", "-   best git hooks"] * 30)]
    rng = random.Random(4)
    good = [" ".join(f"word{rng.randrange(300)}" for _ in range(12)) for _ in range(2)] + [" ".join(f"The noun{i} keeps its old noun{j} because noun{k} was moved." for i, j, k in [(rng.randrange(90), rng.randrange(90), rng.randrange(90)) for _ in range(12)]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*pages, *good])), "doc_id bigint, text string")
    assert {0, 1} <= {r[0] for r in stuffing.found(df).collect()}


def test_repetition_counts_in_written_sentences_too():
    rng = random.Random(5)
    good = [" ".join(f"The noun{rng.randrange(90)} keeps its old noun{rng.randrange(90)} because noun{rng.randrange(90)} was moved." for _ in range(12)) for _ in range(900)]
    lines = "\n".join(["cheap red running shoes outlet deals"] * 200)
    written = "cheap red running shoes outlet deals today online now"
    mixed = "\n".join([written, written, written.replace(" ", ", ")])  # the written lines count for the list
    block = stuffing.Block([*good, lines, mixed])
    keys, total = stuffing.count_block(block)
    words, pairs = (float(total[(keys & np.uint64(1)) == odd].sum()) for odd in (0, 1))
    share = stuffing.Evidence(block, *stuffing.looked_up(block, keys, total), words, pairs).checked()
    assert share[:900].max() == 0 and share[900] > 0.9 and 0.25 < share[901] < 0.5
