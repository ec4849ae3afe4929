import pytest
from pyspark.sql import functions as F

from millrace.config import DedupConfig
from millrace.operators import dedup, ordering, profile, scoring
from millrace.operators.components import connected_components

BASE = "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn"


def corpus(spark):
    rows = [
        ("9", BASE), ("10", BASE.replace(" ", "  ")), ("2", BASE + " today"), ("3", "something else entirely is written here"),
        ("4", None), ("5", ""), (None, BASE), ("6", "a unique text of its own with seven words"),
    ]
    return spark.createDataFrame(rows, "id string, text string")


def test_clusters_survivors_and_kinds(spark):
    got = {r.id: (r.survivor, r.kind) for r in dedup.clusters(corpus(spark)).collect()}
    # ids compare as strings: "10" < "2" < "9"; the two empty texts are one exact group
    assert got == {"10": ("10", "kept"), "9": ("10", "exact"), "2": ("10", "near"), "4": ("4", "kept"), "5": ("4", "exact")}
    found = dedup.clusters(corpus(spark))
    assert {r.id for r in dedup.kept(corpus(spark), found).collect()} == {"10", "3", "4", "6", None}
    s = dedup.summary(corpus(spark), found).first()
    assert (s.input_rows, s.clusters, s.largest_cluster, s.removed_exact, s.removed_near) == (8, 2, 3, 2, 1)


def test_pairs_match_brute_force(spark):
    texts = [f"{BASE} {i} {i * 7 % 5}" if i % 3 else f"row {i} " + BASE[: 20 + i] for i in range(24)]
    df = spark.createDataFrame([(f"{i:02d}", t) for i, t in enumerate(texts)], "id string, text string")
    cfg = DedupConfig(threshold=0.6)
    _, pairs = dedup.near_pairs(df, cfg)

    def grams(t):
        w = t.split()
        return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} or {t}

    want = set()
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            x, y = grams(a), grams(texts[j])
            if len(x & y) / len(x | y) >= 0.6:
                want.add((f"{i:02d}", f"{j:02d}"))
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_empty_and_config(spark):
    assert dedup.clusters(corpus(spark).limit(0)).count() == 0
    for bad in ({"bands": 7}, {"normalize": "x"}, {"threshold": 0}, {"shingle_size": 0}):
        with pytest.raises(ValueError):
            DedupConfig(**bad)


def test_exact_groups_by_mode(spark):
    df = spark.createDataFrame([("1", "a  b"), ("2", "a b"), ("3", "A B"), ("4", "c")], "id string, text string")
    size = lambda mode: sorted(r.rows for r in dedup.exact_groups(df, DedupConfig(normalize=mode)).collect())
    assert size("none") == [] and size("whitespace") == [2] and size("aggressive") == [3]


def test_components_chain_cycle_hub(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    cycle = [(1, 2), (2, 3), (3, 1)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    edges = spark.createDataFrame([*chain, *cycle, *hub, (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in (1, 2, 3)}, **{1000 + i: 1000 for i in range(400)}}
    assert connected_components(edges.limit(0)).count() == 0


def test_profile_and_drift(spark):
    a = spark.createDataFrame([("x", "one two"), ("x", "a b c d e f"), (None, None), ("y", "z")], "source string, text string")
    p = profile.profile(a).first()
    assert p.n_rows == 4 and p.source_dist == {"x": 0.5, "None": 0.25, "y": 0.25} and p.length_dist[:2] == [0.75, 0.25] and len(p.length_dist) == 9
    same = profile.drift_report(a, a).first()
    assert (same.source_psi, same.length_psi, same.verdict) == (0.0, 0.0, "stable")
    b = spark.createDataFrame([("code", "one two")], "source string, text string")
    assert profile.drift_report(a, b).first().verdict == "major"
    none = profile.length_distribution(a.limit(0)).collect()
    assert len(none) == 9 and all(r.share == 0 for r in none)
    bounds = spark.createDataFrame([(0.0999,), (0.1,), (0.25,), (0.2501,)], "v double").select(profile.verdict(F.col("v"))).collect()
    assert [r[0] for r in bounds] == ["stable", "moderate", "moderate", "major"]


def test_confusion_and_defaults(spark):
    df = spark.createDataFrame([("a", "clean", False), ("b", "junk_short", True), ("c", "pii", True), ("d", "pii", False), ("e", "clean", True), ("f", None, False)], "id string, gt_kind string, removed boolean")
    s = scoring.confusion(df, scoring.is_defect(F.col("gt_kind")), F.col("removed")).first()
    assert (s.tp, s.fp, s.fn, s.tn, s.precision, s.recall, s.f1) == (2, 1, 1, 2, 0.6667, 0.6667, 0.6667)
    e = scoring.confusion(df.limit(0), scoring.is_defect(F.col("gt_kind")), F.col("removed")).first()
    assert (e.precision, e.recall) == (1.0, 1.0)
    kinds = {r.kind: (r.rows, r.hits) for r in scoring.by_kind(df, "removed").collect()}
    assert kinds == {"clean": (2, 1), "junk_short": (1, 1), "pii": (2, 1)}
    flagged = scoring.flag(df.drop("removed"), df.where("id in ('a', 'f')"))
    assert {r.id for r in flagged.where("removed").collect()} == {"a", "f"}
    copies = spark.createDataFrame([("1", "t", None, True), ("2", "t", None, False), ("3", "u", None, True)], "id string, text string, gt_dup_of string, removed boolean")
    assert scoring.unlabeled_exact_copies(copies, "removed").first()[0] == 1


def test_dense_ranks(spark):
    df = spark.createDataFrame([(i * 7 % 50, str(i)) for i in range(50)] + [(None, "n")], "k int, v string")
    got = ordering.dense_rank_ids(df, ["k", "v"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(51)) and got[0].v == "n" and [r.k for r in got[1:]] == list(range(50))
    a, b = df.select("v"), df.where("k < 25").select("v")
    assert ordering.symmetric_difference(a, b).count() == 26


def test_both_backends_find_the_same_pairs(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [("1", " ".join(base)), ("2", " ".join([*base[:59], "x"])), ("3", " ".join(f"v{i}" for i in range(40))), ("4", "")]
    df = spark.createDataFrame(rows, "id string, text string")
    found = [sorted((r.a, r.b, round(r.similarity, 4)) for r in dedup.near_pairs(df, DedupConfig(backend=b))[1].collect()) for b in ("bands", "mllib")]
    assert found[0] == found[1] == [("1", "2", round(55 / 57, 4))]
