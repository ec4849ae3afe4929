from millrace.plans.queries import QUERIES


def test_jaccard_of_matches_stored_in_either_order(spark, tmp_path):
    text = "one two three four five six"
    spark.createDataFrame([("a", text), ("b", text + " seven"), ("c", text), (None, text)], "id string, text string").write.parquet(f"{tmp_path}/synth_records.parquet")
    rows = [("b", "a", 0.9), ("a", "b", 0.8), ("c", "a", 0.5), ("c", "b", 0.4), ("c", "c", 1.0), (None, "a", 0.9), ("b", "c", None)]
    spark.createDataFrame(rows, "id_a string, id_b string, similarity double").write.parquet(f"{tmp_path}/match_pairs.parquet")
    got = {(r.id_a, r.id_b): r.similarity for r in QUERIES["jaccard_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): 0.666667, ("a", "c"): 1.0}


WORDS = [f"word{i}" for i in range(40)]
EDITED = [*WORDS[:39], "edited"]
#: A text, an exact copy and an edited copy (labelled), an exact copy without a label, a lone text with a wrong label, quarantined copies.
LABELLED = [
    ("1", " ".join(WORDS), None, None), ("2", " ".join(WORDS), "exact_dup", "1"), ("3", " ".join(EDITED), "near_dup", "1"), ("4", " ".join(WORDS), None, None),
    ("5", "a text of its own without any copy", "near_dup", "9"), ("6", "too short", None, None), ("7", "too short", "exact_dup", "6"),
]


def test_score_dedup_counts_near_copies_outside_quarantine(spark, tmp_path):
    spark.createDataFrame(LABELLED, "id string, text string, gt_kind string, gt_dup_of string").write.parquet(f"{tmp_path}/synth_records.parquet")
    s = QUERIES["score_dedup"](spark, str(tmp_path)).first()
    assert (s.tp, s.fp, s.fn, s.tn, s.fp_unlabeled_exact) == (2, 1, 1, 1, 1)
    assert (s.precision, s.recall) == (0.6667, 0.6667)


def test_threshold_sweep_groups_and_scores(spark, tmp_path):
    spark.createDataFrame(LABELLED, "id string, text string, gt_kind string, gt_dup_of string").write.parquet(f"{tmp_path}/synth_records.parquet")
    rows = {r.threshold: r for r in QUERIES["dedup_threshold_sweep"](spark, str(tmp_path)).collect()}
    assert sorted(rows) == [0.8, 0.85, 0.9, 0.95]
    low, high = rows[0.8], rows[0.95]  # the edited copy has a similarity of 35/37
    assert (low.pairs, low.removed, low.removed_exact, low.removed_near) == (1, 3, 2, 1)
    assert (low.tp, low.fp, low.fn, low.tn, low.recall, low.recall_by_kind) == (2, 1, 1, 1, 0.6667, "exact_dup=1.0000,near_dup=0.5000")
    assert (high.pairs, high.removed, high.removed_near, high.recall, high.recall_by_kind) == (0, 2, 0, 0.3333, "exact_dup=1.0000,near_dup=0.0000")
