import pytest
from pyspark.sql import functions as F

from millrace.config import GateConfig, from_mapping, override
from millrace.functions import text as T
from millrace.operators import gate
from millrace.operators.rules import RULES, failed_rules, marker_hits

SCHEMA = "id string, text string"


def values(spark, texts, column):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], SCHEMA)
    return [r.v for r in df.select("id", column.alias("v")).orderBy(F.col("id").cast("int")).collect()]


def test_words_follow_unicode_white_space(spark):
    texts = ["a b", "a b c", "\x1ca\x1db ", "", "  \t", None, "a​b"]
    assert values(spark, texts, T.word_count(F.col("text"))) == [len((t or "").split()) for t in texts]
    assert values(spark, texts, T.normalize(F.col("text"))) == [" ".join((t or "").split()) for t in texts]
    assert values(spark, ["A  b"], T.normalize(F.col("text"), "aggressive")) == ["a b"]
    assert values(spark, ["A  b"], T.normalize(F.col("text"), "none")) == ["A  b"]
    with pytest.raises(ValueError):
        T.normalize(F.col("text"), "other")


def test_shingles_and_jaccard(spark):
    got = values(spark, ["a b c d", "a b", "", "x x x x"], T.shingles(F.col("text"), 3))
    assert got == [["a b c", "b c d"], ["a b"], [], ["x x x"]]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "x array<string>, y array<string>")
    assert [round(r[0], 4) for r in df.select(T.jaccard(F.col("x"), F.col("y"))).collect()] == [0.3333, 1.0, 0.0]


def test_byte_tokens_round_trip(spark):
    texts = ["héllo", "", "日本 🌾", None]
    assert values(spark, texts, T.byte_tokens(F.col("text"))) == [list((t or "").encode()) for t in texts]
    assert values(spark, texts, T.decode_tokens(T.byte_tokens(F.col("text")))) == [t or "" for t in texts]
    df = spark.createDataFrame([([72, 257, 258, 105],)], "t array<smallint>")
    assert df.select(T.decode_tokens(F.col("t"))).first()[0] == "Hi"


def test_length_bins(spark):
    df = spark.createDataFrame([(n,) for n in (0, 4, 5, 19, 20, 639, 640, 10_000)], "n long")
    assert [r[0] for r in df.select(T.length_bin(F.col("n"))).collect()] == [0, 0, 1, 2, 3, 7, 8, 8]


@pytest.mark.parametrize(
    ("rule", "good", "bad"),
    [
        ("non_empty", ["x", " x "], ["", "  \n", " ", None]),
        ("min_words", ["one two three four five"], ["one two three four", "", None]),
        ("no_mojibake", ["café\nau lait", "Ãx"], ["caf�", "cafÃ©", "a\tb", "â‚¬5", "a\rb"]),
        ("no_boilerplate_markers", ["click here now", "plain"], ["unsubscribe", "Click here. Privacy Policy."]),
        ("no_repeated_sentences", ["A b. A b.", "One. Two. Three. Four."], ["Buy it. Buy it. Buy it. Now."]),
        ("no_pii", ["call 555-0100", "a@b"], ["me@x.example", "(555) 0123", "555-123-4567", "123-45-6789", "é.ü@x.example"]),
    ],
)
def test_rules(spark, rule, good, bad):
    cfg = GateConfig()
    assert values(spark, good, RULES[rule](F.col("text"), cfg)) == [True] * len(good)
    assert values(spark, bad, RULES[rule](F.col("text"), cfg)) == [False] * len(bad)


def test_markers_count_distinct_phrases(spark):
    assert values(spark, ["unsubscribe unsubscribe", "subscribe", None], marker_hits(F.col("text"))) == [2, 1, 0]


def test_reasons_in_config_order(spark):
    cfg = GateConfig(rules=("no_pii", "min_words", "non_empty"))
    assert values(spark, ["", "a@b.example"], failed_rules(F.col("text"), cfg)) == [["min_words", "non_empty"], ["no_pii", "min_words"]]


def test_config_is_validated():
    with pytest.raises(ValueError, match="known"):
        GateConfig(rules=("nope",))
    assert override(GateConfig(), min_words=None, max_reject_rate=0.1) == GateConfig(max_reject_rate=0.1)
    assert from_mapping(GateConfig, {"rules": ["min_words"]}).rules == ("min_words",)
    with pytest.raises(ValueError):
        from_mapping(GateConfig, {"other": 1})


def test_gate_split_and_summary(spark):
    rows = [("1", "one two three four five", 1), ("1", "one two three four five", 2), (None, "", 3), (None, "a b c d e@f.example", 4)]
    df = spark.createDataFrame(rows, "id string, text string, _hits int")  # an extra column with an awkward name
    noted = gate.annotate(df)
    assert sorted(r["_hits"] for r in gate.promoted(noted).collect()) == [1, 2]
    assert {r["_hits"]: r.reject_reasons for r in gate.quarantined(noted).collect()} == {3: "non_empty|min_words", 4: "no_pii"}
    s = gate.summary(noted).first()
    assert (s.input_rows, s.promoted_rows, s.quarantined_rows, s.reject_rate, s.duplicate_id_rows, s.verdict) == (4, 2, 2, 0.5, 2, "promoted")
    assert gate.summary(noted, GateConfig(max_reject_rate=0.4)).first().verdict == "blocked"
    assert {r.reason: r.hits for r in gate.reason_histogram(noted).collect()} == {"non_empty": 1, "min_words": 1, "no_pii": 1}
    empty = gate.summary(gate.annotate(df.limit(0))).first()
    assert (empty.input_rows, empty.reject_rate, empty.verdict) == (0, 0.0, "promoted")
    with pytest.raises(ValueError):
        gate.annotate(df.drop("text"))


def test_contract_and_exclusion(spark):
    df = spark.createDataFrame([("a", "x", None), ("a", None, "s"), (None, "a b c d e", "s")], "id string, text string, source string")
    v = gate.contract_violations(df).first()
    assert (v.null_id, v.null_text, v.short_text, v.null_source, v.repeated_ids) == (1, 1, 2, 1, 1)
    left = gate.exclude_quarantined(df, df.where("source is null"))
    assert [r.id for r in left.collect()] == [None]


def test_long_text_passes_whole(spark):
    long = "word " * 300_000 + "me@x.example"
    assert values(spark, [long], RULES["no_pii"](F.col("text"), GateConfig())) == [False]
