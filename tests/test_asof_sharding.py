import pytest
from pyspark.sql import functions as F

from millrace.config import ShardConfig
from millrace.operators import asof, sharding


def features(spark):
    return spark.createDataFrame([("a", "2026-01-01", 1), ("a", "2026-01-03", 3), ("a", "2026-01-03", 2), ("b", "2026-01-02", 9), (None, "2026-01-01", 7), ("a", None, 8)], "source string, timestamp string, score long")


def test_asof_semantics(spark):
    spine = spark.createDataFrame(
        [(1, "a", "2025-12-31"), (2, "a", "2026-01-01"), (3, "a", "2026-01-02"), (4, "a", "2026-01-09"), (5, "c", "2026-01-09"), (6, None, "2026-01-09"), (7, "a", None), (4, "a", "2026-01-09")],
        "id int, source string, timestamp string",
    )
    j = asof.asof_join(spine, features(spark), "source", "timestamp", ["score"], "v", tie=["score"])
    got = sorted((r.id, r.v__score, r.v__feature_ts) for r in j.collect())
    none = (None, None)
    assert got == [(1, *none), (2, 1, "2026-01-01"), (3, 1, "2026-01-01"), (4, 2, "2026-01-03"), (4, 2, "2026-01-03"), (5, *none), (6, *none), (7, *none)]
    assert j.columns == ["id", "source", "timestamp", "v__score", "v__feature_ts"]
    asof.assert_no_leakage(j, "timestamp", "v")
    with pytest.raises(asof.LeakageError):
        asof.assert_no_leakage(j.withColumn("v__feature_ts", F.lit("2030")), "timestamp", "v")
    assert asof.asof_join(spine.limit(0), features(spark), "source", "timestamp", ["score"], "v").count() == 0
    assert asof.asof_join(spine, features(spark).limit(0), "source", "timestamp", ["score"], "v").where("v__score is not null").count() == 0
    with pytest.raises(ValueError, match="same type"):
        asof.asof_join(spine.withColumn("timestamp", F.lit(1)), features(spark), "source", "timestamp", ["score"], "v")
    with pytest.raises(ValueError, match="already"):
        asof.asof_join(spine.withColumn("v__score", F.lit(1)), features(spark), "source", "timestamp", ["score"], "v")


def test_latest_first_wins_ties(spark):
    got = {r.source: r.score for r in asof.latest(features(spark), "source", "timestamp", ["score"]).collect()}
    assert got == {"a": 2, "b": 9}


def test_rollup_keeps_ties_apart(spark):
    df = spark.createDataFrame([("a", "t1", "x y"), ("a", "t1", "x"), ("a", "t2", "x y z"), ("b", "t1", None)], "source string, timestamp string, text string")
    got = sorted((r.source, r.docs_so_far, r.mean_words_so_far) for r in asof.source_rollup(df).collect())
    assert got == [("a", 1, 1.0), ("a", 2, 1.5), ("a", 3, 2.0), ("b", 1, 0.0)]


def docs(spark, n=40):
    return spark.createDataFrame([(str(i), "é" * (i % 7) + "x" * (i * 13 % 90)) for i in range(n)], "id string, text string")


def brute(rows, cfg):
    import hashlib

    order = sorted(rows, key=lambda r: hashlib.sha256(f"{cfg.seed}/shards/{r[0]}".encode()).hexdigest())
    stream = [t for _, text in order for t in [*(text or "").encode(), 258]]
    w = cfg.seq_len + 1
    return [stream[i : i + w] for i in range(0, len(stream) - w + 1, w)], len(stream)


def test_sequences_match_brute_force(spark):
    cfg = ShardConfig(seq_len=16, sequences_per_shard=10)
    df = docs(spark)
    placed = sharding.offsets(df, cfg)
    want, total = brute([(r.id, r.text) for r in df.collect()], cfg)
    got = [r.tokens for r in sharding.sequences(placed, cfg).orderBy("seq").collect()]
    assert got == want
    s = sharding.summary(placed, cfg).first()
    assert (s.n_docs, s.n_tokens, s.n_sequences, s.dropped_tail) == (40, total, len(want), total % 17)
    ranks = sharding.rank_split(sharding.sequences(placed, cfg), 3).groupBy("rank").count().collect()
    assert sum(r["count"] for r in ranks) == len(want) and max(r["count"] for r in ranks) - min(r["count"] for r in ranks) <= 1
    assert sharding.resume(sharding.sequences(placed, cfg), len(want) - 1).count() == 1
    other = sharding.sequences(sharding.offsets(df, ShardConfig(seq_len=16, seed=1)), cfg)
    assert [r.tokens for r in other.orderBy("seq").collect()] != want
    with pytest.raises(ValueError):
        ShardConfig(seq_len=4)


def test_reader_resumes_exactly(spark):
    cfg = ShardConfig(seq_len=16)
    rows = sharding.sequences(sharding.offsets(docs(spark), cfg), cfg)
    reader = sharding.ShardReader(rows, buffer=5, seed=3)
    whole = list(reader)
    assert sorted(map(tuple, whole)) == sorted(tuple(r.tokens) for r in rows.collect())
    assert list(reader.read(consumed=7)) == whole[7:]
    assert list(reader.read(epoch=1)) != whole


def test_reader_refuses_the_state_of_another_epoch(spark):
    rows = spark.createDataFrame([(i, [i]) for i in range(12)], "seq long, tokens array<int>")
    reader = sharding.ShardReader(rows, buffer=4, seed=1)
    state = reader.state(5, epoch=2)
    assert list(reader.resume(state)) == list(reader.read(0, 2))[5:]
    with pytest.raises(ValueError, match="epoch 2"):
        reader.resume(state, epoch=3)


def test_asof_of_a_hot_entity_over_many_partitions(spark):
    """One entity holds most rows, so its features must be carried over partitions; nulls go round the join."""
    feats = [("hot", t, t) for t in range(0, 4000, 100)] + [("cold", 5, 1), (None, 1, 1), ("hot", None, 7), ("hot", 300, 301)]
    spine = [(i, "hot", i * 7 % 4100) for i in range(600)] + [(1000, "cold", 4), (1001, "cold", 5), (1002, None, 9), (1003, "hot", None), (1003, "hot", None)]
    f = spark.createDataFrame(feats, "e string, t long, v long")
    s = spark.createDataFrame(spine, "i long, e string, t long")
    got = sorted(((r.i, r.w__v) for r in asof.asof_join(s, f, "e", "t", ["v"], "w", tie=["v"]).collect()), key=str)
    want = []
    for i, e, t in spine:
        held = [(ft, -v) for fe, ft, v in feats if fe == e and e and t is not None and ft is not None and ft <= t]
        want.append((i, -max(held)[1] if held else None))
    assert got == sorted(want, key=str)
    assert asof.latest(f, "e", "t", ["v"]).where("e = 'hot'").first().v == 3900
    rolled = asof.source_rollup(spark.createDataFrame([("a", str(i), "w " * (i % 5)) for i in range(300)] + [(None, "1", "x"), ("b", None, None)], "source string, timestamp string, text string"))
    assert rolled.where("source = 'a'").agg({"docs_so_far": "max"}).first()[0] == 300 and rolled.count() == 302
    assert rolled.where("source = 'a'").select("docs_so_far").distinct().count() == 300
