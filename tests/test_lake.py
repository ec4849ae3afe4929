import json

import pytest
from pyspark.sql import functions as F

from millrace.config import CorpusConfig, DedupConfig, GateConfig, ShardConfig
from millrace.operators import lineage, scoring, versioning
from millrace.operators.corpus import generate
from millrace.plans import stages
from millrace.plans.queries import EVENTS
from millrace.sources.catalog import Catalog, StorageError
from millrace.sources.files import format_of, open_source
from millrace.sources.ingest import IngestError, land
from millrace.streaming import ingest as streaming


def frame(spark, rows, schema="id string, text string"):
    return spark.createDataFrame(rows, schema)


def test_catalog_layers_versions_and_sql(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/lake")
    with pytest.raises(StorageError, match="no parts"):
        c.read("silver", "corpus")
    with pytest.raises(StorageError, match="bad dataset"):
        c.replace(frame(spark, [("1", "a")]), "silver", "Bad-Name")
    with pytest.raises(StorageError, match="append-only"):
        c.replace(frame(spark, [("1", "a")]), "bronze", "corpus")
    c.replace(frame(spark, [("1", "a"), ("2", "b")]), "silver", "corpus")
    c.replace(c.read("silver", "corpus").where("id = '2'"), "silver", "corpus")  # rewrites what it reads
    assert c.query("select count(*) as n from silver_corpus") == [{"n": 1}]
    assert c.summary() == {"silver": {"corpus": {"rows": 1, "parts": len(c.parts("silver", "corpus"))}}}
    assert c.vacuum("silver", "corpus") == 1 and c.row_count("silver", "corpus") == 1


def test_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "v": 2}\n\n{"id": "2", "v": 3}\n')
    (tmp_path / "a.csv").write_text("id,v,w\n1,,x\n2,5,\n")
    frame(spark, [("1", "a")]).write.parquet(f"{tmp_path}/p.parquet")
    assert open_source(spark, f"{tmp_path}/a.jsonl").count() == 2
    assert sorted((r.id, r.v, r.w) for r in open_source(spark, f"{tmp_path}/a.csv").collect()) == [(1, None, "x"), (2, 5, "")]
    assert open_source(spark, f"{tmp_path}/p.parquet").count() == 1
    with pytest.raises(ValueError, match="unknown format"):
        format_of("x.csv", "xml")
    with pytest.raises(ValueError, match="suffix"):
        format_of("x.docx")


def test_landing_is_idempotent_and_guarded(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/lake")
    rows = frame(spark, [(f"{i:02d}", f"text {i}") for i in range(10)])
    r = land(rows, c, "corpus", order=["id"], batch_size=4)
    assert (r.batches_written, r.rows_written, r.batches_skipped) == (3, 10, 0)
    r = land(rows, c, "corpus", order=["id"], batch_size=4)
    assert (r.batches_written, r.batches_skipped, r.rows_skipped) == (0, 3, 10)
    assert land(rows, c, "corpus", order=["id"], batch_size=5).batches_written == 2  # framing is part of identity
    land(frame(spark, [("other", "x")], "text string, id string"), c, "corpus")  # column order is forgiven
    with pytest.raises(IngestError, match="schema drift"):
        land(frame(spark, [("1", "x")], "id string, other string"), c, "corpus")
    assert land(rows.limit(0), c, "corpus").batches_written == 0
    c2 = Catalog(spark, f"file://{tmp_path}/two")
    land(spark.sql("select 'a' as id, null as ref, 1L as n"), c2, "corpus")  # a column without a type becomes text
    land(spark.sql("select 'b' as id, 'a' as ref, 2 as n"), c2, "corpus")
    with pytest.raises(IngestError, match="castable"):
        land(spark.sql("select 'c' as id, 'a' as ref, 1.5D as n"), c2, "corpus")
    assert sorted((r.id, r.ref, r.n) for r in c2.read("bronze", "corpus").collect()) == [("a", None, 1), ("b", "a", 2)]


def test_stream_redelivery_lands_once(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/lake")
    lines = [json.dumps({"id": str(i), "text": f"t {i}"}) for i in range(6)] + [""]
    topic = f"file://{tmp_path}/topic"
    assert streaming.replay(c, lines, topic, per_file=2) == 6
    messages = lambda: streaming.file_topic(spark, topic, "id string, text string")

    def crash(batch_id):
        if batch_id == 1:
            raise RuntimeError("crashed before commit")

    with pytest.raises(Exception, match="crashed"):
        streaming.land_stream(messages(), c, "corpus", f"{tmp_path}/group", after_publish=crash)
    r = streaming.land_stream(messages(), c, "corpus", f"{tmp_path}/group")
    assert (r.batches_skipped, r.batches_written) == (1, 1)
    assert sorted(x.id for x in c.read("bronze", "corpus").collect()) == list("012345")
    assert streaming.land_stream(messages(), c, "corpus", f"{tmp_path}/other").batches_skipped == 3  # a second group reads all again
    streaming.replay(c, lines[:2], topic)
    assert streaming.land_stream(messages(), c, "corpus", f"{tmp_path}/group").batches_skipped == 1
    with pytest.raises(ValueError):
        streaming.replay(c, ["not json"], topic)


def test_windowed_counts_stream(spark, tmp_path):
    df = spark.sql("select timestamp'2026-01-01 00:00:10' as ts, 'a' as k union all select timestamp'2026-01-01 00:00:50', 'a' union all select timestamp'2026-01-01 01:00:00', 'b'")
    df.write.parquet(f"{tmp_path}/events")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/events")
    q = streaming.windowed_counts(s, "ts", "k", "1 minute", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.sql("select * from w").collect()) == [("a", 2), ("b", 1)]


def test_lineage_graph(spark):
    ev = spark.createDataFrame(EVENTS, lineage.EVENTS)
    assert lineage.upstream(ev, "gold/shards") == ["bronze/corpus", "file/raw.jsonl", "silver/corpus"]
    assert lineage.upstream(ev, "silver/corpus") == ["bronze/corpus", "file/raw.jsonl", "silver/corpus"]  # read and written by one job
    assert lineage.upstream(ev, "unknown") == []
    assert ("job:promote", "silver/old") not in {(r.src, r.dst) for r in lineage.edges(ev).collect()}
    assert "graph LR" in lineage.to_mermaid(ev)


def test_whole_pipeline(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/lake")
    corpus = generate(spark, CorpusConfig(seed=42, n_docs=300))
    rows = corpus.collect()
    kinds = {k: sum(r.gt_kind == k for r in rows) for k in ("exact_dup", "near_dup", "pii")}
    assert len(rows) == 300 and kinds == {"exact_dup": 18, "near_dup": 30, "pii": 12}
    by_id = {r.id: r for r in rows}
    assert all(by_id[r.gt_dup_of].text == r.text for r in rows if r.gt_kind == "exact_dup")
    assert [r.text for r in generate(spark, CorpusConfig(seed=42, n_docs=300)).collect()] == [r.text for r in rows]
    land(corpus, c, "corpus")
    report = stages.promote(c, "corpus")
    assert report["verdict"] == "promoted" and report["quarantined_rows"] == 30
    flagged = scoring.flag(c.read("bronze", "corpus"), c.read("quarantine", "corpus"))
    s = scoring.confusion(flagged, scoring.is_defect(F.col("gt_kind")), F.col("removed")).first()
    assert (s.precision, s.recall) == (1.0, 1.0)
    before = c.read("silver", "corpus").count()
    d = stages.deduplicate(c, "corpus", DedupConfig())
    assert d["removed_exact"] >= 15 and c.read("silver", "corpus").count() == before - d["removed_exact"] - d["removed_near"]
    g = stages.shard(c, "corpus", ShardConfig(seq_len=64))
    assert c.row_count("gold", "corpus") == g["n_sequences"]
    snaps = versioning.list_snapshots(c)
    assert [x["stage"] for x in snaps] == ["promote", "dedup", "shard"]
    assert versioning.verify_snapshot(c, snaps[2]["snapshot_id"])[0]
    assert not versioning.verify_snapshot(c, snaps[0]["snapshot_id"])[0]  # silver was rewritten since
    assert not versioning.verify_snapshot(c, "none")[0]
    up = lineage.upstream(versioning.lineage_frame(c), "gold/corpus")
    assert up == ["bronze/corpus", "silver/corpus"]
    blocked = stages.promote(c, "corpus", GateConfig(max_reject_rate=0.01))
    assert blocked["verdict"] == "blocked" and c.row_count("gold", "corpus") == g["n_sequences"]
    assert "blocked" in stages.quality_report(blocked)
    with pytest.raises(ValueError, match="too few"):
        stages.shard(c, "corpus", ShardConfig(seq_len=10_000_000))


def test_feature_store(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/lake")
    store = stages.FeatureStore(c)
    df = spark.createDataFrame([("a", "2026-01-01", 1), ("a", "2026-01-03", 3)], "source string, timestamp string, score long")
    with pytest.raises(ValueError, match="missing"):
        store.register("v", df, "source", "nope")
    with pytest.raises(ValueError, match="feature column"):
        store.register("v", df.drop("score"), "source", "timestamp")
    store.register("v", df, "source", "timestamp")
    spine = spark.createDataFrame([(1, "a", "2026-01-02")], "id int, source string, timestamp string")
    assert store.training_set(spine, "v", "source", "timestamp").first().v__score == 1
    assert store.latest("v", "a")["score"] == 3 and store.latest("v", "zz") is None
    with pytest.raises(ValueError, match="no feature view"):
        store.view("other")


def test_command_line_end_to_end(spark, tmp_path, capsys):
    from millrace import cli

    root = f"file://{tmp_path}/lake"
    run = lambda *a: cli.main([*a, "--root", root])
    assert run("synth", f"{tmp_path}/raw.json", "--docs", "60") == 0
    assert run("ingest", f"{tmp_path}/raw.json", "corpus", "--via-stream") == 0
    assert run("promote", "corpus") == 0 and run("dedup", "corpus") == 0
    assert json.loads((tmp_path / "lake/_reports/dedup_corpus.json").read_text())["candidate_pairs"] >= 0
    assert "# Quality gate" in (tmp_path / "lake/_reports/gate_corpus.md").read_text()
    capsys.readouterr()
    assert run("score-dedup", "corpus", "--sweep", "0.8", "0.9") == 0
    assert [r["threshold"] for r in json.loads(capsys.readouterr().out)] == [0.8, 0.9]
    assert run("smoke", "--docs", "60") == 0
    capsys.readouterr()
    assert run("lineage", "--upstream", "gold/smoke") == 0
    assert json.loads(capsys.readouterr().out) == ["bronze/smoke", "silver/smoke"]


def test_batch_identity_follows_order_and_not_partitions(spark):
    from millrace.sources.ingest import batch_hash

    rows = [(str(i), "x") for i in range(20)]
    a = spark.createDataFrame(rows, "id string, text string")
    assert batch_hash(a) == batch_hash(a.coalesce(1)) != batch_hash(spark.createDataFrame(rows[::-1], "id string, text string"))
    assert batch_hash(a, ["id"]) == batch_hash(a.repartition(3), ["id"])


def test_contract_raises_and_staged_tables_are_deleted(spark):
    from millrace.operators import gate
    from millrace.plans import staging

    good = spark.createDataFrame([("1", "one two three four five")], "id string, text string")
    gate.assert_contract(good)
    with pytest.raises(gate.ContractError, match="repeated_ids 1"):
        gate.assert_contract(good.union(good))
    with pytest.raises(gate.ContractError, match="short_text 1"):
        gate.assert_contract(spark.createDataFrame([("1", "short")], "id string, text string"))
    kept = staging.stage(good, "unstaged")
    assert kept.count() == 1 and staging.unstage(spark) >= 1


def test_staging_leaves_no_shuffle_files(spark):
    import time

    from millrace.plans.staging import stage

    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}

    before = shuffled()
    df = spark.range(1000).repartition(3, "id").groupBy("id").count()
    held = stage(df, "test")
    for _ in range(50):  # files are removed in the background
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and held.count() == 1000
