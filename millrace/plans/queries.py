"""The core queries, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import DedupConfig, GateConfig, ShardConfig
from millrace.functions import text as T
from millrace.operators import asof, dedup, gate, lineage, ordering, profile, rules, scoring, sharding
from millrace.plans.staging import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CFG = GateConfig()
#: Shingles of five words and a similarity of 0.8 for the registered queries.
NEAR = DedupConfig(shingle_size=5, threshold=0.8)
PACK = ShardConfig()
#: A small lineage log: landing, promotion (twice), deduplication in place, packing.
EVENTS = [
    (1, "land", ["file/raw.jsonl"], ["bronze/corpus"]),
    (2, "promote", ["bronze/corpus"], ["silver/old"]),
    (3, "promote", ["bronze/corpus"], ["silver/corpus", "quarantine/corpus"]),
    (4, "dedup", ["silver/corpus"], ["silver/corpus"]),
    (5, "shard", ["silver/corpus"], ["gold/shards"]),
]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "synth_records")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as corpus records."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), "text", "source")


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


# --- rules and gate -------------------------------------------------------


@query
def rule_non_empty(spark, d):
    return records(spark, d).select("id", rules.RULES["non_empty"](F.col("text"), CFG).alias("passed"))


@query
def rule_min_words(spark, d):
    return records(spark, d).select("id", T.word_count(F.col("text")).alias("n_words"), rules.RULES["min_words"](F.col("text"), CFG).alias("passed"))


@query
def rule_no_mojibake(spark, d):
    return records(spark, d).select("id", rules.RULES["no_mojibake"](F.col("text"), CFG).alias("passed"))


@query
def rule_no_boilerplate(spark, d):
    return records(spark, d).select("id", rules.marker_hits(F.col("text")).alias("hits"), rules.RULES["no_boilerplate_markers"](F.col("text"), CFG).alias("passed"))


@query
def rule_repeated_sentences(spark, d):
    s = rules.sentences(F.col("text"))
    return records(spark, d).select("id", F.size(s).cast("long").alias("n"), F.size(F.array_distinct(s)).cast("long").alias("n_distinct"), rules.RULES["no_repeated_sentences"](F.col("text"), CFG).alias("passed"))


@query
def rule_no_pii(spark, d):
    return records(spark, d).select("id", rules.RULES["no_pii"](F.col("text"), CFG).alias("passed"))


@query
def gate_reject_reasons(spark, d):
    return gate.annotate(records(spark, d), CFG).select("id", F.array_join("_reasons", "|").alias("reasons"))


@query
def gate_silver(spark, d):
    return gate.promoted(gate.annotate(records(spark, d), CFG)).select("id", "source", "timestamp", "site")


@query
def gate_quarantine(spark, d):
    return gate.quarantined(gate.annotate(records(spark, d), CFG)).select("id", "source", "reject_reasons")


@query
def gate_summary(spark, d):
    return gate.summary(gate.annotate(records(spark, d), CFG), CFG)


@query
def gate_reason_histogram(spark, d):
    return gate.reason_histogram(gate.annotate(records(spark, d), CFG))


@query
def contract_violations(spark, d):
    return gate.contract_violations(records(spark, d))


@query
def pre_dedup_universe(spark, d):
    r = records(spark, d)
    return gate.exclude_quarantined(r, gate.quarantined(gate.annotate(r, CFG))).select("id", "source")


# --- text and hashes ------------------------------------------------------


@query
def word_count(spark, d):
    return pages(spark, d).select("id", T.word_count(F.col("text")).alias("n_words"))


@query
def normalize_text(spark, d):
    return records(spark, d).select("id", T.normalize(F.col("text")).alias("norm"), T.normalize(F.col("text"), "aggressive").alias("norm_lower"))


@query
def text_sha256(spark, d):
    return records(spark, d).select("id", F.sha2(T.filled(F.col("text")), 256).alias("sha"))


@query
def byte_tokens(spark, d):
    t = T.byte_tokens(F.col("text"))
    return pages(spark, d).select("id", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.transform(t, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "").alias("tokens_hex"))


@query
def token_round_trip(spark, d):
    return pages(spark, d).select("id", (T.decode_tokens(T.byte_tokens(F.col("text"))) == T.filled(F.col("text"))).alias("same"))


@query
def canonical_row_json(spark, d):
    df = table(spark, d, "documents")
    return df.select("doc_id", T.row_json(df.columns).alias("json"))


@query
def content_hash(spark, d):
    df = table(spark, d, "orders")
    parts = [F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")]
    return df.select("o_orderkey", T.framed_sha256(F.array(*parts)).alias("sha"))


# --- duplicates -----------------------------------------------------------


@query
def exact_dup_groups(spark, d):
    return dedup.exact_groups(records(spark, d), NEAR)


@query
def shingles(spark, d):
    return pages(spark, d).select("id", F.explode(T.shingles(F.col("text"), NEAR.shingle_size)).alias("shingle"))


@query
def near_dup_pairs(spark, d):
    _, pairs = dedup.near_pairs(pages(spark, d), NEAR)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query
def jaccard_pairs(spark, d):
    """Exact similarity of each accepted match of two records."""
    r = records(spark, d).where("id is not null").dropDuplicates(["id"]).select("id", T.shingles(F.col("text"), 5).alias("s"))
    m = table(spark, d, "match_pairs").where("id_a <> id_b and similarity >= 0.5")
    m = m.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
    both = m.join(r.select(F.col("id").alias("id_a"), F.col("s").alias("x")), "id_a").join(r.select(F.col("id").alias("id_b"), F.col("s").alias("y")), "id_b")
    return both.select("id_a", "id_b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@query
def minhash_signature(spark, d):
    reps = dedup.representatives(pages(spark, d), NEAR).select("rep", T.shingles(F.col("norm"), NEAR.shingle_size).alias("shingles"))
    return dedup.signatures(reps, NEAR)


@query
def lsh_candidate_pairs(spark, d):
    return dedup.candidate_pairs(minhash_signature(spark, d), NEAR)


@query
def minhash_estimate(spark, d):
    signed = minhash_signature(spark, d)
    pairs = dedup.candidate_pairs(signed, NEAR)
    a, b = signed.toDF("a", "x"), signed.toDF("b", "y")
    return pairs.join(a, "a").join(b, "b").select("a", "b", dedup.estimate(F.col("x"), F.col("y"), NEAR.num_perm).alias("estimate"))


@query
def dup_clusters(spark, d):
    return dedup.clusters(pages(spark, d), NEAR).select("id", "survivor")


@query
def dedup_survivors(spark, d):
    return dedup.clusters(pages(spark, d), NEAR).where("kind = 'kept'").select("survivor").distinct()


@query
def dedup_removed(spark, d):
    return dedup.removed(dedup.clusters(pages(spark, d), NEAR))


@query
def dedup_kept(spark, d):
    p = pages(spark, d)
    return dedup.kept(p, dedup.clusters(p, NEAR)).select("id", "source")


@query
def dedup_summary(spark, d):
    p = pages(spark, d)
    return dedup.summary(p, dedup.clusters(p, NEAR))


# --- profiles and drift ---------------------------------------------------


@query
def profile_source_dist(spark, d):
    return profile.source_distribution(records(spark, d)).select("source", "rows", F.round("share", 6).alias("share"))


@query
def profile_length_dist(spark, d):
    return profile.length_distribution(records(spark, d)).select("bin", "rows", F.round("share", 6).alias("share"))


@query
def profile_whole(spark, d):
    p = profile.profile(pages(spark, d))
    pair = lambda e: F.concat_ws("=", e["key"], F.format_string("%.4f", e["value"]))
    return p.select(
        "n_rows",
        F.array_join(F.transform(F.array_sort(F.map_entries("source_dist")), pair), ",").alias("source_dist"),
        F.array_join(F.transform("length_dist", lambda x: F.format_string("%.4f", x)), ",").alias("length_dist"),
    )


@query
def drift_source_psi(spark, d):
    p = profile.psi(profile.source_distribution(pages(spark, d)), profile.source_distribution(records(spark, d)), "source")
    return p.select("source", F.round("expected", 6).alias("expected"), F.round("actual", 6).alias("actual"), F.round("psi", 6).alias("psi"))


@query
def drift_length_psi(spark, d):
    p = profile.psi(profile.length_distribution(pages(spark, d)), profile.length_distribution(records(spark, d)), "bin")
    return p.select("bin", F.round("expected", 6).alias("expected"), F.round("actual", 6).alias("actual"), F.round("psi", 6).alias("psi"))


@query
def drift_report(spark, d):
    return profile.drift_report(pages(spark, d), records(spark, d))


# --- as-of ----------------------------------------------------------------


def _events(spark, d):
    return table(spark, d, "events")


@query
def asof_join(spark, d):
    """Each event with the last view of its user at or before it."""
    e = _events(spark, d)
    views = e.where("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    j = asof.asof_join(e.select("event_id", "user_id", "ts"), views, "user_id", "ts", ["event_id", "value"], "view", tie=["event_id"])
    return j.select("event_id", "user_id", F.col("view__event_id").cast("string").alias("view_id"), F.col("view__value").alias("view_value"), F.date_format("view__feature_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("view_ts"))


@query
def asof_join_inclusive(spark, d):
    """The bound is inclusive: joined to themselves, events find themselves."""
    e = _events(spark, d)
    j = asof.asof_join(e.select("event_id", "user_id", "ts"), e.select("user_id", "ts", "event_id"), "user_id", "ts", ["event_id"], "self", tie=["event_id"])
    return j.select("event_id", (F.col("self__feature_ts") == F.col("ts")).alias("same_time"))


@query
def feature_latest(spark, d):
    return asof.latest(_events(spark, d), "user_id", "ts", ["event_id"]).select("user_id", "event_id", "value", stamp("ts"))


@query
def offline_online_parity(spark, d):
    """Users whose as-of value in the far future differs from their latest value (none)."""
    e = _events(spark, d)
    far = e.select("user_id").distinct().withColumn("ts", F.lit("2999-01-01 00:00:00").cast(e.schema["ts"].dataType))
    offline = asof.asof_join(far, e.select("user_id", "ts", "event_id"), "user_id", "ts", ["event_id"], "f", tie=["event_id"])
    online = asof.latest(e, "user_id", "ts", ["event_id"]).select("user_id", F.col("event_id").alias("online_id"))
    return offline.join(online, "user_id").where(~F.col("f__event_id").eqNullSafe(F.col("online_id"))).agg(F.count("*").alias("differing"))


@query
def leakage_violations(spark, d):
    e = _events(spark, d)
    j = asof.asof_join(e.select("event_id", "user_id", "ts"), e.select("user_id", "ts", "value"), "user_id", "ts", ["value"], "f", tie=["value"])
    return asof.leakage(j, "ts", "f").agg(F.count("*").alias("violations"))


@query
def source_rollup(spark, d):
    return asof.source_rollup(records(spark, d))


# --- packing --------------------------------------------------------------


@query
def seeded_permutation(spark, d):
    return pages(spark, d).select("id", sharding.permutation_key("id", 0).alias("order_key"))


@query
def shard_offsets(spark, d):
    return sharding.offsets(pages(spark, d), PACK).select("id", "tokens", "start")


@query
def shard_sequences(spark, d):
    rows = sharding.sequences(sharding.offsets(pages(spark, d), PACK), PACK)
    return rows.select("seq", F.array_join("tokens", ",").alias("tokens"))


@query
def shard_summary(spark, d):
    return sharding.summary(sharding.offsets(pages(spark, d), PACK), PACK)


@query
def rank_split(spark, d):
    rows = sharding.rank_split(sharding.sequences(sharding.offsets(pages(spark, d), PACK), PACK), 4)
    return rows.groupBy("rank").agg(F.count("*").alias("n_sequences"))


@query
def resume_offset(spark, d):
    rows = sharding.sequences(sharding.offsets(pages(spark, d), PACK), PACK)
    return sharding.resume(rows, 1000).agg(F.count("*").alias("left"), F.min("seq").alias("first_seq"))


# --- scoring --------------------------------------------------------------


def _flagged(spark, d):
    r = records(spark, d).where("gt_kind is not null")
    return scoring.flag(r, gate.quarantined(gate.annotate(r, CFG)))


@query
def score_gate(spark, d):
    return scoring.confusion(_flagged(spark, d), scoring.is_defect(F.col("gt_kind")), F.col("removed"))


@query
def score_recall_by_kind(spark, d):
    return scoring.by_kind(_flagged(spark, d), "removed")


@query
def removed_flag(spark, d):
    r = records(spark, d)
    return scoring.flag(r, gate.quarantined(gate.annotate(r, CFG))).select("id", "removed")


@query
def dangling_labels(spark, d):
    """Labelled copies of records that are not there."""
    return scoring.dangling_labels(records(spark, d)).select("id", "gt_dup_of").distinct()


def _universe(spark, d):
    """Bronze without quarantine."""
    r = records(spark, d)
    return stage(gate.exclude_quarantined(r, gate.quarantined(gate.annotate(r, CFG))).select("id", "text", "gt_kind", "gt_dup_of"), "universe")


@query
def score_dedup(spark, d):
    """Exact and near deduplication of bronze without quarantine, against the labels."""
    u = _universe(spark, d)
    flagged = stage(scoring.flag(u, dedup.removed(dedup.clusters(u, NEAR))), "flagged")
    score = scoring.confusion(flagged, F.col("gt_dup_of").isNotNull(), F.col("removed"))
    return score.crossJoin(scoring.unlabeled_exact_copies(flagged, "removed"))  # one row each


@query
def dedup_threshold_sweep(spark, d):
    """Per threshold: pairs, removed records, and the score of the removal with the recall of each labelled kind."""
    u = _universe(spark, d)
    reps, pairs = dedup.near_pairs(u, NEAR)  # once; NEAR has the least threshold
    out = None
    for t in (0.8, 0.85, 0.9, 0.95):
        close = pairs.where(F.col("similarity") >= t)
        gone = stage(dedup.removed(dedup.grouped(u, reps, close, NEAR)), "gone")
        flagged = stage(scoring.flag(u, gone), "flagged")
        of = lambda kind: F.coalesce(F.sum((F.col("kind") == kind).cast("long")), F.lit(0)).alias(f"removed_{kind}")
        counts = gone.agg(F.countDistinct("id").alias("removed"), of("exact"), of("near"))
        kinds = scoring.by_kind(flagged.where("gt_dup_of is not null"), "removed").select(F.concat_ws("=", "kind", F.format_string("%.4f", "rate")).alias("k"))
        kinds = kinds.agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("recall_by_kind"))
        score = scoring.confusion(flagged, F.col("gt_dup_of").isNotNull(), F.col("removed"))
        row = close.agg(F.lit(t).alias("threshold"), F.count("*").alias("pairs")).crossJoin(counts).crossJoin(score).crossJoin(kinds)  # one row each
        out = row if out is None else out.union(row)
    return out


# --- sets, order, catalog -------------------------------------------------


@query
def batch_stream_symdiff(spark, d):
    a = records(spark, d).select("id").where("id is not null")
    m = table(spark, d, "match_pairs")
    b = m.select(F.col("id_a").alias("id")).union(m.select("id_b")).where("id is not null")
    return ordering.symmetric_difference(a, b).agg(F.count("*").alias("differing"))


@query
def dense_record_ids(spark, d):
    e = table(spark, d, "documents").select("doc_id", "source")
    return ordering.dense_rank_ids(e, ["source", "doc_id"]).select("doc_id", ordering.record_id(F.col("rank"), width=8).alias("record_id"))


@query
def spine_projection(spark, d):
    """The first 100 records by id: a top-k report."""
    return records(spark, d).select("id", "source").where("id is not null").distinct().orderBy("id", "source").limit(100)


@query
def scan_parquet(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), stamp("o_orderdate"))


@query
def catalog_row_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("rows"))


@query
def catalog_summary(spark, d):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "synth_records"]
    parts = [table(spark, d, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("dataset"), "rows") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query
def corpus_report(spark, d):
    r = records(spark, d)
    kinds = r.groupBy(F.lit("kind").alias("what"), F.coalesce("gt_kind", F.lit("None")).alias("value")).agg(F.count("*").alias("rows"))
    return kinds.union(r.groupBy(F.lit("source").alias("what"), F.coalesce("source", F.lit("None")).alias("value")).agg(F.count("*").alias("rows")))


@query
def land_ledger_antijoin(spark, d):
    """Batches of the ledger that code version 0.6.0 has not landed."""
    log = table(spark, d, "ingest_log")
    old = log.where("code_version = '0.6.0'").select("batch_hash").distinct()
    return log.select("batch_hash", "n_rows").distinct().join(old, "batch_hash", "left_anti")


@query
def part_sha256(spark, d):
    from millrace.sources.catalog import file_hashes

    return file_hashes(spark, f"{d}/orders.parquet")


@query
def lineage_edges(spark, d):
    return lineage.edges(spark.createDataFrame(EVENTS, lineage.EVENTS))


@query
def lineage_latest_jobs(spark, d):
    return lineage.latest_jobs(spark.createDataFrame(EVENTS, lineage.EVENTS)).select("job", "seq", F.array_join("outputs", ",").alias("outputs"))


@query
def lineage_upstream(spark, d):
    names = lineage.upstream(spark.createDataFrame(EVENTS, lineage.EVENTS), "gold/shards")
    return spark.createDataFrame([(n,) for n in names], "dataset string")


# --- SQL over views -------------------------------------------------------


def _sql(spark: SparkSession, d: str, names: list[str], statement: str) -> DataFrame:
    for n in names:
        table(spark, d, n).createOrReplaceTempView(n)
    return spark.sql(statement)


@query
def sql_pricing_summary(spark, d):
    return _sql(spark, d, ["lineitem"], SQL["sql_pricing_summary"])


@query
def sql_revenue_by_nation(spark, d):
    return _sql(spark, d, ["lineitem", "orders", "customer", "supplier", "nation", "region"], SQL["sql_revenue_by_nation"])


@query
def sql_rollup(spark, d):
    return _sql(spark, d, ["orders"], SQL["sql_rollup"])


@query
def sql_top_orders(spark, d):
    return _sql(spark, d, ["orders"], SQL["sql_top_orders"])


@query
def sql_semi_anti(spark, d):
    return _sql(spark, d, ["customer", "orders"], SQL["sql_semi_anti"])


#: Statements that both engines accept as they stand.
SQL = {
    "sql_pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_revenue_by_nation": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
             JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY n_name""",
    "sql_rollup": """
        SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "sql_top_orders": """
        SELECT o_custkey, o_orderkey, rk FROM (
            SELECT o_custkey, o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS rk FROM orders) t
        WHERE rk <= 3""",
    "sql_semi_anti": """
        SELECT c_mktsegment, count(*) AS n, cast(sum(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1 ELSE 0 END) AS bigint) AS with_orders
        FROM customer GROUP BY c_mktsegment""",
}
