"""The stages over a catalog: promote, deduplicate, shard, features; each writes, logs and pins what it did."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from millrace.config import DedupConfig, GateConfig, ShardConfig
from millrace.operators import asof, dedup, gate, sharding
from millrace.operators.versioning import build_manifest, emit_event, snapshot_stage
from millrace.plans.staging import stage
from millrace.sources.catalog import Catalog


def promote(catalog: Catalog, dataset: str, cfg: GateConfig | None = None, contract: bool = False) -> dict:
    """Gate bronze into silver and quarantine. A blocked gate, or with ``contract`` a broken contract, writes and clears nothing."""
    cfg = cfg or GateConfig()
    before = build_manifest(catalog, "bronze", dataset)
    noted = stage(gate.annotate(catalog.read("bronze", dataset), cfg), "gate")
    report = gate.summary(noted, cfg).first().asDict()
    report["reasons_histogram"] = {r.reason: r.hits for r in gate.reason_histogram(noted).toLocalIterator()}
    if report["verdict"] == "blocked":
        emit_event(catalog, f"promote:{dataset}", [f"bronze/{dataset}"], [], **report)
        return report
    if contract:
        gate.assert_contract(gate.promoted(noted), cfg.id_column, cfg.text_column, cfg.min_words)
    catalog.replace(gate.promoted(noted), "silver", dataset, cfg.part_rows)
    catalog.replace(gate.quarantined(noted), "quarantine", dataset, cfg.part_rows)
    emit_event(catalog, f"promote:{dataset}", [f"bronze/{dataset}"], [f"silver/{dataset}", f"quarantine/{dataset}"], **report)
    snapshot_stage(catalog, "promote", dataset, cfg, [before], build_manifest(catalog, "silver", dataset))
    return report


def deduplicate(catalog: Catalog, dataset: str, cfg: DedupConfig | None = None) -> dict:
    """Remove duplicates from silver, in place."""
    cfg = cfg or DedupConfig()
    before = build_manifest(catalog, "silver", dataset)
    silver = catalog.read("silver", dataset)
    counted: dict = {}
    found = stage(dedup.clusters(silver, cfg, counted), "dedup-clusters")
    report = dedup.summary(silver, found).first().asDict() | counted
    # The removed ids may be any number: they are a dataset beside the report.
    catalog.replace(dedup.removed(found), "quarantine", f"{dataset}_removed", cfg.part_rows)
    report["removed_ids"] = f"quarantine/{dataset}_removed"
    catalog.replace(dedup.kept(silver, found, cfg.id_column), "silver", dataset, cfg.part_rows)
    emit_event(catalog, f"dedup:{dataset}", [f"silver/{dataset}"], [f"silver/{dataset}"], **report)
    snapshot_stage(catalog, "dedup", dataset, cfg, [before], build_manifest(catalog, "silver", dataset))
    return report


def shard(catalog: Catalog, dataset: str, cfg: ShardConfig | None = None) -> dict:
    """Pack silver into gold sequences; too few tokens for one sequence is an error."""
    cfg = cfg or ShardConfig()
    before = build_manifest(catalog, "silver", dataset)
    placed = sharding.offsets(catalog.read("silver", dataset), cfg)
    report = sharding.summary(placed, cfg).first().asDict()
    if not report["n_sequences"]:
        raise ValueError("too few tokens for one sequence")
    catalog.replace(sharding.sequences(placed, cfg), "gold", dataset, cfg.sequences_per_shard)
    emit_event(catalog, f"shard:{dataset}", [f"silver/{dataset}"], [f"gold/{dataset}"], **report)
    snapshot_stage(catalog, "shard", dataset, cfg, [before], build_manifest(catalog, "gold", dataset))
    return report


class FeatureStore:
    """Feature views: an entity, a time and feature columns, as Parquet with a description beside it."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog

    def register(self, name: str, df: DataFrame, entity: str, time: str, features: list[str] | None = None) -> dict:
        missing = {entity, time, *(features or [])} - set(df.columns)
        if missing:
            raise ValueError(f"missing columns {sorted(missing)}")
        features = features or [c for c in df.columns if c not in (entity, time)]
        if not features:
            raise ValueError("a feature view needs a feature column")
        self.catalog.replace(df.select(entity, time, *features), "gold", f"feature_{name}")
        view = {"name": name, "entity": entity, "time": time, "features": features}
        self.catalog.write_text(f"{self.catalog.root}/_features/{name}.json", json.dumps(view))
        return view

    def view(self, name: str) -> tuple[dict, DataFrame]:
        text = self.catalog.read_text(f"{self.catalog.root}/_features/{name}.json")
        if text is None:
            raise ValueError(f"no feature view {name!r}")
        return json.loads(text), self.catalog.read("gold", f"feature_{name}")

    def training_set(self, spine: DataFrame, name: str, entity: str, time: str) -> DataFrame:
        """Spine rows with the view's values at their time; guarded against leakage."""
        view, df = self.view(name)
        joined = asof.asof_join(spine, df, entity, time, view["features"], name, tie=view["features"], f_entity=view["entity"], f_time=view["time"])
        asof.assert_no_leakage(joined, time, name)
        return joined

    def latest(self, name: str, key) -> dict | None:
        """The online value of one entity."""
        view, df = self.view(name)
        rows = asof.latest(df.where(df[view["entity"]] == key), view["entity"], view["time"], view["features"]).limit(1).collect()
        return rows[0].asDict() if rows else None


def quality_report(report: dict) -> str:
    """The gate's report as Markdown."""
    hits = sorted(report.get("reasons_histogram", {}).items(), key=lambda x: (-x[1], x[0]))
    return "\n".join(
        ["# Quality gate", "", f"Verdict: **{report['verdict']}**", "", "| measure | value |", "|-|-|", *(f"| {k} | {v} |" for k, v in report.items() if k not in ("verdict", "reasons_histogram")), "", "| rule | hits |", "|-|-|", *(f"| {k} | {v} |" for k, v in hits)]
    )


def dedup_report(report: dict) -> str:
    """The deduplication report as Markdown; ``removed_ids`` names the dataset that holds them."""
    return "\n".join(["# Deduplication", "", "| measure | value |", "|-|-|", *(f"| {k} | {v} |" for k, v in report.items())])


def write_report(catalog: Catalog, name: str, report: dict, markdown: str) -> None:
    """``_reports/<name>.json`` and ``.md`` under the catalog's root."""
    catalog.write_text(f"{catalog.root}/_reports/{name}.json", json.dumps(report, indent=2, sort_keys=True, default=str, ensure_ascii=False))
    catalog.write_text(f"{catalog.root}/_reports/{name}.md", markdown + "\n")


def sweep(universe: DataFrame, cfg: DedupConfig, thresholds: tuple[float, ...]) -> list[dict]:
    """Deduplication scored at each threshold; the pairs are formed once, at the least."""
    from dataclasses import replace as changed

    from pyspark.sql import functions as F

    from millrace.operators import scoring

    reps, pairs = dedup.near_pairs(universe, changed(cfg, threshold=min(thresholds)))
    out = []
    for t in sorted(thresholds):
        gone = stage(dedup.removed(dedup.grouped(universe, reps, pairs.where(F.col("similarity") >= t), cfg)), "sweep-gone")
        flagged = stage(scoring.flag(universe, gone), "sweep-flagged")
        kinds = {r.kind: r.rate for r in scoring.by_kind(flagged.where("gt_dup_of is not null"), "removed").toLocalIterator()}  # one row per kind of label
        row = scoring.confusion(flagged, F.col("gt_dup_of").isNotNull(), F.col("removed")).first().asDict()
        out.append({"threshold": t, "removed": gone.select("id").distinct().count()} | row | {"recall_by_kind": kinds})
    return out
