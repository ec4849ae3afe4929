"""Manifests of datasets by content, and snapshots that pin a stage's inputs, config and output."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import functions as F

import millrace
from millrace.sources.catalog import Catalog, file_hashes


def _canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def build_manifest(catalog: Catalog, layer: str, dataset: str) -> dict:
    """Layer, dataset, rows, schema, parts (name, sha256, rows) and the hash over the lines ``name:sha256`` of the sorted parts.

    The list of parts comes to the driver: one entry per file.
    """
    path = catalog.path(layer, dataset)
    df = catalog.spark.read.parquet(path)
    rows = df.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part")).groupBy("part").count()
    files = file_hashes(catalog.spark.newSession(), f"{path}/{'*/' if layer == 'bronze' else ''}*.parquet")
    found = {r.part: r.sha256 for r in files.toLocalIterator()}
    counts = {r.part: r["count"] for r in rows.toLocalIterator()}
    parts = [{"name": n, "sha256": s, "rows": counts.get(n, 0)} for n, s in sorted(found.items())]
    lines = [f"{p['name']}:{p['sha256']}" for p in parts]
    return {
        "layer": layer,
        "dataset": dataset,
        "rows": sum(counts.values()),
        "schema": [[f.name, f.dataType.simpleString()] for f in df.schema if f.name != "_batch_hash"],
        "parts": parts,
        "content_hash": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def snapshot_stage(catalog: Catalog, stage: str, dataset: str, config, inputs: list[dict], output: dict | None) -> dict:
    """Record of a run; its id depends on stage, config, inputs, code version and output only."""
    held = dataclasses.asdict(config) if dataclasses.is_dataclass(config) else config
    config_hash = hashlib.sha256(_canonical(held).encode()).hexdigest()
    pins = [[m["layer"], m["dataset"], m["content_hash"]] for m in inputs]
    out = [output["layer"], output["dataset"], output["content_hash"]] if output else None
    key = _canonical({"stage": stage, "config_hash": config_hash, "inputs": pins, "code_version": millrace.__version__, "output": out})
    record = {
        "snapshot_id": hashlib.sha256(key.encode()).hexdigest()[:12], "stage": stage, "dataset": dataset,
        "created_at": datetime.now(UTC).isoformat(), "code_version": millrace.__version__, "config": held, "config_hash": config_hash, "inputs": pins, "output": out,
    }
    return catalog.append_event("snapshots", record)


def list_snapshots(catalog: Catalog) -> list[dict]:
    return sorted(catalog.events("snapshots"), key=lambda s: (s["created_at"], s["seq"]))


def verify_snapshot(catalog: Catalog, snapshot_id: str) -> tuple[bool, str]:
    """Does the output still have the recorded content?"""
    found = [s for s in list_snapshots(catalog) if s["snapshot_id"] == snapshot_id]
    if not found:
        return False, f"no snapshot {snapshot_id}"
    out = found[-1]["output"]
    if out is None:
        return True, "the stage had no output"
    try:
        now = build_manifest(catalog, out[0], out[1])["content_hash"]
    except ValueError as error:
        return False, str(error)
    return (True, "content matches") if now == out[2] else (False, f"content of {out[0]}/{out[1]} has changed")


def emit_event(catalog: Catalog, job: str, inputs: list[str], outputs: list[str], **facets) -> None:
    catalog.append_event("lineage", {"eventTime": datetime.now(UTC).isoformat(), "job": job, "inputs": inputs, "outputs": outputs, "facets": facets})


def lineage_frame(catalog: Catalog):
    from millrace.operators.lineage import EVENTS

    return catalog.spark.createDataFrame([(e["seq"], e["job"], e["inputs"], e["outputs"]) for e in catalog.events("lineage")], EVENTS)
