"""Command line: python -m millrace.cli COMMAND --root DIR ..."""

from __future__ import annotations

import argparse
import json
import sys

from millrace.config import CorpusConfig, DedupConfig, GateConfig
from millrace.session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--root", default="data/lake")
        for a in args:
            p.add_argument(a)
        return p

    synth = command("synth", "out")
    synth.add_argument("--docs", type=int, default=500)
    synth.add_argument("--format", choices=("json", "csv", "parquet"), default="json")
    ingest = command("ingest", "input", "dataset")
    ingest.add_argument("--batch-size", type=int)
    ingest.add_argument("--via-stream", action="store_true")
    command("smoke").add_argument("--docs", type=int, default=200)
    command("sql", "statement")
    command("catalog")
    command("promote", "dataset").add_argument("--contract", action="store_true")
    for name in ("dedup", "shard", "score-gate"):
        command(name, "dataset")
    command("score-dedup", "dataset").add_argument("--sweep", nargs="*", type=float)
    command("drift", "reference", "current").add_argument("--layer", default="silver")
    graph = command("lineage")
    graph.add_argument("--mermaid", action="store_true")
    graph.add_argument("--upstream")
    command("versions")
    command("verify-snapshot", "snapshot")
    args = parser.parse_args(argv)

    from pyspark.sql import functions as F

    from millrace.operators import dedup, lineage, profile, scoring, versioning
    from millrace.operators.corpus import generate
    from millrace.plans import stages
    from millrace.plans.staging import stage
    from millrace.sources.catalog import Catalog
    from millrace.sources.files import open_source
    from millrace.sources.ingest import land
    from millrace.streaming.ingest import file_topic, land_stream

    spark = session()
    catalog = Catalog(spark, args.root)
    show = lambda x: print(json.dumps(x, indent=2, default=str, ensure_ascii=False))
    match args.command:
        case "synth":
            generate(spark, CorpusConfig(n_docs=args.docs)).write.mode("overwrite").option("header", True).format(args.format).save(args.out)
        case "ingest":
            source = open_source(spark, args.input)
            if args.via_stream:
                # The source becomes messages of a file topic; a second run drains what is new.
                topic = f"{catalog.root}/_topics/{args.dataset}"
                source.write.mode("append").json(topic)
                show(vars(land_stream(file_topic(spark, topic, source.schema), catalog, args.dataset, f"{catalog.root}/_groups/{args.dataset}", args.input)))
                return 0
            show(vars(land(source, catalog, args.dataset, args.input, batch_size=args.batch_size)))
        case "sql":
            show(catalog.query(args.statement))
        case "catalog":
            show(catalog.summary())
        case "promote":
            report = stages.promote(catalog, args.dataset, GateConfig(), args.contract)
            stages.write_report(catalog, f"gate_{args.dataset}", report, stages.quality_report(report))
            print(stages.quality_report(report))
            return int(report["verdict"] == "blocked")
        case "dedup":
            report = stages.deduplicate(catalog, args.dataset, DedupConfig())
            stages.write_report(catalog, f"dedup_{args.dataset}", report, stages.dedup_report(report))
            show(report)
        case "shard":
            show(stages.shard(catalog, args.dataset))
        case "score-gate":
            flagged = scoring.flag(catalog.read("bronze", args.dataset), catalog.read("quarantine", args.dataset))
            show(scoring.confusion(flagged, scoring.is_defect(F.col("gt_kind")), F.col("removed")).first().asDict())
        case "score-dedup":
            universe = catalog.read("bronze", args.dataset).join(catalog.read("quarantine", args.dataset).select("id").distinct(), "id", "left_anti")
            if args.sweep is not None:
                show(stages.sweep(universe, DedupConfig(), tuple(args.sweep) or (0.8, 0.85, 0.9, 0.95)))
                return 0
            flagged = stage(scoring.flag(universe, dedup.removed(dedup.clusters(universe, DedupConfig()))), "flagged")
            score = scoring.confusion(flagged, F.col("gt_dup_of").isNotNull(), F.col("removed")).first().asDict()
            score |= scoring.unlabeled_exact_copies(flagged, "removed").first().asDict()
            show(score | {"recall_by_kind": {r.kind: r.rate for r in scoring.by_kind(flagged.where("gt_dup_of is not null"), "removed").toLocalIterator()}})
        case "smoke":
            land(generate(spark, CorpusConfig(n_docs=args.docs)), catalog, "smoke", order=["id"])
            dangling = scoring.dangling_labels(catalog.read("bronze", "smoke")).count()
            done = {"gate": stages.promote(catalog, "smoke", GateConfig())["verdict"], "removed": stages.deduplicate(catalog, "smoke", DedupConfig())["removed_exact"]}
            done |= {"sequences": stages.shard(catalog, "smoke")["n_sequences"], "dangling_labels": dangling}
            done["verified"] = all(versioning.verify_snapshot(catalog, s["snapshot_id"])[0] for s in versioning.list_snapshots(catalog)[-1:])
            show(done)
            return int(done["gate"] != "promoted" or dangling > 0 or not done["verified"])
        case "drift":
            profile.profile_of(catalog.read(args.layer, args.reference)), profile.profile_of(catalog.read(args.layer, args.current))  # neither may be empty
            show(profile.drift_report(catalog.read(args.layer, args.reference), catalog.read(args.layer, args.current)).first().asDict())
        case "lineage":
            events = versioning.lineage_frame(catalog)
            if args.upstream:
                show(lineage.upstream(events, args.upstream))
                return 0
            print(lineage.to_mermaid(events)) if args.mermaid else show([r.asDict() for r in lineage.edges(events).toLocalIterator()])
        case "versions":
            show(versioning.list_snapshots(catalog))
        case "verify-snapshot":
            ok, detail = versioning.verify_snapshot(catalog, args.snapshot)
            print(detail)
            return int(not ok)
    return 0


if __name__ == "__main__":
    sys.exit(main())
