"""Command line: run, status, probe-plans, probe-official-markets. Answers are JSON on standard output."""

from __future__ import annotations

import argparse
import json
import uuid

from tariffgrid.plans import catalog
from tariffgrid.plans.history import History
from tariffgrid.session import build_session
from tariffgrid.sources.fetch import land_documents
from tariffgrid.sources.landing import Config
from tariffgrid.sources.registry import fetched_pages, land_pages, page_bodies


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tariffgrid")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--directory-file", help="a landed file; without it the configured address is fetched")
    run.add_argument("--fx-file", help="a landed file; without it the configured address is fetched")
    run.add_argument("--pages", help="a folder of landed pages; without it the pages of the registries are fetched")
    run.add_argument("--browser", help="module:function that fetches pages made by scripts")
    run.add_argument("--metadata", help="JSON lines of provider_id, name, name_en, region, website")
    run.add_argument("--official-markets", action="store_true")
    run.add_argument("--models-only", action="store_true")
    commands.add_parser("status")
    for name in ("probe-plans", "probe-official-markets"):
        probe = commands.add_parser(name)
        probe.add_argument("--pages", help="a folder of landed pages; without it the pages of the registry are fetched")
        probe.add_argument("--browser", help="module:function that fetches pages made by scripts")
    asked = parser.parse_args(arguments)
    spark, config = build_session(), Config.from_env()
    if asked.command == "status":
        found = History(spark, f"{config.data_dir}/history").runs().orderBy("started_at", ascending=False).first()
        told, bad = found.asDict() if found else {}, False
    elif asked.command == "run":
        schema = "provider_id string, name string, name_en string, region string, website string"
        metadata = spark.read.schema(schema).json(asked.metadata) if asked.metadata else spark.createDataFrame([], schema)
        wanted = asked.official_markets or not asked.models_only
        plans = spark.createDataFrame([], "plan_id string") if asked.models_only else None
        directory, rates, run_id = asked.directory_file, asked.fx_file, uuid.uuid4().hex
        if not (directory and rates):
            landed = land_documents(config, f"{config.data_dir}/raw/documents/run_id={run_id}")
            directory, rates = directory or landed[0], rates or landed[1]
        inputs = catalog.Inputs(directory, rates, asked.pages if wanted else None, asked.official_markets, plans=plans, fetch=wanted and not asked.pages, fetching={"browse": asked.browser})
        told = catalog.run(spark, config, inputs, metadata, dry_run=asked.dry_run, run_id=run_id)
        bad = False
    else:
        kind = asked.command == "probe-plans"
        pages = asked.pages
        if not pages:
            registry = catalog.registered_pages(plans=kind, offers=not kind, experimental=True)
            rows = fetched_pages(spark, registry, timeout=config.timeout_s, browse=asked.browser)
            pages = page_bodies(land_pages(rows, f"{config.data_dir}/raw/probes", uuid.uuid4().hex))
        report, told = catalog.probe(spark, pages, "plans" if kind else "offers")
        told["sources"] = [r.asDict() for r in report.orderBy("source_id").collect()]
        bad = told["status"] != "healthy"
    print(json.dumps(told, ensure_ascii=False, sort_keys=True, default=str))
    return int(bad)


if __name__ == "__main__":
    raise SystemExit(main())
