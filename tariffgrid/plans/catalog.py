"""The catalog document, its atomic publication, and the run that makes it."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffgrid import SCHEMA_VERSION
from tariffgrid.operators import quality
from tariffgrid.operators.catalog_query import with_provider_info
from tariffgrid.plans import directory, fx, offer_pages, plan_pages
from tariffgrid.plans.history import History, counted
from tariffgrid.schema import as_offers, as_plans
from tariffgrid.sources.fetch import Page
from tariffgrid.sources.landing import Config, published_plans, read_pages, snapshot_rows
from tariffgrid.sources.registry import fetched_pages, land_pages, page_bodies, page_versions
from tariffgrid.sources.shared import SharedFiles, publish, single_writer


def now_text() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def release_name() -> str:
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


#: Rows of one shard of a list of the catalog document.
SHARD_ROWS = 50_000


def write_list(rows: DataFrame, keys: tuple[str, ...], folder: str, n: int, rows_a_shard: int = SHARD_ROWS) -> None:
    """Rows as JSON objects in order of the keys, dealt by ranges into shards whose names are in order; each object ends in a comma and a new line."""
    dealt = rows.repartitionByRange(max(1, -(-n // rows_a_shard)), *keys).sortWithinPartitions(*keys)
    objects = dealt.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    objects.write.mode("overwrite").option("lineSep", ",\n").text(folder)


def write_document(files: SharedFiles, path: str, offers: DataFrame, plans: DataFrame, rates: DataFrame, metadata: DataFrame, release_id: str, published_at: str, rows_a_shard: int = SHARD_ROWS) -> None:
    """Write the catalog as one JSON file: providers, offers and plans in order, comparison rates, summary.

    The lists are sorted and turned into text by tasks, shard by shard, and the shards'
    bytes are then copied one after the other; no row passes through the driver's memory,
    and no task holds more than a shard. Only rates and totals, a few numbers, are put in by hand.
    """
    ids = offers.select("provider_id").union(plans.select("provider_id")).distinct()
    total = counted(offers, plans).first().asDict()
    lists = (
        ("providers", with_provider_info(ids, metadata), ("provider_id",), total["provider_count"]),
        ("model_offers", as_offers(offers), ("provider_id", "offer_id"), total["offer_count"]),
        ("plans", as_plans(plans), ("provider_id", "plan_id"), total["plan_count"]),
    )
    head = {"schema_version": SCHEMA_VERSION, "release_id": release_id, "published_at": published_at}
    parts: list = ["{" + ", ".join(f"{json.dumps(k)}: {json.dumps(v)}" for k, v in head.items())]
    for name, rows, keys, n in lists:
        folder = f"{path}.{name}"
        write_list(rows, keys, folder, n, rows_a_shard)
        shards = files.listed(folder)
        if shards:  # no comma after the last object
            shards[-1] = (shards[-1][0], shards[-1][1] - len(",\n"))
        parts += [f', "{name}": [\n', shards, "\n]"]
    known = rates.select("currency", "rate", "published_date").collect()  # as many as there are currencies
    comparison = {"currency": "CNY", "published_date": max((r["published_date"] for r in known), default=None), "rates": {r["currency"]: r["rate"] for r in sorted(known)}}
    parts.append(f', "comparison": {json.dumps(comparison)}, "summary": {json.dumps(total)}}}')
    files.assemble(path, parts)
    for name, *_ in lists:
        files.delete(f"{path}.{name}")


@dataclass(frozen=True)
class Inputs:
    """Where inputs are: directory and rates as landed JSON files, pages as a landed folder (or none), or plans made elsewhere.

    With fetch the run gets the pages of the registries itself and lands them under its own id;
    `fetching` are options of the registry source (timeout, attempts, pause, fetch, browse).
    """

    directory: str
    rates: str
    pages: str | None = None
    with_offer_pages: bool = False
    experimental: bool = False
    plans: DataFrame | None = None
    fetch: bool = False
    fetching: dict = field(default_factory=dict)
    #: Rows of the registry pages as landed; a run that fetches sets it.
    landed: DataFrame | None = None

    def __post_init__(self):
        if self.plans is not None and (self.pages is not None or self.fetch) and not self.with_offer_pages:
            raise ValueError("give plans or pages, not both")
        if self.pages is not None and self.fetch:
            raise ValueError("give pages, or have them fetched")

    def page_rows(self, spark: SparkSession) -> DataFrame | None:
        """(source_id, body) of the pages, None if there are none."""
        if self.landed is not None:
            return page_bodies(self.landed)
        return read_pages(spark, self.pages) if self.pages else None


def registered_pages(*, plans: bool = True, offers: bool = False, experimental: bool = False, selectors: dict[str, str] | None = None) -> list[Page]:
    """The pages of the registries to fetch; selectors: what a page made by scripts must show before it is read."""
    found = [Page(s.source_id, s.source_url, "browser" if s.kind == "browser" else "static", (selectors or {}).get(s.source_id)) for s in (plan_pages.registry(experimental) if plans else ())]
    return found + [Page(s.source_id, s.source_url) for s in (offer_pages.SOURCES if offers else ())]


def retained_plans(spark: SparkSession, source: plan_pages.PlanSource, history: History, public_path: str) -> DataFrame:
    """A failed source's plans as last released, else as in the public artifact; GateError if there are too few."""
    for kept in (history.last_good_plans(source.source_id), published_plans(spark, public_path).where(F.col("source_url") == source.source_url)):
        if kept.count() >= source.minimum:
            return kept
    raise quality.GateError(f"{source.source_id}: too few plans, and none to fall back to")


def gather_plans(spark: SparkSession, inputs: Inputs, fetched_at: str, history: History, public_path: str) -> tuple[DataFrame, dict]:
    """Plans of every registered source, a source that fails kept as it last was; and each source's status.

    One pass over the pages counts what every source gives.
    """
    empty = as_plans(spark.createDataFrame([], "plan_id string"))
    if inputs.plans is not None:
        return as_plans(inputs.plans), {}
    pages = inputs.page_rows(spark)
    if pages is None:
        return empty, {}
    sources = plan_pages.registry(inputs.experimental)
    fresh = plan_pages.page_plans(pages, fetched_at, sources).cache()
    report = {r["source_id"]: r for r in quality.source_report(fresh, plan_pages.product_table(spark, inputs.experimental), exact=True).collect()}
    kept, status = fresh, {}
    for source in sources:
        row = report[source.source_id]
        status[source.source_id] = {"status": "healthy" if row["healthy"] else "stale", "count": row["n"]}
        if not row["healthy"]:
            old = retained_plans(spark, source, history, public_path).withColumn("source_id", F.lit(source.source_id))
            kept = kept.where(F.col("source_id") != source.source_id).unionByName(old)
    return kept, status


def gather_offers(spark: SparkSession, inputs: Inputs, fetched_at: str) -> tuple[DataFrame, dict]:
    """Offers of the directory, and of the vendors' pages if asked for; a page that gives too few is an error."""
    offers = directory.directory_offers(directory.read_directory(spark, inputs.directory), fetched_at)
    pages = inputs.page_rows(spark)
    if not inputs.with_offer_pages or pages is None:
        return offers, {}
    paged = offer_pages.page_offers(pages, fetched_at)
    expected = spark.createDataFrame([(s.source_id, s.minimum) for s in offer_pages.SOURCES], "source_id string, minimum int")
    report = quality.source_report(paged, expected).collect()
    if short := [r["source_id"] for r in report if not r["healthy"]]:
        raise quality.GateError(f"too few offers: {', '.join(sorted(short))}")
    return offers.unionByName(paged), {r["source_id"]: {"status": "healthy", "count": r["n"]} for r in report}


def run(spark: SparkSession, config: Config, inputs: Inputs, metadata: DataFrame, *, dry_run: bool = False, run_id: str | None = None) -> dict:
    """Make a catalog from landed inputs, keep it in the history and, unless dry, publish it. Fails closed."""
    history, files = History(spark, f"{config.data_dir}/history"), SharedFiles(spark)
    run_id, at = run_id or uuid.uuid4().hex, now_text()
    history.add("run_events", (run_id, "running", at, ""))
    try:
        with single_writer(files, f"{config.data_dir}/run.lock"):
            status = _run(spark, config, inputs, metadata, history, files, run_id, at, dry_run)
    except Exception as error:
        history.add("run_events", (run_id, "failed", now_text(), f"{type(error).__name__}: {error}"[:500]))
        raise
    history.add("run_events", (run_id, "succeeded" if dry_run else "published", now_text(), ""))
    return status


def land_registries(spark: SparkSession, config: Config, inputs: Inputs, run_id: str) -> tuple[DataFrame, dict]:
    """Fetch what the run needs of the registries, in tasks, and land it under the run; what failed, by source."""
    pages = registered_pages(plans=inputs.plans is None, offers=inputs.with_offer_pages, experimental=inputs.experimental)
    landed = land_pages(fetched_pages(spark, pages, **{"timeout": config.timeout_s} | inputs.fetching), f"{config.data_dir}/raw/pages", run_id)
    return landed, {r["source_id"]: r["error"] for r in landed.where("status = 'failed'").select("source_id", "error").collect()}


def _run(spark, config, inputs, metadata, history, files, run_id, at, dry_run) -> dict:
    rates = fx.read_rates(spark, inputs.rates).cache()
    history.add("fx_snapshots", (run_id, run_id, rates.first()["published_date"], json.dumps({r["currency"]: r["rate"] for r in rates.collect()}, sort_keys=True)))
    failed = {}
    if inputs.fetch:
        landed, failed = land_registries(spark, config, inputs, run_id)
        inputs = replace(inputs, landed=landed)
        history.replace("source_snapshots", page_versions(landed))
    elif inputs.pages:
        history.replace("source_snapshots", snapshot_rows(read_pages(spark, inputs.pages), run_id, at, inputs.pages))
    offers, offer_status = gather_offers(spark, inputs, at)
    plans, plan_status = gather_plans(spark, inputs, at, history, config.public_path)
    before = history.previous_counts() or (None, None)
    with_pages = inputs.plans is None and inputs.page_rows(spark) is not None
    gates = (
        quality.offer_gate(minimum=config.minimum_offers, previous=before[0], maximum_drop=config.maximum_drop),
        quality.plan_gate(minimum=config.minimum_plans if with_pages else 0, previous=before[1] if with_pages else None, maximum_drop=config.maximum_drop),
    )
    release_id, snapshot_id = release_name(), uuid.uuid4().hex
    offers, plans = history.save_snapshot(snapshot_id, run_id, at, fx.compare_offers(offers, rates), fx.compare_plans(plans, rates), gates)
    sources = offer_status | plan_status
    for source, error in failed.items():
        if source in sources:
            sources[source]["error"] = error
    overall = "healthy" if all(s["status"] == "healthy" for s in sources.values()) else "degraded"
    status = {"run_id": run_id, "release_id": release_id, "status": "candidate" if dry_run else "published", "overall": overall, "sources": sources, "published_at": None if dry_run else now_text()}
    if not dry_run:
        publish(files, f"{config.data_dir}/releases/{release_id}", config.public_path, lambda path: write_document(files, path, offers, plans, rates, metadata, release_id, at), status)
        history.add("releases", (release_id, snapshot_id, status["published_at"]))
    return status


def probe(spark: SparkSession, folder: str | DataFrame, kind: str = "plans", experimental: bool = True) -> tuple[DataFrame, dict]:
    """Source report over landed pages, a folder or rows (source_id, body), and its rollup with the time it took; writes nothing."""
    began = time.monotonic()
    pages = read_pages(spark, folder) if isinstance(folder, str) else folder
    if kind == "plans":
        report = quality.source_report(plan_pages.page_plans(pages, now_text(), plan_pages.registry(experimental)), plan_pages.product_table(spark, experimental), exact=True)
    else:
        expected = spark.createDataFrame([(s.source_id, s.minimum) for s in offer_pages.SOURCES], "source_id string, minimum int")
        offers = offer_pages.page_offers(pages, now_text())
        told = offers.groupBy("source_id").agg(F.sort_array(F.collect_set("market")).alias("markets"), F.sort_array(F.collect_set("currency")).alias("currencies"))
        report = quality.source_report(offers, expected).join(told, "source_id", "left")
    report = report.cache()
    told = quality.health(report).first().asDict()
    return report, told | {"duration_ms": int((time.monotonic() - began) * 1000)}
