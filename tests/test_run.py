import json

import pytest

from tariffgrid.plans import catalog, directory, fx
from tariffgrid.plans.history import History
from tariffgrid.schema import as_offers, as_plans
from tariffgrid.sources.fetch import Fetched, Page, land_documents, land_sources
from tariffgrid.sources.landing import Config, land, published_plans, read_first, read_pages, selection, snapshot_rows
from tariffgrid.sources.shared import SharedFiles
from tariffgrid.streaming.pages import append_snapshots, stream_pages

DIRECTORY = {
    "openai": {"doc": "https://x", "models": {
        "gpt-a": {"id": "gpt-a", "name": "GPT A", "cost": {"input": 1, "output": "2.5"}, "limit": {"context": 1000.9}, "modalities": {"input": ["text", "image"], "output": ["text"]}, "release_date": "2026-01-01"},
        "gpt-batch": {"name": "GPT Batch", "cost": {"input": 0.5, "cache_read": ""}},
        "no-price": {"name": "None"}, "odd": 3,
    }},
    "google": "no object", "deepseek": {"models": []}, "unknown": {"models": {"m": {"cost": {"input": 1}}}},
}
RATES = {"base": "usd", "date": "2026-01-05", "rates": {"cny": 8, "eur": 0.5, "zero": 0, "text": "x"}}
CURSOR = "<b>Plan Price</b> Pro $20/mo Pro Plus $60/mo Ultra $200 / mo"


@pytest.fixture
def landed(tmp_path):
    (tmp_path / "dir.json").write_text(json.dumps(DIRECTORY))
    (tmp_path / "fx.json").write_text(json.dumps(RATES))
    (tmp_path / "pages").mkdir()
    return tmp_path


def test_directory_offers(spark, landed):
    rows = directory.directory_offers(directory.read_directory(spark, str(landed / "dir.json")), "now", "https://d").collect()
    got = {r["offer_id"]: r for r in rows}
    assert set(got) == {"openai/gpt-a/global/unspecified_endpoint/standard/standard", "openai/gpt-batch/global/unspecified_endpoint/batch/standard"}
    a, b = (got[k] for k in sorted(got))
    assert (a["input_per_1m"], a["output_per_1m"], a["context_window"], a["modalities"], a["source_url"]) == (1.0, 2.5, 1000, ["text", "image"], "https://x")
    assert (b["output_per_1m"], b["cache_read_per_1m"], b["model_id"]) == (None, None, "gpt-batch")


def test_rates(spark, landed):
    assert {r["currency"]: r["rate"] for r in fx.read_rates(spark, str(landed / "fx.json")).collect()} == {"USD": 8.0, "CNY": 1.0, "EUR": 16.0}
    for bad in ({"base": "usd", "date": "d", "rates": {"eur": 1}}, {"base": "usd", "rates": {"cny": 1}}, [1]):
        (landed / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            fx.read_rates(spark, str(landed / "bad.json"))


def _config(tmp_path, **more):
    return Config(data_dir=str(tmp_path / "data"), public_path=str(tmp_path / "public" / "catalog.json"), minimum_offers=1, minimum_plans=1, **more)


def _metadata(spark):
    return spark.createDataFrame([("openai", "OpenAI", "OpenAI", "us", "w")], "provider_id string, name string, name_en string, region string, website string")


def test_publish_then_retain_a_failed_source(spark, landed, monkeypatch):
    from tariffgrid.plans import plan_pages

    only = tuple(s for s in plan_pages.SOURCES if s.source_id == "cursor_plans")
    monkeypatch.setattr(plan_pages, "registry", lambda experimental=False: only)
    (landed / "pages" / "cursor_plans.html").write_text(CURSOR)
    config, inputs = _config(landed), catalog.Inputs(str(landed / "dir.json"), str(landed / "fx.json"), str(landed / "pages"))
    dry = catalog.run(spark, config, inputs, _metadata(spark), dry_run=True)
    assert dry["status"] == "candidate" and not (landed / "public").exists()
    first = catalog.run(spark, config, inputs, _metadata(spark))
    document = json.loads((landed / "public" / "catalog.json").read_text())
    assert document["schema_version"] == "3.1" and document["comparison"]["published_date"] == "2026-01-05"
    assert (document["summary"]["offer_count"], document["summary"]["plan_count"]) == (2, 3)
    assert document["model_offers"][0]["comparison_input_per_1m"] == 8.0 and document["model_offers"][0]["input_per_1m"] == 1.0
    assert json.loads((landed / "public" / "status.json").read_text())["published_at"] and first["overall"] == "healthy"

    (landed / "pages" / "cursor_plans.html").write_text("changed page")
    second = catalog.run(spark, config, inputs, _metadata(spark))
    assert second["overall"] == "degraded" and second["sources"]["cursor_plans"]["status"] == "stale"
    history = History(spark, f"{config.data_dir}/history")
    assert history.last_good_plans("cursor_plans").count() == 3 and history.previous_counts() == (2, 3)
    assert sorted(r["status"] for r in history.releases().collect()) == ["published", "superseded"]
    assert sorted(r["status"] for r in history.runs().collect()) == ["published", "published", "succeeded"]
    assert history.read("plans").count() == 9 and history.read("source_snapshots").count() == 3


def test_a_failed_source_without_history_fails_the_run(spark, landed, monkeypatch):
    from tariffgrid.plans import plan_pages

    only = tuple(s for s in plan_pages.SOURCES if s.source_id == "cursor_plans")
    monkeypatch.setattr(plan_pages, "registry", lambda experimental=False: only)
    (landed / "pages" / "x.html").write_text("nothing")
    config, inputs = _config(landed), catalog.Inputs(str(landed / "dir.json"), str(landed / "fx.json"), str(landed / "pages"))
    with pytest.raises(ValueError, match="too few plans"):
        catalog.run(spark, config, inputs, _metadata(spark))
    assert [r["status"] for r in History(spark, f"{config.data_dir}/history").runs().collect()] == ["failed"] and not (landed / "public").exists()
    plan = {"plan_id": "cursor/cursor/x", "provider_id": "cursor", "product_name": "X", "source_url": only[0].source_url, "surprise": 1, "plan_category": "coding_tool", "billing_type": "subscription", "price_amount": 1.0}
    (landed / "public").mkdir()
    (landed / "public" / "catalog.json").write_text(json.dumps({"schema_version": "3.0", "plans": [plan | {"plan_id": f"c/{k}"} for k in range(3)] + [{"plan_id": "broken"}]}))
    assert catalog.run(spark, config, inputs, _metadata(spark))["sources"]["cursor_plans"]["status"] == "stale"


def test_one_writer(spark, tmp_path):
    files = SharedFiles(spark)
    with catalog.single_writer(files, str(tmp_path / "lock")), pytest.raises(RuntimeError), catalog.single_writer(files, str(tmp_path / "lock")):
        pass


def test_releases_are_immutable(spark, tmp_path):
    files = SharedFiles(spark)
    catalog.publish(files, str(tmp_path / "r1"), str(tmp_path / "c.json"), lambda path: files.create(path, "{}"), {})
    with pytest.raises(FileExistsError):
        catalog.publish(files, str(tmp_path / "r1"), str(tmp_path / "c.json"), lambda path: files.create(path, "{}"), {})


@pytest.mark.parametrize("rows_a_shard", [7, 1000])
def test_the_document_is_made_of_ordered_shards(spark, tmp_path, rows_a_shard):
    offers = spark.range(40).selectExpr("concat('o', lpad(cast(id * 7 % 40 as string), 3, '0')) as offer_id", "concat('p', cast(id % 3 as string)) as provider_id", "'é, \\n' as model_name", "cast(null as double) as input_per_1m")
    plans = spark.createDataFrame([], "plan_id string, provider_id string")
    rates = spark.createDataFrame([("USD", 7.0, "2026-01-02"), ("CNY", 1.0, "2026-01-02")], "currency string, rate double, published_date string")
    at = str(tmp_path / "catalog.json")
    catalog.write_document(SharedFiles(spark), at, as_offers(offers), as_plans(plans), rates, _metadata(spark), "r", "t", rows_a_shard)
    document = json.loads((tmp_path / "catalog.json").read_text())
    assert list(document) == ["schema_version", "release_id", "published_at", "providers", "model_offers", "plans", "comparison", "summary"]
    keys = [(o["provider_id"], o["offer_id"]) for o in document["model_offers"]]
    assert keys == sorted(keys) and len(keys) == 40 and document["plans"] == [] and document["model_offers"][0]["input_per_1m"] is None
    assert [p["provider_id"] for p in document["providers"]] == ["p0", "p1", "p2"] and document["comparison"]["rates"] == {"CNY": 1.0, "USD": 7.0}
    assert document["summary"]["offer_count"] == 40 and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["catalog.json"]


def test_landing(spark, tmp_path, monkeypatch):
    land(str(tmp_path / "raw"), "a", b"x")
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "one.md").write_text("| a |")
    assert [tuple(r) for r in read_pages(spark, str(tmp_path / "pages")).collect()] == [("one", "| a |")]
    assert read_first(spark, str(tmp_path / "gone.json"), str(tmp_path / "pages" / "one.md")).first()[0] == "| a |"
    with pytest.raises(FileNotFoundError):
        read_first(spark, str(tmp_path / "gone.json"))
    assert published_plans(spark, str(tmp_path / "gone.json")).count() == 0
    assert selection('["a", 1, "b", "c", "d", "e"]') == ["a", "b", "c", "d"] and selection("no") == [] and selection(None) == []
    monkeypatch.setenv("TARIFFGRID_MINIMUM_OFFERS", "7")
    assert Config.from_env().minimum_offers == 7


def test_new_pages_are_appended_once(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    history = History(spark, str(tmp_path / "history"))
    for name in ("one", "two"):
        (tmp_path / "pages" / f"{name}.md").write_text(name)
        append_snapshots(stream_pages(spark, str(tmp_path / "pages")), history, "run", str(tmp_path / "checkpoint")).awaitTermination(60)
    assert sorted(r["source_id"] for r in history.read("source_snapshots").collect()) == ["one", "two"]


def test_fetched_pages_land_and_failures_are_told(spark, tmp_path):
    def fetch(url, timeout):
        if "bad" in url:
            raise OSError("no route")
        return Fetched(f"<p>{url}</p>".encode(), 200, {"ETag": "e"})

    told = land_sources([("a", "http://good"), ("b", "http://bad")], str(tmp_path), fetch)
    assert [(t["source_id"], t["status"]) for t in told] == [("a", "landed"), ("b", "failed")] and "no route" in told[1]["error"] and told[0]["etag"] == "e"
    assert [tuple(r) for r in read_pages(spark, str(tmp_path)).collect()] == [("a", "<p>http://good</p>")]


def test_browser_pages_and_versions(spark, tmp_path):
    seen = []

    def browse(url, timeout, selector, settle_ms):
        seen.append((url, selector, settle_ms))
        return Fetched("<p>é</p>".encode(), 200, {"last-modified": "then"})

    pages = [Page("a", "http://x", "browser", "#prices"), Page("b", "http://y", "browser"), Page("c", "http://z")]
    land_sources(pages, str(tmp_path), lambda url, timeout: Fetched(b"plain", 200, {"ETag": "v1"}), browse=browse)
    assert sorted(seen) == [("http://x", "#prices", 1500), ("http://y", None, 1500)]
    rows = {r["source_id"]: r for r in snapshot_rows(read_pages(spark, str(tmp_path)), "run", "now", str(tmp_path)).collect()}
    assert {k: (r["etag"], r["last_modified"], r["size"]) for k, r in rows.items()} == {"a": (None, "then", 9), "b": (None, "then", 9), "c": ("v1", None, 5)}


def test_directory_and_rates_are_landed_by_address(spark, landed, tmp_path):
    files = {"http://d": (landed / "dir.json").read_bytes(), "http://f": (landed / "fx.json").read_bytes()}
    config = Config(data_dir=str(tmp_path), directory_url="http://d", fx_url="http://f")
    paths = land_documents(config, str(tmp_path / "raw"), lambda url, timeout: Fetched(files[url], 200, {}))
    assert all(p.endswith(".json.gz") for p in paths)
    assert directory.directory_offers(directory.read_directory(spark, paths[0]), "now").count() and fx.read_rates(spark, paths[1]).count() == 3
    with pytest.raises(RuntimeError, match="fx"):
        land_documents(Config(directory_url="http://d", fx_url="http://gone"), str(tmp_path / "raw"), lambda url, timeout: Fetched(files[url], 200, {}))


def test_plans_made_elsewhere(spark):
    made = spark.createDataFrame([("p", "x")], "plan_id string, provider_id string")
    plans, told = catalog.gather_plans(spark, catalog.Inputs("d", "f", plans=made), "now", None, "")
    assert [r["plan_id"] for r in plans.collect()] == ["p"] and told == {}
    with pytest.raises(ValueError, match="not both"):
        catalog.Inputs("d", "f", "pages", plans=made)


def test_probe_of_offers_tells_markets(spark, tmp_path):
    (tmp_path / "kimi_official_k26.md").write_text('<T rows={[["Kimi-Z", "1M tokens", "¥1.1", "¥6.5", "¥27.00", "262,144 tokens"]]} />')
    report, told = catalog.probe(spark, str(tmp_path), "offers")
    row = report.where("source_id = 'kimi_official_k26'").first()
    assert (row["markets"], row["currencies"]) == (["cn_mainland"], ["CNY"]) and told["status"] == "degraded"


def test_probe(spark, tmp_path):
    (tmp_path / "cursor_plans.html").write_text(CURSOR)
    report, told = catalog.probe(spark, str(tmp_path))
    assert told["status"] == "degraded" and told["n_healthy"] == 1 and told["n_sources"] == 17
    assert report.where("healthy").first()["source_id"] == "cursor_plans"
