"""Registry pages fetched by tasks, landed by run, read as batch and as stream; history by key; publication on shared storage."""

import gzip
import http.server
import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tariffgrid.operators import quality
from tariffgrid.plans import catalog, plan_pages
from tariffgrid.plans.history import History
from tariffgrid.sources import shared
from tariffgrid.sources.fetch import Page
from tariffgrid.sources.landing import Config, land, read_pages
from tariffgrid.sources.registry import fetched_pages, land_pages, landed_pages, page_bodies, page_versions
from tariffgrid.streaming.pages import append_snapshots, follow_landed, stream_landed, stream_pages

CURSOR = "<b>Plan Price</b> Pro $20/mo Pro Plus $60/mo Ultra $200 / mo"


@pytest.fixture
def server():
    """Serves /ok..., fails at /bad, fails twice before /flaky; counts what is asked for."""
    asked = Counter()

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked[self.path] += 1
            if self.path == "/bad" or (self.path == "/flaky" and asked[self.path] < 3):
                self.send_error(500)
                return
            self.send_response(200)
            self.send_header("ETag", f"v{asked[self.path]}")
            self.end_headers()
            self.wfile.write({"/cursor": CURSOR.encode(), "/bytes": b"\xff\xfe<p>odd</p>"}.get(self.path, f"<p>{self.path} é</p>".encode()))

        def log_message(self, *_):
            pass

    found = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}", asked
    found.shutdown()


def test_pages_are_fetched_by_tasks_and_failures_are_rows(spark, server, tmp_path):
    at, asked = server
    pages = [Page("a", f"{at}/ok"), Page("b", f"{at}/bad"), Page("c", f"{at}/flaky"), Page("d", f"{at}/bytes"), Page("e", "nonsense:")]
    rows = fetched_pages(spark, pages, timeout=5, attempts=3, pause=0)
    assert rows.rdd.getNumPartitions() == len(pages)
    landed = land_pages(rows, str(tmp_path / "raw"), "r1")
    got = {r["source_id"]: r for r in landed.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "landed", "b": "failed", "c": "landed", "d": "landed", "e": "failed"}
    assert (got["a"]["etag"], got["a"]["http_status"], got["a"]["attempts"], got["c"]["attempts"]) == ("v1", 200, 1, 3)
    assert "500" in got["b"]["error"] and got["b"]["attempts"] == 3 and got["e"]["error"] and got["b"]["body"] is None
    assert {tuple(r) for r in page_bodies(landed).collect()} == {("a", "<p>/ok é</p>"), ("c", "<p>/flaky é</p>"), ("d", "��<p>odd</p>")}
    assert asked["/ok"] == 1  # landed once, read as often as one likes
    assert fetched_pages(spark, []).count() == 0


def browse(url, timeout, selector, settle_ms):
    from tariffgrid.sources.fetch import Fetched

    return Fetched(f"{url} {selector} {settle_ms}".encode(), 200, {})


def test_pages_made_by_scripts_take_a_named_function(spark):
    got = fetched_pages(spark, [Page("a", "http://x", "browser", "#p")], browse="tests.test_registry:browse").first()
    assert bytes(got["body"]) == b"http://x #p 1500" and got["kind"] == "browser"


def test_a_run_that_lands_again_replaces_its_own_rows(spark, tmp_path):
    root = str(tmp_path / "raw")
    row = lambda s, b: spark.createDataFrame([(s, "u", "static", "landed", b, 200, len(b), None, None, None, 1, "now")], landed_kind)
    from tariffgrid.sources.registry import FETCHED as landed_kind

    for run, body in (("r1", b"one"), ("r2", b"two"), ("r1", b"one again")):
        land_pages(row("a", body), root, run)
    assert {(r["run_id"], bytes(r["body"])) for r in landed_pages(spark, root).collect()} == {("r1", b"one again"), ("r2", b"two")}
    files = [p for p in (tmp_path / "raw").rglob("*.parquet")]
    assert len(files) == 2 and all(".gz." in p.name for p in files)


def test_stream_and_batch_over_runs_give_the_same_rows(spark, server, tmp_path):
    at, _ = server
    root, history = str(tmp_path / "raw"), History(spark, str(tmp_path / "history"))
    for run in ("r1", "r2"):
        land_pages(fetched_pages(spark, [Page("a", f"{at}/ok"), Page("b", f"{at}/{run}"), Page("x", f"{at}/bad")], attempts=1), root, run)
        follow_landed(stream_landed(spark, root), history, str(tmp_path / "checkpoint")).awaitTermination(120)
    rows = lambda df: {tuple(r) for r in df.select("run_id", "source_id", "checksum", "size", "etag").collect()}
    assert rows(history.read("source_snapshots")) == rows(page_versions(landed_pages(spark, root))) and history.read("source_snapshots").count() == 4


def test_stream_reads_what_landing_writes(spark, tmp_path):
    folder, history = tmp_path / "pages", History(spark, str(tmp_path / "history"))
    land(str(folder / "run_id=r1"), "one", "<p>é</p>".encode())
    (folder / "landing-report.json").write_text("[]")
    (folder / "two.md").write_text("| a |")
    (folder / "three.html.gz").write_bytes(gzip.compress(b"\xff three"))
    query = stream_pages(spark, str(folder)).writeStream.format("memory").queryName("landed_files").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["source_id"], r["body"]) for r in spark.table("landed_files").collect()}
    assert got == {tuple(r) for r in read_pages(spark, str(folder)).collect()} == {("one", "<p>é</p>"), ("two", "| a |"), ("three", "� three")}
    append_snapshots(stream_pages(spark, str(folder)), history, "run", str(tmp_path / "c2")).awaitTermination(120)
    assert {r["source_id"] for r in history.read("source_snapshots").collect()} == {"one", "two", "three"}


def test_keys_are_replaced_and_others_stay(spark, tmp_path):
    history = History(spark, str(tmp_path))
    for _ in range(2):  # a retry
        history.add("fx_snapshots", ("f1", "r1", "2026-01-01", "{}"))
        history.add("releases", ("a", "s1", "2026-01-01"), ("b", "s2", "2026-01-02"))
        history.add("run_events", ("r1", "running", "t0", ""))
    history.add("fx_snapshots", ("f2", "r2", "2026-01-02", "{}"))
    history.add("fx_snapshots", ("f1", "r1", "2026-01-01", '{"USD": 7}'))
    assert {(r["fx_id"], r["rates"]) for r in history.read("fx_snapshots").collect()} == {("f1", '{"USD": 7}'), ("f2", "{}")}
    assert sorted(r["status"] for r in history.releases().collect()) == ["published", "superseded"]
    assert history.read("run_events").count() == 2 and history.runs().count() == 1
    history.forget("fx_snapshots", "f1")
    assert [r["fx_id"] for r in history.read("fx_snapshots").collect()] == ["f2"]


OFFER = {"offer_id": "o", "provider_id": "p", "provider_name": "P", "model_id": "m", "model_name": "M", "currency": "USD", "market": "global", "access_channel": "c", "pricing_condition": "standard", "source_id": "s", "input_per_1m": 1.0}


def _offers(spark, *changes):
    from tariffgrid.schema import as_offers

    names = sorted({**OFFER, **{k: 0 for c in changes for k in c}})
    kind = ", ".join(f"{n} {'double' if n.endswith('1m') else 'string'}" for n in names)
    return as_offers(spark.createDataFrame([tuple((OFFER | c).get(n) for n in names) for c in changes], kind))


def test_the_job_that_writes_measures_the_gate(spark, tmp_path):
    from tariffgrid.schema import as_plans

    history, plans = History(spark, str(tmp_path)), as_plans(spark.createDataFrame([], "plan_id string"))
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    good = _offers(spark, {"offer_id": "a"}, {"offer_id": "b", "provider_id": "q"}).withColumn("model_id", F.udf(seen)("model_id"))
    gates = lambda **k: (quality.offer_gate(**k), quality.plan_gate(minimum=0))
    offers, _ = history.save_snapshot("s1", "r", "t", good, plans, gates(minimum=2))
    assert made.value == 2  # each row was made once, for counts, gate and snapshot together
    assert offers.count() == 2 and tuple(history.read("catalog_snapshots").first())[3:] == (2, 0, 2)
    for bad, limits, why in (
        (_offers(spark, {"offer_id": "a"}), {"minimum": 2}, "1 rows"),
        (_offers(spark, {"offer_id": "a"}, {"offer_id": "a"}, {"offer_id": "b", "currency": "x"}), {}, "repeated offer_id: a"),
        (_offers(spark, {"offer_id": "c", "input_per_1m": -1.0}, {"offer_id": "b", "currency": "usd"}), {}, "currency: b"),
        (_offers(spark, {"offer_id": "a"}), {"previous": 2}, "dropped from 2 to 1"),
    ):
        with pytest.raises(quality.GateError, match=why):
            history.save_snapshot("s2", "r", "t", bad, plans, gates(**limits))
        assert history.read("model_offers").where("snapshot_id = 's2'").count() == 0 and history.read("catalog_snapshots").count() == 1


def test_run_fetches_its_pages(spark, server, tmp_path, monkeypatch):
    from dataclasses import replace

    at, asked = server
    (only,) = (s for s in plan_pages.SOURCES if s.source_id == "cursor_plans")
    monkeypatch.setattr(plan_pages, "registry", lambda experimental=False: (replace(only, source_url=f"{at}/cursor"),))
    (tmp_path / "dir.json").write_text(json.dumps({"openai": {"models": {"m": {"name": "M", "cost": {"input": 1}}}}}))
    (tmp_path / "fx.json").write_text(json.dumps({"base": "USD", "date": "2026-01-05", "rates": {"CNY": 8}}))
    config = Config(data_dir=str(tmp_path / "data"), public_path=str(tmp_path / "public" / "catalog.json"), minimum_offers=1, minimum_plans=1)
    inputs = catalog.Inputs(str(tmp_path / "dir.json"), str(tmp_path / "fx.json"), fetch=True, fetching={"attempts": 1})
    metadata = spark.createDataFrame([], "provider_id string, name string, name_en string, region string, website string")
    first = catalog.run(spark, config, inputs, metadata, run_id="r1")
    assert first["sources"]["cursor_plans"] == {"status": "healthy", "count": 3} and asked["/cursor"] == 1
    assert len(json.loads((tmp_path / "public" / "catalog.json").read_text())["plans"]) == 3
    assert (tmp_path / "public" / "CURRENT").read_text().endswith(first["release_id"])
    monkeypatch.setattr(plan_pages, "registry", lambda experimental=False: (replace(only, source_url=f"{at}/bad"),))
    second = catalog.run(spark, config, inputs, metadata, run_id="r2")
    assert second["sources"]["cursor_plans"]["status"] == "stale" and "500" in second["sources"]["cursor_plans"]["error"]
    assert {r["run_id"] for r in landed_pages(spark, f"{config.data_dir}/raw/pages").collect()} == {"r1", "r2"}
    assert {(r["run_id"], r["etag"]) for r in History(spark, f"{config.data_dir}/history").read("source_snapshots").collect()} == {("r1", "v1")}
    with pytest.raises(ValueError):
        catalog.Inputs("d", "f", "pages", fetch=True)


def test_files_on_shared_storage(spark, tmp_path):
    files, at = shared.SharedFiles(spark), str(tmp_path / "deep" / "a.txt")
    files.replace(at, "eins é")
    files.replace(at, "zwei")
    assert files.read(at) == "zwei" and files.read(str(tmp_path / "none")) is None
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")] == ["a.txt"]
    with pytest.raises(FileExistsError):
        files.create(at, "drei")
    assert files.read(at) == "zwei"


def test_a_lock_is_held_released_and_taken_over(spark, tmp_path):
    files, at = shared.SharedFiles(spark), str(tmp_path / "lock")
    with shared.single_writer(files, at):
        with pytest.raises(RuntimeError, match="another run"), shared.single_writer(files, at):
            pass
        assert files.exists(at)
    assert not files.exists(at)
    with shared.single_writer(files, at, lease_s=-1), shared.single_writer(files, at):  # the first one's lease is over
        pass
    files.replace(at, "half")
    with pytest.raises(RuntimeError), shared.single_writer(files, at):
        pass


def test_command_line_fetches_everything(spark, server, tmp_path, monkeypatch, capsys):
    """`run` without files and pages: documents and registry pages come by address, and land under the run's id."""
    from dataclasses import replace

    from tariffgrid import cli
    from tariffgrid.sources import fetch

    at, asked = server
    (only,) = (s for s in plan_pages.SOURCES if s.source_id == "cursor_plans")
    monkeypatch.setattr(plan_pages, "registry", lambda experimental=False: (replace(only, source_url=f"{at}/cursor"),))
    documents = {"dir": {"openai": {"models": {"m": {"name": "M", "cost": {"input": 1}}}}}, "fx": {"base": "USD", "date": "2026-01-05", "rates": {"CNY": 8}}}
    served = lambda config, folder: fetch.land_documents(config, folder, lambda url, timeout: fetch.Fetched(json.dumps(documents[url]).encode(), 200, {}))
    monkeypatch.setattr(cli, "land_documents", served)
    for key, value in {"DATA_DIR": tmp_path / "data", "PUBLIC_PATH": tmp_path / "public" / "catalog.json", "DIRECTORY_URL": "dir", "FX_URL": "fx", "MINIMUM_OFFERS": 1, "MINIMUM_PLANS": 1}.items():
        monkeypatch.setenv(f"TARIFFGRID_{key}", str(value))
    assert cli.main(["run"]) == 0
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert told["status"] == "published" and told["sources"]["cursor_plans"]["count"] == 3 and asked["/cursor"] == 1
    landed = landed_pages(spark, str(tmp_path / "data" / "raw" / "pages"))
    assert [(r["run_id"], r["source_id"]) for r in landed.collect()] == [(told["run_id"], "cursor_plans")]
    assert (tmp_path / "data" / "raw" / "documents" / f"run_id={told['run_id']}" / "fx.json.gz").is_file()
    assert cli.main(["run", "--models-only", "--dry-run"]) == 0 and asked["/cursor"] == 1  # no pages are needed
    assert cli.main(["probe-plans"]) == 0 and asked["/cursor"] == 2
    probed = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert probed["status"] == "healthy" and probed["n_rows"] == 3
