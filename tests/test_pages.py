import random
import re

import pytest
from pyspark.sql import functions as F

from tariffgrid.operators.labels import anchor, label_places
from tariffgrid.plans import offer_pages, plan_pages
from tariffgrid.sources.html_tables import page_tables

AT = "2026-01-01T00:00:00+00:00"


def pages(spark, **bodies):
    return spark.createDataFrame(list(bodies.items()), "source_id string, body string")


def offers(spark, source, body):
    rows = offer_pages.page_offers(pages(spark, **{source: body}), AT).collect()
    return {r["offer_id"]: r for r in rows}


def plans(spark, source, body):
    found = next(s for s in plan_pages.SOURCES if s.source_id == source)
    return {r["plan_id"]: r for r in plan_pages.source_plans(pages(spark, **{source: body}), found, AT).collect()}


def test_table_rows_and_headings(spark):
    rows = page_tables(pages(spark, x="<h2>One <b>two</b></h2><table><tr><th>a</th><td>b &amp; c</td></tr><tr><td>d</table>")).orderBy("pos").collect()
    assert [(r["kind"], r["heading"], r["cells"]) for r in rows] == [("heading", "One two", None), ("row", None, ["a", "b & c"]), ("row", None, ["d"])]


def test_matrix_of_peak_and_off_peak_prices(spark):
    body = """<table><tr><th>模型</th><th>deepseek-alpha</th><th>deepseek-beta</th></tr>
    <tr><td>百万tokens输入（缓存命中）</td><td>空闲时段</td><td>0.1 元</td><td>0.2 元</td></tr><tr><td>高峰时段</td><td>0.3 元</td><td>0.4 元</td></tr>
    <tr><td>百万tokens输入（缓存未命中）</td><td>空闲时段</td><td>1 元</td><td>2 元</td></tr><tr><td>高峰时段</td><td>3 元</td><td>4 元</td></tr>
    <tr><td>百万tokens输出</td><td>空闲时段</td><td>5 元</td><td>6 元</td></tr><tr><td>高峰时段</td><td>7 元</td><td>8 元</td></tr></table>"""
    got = offers(spark, "deepseek_official_pricing", body)
    assert len(got) == 4
    row = got["deepseek/deepseek-beta/cn_mainland/official_api/standard/peak"]
    assert (row["cache_read_per_1m"], row["input_per_1m"], row["output_per_1m"], row["context_window"], row["currency"]) == (0.4, 4.0, 8.0, 1_000_000, "CNY")


def test_market_tables_keep_the_last_of_a_repeated_offer(spark):
    head = "<tr><th>模型</th><th>模式</th><th>范围</th><th>输入单价</th><th>输出单价</th></tr>"
    row = lambda m, r, a, b: f"<tr><td>{m}</td><td>x</td><td>{r}</td><td>{a} 元</td><td>{b} 元</td></tr>"
    body = f"<h3>新加坡</h3><h4>note</h4><table>{head}{row('qwen-a', '0&lt;Token≤32K', 1, 2)}{row('qwen-a', '无阶梯计价', 3, 4)}{row('qwen-a', '无阶梯计价', 5, 6)}</table><h3>日本（东京）</h3><table>{head}{row('qwen-a', '无阶梯计价', 7, 8)}</table>"
    got = offers(spark, "qwen_model_studio", body)
    assert {k.removeprefix("qwen/qwen-a/"): (r["input_per_1m"], r["output_per_1m"], r["market"]) for k, r in got.items()} == {
        "sg_international/official_api/standard/input_lte_32k": (1.0, 2.0, "sg_international"),
        "sg_international/official_api/standard/standard": (5.0, 6.0, "sg_international"),
        "jp_tokyo/official_api/standard/standard": (7.0, 8.0, "jp_tokyo"),
    }


def test_literal_rows(spark):
    body = 'x <DocTable rows={[["Kimi-Z", "1M tokens", "¥1.1", "¥6.5", "¥27.00", "262,144 tokens"], ["Kimi-Q", "image", "¥1", "¥2", "¥3", "1 tokens"],]} />'
    (row,) = offers(spark, "kimi_official_k26", body).values()
    assert (row["model_id"], row["cache_read_per_1m"], row["input_per_1m"], row["output_per_1m"], row["context_window"]) == ("kimi-z", 1.1, 6.5, 27.0, 262144)


def test_markdown_with_free_row_and_another_table(spark):
    body = "| Model | Input | Cached Input | Cached Input Storage | Output |\n|--|--|--|--|--|\n| GLM-A | \\$0.6 | \\$0.11 | - | \\$2.2 |\n| GLM-F | Free | Free | - | Free |\n\n| Tool | Price |\n|--|--|\n| search | \\$1 |\n"
    got = offers(spark, "zai_global_official_pricing", body)
    assert {r["model_name"]: (r["input_per_1m"], r["cache_read_per_1m"], r["output_per_1m"]) for r in got.values()} == {"GLM-A": (0.6, 0.11, 2.2), "GLM-F": (0.0, 0.0, 0.0)}


def test_markdown_synonyms_tiers_and_struck_prices(spark):
    cn = "| 模型 | 输入价格 元/百万 Tokens | 输出价格 元/百万 Tokens | 缓存读取 元/百万 Tokens |\n|--|--|--|--|\n| MiniMax-A1 (≤512k) | 2.1 | 8.4 | 0.21 |\n"
    (row,) = offers(spark, "minimax_cn_official_pricing", cn).values()
    assert (row["offer_id"], row["input_per_1m"], row["cache_read_per_1m"]) == ("minimax-cn/minimax-a1/cn_mainland/official_anthropic_api/standard/input_lte_512k", 2.1, 0.21)
    world = '<Tab title="Priority">\n| Model | Input | Output |\n|--|--|--|\n| **MiniMax-B** | ~~\\$0.9~~ \\$0.8 | \\$3 |\n</Tabs>\n| Model | Input | Output |\n|--|--|--|\n| MiniMax-B | $0.4 | $1.5 |\n'
    got = offers(spark, "minimax_global_official_pricing", world)
    assert {(r["service_tier"], r["input_per_1m"], r["currency"]) for r in got.values()} == {("priority", 0.8, "USD"), ("standard", 0.4, "USD")}


def test_heading_windows(spark):
    got = plans(spark, "anthropic_plans", "<p>Plan Price Billing Interval</p><p>Pro</p><p>$18 per month</p><p>Max 5x</p><p>$90 per month</p><p>Max 20x</p><p>$180/month</p>")
    assert [got[f"anthropic/claude/{s}"]["price_amount"] for s in ("pro", "max-5x", "max-20x")] == [18.0, 90.0, 180.0]
    assert got["anthropic/claude/pro"]["featured_on_home"] and got["anthropic/claude/pro"]["source_id"] == "anthropic_plans"


def test_lookahead_tells_pro_from_pro_plus(spark):
    got = plans(spark, "cursor_plans", "<b>Plan Price</b> Pro $21/mo Pro Plus $61/mo Ultra $201 / mo")
    assert [got[f"cursor/cursor/{s}"]["price_amount"] for s in ("pro", "pro-plus", "ultra")] == [21.0, 61.0, 201.0]


def test_free_teams_and_sentence_prices(spark):
    assert plans(spark, "cursor_hobby_plan", "Hobby is always Free")["cursor/cursor/hobby"]["price_amount"] == 0.0
    got = plans(spark, "cursor_teams_plan", "Standard ($41/user/mo) and Premium ( $121 / user / mo )")
    assert sorted(r["price_amount"] for r in got.values()) == [41.0, 121.0]
    got = plans(spark, "github_copilot_organization_plans", "Copilot Business at $18 USD per user per month, Copilot Enterprise at $38 USD per user per month")
    assert sorted(r["price_amount"] for r in got.values()) == [18.0, 38.0]


def test_first_priced_occurrence_in_the_page_currency(spark):
    body = "Google AI Plus is nice. Google AI Pro too. Google AI Plus $6.98 SGD / mo Google AI Pro From $27.98 SGD / mo Google AI Ultra $358 SGD/mo"
    got = plans(spark, "google_ai_plans", body)
    assert {(r["product_name"], r["price_amount"], r["currency"]) for r in got.values()} == {("Google AI Plus", 6.98, "SGD"), ("Google AI Pro", 27.98, "SGD"), ("Google AI Ultra", 358.0, "SGD")}


def test_quota_and_free_tier(spark):
    body = "KIRO FREE 40 credits KIRO PRO $19 per month 1,100 credits KIRO PRO+ $39 per month 2,200 credits KIRO PRO MAX $99/mo 5,000 credits KIRO POWER $199 per month 11,000 credits"
    got = plans(spark, "kiro_plans", body)
    assert [(got[f"kiro/kiro/{s}"]["price_amount"], got[f"kiro/kiro/{s}"]["included_quota"]) for s in ("free", "power")] == [(0.0, 40.0), (199.0, 11000.0)]


def test_two_layouts_of_one_page(spark):
    faq = '<script>{"id":"available-plans","a":"| Plus | ¥48 /月 | Max | ¥98/月 | Ultra | ¥198 /月 |"}</script>'
    table = "<p>哪个计划更适合你 Plus ¥48 /月 Max ¥98 /月 Ultra ¥198/月 积分购买</p>"
    for body in (faq, table):
        assert sorted(r["price_amount"] for r in plans(spark, "minimax_plans", body).values()) == [48.0, 98.0, 198.0]


def test_split_decimals_largest_amount_and_specs(spark):
    got = plans(spark, "qwen_token_plans", "Lite版本 ¥ 39 . 90 /1个月 Standard版本 ¥ 99 /1 个月 Pro版本 ¥ 199 .00 /1个月")
    assert sorted(r["price_amount"] for r in got.values()) == [39.9, 99.0, 199.0]
    got = plans(spark, "zhipu_plans", "Lite ¥ 16 /月 ¥ 22 /月 Pro ¥ 80 /月 ¥ 101/月 Max ¥ 160 /月 ¥ 202 /月")
    assert sorted(r["price_amount"] for r in got.values()) == [22.0, 101.0, 202.0]
    got = plans(spark, "xiaomi_plans", "MiMo Token Plan Pro ¥ 99 /月 MiMo Token Plan Lite ¥ 19/月 MiMo Token Plan Standard nothing MiMo Token Plan Max ¥ 299 /月")
    assert {r["product_name"].split()[-1]: r["price_amount"] for r in got.values()} == {"Pro": 99.0, "Lite": 19.0, "Standard": None, "Max": 299.0}


@pytest.mark.parametrize(("body", "n"), [("Pro 5x is $100 and Pro 20x is $200 a month", 2), ("Pro 5x is $100", 0)])
def test_markers_guard_fixed_tiers(spark, body, n):
    assert len(plans(spark, "openai_chatgpt_pro", body)) == n


def test_business_seats(spark):
    got = plans(spark, "openai_chatgpt_business", "Business is $25 monthly or $20 annually with at least 2 seats. Codex uses credits. Enterprise: contact us.")
    assert {k.split("/")[-1]: (r["price_amount"], r["monthly_equivalent"], r["price_status"], r["minimum_seats"]) for k, r in got.items()} == {
        "business-monthly": (25.0, 25.0, "priced", 2), "business-annual": (240.0, 20.0, "priced", 2),
        "business-codex-seat": (None, None, "usage_based", None), "enterprise": (None, None, "contact_sales", None),
    }


def test_spec_windows_follow_the_page(spark):
    page = spark.createDataFrame([("p", "B $2 and A $1")], "source_id string, text string")
    specs = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "slug string, label string")
    assert {r["slug"]: r["window"] for r in plan_pages.spec_windows(page, specs).collect()} == {"b": "B $2 and ", "a": "A $1"}


def test_many_labels_are_found_as_by_their_patterns(spark):
    rng = random.Random(4)
    plain = ["Pro", "Pro Plus", "Plus", "通义", "a.b", "o P", "Max 20x", "MAX", "x"]
    patterns = [r"Pro\s+Plus", r"Max\s*\d+x", r"(?i)pro", r"Ultra|Max", r"[A-Z]{3}", r"\d+", r"P(ro)?", r"us$", r"\$ ?\d+", r"no (such )?label"]
    texts = [None, ""] + ["".join(rng.choice([*plain, " ", " ", "$12", "Max 5x", "z"]) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(texts)), "source_id int, text string").withColumn("source_id", F.col("source_id").cast("string"))
    labels = [re.escape(x) if x == "a.b" else x for x in plain] + patterns + ["Pro"]
    specs = spark.createDataFrame([(f"s{k}", x) for k, x in enumerate(labels)], "slug string, label string")
    want = pages.crossJoin(specs).withColumn("at", F.regexp_instr("text", F.col("label"))).where("at > 0")
    for a_pass in (50_000, 4):
        got = label_places(pages, specs, a_pass)
        assert {tuple(r) for r in got.select("source_id", "slug", "at").collect()} == {tuple(r) for r in want.select("source_id", "slug", "at").collect()}
    assert label_places(pages, specs.limit(0)).count() == 0
    assert label_places(spark.createDataFrame([("a", "🙂 Pro")], "source_id string, text string"), specs.where("slug = 's0'")).first()["at"] == 3  # characters, as substr counts them


def test_anchors():
    assert anchor("Pro Plus") == ("Pro Plus", True) and anchor(r"Pro\s+Plus") == ("Plus", False) and anchor("(?i)pro") is None and anchor("a|b") is None and anchor("(") is None


def test_registry_is_disjoint():
    verified, every = plan_pages.registry(), plan_pages.registry(True)
    assert len(verified) == 12 and sum(s.minimum for s in verified) == 33
    assert len({s.source_id for s in every}) == len(every) == 17
