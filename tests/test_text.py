import pytest
from pyspark.sql import functions as F

from tariffgrid.functions import amounts as A
from tariffgrid.functions import pricing as P
from tariffgrid.functions import text as X


def one(spark, column, *values):
    """The column over a row whose columns a, b, … are the values."""
    names = "abcdef"[: len(values)]
    df = spark.createDataFrame([values], ", ".join(f"{n} {kind}" for n, kind in zip(names, ("double" if isinstance(v, float) else "bigint" if isinstance(v, int) else "array<string>" if isinstance(v, list) else "string" for v in values))))
    return df.select(column.alias("x")).first()["x"]


def test_visible_text_drops_hidden_parts_and_tags(spark):
    page = "<html><style>a{}</style><body><p>Plan&nbsp;A <b>&yen;9</b></p><!-- <p>no</p> --><script>x='<p>'</script><p> B\n &amp; C</p>"
    assert one(spark, X.visible_text(F.col("a")), page) == "Plan A ¥9 B & C"


@pytest.mark.parametrize("text", ["&#36;20 &#x24;5 &#X1F600; &#39;", "no reference & none", "&#;&#x;&#99999999; &#0 &#xD800;", "&#165;9&#48", "&amp;#36;", "&#150;&#8211;", ""])
def test_numeric_references(spark, text):
    import html
    import re

    want = re.sub(r"&#(x[0-9a-f]{1,6}|[0-9]{1,7});?", lambda m: html.unescape(m[0]) if 0 < (n := int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])) < 0x110000 and not 0xD800 <= n < 0xE000 else m[0], text, flags=re.I)
    assert one(spark, X.numeric_references(F.col("a")), text) == want


def test_visible_text_decodes_references_once(spark):
    assert one(spark, X.visible_text(F.col("a")), "<p>&#36;20 &#8211; &amp;#36; &#60;b&#62;</p>") == "$20 – &#36; <b>"


@pytest.mark.parametrize(("text", "price"), [
    ("Pro $20 per month", 20.0), ("US$ 19.5/mo", 19.5), ("每月 30 美元", 30.0), ("12 USD / 月", 12.0), ("monthly price: $7", 7.0), ("$8 a month", 8.0), ("$39 USD per user per month", 39.0), ("soon", None),
])
def test_monthly_usd(spark, text, price):
    assert one(spark, A.monthly_price(F.col("a"), F.lit("USD"), F.lit(False)), text) == price


def test_monthly_cny_free_and_unknown_currency(spark):
    assert one(spark, A.monthly_price(F.col("a"), F.lit("CNY"), F.lit(False)), "¥ 49 /月") == 49.0
    assert one(spark, A.monthly_price(F.col("a"), F.lit("CNY"), F.lit(True)), "anything") == 0.0
    with pytest.raises(Exception, match="no price patterns"):
        one(spark, A.monthly_price(F.col("a"), F.lit("GBP"), F.lit(False)), "£5")


def test_mentions_of_a_text(spark):
    text = "Was US$1,200 in all, now $99.5 per seat per month or 每月 ¥ 680; S$7/mo, 12 元, 5x as much, monthly: 3 USD"
    got = [tuple(m) for m in one(spark, A.mentions(F.col("a")), text)]
    assert got == [(1200.0, "USD", False), (99.5, "USD", True), (680.0, "CNY", True), (7.0, "SGD", True), (12.0, "CNY", False), (5.0, None, False), (3.0, "USD", True)]
    assert one(spark, A.amounts(F.col("a"), "CNY"), text) == [680.0, 12.0] and one(spark, A.amounts(F.col("a"), "USD", monthly=True), text) == [99.5, 3.0]
    assert one(spark, A.labelled(F.col("a"), ("Pro", "Pro X")), "Pro Plus $3/mo, Pro X at $4 / mo") == "Pro X at $4 / mo"
    assert one(spark, A.counted(F.col("a"), "credit"), "has 12,500 credits") == 12500.0 and one(spark, A.mentions(F.col("a")), "") == []
    assert one(spark, A.cell_words(F.col("a"), "qwen"), "new Qwen-Max.2 (beta)") == "qwen-max.2"


def test_product_window_stops_at_the_next_heading_or_the_width(spark):
    text = "intro PRO one $1 MAX two $2"
    assert one(spark, X.product_window(F.col("a"), "pro", ("max",)), text) == "PRO one $1 "
    assert one(spark, X.product_window(F.col("a"), "pro", ("none",), 7), text) == "PRO one"
    assert one(spark, X.product_window(F.col("a"), "ultra", ()), text) == ""


def test_windows_need_their_markers(spark):
    assert one(spark, X.window_between(F.col("a"), "<", ">"), "a<b>c") == "<b"
    assert one(spark, X.window_between(F.col("a"), "<", ">"), "a>b<c") is None
    assert one(spark, X.window_after(F.col("a"), "b", 2), "abcd") == "bc"


def test_markdown_cells(spark):
    assert one(spark, X.markdown_cells(F.col("a")), "  | x | y  z || ") == ["x", "y  z"]
    assert one(spark, X.markdown_cells(F.col("a")), "no table") == []
    assert one(spark, X.is_separator(X.markdown_cells(F.col("a"))), "|:--|---:|") is True
    assert one(spark, X.has_columns(F.col("a"), "model", "input"), ["Model", "Unit", "INPUT"]) is True


def test_cell_prices(spark):
    assert one(spark, A.last_amount(F.col("a"), X.plain_cell(F.col("a"))), "~~¥4~~ ¥3.5") == 3.5
    assert one(spark, A.last_amount(F.col("a"), X.plain_cell(F.col("a"))), " **2.1** ") == 2.1
    assert one(spark, A.last_amount(F.col("a"), X.plain_cell(F.col("a"))), "128K context") is None
    assert one(spark, A.free_or_amount(F.col("a")), "Free") == 0.0
    assert one(spark, A.free_or_amount(F.col("a")), "\\$0.6") == 0.6


def test_brackets(spark):
    assert one(spark, X.token_bracket(F.col("a")), ["qwen-x", "0<Token≤32K"]) == "input_lte_32k"
    assert one(spark, X.token_bracket(F.col("a")), ["qwen-x", "无阶梯计价"]) == "standard"
    assert one(spark, X.half_million_bracket(F.col("a")), "M3 (> 512K)") == "input_gt_512k"


def test_json_rows_and_regional_price(spark):
    assert one(spark, X.json_rows(F.col("a")), '<T rows={[["m", "1M tokens"],]} />') == [["m", "1M tokens"]]
    assert one(spark, X.json_rows(F.col("a")), "nothing") is None
    assert one(spark, A.regional_price(F.col("a")), "From $ 9.90 SGD / mo, $7 /mo").asDict() == {"price": 9.9, "currency": "SGD"}


def test_numbers(spark):
    for text, value in (("12.5", 12.5), ("", None), ("1d", None), ("nan", None), (" 3 ", 3.0), ("1e3", 1000.0)):
        assert one(spark, P.number(F.col("a")), text) == value
    assert one(spark, P.integer(F.col("a")), "-2.9") == -2
    assert one(spark, P.positive(F.col("a")), "0") is None


def test_canonical_json_and_checksum(spark):
    assert one(spark, P.canonical_json(F.col("a")), '{"b": 1, "a": null}') == '{"a":null,"b":1}'
    assert one(spark, P.canonical_json(F.col("a")), "no json") is None


def test_formats(spark):
    assert [one(spark, P.format_context(F.col("a")), n) for n in (2_000_000, 1_500_000, 128_000, 999)] == ["2M", "1.5M", "128K", "999"]
    assert one(spark, P.format_price(F.col("a"), F.lit("USD")), 1234.5) == "$1,234.5"
    assert one(spark, P.format_price(F.col("a"), F.lit("USD")), 0.0375) == "$0.0375"
    assert one(spark, P.format_plan_price(F.col("a"), F.lit("CNY")), 0.0) == "免费"
    assert one(spark, P.format_plan_price(F.col("a"), F.lit("CNY")), 199.04) == "¥199"
    assert one(spark, P.format_reference(F.col("a")), 12.0) == "≈ ¥12"
    assert one(spark, P.condition_label(F.col("a")), "input_lte_32k") == "输入 ≤ 32K"
    assert one(spark, P.market_label(F.col("a")), "elsewhere") == "elsewhere"
    assert one(spark, P.note_text(F.col("a")), '{"text": "hi"}') == "hi"
    assert one(spark, P.note_text(F.col("a")), "plain") == "plain"
    assert one(spark, P.format_quota(F.col("a"), F.lit("credits"), F.lit("monthly")), 1000.0) == "1,000 credits / monthly"


def test_missing_price_is_no_zero(spark):
    compared = P.compare_price(F.lit(None).cast("double"), F.lit("CNY"), F.lit(None).cast("double"))
    assert one(spark, compared, "x") is None
    assert one(spark, P.is_lowest(F.col("a"), F.lit(1.0)), 1.0 + 1e-12) is True
    assert one(spark, P.source_status(F.lit(None).cast("boolean"), F.lit(None).cast("string")), "x") == "healthy"
