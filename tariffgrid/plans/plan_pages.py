"""Subscription plans from vendors' pages, extracted by rules that are data.

A rule names its page, the part of the page to look at, the window of text of each
product in it, and how a price is read from a window. All rules together are one
projection over the pages: every page is read, and its visible text made, once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffgrid.functions import amounts as A
from tariffgrid.functions import text as X
from tariffgrid.operators.labels import label_places
from tariffgrid.operators.selection import with_width
from tariffgrid.schema import as_plans

GENERAL, TOOL, API = "general_ai", "coding_tool", "developer_api"
SUBSCRIPTION, CODING = "subscription", "coding_plan"


@dataclass(frozen=True)
class Product:
    slug: str
    name: str
    #: Heading that the product's window starts at, or the ways to write it.
    label: str | tuple[str, ...] = ""
    free: bool = False
    featured: bool = False
    #: Columns that the page doesn't tell in numbers.
    fixed: dict = field(default_factory=dict)

    @property
    def labels(self) -> tuple[str, ...]:
        return (self.label,) if isinstance(self.label, str) else self.label


@dataclass(frozen=True)
class PlanSource:
    source_id: str
    source_url: str
    provider: tuple[str, str]
    family: str
    category: str
    billing: str
    currency: str
    kind: str
    products: tuple[Product, ...]
    #: (sources' text, rule, product) -> window of text, empty or null if there is none
    window: Callable[[PlanSource, int], Column]
    #: (rule, product, window) -> struct(price, currency) or price
    price: Callable[[PlanSource, Product, Column], Column]
    purchase_url: str = ""
    verified: bool = True
    quota: bool = False

    @property
    def minimum(self) -> int:
        return len(self.products)


def TEXT() -> Column:  # noqa: N802
    """The page's visible text."""
    return F.col("text")


def BODY() -> Column:  # noqa: N802
    return F.col("body")


def _heading_windows(width: int = 900, start: str | None = None, end: str | None = None):
    """From a product's heading to the next product's, inside a part of the page."""

    def of(source: PlanSource, k: int) -> Column:
        part = TEXT()
        if start and end:
            part = X.window_between(part, start, end)
        elif start:
            at = X.position(part, start)
            part = F.when(at > 0, F.substr(part, at))
        return X.product_window(part, source.products[k].label, tuple(p.label for p in source.products[k + 1 :]), width)

    return of


def _name_windows(width: int = 700, joined_decimals: bool = False):
    """From a product's first name to the next product's in the order of the page, or the width."""

    def of(source: PlanSource, k: int) -> Column:
        text = F.regexp_replace(TEXT(), r"(\d)\s*\.\s*(\d)", "$1.$2") if joined_decimals else TEXT()
        places = [F.nullif(F.regexp_instr(text, F.lit(f"(?iu){A.spelled(p.labels)}")), F.lit(0)) for p in source.products]
        later = F.array_min(F.filter(F.array(*places), lambda x: x > places[k]))
        stop = F.least(places[k] + width, F.coalesce(later, F.length(text) + 1))
        return F.when(places[k].isNotNull(), F.substr(text, places[k], stop - places[k]))

    return of


def _labelled(*parts: Callable[[], Column]):
    """A product's name with the price right after it, in the first part of the page that shows one."""
    return lambda source, k: F.coalesce(*(A.labelled(part(), source.products[k].labels) for part in parts))


def _from_marker(*markers: str, width: int = 900) -> Column:
    """From the first of the markers that the text holds, so many characters; null without any."""
    found = [F.nullif(X.position(TEXT(), m), F.lit(0)) for m in markers]
    return F.substr(TEXT(), F.least(*found), F.lit(width))


def _cursor_table() -> Column:
    return F.coalesce(_from_marker("Plan Price", "方案 价格"), X.window_between(TEXT(), "Start (India only)", "Since different models"))


def _minimax_faq() -> Column:
    return X.window_after(BODY(), '"id":"available-plans"', 2400)


def _minimax_table() -> Column:
    return X.window_between(TEXT(), "哪个计划更适合你", "积分购买")


def _priced_occurrence(source: PlanSource, k: int) -> Column:
    """The first part of the text, cut at every heading, that is this product's and shows a price."""
    cuts = F.split(TEXT(), "(?iu)(?=" + A.spelled(n for p in source.products for n in p.labels) + ")")
    own = F.filter(cuts, lambda w: F.lower(w).startswith(source.products[k].labels[0].lower()))
    return F.get(F.filter(F.transform(own, lambda w: F.substr(w, F.lit(1), F.lit(1200))), lambda w: A.regional_price(w).isNotNull()), F.lit(0))


def _followed_by(word: str, width: int = 130):
    """What follows a product's name, if the word is in it."""

    def of(source: PlanSource, k: int) -> Column:
        near = X.window_after(TEXT(), source.products[k].labels[0], width)
        return F.when(near.rlike(f"(?iu){A.spelled((word,))}"), near)

    return of


def _guarded(dollars: tuple[float, ...], words: tuple[str, ...], seats: int | None = None):
    """The whole text, if it shows all of the dollar amounts and words, and tells of so many seats."""

    def of(source: PlanSource, k: int) -> Column:
        shown = A.amounts(TEXT(), "USD")
        ok = F.lit(True)
        for a in dollars:
            ok = ok & F.array_contains(shown, F.lit(a))
        for w in words:
            ok = ok & F.lower(TEXT()).contains(w)
        if seats is not None:  # such as `2 seats`, `two or more users`, `2+ members`
            number = "(?:" + "|".join((str(seats), *_NUMBERS.get(seats, ()))) + ")"
            ok = ok & TEXT().rlike(rf"(?iu)(?<![\w.]){number}\+?\s+(?:[a-z]+\s+){{0,2}}{A.spelled(_SEATS)}")
        return F.when(ok, TEXT())

    return of


_NUMBERS = {1: ("one",), 2: ("two",), 3: ("three",)}
_SEATS = ("seat", "seats", "user", "users", "member", "members")


def _monthly(source: PlanSource, product: Product, window: Column) -> Column:
    return A.monthly_price(window, F.lit(source.currency), F.lit(product.free))


def _largest(source: PlanSource, product: Product, window: Column) -> Column:
    """Where a reduced price stands beside the standard one, the standard one."""
    return F.array_max(A.amounts(window, source.currency, monthly=True))


def _told(source: PlanSource, product: Product, window: Column) -> Column:
    return F.lit(product.fixed.get("price_amount")).cast("double")


_SEAT = {"price_scope": "per_user", "seat_type": "standard_seat", "minimum_seats": 2}

#: Pages, products, labels and markers of the vendors' plans.
SOURCES = (
    PlanSource("anthropic_plans", "https://support.claude.com/en/articles/11049762-choosing-a-claude-plan", ("anthropic", "Anthropic"), "claude", GENERAL, SUBSCRIPTION, "USD", "html",
               (Product("pro", "Claude Pro", "Pro", featured=True), Product("max-5x", "Claude Max 5x", "Max 5x"), Product("max-20x", "Claude Max 20x", "Max 20x")),
               _heading_windows(start="Plan Price Billing Interval"), _monthly),
    PlanSource("cursor_plans", "https://cursor.com/docs/models-and-pricing", ("cursor", "Cursor"), "cursor", TOOL, SUBSCRIPTION, "USD", "html",
               (Product("pro", "Cursor Pro", "Pro", featured=True), Product("pro-plus", "Cursor Pro+", ("Pro Plus", "Pro+", "Pro +")), Product("ultra", "Cursor Ultra", "Ultra")),
               _labelled(_cursor_table), _monthly, "https://cursor.com/pricing"),
    PlanSource("cursor_teams_plan", "https://cursor.com/docs/models-and-pricing", ("cursor", "Cursor"), "cursor", TOOL, SUBSCRIPTION, "USD", "html",
               (Product("teams-standard", "Cursor Teams Standard", "Standard"), Product("teams-premium", "Cursor Teams Premium", "Premium")),
               _labelled(TEXT), _monthly, "https://cursor.com/pricing"),
    PlanSource("github_copilot_plans", "https://github.com/features/copilot/plans", ("githubcopilot", "GitHub Copilot"), "copilot", TOOL, SUBSCRIPTION, "USD", "html",
               (Product("free", "Copilot Free", "Free", free=True), Product("pro", "Copilot Pro", "Pro"), Product("pro-plus", "Copilot Pro+", "Pro+"), Product("max", "Copilot Max", "Max")),
               _heading_windows(start="Pricing plans For individuals", end="GitHub Copilot is available"), _monthly),
    PlanSource("github_copilot_organization_plans", "https://docs.github.com/en/enterprise-cloud@latest/copilot/concepts/billing/organizations-and-enterprises", ("githubcopilot", "GitHub Copilot"), "copilot", TOOL, SUBSCRIPTION, "USD", "html",
               (Product("business", "Copilot Business", "Copilot Business"), Product("enterprise", "Copilot Enterprise", "Copilot Enterprise")),
               _labelled(TEXT), _monthly),
    PlanSource("google_ai_plans", "https://one.google.com/about/google-ai-plans/?hl=en-US", ("google", "Google"), "google-ai", GENERAL, SUBSCRIPTION, "", "browser",
               (Product("plus", "Google AI Plus", "Google AI Plus"), Product("pro", "Google AI Pro", "Google AI Pro"), Product("ultra", "Google AI Ultra", "Google AI Ultra")),
               _priced_occurrence, lambda s, p, w: A.regional_price(w)),
    PlanSource("kiro_plans", "https://kiro.dev/pricing/", ("kiro", "Kiro"), "kiro", TOOL, SUBSCRIPTION, "USD", "html",
               (Product("free", "Kiro Free", "KIRO FREE", free=True), Product("pro", "Kiro Pro", "KIRO PRO"), Product("pro-plus", "Kiro Pro+", "KIRO PRO+"), Product("pro-max", "Kiro Pro Max", "KIRO PRO MAX"), Product("power", "Kiro Power", "KIRO POWER")),
               _heading_windows(width=500), _monthly, quota=True),
    PlanSource("minimax_plans", "https://platform.minimaxi.com/subscribe/token-plan", ("minimax", "MiniMax"), "token-plan", API, CODING, "CNY", "static",
               (Product("plus", "MiniMax Token Plan Plus", "Plus"), Product("max", "MiniMax Token Plan Max", "Max"), Product("ultra", "MiniMax Token Plan Ultra", "Ultra")),
               _labelled(_minimax_faq, _minimax_table), _monthly),
    PlanSource("openai_chatgpt_plus", "https://help.openai.com/en/articles/6950777-what-is-chatgpt-plus", ("openai", "OpenAI"), "chatgpt", GENERAL, SUBSCRIPTION, "USD", "browser",
               (Product("plus", "ChatGPT Plus", ("ChatGPT Plus", "Plus"), featured=True),), _name_windows(), _monthly),
    PlanSource("opencode_plans", "https://opencode.ai/docs/zh-cn/go/", ("opencode", "OpenCode"), "go", TOOL, CODING, "USD", "browser",
               (Product("monthly", "OpenCode Go", "OpenCode Go"),), _name_windows(), _monthly, "https://opencode.ai/auth"),
    PlanSource("qwen_token_plans", "https://www.aliyun.com/benefit/scene/tokenplan", ("qwen", "阿里通义"), "token-plan", API, CODING, "CNY", "browser",
               (Product("lite", "百炼 Token Plan Lite", "Lite版本"), Product("standard", "百炼 Token Plan Standard", "Standard版本"), Product("pro", "百炼 Token Plan Pro", "Pro版本")),
               _name_windows(850, joined_decimals=True), _monthly),
    PlanSource("zhipu_plans", "https://www.bigmodel.cn/glm-coding", ("zhipu", "智谱"), "coding-plan", TOOL, CODING, "CNY", "browser",
               (Product("lite", "GLM Coding Plan Lite", "Lite"), Product("pro", "GLM Coding Plan Pro", "Pro", featured=True), Product("max", "GLM Coding Plan Max", "Max")),
               _name_windows(650), _largest),
    PlanSource("openai_chatgpt_pro", "https://help.openai.com/en/articles/9793128", ("openai", "OpenAI"), "chatgpt", GENERAL, SUBSCRIPTION, "USD", "browser",
               (Product("pro-5x", "ChatGPT Pro 5x", fixed={"price_amount": 100.0}), Product("pro-20x", "ChatGPT Pro 20x", fixed={"price_amount": 200.0})),
               _guarded((100.0, 200.0), ("5x", "20x")), _told, verified=False),
    PlanSource("openai_chatgpt_business", "https://help.openai.com/en/articles/8792536", ("openai", "OpenAI"), "chatgpt", GENERAL, SUBSCRIPTION, "USD", "browser",
               (Product("business-monthly", "ChatGPT Business（月付）", fixed={"price_amount": 25.0} | _SEAT),
                Product("business-annual", "ChatGPT Business（年付）", fixed={"price_amount": 240.0, "monthly_equivalent": 20.0, "billing_cadence": "annual"} | _SEAT),
                Product("business-codex-seat", "ChatGPT Business Codex Seat", fixed={"price_status": "usage_based", "price_scope": "usage_based", "seat_type": "codex_seat"}),
                Product("enterprise", "ChatGPT Enterprise", fixed={"price_status": "contact_sales", "price_scope": "per_seat", "seat_type": "enterprise_seat"})),
               _guarded((20.0, 25.0), ("codex", "credit", "enterprise"), seats=2), _told, verified=False),
    PlanSource("cursor_hobby_plan", "https://cursor.com/pricing", ("cursor", "Cursor"), "cursor", TOOL, SUBSCRIPTION, "USD", "html",
               (Product("hobby", "Cursor Hobby", "Hobby", free=True),), _followed_by("Free"), _monthly, verified=False),
    PlanSource("moonshot_plans", "https://www.kimi.com/membership/pricing", ("moonshot", "Kimi"), "membership", GENERAL, SUBSCRIPTION, "CNY", "browser",
               tuple(Product(n.lower(), f"Kimi 会员 {n}", (f"会员 {n}", f"会员{n}")) for n in ("Andante", "Moderato", "Allegretto", "Allegro")), _name_windows(), _monthly, verified=False),
    PlanSource("xiaomi_plans", "https://platform.xiaomimimo.com/", ("xiaomi", "小米"), "token-plan", API, CODING, "CNY", "browser",
               tuple(Product(n.lower(), f"MiMo Token Plan {n}", f"MiMo Token Plan {n}") for n in ("Lite", "Standard", "Pro", "Max")), _name_windows(), _monthly, verified=False),
)


def registry(experimental: bool = False) -> tuple[PlanSource, ...]:
    """The verified sources, and with them the experimental ones if asked for."""
    return tuple(s for s in SOURCES if s.verified or experimental)


def source_plans(pages: DataFrame, source: PlanSource, fetched_at: str) -> DataFrame:
    """The plans of one source's page."""
    return page_plans(pages, fetched_at, (source,))


def page_plans(pages: DataFrame, fetched_at: str, sources: tuple[PlanSource, ...] | None = None) -> DataFrame:
    """The plans of all given sources (by default the verified ones), in one pass over the pages (source_id, body).

    A product without a window gives no plan, one without a price a null price.
    """
    sources = registry() if sources is None else sources
    page = pages.where(F.col("source_id").isin([s.source_id for s in sources])).select("source_id", "body", X.visible_text(F.col("body")).alias("text"))
    entry = lambda s, k: F.struct(F.lit(k).alias("k"), F.coalesce(s.window(s, k), F.lit("")).alias("window"))
    windows = F.coalesce(*(F.when(F.col("source_id") == s.source_id, F.array(*(entry(s, k) for k in range(len(s.products))))) for s in sources))
    rows = page.select("source_id", F.inline(windows)).where("window <> ''")
    read = rows.withColumn("price", F.coalesce(*(F.when(F.col("source_id") == s.source_id, _prices(s)) for s in sources)))
    told = read.join(F.broadcast(_constants(pages.sparkSession, sources)), ["source_id", "k"])  # as many rows as the registry has products
    return as_plans(told.withColumns({
        "price_amount": F.col("price.price"), "currency": F.coalesce("currency", "price.currency"), "monthly_equivalent": F.coalesce("monthly_equivalent", "price.price"),
        "included_quota": F.when(F.col("with_quota"), A.counted(F.col("window"), "credit")), "billing_cadence": F.coalesce("billing_cadence", F.lit("monthly")),
        "fetched_at": F.lit(fetched_at), "raw": F.to_json(F.struct(F.col("window").alias("official_text"))),
    }).withColumns({"quota_unit": F.when(F.col("included_quota").isNotNull(), "credits"), "quota_period": F.when(F.col("included_quota").isNotNull(), "monthly")}))


def _prices(source: PlanSource) -> Column:
    """struct(price, currency) read from the window of the source's product number k."""
    kind = "struct<price:double,currency:string>"
    shown = lambda p: p if source.currency == "" else F.struct(p.cast("double").alias("price"), F.lit(source.currency).alias("currency"))
    return F.coalesce(*(F.when(F.col("k") == k, shown(source.price(source, p, F.col("window"))).cast(kind)) for k, p in enumerate(source.products)))


#: What the registry tells of a plan besides its window: columns, types, and how they are told.
_TOLD = {
    "source_id": "string", "k": "int", "plan_id": "string", "provider_id": "string", "provider_name": "string", "product_name": "string", "plan_category": "string", "billing_type": "string", "is_free": "boolean",
    "currency": "string", "purchase_url": "string", "source_url": "string", "source_kind": "string", "featured_on_home": "boolean", "with_quota": "boolean", "monthly_equivalent": "double", "billing_cadence": "string",
    "price_status": "string", "price_scope": "string", "seat_type": "string", "minimum_seats": "long",
}


def _constants(spark: SparkSession, sources: tuple[PlanSource, ...]) -> DataFrame:
    rows = []
    for s in sources:
        for k, p in enumerate(s.products):
            told = (s.source_id, k, f"{s.provider[0]}/{s.family}/{p.slug}", *s.provider, p.name, s.category, s.billing, p.free, s.currency or None, s.purchase_url or s.source_url, s.source_url, s.kind, p.featured, s.quota)
            rows.append((*told, *(p.fixed.get(c) for c in list(_TOLD)[len(told) :])))
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in _TOLD.items()))


def spec_windows(pages: DataFrame, specs: DataFrame, width: int = 700) -> DataFrame:
    """Windows of specs (slug, label pattern) in pages (source_id, text): each from its first match to the next spec's.

    All labels are looked for in one pass over a page.
    """
    found = label_places(pages, specs)
    wide = with_width(found, F.col("at"), width, "width", "source_id", ("at", "slug"), F.length("text") + 1)
    return wide.select("source_id", "slug", "at", F.substr("text", "at", "width").alias("window"))


def product_table(spark: SparkSession, experimental: bool = True) -> DataFrame:
    """The registry as rows: source, url, expected plans, whether verified."""
    rows = [(s.source_id, s.source_url, s.minimum, s.verified) for s in registry(experimental)]
    return spark.createDataFrame(rows, "source_id string, source_url string, minimum int, verified boolean")
