"""Questions to the catalog: search, filters, facets, orders, pages and selections as plain DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tariffgrid.functions.model_names import name_parts
from tariffgrid.functions.pricing import SAME_PRICE, compare_price, quota_type
from tariffgrid.operators.paging import PageIndex, SortKey, page_index

COLLATION = "zh"
CONTEXT_BUCKETS = {"gte1000k": (1_000_000, None), "gte200k": (200_000, None), "gte128k": (128_000, None), "lt128k": (None, 128_000)}
PRICE_BUCKETS = {"lt10": (None, 10), "10to50": (10, 50), "50to200": (50, 200), "gte200": (200, None)}
PLAN_BUCKETS = {"lt50": (None, 50), "50to150": (50, 150), "150to500": (150, 500), "gte500": (500, None)}
BILLING_ORDER = ("per_token", "subscription", "coding_plan")
PLAN_TYPES = ("subscription", "coding_plan")
CODING_PROVIDERS = ("cursor", "githubcopilot", "kiro", "opencode")
#: Rows that a search suggests, and that a picker of models or of plans offers.
SUGGESTIONS, PICKER_ROWS, COMPARE_ROWS = 8, 60, 40
#: Rows of a table made of a list of ids, up to which it is broadcast.
BROADCAST_IDS = 10_000


@dataclass(frozen=True)
class Line:
    """A line of a maker's models, by the parts of their names.

    A name is compared in lower case. With `numbered`, it is what stands before its first digit
    (`begins`), a number, and what stands after (`rest`); else it begins so, holds all of `words` and none of `without`.
    """

    provider_id: str
    rank: int
    begins: str
    numbered: bool = False
    rest: str = ""
    words: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


LINE_TYPE = "rule_provider string, rule_rank int, begins string, numbered boolean, rest string, has array<string>, lacks array<string>"
#: Makers and families of their flagships, the preferred one first.
LINES = (
    Line("openai", 0, "gpt-", numbered=True, rest=" sol"),
    Line("openai", 1, "gpt-", numbered=True),
    Line("anthropic", 0, "claude opus", words=("opus",)),
    Line("google", 0, "gemini", words=("gemini", "pro")),
    Line("qwen", 0, "qwen", words=("max",)),
    Line("deepseek", 0, "deepseek", words=("deepseek", "pro")),
    Line("deepseek", 1, "deepseek", without=("flash",)),
    Line("moonshot", 0, "kimi k", numbered=True),
    Line("zhipu", 0, "glm-", numbered=True),
    Line("minimax", 0, "minimax-m", numbered=True),
)


def lines_table(spark: SparkSession, lines: tuple[Line, ...] = LINES) -> DataFrame:
    return spark.createDataFrame([(x.provider_id, x.rank, x.begins, x.numbered, x.rest, list(x.words), list(x.without)) for x in lines], LINE_TYPE)


def in_line(model: str | Column) -> Column:
    """Whether a model's name belongs to the line of its row (columns of LINE_TYPE)."""
    parts = name_parts(model)
    counted = (parts["stem"] == F.col("begins")) & parts["version"].isNotNull() & (parts["rest"] == F.col("rest"))
    named = parts["name"].startswith(F.col("begins")) & (F.size(F.array_except("has", parts["words"])) == 0) & ~F.arrays_overlap("lacks", parts["words"])
    return F.when(F.col("numbered"), counted).otherwise(named)


def view_rows(offers: DataFrame, plans: DataFrame) -> DataFrame:
    """Offers and plans as one table, told apart by billing_type; columns that one lacks are null."""
    a = offers.select(
        F.col("offer_id").alias("id"), F.lit("per_token").alias("billing_type"), "provider_id", "provider_name", F.col("model_name").alias("model"), "market", "currency", "context_window", "modalities", "release_date",
        "input_per_1m", "output_per_1m", "cache_read_per_1m",
        *(compare_price(F.col(f"comparison_{c}_per_1m"), F.col("currency"), F.col(f"{c}_per_1m")).alias(f"compare_{c}") for c in ("input", "output", "cache_read")),
    )
    b = plans.select(
        F.col("plan_id").alias("id"), "billing_type", "provider_id", "provider_name", F.col("product_name").alias("model"), "market", "currency", "price_amount", "monthly_equivalent", "included_quota", "quota_unit",
        "featured_on_home", compare_price(F.col("comparison_monthly_amount"), F.col("currency"), F.col("monthly_equivalent")).alias("compare_monthly"),
    )
    return a.unionByName(b, allowMissingColumns=True).withColumn("row_id", F.concat_ws(":", "provider_id", "id"))


def with_status(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """rows with their provider's status, error and whether it is stale; a provider without a status is not stale."""
    known = statuses.select("provider_id", F.col("status").alias("provider_status"), F.coalesce("stale", F.lit(False)).alias("stale"))
    return rows.join(known, "provider_id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


def is_fresh(rows: DataFrame) -> Column:
    """Not stale; rows without a status are not."""
    return ~F.coalesce(F.col("stale"), F.lit(False)) if "stale" in rows.columns else F.lit(True)


def contains(text: str, *columns: str) -> Column:
    """Case-blind substring in any of the columns; an empty text is in all."""
    q = text.strip().lower()
    found = F.lit(not q)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return found


def one_of(column: str | Column, values: list) -> Column:
    """Among the values; no values let everything pass."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isin(*values) if values else F.lit(True)


def overlaps(column: str, values: list[str]) -> Column:
    return F.arrays_overlap(F.coalesce(column, F.array().cast("array<string>")), F.array(*(F.lit(v) for v in values))) if values else F.lit(True)


def in_bucket(value: Column, bounds: tuple) -> Column:
    """least <= value < most; null is in no bucket."""
    least, most = bounds
    ok = value.isNotNull()
    if least is not None:
        ok = ok & (value >= least)
    return ok & (value < most) if most is not None else ok


def bucket_name(value: Column, buckets: dict) -> Column:
    """The first bucket that holds the value, null if none does."""
    return F.coalesce(*(F.when(in_bucket(value, b), F.lit(n)) for n, b in buckets.items()))


def quick_filter(name: str) -> Column:
    """A filter with a name: under10 by input price, longContext by window, vision by modality; a row that lacks the column's value doesn't pass."""
    return {
        "under10": in_bucket(F.col("compare_input"), PRICE_BUCKETS["lt10"]),
        "longContext": in_bucket(F.col("context_window"), CONTEXT_BUCKETS["gte200k"]),
        "vision": F.coalesce(F.array_contains("modalities", "vision"), F.lit(False)),
    }[name]


def plan_kind(kind: str) -> Column:
    """free: a monthly price of exactly 0; paid: above 0. A plan without a price is neither."""
    return F.coalesce(F.col("monthly_equivalent") == 0 if kind == "free" else F.col("monthly_equivalent") > 0, F.lit(False))


@dataclass(frozen=True)
class CatalogQuery:
    """Parameters of a catalog page; unset ones don't restrict."""

    search: str = ""
    providers: tuple[str, ...] = ()
    modalities: tuple[str, ...] = ()
    market: str = ""
    context: str = ""
    price: str = ""
    billing_types: tuple[str, ...] = ()
    currency: str = ""
    quick: str = ""
    sort: str = "releaseDate:desc"
    page: int = 1
    page_size: int = 50

    def where(self) -> Column:
        ok = contains(self.search, "model", "provider_name") & one_of("provider_id", list(self.providers)) & overlaps("modalities", list(self.modalities)) & one_of("billing_type", list(self.billing_types))
        if self.market:
            ok = ok & (F.coalesce("market", F.lit("global")) == self.market)
        if self.context:
            ok = ok & in_bucket(F.col("context_window"), CONTEXT_BUCKETS[self.context])
        if self.price:
            ok = ok & in_bucket(F.col("compare_input"), PRICE_BUCKETS[self.price])
        if self.currency:
            ok = ok & (F.col("currency") == self.currency)
        return ok & quick_filter(self.quick) if self.quick else ok

    def order(self) -> list[Column]:
        return sort_columns(self.sort)

    def run(self, rows: DataFrame) -> DataFrame:
        return page(rows.where(self.where()), self.order(), self.page, self.page_size)

    def indexed(self, rows: DataFrame, path: str, ranges: int = 64) -> PageIndex:
        """The query's rows dealt into ranges of its order, for pages of any depth."""
        return page_index(rows.where(self.where()), sort_keys(self.sort), path, ranges)


@dataclass(frozen=True)
class PlanQuery:
    """Parameters of the plans' page of one billing type; unset ones don't restrict."""

    billing_type: str = "subscription"
    search: str = ""
    providers: tuple[str, ...] = ()
    kind: str = ""
    price: str = ""
    quota: str = ""
    descending: bool = False

    def where(self) -> Column:
        ok = (F.col("billing_type") == self.billing_type) & contains(self.search, "model", "provider_name") & one_of("provider_id", list(self.providers))
        if self.kind:
            ok = ok & plan_kind(self.kind)
        if self.price:
            ok = ok & in_bucket(F.col("compare_monthly"), PLAN_BUCKETS[self.price])
        if self.quota:
            ok = ok & (quota_type(F.col("quota_unit")) == self.quota)
        return ok

    def order(self) -> list[Column]:
        """By monthly price, plans without one last either way; of equals by name and id."""
        price = F.col("compare_monthly")
        return [price.desc_nulls_last() if self.descending else price.asc_nulls_last(), F.collate("model", COLLATION), F.col("id").asc()]

    def run(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.where()).orderBy(*self.order())


def plan_providers(rows: DataFrame, billing_type: str) -> DataFrame:
    """Providers of the plans of a billing type, most plans first."""
    return rows.where(F.col("billing_type") == billing_type).groupBy("provider_id", "provider_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "provider_name", "provider_id")


def billing_order() -> list[Column]:
    """Products as the billing pages list them: by provider, then by monthly price, without one last."""
    return [F.collate("provider_name", COLLATION), F.col("monthly_equivalent").asc_nulls_last(), F.col("id").asc()]


def candidate_order() -> list[Column]:
    """Models that can be compared: newest first, then by provider and model."""
    return [F.coalesce("release_date", F.lit("")).desc(), F.collate("provider_name", COLLATION), F.collate("model", COLLATION), F.col("id").asc()]


def candidates(rows: DataFrame, search: str = "", without: tuple[str, ...] = (), most: int = PICKER_ROWS) -> DataFrame:
    """Fresh models with a price that a picker offers, without those selected elsewhere."""
    priced = rows.where((F.col("billing_type") == "per_token") & F.col("model").isNotNull() & is_fresh(rows) & contains(search, "model", "provider_name"))
    return (not_selected(priced, list(without)) if without else priced).orderBy(*candidate_order()).limit(most)


def compare_candidates(rows: DataFrame, search: str = "", elsewhere: tuple[str, ...] = ()) -> DataFrame:
    """What one column of the home page's comparison offers: models that no other column has, fewer than a picker of its own."""
    return candidates(rows, search, elsewhere, COMPARE_ROWS)


def featured_plans(rows: DataFrame) -> DataFrame:
    """Plans that the home page shows: featured ones with a monthly price."""
    return rows.where(F.col("billing_type").isin(*PLAN_TYPES) & F.coalesce("featured_on_home", F.lit(False)) & F.col("monthly_equivalent").isNotNull())


def billing_totals(rows: DataFrame) -> DataFrame:
    """One row: fresh rows of each billing type, plans of both kinds together, and all rows."""
    fresh = is_fresh(rows)
    n = {b: F.count_if((F.col("billing_type") == b) & fresh) for b in BILLING_ORDER}
    return rows.agg(*(c.alias(b) for b, c in n.items()), (n["subscription"] + n["coding_plan"]).alias("plans"), F.count(F.lit(1)).alias("n_rows"))


def status_totals(statuses: DataFrame) -> DataFrame:
    """One row: providers that are stale, and that are not."""
    stale = F.coalesce("stale", F.lit(False))
    return statuses.agg(F.count_if(stale).alias("n_stale"), F.count_if(~stale).alias("n_fresh"))


def search_providers(providers: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """Providers whose name, English name or id holds the text; for suggestions the first few, and none for an empty text."""
    found = providers.where(contains(text, "name", "name_en", "provider_id"))
    if most is None:
        return found
    return found.where(F.lit(bool(text.strip()))).orderBy("provider_id").limit(most)


def by_region(providers: DataFrame) -> DataFrame:
    """providers with region_group: cn, or intl for all other regions."""
    return providers.withColumn("region_group", F.when(F.col("region") == "cn", "cn").otherwise("intl"))


def toggled(visible: tuple[str, ...], column: str) -> tuple[str, ...]:
    """The visible columns with one switched on or off; the last one stays on."""
    if column not in visible:
        return (*visible, column)
    return tuple(c for c in visible if c != column) or visible


def shown(rows: DataFrame, visible: tuple[str, ...], always: tuple[str, ...] = ("id", "model")) -> DataFrame:
    """The rows with the visible columns beside those always shown."""
    return rows.select(*dict.fromkeys((*always, *visible)))


def sort_keys(option: str) -> tuple[SortKey, ...]:
    """The keys of `key:direction`: nulls last either way, ties by id."""
    key, _, direction = option.partition(":")
    value = {
        "inputPrice": "compare_input", "outputPrice": "compare_output", "cachedInput": "compare_cache_read", "contextWindow": "context_window",
        "monthlyPrice": "compare_monthly", "model": "model", "releaseDate": "release_date",
    }[key]
    column = F.try_to_date(value) if key == "releaseDate" else F.col(value)
    return SortKey(column, direction != "asc", COLLATION if key == "model" else None), SortKey(F.col("id"))


def sort_columns(option: str) -> list[Column]:
    """Order for `key:direction`."""
    return [k.ordered() for k in sort_keys(option)]


def table_order(column: str, direction: str) -> list[Column]:
    """Order of the generic table: a missing number counts as endless, so it is last ascending and first descending."""
    value = F.col(column)
    first = value.asc_nulls_last() if direction == "asc" else value.desc_nulls_first()
    return [first, F.col("compare_input").asc_nulls_last(), F.col("id").asc()] if column == "release_date" else [first, F.col("id").asc()]


def page_count(n: int, size: int) -> int:
    return max(1, -(-n // size))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """One page of the ordered rows; a number out of range means the nearest page.

    Clamping needs the count; for page 1 it is not asked for, and the plan is a top-k. Where
    many deep pages are asked for, paging.page_index sorts only the range of each.
    """
    if number > 1:
        number = min(number, page_count(rows.count(), size))
    ordered = rows.orderBy(*order)
    return ordered.limit(size) if number <= 1 else ordered.offset((number - 1) * size).limit(size)


def facet_counts(rows: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    """Rows of each value (those that `where` keeps), most first."""
    n = F.count(F.lit(1)) if where is None else F.count_if(where)
    return rows.groupBy(*keys).agg(n.alias("n")).where("n > 0").orderBy(F.desc("n"), *keys)


def billing_tabs(rows: DataFrame) -> DataFrame:
    """Counts by billing type in the fixed order of tabs."""
    order = F.array_position(F.array(*(F.lit(b) for b in BILLING_ORDER)), F.col("billing_type"))
    return rows.groupBy("billing_type").agg(F.count(F.lit(1)).alias("n")).where(order > 0).withColumn("tab", order).orderBy("tab")


def provider_flags(rows: DataFrame) -> DataFrame:
    """Of each provider: which billing types it has, products, models."""
    return rows.groupBy("provider_id").agg(*(F.bool_or(F.col("billing_type") == b).alias(f"has_{b}") for b in BILLING_ORDER), F.count(F.lit(1)).alias("n_products"), F.countDistinct("model").alias("n_models"))


def default_currency(rows: DataFrame) -> DataFrame:
    """One row: plans in CNY and USD, and the tab that opens first (CNY on a tie)."""
    return rows.agg(F.count_if(F.col("currency") == "CNY").alias("n_cny"), F.count_if(F.col("currency") == "USD").alias("n_usd")).withColumn("opens", F.when(F.col("n_cny") >= F.col("n_usd"), "CNY").otherwise("USD"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, of its elements if it is an array, in order."""
    many = rows.schema[column].dataType.typeName() == "array"
    return rows.select(F.explode(column).alias(column) if many else column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def groups_in_order(rows: DataFrame, key: str, ordinal: str, *columns: str) -> DataFrame:
    """One row a key with its rows in order, keys in order of their first row."""
    grouped = rows.groupBy(key).agg(F.min(ordinal).alias("first"), F.sort_array(F.collect_list(F.struct(ordinal, *columns))).alias("rows"))
    return grouped.orderBy("first")


def flagships(rows: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One row a maker: of its most preferred line that has fresh rows, the newest model.

    lines: a table of LINE_TYPE, joined by maker; by default the fixed one.
    """
    table = lines_table(rows.sparkSession) if lines is None else lines
    priced = rows.where("billing_type = 'per_token' and input_per_1m is not null and output_per_1m is not null").where(is_fresh(rows))
    hit = priced.join(table, F.col("provider_id") == F.col("rule_provider")).where(in_line("model"))
    newest = W.partitionBy("provider_id").orderBy("rule_rank", F.coalesce("release_date", F.lit("")).desc(), F.collate("model", COLLATION), "id")
    best = hit.withColumn("place", F.row_number().over(newest)).where("place = 1").select(*rows.columns, "rule_rank")
    return best.orderBy(F.col("compare_input").desc_nulls_last(), F.col("compare_output").desc_nulls_last(), F.coalesce("release_date", F.lit("")).desc(), F.collate("provider_name", COLLATION))


def first_of_each(rows: DataFrame, key: str, order: list[Column], most: int | None = None, without: list | None = None, id_col: str = "id") -> DataFrame:
    """The first row of each key, so many keys at most, without some ids."""
    kept = rows.where(~F.col(id_col).isin(*without)) if without else rows
    first = kept.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("place = 1").drop("place")
    return first.orderBy(*order).limit(most) if most else first


def _listed(table: DataFrame, n: int) -> DataFrame:
    """A table made of a list of n entries, broadcast if these are few."""
    return F.broadcast(table) if n <= BROADCAST_IDS else table


def selected(rows: DataFrame, ids: list[str], most: int = 4, id_col: str = "id") -> DataFrame:
    """Rows of the selected ids in the order of selection; ids without a row are passed over, `most` are kept."""
    spark: SparkSession = rows.sparkSession
    picks = spark.createDataFrame([(k, x) for k, x in enumerate(dict.fromkeys(ids))], f"pick int, `{id_col}` string")
    return rows.join(_listed(picks, len(ids)), id_col).orderBy("pick").limit(most)


def not_selected(rows: DataFrame, ids: list[str], id_col: str = "id") -> DataFrame:
    spark: SparkSession = rows.sparkSession
    return rows.join(_listed(spark.createDataFrame([(x,) for x in ids], f"`{id_col}` string"), len(ids)), id_col, "left_anti")


def row_by_id(rows: DataFrame, wanted: str, id_col: str = "id") -> DataFrame:
    """The row with an id, if there is one."""
    return rows.where(F.col(id_col) == wanted).limit(1)


def current_provider(wanted: str, catalog: DataFrame, metadata: DataFrame) -> DataFrame:
    """A provider as the catalog tells it, else as the metadata does; no row if neither knows it."""
    both = row_by_id(catalog, wanted, "provider_id").withColumn("rank", F.lit(0)).unionByName(row_by_id(metadata, wanted, "provider_id").withColumn("rank", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("rank").limit(1).drop("rank")


def filled_selection(rows: DataFrame, ids: list[str], defaults: list[str], most: int = 3, id_col: str = "id") -> DataFrame:
    """Selected ids that still have rows, topped up with defaults that are not selected."""
    return selected(rows, [*ids, *(d for d in defaults if d not in ids)], most, id_col)


def preferred_first(rows: DataFrame, preferred: list[str], label: str, ordinal: str, most: int = 3) -> DataFrame:
    """Distinct labels, preferred ones first in their order, then by ordinal."""
    rank = F.array_position(F.array(*(F.lit(p) for p in preferred)), F.col(label)) if preferred else F.lit(0)
    ranked = rows.withColumn("rank", F.when(rank > 0, rank))
    order = [F.col("rank").asc_nulls_last(), F.col(ordinal).asc()]
    return first_of_each(ranked, label, order, most, id_col=label)


def with_lowest(rows: DataFrame, *columns: str, by: str | None = None) -> DataFrame:
    """rows with lowest_<column>: whether it has the least value (of its group), if two or more have one.

    The least values are one aggregation, joined back as a row for each group.
    """
    least = [x for c in columns for x in (F.min(c).alias(f"least {c}"), F.count(c).alias(f"n {c}"))]
    if by is None:
        both = rows.crossJoin(F.broadcast(rows.agg(*least)))  # one row
    else:
        found = rows.groupBy(F.col(by).alias("least of")).agg(*least)
        both = rows.join(found, F.col(by).eqNullSafe(F.col("least of")), "left").drop("least of")
    flag = lambda c: (F.col(f"n {c}") >= 2) & F.coalesce(F.abs(F.col(c) - F.col(f"least {c}")) < SAME_PRICE, F.lit(False))
    return both.select(*rows.columns, *(flag(c).alias(f"lowest_{c}") for c in columns))


def lowest_priced(rows: DataFrame, column: str = "compare_input") -> DataFrame:
    return rows.where(F.col(column).isNotNull()).orderBy(column, "id").limit(1)


def provider_directory(catalog: DataFrame, statuses: DataFrame, metadata: DataFrame, without: tuple[str, ...] = CODING_PROVIDERS) -> DataFrame:
    """Providers of the catalog, then those with only a status, then those with only metadata; the first source of a provider counts."""
    every = None
    for rank, part in enumerate((catalog, statuses, metadata)):
        one = part.select("provider_id", F.lit(rank).alias("rank")).distinct()
        every = one if every is None else every.unionByName(one)
    first = every.groupBy("provider_id").agg(F.min("rank").alias("rank"))
    return first.where(~F.col("provider_id").isin(*without)).join(metadata, "provider_id", "left")


def with_provider_info(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """Provider ids with name, English name, region and website; what the metadata lacks is defaulted."""
    m = ids.join(metadata, "provider_id", "left")
    name = F.coalesce("name", "provider_id")
    return m.select("provider_id", name.alias("name"), F.coalesce("name_en", name).alias("name_en"), F.coalesce("region", F.lit("unknown")).alias("region"), F.coalesce("website", F.lit("")).alias("website"))


def providers_with_rows(providers: DataFrame, rows: DataFrame) -> DataFrame:
    """Providers and their rows: a provider of a row is made if it is absent, one without rows is dropped."""
    counts = rows.groupBy("provider_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return providers.join(counts, "provider_id", "full_outer").where("n_rows > 0")
