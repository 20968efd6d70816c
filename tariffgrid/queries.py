"""Queries over the star-schema tables that exercise the catalog operators, each with the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tariffgrid.functions import pricing as P
from tariffgrid.functions import text as X
from tariffgrid.operators import catalog_query as C
from tariffgrid.operators import quality as Q
from tariffgrid.operators import selection as S
from tariffgrid.operators.paging import SortKey, next_page, page_index
from tariffgrid.operators.search_index import search_index
from tariffgrid.plans import fx, history
from tariffgrid.plans.plan_pages import spec_windows
from tariffgrid.session import new_table_path
from tariffgrid.sources.page_parts import page_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        ORACLES[f.__name__] = sql
        return f

    return add


RATES = (*((f"NATION_{k}", r) for k, r in enumerate((7.8, 7.8, 1.0, 0.047, 7.2, 0.086, -1.0))), ("FRANCE", 7.8))
_RATE_ROWS = ", ".join(f"('{n}', {r}::DOUBLE)" for n, r in RATES)


def _rates(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(n, r, "2026-01-02") for n, r in RATES], "currency string, rate double, published_date string")


@query(f"""
SELECT l.l_orderkey, l.l_linenumber, CASE WHEN r.rate > 0 THEN r.rate END AS comparison_fx_rate, round(l.l_extendedprice * CASE WHEN r.rate > 0 THEN r.rate END, 2) AS comparison_price
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN (VALUES {_RATE_ROWS}) r(currency, rate) ON upper(n.n_name) = r.currency""")
def fx_offer_comparison(t):
    suppliers = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    rated = fx.with_rate(lines, _rates(lines), "n_name")
    return rated.select("l_orderkey", "l_linenumber", "comparison_fx_rate", F.round(F.col("l_extendedprice") * F.col("comparison_fx_rate"), 2).alias("comparison_price"))


@query("""
SELECT o_orderkey, CASE WHEN status IN ('priced', 'free') THEN coalesce(CASE WHEN cadence = 'annual' THEN o_totalprice / 12 END, CASE WHEN cadence = 'monthly' THEN o_totalprice END) END AS amount
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'priced' WHEN 'O' THEN 'free' ELSE 'contact_sales' END AS status,
      CASE WHEN o_orderpriority LIKE '1%' THEN 'annual' WHEN o_orderpriority LIKE '5%' THEN 'weekly' ELSE 'monthly' END AS cadence FROM orders)""")
def plan_comparison_amount(t):
    cadence = F.when(F.col("o_orderpriority").startswith("1"), "annual").when(F.col("o_orderpriority").startswith("5"), "weekly").otherwise("monthly")
    plans = t("orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price_amount"), cadence.alias("billing_cadence"),
        F.when(F.col("o_orderstatus") == "F", "priced").when(F.col("o_orderstatus") == "O", "free").otherwise("contact_sales").alias("price_status"),
    )
    plans = plans.withColumn("monthly_equivalent", F.when(F.col("billing_cadence") == "annual", F.col("price_amount") / 12))
    return plans.select("o_orderkey", fx.plan_amount().alias("amount"))


@query("""
SELECT p_partkey, CASE WHEN contains(lower(p_type || ' ' || p_name), 'widget') THEN 'batch' WHEN contains(lower(p_type || ' ' || p_name), 'promo') THEN 'flex' ELSE 'standard' END AS tier FROM part""")
def service_tier_tag(t):
    # A part's words stand for the two words that mark a tier.
    marked = F.replace(F.replace(F.lower("p_type"), F.lit("widget"), F.lit("batch")), F.lit("promo"), F.lit("flex"))
    named = F.replace(F.replace(F.lower("p_name"), F.lit("widget"), F.lit("batch")), F.lit("promo"), F.lit("flex"))
    return t("part").select("p_partkey", P.service_tier(marked, named).alias("tier"))


@query("""SELECT p_partkey, p_brand || '/' || trim(p_name, '/') || '/global/' || p_size::VARCHAR AS offer_id FROM part""")
def offer_id_compose(t):
    return t("part").select("p_partkey", P.offer_id(F.col("p_brand"), F.col("p_name"), F.lit("global"), F.col("p_size").cast("string")).alias("offer_id"))


@query("""SELECT event_id, CAST(props->>'$.k' AS DOUBLE) AS k, CAST(trunc(CAST(props->>'$.k' AS DOUBLE)) AS BIGINT) AS k_whole FROM events""")
def json_property_extract(t):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return t("events").select("event_id", P.number(k).alias("k"), P.integer(k).alias("k_whole"))


@query("""
SELECT c_custkey, coalesce(n.n_name, c_nationkey::VARCHAR) AS name, CASE WHEN n.n_name IS NULL THEN 'unknown' ELSE r.r_name END AS region
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def provider_default_lookup(t):
    known = t("nation").where("n_regionkey < 3").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    metadata = known.select(F.col("n_nationkey").cast("string").alias("provider_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("name_en"), F.col("r_name").alias("region"), F.lit("").alias("website"))
    ids = t("customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("provider_id"))
    info = C.with_provider_info(ids.select("provider_id").distinct(), metadata)
    return ids.join(info, "provider_id").select("c_custkey", "name", "region")


@query("""SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey""")
def target_provider_filter(t):
    wanted = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_mktsegment")
    return S.known_only(t("orders").select("o_orderkey", "o_custkey"), wanted.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select("o_orderkey", "o_custkey", "c_mktsegment")


def _part_view(t) -> DataFrame:
    """Parts in the shape of catalog rows."""
    return t("part").select(
        F.format_string("%010d", "p_partkey").alias("id"), F.lit("per_token").alias("billing_type"), F.col("p_brand").alias("provider_id"), F.col("p_brand").alias("provider_name"), F.col("p_name").alias("model"),
        F.lit("global").alias("market"), F.lit("USD").alias("currency"), (F.col("p_size") * 10_000).cast("bigint").alias("context_window"), F.split("p_type", " ").alias("modalities"),
        (F.col("p_retailprice") - 895).alias("compare_input"), F.lit(None).cast("string").alias("release_date"),
    )


@query("""
SELECT printf('%010d', p_partkey) AS id, p_name AS model, p_retailprice - 895 AS compare_input, p_size * 10000::BIGINT AS context_window FROM part
WHERE contains(lower(p_name) || ' ' || lower(p_brand), 'a') AND p_size * 10000 >= 200000 AND p_retailprice - 895 >= 10 AND p_retailprice - 895 < 50
ORDER BY p_retailprice - 895 ASC NULLS LAST, id LIMIT 50 OFFSET 50""")
def catalog_browse_page(t):
    asked = C.CatalogQuery(search="a", context="gte200k", price="10to50", sort="inputPrice:asc", page=2)
    return asked.run(_part_view(t)).select("id", "model", "compare_input", "context_window")


@query("""
SELECT CASE WHEN x < 10 THEN 'lt10' WHEN x < 50 THEN '10to50' WHEN x < 200 THEN '50to200' ELSE 'gte200' END AS bucket, count(*) AS n FROM (SELECT p_retailprice - 895 AS x FROM part) GROUP BY 1""")
def price_bucket_counts(t):
    return _part_view(t).select(C.bucket_name(F.col("compare_input"), C.PRICE_BUCKETS).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, string_split(p_type, ' ')[1] AS first_modality FROM part WHERE list_has_any(string_split(p_type, ' '), ['STEEL', 'PROMO'])""")
def modality_overlap(t):
    parts = t("part").select("p_partkey", F.split("p_type", " ").alias("modalities"))
    return parts.where(C.overlaps("modalities", ["STEEL", "PROMO"])).select("p_partkey", F.element_at(P.distinct_in_order(F.col("modalities"), F.col("modalities")), 1).alias("first_modality"))


@query("""SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1""")
def duplicate_key_report(t):
    return Q.duplicate_keys(t("events"), "user_id", "event_type")


@query("""
SELECT count(*) AS n_rows, count_if(o_custkey IS NULL OR o_orderpriority = '')::BIGINT AS identity, count_if(o_totalprice > 300000)::BIGINT AS price_high, count_if(o_orderstatus NOT IN ('F', 'O'))::BIGINT AS status,
       min(CASE WHEN o_totalprice > 300000 OR o_orderstatus NOT IN ('F', 'O') THEN o_orderkey END) AS first_bad FROM orders""")
def quality_gate_report(t):
    rules = (
        Q.RowRule("identity", F.col("o_custkey").isNull() | (F.col("o_orderpriority") == "")),
        Q.RowRule("price_high", F.col("o_totalprice") > 300_000),
        Q.RowRule("status", ~F.col("o_orderstatus").isin("F", "O")),
    )
    orders = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    first = orders.agg(F.min(F.when(Q.first_broken(rules).isNotNull(), F.col("o_orderkey"))).alias("first_bad"))
    return Q.rule_counts(orders, rules).crossJoin(first)


@query("""
SELECT month, n, greatest(0, before - n) / before AS drop_ratio FROM (SELECT *, lag(n) OVER (ORDER BY month) AS before FROM
 (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1))""")
def drop_ratio_guard(t):
    counts = t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return history.drop_ratios(counts, "month", "n")


@query("""
SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders JOIN customer ON o_custkey = c_custkey) WHERE k = 1""")
def latest_release_join(t):
    releases = t("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    newest = S.newest(releases, ["o_orderdate", "o_orderkey"], by=["o_custkey"])
    return t("customer").select("c_custkey").join(newest, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT o_orderkey AS release_id, CASE WHEN row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'published' ELSE 'superseded' END AS status FROM orders""")
def supersede_status(t):
    releases = t("orders").select(F.col("o_orderkey").alias("release_id"), F.col("o_orderdate").alias("published_at"))
    return history.with_release_status(releases).select("release_id", "status")


@query("""
WITH g AS (SELECT user_id, arg_max(value, ts) AS v FROM events WHERE event_type <> 'error' GROUP BY 1), e AS (SELECT user_id, arg_max(value, ts) AS v FROM events GROUP BY 1)
SELECT e.user_id, coalesce(g.v, e.v) AS value, g.v IS NULL AS is_stale FROM e LEFT JOIN g USING (user_id)""")
def lkg_fallback(t):
    return S.with_fallback(t("events"), "user_id", "value", "ts", F.col("event_type") != "error")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events""")
def locf_heading(t):
    mark = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return S.with_nearest(t("events"), mark, "heading", "user_id", ("ts", "event_id")).select("event_id", "heading")


@query("""
SELECT event_id, least(coalesce(floor(epoch(lead(ts) OVER w)) - floor(epoch(ts)), 86400), 86400)::BIGINT AS width FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def next_match_window(t):
    rows = t("events").select("event_id", "user_id", "ts", F.unix_timestamp("ts").alias("at"))
    return S.with_width(rows, F.col("at"), 86400, "width", "user_id", ("ts", "event_id")).select("event_id", F.col("width").cast("bigint").alias("width"))


@query("""SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def keep_last_dedupe(t):
    return S.newest(t("events").select("user_id", "event_type", "event_id", "value"), ["event_id"], by=["user_id", "event_type"])


@query("""
SELECT p_brand AS provider_id, id, rule_rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY rule_rank, p_size DESC, p_type COLLATE zh, id) AS k FROM
 (SELECT *, printf('%010d', p_partkey) AS id, CASE WHEN regexp_matches(p_type, '(?i)^PROMO') THEN 0 WHEN regexp_matches(p_type, '(?i)^ECONOMY') THEN 1 END AS rule_rank FROM part) WHERE rule_rank IS NOT NULL) WHERE k = 1""")
def flagship_per_provider(t):
    rows = t("part").select(
        F.format_string("%010d", "p_partkey").alias("id"), F.lit("per_token").alias("billing_type"), F.col("p_brand").alias("provider_id"), F.col("p_brand").alias("provider_name"), F.col("p_type").alias("model"),
        F.col("p_retailprice").alias("input_per_1m"), F.col("p_retailprice").alias("output_per_1m"), F.col("p_retailprice").alias("compare_input"), F.col("p_retailprice").alias("compare_output"),
        F.format_string("%04d", "p_size").alias("release_date"),
    )
    lines = C.lines_table(rows.sparkSession, (C.Line("", 0, "promo", words=("promo",)), C.Line("", 1, "economy")))
    makers = rows.select(F.col("provider_id").alias("rule_provider")).distinct()
    each = makers.select("rule_provider", F.explode(F.array(F.lit(0), F.lit(1))).alias("rule_rank")).join(F.broadcast(lines.drop("rule_provider")), "rule_rank")  # two lines
    return C.flagships(rows, each).select("provider_id", "id", "rule_rank")


@query("""SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_partkey <> 1) WHERE k = 1 ORDER BY p_partkey LIMIT 2""")
def first_per_provider(t):
    return C.first_of_each(t("part"), "p_brand", [F.col("p_partkey")], 2, [1], "p_partkey").select("p_brand", "p_partkey")


@query("""
SELECT p_partkey, p_retailprice, count(p_retailprice) OVER b >= 2 AND abs(p_retailprice - min(p_retailprice) OVER b) < 1e-9 AS lowest_p_retailprice,
 count(p_size) OVER () >= 2 AND p_size = min(p_size) OVER () AS lowest_p_size FROM part WINDOW b AS (PARTITION BY p_brand)""")
def lowest_price_flag(t):
    return C.with_lowest(C.with_lowest(t("part"), "p_retailprice", by="p_brand"), "p_size").select("p_partkey", "p_retailprice", "lowest_p_retailprice", "lowest_p_size")


@query("""SELECT p_brand AS provider_id, bool_or(p_size < 10) AS has_per_token, bool_or(p_size >= 10 AND p_size < 30) AS has_subscription, bool_or(p_size >= 30) AS has_coding_plan, count(*) AS n_products, count(DISTINCT p_name) AS n_models FROM part GROUP BY 1""")
def provider_facets(t):
    kind = F.when(F.col("p_size") < 10, "per_token").when(F.col("p_size") < 30, "subscription").otherwise("coding_plan")
    return C.provider_flags(t("part").select(F.col("p_brand").alias("provider_id"), kind.alias("billing_type"), F.col("p_name").alias("model")))


@query("""
SELECT n_name AS provider, min(s_suppkey) AS first, string_agg(s_name, ',' ORDER BY s_suppkey) AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def order_preserving_groups(t):
    rows = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    grouped = C.groups_in_order(rows, "n_name", "s_suppkey", "s_name")
    return grouped.select(F.col("n_name").alias("provider"), "first", F.array_join(F.transform("rows", lambda r: r["s_name"]), ",").alias("names"))


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def semi_selection(t):
    return S.among(t("orders").select("o_orderkey", "o_custkey"), t("customer").where("c_acctbal < 0"), "o_custkey", "c_custkey").select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")
def anti_selection(t):
    return S.not_among(t("customer").select("c_custkey"), t("orders").where("o_totalprice > 250000"), "c_custkey", "o_custkey")


@query("""SELECT coalesce(n_nationkey, s_nationkey)::INT AS provider_id, n AS n_rows FROM (SELECT * FROM nation WHERE n_nationkey < 15) FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey WHERE n > 0""")
def full_outer_providers(t):
    providers = t("nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("provider_id"))
    return C.providers_with_rows(providers, t("supplier").select(F.col("s_nationkey").alias("provider_id")))


@query("""
SELECT (SELECT count(*) FROM orders) AS offer_count, (SELECT count(*) FROM supplier) AS plan_count, (SELECT count(*) FROM (SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier)) AS provider_count,
 (SELECT count(DISTINCT o_orderpriority) FROM orders) + (SELECT count(DISTINCT s_name) FROM supplier) AS source_count""")
def set_union_providers(t):
    offers = t("orders").select(F.col("o_custkey").alias("provider_id"), F.col("o_orderpriority").alias("source_id"))
    return history.counted(offers, t("supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("source_url")))


_ENTITY_SQL = "x"
for _name, _value in X.ENTITIES.items():
    _ENTITY_SQL = f"replace({_ENTITY_SQL}, '{_name}', '{_value.replace(chr(39), chr(39) * 2)}')"
_VISIBLE_SQL = f"""SELECT page_id, html, trim(regexp_replace({_ENTITY_SQL}, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS text FROM (
 SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\\b.*?</script\\s*>', ' ', 'g'),
  '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS x FROM pages)"""


@query(f"SELECT page_id, text, sha256(text) AS checksum FROM ({_VISIBLE_SQL})")
def page_visible_text(t):
    text = t("pages").select("page_id", X.visible_text(F.col("html")).alias("text"))
    return text.select("page_id", "text", P.checksum(F.col("text")).alias("checksum"))


@query("""
SELECT page_id, CASE WHEN strpos(html, '<article>') > 0 THEN substr(html, strpos(html, '<article>'), 200) ELSE '' END AS slice,
 CASE WHEN strpos(html, '<title>') > 0 AND strpos(html, '</title>') > 0 THEN substr(html, strpos(html, '<title>'), strpos(html, '</title>') - strpos(html, '<title>')) END AS title FROM pages""")
def page_window_extract(t):
    html = F.col("html")
    return t("pages").select("page_id", X.window_after(html, "<article>", 200).alias("slice"), X.window_between(html, "<title>", "</title>").alias("title"))


@query("""
SELECT doc_id, CAST(nullif(regexp_extract(text, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS first_number, list_max(list_transform(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?)', 1), lambda x: x::DOUBLE)) AS largest,
 len(list_distinct(list_transform(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?)', 1), lambda x: x::DOUBLE)))::INT AS n_distinct FROM documents""")
def regex_amounts(t):
    pattern = r"([0-9]+(?:\.[0-9]+)?)"
    found = t("documents").select("doc_id", "text", X.all_numbers(F.col("text"), pattern).alias("all"))
    return found.select("doc_id", X.first_number(F.col("text"), pattern).alias("first_number"), F.array_max("all").alias("largest"), F.size(F.array_distinct("all")).alias("n_distinct"))


@query(r"""
SELECT doc_id, len(c)::INT AS n_cells, c[1] AS first_cell, len(list_filter(c, lambda x: NOT regexp_full_match(x, '[:\- ]*'))) = 0 AS separator FROM
 (SELECT doc_id, list_transform(string_split(regexp_replace(l, '^\|+|\|+$', '', 'g'), '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS c FROM
  (SELECT doc_id, '|' || unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE len(c) > 1""")
def md_table_cells(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    cells = lines.select("doc_id", X.markdown_cells(F.concat(F.lit("|"), "line")).alias("c")).where(F.size("c") > 1)
    return cells.select("doc_id", F.size("c").alias("n_cells"), F.col("c")[0].alias("first_cell"), X.is_separator(F.col("c")).alias("separator"))


@query("""SELECT event_id, sha256('{"k":' || (props->>'$.k') || '}') AS checksum FROM events""")
def canonical_checksum(t):
    return t("events").select("event_id", P.checksum(P.canonical_json(F.col("props"))).alias("checksum"))


@query("""
SELECT p_partkey, CASE WHEN c >= 1000000 THEN CASE WHEN c % 1000000 = 0 THEN (c // 1000000)::VARCHAR ELSE printf('%.1f', c / 1000000.0) END || 'M' WHEN c >= 1000 THEN floor(c / 1000.0 + 0.5)::BIGINT::VARCHAR || 'K' ELSE c::VARCHAR END AS context
FROM (SELECT p_partkey, p_size * p_size * 1000::BIGINT AS c FROM part)""")
def format_context(t):
    return t("part").select("p_partkey", P.format_context((F.col("p_size") * F.col("p_size") * 1000).cast("bigint")).alias("context"))


@query("""
SELECT p_partkey, '$' || regexp_replace(regexp_replace(format('{:,.2f}', p_retailprice), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS price, CASE WHEN p_size = 1 THEN '免费' WHEN p_size = 2 THEN '—' ELSE '¥' || p_size END AS plan_price FROM part""")
def format_price(t):
    monthly = F.when(F.col("p_size") == 1, 0.0).when(F.col("p_size") > 2, F.col("p_size").cast("double"))
    return t("part").select("p_partkey", P.format_price(F.col("p_retailprice"), F.lit("USD")).alias("price"), P.format_plan_price(monthly, F.lit("CNY")).alias("plan_price"))


@query("""
SELECT event_id, h AS hours, CASE WHEN h < 1 THEN '刚刚' WHEN h < 24 THEN h || ' 小时前' ELSE (h // 24) || ' 天前' END AS freshness FROM (SELECT event_id, greatest(0, floor((epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - floor(epoch(ts))) / 3600.0))::BIGINT AS h FROM events)""")
def freshness_bucket(t):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return t("events").select("event_id", P.age_hours(F.col("ts").cast("timestamp"), now).alias("hours"), P.freshness(F.col("ts").cast("timestamp"), now).alias("freshness"))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'calls' WHEN 'purchase' THEN 'monetary' WHEN 'view' THEN 'prompts' ELSE 'other' END AS quota_type,
 CASE event_type WHEN 'view' THEN '输入 ≤ 32K' ELSE event_type END AS label FROM events""")
def quota_type_map(t):
    unit = P.lookup(F.col("event_type"), {"click": "requests", "purchase": "USD", "view": "prompts"})
    condition = F.when(F.col("event_type") == "view", "input_lte_32k").otherwise(F.col("event_type"))
    return t("events").select("event_id", P.quota_type(unit).alias("quota_type"), P.condition_label(condition).alias("label"))


@query("""
SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY b DESC NULLS LAST, s_suppkey) AS by_price, row_number() OVER (PARTITION BY s_nationkey ORDER BY b DESC NULLS FIRST, s_suppkey) AS by_table FROM
 (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS b FROM supplier)""")
def multi_sort_rank(t):
    rows = t("supplier").select("s_suppkey", "s_nationkey", F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("compare_input"))
    place = lambda order: F.row_number().over(W.partitionBy("s_nationkey").orderBy(*order)).cast("bigint")
    return rows.withColumns({"by_price": place(C.sort_columns("inputPrice:desc")), "by_table": place(C.table_order("compare_input", "desc"))}).select("s_suppkey", "by_price", "by_table")


@query("""SELECT n_name AS value, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1""")
def facet_counts(t):
    rows = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return C.facet_counts(rows, "n_name", where=F.col("c_acctbal") > 0).withColumnRenamed("n_name", "value")


@query("""SELECT pick::INT AS pick, p_partkey AS id, p_name FROM part JOIN (VALUES (0, 7), (1, 3), (2, 11)) v(pick, k) ON p_partkey = k""")
def selection_in_order(t):
    return C.selected(t("part").withColumnRenamed("p_partkey", "id").withColumn("id", F.col("id").cast("string")), ["7", "3", "11", "-5", "3"]).select("pick", F.col("id").cast("bigint").alias("id"), "p_name")


@query("""
SELECT count(*) AS n_sources, count_if(n >= 10)::BIGINT AS n_healthy, sum(n)::BIGINT AS n_rows, CASE WHEN bool_and(n >= 10) THEN 'healthy' ELSE 'degraded' END AS status FROM
 (SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)""")
def source_health(t):
    rows = t("supplier").select(F.col("s_nationkey").cast("string").alias("source_id"), F.col("s_acctbal").alias("input_per_1m"), F.lit(1.0).alias("output_per_1m"))
    expected = t("nation").select(F.col("n_nationkey").cast("string").alias("source_id"), F.lit(10).alias("minimum"))
    return Q.health(Q.source_report(rows, expected))


@query("""SELECT count_if(p_size % 2 = 0)::BIGINT AS n_cny, count_if(p_size % 2 = 1)::BIGINT AS n_usd, CASE WHEN count_if(p_size % 2 = 0) >= count_if(p_size % 2 = 1) THEN 'CNY' ELSE 'USD' END AS opens FROM part""")
def default_currency_tab(t):
    rows = t("part").select(F.when(F.col("p_size") % 2 == 0, "CNY").otherwise("USD").alias("currency"))
    return C.default_currency(rows)


def _plan_view(t) -> DataFrame:
    """Customers in the shape of plans: the balance is the monthly price, the nation the provider."""
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "coding_plan").when(F.col("c_mktsegment") == "HOUSEHOLD", "per_token").otherwise("subscription")
    monthly = F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 10)).cast("double")
    return rows.select(
        F.format_string("%010d", "c_custkey").alias("id"), kind.alias("billing_type"), F.col("n_nationkey").cast("string").alias("provider_id"), F.col("n_name").alias("provider_name"), F.col("c_name").alias("model"),
        monthly.alias("compare_monthly"), monthly.alias("monthly_equivalent"), F.when(F.col("c_custkey") % 3 == 0, "USD").when(F.col("c_custkey") % 3 == 1, "prompts").alias("quota_unit"),
        (F.col("c_custkey") % 7 == 0).alias("featured_on_home"), F.col("c_custkey"),
    )


_PLANS_SQL = """(SELECT printf('%010d', c_custkey) AS id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'coding_plan' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'per_token' ELSE 'subscription' END AS billing_type,
 n_nationkey, n_name, n_regionkey, c_name AS model, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal / 10)::DOUBLE END AS monthly, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""
SELECT id, model, monthly AS compare_monthly FROM {_PLANS_SQL} WHERE billing_type = 'coding_plan' AND contains(lower(n_name) || ' ' || lower(model), 'nation_1') AND monthly > 0 AND monthly >= 150 AND monthly < 500 AND c_custkey % 3 = 0""")
def plan_page(t):
    return C.PlanQuery("coding_plan", search="Nation_1", kind="paid", price="150to500", quota="monetary").run(_plan_view(t)).select("id", "model", "compare_monthly")


@query(f"""
SELECT id, row_number() OVER (PARTITION BY n_nationkey ORDER BY monthly ASC NULLS LAST, model, id)::BIGINT AS upward, row_number() OVER (PARTITION BY n_nationkey ORDER BY monthly DESC NULLS LAST, model, id)::BIGINT AS downward,
 row_number() OVER (PARTITION BY n_nationkey ORDER BY n_name, monthly ASC NULLS LAST, id)::BIGINT AS listed FROM {_PLANS_SQL} WHERE billing_type = 'subscription'""")
def plan_orders(t):
    place = lambda order: F.row_number().over(W.partitionBy("provider_id").orderBy(*order)).cast("bigint")
    up, down = C.PlanQuery("subscription"), C.PlanQuery("subscription", descending=True)
    return _plan_view(t).where(up.where()).select("id", place(up.order()).alias("upward"), place(down.order()).alias("downward"), place(C.billing_order()).alias("listed"))


@query(f"""SELECT n_nationkey::VARCHAR AS provider_id, n_name AS provider_name, count(*) AS n FROM {_PLANS_SQL} WHERE billing_type = 'coding_plan' GROUP BY ALL""")
def plan_provider_options(t):
    return C.plan_providers(_plan_view(t), "coding_plan")


@query(f"""SELECT id, monthly AS monthly_equivalent FROM {_PLANS_SQL} WHERE billing_type <> 'per_token' AND c_custkey % 7 = 0 AND monthly IS NOT NULL""")
def featured_plans(t):
    return C.featured_plans(_plan_view(t)).select("id", "monthly_equivalent")


def _statuses(t) -> DataFrame:
    """Nations in the shape of provider statuses; some have none."""
    return t("nation").where("n_regionkey <> 4").select(F.col("n_nationkey").cast("string").alias("provider_id"), F.lit("ok").alias("status"), F.when(F.col("n_regionkey") != 3, F.col("n_regionkey") == 1).alias("stale"))


@query(f"""SELECT id, CASE WHEN n_regionkey <> 4 THEN 'ok' END AS provider_status, n_regionkey = 1 AS stale FROM {_PLANS_SQL}""")
def provider_status_join(t):
    return C.with_status(_plan_view(t), _statuses(t)).select("id", "provider_status", "stale")


@query(f"""
SELECT *, subscription + coding_plan AS plans, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS n_stale, (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (1, 4)) AS n_fresh FROM (
 SELECT count_if(billing_type = 'per_token' AND n_regionkey <> 1)::BIGINT AS per_token, count_if(billing_type = 'subscription' AND n_regionkey <> 1)::BIGINT AS subscription,
  count_if(billing_type = 'coding_plan' AND n_regionkey <> 1)::BIGINT AS coding_plan, count(*) AS n_rows FROM {_PLANS_SQL})""")
def billing_totals(t):
    return C.billing_totals(C.with_status(_plan_view(t), _statuses(t))).crossJoin(C.status_totals(_statuses(t)))


@query("""
SELECT n_nationkey::VARCHAR AS provider_id, n_name AS name, CASE WHEN r_name = 'ASIA' THEN 'cn' ELSE 'intl' END AS region_group FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE contains(lower(n_name), 'i') OR contains(lower(r_name), 'i') OR contains(n_nationkey::VARCHAR, 'i')""")
def provider_search_by_region(t):
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    providers = rows.select(F.col("n_nationkey").cast("string").alias("provider_id"), F.col("n_name").alias("name"), F.col("r_name").alias("name_en"), F.when(F.col("r_name") == "ASIA", "cn").otherwise("us").alias("region"))
    return C.by_region(C.search_providers(providers, " I ")).select("provider_id", "name", "region_group")


@query("""SELECT n_nationkey::VARCHAR AS provider_id FROM nation WHERE contains(lower(n_name), 'a') ORDER BY n_nationkey::VARCHAR LIMIT 8""")
def provider_suggestions(t):
    providers = t("nation").select(F.col("n_nationkey").cast("string").alias("provider_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("name_en"))
    return C.search_providers(providers, "a", C.SUGGESTIONS).select("provider_id")


@query("""SELECT printf('%010d', p_partkey) AS id, p_name AS model FROM part WHERE contains(lower(p_name) || ' ' || lower(p_brand), 'brand#1') AND p_partkey <> 4 ORDER BY p_size DESC, p_brand COLLATE zh, p_name COLLATE zh, id LIMIT 60""")
def model_picker(t):
    rows = _part_view(t).drop("release_date").join(t("part").select(F.format_string("%010d", "p_partkey").alias("id"), F.format_string("%04d", "p_size").alias("release_date")), "id")
    return C.candidates(rows, "brand#1", ("0000000004",)).select("id", "model")


#: The page of lines by price that deep_page asks for, and how many rows it has.
DEEP_PAGE, DEEP_SIZE = 100, 50


def _line_keys() -> tuple[SortKey, ...]:
    return SortKey(F.nullif(F.col("l_extendedprice"), F.lit(0)), True), SortKey(F.col("l_shipdate")), SortKey(F.col("l_orderkey")), SortKey(F.col("l_linenumber"))


_LINE_ORDER = "nullif(l_extendedprice, 0) DESC NULLS LAST, l_shipdate ASC NULLS LAST, l_orderkey, l_linenumber"


@query(f"""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY {_LINE_ORDER} LIMIT {DEEP_SIZE} OFFSET {(DEEP_PAGE - 1) * DEEP_SIZE}""")
def deep_page(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    index = page_index(lines, _line_keys(), new_table_path(lines.sparkSession))
    return index.page(DEEP_PAGE, DEEP_SIZE).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"""
SELECT p_partkey, p_type, p_retailprice FROM part
WHERE p_type < 'PROMO' OR (p_type = 'PROMO' AND (p_retailprice > 1000 OR (p_retailprice = 1000 AND p_partkey > 7))) ORDER BY p_type DESC, p_retailprice, p_partkey LIMIT {DEEP_SIZE}""")
def keyset_page(t):
    keys = SortKey(F.col("p_type"), True), SortKey(F.col("p_retailprice")), SortKey(F.col("p_partkey"))
    return next_page(t("part").select("p_partkey", "p_type", "p_retailprice"), keys, '["PROMO", 1000.0, 7]', DEEP_SIZE)


@query("""
SELECT 'under10' AS filter, count(*) AS n FROM part WHERE p_retailprice / 200 < 10 UNION ALL
SELECT 'longContext', count(*) FROM part WHERE p_size * 8000 >= 200000 UNION ALL
SELECT 'vision', count(*) FROM part WHERE list_contains(string_split(replace(p_name, 'widget', 'vision'), ' '), 'vision')""")
def quick_filters(t):
    rows = t("part").select((F.col("p_retailprice") / 200).alias("compare_input"), (F.col("p_size") * 8000).alias("context_window"), F.split(F.replace("p_name", F.lit("widget"), F.lit("vision")), " ").alias("modalities"))
    passed = F.array(*(F.when(C.quick_filter(q), F.lit(q)) for q in ("under10", "longContext", "vision")))
    return rows.select(F.explode(F.array_compact(passed)).alias("filter")).groupBy("filter").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT printf('%010d', p_partkey) AS id, p_name AS model FROM part WHERE contains(lower(p_name) || '|' || lower(p_brand), 'blue') AND p_partkey NOT IN (8, 9)
ORDER BY p_size DESC, p_brand COLLATE zh, p_name COLLATE zh, id LIMIT 40""")
def comparison_picker(t):
    rows = t("part").select(
        F.format_string("%010d", "p_partkey").alias("id"), F.lit("per_token").alias("billing_type"), F.col("p_brand").alias("provider_name"), F.col("p_name").alias("model"), F.format_string("%04d", "p_size").alias("release_date")
    )
    return C.compare_candidates(rows, "Blue", ("0000000008", "0000000009")).select("id", "model")


@query("""
SELECT o_orderpriority AS source_id, count(*) AS n_rows, count_if(o_totalprice < 0) AS n_negative, (SELECT count(*) FROM orders) AS n_seen,
 (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')::VARCHAR AS first_bad FROM orders GROUP BY o_orderpriority""")
def gate_on_write(t):
    """A gate that the job that writes the table measures; the table is then read as written."""
    rows = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    gate, path = Q.Gate("o_orderkey", (Q.RowRule("open", F.col("o_orderstatus") == "P"),)), new_table_path(rows.sparkSession)
    gate.watched(rows).write.parquet(path)
    found, written = gate.observation.get, rows.sparkSession.read.schema(rows.schema).parquet(path)
    bad = found["bad"]["key"] if found["bad"] else None
    counts = written.groupBy(F.col("o_orderpriority").alias("source_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("o_totalprice") < 0).alias("n_negative"))
    return counts.select("*", F.lit(found["n"]).cast("bigint").alias("n_seen"), F.lit(bad).cast("string").alias("first_bad"))


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'red w') OR contains(lower(p_brand), 'red w')""")
def indexed_search(t):
    rows = t("part").select("p_partkey", "p_name", "p_brand")
    return search_index(rows, ("p_name", "p_brand"), new_table_path(rows.sparkSession)).search("Red W")


#: Labels looked for in every document: words, and patterns.
LABELS = {"and": " and ", "der": " der ", "license": "Licensed under", "line": "\n", "number": "[0-9]{3}", "que": "que[ .,]"}
_LABEL_ROWS = ", ".join(f"('{slug}', {k})" for k, slug in enumerate(LABELS))


@query(f"""
WITH found AS (
 SELECT doc_id, text, slug, CASE slug WHEN 'and' THEN strpos(text, ' and ') WHEN 'der' THEN strpos(text, ' der ') WHEN 'license' THEN strpos(text, 'Licensed under') WHEN 'line' THEN strpos(text, chr(10))
  WHEN 'number' THEN coalesce(strpos(text, nullif(regexp_extract(text, '[0-9]{{3}}'), '')), 0) ELSE coalesce(strpos(text, nullif(regexp_extract(text, 'que[ .,]'), '')), 0) END AS at_
 FROM documents, (VALUES {_LABEL_ROWS}) v(slug, k)
), wide AS (
 SELECT *, least(coalesce(lead(at_) OVER (PARTITION BY doc_id ORDER BY at_, slug) - at_, length(text) + 1 - at_, 700), 700) AS w FROM found WHERE at_ > 0
) SELECT doc_id::VARCHAR AS source_id, slug, at_::INT AS at, substr(text, at_, w) AS said FROM wide""")
def label_windows(t):
    pages = t("documents").select(F.col("doc_id").cast("string").alias("source_id"), "text")
    specs = pages.sparkSession.createDataFrame(list(LABELS.items()), "slug string, label string")
    return spec_windows(pages, specs).select("source_id", "slug", "at", F.col("window").alias("said"))


@query(f"""
SELECT max(CASE WHEN r.rate > 0 THEN '2026-01-02' END) AS reference_date, count(CASE WHEN r.rate > 0 THEN 1 END) AS n_rows
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (VALUES {_RATE_ROWS}) r(currency, rate) ON upper(n_name) = r.currency""")
def rates_reference_date(t):
    suppliers = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return fx.reference_date(fx.with_rate(suppliers, _rates(suppliers), "n_name"))


@query(f"""
SELECT page_id, v.text AS text, len(h.said)::BIGINT AS n_headings, trim(regexp_replace({_ENTITY_SQL}, '\\s+', ' ', 'g')) AS first_heading
FROM ({_VISIBLE_SQL}) v JOIN (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6]>(.*?)</h[1-6]>', 1) AS said, regexp_replace(said[1], '<[^>]+>', ' ', 'g') AS x FROM pages) h USING (page_id)""")
def page_parts_of(t):
    parts = page_parts(t("pages").select(F.col("page_id").alias("source_id"), F.col("html").alias("body")))
    return parts.select(F.col("source_id").cast("bigint").alias("page_id"), "text", F.size("headings").cast("bigint").alias("n_headings"), F.try_element_at("headings", F.lit(1))["text"].alias("first_heading"))
