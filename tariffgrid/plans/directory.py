"""Offers from a JSON directory of providers and their models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffgrid.functions.pricing import distinct_in_order, integer, number, offer_id, service_tier
from tariffgrid.operators.selection import known_only
from tariffgrid.schema import as_offers

#: Directory key, catalog id, name and region of the providers taken, in order.
PROVIDERS = (
    ("anthropic", "anthropic", "Anthropic", "us"),
    ("amazon-bedrock", "aws", "AWS", "us"),
    ("deepseek", "deepseek", "DeepSeek", "cn"),
    ("google", "google", "Google", "us"),
    ("minimax-cn", "minimax", "MiniMax", "cn"),
    ("moonshotai-cn", "moonshot", "Kimi", "cn"),
    ("openai", "openai", "OpenAI", "us"),
    ("alibaba-cn", "qwen", "阿里通义", "cn"),
    ("xiaomi", "xiaomi", "小米", "cn"),
    ("zhipuai", "zhipu", "智谱", "cn"),
)


def provider_table(spark: SparkSession) -> DataFrame:
    rows = [(k, *p) for k, p in enumerate(PROVIDERS)]
    return spark.createDataFrame(rows, "provider_rank int, directory_provider_id string, provider_id string, provider_name string, region string")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc variant) of each JSON file; a document that is no object is an error."""
    docs = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    if docs.where("doc is null or not startswith(schema_of_variant(doc), 'OBJECT')").head(1):
        raise ValueError("the directory must be a JSON object")
    return docs


def directory_offers(docs: DataFrame, fetched_at: str, source_url: str = "") -> DataFrame:
    """Offers of the known providers' models that have an input or an output price.

    Members that are no objects are passed over. Rows have no order of their own: the
    catalog orders by provider as listed, then by offer id.
    """
    spark = docs.sparkSession
    providers = spark.sql("select p.key as directory_provider_id, p.value as provider from {docs}, lateral variant_explode(doc) p where startswith(schema_of_variant(p.value), 'OBJECT')", docs=docs)
    known = known_only(providers, F.broadcast(provider_table(spark)), "directory_provider_id")  # ten rows
    models = spark.sql(
        "select d.*, m.key as model_key, m.value as model from {known} d, lateral variant_explode_outer(try_variant_get(provider, '$.models', 'variant')) m "
        "where m.key is not null and startswith(schema_of_variant(m.value), 'OBJECT')",
        known=known,
    )
    get = lambda path, kind="string": F.try_variant_get("model", path, kind)
    price = {c: number(get(f"$.cost.{k}")) for c, k in (("input_per_1m", "input"), ("output_per_1m", "output"), ("cache_read_per_1m", "cache_read"), ("cache_write_per_1m", "cache_write"))}
    tier = service_tier(F.col("model_key"), get("$.name"))
    priced = models.withColumns(price).where("input_per_1m is not null or output_per_1m is not null")
    rows = priced.select(
        "provider_rank", "model_key", "directory_provider_id", "provider_id", "provider_name", "region", *price,
        offer_id(F.col("directory_provider_id"), F.col("model_key"), F.lit("global"), F.lit("unspecified_endpoint"), tier, F.lit("standard")).alias("offer_id"),
        F.coalesce(F.nullif(get("$.id"), F.lit("")), "model_key").alias("model_id"), F.coalesce(F.nullif(get("$.name"), F.lit("")), "model_key").alias("model_name"), tier.alias("service_tier"),
        integer(get("$.limit.context")).alias("context_window"), integer(get("$.limit.output")).alias("max_output_tokens"),
        distinct_in_order(get("$.modalities.input", "array<string>"), get("$.modalities.output", "array<string>")).alias("modalities"),
        get("$.knowledge").alias("knowledge_cutoff"), get("$.release_date").alias("release_date"), get("$.last_updated").alias("source_updated_at"),
        F.coalesce(F.nullif(F.try_variant_get("provider", "$.doc", "string"), F.lit("")), F.lit(source_url)).alias("source_url"),
        F.lit(fetched_at).alias("fetched_at"), F.to_json("model").alias("raw"),
    )
    return as_offers(rows)
