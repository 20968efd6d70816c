"""Mix sources to target weights by nested hash thresholds, without sorting documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tariffgrid.llm.common import durable, read_table, text_words

#: Weights that the sources take in turn, in code point order, null last.
WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
#: Bits of the document hash that one histogram level resolves, and the hash's length.
LEVEL_BITS, HASH_BITS = 12, 60
#: Rows up to which the table of sources is broadcast (a source name is cut from no row;
#: 10,000 of them with four numbers stay under a few MB).
BROADCAST_SOURCES = 10_000


def _hash(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 over id and text: rows that agree in both are one unit."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with `place`, the number of each row (from 0) in code point order of source, null last.

    Rows are sorted by ranges, numbered within each, and the ranges' sizes, one number
    each, are summed up: no task holds more than its range.
    """
    cut = durable(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    ranges = cut.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = ranges.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = cut.withColumn("part", part).join(F.broadcast(before.select("part", "before")), "part")  # one row a range
    return placed.withColumn("place", F.col("before") + F.col("at") - F.shiftleft("part", 33)).select("source", "source_size", "place")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Targets for a table (source, source_size) of one row a source.

    The whole of all sizes is shared by weight; a target stops at `most` times its
    source's size and the excess goes to the others by weight, until none is above. Each
    round is one aggregation; the sources capped so far only grow, so few rounds are needed.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = durable(_ranked(sizes).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    left, share, capped = 0, 1, -1
    while True:
        # Above its cap: left * weight / share > cap; in integers, as long as the sums are.
        over = F.lit(left).cast("decimal(38,0)") * F.col("weight") > F.col("cap").cast("decimal(38,0)") * F.lit(share) if capped >= 0 else F.lit(False)
        free = F.when(~over, F.col("weight"))
        got = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("cap"))).alias("caps"), F.sum(free).alias("free"), F.count_if(over).alias("n")).first()
        if got["n"] == capped or got["all"] is None or not got["free"]:
            break
        left, share, capped = got["all"] - (got["caps"] or 0), got["free"], got["n"]
    target = F.when(over, F.col("cap").cast("double")).otherwise(F.lit(left) * F.col("weight").cast("double") / F.lit(share))
    return table.select("source", "source_size", target.alias("target"))


def _beside(docs: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """docs with the row of their source; a large table of sources is joined by shuffle, where AQE splits hot keys."""
    named = table.withColumnRenamed("source", "source beside")
    return docs.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("source beside")), "left").drop("source beside")


def _boundary(units: DataFrame, open_: DataFrame, key: str, few: bool) -> DataFrame:
    """(source, value, below, size, n, rest) of the unit, by the hash `key`, at which each source's running sum reaches its rest.

    Histograms of 4,096 buckets over (source, hash): running sums give the bucket that holds
    the boundary, and only that bucket is resolved by the next bits. open_: (source, rest).
    """
    open_ = open_.select("source", "rest", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    done, shift = None, HASH_BITS
    while shift > 0:
        inside = _beside(units, open_.select("source", "prefix", "rest", F.col("below").alias("base")), few).where(F.col("rest").isNotNull() & (F.shiftright(key, shift) == F.col("prefix")))
        shift -= LEVEL_BITS
        bars = inside.groupBy("source", F.shiftright(key, shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.first("rest").alias("rest"), F.first("base").alias("base")
        )
        upto = W.partitionBy("source").orderBy("bucket")
        run = bars.withColumn("above", F.col("base") + F.sum("size").over(upto)).withColumn("below", F.col("above") - F.col("size"))
        edge = run.where((F.col("above") >= F.col("rest")) & (F.col("below") < F.col("rest"))).groupBy("source").agg(F.min(F.struct("bucket", "below", "size", "n", "lo", "hi", "rest")).alias("e"))
        edge = durable(edge.select("source", "e.*"))
        single = (F.col("lo") == F.col("hi")) | F.lit(shift <= 0)
        found = edge.where(single).select("source", F.col("hi").alias("value"), "below", "size", "n", "rest")
        done = found if done is None else done.unionByName(found)
        open_ = edge.where(~single).select("source", "rest", "below", F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
    return done


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """One row (id, size, source_size, target, taken) for every row of docs.

    Each source is taken whole as often as its target allows, and the rest of its target
    from the documents whose hash lies under the source's threshold. The kept sets are
    nested: a larger target keeps all that a smaller one keeps. The boundary document goes
    whichever way is nearer to the target. If rows alike in id and text stand there, so many
    of them are taken as the target needs, found by a second threshold over a number that
    the rows got when their sizes were stored; which of the like rows doesn't show.

    Defined results: a null or wordless text has size 0; a null source is a source, last
    in order; repeated rows are documents of their own; a null id is carried; an empty table
    gives no rows; extra columns are ignored. Reruns agree.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    units = base.select("id", "source", F.size(text_words(F.col("text"))).cast("long").alias("size"), _hash(F.col("id"), F.col("text")).alias("h"))
    units = durable(units.withColumn("copy", F.shiftright(F.abs(F.xxhash64(F.monotonically_increasing_id())), 63 - HASH_BITS)))
    sizes = durable(source_targets(units.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    few = sizes.count() <= BROADCAST_SOURCES

    # Whole passes, and what is left of the target for the partial one.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sizes.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    at = _boundary(units, plan.select("source", "rest"), "h", few)
    nearer = (F.col("below") + F.col("size") - F.col("rest")) <= (F.col("rest") - F.col("below"))
    edges = at.where("n = 1").select("source", "value", F.when(nearer, F.lit((1 << HASH_BITS) - 1)).otherwise(F.lit(-1)).alias("last"))
    copies = durable(at.where("n > 1"))
    if not copies.isEmpty():
        of = copies.select("source", F.col("value").alias("h0"), (F.col("rest") - F.col("below")).alias("rest"))
        like = _beside(units, of.select("source", "h0"), few).where("h = h0")
        inner = _boundary(like, of, "copy", few).select("source", F.when(nearer, F.col("value")).otherwise(F.col("value") - 1).alias("last"))
        edges = edges.unionByName(_beside(copies.select("source", "value"), inner, few))

    plan = _beside(plan, edges, few)
    # No boundary: nothing is left to take, or (by rounding) all of the source.
    end = F.when(F.col("rest") <= 0, F.lit(-1)).otherwise(F.coalesce("value", F.lit(1 << HASH_BITS)))
    chosen = _beside(units, plan.select("source", "source_size", "target", "passes", end.alias("end"), "last"), few)
    once = (F.col("h") < F.col("end")) | (F.col("h") == F.col("end")) & (F.col("copy") <= F.col("last"))
    return chosen.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("passes") + once.cast("long"))).alias("taken"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix_sources(read_table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE u AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:15])::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM u GROUP BY source)
), fill AS (
  SELECT 0 AS turn, source, source_size, cap, weight, FALSE AS capped FROM s
  UNION ALL
  SELECT turn + 1, source, source_size, cap, weight,
         capped OR (sum(source_size) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight
                   > cap * sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()
  FROM fill WHERE turn < (SELECT count(*) FROM s)
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
         ELSE ((sum(source_size) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight)::DOUBLE
              / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target
  FROM fill WHERE turn = (SELECT count(*) FROM s)
), p AS (
  SELECT u.doc_id, u.size, u.h, t.source, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS passes
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, target - passes * source_size AS rest, (sum(size) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING))::DOUBLE AS above FROM p
)
SELECT doc_id, size, source_size, target,
       size * (passes + CASE WHEN rest > 0 AND above - size < rest AND (above < rest OR above - rest <= rest - (above - size)) THEN 1 ELSE 0 END) AS taken
FROM q
"""
