"""What each filter removes under every order of the filters, from one pass over the documents."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tariffgrid.llm.common import SPACE, read_table

#: Filters by letter: the condition under which a document fails, over `text` and its measures.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 50,
    "B": lambda: 100 * F.col("n_distinct") < 65 * F.col("n_words"),
    "C": lambda: 100 * F.col("n_upper") > 5 * F.col("n_chars"),
    "D": lambda: F.col("text").rlike(r"[#$%&*|]"),
}
#: The letter of the filter on texts that a smaller id has already.
COPIES = "E"
#: Beyond so many filters the orders (k! of them) are too many for a report.
MOST_FILTERS = 7
_BLANKS = " \t\n\x0b\f\r"


def lehmer_rank(first: str, letters: str) -> int:
    """The number, in lexicographic order, of the first permutation of letters that begins so."""
    left, rank = sorted(letters), 0
    for c in first:
        rank += left.index(c) * math.factorial(len(left) - 1)
        left.remove(c)
    return rank


def removal_intervals(letters: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, lo, hi): documents failing just the mask's filters go at that step in the orders lo to hi - 1.

    They go at step s where an order's first s - 1 letters are outside the mask and the
    next is in it; all orders that share these s letters are neighbours. Bit i of a mask is
    the i-th letter. Intervals of a mask and step that touch are one.
    """
    found = []
    for mask in range(1, 1 << len(letters)):
        inside = [c for i, c in enumerate(letters) if mask >> i & 1]
        outside = [c for c in letters if c not in inside]
        for step in range(1, len(outside) + 2):
            width = math.factorial(len(letters) - step)
            starts = {lehmer_rank("".join(before) + c, letters) for before in permutations(outside, step - 1) for c in inside}
            ends = {lo + width for lo in starts}
            found += [(mask, step, lo, hi) for lo, hi in zip(sorted(starts - ends), sorted(ends - starts))]
    return found


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_distinct, n_upper and n_chars of `text`."""
    trimmed = F.btrim("text", F.lit(_BLANKS))
    split = docs.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    return split.select(
        *docs.columns,
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length("text").cast("long").alias("n_chars"),
    )


def fail_masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[], Column]], copies: str | None) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents fail exactly the mask's filters. docs: id, part, text.

    Conditions on the text are a projection. Copies are found by the text's sha-256: rows
    are counted by (digest, id, ...), then by digest without the id, each time pre-summed
    by task, so that no row of a document ever meets the others of a large group; the
    least id is then joined to what is left of a digest, a few counts.
    """
    letters = sorted([*filters, *([copies] if copies else [])])
    bit = {c: 1 << i for i, c in enumerate(letters)}
    mask = sum((F.coalesce(failed(), F.lit(False)).cast("int") * bit[c] for c, failed in filters.items()), F.lit(0))
    marked = _measured(docs).select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    of = labels.groupBy("id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    marked = marked.join(of.where("id IS NOT NULL").withColumnRenamed("id", "labelled"), F.col("id") == F.col("labelled"), "left")
    flags = ("part", "mask", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("good", "toxic")))
    sums = (F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    if copies is None:
        return marked.select(*flags, F.lit(1).cast("long").alias("n")).groupBy("part", "mask").agg(*sums)
    by_id = marked.select("digest", "id", *flags).groupBy("digest", "id", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    first = by_text.groupBy("digest").agg(F.min("least").alias("first"))
    n_first = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    halves = F.array(F.struct(F.col("mask").alias("mask"), n_first.alias("n")), F.struct((F.col("mask") + bit[copies]).alias("mask"), (F.col("n") - n_first).alias("n")))
    told = by_text.join(first, "digest").select("part", "good", "toxic", F.inline(halves))
    return told.where("n > 0").groupBy("part", "mask").agg(*sums)


def audit_filters(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: dict[str, Callable[[], Column]] = FILTERS, copies: str | None = COPIES
) -> DataFrame:
    """One row for every part, order of the filters and step: what goes, what stays, and why.

    Documents are summed to counts by part and mask of failed filters (32 at most for five).
    A mask's removal step is constant on few intervals of the lexicographic order of all
    orders: its counts are added where one starts and taken away where it ends, and running
    sums over the ranks give what goes in each order. All of it follows one exchange by part.

    filters: letter to a condition over text, n_words, n_distinct, n_upper, n_chars; a null
    condition passes. copies: the letter of the filter on texts that a smaller id has.
    labels: (id, quality, toxic); rows that repeat an id count as one, with the larger label.

    Defined results: a null text is an empty one; a null part is the empty string; a null id
    is no copy, makes none and has no label; rows that repeat an id and text are documents of
    their own, none a copy of the other; an empty table gives no rows; extra columns are
    ignored. Texts are read whole.
    """
    letters = "".join(sorted([*filters, *([copies] if copies else [])]))
    if len(set(letters)) != len(letters) or len(letters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters of different letters")
    spark, k, n_orders = docs.sparkSession, len(letters), math.factorial(len(letters))
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cells = fail_masks(narrow, labels.select(F.col(id_col).alias("id"), "quality", "toxic"), filters, copies)

    ends = [(mask, step, at, sign) for mask, step, lo, hi in removal_intervals(letters) for at, sign in ((lo, 1), (hi, -1)) if at < n_orders]
    ends_table = spark.createDataFrame(ends, "mask int, step int, at int, sign int")  # fixed by the number of filters
    none = {c: F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic", "total", "fails", "unique_fails")}
    steps = cells.join(F.broadcast(ends_table), "mask").select(
        "part", "step", "at", *((F.col(c) * F.col("sign")).alias(c) for c in ("n", "good", "toxic")), none["total"], F.array().cast("array<struct<letter:string,fails:bigint,alone:bigint>>").alias("by_letter")
    )
    fails = lambda i: F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0))
    alone = lambda i: F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0))
    parts = cells.groupBy("part").agg(
        F.sum("n").alias("total"), F.array(*(F.struct(F.lit(c).alias("letter"), fails(i).alias("fails"), alone(i).alias("alone")) for i, c in enumerate(letters))).alias("by_letter")
    )
    places = F.array(*(F.struct(F.lit(s).alias("step"), F.lit(r).alias("at")) for s in range(1, k + 1) for r in range(n_orders)))
    grid = parts.select("part", F.inline(places), none["n"], none["good"], none["toxic"], "total", "by_letter")
    return _report(steps.unionByName(grid), letters)


def _report(diffs: DataFrame, letters: str) -> DataFrame:
    """Running sums of (part, step, at) differences, told by order and step."""
    orders = ["".join(p) for p in permutations(letters)]
    summed = diffs.repartition("part").groupBy("part", "step", "at").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic", "total")), F.flatten(F.collect_list("by_letter")).alias("by_letter"))
    run = W.partitionBy("part", "step").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    order = F.element_at(F.array(*map(F.lit, orders)), F.col("at") + 1)
    told = summed.select("part", "step", "at", "total", "by_letter", order.alias("filter_order"), *(F.sum(c).over(run).alias(c) for c in ("n", "good", "toxic")))
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    own = F.get(F.filter("by_letter", lambda x: x["letter"] == F.col("letter")), F.lit(0))
    told = told.withColumn("letter", letter).withColumn("own", own)
    so_far = W.partitionBy("part", "at").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return told.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(so_far)).alias("kept"),
        F.col("n").alias("removed"),
        (F.col("own")["fails"] - F.col("n")).alias("redundant"),
        F.col("own")["alone"].alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(W.partitionBy("part", "letter")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters under all 120 orders, for every source of the documents."""
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN l USING (doc_id)
), cells AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                      CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), orders AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5
), gone AS (
  SELECT part, filter_order, fails, n, good, toxic,
         list_min(list_filter(range(1, 6), lambda i: contains(fails, filter_order[i]))) AS gone_at FROM cells, orders
), steps AS (
  SELECT part, filter_order, step, filter_order[step] AS letter,
         sum(CASE WHEN gone_at IS NULL OR gone_at > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone_at < step AND contains(fails, filter_order[step]) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone_at = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone_at = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM gone, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps
"""
