"""Quality rules: one threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffgrid.llm.common import let, read_table, text_words

#: Words of a window for repeats, and the base rule's limits.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
#: The most frequent function words of the four languages served.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "are", "this", "an", "or", "from"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
}


@dataclass(frozen=True)
class Rule:
    """A document passes if least <= metric <= most; a bound of None is open."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The method's thresholds, over the metrics of METRICS. The bounds lie well outside of
#: what running prose in the four languages shows, short texts included.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.05),
    Rule("letter_word_ratio", 0.6, None),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("upper_ratio", None, 0.6),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _repeat_words(words: Column) -> Column:
    """Words lying in a WINDOW-word window that occurs twice or more in the text."""

    def covered(hashes: Column) -> Column:
        # Windows in order of (hash, place): a repeated window has an equal neighbour.
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            hit = F.filter(s, lambda x, k: same(k - 1, x) | same(k + 1, x))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(placed, places), length)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    # Most texts repeat nothing: a set of the hashes tells, before anything is sorted.
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= WINDOW, some).otherwise(F.lit(0).cast("long"))


def quality_metrics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with one struct column `quality` of counts and ratios of each whole text.

    A null text counts as no words. An existing column `quality` is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = text_words(text)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.array(*(F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws})))
    counts = let(
        F.struct(text.alias("t"), words.alias("w"), lines.alias("l")),
        lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
            (F.length(x["t"]) - F.length(F.regexp_replace(x["t"], r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            F.size(x["l"]).cast("long").alias("n_lines"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
            _repeat_words(x["w"]).alias("n_repeat_words"),
            F.size(F.filter(x["w"], lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
            F.size(F.filter(x["w"], lambda w: F.array_contains(stop, F.lower(F.rtrim(w, F.lit(".,;:!?")))))).cast("long").alias("n_stop_words"),
            (F.length(x["t"]) - F.length(F.regexp_replace(x["t"], r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        ),
    )
    return docs.withColumn("quality", counts)


def _metric(name: str) -> Column:
    q = lambda c: F.col("quality")[c]
    return {
        "n_words": q("n_words"),
        "mean_word_chars": _ratio(q("word_chars"), q("n_words")),
        "symbol_ratio": _ratio(q("n_symbols"), q("word_chars")),
        "letter_word_ratio": _ratio(q("n_letter_words"), q("n_words")),
        "stop_word_ratio": _ratio(q("n_stop_words"), q("n_words")),
        "dup_line_ratio": _ratio(q("n_dup_lines"), q("n_lines")),
        "upper_ratio": _ratio(q("n_upper"), q("word_chars")),
        "repeat_ratio": _ratio(q("n_repeat_words"), q("n_words")),
    }[name]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean column: every metric lies within its bounds."""
    passed = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            passed = passed & (_metric(rule.metric) >= rule.least)
        if rule.most is not None:
            passed = passed & (_metric(rule.metric) <= rule.most)
    return passed


def base_failed() -> Column:
    q = F.col("quality")
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict of every row of docs, one projection without a shuffle.

    Defined results: a null text is one without words and fails the base rule; repeated
    rows are each reported; a null id is carried; extra columns are ignored; an empty
    table gives no rows. Texts are read whole, however long.
    """
    q = F.col("quality")
    narrow = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    measured = quality_metrics(narrow).select(F.col(id_col), "quality")
    return measured.select(
        id_col,
        *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed().alias("base_failed"),
        (~base_failed() & compile_rules(rules)).alias("kept"),
    )


def keep_good(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the base rule and the table keep, columns as they were."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    return quality_metrics(held).where(~base_failed() & compile_rules(rules)).select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every document."""
    return quality_report(read_table(spark, sf_dir, "documents"))


def _sql_stop() -> str:
    return ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT *, CASE WHEN len(w) >= {WINDOW} THEN list_transform(range(1, len(w) - {WINDOW - 2}),
           lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' ')) ELSE [] END AS g
  FROM w
), r AS (
  SELECT k, i FROM (SELECT rowid_ AS k, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM (SELECT *, row_number() OVER () AS rowid_ FROM g))
  QUALIFY count(*) OVER (PARTITION BY k, x) > 1
), n AS (
  SELECT k, sum(step)::BIGINT AS n FROM (
    SELECT k, least(coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, {WINDOW}), {WINDOW}) AS step FROM r) GROUP BY k
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
         len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_sql_stop()})))::BIGINT AS n_stop_words,
         (length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')))::BIGINT AS n_upper
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM g) g LEFT JOIN n ON n.k = g.rowid_
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_chars / nullif(n_words, 0) BETWEEN 2.0 AND 14.0
         AND n_symbols / nullif(word_chars, 0) <= 0.05 AND n_letter_words / nullif(n_words, 0) >= 0.6
         AND n_stop_words / nullif(n_words, 0) >= 0.02 AND n_dup_lines / nullif(n_lines, 0) <= 0.5
         AND n_upper / nullif(word_chars, 0) <= 0.6, FALSE) AS kept
FROM b
"""
