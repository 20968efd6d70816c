"""Phrases whose words stand together more often than chance: n-grams counted by quotient filters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tariffgrid.llm.common import drop_stored, prepare, read_table, stored
from tariffgrid.llm.quotient_filter import NgramKeys, counted, from_block, merged, to_block

LEAST, LONGEST, TOP = 100, 5, 2000
#: Where phrases end, and what parts words.
BREAKS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: Words and their bytes up to which the table of frequent words goes to every task as it
#: is; a larger one is joined, where words of more than one in HOT of all occurrences (at
#: most HOT of them) are broadcast.
BROADCAST_WORDS, BROADCAST_BYTES, HOT, HOT_BYTES = 500_000, 16 << 20, 50_000, 200
#: Keys that a task collects before it sorts them, and entries of a filter that it holds.
BUFFER, HELD = 1 << 21, 1 << 22
#: Entries that a range of quotients should hold, and the most bits that name a range.
RANGE_ENTRIES, MOST_RANGE_BITS = 1 << 21, 22
#: Bits of the map of occupied quotients that prunes the next level: 8 MB, whatever the input.
MAP_BITS = 26
_TO_DOTS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tokens(text: str | None) -> list[bytes]:
    """The lower-case words of a text in order, and `.` for each place where pieces part."""
    return (text or "").encode("utf-8").lower().translate(_TO_DOTS).replace(b".", b" . ").split()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of parts of the input, and of all words of a language together under a null word."""

    def flush() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()] + [(lang, None, sum(c.values())) for lang, c in held.items()]
        held.clear()
        langs, words, n = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([w and w.decode("utf-8") for w in words], pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    held: dict[str, Counter] = {}
    seen = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = _tokens(text.as_py())
            held.setdefault(lang, Counter()).update(found)
            del held[lang][b"."]
            seen += len(found)
        if seen > 4_000_000 or sum(map(len, held.values())) > 200_000:
            yield flush()
            seen = 0
    if held:
        yield flush()


def _numbered(words: DataFrame) -> DataFrame:
    """A stored table's rows with `id` from 1 without gaps: place in its range, and the sizes of the ranges before."""
    at = words.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33))
    sizes = at.groupBy("range").agg(F.count(F.lit(1)).alias("n_range"))
    before = sizes.select("range", F.coalesce(F.sum("n_range").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = at.join(F.broadcast(before), "range")  # a row for each task's range
    return placed.select((F.col("before") + F.col("at") - F.shiftleft("range", 33) + 1).alias("id"), "lang", "word", "f")


def _encoded_by_table(texts: DataFrame, words: list[tuple[int, str, str]]) -> DataFrame:
    """(ids) of every text: its frequent words by number, 0 for what breaks phrases. words: a bounded table."""
    table: dict[str, dict[bytes, int]] = {}
    for number, lang, word in words:
        table.setdefault(lang, {})[word.encode("utf-8")] = number
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, parts = [0], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                known = sent.value.get(lang)
                if known:
                    found = _tokens(text.as_py())
                    ids = np.fromiter((known.get(w, 0) for w in found), np.int32, len(found))
                    keep = np.ones(len(ids), bool)  # of neighbouring breaks the first
                    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
                    parts += [ids[keep], np.zeros(1, np.int32)]
                    ends.append(ends[-1] + len(parts[-2]) + 1)
            if parts:
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))], names=["ids"])

    return texts.mapInArrow(run, "ids array<int>")


def _encoded_by_join(texts: DataFrame, vocabulary: DataFrame, n_words: int) -> DataFrame:
    """The same phrases from a vocabulary of any size, a row for each piece of a text.

    The most frequent words are matched by broadcast; of the others none holds more than
    one in HOT of the rows, so the shuffle by word has no hot key.
    """
    lower = F.translate("text", _UPPER, _LOWER)
    pieces = texts.select(F.monotonically_increasing_id().alias("row"), "lang", F.posexplode(F.split(lower, BREAKS)).alias("piece", "said"))
    places = pieces.select("row", "piece", "lang", F.posexplode(F.filter(F.split("said", BLANKS), lambda w: w != "")).alias("place", "word"))
    hot = (F.col("f") * HOT >= n_words) & (F.octet_length("word") <= HOT_BYTES)
    head = vocabulary.where(hot).select("lang", "word", F.col("id").alias("hot_id"))
    marked = places.join(F.broadcast(head), ["lang", "word"], "left")
    rest = marked.where("hot_id IS NULL").join(vocabulary.where(~hot).select("lang", "word", "id"), ["lang", "word"])
    known = marked.where("hot_id IS NOT NULL").select("row", "piece", "place", F.col("hot_id").alias("id")).unionByName(rest.select("row", "piece", "place", "id"))
    said = known.groupBy("row", "piece").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("w"))
    gap = lambda w, i: (i > 0) & (F.get(F.col("w"), i - 1)["place"] + 1 != w["place"])
    with_gaps = F.flatten(F.transform("w", lambda w, i: F.when(gap(w, i), F.array(F.lit(0), w["id"].cast("int"))).otherwise(F.array(w["id"].cast("int")))))
    return said.select(F.array_append(with_gaps, F.lit(0)).alias("ids"))


def _shards(keys: NgramKeys, part_bits: int, within: tuple[NgramKeys, int, Broadcast] | None):
    """Sorted filters of a task's n-grams, in blocks by range of quotients."""

    def windows(ids: np.ndarray) -> np.ndarray:
        ok = ids != 0
        full = np.logical_and.reduce([ok[k : len(ids) - keys.n + 1 + k] for k in range(keys.n)])
        starts = np.flatnonzero(full)
        if within is None or not len(starts):
            return starts
        part_keys, bits, sent = within  # both n-grams of one word less must be on the map
        parts = np.union1d(starts, starts + 1)
        at = part_keys.quotient(part_keys.permute(part_keys.pack(ids, parts)), bits)
        on = np.zeros(len(ids) + 1, bool)
        on[parts] = (sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return starts[on[starts] & on[starts + 1]]

    def blocks(limbs, counts) -> pa.RecordBatch:
        of = keys.quotient(limbs, part_bits)
        cuts = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
        rows = [to_block(keys, [x[a:b] for x in limbs], counts[a:b], part_bits) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(of[cuts[:-1]].astype(np.int32)), pa.array(rows, pa.binary())], names=["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, n_buffer, held, n_held = [], 0, [], 0
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy()
            step = BUFFER - LONGEST
            for a in range(0, len(ids), step):  # slices of a batch share n - 1 ids
                piece = ids[a : a + step + keys.n - 1]
                if len(piece) < keys.n or not len(starts := windows(piece)):
                    continue
                buffer.append(keys.permute(keys.pack(piece, starts)))
                n_buffer += len(starts)
                if n_buffer >= BUFFER:
                    held.append(counted([np.concatenate(x) for x in zip(*buffer)]))
                    buffer, n_buffer = [], 0
                    n_held += len(held[-1][1])
                    if n_held > HELD:
                        held = [merged(held)]
                        n_held = len(held[0][1])
                        if n_held > HELD // 2:
                            yield blocks(*held[0])
                            held, n_held = [], 0
        if buffer:
            held.append(counted([np.concatenate(x) for x in zip(*buffer)]))
        if held:
            yield blocks(*merged(held))

    return run


def _merge(keys: NgramKeys, part_bits: int, least: int, map_bits: int):
    """(ids, f, slot) of n-grams with f >= least, from blocks that come sorted by their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filters, n_held = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            limbs, counts = merged(filters)
            keep = counts >= least
            if keep.any():
                limbs = [x[keep] for x in limbs]
                ids = keys.unpack(keys.restore(limbs)).astype(np.int32)
                ends = np.arange(0, ids.size + 1, keys.n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, ids.ravel()), pa.array(counts[keep]), pa.array(keys.quotient(limbs, map_bits))], names=["ids", "f", "slot"])

        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now:
                    if filters:
                        yield from done()
                    now, filters, n_held = part, [], 0
                filters.append(from_block(keys, block.as_buffer(), part, part_bits))
                n_held += len(filters[-1][1])
                if n_held > HELD and len(filters) > 1:
                    filters = [merged(filters)]
                    n_held = len(filters[0][1]) // 2  # compacted: grows by half before it is merged again
        if filters:
            yield from done()

    return run


def _range_bits(keys: NgramKeys, n_words: int, tasks: int) -> int:
    """Bits that name a range: a few ranges a task, and more where they would hold too much."""
    wanted = max(4 * tasks, n_words // RANGE_ENTRIES)
    return min(wanted.bit_length(), MOST_RANGE_BITS, keys.widths[0])


def _occupied(frequent: DataFrame, keys: NgramKeys, n_frequent: int, most_bits: int) -> tuple[NgramKeys, int, Broadcast]:
    """The map of the quotients that frequent n-grams occupy, as bits; at most 2 ** most_bits of them.

    The table's slots have most_bits; of few n-grams a smaller map does. Two n-grams of
    one quotient only cost counters that the merge drops.
    """
    bits = min(most_bits, keys.widths[0], max(10, n_frequent.bit_length() + 6))
    shift = min(most_bits, keys.widths[0]) - bits
    slot = F.shiftright("slot", shift)
    one = F.lit(1).cast("long")
    by_word = frequent.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", one, (slot % 64).cast("int"))).alias("on"))
    got = by_word.toArrow()  # a row for 64 bits of the map: a million of them at most
    bitmap = np.zeros(max(1, (1 << bits) // 64), np.uint64)
    bitmap[got["at"].to_numpy()] = got["on"].to_numpy().view(np.uint64)
    return keys, bits, frequent.sparkSession.sparkContext.broadcast(bitmap)


def frequent_ngrams(encoded: DataFrame, n: int, bits: int, n_words: int, *, least: int, within=None, map_bits: int = MAP_BITS) -> DataFrame:
    """(ids, f, slot) of the n-grams with f >= least. encoded: (ids), 0 between phrases and at the end.

    Each task counts its n-grams in sorted filters and sends them as blocks by range of
    quotients; blocks of a range are merged one range at a time.
    """
    spark, keys = encoded.sparkSession, NgramKeys(n, bits)
    part_bits = _range_bits(keys, n_words, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = encoded.mapInArrow(_shards(keys, part_bits, within), "part int, block binary")
    dealt = blocks.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(_merge(keys, part_bits, least, min(map_bits, keys.widths[0])), "ids array<int>, f long, slot long")


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, broadcast_words: int = BROADCAST_WORDS, map_bits: int = MAP_BITS
) -> DataFrame:
    """The best phrases of 2 to `longest` words by language: (lang, rank, phrase, a, l, r, n, score).

    Level by level, n-grams of frequent words are counted whose two parts of one word less
    are frequent, as far as a map of fixed size tells; the counts are exact. A phrase counts by its
    worst cut; one that stands only inside a longer one is dropped. Ranks are limited in
    each task before rows of a language meet.

    Defined results: a null text is an empty one; a null language is `und`; all rows
    count, repeated ones too; ties of score and count go by the phrase's bytes; a table
    without frequent phrases gives no rows; other columns are ignored. The
    result is a table in the shared folder; those it was made from are deleted.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = texts.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = stored(words.where(F.col("word").isNull() | (F.col("f") >= least)))
    sizes = words.where("word IS NULL").select("lang", F.col("f").alias("n"))
    vocabulary = stored(_numbered(words.where("word IS NOT NULL")))
    size = vocabulary.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("f"), F.lit(0)).alias("f")).first()
    few = size["n"] <= broadcast_words and size["bytes"] <= BROADCAST_BYTES
    if few:
        encoded = _encoded_by_table(texts, [tuple(r) for r in vocabulary.select("id", "lang", "word").collect()])
    else:
        encoded = _encoded_by_join(texts, vocabulary, size["f"])
    encoded, bits = stored(encoded), max(1, size["n"].bit_length())

    levels, within = [], None
    for n in range(2, longest + 1):
        found = stored(frequent_ngrams(encoded, n, bits, size["f"], least=least, within=within, map_bits=map_bits))
        levels.append(found)
        if not (n_found := found.count()):
            break
        if n < longest:
            within = _occupied(found, NgramKeys(n, bits), n_found, map_bits)
    told = stored(_ranked(levels, vocabulary, sizes, few, top))
    drop_stored(encoded, words, vocabulary, *levels)
    return told


def _ranked(levels: list[DataFrame], vocabulary: DataFrame, sizes: DataFrame, few: bool, top: int) -> DataFrame:
    """Scores and ranks of the counted n-grams."""
    phrases = levels[0].select("ids", "f")
    for more in levels[1:]:
        phrases = phrases.unionByName(more.select("ids", "f"))
    # Dropped: as frequent inside a longer phrase. One word longer will do, as counts only fall.
    n = F.size("ids")
    inside = phrases.where(n > 2).select(F.explode(F.array(F.slice("ids", 1, n - 1), F.slice("ids", F.lit(2), n - 1))).alias("ids"), F.col("f").alias("longer"))
    kept = phrases.join(inside.groupBy("ids").agg(F.max("longer").alias("longer")), "ids", "left").where("longer IS NULL OR longer < f").select("ids", "f")

    # Every cut asks for the counts of its two parts; words and phrases are looked up alike.
    counts = phrases.unionByName(vocabulary.select(F.array(F.col("id").cast("int")).alias("ids"), "f")).select(F.col("ids").alias("part"), F.col("f").alias("f_part"))
    cuts = kept.select("ids", "f", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    sides = F.array(F.struct(F.slice("ids", F.lit(1), F.col("k")).alias("part"), F.lit(True).alias("first")), F.struct(F.slice("ids", F.col("k") + 1, n - F.col("k")).alias("part"), F.lit(False).alias("first")))
    asked = cuts.select("ids", "f", "k", F.inline(sides)).join(counts, "part")
    cut = asked.groupBy("ids", "f", "k").agg(F.max(F.when(F.col("first"), F.col("f_part"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f_part"))).alias("r"))

    # Language and size by the first word.
    at = vocabulary.join(sizes, "lang").select(F.col("id").cast("int").alias("word_id"), "lang", "n")
    cut = cut.join(F.broadcast(at) if few else at, F.col("ids")[0] == F.col("word_id"))
    score = F.expr("(CAST(f * 1000 AS DECIMAL(38, 0)) * n) DIV (CAST(l AS DECIMAL(38, 0)) * r)")
    best = cut.withColumn("score", score).groupBy("ids", "f", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = best.select("ids", "lang", "n", F.col("f").alias("a"), "cut.score", "cut.l", "cut.r")
    near = scored.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top).drop("place")

    named = near.select("*", F.posexplode("ids").alias("at", "word_id"))
    spelt = vocabulary.select(F.col("id").cast("int").alias("word_id"), "word")
    named = named.join(F.broadcast(spelt) if few else spelt, "word_id").groupBy("ids", "lang", "n", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    phrase = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    told = named.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return told.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of every language of the documents."""
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
size AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100
), words AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f),
longer AS (
  SELECT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase, f FROM words WHERE k > 2
), kept AS (
  SELECT * FROM words WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = words.lang AND x.phrase = words.phrase AND x.f >= words.f)
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k1, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS k1 FROM kept) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k1], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k1 + 1:c.k], ' ')
  JOIN size ON size.lang = c.lang
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k1) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
