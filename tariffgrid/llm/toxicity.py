"""Toxicity: a learned weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffgrid.llm.common import drop_stored, is_held_out, prepare, read_table, stored, unit_hash

#: Labelled documents that the lexicon is fitted on, the whole of each.
MAX_TRAIN_DOCS = 20_000
#: Besides whole words, stems of these lengths can be terms: endings vary.
STEMS = tuple(range(3, 11))
CUT = 0.3
#: Different words of a term in one document that learning counts at most, and toxic documents that a term needs.
MOST_COUNTED, LEAST_DOCS = 4, 3
#: Share of a stem's toxic occurrences from which one longer term stands for it.
ONE_ENDING = 0.8
#: A term must explain so many toxic documents that no weightier term does, or be in at
#: least this share of the documents that the most frequent term is in.
LEAST_NEW, FREQUENT = 2, 0.25
#: Words added to every text's number, and the evidence (in nats) at which a text scores 1 - 1/e.
MORE_WORDS, NATS = 20.0, 8.0
#: Letters of other scripts and digits or signs that stand for Latin letters
#: (full-width, mathematical and other compatibility letters are folded by NFKC).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p",
    "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "з": "3", "б": "6",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ϳ": "j",
    "ա": "w", "ց": "g", "հ": "h", "յ": "j", "ո": "n", "օ": "o", "ս": "u", "ք": "f",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ꜱ": "s", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴊ": "j", "ᴋ": "k", "ᴍ": "m",
    "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
#: Characters without a width that split a word for readers of code points only.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff"
#: Phrases whose words are not counted, as they are harmless in this company.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash compactor", "clown fish", "clown shoes", "circus clown", "idiot proof", "idiot light", "dumb waiter", "dumb terminal",
    "damn with faint praise", "dirty laundry", "dirty read", "kill switch", "kill process", "killer whale", "killer app", "garbage collection", "garbage collector", "garbage can", "garbage disposal",
    "pest control", "vermin control", "worm gear", "rat race", "pig iron", "pond scum", "snail mail", "cock pit", "weather cock", "cock crow", "great tit", "blue tit",
)

_FOLD = HOMOGLYPHS | dict.fromkeys(INVISIBLE, "")
_FOREIGN = re.compile(f"[{re.escape(''.join(_FOLD))}]")
#: A word with a digit or sign in it; words without are passed over at once.
_ODD = re.compile(r"(?<![\w@$!])[^\W\d]*+[0-9@$!][\w@$!]*+")
_SIGNS = str.maketrans(SUBSTITUTES)
_WORDS = re.compile(r"[^\W_]+")


def _letters(found: re.Match) -> str:
    """The word with digits and signs inside read as letters, if it has a letter."""
    inside = found[0].strip("@$!")
    return found[0].replace(inside, inside.translate(_SIGNS)) if any(c.isalpha() for c in inside) else found[0]


def folded_words(text: str | None) -> list[str]:
    """Lower-case words with homoglyphs folded, and digits and signs inside words read as letters."""
    low = text or ""
    if low.isascii():
        low = low.lower()
    else:
        low = unicodedata.normalize("NFKC", low).lower()
        if _FOREIGN.search(low):
            low = _FOREIGN.sub(lambda m: _FOLD[m[0]], low)
    return _WORDS.findall(_ODD.sub(_letters, low))


def terms_of(words: list[str]) -> Counter:
    """The words (` word `) and stems (` stem`) of folded words, each with the number of its different words."""
    found = Counter()
    for word in set(words):
        found[f" {word} "] = 1
        for k in STEMS:
            if len(word) < k:
                break
            found[f" {word[:k]}"] += 1
    return found


def stems_of(term: str) -> list[str]:
    """The shorter terms that every word with this term has."""
    word = term.strip()
    return [f" {word[:k]}" for k in STEMS if k < len(word) or (k == len(word) and term[-1] == " ")]


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each text's folded words before its text and label."""
    for batch in batches:
        digests = [hashlib.blake2b(" ".join(folded_words(t)).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *batch.columns], names=["digest", "text", "label"])


def _held_terms(sent):
    """The candidate terms of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(terms_of(folded_words(t)).keys() & sent.value) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["terms"])

    return run


def explaining_terms(held: list[set[str]]) -> set[str]:
    """Terms that together explain the toxic documents, each given by the candidates it holds.

    Copies of a toxic document share harmless words as well, which look significant. So
    terms are taken greedily, each for the documents that none before explains; to those
    come the terms that are about as frequent as the most frequent one.
    """
    docs_of: dict[str, list[int]] = defaultdict(list)
    for d, terms in enumerate(held):
        for t in terms:
            docs_of[t].append(d)
    rank = {t: k for k, t in enumerate(sorted(docs_of, key=lambda t: (len(t), t)))}
    new = {t: len(ds) for t, ds in docs_of.items()}
    queue = [(-n, -rank[t], t) for t, n in new.items()]
    heapq.heapify(queue)
    chosen, open_ = set(), [True] * len(held)
    while queue:
        n, place, term = heapq.heappop(queue)
        if new[term] < -n:  # some of its documents are explained by now
            if new[term]:
                heapq.heappush(queue, (-new[term], place, term))
            continue
        if -n < LEAST_NEW and chosen:
            break
        chosen.add(term)
        for d in docs_of[term]:
            if open_[d]:
                open_[d] = False
                for t in held[d]:
                    new[t] -= 1
    most = max(map(len, docs_of.values()), default=0)
    return chosen | {t for t, ds in docs_of.items() if len(ds) >= FREQUENT * most}


def separate_terms(counts: dict[str, tuple[int, int]], significance: Callable[[int, int], float], least: float) -> set[str]:
    """Terms that each stand for occurrences of their own. counts: toxic and clean occurrences of the candidates.

    The most significant one is taken, but a longer one in its place that has nearly all its
    toxic occurrences: a stem is a term only if it joins several endings, and of terms with the same
    occurrences the longest is. What it accounts for is taken off the shorter terms,
    and the longer ones are done with; so on, until none of the rest is significant.
    """
    longer: dict[str, set[str]] = defaultdict(set)
    for term in counts:
        for stem in stems_of(term):
            if stem in counts:
                longer[stem].add(term)
    left, chosen = dict(counts), set()
    queue = [(-significance(*n), t) for t, n in left.items()]
    heapq.heapify(queue)
    while queue:
        known, term = heapq.heappop(queue)
        if term not in left:
            continue
        now = significance(*left[term])
        if now <= least:
            continue
        if now < -known:  # some of its occurrences have been taken off
            heapq.heappush(queue, (-now, term))
            continue
        taken = term
        while nearly := [t for t in longer[taken] if t in left and left[t][0] >= ONE_ENDING * left[taken][0]]:
            taken = max(nearly, key=lambda t: (left[t][0], len(t), t))
        toxic, clean = left.pop(taken)
        chosen.add(taken)
        for stem in stems_of(taken):
            if stem in left:
                left[stem] = (max(0, left[stem][0] - toxic), max(0, left[stem][1] - clean))
        for t in longer[taken]:
            left.pop(t, None)
        if term in left:
            heapq.heappush(queue, (-significance(*left[term]), term))
    return chosen


@dataclass
class Lexicon:
    """What is known of whole words (` word `) and stems (` stem`), and phrases to pass over.

    A text's repeats of a word add nothing, as whole lines may be repeated.

    terms: different words with the term in a toxic document that has it, their share of the words of
    clean ones, and the log ratio of toxic and clean documents with it. prior: log odds of
    clean against toxic.
    """

    terms: dict[str, tuple[float, float, float]]
    prior: float = 0.0
    exceptions: tuple[str, ...] = EXCEPTIONS

    def matcher(self):
        found = ahocorasick.Automaton()
        for term, (often, share, _) in self.terms.items():
            found.add_word(term, (len(term), often / share, term))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None, phrase))
        found.make_automaton()
        return found

    def weight(self, term: str, n: int, n_words: int) -> float:
        """Evidence, in nats, of n different words of a term: against what chance gives in so many words, 0 at least.

        The first one says no more than that the text is one of those with the term: chance is
        higher in some texts, as those of its language, than in all together.
        """
        often, share, present = self.terms[term]
        each = math.log1p(often / (share * (n_words + MORE_WORDS)))
        return max(0.0, min(n * each - often, present + (n - 1) * each))

    def score(self, matcher, text: str | None) -> float:
        """0 to 1: grows with the evidence of the words matched, which the text's length lowers; 0 without a match."""
        words = folded_words(text)
        if not words or not self.terms:
            return 0.0
        best: dict[int, tuple[float, str]] = {}
        line = f" {' '.join(words)} "
        passed: list[tuple[int, int]] = []
        for end, (length, ratio, term) in matcher.iter(line):
            start = end - length + 1
            if ratio is None:
                passed.append((start, end))
            elif ratio > best.get(start, (0.0, ""))[0]:
                best[start] = (ratio, term)  # one match for each word: its most telling term
        for a, b in passed:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        told = Counter(t for t, _ in {(t, line[a + 1 : line.index(" ", a + 1)]) for a, (_, t) in best.items()})
        evidence = sum(self.weight(term, n, len(words)) for term, n in sorted(told.items())) - self.prior
        return 1.0 - math.exp(-max(0.0, evidence) / NATS) if best else 0.0


_COUNTS = "term string, toxic long, clean long, toxic_docs long, clean_docs long"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of each term, and documents with it, by label; partial sums, flushed before they grow large.

    Under the empty term all words and documents.
    """
    toxic, clean, toxic_docs, clean_docs = every = Counter(), Counter(), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        terms = list(toxic.keys() | clean.keys())
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in every)], names=["term", "toxic", "clean", "toxic_docs", "clean_docs"])
        for c in every:
            c.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = folded_words(text)
            found = {t: min(n, MOST_COUNTED) for t, n in terms_of(words).items()} | {"": len(words)}
            (toxic if label else clean).update(found)
            (toxic_docs if label else clean_docs).update(found.keys())
            if len(toxic) + len(clean) > 200_000:
                yield flush()
    yield flush()


def fit_lexicon(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_TRAIN_DOCS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn the terms from labelled documents that are not held out: all, or `max_docs` of them by a hash of the id.

    A term is a candidate if it stands in toxic documents far beyond their share of all words
    (a log-likelihood ratio that outweighs the number of terms tried); in clean ones it may stand too. Of
    the candidates those stay that have occurrences of their own, and of these the ones that explain
    toxic documents. Kept of a term are its two rates, from which a text's length makes its weight. Texts of
    the same folded words are one piece of evidence, toxic if one of them is. Whole texts
    are counted on Spark, from a table of the sampled ones that is written once.

    max_docs is the bound of all that is broadcast (ids of the sample) and that the driver
    receives (candidate terms of the sample, and which of them each toxic document holds).

    Defined results: null ids and labels are not learned from, null texts have no terms;
    labels that repeat an id count as the highest of them; without toxic or without clean
    documents the lexicon is empty; extra columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col)))
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    n = marks.count()
    if n > max_docs:  # a little more than needed by a threshold, and of those exactly so many
        draw = unit_hash(F.col("id"))
        marks = marks.where(draw < (max_docs + 6 * math.sqrt(max_docs)) / n).orderBy(draw, "id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marks), "id").select("text", "label")
    texts = texts.mapInArrow(_with_digest, "digest binary, text string, label int")
    rows = stored(texts.groupBy("digest").agg(F.max("label").alias("label"), F.first("text").alias("text")).select("text", "label"))
    try:
        return _lexicon(rows, exceptions)
    finally:
        drop_stored(rows)


def _lexicon(rows: DataFrame, exceptions: tuple[str, ...]) -> Lexicon:
    """The lexicon of sampled rows (text, label), one for each distinct text."""
    sums = (F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_docs", "clean_docs"))
    counts = stored(rows.mapInArrow(_count_terms, _COUNTS).groupBy("term").agg(*sums))
    try:
        whole = counts.where("term = ''").first()
        if whole is None or not whole["toxic"] or not whole["clean"]:
            return Lexicon({}, 0.0, exceptions)
        toxic, clean, odds = whole["toxic"], whole["clean"], math.log(whole["clean_docs"] / whole["toxic_docs"])
        base, least = toxic / (toxic + clean), math.log(counts.count()) + 3.0
        both = F.col("toxic") + F.col("clean")
        beyond = F.col("toxic") * F.log(F.col("toxic") / (both * base)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - base)))).otherwise(0.0)
        good = counts.where((F.col("term") != "") & (F.col("toxic_docs") >= LEAST_DOCS)).where((F.col("toxic") > base * both) & (beyond > least))
        found = {r["term"]: (r["toxic"], r["clean"], r["toxic_docs"], r["clean_docs"]) for r in good.collect()}
    finally:
        drop_stored(counts)

    def significance(a: int, b: int) -> float:
        if a <= base * (a + b):
            return 0.0
        return a * math.log(a / ((a + b) * base)) + (b * math.log(b / ((a + b) * (1 - base))) if b else 0.0)

    own = separate_terms({t: (a, b) for t, (a, b, *_) in found.items()}, significance, least)
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(own))
    held = rows.where("label = 1").select("text").mapInArrow(_held_terms(sent), "terms array<string>").where(F.size("terms") > 0).collect()
    chosen = explaining_terms([set(r["terms"]) for r in held])
    terms = {t: (a / in_toxic, (b + 0.5) / clean, math.log((in_toxic + 0.5) / (in_clean + 0.5)) + odds) for t, (a, b, in_toxic, in_clean) in found.items() if t in chosen}
    return Lexicon(terms, max(0.0, odds), exceptions)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs, from its whole text alone.

    Defined results: null and empty texts score 0; repeated rows are each scored; a null
    id is carried and not held out; an empty table gives no rows; extra columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast((lexicon.terms, lexicon.prior, lexicon.exceptions))
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Lexicon(*sent.value))
            made.append(made[0].matcher())
        for batch in batches:
            scores = [made[0].score(made[1], t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32())],
                names=[id_col, "held_out", "score", "predicted"],
            )

    narrow = docs.select(F.col(id_col), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, narrow.select(id_col, "held_out").schema.add("score", "double").add("predicted", "integer"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from `labels`."""
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_lexicon(docs, read_table(spark, sf_dir, "labels")))
