"""Language identification: known words first, backing off to ever shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffgrid.llm.common import drop_stored, is_held_out, prepare, read_table, stored, unit_hash

#: Documents that the model is fitted on, the whole of each, and languages it tells apart.
MAX_TRAIN_DOCS, MAX_LANGUAGES = 20_000, 10_000
#: Documents of each language that are learned from even if all languages together then have more.
LEAST_DOCS = 50
#: Entries (language, word) and, for each order, (language, n-gram) of the model.
MAX_WORDS, MAX_GRAMS = 120_000, 80_000
ORDERS = (4, 3, 2, 1)
UNDETERMINED = "und"
#: Counts from here on are alike to the threshold that keeps a model within its entries.
_FREQUENT = 4096
#: Bytes of the word vectors that a worker remembers before it forgets them all.
_MEMO_BYTES = 64 << 20
#: Words that count fully towards certainty; more of them do not raise it.
_EVIDENCE = 20
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Table:
    """Terms of one kind (words, or n-grams of one order) with their counts by language, as sparse rows."""

    at: dict[str, int]
    first: np.ndarray
    language: np.ndarray
    count: np.ndarray
    #: Log frequency, by language, of a term that the language doesn't have.
    least: np.ndarray

    @classmethod
    def of(cls, terms: list[str], languages: np.ndarray, counts: np.ndarray, n_languages: int) -> Table:
        """From parallel lists of (term, language number, count)."""
        at: dict[str, int] = {}
        row = np.array([at.setdefault(t, len(at)) for t in terms], np.int64)
        order = np.argsort(row, kind="stable")
        first = np.searchsorted(row[order], np.arange(len(at) + 1))
        total = np.bincount(languages, weights=counts, minlength=n_languages) + 0.5 * len(at)
        return cls(at, first, languages[order], counts[order].astype(float), np.log(0.5 / np.maximum(total, 0.5)))

    def rows(self, numbers: list[int]) -> np.ndarray:
        """Smoothed log frequencies of terms, by their numbers, in each language."""
        k = np.array(numbers, np.int64)
        lengths = self.first[k + 1] - self.first[k]
        at = np.arange(lengths.sum()) + np.repeat(self.first[k] - np.cumsum(lengths) + lengths, lengths)
        out = np.repeat(self.least[None], len(k), axis=0)
        out[np.repeat(np.arange(len(k)), lengths), self.language[at]] += np.log1p(2.0 * self.count[at])
        return out


@dataclass
class LanguageModel:
    """Tables of words, and of n-grams by order; their columns follow `languages`."""

    languages: list[str]
    words: Table
    grams: dict[int, Table]
    _ids: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def of(cls, counts: list[tuple[int, str, str, int]]) -> LanguageModel:
        """From rows (kind, language, term, count); kind is the n-gram's order, or 0 for a word."""
        languages = sorted({r[1] for r in counts})
        number = {x: i for i, x in enumerate(languages)}
        tables = {}
        for kind in (0, *ORDERS):
            rows = [r for r in counts if r[0] == kind]
            tables[kind] = Table.of([r[2] for r in rows], np.array([number[r[1]] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), len(languages))
        return cls(languages, tables.pop(0), tables)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Log frequencies of words: their own if known, else the mean of their longest known n-grams."""
        out = np.zeros((len(words), len(self.languages)))
        known = [i for i, w in enumerate(words) if w in self.words.at]
        out[known] = self.words.rows([self.words.at[words[i]] for i in known])
        open_ = [(i, f"<{w}>") for i, w in enumerate(words) if w not in self.words.at]
        for n in ORDERS:
            get, found, rest = self.grams[n].at.get, [], []
            for i, marked in open_:
                have = [g for k in range(len(marked) - n + 1) if (g := get(marked[k : k + n])) is not None]
                (found if have else rest).append((i, have or marked))
            if found:
                lengths = np.array([len(have) for _, have in found])
                sums = np.add.reduceat(self.grams[n].rows([g for _, have in found for g in have]), np.cumsum(lengths) - lengths, axis=0)
                out[[i for i, _ in found]] = sums / lengths[:, None]
            open_ = rest
        return out

    def vectors(self, words: list[str]) -> np.ndarray:
        """One row for each of distinct words; those seen before are remembered."""
        width, ids = len(self.languages), self._ids
        if self._rows is None or (len(ids) + len(words)) * width * 4 > _MEMO_BYTES:
            ids.clear()
            self._rows = np.zeros((1 << 10, width), np.float32)
        if new := [w for w in words if w not in ids]:
            start = len(ids)
            ids.update(zip(new, range(start, start + len(new))))
            if len(ids) > len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros((max(len(self._rows), len(new)), width), np.float32)])
            self._rows[start : start + len(new)] = self.unseen(new)
        return self._rows[[ids[w] for w in words]]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; `und` and 0 for a text without letters or a model without languages; of equals the first by name."""
        counts = Counter(_LETTERS.findall((text or "").lower()))
        if not self.languages or not any(c.isalpha() for w in counts for c in w):
            return UNDETERMINED, 0.0
        words, n = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
        step = max(1, _MEMO_BYTES // (8 * len(self.languages)))
        total = sum(n[k : k + step] @ self.vectors(words[k : k + step]) for k in range(0, len(words), step))
        mean = total / n.sum()
        odds = np.exp((mean - mean.max()) * min(n.sum(), _EVIDENCE))
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def fair_shares(sizes: dict[str, int], most: int, least: int = 1) -> dict[str, int]:
    """How much of each size to take so that all together take at most `most`, but `least` of each: small ones whole, large ones alike."""
    left, out = most, {}
    for k, name in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        out[name] = min(sizes[name], max(least, left // (len(sizes) - k)))
        left -= out[name]
    return out


def _sample(rows: DataFrame, max_docs: int, max_languages: int) -> DataFrame:
    """Of rows (id, lang, text): all of them, or of each language its fair share by a hash of the id."""
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    quota = fair_shares(sizes, max_docs, LEAST_DOCS)
    shares = [(lang, 2.0 if quota[lang] == n else quota[lang] / n) for lang, n in sizes.items()]
    table = rows.sparkSession.createDataFrame(shares, "lang string, share double")  # of max_languages rows at most
    return rows.join(F.broadcast(table), "lang").where(unit_hash(F.struct("id", "lang")) < F.col("share"))


def _pieces() -> Column:
    """A word's own entry and those of the n-grams between its marks, as (kind, term)."""
    marked = F.concat(F.lit("<"), "term", F.lit(">"))

    def grams(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        return F.transform(places, lambda i: F.struct(F.lit(n).alias("kind"), F.substr(marked, i, F.lit(n)).alias("term")))

    whole = F.array(F.struct(F.lit(0).alias("kind"), F.col("term").alias("term")))
    return F.filter(F.concat(whole, *(grams(n) for n in ORDERS)), lambda p: (p["kind"] == 0) | (F.length(p["term"]) == p["kind"]))


def _thresholds(bars: list, max_words: int, max_grams: int) -> list[tuple[int, str, int]]:
    """(kind, language, least count) that keep each kind within its entries, dealt among the languages as they need them.

    bars: (kind, lang, n, terms), the terms with each count. Terms of one count stay or go together.
    """
    by_kind: dict[int, dict[str, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for kind, lang, n, terms in bars:
        if kind or n > 1:  # a word seen once may be of any language
            by_kind[kind][lang].append((n, terms))
    out = []
    for kind, langs in by_kind.items():
        quota = fair_shares({lang: sum(t for _, t in of) for lang, of in langs.items()}, max_words if kind == 0 else max_grams)
        for lang, of in langs.items():
            least, held = _FREQUENT, 0
            for n, terms in sorted(of, reverse=True):
                held += terms
                if held > quota[lang] and n < _FREQUENT:
                    break
                least = n
            out.append((kind, lang, least))
    return out


def fit_language_model(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None, max_docs: int = MAX_TRAIN_DOCS,
    max_languages: int = MAX_LANGUAGES, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS,
) -> LanguageModel:
    """Fit on whole labelled texts: all of them, or about `max_docs`, the rows of rare languages first (50 of each, if it has them).

    usable: which rows may be learned from; by default those not held out. max_languages,
    max_words and max_grams (for each order) bound the model that is broadcast: its entries
    are (language, term), shared fairly among the languages, the most frequent ones first;
    entries of one count stay or go together, and those seen 4,096 times or more all stay.
    The counting runs on Spark, and no step deals rows out by language alone: entries are
    kept by a least count, which a histogram of the counts gives.

    Defined results: null languages, and languages of no word, are not learned; a null id
    is one like others; without any label the model is empty and predicts `und`.
    """
    usable = ~is_held_out(F.col(id_col)) if usable is None else usable
    rows = docs.where(usable & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    word = F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), 1))
    words = _sample(rows, max_docs, max_languages).select("lang", word.alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    entries = words.select("lang", F.explode(_pieces()).alias("p"), "n").groupBy("p.kind", "lang", "p.term").agg(F.sum("n").alias("n"))
    counts = stored(entries.select("kind", "lang", "term", "n"))
    bars = counts.groupBy("kind", "lang", F.least("n", F.lit(_FREQUENT)).alias("n")).count().collect()
    least = _thresholds([tuple(r) for r in bars], max_words, max_grams)
    if not least:
        drop_stored(counts)
        return LanguageModel.of([])
    cuts = docs.sparkSession.createDataFrame(least, "kind int, lang string, least long")  # of 5 rows a language
    kept = counts.join(F.broadcast(cuts), ["kind", "lang"]).where("n >= least").select("kind", "lang", "term", "n").toArrow()
    drop_stored(counts)
    return LanguageModel.of(list(zip(*(kept.column(c).to_pylist() for c in ("kind", "lang", "term", "n")))))


_PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def predict_languages(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score of each whole text; existing columns of these names are replaced."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast((model.languages, model.words, model.grams))  # bounded as fit_language_model() tells
    made: list[LanguageModel] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(LanguageModel(*sent.value))
        for batch in batches:
            got = [made[0].predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*batch.schema.names[:-1], *_PREDICTED.names],
            )

    kept = [c for c in docs.columns if c not in _PREDICTED.names]
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias("text to read")).mapInArrow(run, schema)


def identify_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.3, **fit) -> DataFrame:
    """The rows of docs whose language is determined with at least `least_score`, with lang_pred and score.

    Defined results: a null text, or one without letters, is `und` with score 0 (and so
    goes); repeated rows are each judged; null languages are not learned from; an empty
    table, or one without any language label, leaves no rows.
    """
    model = fit_language_model(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **fit)
    return predict_languages(docs, model, text_col=text_col).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit_language_model(docs)
    narrow = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict_languages(narrow, model).select("doc_id", "held_out", "lang_pred", "score")
