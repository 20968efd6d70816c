"""Benchmark decontamination by latent semantic retrieval and a word-order check."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffgrid.llm.common import drop_stored, prepare, read_table, stored, unit_hash

#: Words of a block and blocks of a passage: passages of 48 words every 16.
BLOCK, BLOCKS = 16, 3
#: Dimensions of the latent space, and more of them while it is fitted.
RANK, OVERSAMPLE = 96, 16
#: Items searched for in one pass over the corpus, and about the bytes of their texts: bounds what is broadcast.
ITEMS_A_PASS, BYTES_A_PASS = 5_000, 16 << 20
#: Different words that a task counts before it passes them on.
WORDS_HELD = 200_000
#: A term in more than this share of all documents says little about a passage, unless it
#: is among so many rarest ones of an item (an item itself may be in many documents).
MAX_DF, RAREST = 0.2, 16
#: Texts whose passages are projected and compared together.
_TEXTS_AT_ONCE = 64
#: Terms of passages that are weighted, and cosines that are computed, in one product:
#: bounds a task's memory, however long the texts and many the items are.
_TERMS_AT_ONCE, _COSINES_AT_ONCE = 1 << 15, 1 << 22
#: Words of texts whose passages are fitted together; terms of a row up to which rows are summed side by side; and
#: terms of a part of the fit's sums, and tasks whose parts are added first.
_FIT_WORDS, _TERMS_SIDE_BY_SIDE, _PART_TERMS, _PART_TASKS = 1 << 18, 64, 128, 32
#: Share of an item's words that must be among its rarest ones in a text, besides those that
#: can be missing, for the word-order check; and words of items that are looked up at once.
RARE, _PLACES_AT_ONCE = 0.2, 1 << 20
#: Least cosine of a candidate; least share of an item's words found in order; and the
#: lesser share that is enough if the answer is found as well.
COSINE, ORDER, ORDER_WITH_ANSWER, ANSWER = 0.45, 0.7, 0.6, 0.8
#: Characters of a text that are cut into words at once.
_PIECE_CHARS = 1 << 20
_BLANK = re.compile(r"[ \t\n\r\x0b\x0c]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_CLEAN = bytes.maketrans(b"-_/", b"   ")
_DROP = b".,;:!?\"'()[]{}*#%&$|<>"


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN, _DROP).split()


def pieces_of(text: str | None, overlap: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first word, words) of a text; a very long text is cut at white space into pieces that share `overlap` words."""
    text, start, place, words = text or "", 0, 0, []
    while True:
        at = _BLANK.search(text, start + _PIECE_CHARS) if len(text) - start > _PIECE_CHARS else None
        new = words_of(text[start : at.start()] if at else text[start:])
        shared = words[-overlap:] if overlap else []
        place += len(words) - len(shared)
        words = shared + new if shared else new
        yield place, words
        if at is None:
            return
        start = at.start()


def places_of(a: list[bytes]) -> dict[bytes, int]:
    """The places of each word as bits."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    return places


def last_start(a: list[bytes], b: list[bytes]) -> int:
    """The last place of `b` from which the rest of it still has the longest common subsequence with `a`."""
    get, n = places_of(a[::-1]).get, common_in_order(a, b)
    free = full = (1 << len(a)) - 1
    for k in range(len(b) - 1, -1, -1):
        if m := get(b[k]):
            hit = free & m
            free = ((free + hit) | (free - hit)) & full
            if len(a) - free.bit_count() == n:
                return k
    return 0


def common_in_order(a: list[bytes], b: list[bytes], places: dict[bytes, int] | None = None) -> int:
    """Length of the longest common subsequence, all places of `a` at a time; places: places_of(a) if known."""
    get = (places_of(a) if places is None else places).get
    free = full = (1 << len(a)) - 1
    for w in b:
        if m := get(w):
            hit = free & m
            free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


@dataclass
class Items:
    """One pass's benchmark items, their vocabulary, and the answer of each."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]

    @classmethod
    def of(cls, rows: list, answer_col: str | None) -> Items:
        texts = [r["text"] or "" for r in rows]
        answers = [(r["answer"] if answer_col else None) or _SENTENCE.split(t.strip())[-1] for r, t in zip(rows, texts)]
        return cls([r["id"] for r in rows], [words_of(t) for t in texts], [words_of(a) for a in answers])

    def vocabulary(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}


def _passage_count(n_words: int) -> int:
    return max(1, -(-n_words // BLOCK) - BLOCKS + 1)


def _tf_rows(lists: list[np.ndarray], v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct (row, term) of all passages of the texts (terms, -1 for none) with term counts; and the number of rows."""
    rows, terms, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for ids in lists:
        at = np.flatnonzero(ids >= 0)
        n = _passage_count(len(ids))
        for k in range(BLOCKS):
            row = at // BLOCK - k
            inside = (row >= 0) & (row < n)
            rows.append(row[inside] + base)
            terms.append(ids[at[inside]])
        base += n
    key, tf = np.unique(np.concatenate(rows) * v + np.concatenate(terms), return_counts=True)
    return key // v, key % v, tf.astype(np.float32), base


def _runs(row: np.ndarray) -> Iterator[slice]:
    """Slices that together are all of row (in order), each of whole rows and a bounded length."""
    at = np.arange(_TERMS_AT_ONCE, len(row), _TERMS_AT_ONCE)
    ends = np.unique(np.r_[0, np.searchsorted(row, row[at], "left"), len(row)])
    yield from (slice(int(x), int(y)) for x, y in zip(ends[:-1], ends[1:]))


def _project(row: np.ndarray, term: np.ndarray, value: np.ndarray | None, vectors: np.ndarray, n: int) -> np.ndarray:
    """Sums of the terms' vectors, times value if given, of each row; row is in order."""
    out = np.zeros((n, vectors.shape[1]), np.float32)
    for run in _runs(row):
        r, t, x = row[run], term[run], None if value is None else value[run, None]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        count = np.diff(np.r_[first, len(r)])
        first, count = first[order := np.argsort(-count, kind="stable")], count[order]
        long = int(np.searchsorted(-count, -_TERMS_SIDE_BY_SIDE, "left"))
        sums = np.zeros((len(first), vectors.shape[1]), np.float32)
        for k in range(long):
            part = slice(first[k], first[k] + count[k])
            weighted = vectors.take(t[part], axis=0)
            sums[k] = (weighted if x is None else x[part] * weighted).sum(axis=0)
        for k in range(int(count[long]) if long < len(count) else 0):  # the k-th terms of all rows that have so many
            at = first[long : int(np.searchsorted(-count, -k, "left"))] + k
            weighted = vectors.take(t[at], axis=0)
            sums[long : long + len(at)] += weighted if x is None else x[at] * weighted
        out[r[first]] = sums
    return out


def _gram_times(row, term, value, basis) -> np.ndarray:
    """A'(A basis) for the sparse rows A = (row, term, value)."""
    out = np.zeros_like(basis)
    for run in _runs(row):
        r, t, x = row[run] - row[run.start], term[run], value[run]
        left = _project(r, t, x, basis, int(r[-1]) + 1)
        order = np.argsort(t, kind="stable")
        t, x = t[order], x[order, None] * left[r[order]]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        out[t[first]] += np.add.reduceat(x, first, axis=0)
    return out


def _add_gram(lists: list[np.ndarray], vectors: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A vectors) to out, with A the term counts of all passages of the texts (terms, -1 for none).

    A passage is the sum of its blocks, so that each word is summed once and passages are sliding sums.
    """
    blocks = np.array([max(BLOCKS, -(-len(x) // BLOCK)) for x in lists])
    first_block, n = np.cumsum(blocks) - blocks, int(blocks.sum())
    at = [np.flatnonzero(x >= 0) for x in lists]
    block = np.concatenate([a // BLOCK + f for a, f in zip(at, first_block)])
    term = np.concatenate([x[a] for x, a in zip(lists, at)])
    sums = _project(block, term, None, vectors, n + BLOCKS - 1)
    passages = sum(sums[k : k + n] for k in range(BLOCKS))
    for k in range(1, BLOCKS):
        passages[first_block + blocks - k] = 0  # these would reach into the next text
    back = np.zeros_like(sums)
    for k in range(BLOCKS):
        back[k : k + n] += passages
    order = np.argsort(term, kind="stable")
    used, row = np.unique(term[order], return_inverse=True)
    out[used] += _project(row, block[order], None, back, len(used))


def _ids(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term, over all of docs (column text)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, n = sent.value, np.zeros(len(sent.value) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                total[_ids(list({w for _, words in pieces_of(text) for w in words}), known)] += 1  # -1 is the last place
        total[-1] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    for r in got:
        df[r["term"]] = r["n"]
    return int(df[-1]), df[:-1]


def _words_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = {w for text in batch.column(0).to_pylist() for w in words_of(text or "")}
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary())], names=["word"])


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents with it) of parts of the input, and all documents under a null word."""

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([*held, None], pa.binary()), pa.array([*held.values(), n], pa.int64())], names=["word", "n"])
        held.clear()
        return out

    held, n = Counter(), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n += 1
            held.update({w for _, words in pieces_of(text) for w in words})
            if len(held) > WORDS_HELD:
                yield flush()
                n = 0
    yield flush()


def all_frequencies(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(word, n), stored: in how many documents each word of any item is, and under a null word how many there are; one scan, whatever the number of items.

    Words are summed by task, dealt by hash and matched with those of the items; nothing is broadcast.
    """
    wanted = items.select("text").mapInArrow(_words_of_items, "word binary").distinct()
    counts = docs.select("text").mapInArrow(_documents_with, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts.join(wanted.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left").where("word IS NULL OR of IS NOT NULL").select("word", "n"))


def frequencies_of(counts: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Of all_frequencies() those of one pass's vocabulary, as document_frequencies() gives them."""
    words = counts.sparkSession.createDataFrame([(w, k) for w, k in vocabulary.items()], "word binary, term long")
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts.join(F.broadcast(words), "word").select("term", "n").collect():  # as many rows as the pass has words
        df[r["term"]] = r["n"]
    return counts.where("word IS NULL").first()["n"], df


def _weights(items: Items, vocabulary: dict[bytes, int], n_docs: int, df: np.ndarray) -> np.ndarray:
    """Inverse document frequency of each term, 0 for those that are not looked at."""
    rare = df <= MAX_DF * n_docs
    for words in items.words:
        ids = np.array(sorted({vocabulary[w] for w in words}), np.int64)
        rare[ids[np.argsort(df[ids], kind="stable")[:RAREST]]] = True
    return np.where(rare, np.log((n_docs + 1.0) / (df + 1.0)) + 0.1, 0.0)


def _parts_added(table: pa.Table) -> pa.Table:
    total = np.zeros(len(table.column("part")[0].as_buffer()) // 4)
    for part in table.column("part"):
        total += np.frombuffer(part.as_buffer(), np.float32)
    return pa.table({"block": table.column("block")[:1], "tasks": table.column("tasks")[:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _corpus_gram(texts: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) over the passages of all texts: partial products by task, added on Spark by blocks of terms, of so many tasks at first."""
    weight = idf.astype(np.float32)
    sent = texts.sparkSession.sparkContext.broadcast((vocabulary, np.append(weight > 0, False), weight[:, None] * basis))
    width = basis.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, useful, weighted = sent.value
        out, lists, held = np.zeros(weighted.shape), [], 0
        for batch in batches:
            for text in batch.column(0):
                for _, words in pieces_of(text.as_py()):
                    ids = _ids(words, known)
                    lists.append(np.where(useful[ids], ids, -1))
                    held += len(ids)
                    if len(lists) == _TEXTS_AT_ONCE or held > _FIT_WORDS:
                        _add_gram(lists, weighted, out)
                        lists, held = [], 0
        if lists:
            _add_gram(lists, weighted, out)
        if out.any():
            starts = range(0, len(out), _PART_TERMS)
            yield pa.RecordBatch.from_arrays([pa.array([k // _PART_TERMS for k in starts], pa.int64()), pa.array([out[k : k + _PART_TERMS].astype(np.float32).tobytes() for k in starts], pa.binary())], names=["block", "part"])

    schema = "block long, tasks int, part binary"
    parts = texts.mapInArrow(partial, "block long, part binary").select("block", F.floor(F.spark_partition_id() / _PART_TASKS).cast("int").alias("tasks"), "part")
    some = parts.groupBy("block", "tasks").applyInArrow(_parts_added, schema)
    out = np.zeros(basis.shape)
    for r in some.groupBy("block").applyInArrow(_parts_added, schema).collect():  # as many rows as there are blocks of terms
        part = np.frombuffer(r["part"], np.float32).reshape(-1, width)
        out[r["block"] * _PART_TERMS : r["block"] * _PART_TERMS + len(part)] = part
    return out * weight[:, None]


def bounded_sample(docs: DataFrame, n_docs: int, max_docs: int) -> DataFrame:
    """About `max_docs` distinct texts at most, chosen by a hash of the text, written once."""
    sample = docs.where(F.col("text").isNotNull())
    if n_docs > max_docs:
        sample = sample.where(unit_hash(F.col("text")) < max_docs / n_docs)
    return stored(sample.groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text")).select("text"))


def latent_basis(texts: DataFrame, items: Items, vocabulary: dict[bytes, int], idf: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (terms x rank) of TF-IDF passages over the roots of their values, by a randomised Nystroem factorisation.

    Divided by the roots of the singular values, directions that all passages share count no more than
    those that tell them apart.

    Passages of all texts (column text), and of every item, which together weigh as much as
    the texts. These are read once, for the product z = A'(A x) with a random x: A'A is
    about z (x'z)^-1 z', exactly so if there are no more terms than columns of x.
    """
    v = len(vocabulary)
    width = min(v, rank + OVERSAMPLE)
    lists = [_ids(w, vocabulary) for w in items.words]
    lists = [np.where(x >= 0, np.where(idf[x] > 0, x, -1), -1) for x in lists]
    row, term, tf, _ = _tf_rows(lists, v)

    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((v, width)))[0].astype(np.float32)
    corpus = _corpus_gram(texts, vocabulary, idf, basis)
    own = _gram_times(row, term, tf * idf[term].astype(np.float32), basis).astype(np.float64)
    z = corpus + own * (np.linalg.norm(corpus) / max(np.linalg.norm(own), 1e-9) if np.linalg.norm(corpus) > 0 else 1.0)
    small = basis.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    kept = values > max(values.max(), 1e-9) * 1e-5  # what is less may be rounding
    if not kept.any():
        return np.zeros((v, 1), np.float32)
    left, roots, _ = np.linalg.svd(z @ (vectors[:, kept] / np.sqrt(values[kept])), full_matrices=False)
    scale = np.sqrt(np.maximum(roots[:rank], roots.max() * 1e-3))  # roots are singular values of A
    return (left[:, :rank] / scale).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


_FOUND = ("cosine", "order_share", "answer_share", "first_word")


class Search:
    """Finds the items of one pass in a text.

    Candidates are the passages that are near in the latent space, and besides them every
    place where enough of an item's rarest words stand: a text that holds the share `order`
    of n words lacks at most the rest of them, so of the rest and m more at least m are
    there. The latter leave out nothing that the word-order check accepts within n words of
    such a word, however many the items are and whatever the latent space tells apart.
    """

    def __init__(self, items: Items, vocabulary: dict[bytes, int], weighted: np.ndarray, cosine: float, order: float, order_with_answer: float, answer: float, df: np.ndarray | None = None):
        self.items, self.vocabulary, self.weighted = items, vocabulary, weighted
        self.places = [(places_of(w), places_of(a)) for w, a in zip(items.words, items.answers)]
        self.useful = np.append(np.any(weighted != 0, axis=1), False)
        self.cut = (cosine, order, order_with_answer, answer)
        row, term, tf, n = _tf_rows(lists := [self.terms(_ids(w, vocabulary)) for w in items.words], len(vocabulary))
        self.vectors = _unit(_project(row, term, tf, weighted, n))
        counts = np.array([_passage_count(len(x)) for x in lists])
        self.of, self.first = np.repeat(np.arange(len(lists)), counts), np.cumsum(counts) - counts
        self.index(np.zeros(len(vocabulary), np.int64) if df is None else df)

    def index(self, df: np.ndarray) -> None:
        """The items that look for each term: those that have it among their rarest words."""
        share = min(self.cut[1:3])
        self.lengths = np.array([len(w) for w in self.items.words])
        #: Words that pieces of a text share: a place and what is looked at about it lie in one of them.
        self.overlap = 2 * int(self.lengths.max(initial=0)) + (BLOCKS + 1) * BLOCK
        self.least = np.ones(len(self.lengths), np.int64)
        pairs = [np.zeros((2, 0), np.int64)]
        for k, words in enumerate(self.items.words):
            need = max(1, math.ceil(share * len(words) - 1e-9))
            self.least[k] = max(1, min(need, int(RARE * len(words))))
            ids = _ids(words, self.vocabulary)
            rarest = np.unique(ids[np.argsort(df[ids], kind="stable")[: len(words) - need + self.least[k]]])
            pairs.append(np.stack([rarest, np.full(len(rarest), k)]))
        term, self.owner = (both := np.concatenate(pairs, axis=1))[:, np.argsort(both[0], kind="stable")]
        self.fan = np.append(np.bincount(term, minlength=len(self.vocabulary)), 0)  # -1 is the last place
        self.start = np.cumsum(self.fan) - self.fan

    def terms(self, ids: np.ndarray) -> np.ndarray:
        return np.where(self.useful[ids], ids, -1)

    def rare_places(self, lists: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(piece, item, first word, words) of the places about which enough of the item's rarest words stand.

        The pieces stand one after another, too far apart to share a place. Of an item
        shorter than a block, each of these words is a place of its own.
        """
        reach = -(-int(self.lengths.max(initial=0)) // BLOCK) * BLOCK + 2 * BLOCK
        room = np.array([-(-len(x) // BLOCK) * BLOCK + reach for x in lists])
        offset = np.cumsum(room) - room
        ids = np.full(size := int(room.sum()), -1)
        for o, x in zip(offset, lists):
            ids[o : o + len(x)] = x
        total = np.cumsum(fan := self.fan[ids])
        if not size or not total[-1]:
            return
        ends = np.unique(np.append(np.searchsorted(total, np.arange(_PLACES_AT_ONCE, total[-1], _PLACES_AT_ONCE), "left") + 1, size))
        for a, b in zip(np.r_[0, ends[:-1]], ends):
            low = max(0, a - reach)
            at = low + np.flatnonzero(fan[low : b + reach])
            n = fan[at]
            place = np.repeat(at, n)
            item = self.owner[np.arange(len(place)) + np.repeat(self.start[ids[at]] - np.cumsum(n) + n, n)]
            key = np.sort(item * size + place)
            item, place = np.divmod(key, size)
            length = self.lengths[item]
            step = np.where(length < BLOCK, 1, BLOCK)
            first = place // step * step
            inside = np.searchsorted(key, item * size + np.minimum(first + step + length, size)) - np.searchsorted(key, item * size + np.maximum(first - length, 0))
            some = (inside >= self.least[item]) & (place >= a) & (place < b)
            for item, first in zip(*np.divmod(np.unique(item[some] * size + first[some]), size)):
                piece = int(np.searchsorted(offset, first, "right")) - 1
                yield piece, int(item), int(first - offset[piece]), 1 if self.lengths[item] < BLOCK else BLOCK

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(text's place, item's place, cosine, share in order, answer's share, first word), once for a text and an item.

        The texts' blocks stand one after another, with empty ones between texts; a
        passage's vector is the sum of its blocks'.
        """
        pieces = [(k, before, words) for k, text in enumerate(texts) for before, words in pieces_of(text, self.overlap)]
        ids = [_ids(words, self.vocabulary) for _, _, words in pieces]
        terms = [self.terms(x) for x in ids]
        blocks = np.array([-(-len(t) // BLOCK) + BLOCKS - 1 for t in terms])
        first_block = np.cumsum(blocks) - blocks + BLOCKS - 1
        at = [np.flatnonzero(t >= 0) for t in terms]
        block = np.concatenate([a // BLOCK + f for a, f in zip(at, first_block)] or [np.zeros(0, np.int64)])
        sums = _project(block, np.concatenate([t[a] for t, a in zip(terms, at)]), None, self.weighted, int(blocks.sum()) + BLOCKS - 1) if len(block) else np.zeros((int(blocks.sum()) + BLOCKS - 1, self.weighted.shape[1]), np.float32)
        vectors = sum(sums[k : len(sums) - BLOCKS + 1 + k] for k in range(BLOCKS))
        some = np.flatnonzero(np.any(vectors, axis=1))
        best: dict[tuple[int, int, int], tuple[float, int]] = {}
        step = max(1, _COSINES_AT_ONCE // len(self.vectors))
        for part in (some[k : k + step] for k in range(0, len(some), step)):
            near = _unit(vectors[part]) @ self.vectors.T
            for p, k in zip(*np.nonzero(near >= self.cut[0])):
                item, piece = int(self.of[k]), int(np.searchsorted(first_block, part[p] + BLOCKS - 1, "right")) - 1
                passage = max(0, int(part[p] - first_block[piece]))
                span = -(-len(self.items.words[item]) // BLOCK) + BLOCKS
                key = (piece, item, passage // span)  # the best passage of each stretch as long as the item
                if near[p, k] > best.get(key, (0.0, 0))[0]:
                    best[key] = (float(near[p, k]), passage)
        found: dict[tuple[int, int], tuple[float, float, float, int]] = {}

        def look(piece: int, item: int, first: int, length: int, cosine: float | None) -> None:
            text, before, words = pieces[piece]
            got = self.check(words, item, first, length)
            if got and got[0] > found.get((text, item), (0.0, 0.0))[1]:
                if cosine is None:
                    own = self.vectors[self.first[item] : self.first[item] + _passage_count(len(self.items.words[item]))]
                    cosine = float((own @ _unit(vectors[None, first_block[piece] + first // BLOCK])[0]).max())
                found[text, item] = (cosine, *got, (before, words, first, length))

        for (piece, item, _), (cosine, passage) in best.items():
            look(piece, item, passage * BLOCK, BLOCK * BLOCKS, cosine)
        for piece, item, first, length in self.rare_places(ids):
            if found.get((pieces[piece][0], item), (0.0, 0.0))[1] < 1.0:
                look(piece, item, first, length, None)
        for (text, item), (cosine, share, answered, (before, words, first, length)) in found.items():
            low, around = self.around(words, item, first, length)
            yield text, item, cosine, share, answered, before + low + last_start(self.items.words[item], around)

    def around(self, words: list[bytes], item: int, start: int, length: int) -> tuple[int, list[bytes]]:
        """Where the words that are looked at about a place start, and these: as many as the item has on either side."""
        n = len(self.items.words[item])
        return max(0, start - n), words[max(0, start - n) : start + length + n]

    def check(self, words: list[bytes], item: int, start: int, length: int) -> tuple[float, float] | None:
        """Shares of the item's and its answer's words that stand in order about the words of a place."""
        want, answer = self.items.words[item], self.items.answers[item]
        _, around = self.around(words, item, start, length)
        share = common_in_order(want, around, self.places[item][0]) / max(1, len(want))
        _, order, with_answer, least = self.cut
        if share < with_answer:
            return None
        got = common_in_order(answer, around, self.places[item][1]) / max(1, len(answer))
        return (share, got) if share >= order or got >= least else None


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
    rank: int = RANK, max_fit_docs: int | None = None, cosine: float = COSINE, order: float = ORDER, order_with_answer: float = ORDER_WITH_ANSWER, answer: float = ANSWER,
) -> DataFrame:
    """One row for each document and item found in it: ids, cosine, shares in order, first word (from 0) of what is found.

    The benchmark is the query set; it is searched for in the whole of docs, in passes of
    a bounded number of items and bytes, a scan each; besides these the corpus is read once for the frequencies
    of all terms, by which they are weighed, and once for the texts that the space is fitted on: all
    of them (stored first if there are several passes), unless max_fit_docs says about how many distinct ones are enough.
    Passages whose latent vector is near to one of an item's are candidates, and so are all
    places with enough of an item's rarest words, by which no occurrence is left out; then
    the longest common subsequence of words must hold most of the item, or half of it and
    its answer (answer_col, or else the item's last sentence), wherever it stands.

    Defined results: null, empty and wordless texts or items are never found; a row with
    a null item id is not searched for; ids of items are whole numbers or else become
    strings, those of docs stay as they are; repeated rows of docs are each reported, a null
    doc id is carried; an empty table on either side gives no rows; extra columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    whole = wanted.schema[item_col].dataType.typeName() in ("byte", "short", "integer", "long")
    wanted = wanted.select(F.col(item_col).cast("long" if whole else "string").alias("id"), F.col(item_text_col).cast("string").alias("text"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer"))
    told = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(-(-told["n"] // ITEMS_A_PASS), -(-told["bytes"] // BYTES_A_PASS))
    kinds = base.select(F.col("id").alias("doc_id")).schema.add("item_id", wanted.schema["id"].dataType)
    for name in _FOUND:
        kinds = kinds.add(name, "long" if name == "first_word" else "double")
    out, texts, written = spark.createDataFrame([], kinds), None, []
    counts = all_frequencies(base, wanted) if passes > 1 else None
    if counts is not None:
        written.append(counts)
    for k in range(passes):
        part = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k)
        items = Items.of(part.orderBy("id", "text").collect(), answer_col)
        vocabulary = items.vocabulary()
        if not vocabulary:
            continue
        n_docs, df = document_frequencies(base, vocabulary) if counts is None else frequencies_of(counts, vocabulary)
        idf = _weights(items, vocabulary, n_docs, df)
        if texts is None:
            texts = base.select("text")
            if max_fit_docs is not None or passes > 1:
                texts = stored(texts) if max_fit_docs is None else bounded_sample(base, n_docs, max_fit_docs)
                written.append(texts)
        basis = latent_basis(texts, items, vocabulary, idf, rank)
        sent = spark.sparkContext.broadcast((items, vocabulary, idf.astype(np.float32)[:, None] * basis))
        out = out.unionByName(base.mapInArrow(_search(sent, (cosine, order, order_with_answer, answer), df), kinds))
    drop_stored(*written)
    return out.withColumnRenamed("doc_id", id_col).withColumnRenamed("item_id", item_col)


def _search(sent, cuts: tuple, df: np.ndarray):
    made: list[Search] = []
    item_type = pa.int64() if isinstance(sent.value[0].ids[0], int) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Search(*sent.value, *cuts, df))
        ids = made[0].items.ids
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            rows = [(k + j, ids[i], *rest) for k in range(0, len(texts), _TEXTS_AT_ONCE) for j, i, *rest in made[0].hits(texts[k : k + _TEXTS_AT_ONCE])]
            at, items, *values = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [docs.take(pa.array(at, pa.int64())), pa.array(items, item_type), *(pa.array(c, pa.int64() if n == "first_word" else pa.float64()) for n, c in zip(_FOUND, values))],
                names=["doc_id", "item_id", *_FOUND],
            )

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs in which no item is found.

    Defined results: a row with a null id can't be told by it and stays; of rows that
    repeat an id all go if an item is found in one; null texts stay; columns are as they
    were; an empty table gives no rows, and an empty benchmark leaves all.
    """
    leaks = find_leaks(docs, benchmark, id_col=id_col, **options).select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return docs.join(leaks, id_col, "left_anti").select(docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in documents."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
