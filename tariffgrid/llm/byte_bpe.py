"""Byte-level BPE over Arrow batches: texts to ids with offsets, ids back to bytes and text."""

from __future__ import annotations

import base64
import itertools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffgrid.llm.common import prepare, read_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of the texts that are split and joined at a time, and matches of a long text.
CALL, MATCHES = 1_000_000, 200_000
#: Matches whose ids a task remembers, and the longest of them.
KNOWN, KNOWN_CHARS = 400_000, 64


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary's tokens.

    Printable bytes stand for themselves; the others, in order, take the characters from 256 on.
    """
    shown = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    spare = iter(range(256, 512))
    return [chr(b) if shown[b] else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of base64 tokens, one a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteEncoder:
    """Encodes each match of the pattern by the ranks, in the tokenizers library.

    The file has ranks but no merges: two neighbours are merged if they make a token, the
    lowest rank first. So every way to halve a token is a merge here, in order of the
    token's rank, and a match that is a token as a whole is taken as it is.

    A match's ids don't depend on what stands around it. So the library gets each different match
    of a few texts once, in one call, and a bounded table remembers short ones for the next texts.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, call: int = CALL, known: int = KNOWN, matches: int = MATCHES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        shown = byte_characters()
        name = {token: "".join(shown[b] for b in token) for token in ranks}
        halves = [(name[t[:k]], name[t[k:]]) for t in sorted(ranks, key=ranks.get) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.tokenizer = Tokenizer(BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=halves, ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        self.call, self.most_known, self.matches = call, known, matches
        self.known: dict[str, bytes] = {}
        self.known_spans: dict[str, bytes] = {}

    def _learn(self, found: set[str], offsets: bool) -> dict[str, bytes]:
        """A table that has the ids, or (start, end) pairs, of all these matches as int32 bytes."""
        table = self.known_spans if offsets else self.known
        new = found.difference(table)
        if len(table) + len(new) > self.most_known:
            table.clear()
            new = found
        new = list(new)
        for m, e in zip(new, (self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast)(new, add_special_tokens=False)):
            table[m] = array("i", itertools.chain.from_iterable(e.offsets) if offsets else e.ids).tobytes()
        return table

    def _joined(self, lists: list[list[str]]) -> list[np.ndarray]:
        found = set().union(*lists)
        table = self._learn(found, False)
        ids = [np.frombuffer(b"".join(map(table.__getitem__, matches)), np.int32) for matches in lists]
        for m in found:
            if len(m) > KNOWN_CHARS:
                del table[m]
        return ids

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        call, size = [], 0
        for text in [*texts, None]:
            if call and (text is None or size + len(text) > self.call):
                yield from self._joined([self.pattern.findall(t) for t in call])
                call, size = [], 0
            if text is not None and len(text) > self.call:  # by a bounded number of matches at a time
                found = (m[0] for m in self.pattern.finditer(text))
                yield np.concatenate([self._joined([part])[0] for part in iter(lambda: list(itertools.islice(found, self.matches)), [])])
            elif text is not None:
                call.append(text)
                size += len(text)

    def spans(self, text: str) -> np.ndarray:
        """The (start, end) characters that each id of a text covers; the parts of a split character all span it."""
        at, parts, found = 0, [], self.pattern.finditer(text)
        for some in iter(lambda: [m[0] for m in itertools.islice(found, self.matches)], []):
            table = self._learn(set(some), True)
            inside = [table[m] for m in some]
            starts = at + np.cumsum([0, *map(len, some)])
            flat = np.frombuffer(b"".join(inside), np.int32).reshape(-1, 2).astype(np.int64)
            parts.append(flat + np.repeat(starts[:-1], [len(x) // 8 for x in inside])[:, None])
            at = int(starts[-1])
        return np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)


class ByteDecoder:
    """Bytes of ids, by the table of characters read backwards."""

    def __init__(self, ranks: dict[bytes, int]):
        shown = byte_characters()
        byte_of = {c: b for b, c in enumerate(shown)}
        names = {rank: "".join(shown[b] for b in token) for token, rank in ranks.items()}
        self.bytes = {rank: bytes(byte_of[c] for c in name) for rank, name in names.items()}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _ranks(vocabulary: str | None) -> dict[bytes, int]:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    return read_ranks(vocabulary)


def some_rows(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (id, text) of about so many characters at most, or one row."""
    sizes, start, held = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist(), 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def encode_texts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, vocabulary: str | None = None, pattern: str | None = None, call: int = CALL, known: int = KNOWN
) -> DataFrame:
    """(id, ids) of every row, and with offsets `starts` and `ends`: the characters of the text that each id covers.

    vocabulary: path of a rank file that every machine can open, by default that of the
    installed public vocabulary; pattern: how texts are split, by default its own.

    Defined results: a null text is an empty one, with no ids; repeated rows are each
    encoded; a null id is carried; an empty table gives no rows; extra columns are ignored.
    Strings of special tokens are ordinary text. Texts are encoded whole, long ones some
    matches at a time; what a task holds beside the text is bounded by call and known.
    """
    prepare(docs.sparkSession)
    made: list[ByteEncoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            import public_tokenizers

            made.append(ByteEncoder(_ranks(vocabulary), pattern or public_tokenizers.PATTERN, call, known))
        for batch in batches:
            for rows in some_rows(batch, call):
                texts = [t or "" for t in rows.column(1).to_pylist()]
                ids = list(made[0].encode(texts))
                ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))]
                if offsets:
                    both = np.concatenate([made[0].spans(t) for t in texts])
                    lists += [pa.ListArray.from_arrays(ends, pa.array(both[:, k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *lists], names=[id_col, *names])

    names = ["ids", "starts", "ends"] if offsets else ["ids"]
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = narrow.select(id_col).schema
    for name in names:
        schema = schema.add(name, T.ArrayType(T.IntegerType() if name == "ids" else T.LongType()))
    return narrow.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None, with_text: bool = True) -> DataFrame:
    """(id, ids, decoded, decoded_text) of every row: the bytes, and (with_text) the text they spell.

    Ids may begin or end inside a character, as any slice of a text's ids may: the bytes are
    exact, and in the text what is no whole character becomes U+FFFD. decoded_text of joined
    slices is not the joined text; that of joined bytes is.

    Defined results: null ids are no ids, with empty bytes; an unknown id raises; repeated rows
    and null row ids are carried; an empty table gives no rows.
    """
    prepare(encoded.sparkSession)
    made: list[ByteDecoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(ByteDecoder(_ranks(vocabulary)))
        for batch in batches:
            lists = batch.column(1)
            flat, ends, valid = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist(), lists.is_valid().to_pylist()
            got = [made[0].decode(flat[a:b].tolist() if ok else ()) for a, b, ok in zip(ends, ends[1:], valid)]
            made_of = [batch.column(0), lists, pa.array(got, pa.binary())]
            if with_text:
                made_of.append(pa.array([b.decode("utf-8", "replace") for b in got], pa.string()))
            yield pa.RecordBatch.from_arrays(made_of, names=names)

    names = [id_col, ids_col, "decoded", "decoded_text"][: 4 if with_text else 3]
    schema = encoded.select(id_col, ids_col).schema.add("decoded", "binary")
    return encoded.select(id_col, ids_col).mapInArrow(run, schema.add("decoded_text", "string") if with_text else schema)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their way back, as digests."""
    back = decode_ids(encode_texts(read_table(spark, sf_dir, "documents")), with_text=False)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
