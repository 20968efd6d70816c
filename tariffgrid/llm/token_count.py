"""Token counts of whole texts; huge texts by overlapping chunks that resynchronise."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffgrid.llm.common import prepare, read_table

#: Code points of a chunk, of the first overlap, and the length up to which a text is one chunk.
CHUNK, OVERLAP, WHOLE = 20_000, 256, 24_000
LIMIT = 4096
VOCABULARY = "piece_bpe_32k.model"
_SPACE = "▁"


class PieceCounter:
    """Counts the pieces that a sentencepiece BPE model makes of a text.

    Where a model's pieces contain no two neighbouring characters (a, b), no merge ever
    joins an a to a following b: the text on either side of such a place is encoded alike
    whatever stands on the other side. That is what proves a common boundary stable.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, whole: int = WHOLE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap, self.whole = chunk, overlap, max(whole, chunk)
        self.joined: set[tuple[str, str]] = set()
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)):
                piece = self.model.id_to_piece(i)
                self.joined.update(itertools.pairwise(piece))

    def counts(self, texts: list[str]) -> list[int]:
        short = [t if len(t) <= self.whole else "" for t in texts]
        got = [len(ids) for ids in self.model.encode(short, num_threads=1)]
        return [n if len(t) <= self.whole else self.count_long(t) for n, t in zip(got, texts)]

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece can span the place before text[at]."""
        return (text[at - 1].replace(" ", _SPACE), text[at].replace(" ", _SPACE)) not in self.joined

    def starts(self, text: str, start: int, end: int) -> list[int]:
        """Where in text each piece of text[start:end] starts; the pieces of one character's bytes start alike."""
        return [start + a for a, _ in self.model.encode(text[start:end], return_type="offset_mapping")["offsets"]]

    def last_stable(self, text: str, low: int, high: int) -> int | None:
        """The last place in (low, high) that no piece can span."""
        return next((p for p in range(high - 1, low, -1) if self.stable(text, p)), None)

    def count_long(self, text: str) -> int:
        """Encode chunks that overlap, and splice each pair at a stable boundary that both have.

        Where alignment fails the overlap widens; where a chunk holds no stable place at all,
        it is encoded anew at twice the length, so that the whole work stays linear.
        """
        total, start, end, overlap = 0, 0, min(self.chunk, len(text)), self.overlap
        pieces = self.starts(text, 0, end)
        taken = bare = 0  # pieces that start before `taken` are counted; up to `bare` no place is stable
        while end < len(text):
            splice, next_start, next_end = None, taken, min(end + self.chunk, len(text))
            if (place := self.last_stable(text, max(taken, bare - 1), end)) is not None:
                next_start = max(taken, place - overlap)
                following = self.starts(text, next_start, next_end)
                common = set(pieces).intersection(following)
                splice = next((p for p in sorted(common, reverse=True) if next_start < p and self.stable(text, p)), None)
            else:
                bare = end
            if splice is not None:
                total += sum(1 for p in pieces if taken <= p < splice)
                taken, start, end, pieces, overlap, bare = splice, next_start, next_end, following, self.overlap, 0
            elif next_start > taken:
                overlap *= 2
            else:
                end, overlap = min(2 * end - start, len(text)), self.overlap
                pieces = self.starts(text, start, end)
        return total + sum(1 for p in pieces if p >= taken)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of docs, over whole texts.

    vocabulary: path of a sentencepiece model, which every machine can open; by default
    that of the installed public vocabulary. No begin, end or special tokens are added.

    Defined results: a null text is an empty one, with 0 tokens; repeated rows are each
    counted; a null id is carried; extra columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    made: list[PieceCounter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            if vocabulary is None:
                import public_tokenizers

                made.append(PieceCounter(public_tokenizers.path(VOCABULARY), chunk, overlap))
            else:
                made.append(PieceCounter(vocabulary, chunk, overlap))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = made[0].counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, narrow.select(id_col).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(read_table(spark, sf_dir, "documents"))
