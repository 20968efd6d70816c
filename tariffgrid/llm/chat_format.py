r"""Chat formatting with typed content parts, and reading it back.

A turn is written as

    <|turn ROLE|>\nCONTENT\n<|end|>\n

and a conversation as its turns one after another. In texts a backslash is doubled and
`<|` becomes `<\|`, so that no text can hold a control string; in roles `|` and a newline
are escaped too. Unescaping is exact.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffgrid.llm.common import prepare, read_table

HEAD, MIDDLE, END = "<|turn ", "|>\n", "\n<|end|>\n"
#: Roles whose content the model learns to write.
LOSS_ROLES = ("assistant",)
#: Pixels of a side that one image token covers; audio tokens a second; tokens of a document's page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 400
#: type: text, image, audio or document; text for text; ref names the attachment; width and
#: height in pixels, seconds of audio and pages of a document give its token count.
PART_SCHEMA = "type string, text string, ref string, width long, height long, seconds double, pages long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("|", "\\p").replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|pn])", lambda m: {"p": "|", "n": "\n"}.get(m[1], m[1]), text) if "\\" in text else text


@dataclass
class Flattener:
    """Visits the parts of a turn in order and flattens them to text with placeholders."""

    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(side) or 0) / IMAGE_PATCH) for side in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        """A part of an unknown type is kept as an attachment without tokens."""
        self._attach("other", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        at = len(self.attachments)
        self.attachments.append({"place": at, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.out.append(f"<|{kind} {at}|>")


_ATTACHMENTS = T.ArrayType(T.StructType().add("place", "long").add("kind", "string").add("ref", "string").add("tokens", "long"))
_ATTACHMENT = pa.struct([("place", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])


def format_turn(role: str | None, parts: list[dict] | None, loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[str, int | None, int | None, list[dict]]:
    """The turn as text, where its content under the loss starts and ends (else null), and its attachments."""
    flat = Flattener()
    for part in parts or []:
        flat.visit(part)
    head, content = f"{HEAD}{escape_role(role or '')}{MIDDLE}", "".join(flat.out)
    start = len(head) if role in loss_roles else None
    return f"{head}{content}{END}", start, None if start is None else start + len(content), flat.attachments


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv, turn, role, formatted, loss_start, loss_end, attachments) of every turn.

    parts_col holds an array of PART_SCHEMA structs. A conversation's text is its turns'
    `formatted`, joined in order of (turn, formatted), nulls first; turns stay rows, so that
    no conversation has to fit in one task's memory. attachments: place, kind, ref and
    expanded token count, in the order of the placeholders `<|kind place|>`.

    Defined results: a null role is an empty one; null parts are no content; repeated rows
    are turns of their own; null conversation ids form one conversation; extra columns are
    ignored; an empty table gives no rows.
    """
    prepare(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(role, parts, loss_roles) for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), pa.array([m[3] for m in made], pa.list_(_ATTACHMENT))],
                names=[conv_col, turn_col, role_col, "formatted", "loss_start", "loss_end", "attachments"],
            )

    narrow = turns.select(conv_col, turn_col, role_col, F.col(parts_col).alias("parts to read"))
    schema = narrow.select(conv_col, turn_col, role_col).schema.add("formatted", "string").add("loss_start", "long").add("loss_end", "long")
    return narrow.mapInArrow(run, schema.add("attachments", _ATTACHMENTS))


class _Conversation:
    """Digests of one conversation, fed with its formatted turns."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def feed(self, formatted: str, start: int | None, end: int | None) -> None:
        head, _, rest = formatted.removeprefix(HEAD).partition(MIDDLE)
        content = rest.removesuffix(END)
        self.turns.update(f"{unescape(head)}\n{unescape(content)}\n".encode("utf-8", "surrogatepass"))
        if start is not None:
            learned = unescape(formatted[start:end])
            self.loss.update(learned.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(learned)
        self.n_turns += 1
        self.formatted_chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


_DIGESTS = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def read_back(formatted: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """What the formatted turns say: one row a conversation with counts and digests.

    Turns are dealt out by conversation and sorted there; each task streams over them and
    keeps the running digests of one conversation, however many turns it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * 6
            rows = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], _DIGESTS))], names=[conv_col, *(n for n, _ in _DIGESTS)])
            done.clear()
            return rows

        for batch in batches:
            for conv, text, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != key:
                    if now is not None:
                        done.append((key, *now.row()))
                    now, key = _Conversation(), conv
                now.feed(text, start, end)
            if len(done) >= 1000:
                yield out()
        if now is not None:
            done.append((key, *now.row()))
        yield out()

    dealt = formatted.select(F.col(conv_col).cast("long").alias(conv_col), turn_col, "formatted", "loss_start", "loss_end").repartition(conv_col)
    ordered = dealt.sortWithinPartitions(F.col(conv_col), F.col(turn_col).asc_nulls_first(), F.col("formatted")).select(conv_col, "formatted", "loss_start", "loss_end")
    return ordered.mapInArrow(run, f"`{conv_col}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, formatted and read back."""
    odd = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(odd).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")).cast("struct<type:string,text:string>")
    return read_back(format_conversations(turns.withColumn("parts", F.array(part))))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(k, r)
), f AS (
  SELECT *, '<|turn ' || replace(replace(replace(role, '\', '\\'), '|', '\p'), chr(10), '\n') || '|>' || chr(10)
         || replace(replace(text, '\', '\\'), '<|', '<\|') || chr(10) || '<|end|>' || chr(10) AS formatted FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
