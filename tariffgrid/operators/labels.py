"""Where many labels first stand in many pages, found in one pass over each page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as kinds
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels of one matcher, which goes to every task; more of them take a matcher each so many.
LABELS_A_PASS = 50_000
_META = re.compile(r"[\\^$.|?*+()\[\]{}]")


def anchor(label: str) -> tuple[str, bool] | None:
    """(text, True) of a label without pattern signs; (text that every match holds, False) of another, None if none is known."""
    if not _META.search(label):
        return (label, True) if label else None
    try:
        parsed = parser.parse(label)
    except re.error:
        return None
    if parsed.state.flags & re.IGNORECASE:
        return None
    runs, now = [], ""
    for kind, value in parsed:
        if kind is kinds.LITERAL:
            now += chr(value)
        else:
            runs.append(now)
            now = ""
    best = max([*runs, now], key=len)
    return (best, False) if best else None


def _finder(labels: list[str]):
    """For each page's text the places of plain labels, and which patterns may match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        table, always = ahocorasick.Automaton(), []
        of: dict[str, list[tuple[int, bool]]] = {}
        for k, label in enumerate(labels):
            if (found := anchor(label)) is None:
                always.append(k)
            else:
                of.setdefault(found[0], []).append((k, found[1]))
        for text, entries in of.items():
            table.add_word(text, (len(text), entries))
        if of:
            table.make_automaton()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                first: dict[int, int] = dict.fromkeys(always, 0)
                for end, (length, entries) in table.iter(text or "") if of else ():
                    for k, plain in entries:
                        first.setdefault(k, end - length + 2 if plain else 0)
                rows.append([{"k": k, "at": at} for k, at in first.items()] if text else [])
            found = pa.array(rows, pa.list_(pa.struct([("k", pa.int32()), ("at", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["source_id", "text", "found"])

    return run


def label_places(pages: DataFrame, specs: DataFrame, labels_a_pass: int = LABELS_A_PASS) -> DataFrame:
    """(source_id, text, slug, label, at) of each spec (slug, label) in each page (source_id, text): its first match, from 1.

    Labels may be patterns. Plain ones are found in one pass over a page, however many they
    are; a pattern is only tried on pages that hold the text which all its matches hold.
    Null texts have no labels; specs that share a label are each found; a label is never empty.
    """
    known = [(r["slug"], r["label"]) for r in specs.select("slug", "label").collect()]  # a table that people write
    parts = None
    for start in range(0, max(1, len(known)), labels_a_pass):
        some = known[start : start + labels_a_pass]
        table = pages.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(some)], "k int, slug string, label string")
        narrow = pages.select(F.col("source_id").cast("string").alias("source_id"), "text")
        found = narrow.mapInArrow(_finder([label for _, label in some]), "source_id string, text string, found array<struct<k:int,at:int>>")
        rows = found.select("source_id", "text", F.inline("found")).join(F.broadcast(table), "k")
        placed = rows.withColumn("at", F.when(F.col("at") > 0, F.col("at")).otherwise(F.regexp_instr("text", F.col("label")))).where("at > 0")
        part = placed.select("source_id", "text", "slug", "label", "at")
        parts = part if parts is None else parts.unionByName(part)
    return parts
