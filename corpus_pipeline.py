"""Clean a corpus in stages; each works on all that the stage before it kept.

Every stage but the last gives rows of its input with all their columns, whatever these
are named, and gives none for an empty table. A null id is carried through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tariffgrid.llm.common import drop_stored, read_table, stored
from tariffgrid.llm.decontaminate import drop_leaks
from tariffgrid.llm.language_id import identify_languages
from tariffgrid.llm.near_dedup import keep_first_of_class, near_duplicate_classes
from tariffgrid.llm.quality_rules import keep_good
from tariffgrid.llm.source_mix import mix_sources


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined.

    A null text, and one without letters, goes; null languages are not learned from;
    repeated rows are each judged; of languages that tie the first by name is taken. A
    table without any language label leaves no rows.
    """
    return identify_languages(docs).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table.

    A null or empty text has no words and goes; repeated rows are each judged; a metric at
    its bound passes.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of the least id.

    Rows of a null id stay, rows that repeat an id count as one document, of which the
    first by its columns stays; null and wordless texts are classes of their own.
    """
    return keep_first_of_class(docs, near_duplicate_classes(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    All rows of an id go if an item is found in one of them; rows of a null id, which
    can't be told by it, and null texts stay.
    """
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target and taken.

    A null source is a source, a null text has size 0, repeated rows are documents of
    their own.
    """
    return mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: No SQL expresses the learned and hashed stages; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what each keeps is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
            if before is not None:
                drop_stored(before)
            before = docs
    return docs
