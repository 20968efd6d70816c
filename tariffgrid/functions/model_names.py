"""The parts of a model's name as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A version: a number, with one decimal part at most.
VERSION = r"\d+(?:\.\d+)?"


def name_parts(model: str | Column) -> Column:
    """struct(name, stem, version, rest, words) of a name in lower case.

    stem: what stands before the first digit, all of it without one; version: the number there,
    null without one; rest: what follows; words: runs of letters, digits and underscores.
    """
    name = F.lower(model)
    found = F.regexp_extract(name, rf"^\D*({VERSION})", 1)
    stem = F.regexp_extract(name, r"^\D*", 0)
    return F.struct(
        name.alias("name"),
        stem.alias("stem"),
        F.nullif(found, F.lit("")).alias("version"),
        F.substr(name, F.length(stem) + F.length(found) + 1).alias("rest"),
        F.split(name, r"[^a-z0-9_]+").alias("words"),
    )
