"""Column functions over page text: visible text, windows, Markdown cells, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The named character references that visible_text() decodes.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&yen;": "¥", "&amp;": "&"}


#: What references to the control characters from 128 to 159 mean: the characters of code page 1252 there.
_CONTROLS = {chr(b): c for b in range(128, 160) if (c := bytes([b]).decode("cp1252", "ignore"))}


def numeric_references(text: Column) -> Column:
    """Text with `&#36;`, `&#x24;` and the like decoded, also without the semicolon; what names no character stays as it is."""

    def decoded(part: Column) -> Column:
        said = F.regexp_extract(part, r"^([xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});?", 0)
        digits = F.regexp_replace(said, "[xX;]", "")
        code = F.when(said.rlike("^[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        char = F.translate(char, "".join(_CONTROLS), "".join(_CONTROLS.values()))
        is_one = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(F.coalesce(is_one, F.lit(False)), F.concat(char, F.substr(part, F.length(said) + 1))).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#")
    many = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded), ""))
    return F.when(text.contains("&#"), many).otherwise(text)


def visible_text(page: Column) -> Column:
    """Text of an HTML page without comments, hidden elements and tags, one space between pieces."""
    text = F.regexp_replace(page, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", " ")
    text = numeric_references(F.regexp_replace(text, r"(?s)<[^>]+>", " "))
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def position(text: Column, marker: Column | str, start: Column | int = 1) -> Column:
    """1-based place of a marker at or after start, 0 if there is none."""
    marker = F.lit(marker) if isinstance(marker, str) else marker
    start = F.lit(start) if isinstance(start, int) else start
    return F.call_function("locate", marker, text, start)


def window_between(text: Column, start: str, end: str) -> Column:
    """From the start marker up to the end marker after it; null unless both stand in the text."""
    a = position(text, start)
    b = position(text, end, F.greatest(a, F.lit(1)))
    return F.when((a > 0) & (b > 0), F.substr(text, a, b - a))


def window_after(text: Column, marker: str, width: int) -> Column:
    """The marker and what follows it, `width` characters in all; empty if it is missing."""
    a = position(text, marker)
    return F.when(a > 0, F.substr(text, a, F.lit(width))).otherwise(F.lit(""))


def product_window(text: Column, name: str, next_names: tuple[str, ...], width: int = 900) -> Column:
    """Text from a product's heading, case-blind, to the next heading or `width`; empty if it is missing."""
    low = F.lower(text)
    a = position(low, name.lower())
    stops = [F.nullif(position(low, n.lower(), a + len(name)), F.lit(0)) for n in next_names]
    end = F.least(F.length(text) + 1, a + width, *stops)
    return F.when(a > 0, F.substr(text, a, end - a)).otherwise(F.lit(""))


def first_number(text: Column, *patterns: str) -> Column:
    """Number in group 1 of the first pattern that matches, patterns in order of priority."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double") for p in patterns))


def all_numbers(text: Column, pattern: str) -> Column:
    """Every number in group 1 of the pattern."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("double"))


def markdown_cells(line: Column) -> Column:
    """Cells of a Markdown table row; empty for another line. Pipes at either end are all stripped."""
    trimmed = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    cells = F.transform(F.split(F.regexp_replace(trimmed, r"^\|+|\|+$", ""), r"\|"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(trimmed.startswith("|"), cells).otherwise(F.array().cast("array<string>"))


def is_separator(cells: Column) -> Column:
    """Whether every cell of a row holds only colons, dashes and spaces."""
    return F.forall(cells, lambda c: c.rlike(r"^[:\- ]*$"))


def has_columns(cells: Column, *names: str) -> Column:
    """Whether a header row names all of the columns, case-blind."""
    return F.size(F.array_except(F.array(*(F.lit(n) for n in names)), F.transform(cells, F.lower))) == 0


def plain_cell(cell: Column) -> Column:
    """A cell without tags, emphasis and escapes."""
    return F.trim(F.replace(F.replace(F.regexp_replace(cell, r"<[^>]+>", " "), F.lit("**"), F.lit("")), F.lit("\\"), F.lit("")))


def column_index(cells: Column, synonyms: dict[str, tuple[str, ...]]) -> Column:
    """map(column, 0-based index) of a header by synonyms, blanks and case ignored; later columns win."""
    names = F.transform(cells, lambda c: F.replace(F.lower(plain_cell(c)), F.lit(" "), F.lit("")))
    pairs = [F.struct(F.lit(k).alias("k"), F.array_max(_places(names, of)).alias("v")) for k, of in synonyms.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def _places(names: Column, of: tuple[str, ...]) -> Column:
    return F.filter(F.transform(names, lambda n, i: F.when(n.isin(*of), i)), lambda i: i.isNotNull())


def token_bracket(cells: Column) -> Column:
    """Pricing condition of a row: `standard` without brackets, else input_lte_<n><k|m> of the first cell that has one."""

    def of(cell: Column) -> Column:
        compact = F.lower(F.replace(cell, F.lit(" "), F.lit("")))
        bound = F.regexp_extract(F.get(F.split(compact, "token≤"), F.lit(1)), r"^\d[\d.]*[km]", 0)
        return F.when(compact.contains("无阶梯计价"), F.lit("standard")).when(bound != "", F.concat(F.lit("input_lte_"), bound))

    return F.coalesce(F.get(F.filter(F.transform(cells, of), lambda x: x.isNotNull()), F.lit(0)), F.lit("standard"))


def half_million_bracket(cell: Column) -> Column:
    """Pricing condition of a model cell that tells input up to or over 512K."""
    compact = F.replace(F.lower(cell), F.lit(" "), F.lit(""))
    return F.when(compact.contains("≤512k"), "input_lte_512k").when(compact.contains(">512k"), "input_gt_512k").otherwise("standard")


def json_rows(page: Column) -> Column:
    """The matrix of strings of a `rows={[[…]]}` attribute, read as JSON; null if there is none or it is no matrix."""
    start = position(page, "rows={")
    value = F.get(F.split(F.substr(page, start + len("rows={")), r"\]\s*\}"), F.lit(0))  # up to the end of the outer array
    inner = F.regexp_replace(F.regexp_replace(value, r"[\s,]+$", ""), r"^\s*\[", "")
    return F.when(start > 0, F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<array<string>>"))
