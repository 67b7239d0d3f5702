"""Scalar expressions and predicates over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholder names as most scans read them, and as the plain filler does (no digits).
PLACEHOLDER = r"\{\{([A-Z0-9_]+)\}\}"
PLACEHOLDER_NO_DIGITS = r"\{\{([A-Z_]+)\}\}"


#: White space of Unicode.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends; only the ends are looked at."""
    return F.btrim(x, F.lit(WHITE))


def present(x: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(x, F.lit("")) != ""


def preview(x: Column, width: int = 100, always: bool = False) -> Column:
    """The first ``width`` characters; an ellipsis if something is cut, or always."""
    cut = F.concat(F.substring(x, 1, width), F.lit("..."))
    return cut if always else F.when(F.length(x) > width, cut).otherwise(x)


def element_path(kind: Column, paragraph: Column, table: Column, row: Column, cell: Column) -> Column:
    return (
        F.when(kind == "paragraph", F.format_string("p[%d]", paragraph))
        .when(kind == "table_cell", F.format_string("table[%d]/row[%d]/cell[%d]", table, row, cell))
        .when(kind.isin("header", "footer"), F.format_string("%s/p[%d]", kind, paragraph))
        .otherwise(F.format_string("unknown[%d]", paragraph))
    )


def tag(name: Column) -> Column:
    return F.concat(F.lit("{{"), name, F.lit("}}"))


def normal_placeholder(placeholder: Column, category: Column) -> Column:
    return F.when(F.startswith(placeholder, F.lit("{{")), placeholder).otherwise(tag(category))


def position(text: Column, part: Column) -> Column:
    """Place of the first occurrence, from 0; -1 if there is none."""
    return F.call_function("instr", text, part) - 1


def first_placeholder(x: Column) -> Column:
    return F.regexp_extract(x, PLACEHOLDER, 1)


def placeholders(x: Column, pattern: str = PLACEHOLDER) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(1))


def normal_text(x: Column) -> Column:
    """Line ends as LF, three or more of them as two, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), "\n{3,}", "\n\n"))


def fold_alnum(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def token_estimate(x: Column) -> Column:
    """Words times 1.3, rounded down."""
    return F.floor(F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0))) * F.lit(1.3)).cast("int")


def has_extension(name: Column, allowed: tuple[str, ...] = ("docx", "pdf")) -> Column:
    return F.contains(name, F.lit(".")) & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*allowed)


def request_estimate(prompt: Column, most: int = 8192) -> Column:
    """What a request may cost: words times 1.3 and the reply's bound, rounded down."""
    return F.floor(F.size(F.regexp_extract_all(prompt, F.lit(r"\S+"), F.lit(0))) * F.lit(1.3) + F.lit(most)).cast("int")


def human_size(n: Column) -> Column:
    """Size in KB or MB with one decimal; nothing for nothing."""
    shown = lambda unit, name: F.concat(F.format_string("%.1f", F.floor(n * 10 / unit + 0.5) / 10), F.lit(name))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").when(n < 1048576, shown(1024, " KB")).otherwise(shown(1048576, " MB"))


def splice(text: Column, start: Column, end: Column, put: Column) -> Column:
    """``text`` with [start, end) replaced, both from 0."""
    return F.concat(F.substring(text, F.lit(1), start), put, F.substring(text, end + 1, F.length(text)))


def fill(text: Column, pairs: list[tuple[str, Column]]) -> Column:
    """Literal replacement of one name after the other; earlier content can bring in later names."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), new)
    return text


def is_heading(style: Column) -> Column:
    return F.coalesce(F.contains(style, F.lit("Heading")), F.lit(False))


def render(kind: Column, text: Column, style: Column, table: Column) -> Column:
    """An element's line in the full text of its document."""
    return (
        F.when((kind == "paragraph") & is_heading(style), F.concat(F.lit("\n["), style, F.lit("] "), text, F.lit("\n")))
        .when(kind == "table_cell", F.concat(F.lit("[Table"), (table + 1).cast("string"), F.lit("] "), text))
        .when(kind == "header", F.concat(F.lit("[Header] "), text))
        .when(kind == "footer", F.concat(F.lit("[Footer] "), text))
        .otherwise(text)
    )
