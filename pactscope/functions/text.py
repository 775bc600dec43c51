"""Text steps on comment lines and names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_comment_marker(line: Column) -> Column:
    """Remove a leading ``//`` and at most one blank after it."""
    return F.regexp_replace(line, r"^// ?", "")


def comment_body(line: Column) -> Column:
    """Text after a possibly indented ``//``; other text is kept as it is."""
    pattern = r"^\s*//+\s?(.*)\s*$"
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1)).otherwise(line)


def linkify_refs(line: Column) -> Column:
    """Turn ``[RFC123]`` into a link unless one follows, and curly quotes into straight ones.

    The character after a reference is consumed, so of two adjacent references the first is linked.
    """
    linked = F.regexp_replace(
        line, r"\[RFC(\d+)\](?!\()(.?)", r"[RFC$1](https://www.rfc-editor.org/rfc/rfc$1.html)$2"
    )
    return F.translate(linked, "“”", '""')


def title_first(text: Column) -> Column:
    """Upper-case the first character only; one whose capital form is longer stays as it is."""
    first = F.substring(text, 1, 1)
    capital = F.when(F.length(F.upper(first)) > 1, first).otherwise(F.upper(first))
    return F.concat(capital, F.substring(text, 2, 2147483647))


def singularize(word: Column) -> Column:
    """English singular by ordered suffix rules."""
    return (
        F.when(word.endswith("ses"), F.regexp_replace(word, "ses$", "se"))
        .when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y"))
        .when(word.endswith("ges"), F.regexp_replace(word, "ges$", "ge"))
        .when(word.endswith("es"), F.regexp_replace(word, "es$", ""))
        .when(word.endswith("s"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def article(word: Column) -> Column:
    """``an`` before a, e, i, o, u and y, else ``a``."""
    return F.when(word.rlike("^[aeiouyAEIOUY]"), F.lit("an")).otherwise(F.lit("a"))


def split_first(text: Column, separator: str) -> Column:
    """Struct of the text before and after the first separator; without one, the text and ''."""
    at = F.instr(text, separator)
    before = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    after = F.when(at > 0, F.substr(text, at + len(separator))).otherwise(F.lit(""))
    return F.struct(before.alias("before"), after.alias("after"))


def is_blank(line: Column) -> Column:
    return squeeze_trim(line) == ""


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def squeeze_trim(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))
