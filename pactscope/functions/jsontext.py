"""Building JSON text from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(text: Column) -> Column:
    """A quoted and escaped JSON string; null stays null."""
    quoted = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def with_member(json: Column, name: str, value: Column) -> Column:
    """A non-empty JSON object with one more member, unless its value is null."""
    member = F.concat(F.lit(f',"{name}":'), value, F.lit("}"))
    return F.concat(F.substr(json, F.lit(1), F.length(json) - 1), F.coalesce(member, F.lit("}")))


def pointer_token(text: Column) -> Column:
    """One step of a JSON pointer."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    Parsing stops behind the first value, so the text is read as the element of an array and as a member of an object: what
    would close one of them early breaks the other.
    """
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return element.isNotNull() & member.isNotNull()
