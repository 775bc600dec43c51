"""Struct tags of fields, and tags of endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.functions.paths import SHAPE_COLUMNS, with_path_shape
from pactscope.functions.text import blank_to_null, singularize

# The parts of a field's tag text.
JSON_NAME = r'json:"(.+?)(?:,(omitempty|omitzero))?"'
REQUIREMENT = r'doc:"(req|opt|)"'
NOT_IN_REQUEST = r'doc:"(!request)"'
NOT_IN_RESPONSE = r'doc:"(!response)"'
DEFAULT_VALUE = r'docdef:"(.*?)"'

# Tags added to operations.
UNTAGGED, UNIFIED, ALL = "untagged", "unified", "all"


def field_attr(tag: Column, name: Column) -> Column:
    """The attribute name a field has in JSON: ``-`` where it has none, the field's name if unstated."""
    return F.coalesce(blank_to_null(F.regexp_extract(tag, JSON_NAME, 1)), name)


def field_required(tag: Column) -> Column:
    """Whether a field is required; null where that is not stated."""
    stated = F.regexp_extract(tag, REQUIREMENT, 1)
    return F.when(stated == "req", F.lit(True)).when(stated == "opt", F.lit(False))


def with_inferred_tags(df: DataFrame, path: str = "path", name: str = "tags") -> DataFrame:
    """Add the tags told from a path: the feed of changes, the child collection, or the first segment."""
    rest, kind = F.regexp_replace("_rest", "^/", ""), F.col("_class")
    first = F.regexp_extract(rest, "^([^/]*)", 1)
    return (
        with_path_shape(df, path)
        .withColumn("_first", first)
        .withColumn(
            name,
            F.when(rest == "", F.array().cast("array<string>"))
            .when(kind == "changes", F.array(F.lit("changes"), F.col("_object_one")))
            .when(kind == "children", F.array(F.col("_child_one")))
            .otherwise(F.array(singularize(F.col("_first")))),
        )
        .drop("_first", *SHAPE_COLUMNS)
    )


def decorate_tags(tags: Column, path: Column) -> Column:
    """Tags with a mark for untagged and for account-spanning operations, and the tag of all."""
    across = path.startswith("/accounts/all/") | (path == "/accounts/all")
    none = F.array().cast("array<string>")
    return F.concat(
        F.when(F.size(tags) == 0, F.array(F.lit(UNTAGGED))).otherwise(tags),
        F.when(across, F.array(F.lit(UNIFIED))).otherwise(none),
        F.array(F.lit(ALL)),
    )
