"""Type keys such as ``pkg.Name``, ``[]T`` and ``map[K]V``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The basic types of a contract.
BASIC_TYPES = ("int", "uint", "string", "bool", "any", "time.Time", "io.Closer", "error")

MAP_KEY = r"^map\[(.+?)\](.+)$"
WRAPPERS = r"^((?:\[\]|map\[[^\]]*+\])*+)"


def split_type_key(key: Column) -> Column:
    """Struct of kind, map key type and element type of one level of a type key."""
    return F.struct(
        F.when(key.rlike(r"^\[\].+"), F.lit("array"))
        .when(key.rlike(MAP_KEY), F.lit("map"))
        .when(key.isin(*BASIC_TYPES), F.lit("basic"))
        .when(key.rlike(r"^[A-Za-z_][\w]*(\.[A-Za-z_][\w]*)?$"), F.lit("named"))
        .otherwise(F.lit("unknown"))
        .alias("kind"),
        F.when(~key.startswith("[]") & key.rlike(MAP_KEY), F.regexp_extract(key, MAP_KEY, 1)).alias("key_key"),
        F.when(key.rlike(r"^\[\].+"), F.substring(key, 3, 2147483647))
        .when(key.rlike(MAP_KEY), F.regexp_extract(key, MAP_KEY, 2))
        .alias("element_key"),
    )


def wrappers(key: Column) -> Column:
    """All array and map prefixes of a type key."""
    return F.regexp_extract(key, WRAPPERS, 1)


def leaf_key(key: Column) -> Column:
    """The type key below all arrays and maps."""
    return F.regexp_replace(key, WRAPPERS, "")
