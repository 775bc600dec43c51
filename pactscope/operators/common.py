"""Shared steps: keys, last-wins indexes, set operations and ordered grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERVICE = ["service", "version"]
HANDLER = [*SERVICE, "fun"]


def present(keys: Sequence[str], *frames: DataFrame) -> list[str]:
    """The keys that all frames have; dimension tables need not carry service and version."""
    return [k for k in keys if all(k in f.columns for f in frames)]


def pick_first(df: DataFrame, keys: Sequence[str], order: Column, values: Sequence[str]) -> DataFrame:
    """One row per key with the least order. Partial aggregation keeps hot keys off a single task."""
    best = F.min_by(F.struct(*values), order).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def scattered(key: Column, *spread: str) -> Column:
    """A join key whose nulls are replaced by texts that match nothing, over many partitions.

    Null keys of an outer join would otherwise all meet in one task.
    """
    nowhere = F.concat(F.lit("~"), F.pmod(F.xxhash64(*spread), F.lit(4096)).cast("string"))
    return F.coalesce(key, nowhere)


def index_last(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """One row per key; the row with the greatest order wins."""
    order = F.col(order) if isinstance(order, str) else order
    values = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*values), order).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def merge_keep_existing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``target``, and the rows of ``source`` under keys that ``target`` lacks."""
    return target.unionByName(source.join(target, list(keys), "left_anti"))


def overlay(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``source``, and the rows of ``target`` under keys that ``source`` lacks."""
    return merge_keep_existing(source, target, keys)


def except_seen(frontier: DataFrame, visited: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct frontier keys that have not been visited."""
    return frontier.select(*keys).distinct().join(visited, list(keys), "left_anti")


def distinct_keys(*frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of the key sets of several tables."""
    merged = frames[0].select(*keys).distinct()
    for frame in frames[1:]:
        merged = merged.unionByName(frame.select(*keys).distinct())
    return merged.distinct()


def collect_ordered(df: DataFrame, keys: Sequence[str], element: Column, *aggregates: Column) -> DataFrame:
    """Sorted arrays of ``element`` per key, for outputs that hold a group as one value: ``keys, items``."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(element)).alias("items"), *aggregates)
