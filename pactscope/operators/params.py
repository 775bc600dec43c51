"""Parameters and request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.catalogue.defaults import ACCOUNT_PARAM, REQUEST_SUFFIX
from pactscope.functions.jsontext import json_string
from pactscope.functions.text import blank_to_null, is_blank, title_first
from pactscope.functions.typekeys import leaf_key
from pactscope.operators.common import HANDLER, SERVICE, collect_ordered, index_last, pick_first, present
from pactscope.session import materialise


def resolve_params(params: DataFrame, definitions: DataFrame) -> DataFrame:
    """Parameters outside the body with the wire name and texts of their definition."""
    outside = params.where(F.col("location") != "body")
    defs = _definitions(definitions)
    keys = [*present(SERVICE, params, defs), "location", "name"]
    return (
        outside.join(defs, keys)
        .withColumn("description", _stated("description"))
        .withColumn("default_value", _stated("default_value"))
        .drop("_description", "_default_value")
    )


def unresolved_params(params: DataFrame, definitions: DataFrame) -> DataFrame:
    """Parameters outside the body that no constant defines."""
    defs = _definitions(definitions)
    keys = [*present(SERVICE, params, defs), "location", "name"]
    return params.where(F.col("location") != "body").join(defs, keys, "left_anti")


def _definitions(definitions: DataFrame) -> DataFrame:
    return definitions.withColumnsRenamed(
        {"const_name": "name", "description": "_description", "default_value": "_default_value"}
    )


def _stated(column: str) -> Column:
    return F.coalesce(blank_to_null(F.col(column)), F.col(f"_{column}"), F.lit(""))


def merge_params(*sources: DataFrame) -> DataFrame:
    """Parameters of several sources, one per handler, location and name; later sources win."""
    merged = None
    for place, source in enumerate(sources):
        tagged = source.withColumn("_source", F.lit(place))
        merged = tagged if merged is None else merged.unionByName(tagged)
    return index_last(merged, [*HANDLER, "location", "name"], F.struct("_source", "ord")).drop("_source")


def inherited_params(params: DataFrame, calls: DataFrame) -> DataFrame:
    """The parameters of each function and of the functions it calls, directly or over others.

    ``calls`` has ``fun, callee``. A parameter of one location and name comes from the nearest function that reads it, of
    several from the first by name: ``declared_in``, ``distance``. Each round hands what was newly found to the callers,
    so functions that call each other end the search.
    """
    keys = [*HANDLER, "location", "name"]
    own = index_last(params, keys, "ord")
    known = materialise(own.withColumn("declared_in", F.col("fun")).withColumn("distance", F.lit(0)))
    callers = materialise(calls.select(*SERVICE, F.col("fun").alias("_caller"), F.col("callee").alias("fun")).distinct())
    frontier, columns, distance = known, known.columns, 0
    while not frontier.isEmpty():
        distance += 1
        offered = frontier.join(callers, [*SERVICE, "fun"]).withColumn("fun", F.col("_caller")).drop("_caller", "distance")
        rest = [c for c in columns if c not in (*keys, "distance")]
        nearest = pick_first(offered, keys, F.col("declared_in"), rest)
        fresh = nearest.join(known.select(*keys), keys, "left_anti").withColumn("distance", F.lit(distance))
        frontier = materialise(fresh.select(*columns))
        known = known.unionByName(frontier)
    return known


def endpoint_flags(params: DataFrame) -> DataFrame:
    """Per handler: which conditions of the error rules hold, and the number of parameters."""
    location, required = F.col("location"), F.col("required")

    def any_of(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    return params.groupBy(*HANDLER).agg(
        any_of((location == "path") & (F.col("name") == ACCOUNT_PARAM)).alias("has_account"),
        any_of(location == "query").alias("has_query"),
        any_of((location == "query") & required).alias("has_query_required"),
        any_of(location == "path").alias("has_path"),
        any_of((location == "path") & required).alias("has_path_required"),
        any_of(location == "body").alias("has_body"),
        any_of((location == "body") & required).alias("has_body_required"),
        F.count_if(location != "path").alias("n_visible"),
    )


def body_schema(name: Column, description: Column, default_value: Column) -> Column:
    """JSON schema of a body that names a plain type instead of a known one; null for others."""
    text = F.when(
        blank_to_null(description).isNotNull(), F.concat(F.lit(',"description":'), json_string(description))
    ).otherwise(F.lit(""))
    given = blank_to_null(default_value).isNotNull()
    default = F.when(given, F.concat(F.lit(',"default":'), json_string(default_value))).otherwise(F.lit(""))
    plain_default = F.when(given, F.concat(F.lit(',"default":'), default_value)).otherwise(F.lit(""))
    string = F.concat(F.lit('{"type":"string"'), text, default, F.lit("}"))
    return (
        F.when(name.isin("map[string]any", "any"), F.concat(F.lit('{"type":"object"'), text, F.lit("}")))
        .when(name == "string", string)
        .when(name == "[]string", F.concat(F.lit('{"type":"array","items":'), string, F.lit("}")))
        .when(name == "bool", F.concat(F.lit('{"type":"boolean"'), text, plain_default, F.lit("}")))
    )


def body_schema_fallbacks(bodies: DataFrame) -> DataFrame:
    """Bodies of untyped parameters with their schema, and whether there is one."""
    schema = body_schema(F.col("name"), title_first(F.col("description")), F.col("default_value"))
    return bodies.withColumn("schema", schema).withColumn("supported", F.col("schema").isNotNull())


def collapse_bodies(params: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """The request body of each handler that has one.

    One body keeps its own description and requirement. Several become alternatives: required, and
    without a description. ``bodies`` lists their types in order; types that have a schema of their own in requests (``variants``) are named by that.
    """
    bodies = params.where(F.col("location") == "body")
    if variants is not None:
        special = variants.where(F.col("scope") == "request")
        keys = present(SERVICE, special)
        special = special.select(*keys, F.col("type_key").alias("_leaf"), F.lit(REQUEST_SUFFIX).alias("_suffix"))
        bodies = (
            bodies.withColumn("_leaf", leaf_key(F.col("name")))
            .join(special.distinct(), [*keys, "_leaf"], "left")
            .withColumn("name", F.concat("name", F.coalesce("_suffix", F.lit(""))))
            .drop("_leaf", "_suffix")
        )
    totals = (
        F.max("description").alias("_description"),
        F.bool_and("required").alias("_required"),
    )
    grouped = collect_ordered(index_last(bodies, [*HANDLER, "name"], "ord"), HANDLER, F.col("name"), *totals)
    single = F.size("items") == 1
    return grouped.select(
        *HANDLER,
        F.col("items").alias("bodies"),
        F.when(single, "single").otherwise("one_of").alias("form"),
        F.when(single, F.col("_required")).otherwise(F.lit(True)).alias("required"),
        F.when(single, title_first(F.col("_description"))).otherwise(F.lit("")).alias("description"),
    )


POSITION = ("file", "line", "col")


def undocumented_bodies(params: DataFrame, first_routes: DataFrame) -> DataFrame:
    """Request bodies without a description, with their position and the first route that takes them."""
    position = [c for c in POSITION if c in params.columns]
    bare = params.where((F.col("location") == "body") & is_blank(F.coalesce("description", F.lit(""))))
    found = bare.withColumn("type_key", F.col("name")).join(first_routes.select(*HANDLER, "verb", "path"), HANDLER)
    return pick_first(found, [*SERVICE, "type_key"], F.col("ord"), ["fun", *position, "verb", "path"])


def undocumented_results(responses: DataFrame, types: DataFrame, first_routes: DataFrame) -> DataFrame:
    """Named response types without a summary, with their position and the first route that answers so."""
    keys = [*present(SERVICE, types), "type_key"]
    used = responses.where(F.col("type_key").isNotNull()).join(first_routes.select(*HANDLER, "verb", "path"), HANDLER)
    used = pick_first(used, [*SERVICE, "type_key"], F.col("ord"), ["fun", "verb", "path"])
    bare = types.where(is_blank(F.coalesce("summary", F.lit("")))).select(
        *keys, *[c for c in POSITION if c in types.columns]
    )
    return used.join(bare, keys)
