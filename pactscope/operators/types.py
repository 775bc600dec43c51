"""Types, their fields, and the JSON schemas made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.catalogue.defaults import REQUEST_SUFFIX, SCHEMA_REF
from pactscope.functions.jsontext import json_string
from pactscope.functions.tags import (
    DEFAULT_VALUE,
    NOT_IN_REQUEST,
    NOT_IN_RESPONSE,
    field_attr,
    field_required,
)
from pactscope.functions.text import blank_to_null
from pactscope.functions.typekeys import BASIC_TYPES, leaf_key, split_type_key, wrappers
from pactscope.operators.common import SERVICE, collect_ordered, present, scattered

# Basic types without a schema, and the JSON type of the others.
NO_SCHEMA = ("io.Closer", "error")
JSON_TYPES = {
    "string": '"type":"string"',
    "int": '"type":"integer"',
    "uint": '"type":"integer","minimum":0',
    "bool": '"type":"boolean"',
    "any": '"type":"object"',
    "time.Time": '"type":"string","format":"date-time"',
}
# Name of the patch type, and the prefix of types left out of documents.
PATCH_TYPE, HIDDEN_TYPE_PREFIX = "PatchObject", "Swagger"


def parse_field_tags(fields: DataFrame) -> DataFrame:
    """Fields with what their tag text says; fields whose attribute is ``-`` are left out."""
    tag = F.col("tag")
    return (
        fields.withColumn("attr", field_attr(tag, F.col("name")))
        .where(F.col("attr") != "-")
        .withColumn("required", field_required(tag))
        .withColumn("default_value", F.regexp_extract(tag, DEFAULT_VALUE, 1))
        .withColumn("in_request", ~tag.rlike(NOT_IN_REQUEST))
        .withColumn("in_response", ~tag.rlike(NOT_IN_RESPONSE))
    )


def visible_fields(fields: DataFrame, scope: str) -> DataFrame:
    """The fields that requests or responses show."""
    return fields.where(F.col("in_request" if scope == "request" else "in_response"))


def types_of_interest(types: DataFrame, packages: Sequence[str]) -> DataFrame:
    """Types of the listed packages that documents may show."""
    return types.where(F.col("pkg").isin(*packages) & ~F.col("name").startswith(HIDDEN_TYPE_PREFIX))


def enum_values(enums: DataFrame) -> DataFrame:
    """The values of each enumerated type, by constant name."""
    keys = [*present(SERVICE, enums), "type_key"]
    unique = enums.groupBy(*keys, "name").agg(F.max("value").alias("value"))
    grouped = collect_ordered(unique, keys, F.struct("name", "value"))
    return grouped.select(*keys, F.transform("items", lambda e: e.value).alias("enum_values"))


def attach_enums(types: DataFrame, enums: DataFrame) -> DataFrame:
    """Types, marked as enumerated if any constant has their key, with the number of values."""
    keys = [*present(SERVICE, types, enums), "type_key"]
    counted = enums.groupBy(*keys).agg(F.count_distinct("name").alias("n_values"))
    return (
        types.join(counted, keys, "left")
        .withColumn("is_enum", F.col("n_values").isNotNull())
        .withColumn("n_values", F.coalesce("n_values", F.lit(0)))
    )


def scope_variants(fields: DataFrame) -> DataFrame:
    """The schemas each type needs: its own, and one for requests if a scope hides any field."""
    keys = [*present(SERVICE, fields), "type_key"]
    hidden = F.bool_or(~F.col("in_request") | ~F.col("in_response"))
    plain = F.struct(F.col("type_key").alias("schema_key"), F.lit("response").alias("scope"))
    special = F.struct(
        F.concat("type_key", F.lit(REQUEST_SUFFIX)).alias("schema_key"), F.lit("request").alias("scope")
    )
    return (
        fields.groupBy(*keys)
        .agg(hidden.alias("_hidden"))
        .select(*keys, F.inline(F.when(F.col("_hidden"), F.array(plain, special)).otherwise(F.array(plain))))
    )


def documented_types(types: DataFrame) -> DataFrame:
    """The types that documents have a schema of: structs that are not hidden by their name."""
    return types.where((F.col("kind") == "struct") & ~_hidden())


def _hidden() -> Column:
    """Whether the name of a type keeps it out of documents."""
    return F.regexp_extract("type_key", r"([^.]*)$", 1).startswith(HIDDEN_TYPE_PREFIX)


def shown_types(rows: DataFrame, column: str, types: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` with the types of ``column`` as documents write them, and ``unknown``, the type that they cannot show.

    Aliases stand for their targets. A type that the row's service doesn't have is shown as anything (``any``), below its
    arrays and maps, so that nothing refers to a schema that isn't there.
    """
    keys = present(SERVICE, rows, types)
    given = F.col(column)
    leaf = leaf_key(given)
    targets = aliases.where("resolved").select(*keys, F.col("type_key").alias("_leaf"), F.col("target_key").alias("_target"))
    known = documented_types(types).select(*keys, F.col("type_key").alias("_final"), F.lit(True).alias("_known")).distinct()
    spread = [c for c in ("fun", column) if c in rows.columns]
    written = (
        rows.withColumn("_leaf", scattered(F.when(~leaf.isin(*JSON_TYPES), leaf), *spread))
        .join(targets, [*keys, "_leaf"], "left")
        .withColumn("_key", F.when(F.col("_target").isNotNull(), F.concat(wrappers(given), "_target")).otherwise(given))
        .withColumn("_own", leaf_key(F.col("_key")))
        .withColumn("_final", scattered(F.when(~F.col("_own").isin(*JSON_TYPES), F.col("_own")), *spread))
        .join(known, [*keys, "_final"], "left")
    )
    plain = F.col("_own").isin(*JSON_TYPES) | F.col("_known").isNotNull()
    others = [F.col(c) for c in rows.columns if c != column]
    return written.select(
        *others,
        F.when(given.isNull() | plain, F.col("_key")).otherwise(F.concat(wrappers(F.col("_key")), F.lit("any"))).alias(column),
        F.when(given.isNotNull() & ~plain, leaf).alias("unknown"),
    )


def visible_anywhere(fields: DataFrame) -> DataFrame:
    """The fields that requests or responses, or both, show."""
    return fields.where(F.col("in_request") | F.col("in_response"))


def type_edges(types: DataFrame, fields: DataFrame) -> DataFrame:
    """References between types: of fields, elements and aliases, below arrays and maps."""
    keys = present(SERVICE, types)
    pairs = fields.select(*keys, F.col("type_key").alias("from_key"), F.col("field_type_key").alias("to_key"))
    for target in [c for c in ("element_key", "target_key") if c in types.columns]:
        pairs = pairs.unionByName(
            types.where(F.col(target).isNotNull()).select(
                *keys, F.col("type_key").alias("from_key"), F.col(target).alias("to_key")
            )
        )
    leaf = leaf_key(F.col("to_key"))
    return pairs.withColumn("to_key", leaf).where(~F.col("to_key").isin(*BASIC_TYPES)).distinct()


def split_type_keys(types: DataFrame) -> DataFrame:
    """Type keys with their kind, map key and element, and the type below all containers."""
    parts = split_type_key(F.col("type_key"))
    return types.withColumn("_parts", parts).select("*", "_parts.*", leaf_key(F.col("type_key")).alias("leaf")).drop("_parts")


def _text_member(name: str, value: Column) -> Column:
    stated = blank_to_null(value)
    return F.when(stated.isNotNull(), F.concat(F.lit(f',"{name}":'), json_string(value))).otherwise(F.lit(""))


def _plain_member(name: str, value: Column) -> Column:
    return F.when(blank_to_null(value).isNotNull(), F.concat(F.lit(f',"{name}":'), value)).otherwise(F.lit(""))


def basic_schema(key: Column, description: Column, default: Column) -> Column:
    """JSON schema of a basic type; null for others."""
    members = F.create_map(*[F.lit(v) for pair in JSON_TYPES.items() for v in pair])
    value = (
        F.when(key == "string", _text_member("default", default))
        .when(key.isin("int", "uint", "bool"), _plain_member("default", default))
        .otherwise("")
    )
    return F.concat(
        F.lit("{"), F.try_element_at(members, key), _text_member("description", description), value, F.lit("}")
    )


def wrap_schema(inner: Column, wraps: Column, description: Column) -> Column:
    """Put a schema into the arrays and maps of ``wraps``, from the outside in."""
    text = _text_member("description", description)
    # one character per level: a for an array, m for a map
    levels = F.regexp_replace(F.regexp_replace(wraps, r"\[\]", "a"), r"map\[[^\]]*\]", "m")
    opened = F.transform(
        F.filter(F.split(levels, ""), lambda c: c != ""),
        lambda c: F.when(c == "a", F.concat(F.lit('{"type":"array"'), text, F.lit(',"items":'))).otherwise(
            F.concat(F.lit('{"type":"object"'), text, F.lit(',"additionalProperties":'))
        ),
    )
    return F.concat(F.array_join(opened, ""), inner, F.repeat(F.lit("}"), F.length(levels)))


def schema_properties(
    fields: DataFrame,
    types: DataFrame,
    enums: DataFrame,
    aliases: DataFrame,
    scope: str = "response",
    known_fields: DataFrame | None = None,
) -> DataFrame:
    """One row per visible field with its JSON schema, or the problem that it has none.

    ``aliases`` is the result of :func:`~pactscope.operators.graph.resolve_aliases`. Basic types, by
    far the most common, are rendered in place: their join keys are made to match nothing and are
    spread, so they do not meet in one task. ``known_fields`` are those of all types, where ``fields`` are only some: they
    tell which types have a schema of their own in requests.
    """
    keys = present(SERVICE, fields, types)
    shown = visible_fields(fields, scope)
    leaf = leaf_key(F.col("field_type_key"))
    basic = leaf.isin(*BASIC_TYPES)

    enum_text = F.concat(
        F.lit("["), F.array_join(F.transform("enum_values", json_string), ","), F.lit("]")
    )
    enum_keys = present(SERVICE, enums)
    enum_side = enum_values(enums).select(*enum_keys, F.col("type_key").alias("_leaf"), enum_text.alias("_enum"))
    all_fields = fields if known_fields is None else known_fields
    hidden = scope_variants(all_fields).where(F.col("scope") == "request").select(
        *keys, F.col("type_key").alias("_final"), F.lit(True).alias("_variant")
    )
    known = types.where((F.col("kind") != "alias") & ~_hidden()).select(
        *keys, F.col("type_key").alias("_final"), F.lit(True).alias("_known")
    ).distinct()
    targets = aliases.select(*keys, F.col("type_key").alias("_leaf"), F.col("target_key").alias("_target"))

    named = (
        shown.withColumn("_basic", basic)
        .withColumn("_wraps", wrappers(F.col("field_type_key")))
        .withColumn("_leaf", scattered(F.when(~basic, leaf), "type_key", "name"))
        .join(enum_side, [*enum_keys, "_leaf"], "left")
        .join(targets, [*keys, "_leaf"], "left")
        .withColumn("_reached", F.when(F.col("_basic"), leaf).otherwise(F.coalesce("_target", "_leaf")))
        .withColumn("_wraps", F.concat("_wraps", F.when(F.col("_enum").isNull(), wrappers(F.col("_reached"))).otherwise("")))
        .withColumn("_reached", leaf_key(F.col("_reached")))
        .withColumn("_final", scattered(F.when(~F.col("_reached").isin(*BASIC_TYPES), F.col("_reached")), "type_key", "name"))
        .join(known, [*keys, "_final"], "left")
        .join(hidden, [*keys, "_final"], "left")
    )
    description, default = F.col("summary"), F.col("default_value")
    enum = F.when(
        F.col("_enum").isNotNull(),
        F.concat(
            F.lit('{"type":"string","enum":'),
            F.col("_enum"),
            _text_member("description", description),
            _text_member("default", default),
            F.lit("}"),
        ),
    )
    suffix = F.when(F.col("_variant").isNotNull() & F.lit(scope == "request"), F.lit(REQUEST_SUFFIX)).otherwise("")
    patch = F.when(
        F.regexp_extract("_reached", r"([^.]+)$", 1) == PATCH_TYPE,
        F.lit('{"type":"array","items":{"type":"object"}}'),
    )
    reference = F.when(
        F.col("_known").isNotNull(),
        F.concat(F.lit('{"$ref":'), json_string(F.concat(F.lit(SCHEMA_REF), "_reached", suffix)), F.lit("}")),
    )
    inner = F.coalesce(enum, patch, basic_schema(F.col("_reached"), description, default), reference)
    absent = F.col("_reached").isin(*NO_SCHEMA)
    return named.select(
        *keys,
        "type_key",
        "pos",
        "attr",
        "required",
        F.when(~absent, wrap_schema(inner, F.col("_wraps"), description)).alias("schema"),
        F.when(inner.isNull() & ~absent, "unsupported type").alias("problem"),
    ).where(~F.coalesce(absent, F.lit(False)))


def type_schemas(types: DataFrame, properties: DataFrame) -> DataFrame:
    """JSON schema of each struct: its properties in field order, and the required ones.

    ``properties`` is the result of :func:`schema_properties`.
    """
    keys = [*present(SERVICE, types, properties), "type_key"]
    # lists drop nulls; a filter would have every schema made twice
    member = F.when(F.col("schema").isNotNull(), F.struct("pos", "attr", "schema", "required"))
    grouped = collect_ordered(properties, keys, member)
    described = types.where(F.col("kind") == "struct").join(grouped, keys, "left")
    items = F.coalesce("items", F.array().cast("array<struct<pos:int,attr:string,schema:string,required:boolean>>"))
    members = F.array_join(
        F.transform(items, lambda p: F.concat(json_string(p.attr), F.lit(":"), p.schema)), ","
    )
    required = F.array_join(
        F.transform(F.filter(items, lambda p: F.coalesce(p.required, F.lit(False))), lambda p: json_string(p.attr)), ","
    )
    text = F.concat_ws("\n", blank_to_null(F.col("summary")), blank_to_null(F.col("description")))
    return described.select(
        *keys,
        F.concat(
            F.lit('{"type":"object"'),
            _text_member("description", text),
            F.lit(',"properties":{'),
            members,
            F.lit("}"),
            F.when(required != "", F.concat(F.lit(',"required":['), required, F.lit("]"))).otherwise(F.lit("")),
            F.lit("}"),
        ).alias("schema"),
    )


def request_schemas(types: DataFrame, fields: DataFrame, properties: DataFrame) -> DataFrame:
    """Schemas for requests of the types that need one; ``properties`` are those of the request scope."""
    special = scope_variants(fields).where(F.col("scope") == "request")
    keys = [*present(SERVICE, types, fields), "type_key"]
    needed = types.join(special.select(*keys), keys, "left_semi")
    return type_schemas(needed, properties).withColumn(
        "schema_key", F.concat("type_key", F.lit(REQUEST_SUFFIX))
    )
