"""Template functions: contracts written once and used for many object types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.functions.text import article, title_first
from pactscope.operators.accessors import NEEDED_ACCOUNT
from pactscope.operators.common import HANDLER, SERVICE, present

# The attributes of an object type.
OBJECT_ATTRIBUTES = {
    "name": "name",
    "plural": "plural",
    "responseType": "response_type",
    "uriParamName": "uri_param_name",
    "containerUriParamName": "container_uri_param_name",
    "failedToDeleteError": "failed_to_delete_error",
    "accountFunc": "account_type",
}
OBJECT_TYPES = ("foo", "change", "changes")

# The fields a template text may name, and where their values come from.
PLACEHOLDERS = {
    "Name": "name",
    "Names": "plural",
    "Verb": "verb",
    "Path": "path",
    "ObjType": "foo",
    "UriParamName": "uri_param_name",
    "AccountType": "account_type",
}
PARAM_REFERENCE = r"\.((?:Query|Path|Header)Param\.\w+\.(?:Name|Description|DefaultValue))"


def render_placeholders(template: Column, values: dict[str, Column], maps: Column | None = None) -> Column:
    """Put values into the ``{{.Name}}`` places of a text.

    ``maps`` is a map from dotted names, such as ``TypeParam.T``, to their values.
    """
    # pieces of text and placeholders in turn; a value that looks like a placeholder is not read again
    pieces = F.split(F.regexp_replace(template, r"\{\{\s*(\.[\w.]+)\s*\}\}", "\u0001{{$1}}\u0001"), "\u0001")
    known = F.coalesce(maps, F.create_map().cast("map<string,string>")) if maps is not None else None

    def rendered(piece: Column) -> Column:
        found = piece
        if known is not None:
            key = F.regexp_extract(piece, r"^\{\{\.(.*)\}\}$", 1)
            found = F.coalesce(F.when(piece.startswith("{{."), F.try_element_at(known, key)), piece)
        for name, value in values.items():
            found = F.when(piece == "{{." + name + "}}", F.coalesce(value, F.lit(""))).otherwise(found)
        return found

    return F.array_join(F.transform(pieces, rendered), "")


def assemble_object_types(type_arguments: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per object type variable: its three types and its attributes.

    ``type_arguments`` has ``var, pos, type_key``; ``attributes`` has ``var, attr, value, ord``.
    """
    keys = [*present(SERVICE, type_arguments, attributes), "var"]
    pos, attr = F.col("pos"), F.col("attr")
    types = type_arguments.groupBy(*keys).agg(
        *[F.max(F.when(pos == i, F.col("type_key"))).alias(name) for i, name in enumerate(OBJECT_TYPES)]
    )
    values = attributes.groupBy(*keys).agg(
        *[F.max_by("value", F.when(attr == a, F.col("ord"))).alias(name) for a, name in OBJECT_ATTRIBUTES.items()]
    )
    return (
        values.join(types, keys)
        .where(F.col("foo").isNotNull() & F.col("change").isNotNull() & F.col("changes").isNotNull())
        .withColumn("account_type", F.nullif(F.regexp_extract("account_type", NEEDED_ACCOUNT, 1), F.lit("")))
    )


def incomplete_object_types(type_arguments: DataFrame, attributes: DataFrame) -> DataFrame:
    """Variables with attributes but without one of the three types."""
    keys = [*present(SERVICE, type_arguments, attributes), "var"]
    complete = type_arguments.where(F.col("pos") < 3).groupBy(*keys).agg(F.count_distinct("pos").alias("_n"))
    return attributes.select(*keys).distinct().join(complete.where(F.col("_n") == 3), keys, "left_anti")


def _calls_with_values(
    calls: DataFrame,
    routes: DataFrame,
    object_types: DataFrame,
    type_arguments: DataFrame,
    texts: DataFrame,
    definitions: DataFrame,
) -> DataFrame:
    """Template calls with everything their texts may name."""
    objects = object_types.select(
        *present(SERVICE, object_types),
        F.col("var").alias("object_var"),
        *[c for c in PLACEHOLDERS.values() if c not in ("verb", "path")],
    )
    generic = (
        type_arguments.groupBy(*HANDLER, "template", "placeholder")
        .agg(F.max("type_key").alias("type_key"))
        .groupBy(*HANDLER, "template")
        .agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "type_key"))).alias("type_args"))
    )
    # only the parameter definitions that a template names, once per template
    named = texts.select("template", F.explode(F.regexp_extract_all("text", F.lit(PARAM_REFERENCE), 1)).alias("ref")).distinct()
    defined = definitions.select(
        *present(SERVICE, definitions),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.concat(F.initcap("location"), F.lit("Param."), F.col("const_name"), F.lit("." + field)).alias("ref"),
                        F.col(column).alias("value"),
                    )
                    for field, column in (("Name", "wire_name"), ("Description", "description"), ("DefaultValue", "default_value"))
                ]
            )
        ).alias("_d"),
    ).select(*present(SERVICE, definitions), "_d.*")
    per_template = [*present(SERVICE, definitions), "template"]
    known = (
        named.join(defined, "ref")
        .groupBy(*per_template, "ref")
        .agg(F.max("value").alias("value"))
        .groupBy(*per_template)
        .agg(F.map_from_entries(F.collect_list(F.struct("ref", "value"))).alias("param_values"))
    )
    return (
        calls.join(routes.select(*HANDLER, "verb", "path"), HANDLER)
        .join(objects, [*present(SERVICE, objects), "object_var"])
        .join(generic, [*HANDLER, "template"], "left")
        .join(known, [*present(SERVICE, definitions), "template"], "left")
    )


def _maps() -> Column:
    none = F.create_map().cast("map<string,string>")
    generic = F.transform_keys(F.coalesce("type_args", none), lambda k, _: F.concat(F.lit("TypeParam."), k))
    return F.map_concat(generic, F.coalesce("param_values", none))


def _actual_type(written: Column) -> Column:
    """The type meant by a template: a name in capitals is a generic parameter; ``[]`` is kept."""
    many = written.startswith("[]")
    name = F.regexp_replace(written, r"^\[\]", "")
    actual = F.when(F.upper(name) == name, F.try_element_at("type_args", name)).otherwise(name)
    return F.concat(F.when(many, "[]").otherwise(""), actual)


def expand_templates(
    calls: DataFrame,
    routes: DataFrame,
    templates: DataFrame,
    template_responses: DataFrame,
    object_types: DataFrame,
    type_arguments: DataFrame,
    definitions: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What template calls stand for: body parameters, responses and summaries of their handlers.

    A type that cannot be resolved is null, with a ``problem``.
    """
    texts = templates.select("template", F.col("comment_tpl").alias("text"))
    texts = texts.unionByName(templates.select("template", F.col("body_comment_tpl").alias("text")))
    texts = texts.unionByName(template_responses.select("template", F.col("summary_tpl").alias("text")))
    full = _calls_with_values(
        calls, routes, object_types, type_arguments, texts.where(F.col("text").isNotNull()), definitions
    )
    values = {name: F.col(column) for name, column in PLACEHOLDERS.items()}

    def rendered(template: str) -> Column:
        return render_placeholders(F.col(template), values, _maps())

    def problem() -> Column:
        return F.when(F.col("type_key").isNull() & F.col("_written").isNotNull(), "unresolved type")

    used = full.join(templates, "template")
    written = F.nullif(F.col("body_type"), F.lit(""))
    bodies = (
        used.where(written.isNotNull())
        .withColumn("_written", written)
        .withColumn("type_key", _actual_type(F.col("_written")))
        # a step of its own: beside ``type_key AS name``, ``name`` inside a lambda would mean that alias
        .withColumn("_text", F.coalesce(rendered("body_comment_tpl"), F.lit("")))
        .select(
            *HANDLER,
            "template",
            F.col("type_key").alias("name"),
            "type_key",
            F.col("_text").alias("description"),
            F.col("body_required").alias("required"),
            problem().alias("problem"),
        )
    )
    responses = (
        full.join(template_responses, "template")
        .withColumn("_written", F.nullif(F.col("response_type"), F.lit("")))
        .withColumn("type_key", _actual_type(F.col("_written")))
        .select(
            *HANDLER,
            "template",
            "code",
            "type_key",
            F.coalesce(rendered("summary_tpl"), F.lit("")).alias("summary"),
            problem().alias("problem"),
        )
    )
    fallback = F.concat_ws(" ", title_first(F.col("template")), article(F.col("name")), F.col("name"))
    summaries = used.select(
        *HANDLER, "template", F.coalesce(rendered("comment_tpl"), fallback).alias("default_summary")
    )
    return bodies, responses, summaries
