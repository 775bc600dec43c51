"""Examples: their sets per type, their use in responses and bodies, and their payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.functions.jsontext import is_json
from pactscope.functions.text import blank_to_null
from pactscope.functions.typekeys import split_type_key
from pactscope.operators.common import SERVICE, present, scattered

# Where an example may be used.
ANY, REQUEST = "any", "request"


def partition_examples(examples: DataFrame) -> DataFrame:
    """Per type: the number of general and request examples, and what is wrong with the set.

    The examples stay rows of their own; :func:`examples_for` selects those of a scope.
    """
    scope = F.col("scope")
    counted = examples.groupBy(*present(SERVICE, examples), "type_key").agg(
        F.count_if(scope == ANY).alias("n_any"),
        F.count_if(scope == REQUEST).alias("n_request"),
        F.count_if(~scope.isin(ANY, REQUEST)).alias("n_other"),
    )
    problem = F.when(F.col("n_any") == 0, "no default example").when(
        F.col("n_other") > 0, "unsupported scope"
    )
    return counted.withColumn("problem", problem)


def examples_for(examples: DataFrame, scope: str) -> DataFrame:
    """The examples that responses or requests of a type show.

    Responses show the general ones. Requests show the request examples of a type that has any, and
    else the general ones.
    """
    general = examples.where(F.col("scope") == ANY)
    if scope != REQUEST:
        return general
    special = examples.where(F.col("scope") == REQUEST)
    keys = [*present(SERVICE, examples), "type_key"]
    return special.unionByName(general.join(special.select(*keys).distinct(), keys, "left_anti"))


def _example_sets(examples: DataFrame) -> tuple[DataFrame, list[str]]:
    keys = [*present(SERVICE, examples), "type_key"]
    return examples.where(F.col("scope") == ANY).select(*keys).distinct(), keys


def match_examples(responses: DataFrame, examples: DataFrame) -> DataFrame:
    """Each response and the set of examples that its body shows, if it has one.

    The set is that of the explicit key, else of the type; failing that, of the element of an array
    or map, whose examples are wrapped (``ref_prefix``). A response refers to its set by name, so that
    a common type costs one row per response and not one per response and example.
    """
    sets, keys = _example_sets(examples)
    service = keys[:-1]
    element = split_type_key(F.col("type_key"))
    wanted = F.coalesce(blank_to_null(F.col("example_key")), F.col("type_key"))
    direct = sets.select(*service, F.col("type_key").alias("_wanted"), F.lit(True).alias("_direct"))
    inner = sets.select(*service, F.col("type_key").alias("_element"), F.lit(True).alias("_inner"))
    has_body = F.col("type_key").isNotNull()
    found = (
        responses.withColumn("_wanted", scattered(F.when(has_body, wanted), *responses.columns))
        .withColumn("_kind", element.kind)
        .withColumn("_element", scattered(element.element_key, *responses.columns))
        .join(direct, [*service, "_wanted"], "left")
        .join(inner, [*service, "_element"], "left")
    )
    is_direct, is_inner = F.col("_direct").isNotNull(), F.col("_inner").isNotNull()
    return found.select(
        *responses.columns,
        F.when(is_direct, F.col("_wanted")).when(is_inner, F.col("_element")).alias("example_set"),
        F.when(is_direct, F.lit(""))
        .when(is_inner & (F.col("_kind") == "array"), F.lit("[]"))
        .when(is_inner & (F.col("_kind") == "map"), F.lit("map[string]"))
        .alias("ref_prefix"),
        F.when(
            has_body & ~is_direct & ~is_inner,
            F.when(blank_to_null(F.col("example_key")).isNotNull(), "unknown example key").otherwise("no example"),
        ).alias("problem"),
    )


def match_body_examples(bodies: DataFrame, examples: DataFrame) -> DataFrame:
    """Each body parameter with the set of examples it shows and the scope they come from."""
    service = present(SERVICE, examples)
    sets = examples.groupBy(*service, F.col("type_key").alias("_wanted")).agg(
        F.bool_or(F.col("scope") == REQUEST).alias("_special")
    )
    wanted = F.coalesce(blank_to_null(F.col("example_key")), F.col("name"))
    return (
        bodies.withColumn("_wanted", wanted)
        .join(sets, [*service, "_wanted"], "left")
        .select(
            *bodies.columns,
            F.when(F.col("_special").isNotNull(), F.col("_wanted")).alias("example_set"),
            F.when(F.col("_special"), REQUEST).when(~F.col("_special"), ANY).alias("example_scope"),
        )
    )


def wrap_examples(examples: DataFrame, matched: DataFrame, prefix: str) -> DataFrame:
    """The examples of element types that array or map responses show, wrapped in an array or map.

    ``matched`` is the result of :func:`match_examples`; only the sets it needs are wrapped.
    """
    keys = [*present(SERVICE, examples), "type_key"]
    needed = matched.where(F.col("ref_prefix") == prefix).select(
        *keys[:-1], F.col("example_set").alias("type_key")
    ).distinct()
    opening, closing = ("[", "]") if prefix == "[]" else ('{"key":', "}")
    return (
        examples.where(F.col("scope") == ANY)
        .join(needed, keys, "left_semi")
        .withColumn("key", F.concat(F.lit(prefix), "key"))
        .withColumn("payload", F.concat(F.lit(opening), "payload", F.lit(closing)))
    )


def wrap_examples_as_array(examples: DataFrame, matched: DataFrame) -> DataFrame:
    return wrap_examples(examples, matched, "[]")


def wrap_examples_as_map(examples: DataFrame, matched: DataFrame) -> DataFrame:
    return wrap_examples(examples, matched, "map[string]")


def request_example_overrides(examples: DataFrame) -> DataFrame:
    """Per example key: the general payload, and the one for requests, which falls back to it."""

    def last(scope: str) -> Column:
        return F.max_by("payload", F.when(F.col("scope") == scope, F.col("ord")))

    return (
        examples.where(F.col("scope").isin(ANY, REQUEST))
        .groupBy(*present(SERVICE, examples), "key")
        .agg(last(ANY).alias("response_payload"), last(REQUEST).alias("_request"))
        .withColumn("request_payload", F.coalesce("_request", "response_payload"))
        .withColumn("problem", F.when(F.col("response_payload").isNull(), "no default example"))
        .drop("_request")
    )


def valid_examples(examples: DataFrame) -> DataFrame:
    """Examples whose payload is JSON, so that what is put together of them is JSON as well."""
    return examples.where(is_json(F.col("payload")))


def invalid_examples(examples: DataFrame) -> DataFrame:
    """Examples whose payload is not JSON."""
    return examples.where(~is_json(F.col("payload")))


def property_examples(examples: DataFrame, fields: DataFrame) -> DataFrame:
    """The values that example payloads give to the fields of their type."""
    keys = [*present(SERVICE, examples, fields), "type_key", "attr"]
    values = (
        examples.where(F.col("scope") == ANY)
        .withColumn("_values", F.from_json("payload", "map<string,string>"))
        .select(*[c for c in examples.columns if c not in ("payload", "scope")], F.explode("_values").alias("attr", "value"))
    )
    return values.join(fields.select(*keys).distinct(), keys, "left_semi")
