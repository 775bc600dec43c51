"""Audits of documentation coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactscope.functions.text import blank_to_null
from pactscope.operators.common import HANDLER, SERVICE, present

# The kinds of findings, and the column of the report that counts each.
KINDS = {
    "untagged": "n_untagged",
    "unified": "n_unified",
    "undocumented_result": "n_undocumented_results",
    "undocumented_body": "n_undocumented_bodies",
    "response_without_example": "n_responses_without_examples",
    "unmounted_handler": "n_unmounted_handlers",
}


def unknown_tags(endpoint_tags: DataFrame, definitions: DataFrame) -> DataFrame:
    """Tags of endpoints that the dictionary does not define."""
    named = definitions.select(*present(SERVICE, definitions), F.col("name").alias("tag"))
    return endpoint_tags.join(named, [*present(SERVICE, definitions), "tag"], "left_anti")


def merge_tag_metadata(own: DataFrame, template: DataFrame) -> DataFrame:
    """The tags of both dictionaries; texts that the first leaves empty come from the second."""
    keys = [*present(SERVICE, own, template), "name"]
    other = template.withColumnsRenamed({"summary": "_summary", "description": "_description"})
    return own.join(other, keys, "full").select(
        *keys,
        *[
            F.coalesce(blank_to_null(F.col(c)), F.col(f"_{c}"), F.lit("")).alias(c)
            for c in ("summary", "description")
        ],
    )


def coverage_items(
    endpoints: DataFrame,
    tags: DataFrame,
    undocumented_results: DataFrame,
    undocumented_bodies: DataFrame,
    matched_responses: DataFrame,
    unmounted: DataFrame,
) -> DataFrame:
    """Every finding as a row: ``service, version, kind, item``.

    Untagged endpoints are those without tags of their own, before any default tag is added.
    """

    def rows(df: DataFrame, kind: str, item) -> DataFrame:
        return df.select(*SERVICE, F.lit(kind).alias("kind"), item.alias("item"))

    place = F.concat(F.col("fun"), F.lit(" ("), F.col("verb"), F.lit(" "), F.col("path"), F.lit(")"))
    tagged = tags.select(*HANDLER).distinct()
    across = F.col("path").startswith("/accounts/all/") | (F.col("path") == "/accounts/all")
    no_example = matched_responses.where(F.col("problem") == "no example")
    return (
        rows(endpoints.join(tagged, HANDLER, "left_anti"), "untagged", place)
        .unionByName(rows(endpoints.where(across), "unified", place))
        .unionByName(rows(undocumented_results, "undocumented_result", F.col("type_key")))
        .unionByName(rows(undocumented_bodies, "undocumented_body", F.col("type_key")))
        .unionByName(rows(no_example, "response_without_example", F.col("type_key")))
        .unionByName(rows(unmounted, "unmounted_handler", F.col("fun")))
        .distinct()
    )


def coverage_report(endpoints: DataFrame, items: DataFrame) -> DataFrame:
    """The number of findings of each kind per service and version, zero where there are none."""
    counts = items.groupBy(*SERVICE).agg(
        *[F.count_if(F.col("kind") == kind).alias(name) for kind, name in KINDS.items()]
    )
    services = endpoints.groupBy(*SERVICE).agg(F.count(F.lit(1)).alias("n_routes"))
    zero = F.lit(0)
    return services.join(counts, SERVICE, "full").select(
        *SERVICE,
        F.coalesce("n_routes", zero).alias("n_routes"),
        *[F.coalesce(name, zero).alias(name) for name in KINDS.values()],
    )
