"""The response of every handler and status code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactscope.catalogue.defaults import COMMON_REQUEST_HEADERS, DEFAULT_RESPONSE_CODES, RESPONSE_HELPERS
from pactscope.functions.paths import with_inferred
from pactscope.functions.sentences import not_found_sentence, response_sentence, status_text
from pactscope.functions.text import blank_to_null, title_first
from pactscope.operators.common import HANDLER, SERVICE, index_last, present
from pactscope.operators.errors import CONDITIONS, held_conditions, resolve_handler_errors, rule_payloads
from pactscope.operators.params import endpoint_flags
from pactscope.operators.routes import first_route_per_handler

# The order in which sources may define a response.
EXPLICIT, HANDLER_ERROR, RULE_ERROR, INFERRED, DEFAULT, PROFILE = range(6)


def response_from_call(calls: DataFrame, keys: Sequence[str] = HANDLER) -> DataFrame:
    """Responses told from calls of response helpers: the helper's status, or that of ``RBODY<code>``.

    Of several calls with the same status the last one counts.
    """
    helpers = F.create_map(
        *[
            part
            for name, status, has_body in RESPONSE_HELPERS
            for part in (F.lit(name), F.struct(F.lit(status).alias("status"), F.lit(has_body).alias("has_body")))
        ]
    )
    keys = present(keys, calls)
    named = F.regexp_extract("arg_name", r"^RBODY(\d+)$", 1).try_cast("int")
    rows = (
        calls.withColumn("_helper", F.try_element_at(helpers, F.col("method")))
        .where(F.col("_helper").isNotNull())
        .select(
            *keys,
            F.when(F.col("_helper.has_body"), F.coalesce(named, F.col("_helper.status")))
            .otherwise(F.col("_helper.status"))
            .alias("code"),
            F.col("_helper.has_body").alias("has_body"),
            F.coalesce("comment", F.lit("")).alias("summary"),
            "ord",
        )
    )
    return index_last(rows, [*keys, "code"], "ord")


def handler_profile(endpoints: DataFrame, params: DataFrame) -> DataFrame:
    """One row per mounted handler: its first route, what that does, and its parameter flags."""
    first = with_inferred(first_route_per_handler(endpoints))
    return first.join(endpoint_flags(params), HANDLER, "left").select(
        *HANDLER,
        "verb",
        "path",
        "inferred",
        *[F.coalesce(f"has_{c}", F.lit(False)).alias(f"has_{c}") for c in CONDITIONS],
        F.coalesce("n_visible", F.lit(0)).alias("n_visible"),
    )


def _candidate(
    rank: int,
    source: str,
    code: Column,
    summary: Column,
    type_key: Column,
    example_key: Column | None = None,
    place: Column | None = None,
    tie: Column | None = None,
) -> Column:
    """A possible response; the least ``rank, place, tie`` per code is the one that counts."""
    none = F.lit(None)
    return F.struct(
        code.cast("int").alias("code"),
        F.lit(rank).alias("rank"),
        (F.lit(0) if place is None else place).cast("long").alias("place"),
        (none if tie is None else tie).cast("string").alias("tie"),
        F.lit(source).alias("source"),
        summary.cast("string").alias("summary"),
        type_key.cast("string").alias("type_key"),
        (none if example_key is None else example_key).cast("string").alias("example_key"),
    )


def _column_of(df: DataFrame, name: str) -> Column:
    """A column that a table may lack."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def rule_sets(errors: DataFrame, rules: DataFrame) -> DataFrame:
    """The errors of all parameter conditions, one row per service; never more than the rules list."""
    payloads = rule_payloads(errors, rules)
    rule = F.struct(
        "condition",
        F.col("condition_rank").alias("place"),
        "error_name",
        F.col("status").cast("int").alias("status"),
        _column_of(errors, "type_key").alias("type_key"),
        _column_of(errors, "example_key").alias("example_key"),
    )
    return payloads.groupBy(*present(SERVICE, errors)).agg(F.collect_set(rule).alias("rules"))


def general_candidates(
    profile: DataFrame, errors: DataFrame, rules: DataFrame, error_type: str, legacy_bad_request: bool = False
) -> DataFrame:
    """What a handler's parameters and path tell: rule errors, an inferred 404 and the defaults.

    Each handler also has a row of source ``profile`` without a code, which carries ``inferred``.
    """
    missing, counted = F.col("_missing"), F.col("n_visible")
    if legacy_bad_request:
        counted = counted - len(COMMON_REQUEST_HEADERS)
    none = F.lit(None)
    general = [
        _candidate(PROFILE, "profile", none, none, none),
        F.when(missing.isNotNull(), _candidate(INFERRED, "inferred", F.lit(404), missing, F.lit(error_type))),
    ]
    for code in DEFAULT_RESPONSE_CODES:
        offered = _candidate(DEFAULT, "default", F.lit(code), status_text(F.lit(code)), F.lit(error_type))
        # without parameters there is nothing to get wrong in a request
        general.append(F.when(counted >= 1, offered) if code == 400 else offered)

    def ruled(rule: Column) -> Column:
        return _candidate(
            RULE_ERROR, "rule_error", rule.status, status_text(rule.status),
            F.coalesce(rule.type_key, F.lit(error_type)), rule.example_key, place=rule.place, tie=rule.error_name,
        )

    held = F.filter(F.col("rules"), lambda rule: F.array_contains(held_conditions(), rule.condition))
    candidates = F.concat(F.array(*general), F.coalesce(F.transform(held, ruled), F.array()))
    return (
        profile.withColumn("_missing", not_found_sentence(F.col("inferred")))
        .join(rule_sets(errors, rules), present(SERVICE, errors), "left")
        .select(*HANDLER, "inferred", F.explode_outer(candidates).alias("c"))
        .where(F.col("c").isNotNull())
        .select(*HANDLER, "c.*", F.when(F.col("c.source") == "profile", F.col("inferred")).alias("inferred"))
    )


def effective_responses(
    endpoints: DataFrame,
    params: DataFrame,
    responses: DataFrame,
    handler_errors: DataFrame,
    errors: DataFrame,
    rules: DataFrame,
    error_type: str,
    legacy_bad_request: bool = False,
) -> DataFrame:
    """The one response of every mounted handler and status code, with its summary.

    Explicit responses come before the handler's errors, the errors of its parameters' conditions, a
    404 inferred from the path, and the defaults. Errors have the type and example that their table
    states, and ``error_type`` otherwise, as do the last two sources.

    Every table is read once. The choice is an aggregation with partial results, so that handlers with
    very many responses are reduced before the shuffle; what is known of a handler travels along as
    one more row and is handed to its responses, of which there are at most as many as status codes.
    """
    profile = handler_profile(endpoints, params)
    general = general_candidates(profile, errors, rules, error_type, legacy_bad_request)
    nothing = F.lit(None).cast(general.schema["inferred"].dataType).alias("inferred")
    explicit = responses.select(
        *HANDLER,
        _candidate(
            EXPLICIT, "explicit", F.col("code"), F.col("summary"), F.col("type_key"),
            _column_of(responses, "example_key"), place=-F.col("ord"),
        ).alias("c"),
    )
    own = resolve_handler_errors(handler_errors, errors).select(
        *HANDLER,
        _candidate(
            HANDLER_ERROR, "handler_error", F.col("status"), status_text(F.col("status")),
            F.coalesce(_column_of(errors, "type_key"), F.lit(error_type)), _column_of(errors, "example_key"),
            tie=F.col("error_name"),
        ).alias("c"),
    )
    offered = explicit.unionByName(own).select(*HANDLER, "c.*", nothing).unionByName(general)
    best = F.min_by(
        F.struct("source", "summary", "type_key", "example_key", "inferred"), F.struct("rank", "place", "tie")
    )
    handler = Window.partitionBy(*HANDLER)
    chosen = (
        offered.groupBy(*HANDLER, "code")
        .agg(best.alias("c"))
        .select(*HANDLER, "code", "c.source", "c.summary", "c.type_key", "c.example_key", F.col("c.inferred").alias("_profile"))
        .withColumns(
            {
                "inferred": F.max("_profile").over(handler),
                "mounted": F.max(F.col("source") == "profile").over(handler),
            }
        )
        .where(F.col("mounted") & F.col("code").isNotNull())
    )
    code, inferred = F.col("code"), F.col("inferred")
    summary = F.coalesce(
        blank_to_null(F.col("summary")),
        response_sentence(inferred, code),
        F.when(code == 404, not_found_sentence(inferred)),
        status_text(code),
    )
    return chosen.select(
        *HANDLER, "code", "source", title_first(summary).alias("summary"), "type_key", "example_key"
    )


def operation_responses(endpoints: DataFrame, effective: DataFrame) -> DataFrame:
    """The responses of every route: those of its handler."""
    return endpoints.select(*HANDLER, "verb", "path").join(effective, HANDLER)
