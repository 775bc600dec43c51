"""Errors that handlers may answer with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.catalogue.defaults import GENERAL_CONDITION, MISSING_ACCOUNT_ERROR, HeaderRule
from pactscope.operators.common import HANDLER, SERVICE, present

CONDITIONS = ("account", "query", "query_required", "path", "path_required", "body", "body_required")


def build_error_catalogue(literals: DataFrame, codes: DataFrame, statuses: DataFrame) -> DataFrame:
    """Error variables with the status and code text of the constants they use."""
    code_keys = [*present(SERVICE, literals, codes), "code_name"]
    return literals.join(codes, code_keys).join(statuses.select("status_name", F.col("code").alias("status")), "status_name").select(
        *present(SERVICE, literals), "name", "status", F.col("code_text").alias("code"), "title", "detail"
    )


def broken_error_literals(literals: DataFrame, codes: DataFrame, statuses: DataFrame) -> DataFrame:
    """Error variables with a status or code constant that does not exist, and which it is."""
    code_keys = [*present(SERVICE, literals, codes), "code_name"]
    status_gap = literals.join(statuses, "status_name", "left_anti").withColumn("problem", F.lit("status"))
    code_gap = literals.join(codes, code_keys, "left_anti").withColumn("problem", F.lit("code"))
    columns = [*literals.columns, "problem"]
    return status_gap.select(*columns).unionByName(code_gap.select(*columns))


def resolve_handler_errors(handler_errors: DataFrame, errors: DataFrame) -> DataFrame:
    """The errors named by handlers, with their payload."""
    named = errors.withColumnRenamed("name", "error_name")
    return handler_errors.join(named, [*present(SERVICE, errors), "error_name"])


def missing_handler_errors(handler_errors: DataFrame, errors: DataFrame) -> DataFrame:
    """Errors named by handlers that no variable defines."""
    named = errors.withColumnRenamed("name", "error_name")
    return handler_errors.join(named, [*present(SERVICE, errors), "error_name"], "left_anti")


def held_conditions() -> Column:
    """An array with the name of each condition that holds, and null for each other one.

    The general one always holds; it counts where the rules have errors for it.
    """
    return F.array(*[F.when(F.col(f"has_{c}"), F.lit(c)) for c in CONDITIONS], F.lit(GENERAL_CONDITION))


def rule_payloads(errors: DataFrame, rules: DataFrame) -> DataFrame:
    """The errors of each parameter condition, in listed order."""
    return errors.withColumnRenamed("name", "error_name").join(rules, "error_name")


def apply_error_rules(flags: DataFrame, errors: DataFrame, rules: DataFrame) -> DataFrame:
    """The errors of every condition that holds for a handler.

    Flags become one row per condition, so that this is an equality join.
    """
    held = flags.select(*HANDLER, F.explode(held_conditions()).alias("condition")).where(F.col("condition").isNotNull())
    payloads = rule_payloads(errors, rules)
    return held.join(payloads, [*present(SERVICE, errors), "condition"])


def capability_errors_of(account_calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Errors of calls that need a kind of account: the missing account, and the missing capabilities.

    A call's own row yields the missing account; the rules table adds one row per capability.
    """
    calls = account_calls.select(*HANDLER, "account_kind").distinct()
    missing = calls.select(*HANDLER).distinct().withColumn("error_name", F.lit(MISSING_ACCOUNT_ERROR))
    lacking = calls.join(rules, "account_kind").select(*HANDLER, "error_name")
    return missing.unionByName(lacking).distinct()


def unknown_account_kinds(account_calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls for a kind of account that no rule lists."""
    return account_calls.join(rules, "account_kind", "left_anti")


def header_applies(rule: HeaderRule, code: Column) -> Column:
    """Whether a response header goes with a status code; redirects take part in either case."""
    applies = F.lit(True)
    if rule.only_codes is not None:
        applies = applies & code.isin(*rule.only_codes)
    if not rule.on_success:
        applies = applies & (code >= 300)
    if not rule.on_error:
        applies = applies & (code < 400)
    return applies


def header_names(headers: Sequence[HeaderRule], code: Column) -> Column:
    """The names of the headers that go with a status code, as an array."""
    names = F.array(*[F.when(header_applies(h, code), F.lit(h.name)) for h in headers])
    return F.filter(names, lambda name: name.isNotNull())


def applicable_headers(responses: DataFrame, headers: Sequence[HeaderRule]) -> DataFrame:
    """One row per response and header that goes with its code, expanded in place without a join."""
    code = F.col("code")
    names = F.array(*[F.when(header_applies(h, code), F.lit(h.name)) for h in headers])
    return responses.select("*", F.explode(names).alias("header")).where(F.col("header").isNotNull())


def error_payload_examples(handler_payloads: DataFrame, rule_errors: DataFrame) -> DataFrame:
    """One example per handler, status and detail text; where details repeat, the last error wins.

    Errors of the handler come first, then those of its conditions in their order.
    """
    own = handler_payloads.select(
        *HANDLER, "status", "code", "title", "detail", "error_name",
        F.struct(F.lit(-1).alias("place"), F.col("error_name").alias("by")).alias("_order"),
    )
    ruled = rule_errors.select(
        *HANDLER, "status", "code", "title", "detail", "error_name",
        F.struct(F.col("condition_rank").alias("place"), F.col("error_name").alias("by")).alias("_order"),
    )
    payload = F.to_json(F.struct("status", "code", "title", "detail"))
    return (
        own.unionByName(ruled)
        .withColumn("payload", payload)
        .groupBy(*HANDLER, "status", "detail")
        .agg(F.max_by(F.struct("error_name", "payload"), "_order").alias("_last"))
        .select(*HANDLER, "status", "detail", "_last.error_name", "_last.payload")
    )
