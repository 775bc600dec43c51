"""Summaries of responses, and reason phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactscope.catalogue.defaults import HTTP_STATUS
from pactscope.functions.text import singularize


def response_sentence(inferred: Column, code: Column) -> Column:
    """Summary of a 2xx response from what the endpoint does; null where there is nothing to say."""
    has_child = inferred.child != ""
    subject = F.when(has_child, inferred.child).otherwise(inferred.object)
    specific = F.when(has_child, inferred.specific_child).otherwise(inferred.specific_object)
    account_wide = (inferred.for_all_accounts | inferred.for_account) & ~has_child
    done = F.format_string("the successfully %s %s", inferred.adjective, subject)
    text = (
        F.when(
            (inferred.action == "retrieve") & account_wide,
            F.when(
                specific,
                F.format_string(
                    "the %s corresponding to the specified identifier, %s",
                    subject,
                    F.when(inferred.for_all_accounts, "across all accounts").otherwise("for that account"),
                ),
            ).otherwise(
                F.format_string(
                    "the %s for %s",
                    subject,
                    F.when(inferred.for_all_accounts, "all accounts").otherwise("the specified account"),
                )
            ),
        )
        .when(inferred.action == "delete", F.format_string("the %s was %s successfully", subject, inferred.adjective))
        .when(inferred.action.isin("retrieve", "create", "replace", "modify"), done)
    )
    return F.when(code.between(200, 299) & (subject != ""), text)


def not_found_sentence(inferred: Column) -> Column:
    """Summary of a 404 response: which object does not exist; null without an object."""
    child = (inferred.child != "") & inferred.specific_child
    subject = F.when(child, inferred.child).otherwise(inferred.object)
    return F.when(
        subject != "",
        F.concat(
            F.when(inferred.for_account, F.lit("the account or the specified ")).otherwise(F.lit("the specified ")),
            subject,
            F.when(singularize(subject) != subject, F.lit(" do")).otherwise(F.lit(" does")),
            F.lit(" not exist"),
            F.when(child, F.concat(F.lit(" within that "), inferred.object)).otherwise(F.lit("")),
        ),
    )


def status_text(code: Column) -> Column:
    """Reason phrase of a status code; null for an unknown one."""
    pairs = ", ".join(f"{number}, '{text.replace(chr(39), chr(92) + chr(39))}'" for number, _, text in HTTP_STATUS)
    return F.try_element_at(F.expr(f"map({pairs})"), code.cast("int"))
