"""URL path steps: seams, placeholders, account scope and path classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.functions.text import article, singularize

# The two account prefixes of a path.
ONE_ACCOUNT_PREFIX = "/accounts/{accountid}/"
ALL_ACCOUNTS_PREFIX = "/accounts/all/"

# The shapes a path may have after its account prefix.
CHANGES = r"^(changes)/([^/]+s)$"
CHILD_BY_ID = r"^([^/]+?s)/\{[^/]*?id\}/([^/]+?s)/\{[^/]*?id\}$"
CHILDREN = r"^([^/]+?s)/\{[^/]*?id\}/([^/]+?s)$"
BY_ID = r"^([^/]+?s)/\{[^/]*?id\}$"
COLLECTION = r"^([^/]+?s)/?$"

# What each verb does, and its participle.
VERB_ACTIONS = {
    "GET": ("retrieve", "retrieved"),
    "POST": ("create", "created"),
    "PUT": ("replace", "replaced"),
    "PATCH": ("modify", "modified"),
    "DELETE": ("delete", "deleted"),
}


def append_segment(base: Column, part: Column) -> Column:
    """``base`` and ``part`` with one slash between them and none at the end; an empty path is ``/``."""
    joined = F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), F.regexp_replace(part, "^/", ""))
    trimmed = F.regexp_replace(joined, "/$", "")
    return F.when(trimmed == "", F.lit("/")).otherwise(trimmed)


def join_path(*parts: Column) -> Column:
    """One path from its parts."""
    return reduce(append_segment, parts, F.lit("/"))


def join_path_array(parts: Column) -> Column:
    """One path from an array of parts, appended in order."""
    return F.aggregate(parts, F.lit("/"), append_segment)


def path_placeholders(path: Column) -> Column:
    """The ``{x}`` segments in order."""
    return F.filter(F.split(path, "/"), lambda s: s.startswith("{") & s.endswith("}"))


def with_path_shape(df: DataFrame, path: str = "path") -> DataFrame:
    """Add the account scope of a path and the class of the rest of it, as columns ``_…``.

    The columns build on each other in steps, which keeps each expression small.
    """
    at = F.col(path)
    one = at.startswith(ONE_ACCOUNT_PREFIX)
    every = at.startswith(ALL_ACCOUNTS_PREFIX)
    length = F.when(one, len(ONE_ACCOUNT_PREFIX)).when(every, len(ALL_ACCOUNTS_PREFIX)).otherwise(1)
    rest, kind = F.col("_rest"), F.col("_class")
    return (
        df.withColumns(
            {
                "_for_account": one | every,
                "_for_all_accounts": every,
                "_rest": F.substr(at, length + 1),
            }
        )
        .withColumn(
            "_class",
            F.when(rest.rlike(CHANGES), "changes")
            .when(rest.rlike(CHILD_BY_ID), "child")
            .when(rest.rlike(CHILDREN), "children")
            .when(rest.rlike(BY_ID), "object")
            .when(rest.rlike(COLLECTION), "collection"),
        )
        .withColumns(
            {
                "_object": F.when(kind == "changes", F.regexp_extract(rest, CHANGES, 2))
                .when(kind.isNotNull(), F.regexp_extract(rest, r"^([^/]+)", 1))
                .otherwise(""),
                "_child": F.when(
                    kind.isin("child", "children"), F.regexp_extract(rest, r"^[^/]+/[^/]+/([^/]+)", 1)
                ).otherwise(""),
            }
        )
        .withColumns({"_object_one": singularize(F.col("_object")), "_child_one": singularize(F.col("_child"))})
    )


SHAPE_COLUMNS = (
    "_for_account", "_for_all_accounts", "_rest", "_class", "_object", "_child", "_object_one", "_child_one"
)

INFERRED_FIELDS = (
    "sentence",
    "object",
    "child",
    "action",
    "adjective",
    "for_account",
    "for_all_accounts",
    "specific_object",
    "specific_child",
)


def with_inferred(df: DataFrame, verb: str = "verb", path: str = "path", name: str = "inferred") -> DataFrame:
    """Add what an endpoint does, told from its verb and path; null for a verb without an action."""
    words = F.create_map(
        *[
            part
            for key, (action, adjective) in VERB_ACTIONS.items()
            for part in (F.lit(key), F.struct(F.lit(action).alias("action"), F.lit(adjective).alias("adjective")))
        ]
    )
    kind, action = F.col("_kind"), F.col("_verb.action")
    named, one, child, child_one = (F.col(c) for c in ("_object", "_object_one", "_child", "_child_one"))
    sentence = (
        F.when(kind == "changes", F.format_string("Get the changes to %s objects since a given state", one))
        .when(
            kind == "child",
            F.format_string(
                "%s %s %s by its identifier of %s %s by its own identifier",
                action, article(child_one), child_one, article(one), one,
            ),
        )
        .when(
            kind == "children",
            F.format_string("%s the %s of %s %s by its identifier", action, child, article(one), one),
        )
        .when(kind == "object", F.format_string("%s %s %s by its identifier", action, article(one), one))
        .when((kind == "collection") & (action == "create"), F.format_string("create %s %s", article(one), one))
        .when(kind == "collection", F.format_string("%s all %s", action, named))
    )
    suffix = (
        F.when(F.col("_for_all_accounts"), " for all accounts")
        .when(F.col("_for_account"), " for a given account")
        .otherwise("")
    )
    inferred = F.struct(
        F.coalesce(F.concat(sentence, suffix), F.lit("")).alias("sentence"),
        F.when(kind.isNull(), "")
        .when((kind == "collection") & (action != "create"), named)
        .otherwise(one)
        .alias("object"),
        F.when(kind == "child", child_one).when(kind == "children", child).otherwise("").alias("child"),
        action.alias("action"),
        F.col("_verb.adjective").alias("adjective"),
        F.col("_for_account").alias("for_account"),
        F.col("_for_all_accounts").alias("for_all_accounts"),
        F.coalesce(kind.isin("child", "children", "object"), F.lit(False)).alias("specific_object"),
        F.coalesce(kind == "child", F.lit(False)).alias("specific_child"),
    )
    return (
        with_path_shape(df, path)
        .withColumn("_verb", F.try_element_at(words, F.col(verb)))
        # a feed of changes can only be read
        .withColumn("_kind", F.when((F.col("_class") != "changes") | (F.col(verb) == "GET"), F.col("_class")))
        .withColumn(name, F.when(F.col("_verb").isNotNull(), inferred))
        .drop("_verb", "_kind", *SHAPE_COLUMNS)
    )
