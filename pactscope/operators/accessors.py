"""Parameters told from the accessor calls of handlers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.catalogue.defaults import ACCOUNT_PARAM
from pactscope.functions.text import linkify_refs

# The names of accessor methods.
OPTIONAL_QUERY = r"^(?:parse|get)([A-Z].*?)Param$"
MANDATORY_QUERY = r"^(?:parse|get)Mandatory([A-Z].*?)Param$"
SINGLE_QUERY = r"^parseOpt([A-Z].*?)Param$"
ACCOUNT_GETTER = r"^(?:GetAccountFor|GetAccountIdFor)"
NEEDED_ACCOUNT = r"^need([A-Z][a-z]+)WithAccount$"
BODY_METHODS = ("body", "bodydoc", "optBody", "optBodyDoc")
PATH_METHODS = ("PathParam", "PathParamDoc", "PathListParamDoc")
HEADER_METHODS = ("HeaderParam", "HeaderParamDoc", "OptHeaderParam", "OptHeaderParamDoc")

# The value types in accessor names.
VALUE_TYPES = [
    ("String", "string"),
    ("Int", "int"),
    ("UInt", "uint"),
    ("Date", "string"),
    ("Bool", "bool"),
    ("StringList", "[]string"),
    ("Map", "map[string]string"),
]


def typed_accessor(calls: DataFrame) -> DataFrame:
    """The parameter of each accessor call: ``location, name, type_key, required, exploded, …``.

    Other calls are left out. An accessor of an unknown value type has a ``problem`` and no type.
    """
    method, arg = F.col("method"), F.col("arg_name")

    def value_type_of(pattern: str) -> Column:
        return F.regexp_extract(method, pattern, 1)

    single, mandatory, optional = (method.rlike(p) for p in (SINGLE_QUERY, MANDATORY_QUERY, OPTIONAL_QUERY))
    value = (
        F.when(single, value_type_of(SINGLE_QUERY))
        .when(mandatory, value_type_of(MANDATORY_QUERY))
        .when(optional, value_type_of(OPTIONAL_QUERY))
    )
    url_get = (method == "Get") & arg.startswith("QueryParam")
    account = method.rlike(ACCOUNT_GETTER) & (arg == "")
    needed = method.rlike(NEEDED_ACCOUNT) & (arg == "")
    in_body, in_path, in_header = (
        method.isin(*names) for names in (BODY_METHODS, PATH_METHODS, HEADER_METHODS)
    )
    router = method == "URLParam"
    location = (
        F.when(in_body, "body")
        .when(account | needed | in_path | router, "path")
        .when(in_header, "header")
        .when(value.isNotNull() | url_get, "query")
    )
    types = F.create_map(*[F.lit(v) for pair in VALUE_TYPES for v in pair])
    type_key = (
        F.when(in_body, arg)
        .when(method == "PathListParamDoc", "[]string")
        .when(value.isNotNull() & (F.col("_location") == "query"), F.try_element_at(types, value))
        .otherwise("string")
    )
    documented = method.isin("bodydoc", "optBodyDoc", "PathParamDoc", "PathListParamDoc", "HeaderParamDoc", "OptHeaderParamDoc")
    return (
        calls.withColumn("_location", location)
        .where(F.col("_location").isNotNull())
        .withColumn("type_key", type_key)
        .select(
            *[c for c in ("service", "version", "file", "fun") if c in calls.columns],
            "line_no",
            "ord",
            F.col("_location").alias("location"),
            F.when(account | needed, F.lit(ACCOUNT_PARAM))
            .when(router, F.col("second_name"))
            .otherwise(arg)
            .alias("name"),
            "type_key",
            F.when(F.col("_location") == "query", mandatory & ~single)
            .otherwise(~method.rlike("^(opt|Opt)"))
            .alias("required"),
            (
                method.isin("PathParamDoc", "PathListParamDoc")
                | F.coalesce((F.col("_location") == "query") & (value == "StringList"), F.lit(False))
            ).alias("exploded"),
            F.when(documented, F.col("arg_text"))
            .when(in_body, F.lit(""))
            .otherwise(linkify_refs(F.col("comment")))
            .alias("description"),
            F.when(needed, F.regexp_extract(method, NEEDED_ACCOUNT, 1)).alias("account_kind"),
            F.when(F.col("type_key").isNull(), "unsupported value type").alias("problem"),
        )
    )
