import pytest
from pyspark.sql import functions as F

from pactscope.catalogue import defaults
from pactscope.operators import common, errors, params, responses, routes

ERROR_TYPE = "m.ErrorResponse"


@pytest.fixture(scope="module")
def tables(spark):
    key = "service string, version string, "
    return {
        "endpoints": spark.createDataFrame(
            [("s", "1", "GET", "/accounts/{accountid}/emails", "f", 2), ("s", "1", "POST", "/emails", "f", 1), ("s", "1", "GET", "/", "bare", 3)],
            key + "verb string, path string, fun string, ord bigint",
        ),
        "params": spark.createDataFrame(
            [("s", "1", "f", "path", "UriParamAccountId", True, "", 1), ("s", "1", "f", "query", "QueryParamLimit", False, "", 2),
             ("s", "1", "f", "body", "m.A", True, "the body", 3), ("s", "1", "bare", "path", "UriParamX", False, "", 4)],
            key + "fun string, location string, name string, required boolean, description string, ord bigint",
        ),
        "responses": spark.createDataFrame(
            [("s", "1", "f", 201, "", "m.A", 1), ("s", "1", "f", 201, "last", "m.B", 2), ("s", "1", "f", 204, "", None, 3), ("s", "1", "gone", 200, "x", None, 4)],
            key + "fun string, code int, summary string, type_key string, ord bigint",
        ),
        "errors": spark.createDataFrame(
            [("s", "1", "ErrorNonExistingAccount", 404, "E1", "t", "d1"), ("s", "1", "ErrorInvalidRequestParameter", 400, "E2", "t", "d2"),
             ("s", "1", "ErrorMissingMandatoryRequestParameter", 400, "E3", "t", "d2"), ("s", "1", "ErrorInvalidRequestBody", 422, "E4", "t", "d4"),
             ("s", "1", "ErrorForbidden", 403, "E5", "t", "d5")],
            key + "name string, status int, code string, title string, detail string",
        ),
        "handler_errors": spark.createDataFrame([("s", "1", "f", "ErrorForbidden"), ("s", "1", "f", "Unknown")], key + "fun string, error_name string"),
    }


def effective(spark, tables, **options):
    df = responses.effective_responses(
        tables["endpoints"], tables["params"], tables["responses"], tables["handler_errors"], tables["errors"],
        defaults.error_rules(spark), ERROR_TYPE, **options,
    )
    return {(r.fun, r.code): (r.source, r.summary, r.type_key) for r in df.collect()}


def test_effective_responses(spark, tables):
    assert effective(spark, tables) == {
        ("f", 201): ("explicit", "Last", "m.B"),
        ("f", 204): ("explicit", "The successfully created email", None),
        ("f", 403): ("handler_error", "Forbidden", ERROR_TYPE),
        ("f", 404): ("rule_error", "Not Found", ERROR_TYPE),
        ("f", 400): ("rule_error", "Bad Request", ERROR_TYPE),
        ("f", 422): ("rule_error", "Unprocessable Entity", ERROR_TYPE),
        ("f", 500): ("default", "Internal Server Error", ERROR_TYPE),
        # a handler with path parameters only cannot be asked badly, but its parameters can be invalid
        ("bare", 400): ("rule_error", "Bad Request", ERROR_TYPE),
        ("bare", 404): ("default", "Not Found", ERROR_TYPE),
        ("bare", 500): ("default", "Internal Server Error", ERROR_TYPE),
    }


def test_default_bad_request(spark, tables):
    given = dict(tables, errors=tables["errors"].where("status <> 400"))
    assert ("f", 400) in effective(spark, given)
    assert ("bare", 400) not in effective(spark, given)
    assert ("f", 400) not in effective(spark, given, legacy_bad_request=True)


def test_inferred_not_found(spark, tables):
    given = dict(tables, errors=tables["errors"].where("status <> 404"))
    assert effective(spark, given)[("f", 404)] == ("inferred", "The specified email does not exist", ERROR_TYPE)


@pytest.mark.parametrize(
    "code, expected",
    [
        (200, {"Session-State", "State", "Object-Type", "Account-Id", "Account-Ids", "Trace-Id"}),
        (304, {"Session-State", "State", "Object-Type", "Account-Id", "Account-Ids", "Trace-Id"}),
        (404, {"Session-State", "Object-Type", "Account-Id", "Account-Ids", "Trace-Id", "Unmatched-Path", "Unsupported-Method"}),
        (500, {"Session-State", "Object-Type", "Account-Id", "Account-Ids", "Trace-Id"}),
    ],
)
def test_applicable_headers(spark, code, expected):
    df = spark.createDataFrame([(code,)], "code int")
    assert {r.header for r in errors.applicable_headers(df, defaults.DEFAULT_HEADERS).collect()} == expected


def test_error_examples_keep_the_last_of_a_detail(spark, tables):
    own = errors.resolve_handler_errors(tables["handler_errors"], tables["errors"])
    ruled = errors.apply_error_rules(params.endpoint_flags(tables["params"]), tables["errors"], defaults.error_rules(spark))
    found = {(r.fun, r.status, r.detail): r.error_name for r in errors.error_payload_examples(own, ruled).collect()}
    assert found[("f", 400, "d2")] == "ErrorMissingMandatoryRequestParameter"
    assert found[("f", 403, "d5")] == "ErrorForbidden"
    assert [r.error_name for r in errors.missing_handler_errors(tables["handler_errors"], tables["errors"]).collect()] == ["Unknown"]


def test_response_from_call(spark):
    calls = spark.createDataFrame(
        [("f", "respond", "RBODY201", "a", 1), ("f", "respond", "RBODY201", "b", 2), ("f", "noContent", "RBODY299", None, 3),
         ("f", "response", "RBODY", "c", 4), ("f", "other", "x", "", 5), ("f", "notImplementedN", "", "", 6)],
        "fun string, method string, arg_name string, comment string, ord int",
    )
    found = {(r.code, r.has_body, r.summary) for r in responses.response_from_call(calls).collect()}
    assert found == {(201, True, "b"), (204, False, ""), (200, True, "c"), (501, False, "")}


def test_clean_catalogue_has_no_findings(spark, tables):
    handlers = tables["endpoints"].select(*common.HANDLER).distinct()
    assert routes.unmounted_handlers(tables["endpoints"], handlers).isEmpty()
    assert routes.dangling_routes(tables["endpoints"], handlers).isEmpty()
    assert routes.route_conflicts(tables["endpoints"]).isEmpty()
    assert routes.unsupported_verbs(tables["endpoints"]).isEmpty()
    planted = tables["endpoints"].unionByName(tables["endpoints"].withColumn("verb", F.lit("REPORT")).withColumn("fun", F.lit("new")))
    assert routes.dangling_routes(planted, handlers).count() == 3
    assert routes.unsupported_verbs(planted).count() == 3
    assert routes.route_conflicts(planted.unionByName(tables["endpoints"])).count() == 3


def test_verb_order(spark):
    verbs = ["TRACE", "ZAP", "DELETE", "GET", "ACL", "QUERY", "PUT", "POST", "HEAD", "PATCH", "OPTIONS"]
    df = routes.order_by_verb(spark.createDataFrame([(v,) for v in verbs], ["verb"]))
    assert [r.verb for r in df.collect()] == ["GET", "QUERY", "HEAD", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "TRACE", "ACL", "ZAP"]


def test_bodies(spark):
    df = spark.createDataFrame(
        [("s", "1", "one", "body", "m.A", False, "text", 1), ("s", "1", "two", "body", "m.A", False, "x", 1), ("s", "1", "two", "body", "m.B", False, "y", 2)],
        "service string, version string, fun string, location string, name string, required boolean, description string, ord int",
    )
    found = {r.fun: (r.form, r.required, r.description, r.bodies) for r in params.collapse_bodies(df).collect()}
    assert found == {"one": ("single", False, "Text", ["m.A"]), "two": ("one_of", True, "", ["m.A", "m.B"])}


def test_groups_stay_whole_and_in_order(spark):
    """A group with a third of all rows is one value, complete and sorted."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("key"), F.col("id")
    )
    found = {r.key: r["items"] for r in common.collect_ordered(rows, ["key"], F.col("id")).collect()}
    assert found["hot"] == list(range(0, 3000, 3)) and sum(map(len, found.values())) == 3000
    assert all(items == sorted(items) for items in found.values())


def test_undocumented_takes_mounted_handlers(spark):
    """A type that an unmounted handler uses first is still reported for the mounted one."""
    routes = spark.createDataFrame([("s", "1", "live", "GET", "/x")], "service string, version string, fun string, verb string, path string")
    bodies = spark.createDataFrame(
        [("s", "1", "dead", "body", "m.A", "", 1), ("s", "1", "live", "body", "m.A", "", 2)],
        "service string, version string, fun string, location string, name string, description string, ord int",
    )
    assert [(r.type_key, r.fun, r.path) for r in params.undocumented_bodies(bodies, routes).collect()] == [("m.A", "live", "/x")]
    results = bodies.withColumnRenamed("name", "type_key").drop("location", "description")
    types = spark.createDataFrame([("m.A", "")], "type_key string, summary string")
    assert [(r.type_key, r.fun, r.verb) for r in params.undocumented_results(results, types, routes).collect()] == [("m.A", "live", "GET")]


def test_set_operations(spark, rows_of):
    a = spark.createDataFrame([("x", 1), ("y", 2)], ["k", "v"])
    b = spark.createDataFrame([("y", 3), ("z", 4)], ["k", "v"])
    assert rows_of(common.merge_keep_existing(a, b, ["k"])) == [("x", 1), ("y", 2), ("z", 4)]
    assert rows_of(common.overlay(a, b, ["k"])) == [("x", 1), ("y", 3), ("z", 4)]
    assert rows_of(common.except_seen(b.union(b), a, ["k"])) == [("z",)]
    assert rows_of(common.distinct_keys(a, b, keys=["k"])) == [("x",), ("y",), ("z",)]
