"""Template calls whose texts name the object."""

from pactscope.operators.templates import expand_templates


def test_name_of_the_object_in_all_texts(spark):
    key = "service string, version string, fun string"
    calls = spark.createDataFrame([("s", "1", "api.F", "create", "Mail")], f"{key}, template string, object_var string")
    routes = spark.createDataFrame([("s", "1", "api.F", "POST", "/mails")], f"{key}, verb string, path string")
    templates = spark.createDataFrame(
        [("create", "Makes {{.Name}}", True, "T", "the {{.Name}} among {{.Names}}")],
        "template string, comment_tpl string, body_required boolean, body_type string, body_comment_tpl string",
    )
    answers = spark.createDataFrame(
        [("create", 201, "made {{.Name}}", "[]T")], "template string, code int, summary_tpl string, response_type string"
    )
    objects = spark.createDataFrame(
        [("s", "1", "Mail", "mail", "mails", "m.Mail", "mid", None)],
        "service string, version string, var string, name string, plural string, foo string, uri_param_name string, account_type string",
    )
    generic = spark.createDataFrame(
        [("s", "1", "api.F", "create", "T", "m.Mail")], f"{key}, template string, placeholder string, type_key string"
    )
    definitions = spark.createDataFrame(
        [], "service string, version string, location string, const_name string, wire_name string, description string, default_value string"
    )
    bodies, responses, summaries = expand_templates(calls, routes, templates, answers, objects, generic, definitions)
    (body,), (answer,), (summary,) = bodies.collect(), responses.collect(), summaries.collect()
    assert (body.name, body.type_key, body.description) == ("m.Mail", "m.Mail", "the mail among mails")
    assert (answer.type_key, answer.summary) == ("[]m.Mail", "made mail")
    assert summary.default_summary == "Makes mail"
