import pytest
from pyspark.sql import functions as F

from pactscope.functions.jsontext import is_json
from pactscope.functions import paths, releases, sentences, tags, text, typekeys


def apply(spark, values, expression):
    rows = [(i, *((v,) if isinstance(v, str) else v)) for i, v in enumerate(values)]
    names = ["i", *[f"c{n}" for n in range(len(rows[0]) - 1)]]
    df = spark.createDataFrame(rows, names)
    out = df.select("i", expression(*[F.col(n) for n in names[1:]]).alias("out"))
    return [r.out for r in out.orderBy("i").collect()]


def test_singularize(spark):
    pairs = {
        "addressbooks": "addressbook", "blobs": "blob", "calendars": "calendar", "events": "event",
        "contacts": "contact", "vacationresponses": "vacationresponse", "quotas": "quota", "emails": "email",
        "mailboxes": "mailbox", "identities": "identity", "pages": "page", "addresses": "addresse", "email": "email", "": "",
    }
    assert apply(spark, list(pairs), text.singularize) == list(pairs.values())


def test_split_first(spark):
    cases = [
        ("foo", "foo", ""), ("foo:bar", "foo", "bar"), ("foo:bar:spam", "foo", "bar:spam"), (":bar", "", "bar"),
        (":", "", ""), ("", "", ""), (":bar:spam", "", "bar:spam"),
    ]
    out = apply(spark, [c[0] for c in cases], lambda c: text.split_first(c, ":"))
    assert [(o.before, o.after) for o in out] == [c[1:] for c in cases]
    long = apply(spark, ["a://b://c"], lambda c: text.split_first(c, "://"))[0]
    assert (long.before, long.after) == ("a", "b://c")


def test_linkify_refs(spark):
    link = "[RFC123](https://www.rfc-editor.org/rfc/rfc123.html)"
    cases = {
        "hello [RFC123] this is a test": f"hello {link} this is a test",
        "[RFC123](with a link)": "[RFC123](with a link)",
        "ends with [RFC123]": f"ends with {link}",
        "[RFC123][RFC2]": f"{link}[RFC2]",
        "[RFC123] [RFC2]": f"{link} [RFC2](https://www.rfc-editor.org/rfc/rfc2.html)",
        "“quoted”": '"quoted"',
    }
    assert apply(spark, list(cases), text.linkify_refs) == list(cases.values())


def test_small_text_steps(spark):
    assert apply(spark, ["// a", "//b", "//  c", "d // e"], text.strip_comment_marker) == ["a", "b", " c", "d // e"]
    assert apply(spark, ["  // a ", "///b", "c"], text.comment_body) == ["a ", "b", "c"]
    assert apply(spark, ["été d", "a B c", ""], text.title_first) == ["Été d", "A B c", ""]
    assert apply(spark, ["email", "Year", "x", ""], text.article) == ["an", "an", "a", "a"]


def test_join_path(spark):
    cases = [
        (("/", "a", "b"), "/a/b"), (("/", "/a/", "/b/"), "/a/b"), (("a", "b", ""), "/a/b"), (("", "", ""), "/"),
        (("/", "/", "x"), "/x"), (("/a", "/", "/"), "/a"), (("/", "/a/{id}", "b/"), "/a/{id}/b"),
    ]
    assert apply(spark, [c[0] for c in cases], paths.join_path) == [c[1] for c in cases]
    as_array = apply(spark, [c[0] for c in cases], lambda *c: paths.join_path_array(F.array(*c)))
    assert as_array == [c[1] for c in cases]


def test_path_placeholders(spark):
    assert apply(spark, ["/a/{x}/b/{yid}", "/a"], paths.path_placeholders) == [["{x}", "{yid}"], []]


@pytest.mark.parametrize(
    "verb, path, sentence, subject, child",
    [
        ("GET", "/accounts/{accountid}/changes/mailboxes", "Get the changes to mailbox objects since a given state for a given account", "mailbox", ""),
        ("POST", "/accounts/{accountid}/changes/mailboxes", "", "", ""),
        ("GET", "/accounts/all/emails/{emailid}", "retrieve an email by its identifier for all accounts", "email", ""),
        ("DELETE", "/accounts/{accountid}/mailboxes/{mailboxid}/roles/{roleid}",
         "delete a rol by its identifier of a mailbox by its own identifier for a given account", "mailbox", "rol"),
        ("GET", "/mailboxes/{mailboxid}/roles", "retrieve the roles of a mailbox by its identifier", "mailbox", "roles"),
        ("POST", "/emails", "create an email", "email", ""),
        ("PATCH", "/emails/", "modify all emails", "emails", ""),
        ("GET", "/", "", "", ""),
    ],
)
def test_inferred(spark, verb, path, sentence, subject, child):
    row = paths.with_inferred(spark.createDataFrame([(verb, path)], ["verb", "path"])).head().inferred
    assert (row.sentence, row.object, row.child) == (sentence, subject, child)


def test_unsupported_verb_is_null(spark):
    assert paths.with_inferred(spark.createDataFrame([("REPORT", "/a")], ["verb", "path"])).head().inferred is None


@pytest.mark.parametrize(
    "verb, path, code, success, missing",
    [
        ("GET", "/accounts/all/emails/{emailid}", 200,
         "the email corresponding to the specified identifier, across all accounts", "the account or the specified email does not exist"),
        ("GET", "/accounts/{accountid}/emails", 200, "the emails for the specified account", "the account or the specified emails do not exist"),
        ("POST", "/emails", 201, "the successfully created email", "the specified email does not exist"),
        ("DELETE", "/emails/{id}", 204, "the email was deleted successfully", "the specified email does not exist"),
        ("GET", "/boxes/{id}/roles/{id}", 200, "the successfully retrieved rol", "the specified rol does not exist within that box"),
        ("GET", "/emails", 404, None, "the specified emails do not exist"),
    ],
)
def test_sentences(spark, verb, path, code, success, missing):
    df = paths.with_inferred(spark.createDataFrame([(verb, path, code)], ["verb", "path", "code"]))
    inferred, number = F.col("inferred"), F.col("code")
    row = df.select(
        sentences.response_sentence(inferred, number), sentences.not_found_sentence(inferred), sentences.status_text(number)
    ).head()
    assert (row[0], row[1]) == (success, missing)
    assert row[2]


def test_tags_of_paths(spark):
    given = ["/accounts/{accountid}/changes/mailboxes", "/a/{aid}/bs", "/boxes/{boxid}/roles", "/quotas", "/", "/accounts/all/emails/{emailid}"]
    df = tags.with_inferred_tags(spark.createDataFrame([(i, p) for i, p in enumerate(given)], ["i", "path"]))
    out = [r.tags for r in df.orderBy("i").collect()]
    assert out == [["changes", "mailbox"], ["a"], ["rol"], ["quota"], [], ["email"]]
    marked = apply(spark, ["/accounts/all/x", "/x"], lambda p: tags.decorate_tags(F.array().cast("array<string>"), p))
    assert marked == [["untagged", "unified", "all"], ["untagged", "all"]]


def test_field_tags(spark):
    given = ['json:"a,omitempty" doc:"req"', 'json:"-"', 'doc:"opt"', 'json:"b" docdef:"x y"', ""]
    assert apply(spark, given, lambda t: tags.field_attr(t, F.lit("Name"))) == ["a", "-", "Name", "b", "Name"]
    assert apply(spark, given, tags.field_required) == [True, None, False, None, None]


def test_type_keys(spark):
    out = apply(spark, ["[]a.B", "map[string][]a.B", "string", "a.B", "[]", "?"], typekeys.split_type_key)
    assert [tuple(o) for o in out] == [
        ("array", None, "a.B"), ("map", "string", "[]a.B"), ("basic", None, None), ("named", None, None),
        ("unknown", None, None), ("unknown", None, None),
    ]
    assert apply(spark, ["[]map[string][]a.B", "int"], typekeys.leaf_key) == ["a.B", "int"]


def test_release_order(spark):
    given = ["v4.10.0", "v4.1.0", "v4.1.0-rc.1", "v4.1", "v1.2.3-a-b", "v1.2.99999999999999999999"]
    df = spark.createDataFrame([(g,) for g in given], ["tag"]).withColumn("r", releases.parse_release(F.col("tag")))
    ordered = df.where("r is not null").orderBy(releases.release_order(F.col("r"))).collect()
    assert [r.tag for r in ordered] == ["v4.1.0-rc.1", "v4.1.0", "v4.10.0"]


def test_is_json(spark):
    cases = {
        '{"a":1}': True, "[1, 2]": True, '"x"': True, "1": True, " null ": True, "": False, " ": False, '{"a":1}}': False, "1, 2": False,
        "1],[2": False, '1},{"x":2': False, "{": False, "x": False, '{"a":1} {"a":2}': False, None: False,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "text string")
    found = {r.text: r.ok for r in rows.select("text", is_json(F.col("text")).alias("ok")).collect()}
    assert found == cases
