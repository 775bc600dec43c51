import random

import pytest
from pyspark.sql import functions as F

from pactscope.operators import comments
from pactscope.sources import corpus


def lines(spark, texts, decl="d"):
    return spark.createDataFrame([(decl, i, t) for i, t in enumerate(texts)], "decl_id string, line_no bigint, text string")


@pytest.mark.parametrize(
    "texts, summary, description",
    [
        (["the summary"], "The summary", ""),
        (["", " ", "the summary", ""], "The summary", ""),
        (["", "the summary", "", "More is described here", "technically one could say it's the description."],
         "The summary", "More is described here\ntechnically one could say it's the description."),
        (["swagger:model x", "a", "swagger:y", "b", "swagger:z", "c"], "A", "B\nswagger:z\nc"),
        (["", ""], "", ""),
    ],
)
def test_summarize_blocks(spark, texts, summary, description):
    found = comments.summarize_blocks(lines(spark, texts))
    assert [r.summary for r in comments.summary_of(found, ["decl_id"]).collect()] == [summary]
    assert "".join(r.description for r in comments.description_of(found, ["decl_id"]).collect()) == description


def brute_summary(texts):
    clean = [t for t in texts]
    good = [i for i, t in enumerate(clean) if t.strip() and not t.strip().startswith("swagger:")]
    if not good:
        return "", ""
    title = lambda s: s[:1].upper() + s[1:]
    rest = "\n".join(clean[good[1]:]) if len(good) > 1 else ""
    return title(clean[good[0]]), title(rest)


@pytest.mark.parametrize("apart", [1, 5_000, 200_003])
def test_lines_far_apart(spark, apart):
    """Line numbers of any distance make one declaration, with every line."""
    rng = random.Random(5)
    vocabulary = ["", " ", "swagger:model", "word", "more words", "z"]
    texts = {f"d{n}": [rng.choice(vocabulary[: rng.choice([3, 6])]) for _ in range(rng.randrange(1, 60))] for n in range(25)}
    rows = [(d, 300_000 + i * apart, t) for d, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "decl_id string, line_no bigint, text string").repartition(8)
    found = comments.summarize_blocks(df)
    summaries = {r.decl_id: r.summary for r in comments.summary_of(found, ["decl_id"]).collect()}
    described = {r.decl_id: r.description for r in comments.description_of(found, ["decl_id"]).collect()}
    for decl, ts in texts.items():
        assert (summaries[decl], described.get(decl, "")) == brute_summary(ts)


def endpoint_summary(spark, texts, apart):
    rows = [("s", "v", "f", i, t) for i, t in enumerate(texts)]
    rows = [(*r[:3], r[3] + apart * (r[3] > 1), r[4]) for r in rows]
    df = spark.createDataFrame(rows, "service string, version string, fun string, line_no bigint, text string")
    keys = ["service", "version", "fun"]
    described = spark.createDataFrame([("s", "v", "f", "create an email")], [*keys, "sentence"])
    found = comments.summarize_endpoints(df, described)
    (summary,) = [r.summary for r in comments.summary_of(found, keys).collect()]
    return summary, "".join(r.description for r in comments.description_of(found, keys).collect())


@pytest.mark.parametrize("apart", [0, 500_000])
@pytest.mark.parametrize(
    "texts, summary, description",
    [
        (["", "does it. ", "", "more", "@api:tag x", "text", "responses:", "200: x"], "Does it", "More\ntext"),
        (["swagger:route GET /x", "the line.", "rest"], "The line", "Rest"),
        (["", " "], "Create an email", ""),
        (["// marked", "@api:body T"], "Marked", ""),
        (["// marked", "@api:body T", "", "then text", "x"], "Marked", "\nthen text\nx"),
    ],
)
def test_summarize_endpoints(spark, texts, summary, description, apart):
    assert endpoint_summary(spark, texts, apart) == (summary, description)


def test_scans_and_exchanges(spark, tmp_path):
    """The corpus is read twice at most, for the bounds and for the lines."""
    lines(spark, ["a", "", "b"]).write.parquet(str(tmp_path / "lines"))
    found = comments.summarize_blocks(spark.read.parquet(str(tmp_path / "lines")))
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("FileScan") <= 3 and plan.count("Exchange hashpartitioning") <= 6


def test_directives(spark, rows_of):
    given = lines(
        spark,
        [
            "@api:tag a, b,", " @api:tags c", "@api:example first", "@api:examples second", "@api:success 201", "@api:success 204 x",
            "@api:response 200 fine", "@api:response 200:[]T better", "@api:response 404:X none", "@api:body T the body", "@api:body ?U other", "text @api:tag z",
        ],
    )
    found = rows_of(comments.mine_directives(given).fillna(-1, ["code"]).fillna("", ["type_key", "text"]), "kind", "code", "type_key", "text")
    assert found == sorted([
        ("tag", -1, "", "a"), ("tag", -1, "", "b"), ("tag", -1, "", "c"), ("example", -1, "", "second"), ("success", 204, "", ""),
        ("response", 200, "[]T", "better"), ("response", 404, "X", "none"), ("body", -1, "U", "other"),
    ])
    body = comments.mine_directives(given).where("kind = 'body'").head()
    assert body.required is False


def test_attach_comments(spark, rows_of):
    groups = spark.createDataFrame(
        [("f", 1, 1, 4), ("f", 2, 5, 5), ("f", 3, 9, 9), ("g", 4, 5, 5)], ["file", "group_id", "start_line", "end_line"]
    )
    decls = spark.createDataFrame(
        [("f", 10, 5, "var", "type", None), ("f", 11, 9, "var", "type", None), ("f", 12, 30, "var", "type", None),
         ("f", 13, 9, "type", "type", None), ("f", 14, 9, "type", "type", 7)],
        "file string, decl_id int, line int, kind string, wanted_kind string, doc_group bigint",
    )
    found = {r.decl_id: r.group_id for r in comments.attach_comments(decls, groups).collect()}
    assert found == {10: 1, 11: 3, 12: None, 13: None, 14: 7}
    near = {r.decl_id: r.group_id for r in comments.inline_comments(decls.select("file", "decl_id", "line"), groups).collect()}
    assert near == {10: 2, 11: 3, 12: None, 13: 3, 14: 3}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_carry_forward(spark, size):
    rng = random.Random(size)
    rows = [(g, i, rng.choice([None, None, None, f"{g}{i}"])) for g in "abc" for i in range(40)]
    df = spark.createDataFrame(rows, "file string, line_no int, v string").repartition(5)
    out = corpus.carry_forward(df, "file", "line_no", F.col("v"), "seen", size=size)
    got = {(r.file, r.line_no): r.seen for r in out.collect()}
    last = {}
    for g, i, v in rows:
        last[g] = v or last.get(g)
        assert got[(g, i)] == last[g]


def test_call_sites(spark):
    texts = [
        "package x", "func (g *Api) List(w http.ResponseWriter, r *http.Request) {", "  a := req.getIntParam(QueryParamLimit, 5) // the [RFC1] limit",
        '  b := req.PathParamDoc(UriParamId, "see http://x // y")', "  return response(a, RBODY201)", "}", "func plain() {", "  if check(a) {",
    ]
    df = lines(spark, texts).withColumnRenamed("decl_id", "file")
    found = [
        (r.fun, r.receiver, r.method, r.arg_name, r.second_name, r.arg_text, r.comment)
        for r in corpus.mine_call_sites(df).orderBy("line_no", "ord").collect()
    ]
    assert found == [
        ("List", "req", "getIntParam", "QueryParamLimit", "", "", "the [RFC1] limit"),
        ("List", "req", "PathParamDoc", "UriParamId", "", "see http://x // y", ""),
        ("List", "", "response", "a", "RBODY201", "", ""),
        ("plain", "", "check", "a", "", "", ""),
    ]


def test_very_long_lines_do_not_overflow(spark):
    texts = ['x("' + "a/b " * 20000 + '") // end', "y" * 100000, '"' * 30001]
    df = lines(spark, texts).withColumnRenamed("decl_id", "file")
    assert [r.method for r in corpus.mine_call_sites(df).collect()] == ["x"]
