"""The operators made of built-in functions, against reference SQL and on edge cases."""

import time

import pytest
from pyspark.sql import functions as F

from pactscope.llm.decontamination import benchmark_hits, contamination, remove_contamination
from pactscope.llm.line_quality import clean_documents, line_verdicts
from pactscope.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, reference, sf_dir, name):
    result = reference.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    expected = sorted(repr([row[i] for i in order]) for row in result.fetchall())
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert sorted(repr([row[c] for c in columns]) for row in df.collect()) == expected


@pytest.mark.parametrize("name", ["op4_line_frequency", "op9_decontamination"])
def test_no_python_in_the_plan(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "Seven wise owls watch from a tall oak tree, and nobody in the village"),
        (2, "the lazy dog"),
        (3, None),
        (4, ""),
        (None, "quick brown fox jumps over the lazy dog while seven wise"),
        (5, "  the LAZY--dog "),
        (6, "owls never tell anybody about THEIR plans"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contamination(edge_docs, items):
    found = contamination(edge_docs, items).collect()
    assert len(found) == 12
    prose = [r for r in found if r.id in (1, 2)]
    assert len(prose) == 3
    for row in prose:
        # "the lazy dog" 6-8, "seven ... village" 10-23, "owls never ... plans" at the end
        # and the item without an id: "quick ... wise" 1-11
        assert row.hit == [*range(1, 24), *range(row.n_words - 7, row.n_words)]
        assert row["items"] == ["1", "2", "5", "6"]
    assert all(r.hit == [] and r["items"] == [] for r in found if r.id not in (1, 2))
    assert {r.id: r.n_words for r in found if r.id in (3, 4, 5, 6, 9)} == {3: 0, 4: 0, 5: 0, 6: 1, 9: 0}
    assert next(r for r in found if r.id == 7).n_words == 60_000


def test_contamination_of_nothing(edge_docs, no_docs, items):
    assert contamination(no_docs, items).count() == 0
    none = items.where("false")
    assert contamination(edge_docs, none).where("size(hit) > 0").count() == 0


def test_remove_contamination(edge_docs, items):
    left = remove_contamination(edge_docs.withColumn("n_chars", F.length("text")), items)
    assert left.columns == [*edge_docs.columns, "n_chars"]
    rows = left.collect()
    assert len(rows) == 12
    prose = next(r for r in rows if r.doc_id == 2)
    assert prose.text == (
        "the  knows why they came or when they will leave again because "
    )
    assert prose.n_chars == len(prose.text) and prose.key == "key"
    dropped = remove_contamination(edge_docs, items, drop_documents=True)
    assert dropped.count() == 9 and dropped.columns == edge_docs.columns
    only = edge_docs.where("doc_id = 6").selectExpr("doc_id", "'the lazy dog!' AS text")
    assert remove_contamination(only, items).count() == 0


def test_one_scan_for_all_lengths(spark, edge_docs):
    rows = [(i, " ".join(f"w{j}" for j in range(i))) for i in range(1, 13)]
    plan = contamination(edge_docs.limit(5), spark.createDataFrame(rows, "item_id long, text string"))
    assert plan.count() == 5
    docs = spark.createDataFrame([(1, "x w0 w1 w2 y w0"), (2, " ".join(f"w{j}" for j in range(12)))], "doc_id long, text string")
    hits = benchmark_hits(docs, spark.createDataFrame(rows, "item_id long, text string"))
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
    found = {r.id: r for r in contamination(docs, spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert found[1].hit == [1, 2, 3, 5] and found[1]["items"] == ["1", "2", "3"]
    assert found[2].hit == list(range(12)) and len(found[2]["items"]) == 12


def test_removal_is_linear(spark):
    def seconds(n):
        words = [f"a{i}" if i % 50 else "bad phrase here" for i in range(n)]
        docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
        items = spark.createDataFrame([(1, "bad phrase here")], "item_id long, text string")
        start = time.perf_counter()
        left = remove_contamination(docs, items).first().text
        assert left.count("a") == n - n // 50 and "bad" not in left
        return time.perf_counter() - start

    seconds(100)
    small = seconds(20_000)
    assert small < 10 and seconds(80_000) < 5 * max(small, 2)


def test_line_verdicts(spark, edge_docs, no_docs):
    found = {(r.id, r.host): r for r in line_verdicts(edge_docs).collect()}
    assert found[1, "a"].kept and found[7, "b"].kept
    assert all(found[k].base_failed and not found[k].kept for k in ((3, "a"), (4, "b"), (5, "b"), (6, "b"), (None, "")))
    assert found[7, "b"].n_words == 60_000
    assert line_verdicts(no_docs).count() == 0


def test_frequent_lines(spark):
    body = "a line of its own with number {} and enough other words to make a document out of it all {}"
    rows = [(i, "Home | Contact\n" + body.format(i, "abcdefghijklm"[i]), "x") for i in range(13)]
    copies = [(100 + i, "the very same text in many copies, which counts once for each host and line so it is kept here", "x") for i in range(30)]
    shells = [(200 + i, "HOME |  contact\nhome | Contact\nhome | contact \nalone", "x") for i in range(2)]
    other = [(300, "Home | Contact\n" + body.format(1, "z"), "y")]
    docs = spark.createDataFrame(rows + copies + shells + other, "doc_id long, text string, source string")
    found = {r.id: r for r in line_verdicts(docs, min_words=5).collect()}
    assert all(found[i].kept for i in (*range(100, 130), 300))
    # digits are folded, so the bodies differ by their letter only
    assert all(found[i].left_words == found[i].n_words - 3 and found[i].kept for i in range(13))
    assert all(not found[200 + i].kept and not found[200 + i].base_failed for i in range(2))
    cleaned = {r.doc_id: r.text for r in clean_documents(docs, min_words=5).collect()}
    assert set(cleaned) == {*range(13), *range(100, 130), 300}
    assert cleaned[0].startswith("a line") and cleaned[300].startswith("Home")


def test_repeated_words(spark):
    words = [f"w{i}" for i in range(40)]
    cases = {
        1: " ".join(words),
        2: " ".join(words + words[:8]),
        3: " ".join(["x"] * 20),
        4: " ".join(words[:9] + words[1:9]),
        5: " ".join(words[:7] * 2),
    }
    docs = spark.createDataFrame(list(cases.items()), "doc_id long, text string").selectExpr("*", "'s' AS source")
    got = {r.id: r.n_repeat_words for r in line_verdicts(docs).collect()}
    for key, text in cases.items():
        w = text.split()
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
        assert got[key] == len(covered), key
