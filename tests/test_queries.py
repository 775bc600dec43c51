"""Every registered query against its reference SQL, at the smallest scale."""

import json
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from pactscope.plans.adapters import BASE_TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def reference():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, reference, name):
    result = reference.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    expected = sorted(repr([row[i] for i in order]) for row in result.fetchall())
    df = queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert sorted(repr([row[c] for c in columns]) for row in df.collect()) == expected
    assert expected or name in ("unparsable_releases",)


def test_documents_are_json(spark):
    found = queries()["contract_documents"](spark, SF_DIR).collect()
    parts = queries()["document_parts"](spark, SF_DIR).collect()
    assert {r.service for r in found} == {r.service for r in parts}
    read = {}
    for r in found:
        section = read.setdefault(r.service, {})
        if r.item is None:
            section[r.section] = json.loads(r.document)
            continue
        place = section.setdefault(r.section, {})
        *kind, item = r.item.split("/", 1) if r.section in ("components", "x-undocumented") else [r.item]
        place = place.setdefault(kind[0], {}) if kind else place
        place[item] = json.loads(r.document)
    for part in parts:
        place = read[part.service]
        steps = [s.replace("~1", "/").replace("~0", "~") for s in part.pointer[1:].split("/")]
        listed = None
        for step in steps:
            if isinstance(place, list):
                listed = place
                break
            place = place[step]
        own = json.loads(part.fragment)
        if listed is not None:
            assert own in listed
        elif isinstance(own, dict):
            assert own.items() <= place.items()


def test_all_references_resolve(spark):
    found = queries()["document_references"](spark, SF_DIR).collect()
    assert found and all(r.n_dangling == 0 < r.n_references for r in found)


def test_parts_read_lineitem_no_more(spark):
    """Fields and types of services, which are made of lineitem, are kept; sections read what is kept."""
    plan = queries()["document_parts"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan


def test_entry(spark):
    df = entry(spark)
    assert "summary" in df.columns and df.count() > 0
