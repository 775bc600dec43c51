"""Queries on data in which one service, one handler and one document hold a third of all rows."""

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from pactscope.plans.adapters import BASE_TABLES

SF_DIR = "/root/testdata/sf0.001"
HOT = {
    # a third of the events belong to one user, and most of those to one handler
    "events": """SELECT CASE WHEN event_id % 3 = 0 THEN event_id * 50 + 7 ELSE event_id * 50 + event_id % 50 END AS event_id, ts,
      CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id, event_type, value, props FROM events""",
    # one document has a third of all lines
    "documents": """SELECT doc_id, CASE WHEN doc_id = 5 THEN (SELECT string_agg(text, chr(10) ORDER BY doc_id) FROM (SELECT * FROM documents WHERE doc_id < 60)) ELSE text END AS text,
      lang, source, n_chars FROM documents""",
    # one part is on a third of all lines
    "lineitem": "SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey, * EXCLUDE (l_orderkey, l_partkey) FROM lineitem",
}
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}
NAMES = (
    "effective_responses operation_responses match_examples resolve_params endpoint_tags summarize_blocks summarize_endpoints "
    "mine_call_sites mine_directives collapse_bodies error_payload_examples reachable_types coverage_report property_examples "
    "group_routes_by_path undocumented"
).split()


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    for table in BASE_TABLES:
        target = folder / f"{table}.parquet"
        if table in HOT:
            connection.execute(f"COPY ({HOT[table]}) TO '{target}' (FORMAT parquet)")
        else:
            os.symlink(f"{SF_DIR}/{table}.parquet", target)
    connection.close()
    reference = duckdb.connect()
    for table in BASE_TABLES:
        reference.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield str(folder), reference
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
    reference.close()


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, skewed, name):
    folder, reference = skewed
    result = reference.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    expected = sorted(repr([row[i] for i in order]) for row in result.fetchall())
    df = queries()[name](spark, folder)
    assert sorted(repr([row[c] for c in sorted(df.columns)]) for row in df.collect()) == expected
    assert expected
