import hashlib
import json
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from pactscope.operators import examples, graph, types
from pactscope.plans.queries import QUERIES
from pactscope.sources import catalogue, corpus, documents
from pactscope.sources import examples as example_files


@pytest.fixture()
def tree(tmp_path):
    for name, text in {
        "a/x.go": "// first\npackage x\n\n  //second\r\nfunc f() {\n}\n",
        "b/y.go": "\n".join(f"// line {i}" for i in range(500)),
        "b/z.txt": "// not this",
        "b/empty.go": "",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text, newline="")
    return tmp_path


@pytest.mark.parametrize("whole_bytes", [1 << 20, 0, 100])
def test_read_lines(spark, tree, whole_bytes):
    """Lines are numbered alike whether files are read whole or in splits."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = corpus.read_lines(spark, str(tree), "*.go", whole_bytes)
        found = {(r.file.rsplit("/", 1)[1], r.line_no): r.text for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {n: t for (f, n), t in found.items() if f == "y.go"} == {i: f"// line {i}" for i in range(500)}
    assert [found[("x.go", i)] for i in range(6)] == ["// first", "package x", "", "  //second", "func f() {", "}"]
    assert len(found) == 506


def test_read_corpus(spark, tree):
    found = [(r.line_no, r.text) for r in corpus.read_corpus(spark, str(tree / "a")).orderBy("line_no").collect()]
    assert found == [(0, "first"), (3, "second")]


def test_read_examples(spark, tmp_path):
    records = [
        {"type": "m.Email", "key": "e1", "title": "", "scope": "", "origin": "rfc", "example": {"id": "a", "n": [1, {"x": None}]}},
        {"type": "Url", "key": "e2", "title": "T", "scope": "request", "example": "text"},
    ]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "apidoc-examples.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "other.json").write_text("[]")
    found = {r.key: r for r in example_files.read_examples(spark, str(tmp_path)).collect()}
    assert (found["e1"].title, found["e1"].scope) == ("An Email", "any")
    assert found["e1"].origin.endswith("apidoc-examples.json:rfc")
    assert json.loads(found["e1"].payload) == records[0]["example"]
    assert (found["e2"].title, found["e2"].scope, json.loads(found["e2"].payload)) == ("T", "request", "text")


def test_catalogue(spark, tmp_path, rows_of):
    endpoints = spark.createDataFrame([("s1", "1", "GET", "/", "f", 1), ("s2", "1", "PUT", "/a", "g", 2)], catalogue.schema_of("endpoints"))
    catalogue.write_catalogue({"endpoints": endpoints}, str(tmp_path))
    read = catalogue.read_catalogue(spark, str(tmp_path))
    assert rows_of(read["endpoints"]) == rows_of(endpoints)
    assert read["endpoints"].schema == endpoints.schema
    assert read["types"].isEmpty()
    plan = read["endpoints"].where("service = 's1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(service" in plan


def test_documents(spark, tmp_path):
    parts = spark.createDataFrame(
        [
            ("s", "1", ["info"], '{"title":"T"}'),
            ("s", "1", ["paths", "/a~b", "put"], '{"operationId":"g"}'),
            ("s", "1", ["paths", "/a~b", "get"], '{"operationId":"f"}'),
            ("s", "1", ["paths", "/a~b", "get", "tags", "y"], '"y"'),
            ("s", "1", ["paths", "/a~b", "get", "tags", "x"], '"x"'),
            ("s", "1", ["paths", "/a~b", "get", "parameters", "query.q"], '{"name":"q"}'),
            ("s", "1", ["paths", "/a~b", "get", "responses", "200"], '{"description":"d \\"q\\""}'),
            ("s", "1", ["components", "schemas", "m.T"], '{"type":"object"}'),
            ("big", "1", ["info"], '{"title":"' + "x" * 300 + '"}'),
        ],
        "service string, version string, steps array<string>, fragment string",
    )
    found = {(r.service, r.section, r.item): r.document for r in documents.assemble_documents(parts).collect()}
    assert {k: json.loads(d) for k, d in found.items() if k[0] == "s"} == {
        ("s", "info", None): {"title": "T"},
        ("s", "paths", "/a~b"): {
            "get": {"operationId": "f", "tags": ["x", "y"], "parameters": [{"name": "q"}], "responses": {"200": {"description": 'd "q"'}}},
            "put": {"operationId": "g"},
        },
        ("s", "components", "schemas/m.T"): {"type": "object"},
    }
    item = found["s", "paths", "/a~b"]
    assert item.index('"get"') < item.index('"put"')
    assert len(found["big", "info", None]) > 300


def test_written_documents(spark, tmp_path):
    rows = []
    for service, paths in (("s/1+ %2B", 3), ("big", 400), ("one", 0)):
        rows += [(service, ["info"], '{"title":"T"}'), (service, ["openapi"], '"3.0.4"')]
        for i in range(paths):
            path = ["paths", f"/a~{i}"]
            for verb in ("put", "get")[: 1 + i % 2]:
                rows.append((service, [*path, verb], "{}" if i % 3 else '{"operationId":"f",\n "deep":{"x":[1]}}'))
                rows.append((service, [*path, verb, "responses", "200"], '{"description":"d \\"q\\""}'))
                rows += [(service, [*path, verb, "tags", t], f'"{t}"') for t in ("x", "y")[: i % 3]]
                rows += [(service, [*path, verb, "parameters", "p"], '{"name":"tags","in":"query"}')]
            rows.append((service, ["components", "schemas", f"tags{i}"], '{"type":"object"}'))
            rows.append((service, ["components", "examples", f"tags{i}"], '[1]'))
        rows.append((service, ["tags", "all"], '{"name":"all"}'))
    parts = spark.createDataFrame([(s, "1", p, f) for s, p, f in rows], "service string, version string, steps array<string>, fragment string")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        documents.write_documents(parts.repartition(5), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    lines = documents.read_document_lines(spark, str(tmp_path / "out")).orderBy("service", "line_no").collect()
    assert len(lines) == len(rows)
    texts = {}
    for r in lines:
        texts[r.service] = texts.get(r.service, "") + r.text
    expected = {}
    for service, steps, fragment in sorted(rows, key=lambda r: (r[0], r[1])):
        at = expected.setdefault(service, {})
        for i, step in enumerate(steps[:-1]):
            if isinstance(at, list):
                break
            lists = step in ("tags", "parameters") and (i == 0 or i == 3)
            at = at.setdefault(step, [] if lists else {})
        if isinstance(at, list):
            at.append(json.loads(fragment))
        else:
            at[steps[-1]] = json.loads(fragment)
    assert {s: json.loads(t) for s, t in texts.items()} == expected
    found = json.loads(texts["big"])
    assert list(found) == ["openapi", "info", "tags", "paths", "components"]
    assert list(found["paths"]["/a~1"]) == ["get", "put"] and list(found["paths"]) == sorted(found["paths"])
    # the large one is spread over several files
    assert len(list((tmp_path / "out").glob("service=big/version=1/part-*"))) > 3


def test_parts_are_made_once_before_they_are_dealt(spark, monkeypatch):
    plans, write = [], documents.materialise

    def recorded(df):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return write(df)

    monkeypatch.setattr(documents, "materialise", recorded)
    parts = spark.createDataFrame([("s", "v1", ["info"], "{}")], "service string, version string, steps array<string>, fragment string")
    assert [r.text for r in documents.document_lines(parts).collect()] == ['{"info":{}}']
    assert "RepartitionByExpression" not in plans[0] and "RepartitionByExpression" in plans[1]


def test_schemas_are_made_once(spark):
    known = spark.createDataFrame([("A", "struct", "", ""), ("B", "struct", "", "")], "type_key string, kind string, summary string, description string")
    fields = spark.createDataFrame([("A", 1, "b", True, "{}"), ("A", 0, "a", None, "x"), ("A", 2, "c", True, None), ("B", 0, "d", True, None)], "type_key string, pos int, attr string, required boolean, s string")
    found = types.type_schemas(known, fields.withColumn("schema", F.from_json("s", "map<string,string>").cast("string")))
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "from_json" in x]
    made = {r.type_key: r.schema for r in types.type_schemas(known, fields.withColumnRenamed("s", "schema")).collect()}
    assert made == {"A": '{"type":"object","properties":{"a":x,"b":{}},"required":["b"]}', "B": '{"type":"object","properties":{}}'}


def test_digests_show_changes(spark, tmp_path):
    schema = catalogue.schema_of("tag_defs")
    rows = [("s1", "1", "a", "text", None), ("s1", "1", "b", "", ""), ("s2", "1", "a", None, "x"), ("s2", "1", "a", None, "x")]
    given = {"tag_defs": spark.createDataFrame(rows, schema)}
    catalogue.write_catalogue(given, str(tmp_path / "a"))
    assert catalogue.changed_tables(spark, str(tmp_path / "a")).count() == 0

    def changed(other):
        folder = str(tmp_path / f"b{len(list(tmp_path.iterdir()))}")
        catalogue.write_catalogue(given, folder)
        df = spark.createDataFrame(other, schema)
        df.write.mode("overwrite").partitionBy("service").parquet(f"{folder}/tag_defs")
        return {(r.service, r.n_written, r.n_now) for r in catalogue.changed_tables(spark, folder).collect()}

    assert changed(rows[::-1]) == set()
    assert changed(rows[:3]) == {("s2", 2, 1)}
    assert changed([*rows[:1], ("s1", "1", "b", "", None), *rows[2:]]) == {("s1", 2, 2)}
    assert changed([(s, v, n, None, d) for s, v, n, _, d in rows]) == {("s1", 2, 2)}
    assert changed(rows[:2]) == {("s2", 2, None)}


def test_spanning_calls_over_stretches(spark):
    lines = [
        "req.open(", "func (g *Api) First(w int) {", '  a := req.parse(  // note', '    Name, inner("x) (", deep(',
        "", "    1)), (2)", "  )", "} )", "func (g *Api) Second(w int) {", "  if (x) { lost( one(A), two(B)", "func (g *Api) Third() {", "  done(C)",
    ]
    df = spark.createDataFrame([(f, i, t) for f in ("f", "g") for i, t in enumerate(lines)], "file string, line_no long, text string")
    expected = {
        ("First", 2, 6, 1, "req", "parse", "Name", "x) ("), ("First", 3, 5, 2, "", "inner", "", "x) ("),
        ("First", 3, 5, 3, "", "deep", "", ""), ("Second", 9, 9, 2, "", "one", "A", ""), ("Second", 9, 9, 2, "", "two", "B", ""),
        ("Third", 11, 11, 1, "", "done", "C", ""),
    }
    for size in (1, 2, 3, 1 << 17):
        found = corpus.mine_spanning_calls(df, size).where("file = 'f'").collect()
        assert {(r.fun, r.line_no, r.end_line, r.level, r.receiver, r.method, r.arg_name, r.arg_text) for r in found} == expected
        assert len(found) == len(expected) and next(r.comment for r in found if r.method == "parse") == "note"


def test_schemas(spark):
    struct = "type_key string, kind string, target_key string, summary string, description string"
    all_types = spark.createDataFrame(
        [("m.T", "struct", None, "a type", "with text"), ("m.U", "struct", None, "", ""), ("m.A", "alias", "[]m.U", "", "")], struct
    )
    fields = spark.createDataFrame(
        [
            ("m.T", 0, "S", "s", "string", 'say "hi"', True, "x", True, True),
            ("m.T", 1, "N", "n", "[]uint", "", None, "7", True, True),
            ("m.T", 2, "A", "a", "map[string]m.A", "", False, "", True, True),
            ("m.T", 3, "H", "h", "m.U", "", True, "", False, True),
            ("m.T", 4, "E", "e", "m.E", "", None, "", True, True),
            ("m.T", 5, "X", "x", "error", "", None, "", True, True),
            ("m.T", 6, "F", "f", "float64", "", None, "", True, True),
            ("m.U", 0, "T", "t", "m.T", "", None, "", True, True),
        ],
        "type_key string, pos int, name string, attr string, field_type_key string, summary string, required boolean, "
        "default_value string, in_request boolean, in_response boolean",
    )
    enums = spark.createDataFrame([("m.E", "B", "b"), ("m.E", "A", "a")], ["type_key", "name", "value"])
    aliases = graph.resolve_aliases(all_types)

    def schema_of(scope):
        rows = types.schema_properties(fields, all_types, enums, aliases, scope)
        found = types.type_schemas(all_types, rows).collect()
        return {r.type_key: json.loads(r.schema) for r in found}, {r.attr for r in rows.where("problem is not null").collect()}

    response, problems = schema_of("response")
    ref = {"$ref": "#/components/schemas/m.U"}
    assert problems == {"f"}
    assert response["m.T"] == {
        "type": "object", "description": "a type\nwith text", "required": ["s", "h"],
        "properties": {
            "s": {"type": "string", "description": 'say "hi"', "default": "x"},
            "n": {"type": "array", "items": {"type": "integer", "minimum": 0, "default": 7}},
            "a": {"type": "object", "additionalProperties": {"type": "array", "items": ref}},
            "h": ref,
            "e": {"type": "string", "enum": ["a", "b"]},
        },
    }
    request, _ = schema_of("request")
    assert "h" not in request["m.T"]["properties"]
    assert request["m.U"]["properties"] == {"t": {"$ref": "#/components/schemas/m.T.forRequests"}}
    variants = {(r.type_key, r.schema_key) for r in types.scope_variants(fields).collect()}
    assert variants == {("m.T", "m.T"), ("m.T", "m.T.forRequests"), ("m.U", "m.U")}
    edges = {(r.from_key, r.to_key) for r in types.type_edges(all_types.withColumn("element_key", F.lit(None).cast("string")), fields).collect()}
    assert edges == {("m.T", "m.A"), ("m.T", "m.U"), ("m.T", "m.E"), ("m.T", "float64"), ("m.U", "m.T"), ("m.A", "m.U")}


def test_examples(spark):
    given = spark.createDataFrame(
        [(1, "m.T", "a", "any", "{}"), (2, "m.T", "a", "request", '{"r":1}'), (3, "m.U", "b", "any", "{"), (4, "m.V", "c", "request", "1"), (5, "m.T", "d", "any", "2")],
        "ord int, type_key string, key string, scope string, payload string",
    )
    assert {r.key for r in examples.examples_for(given, "request").collect()} == {"a", "b", "c"}
    assert [r.key for r in examples.invalid_examples(given).collect()] == ["b"]
    overrides = {r.key: (r.response_payload, r.request_payload, r.problem) for r in examples.request_example_overrides(given).collect()}
    assert overrides == {"a": ("{}", '{"r":1}', None), "b": ("{", "{", None), "c": (None, "1", "no default example"), "d": ("2", "2", None)}
    used = spark.createDataFrame(
        [(1, "[]m.T", None), (2, "map[string]m.U", ""), (3, "m.T", None), (4, "m.X", "m.U"), (5, "m.X", "m.Y"), (6, "[]m.X", None), (7, None, None)],
        "n int, type_key string, example_key string",
    )
    matched = examples.match_examples(used, given)
    assert {r.n: (r.example_set, r.ref_prefix, r.problem) for r in matched.collect()} == {
        1: ("m.T", "[]", None), 2: ("m.U", "map[string]", None), 3: ("m.T", "", None), 4: ("m.U", "", None),
        5: (None, None, "unknown example key"), 6: (None, None, "no example"), 7: (None, None, None),
    }
    assert {(r.key, r.payload) for r in examples.wrap_examples_as_array(given, matched).collect()} == {("[]a", "[{}]"), ("[]d", "[2]")}
    assert {(r.key, r.payload) for r in examples.wrap_examples_as_map(given, matched).collect()} == {("map[string]b", '{"key":{}')}


def _number_of(row):
    text = "\u001f".join("~" if v is None else str(v) for v in row)
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_digests_are_sums_of_integers(spark):
    """No decimal is added per row, and sums beyond a bigint are exact."""
    rows = [(("s1", None)[i % 3 == 0], "1", f"t{i}", "a" if i % 2 else None, "") for i in range(300)] * 2
    found = catalogue.table_digests({"tag_defs": spark.createDataFrame(rows, catalogue.schema_of("tag_defs"))})
    expected = {s: str(sum(_number_of(r) for r in rows if r[0] == s)) for s in ("s1", None)}
    assert int(expected["s1"]) > 1 << 63
    assert {r.service: r.digest for r in found.collect()} == expected
    partial = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "partial_sum" in x]
    assert partial and not any("decimal" in x.split("functions=")[1] for x in partial)


def test_tables_are_written_side_by_side(spark, tmp_path, monkeypatch, rows_of):
    given = {
        "tag_defs": spark.createDataFrame([("s1", "1", "a", "text", None), (None, "1", "b", "", "")], catalogue.schema_of("tag_defs")),
        "enums": spark.createDataFrame([("s1", "1", "A", "b", "c")], catalogue.schema_of("enums")),
    }
    both, parquet = threading.Barrier(2, timeout=60), DataFrameWriter.parquet

    def together(self, path, *args, **kwargs):
        if not path.endswith(catalogue.MANIFEST):
            both.wait()
        return parquet(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", together)
    catalogue.write_catalogue(given, str(tmp_path))
    read = catalogue.read_catalogue(spark, str(tmp_path))
    for table, df in given.items():
        assert {*map(tuple, read[table].collect())} == {*map(tuple, df.collect())}
    assert catalogue.changed_tables(spark, str(tmp_path)).count() == 0


def test_failed_table_leaves_no_digests(spark, tmp_path):
    given = {
        "tag_defs": spark.createDataFrame([("s1", "1", "a", "text", None)], catalogue.schema_of("tag_defs")),
        "enums": spark.range(1).select(*[F.raise_error(F.lit("no rows")).cast("string").alias(c) for c in catalogue.schema_of("enums").fieldNames()]),
    }
    with pytest.raises(PySparkException, match="no rows"):
        catalogue.write_catalogue(given, str(tmp_path))
    assert not (tmp_path / catalogue.MANIFEST).exists()


def test_object_types_are_joined_once(spark, tmp_path, monkeypatch):
    given = {}
    monkeypatch.setattr(catalogue, "write_catalogue", lambda tables, folder: given.update(tables))
    for name, row in {
        "events": "1L event_id, 2L user_id, 'view' event_type, '{}' props",
        "part": "1L p_partkey, 'n' p_name, 'B#1' p_brand, 'STEEL' p_type, 20 p_size",
        "orders": "1L o_orderkey, 2L o_custkey",
        "documents": "1L doc_id, 'a' text",
        "nation": "1L n_nationkey, 'N' n_name, 0L n_regionkey",
        "region": "0L r_regionkey, 'ASIA' r_name",
    }.items():
        spark.sql(f"SELECT {row}").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert QUERIES["catalogue_tables"](spark, str(tmp_path)).count() == 0
    plan = given["object_types"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert [(r["var"], r["foo"]) for r in given["object_types"].collect()] == [("V1", "m.T1")]
