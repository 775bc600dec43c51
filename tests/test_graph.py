import random
import time

import pytest
from pyspark.sql import functions as F

from pactscope.operators import graph, routes


def edges_of(spark, pairs):
    return spark.createDataFrame([(s, a, b) for s, a, b in pairs], "service string, from_key string, to_key string")


def closure(pairs, starts):
    seen, todo = dict.fromkeys(starts, 0), list(starts)
    while todo:
        node = todo.pop(0)
        for s, a, b in pairs:
            if (s, a) == node and (s, b) not in seen:
                seen[(s, b)] = seen[node] + 1
                todo.append((s, b))
    return seen


def random_graph(seed, n, m):
    rng = random.Random(seed)
    return [(rng.choice("xy"), f"t{rng.randrange(n)}", f"t{rng.randrange(n)}") for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable_types(spark, seed):
    pairs = random_graph(seed, 30, 50)
    starts = [("x", "t1"), ("y", "t2"), ("x", "t1")]
    seeds = spark.createDataFrame(starts, ["service", "type_key"])
    found = graph.reachable_types(seeds, edges_of(spark, pairs), ["service"])
    assert {(r.service, r.type_key): r.round for r in found.collect()} == closure(pairs, starts)


def test_reachable_types_limit(spark):
    chain = edges_of(spark, [("x", f"t{i}", f"t{i + 1}") for i in range(19)])
    seeds = spark.createDataFrame([("x", "t1")], ["service", "type_key"])
    assert graph.reachable_types(seeds, chain, ["service"]).count() == 19
    assert graph.too_deep(graph.reachable_types(seeds, chain, ["service"])).count() == 0
    longer = graph.reachable_types(spark.createDataFrame([("x", "t0"), ("y", "t0")], ["service", "type_key"]), chain, ["service"])
    assert longer.count() == 21  # another service's depth holds up nothing
    assert [tuple(r) for r in graph.too_deep(longer).select("service", "type_key").collect()] == [("x", "t19")]


@pytest.mark.parametrize("seed, n, m", [(3, 25, 30), (4, 40, 45), (5, 20, 60), (6, 10, 0)])
def test_recursive_types(spark, seed, n, m):
    pairs = random_graph(seed, n, m)
    expected = {
        (s, a)
        for s, a, _ in pairs
        if any((s, a) in closure(pairs, [(s2, b2)]) for s2, a2, b2 in pairs if (s2, a2) == (s, a))
    }
    found = graph.recursive_types(edges_of(spark, pairs), ["service"])
    assert {(r.service, r.type_key) for r in found.collect()} == expected


def plans_of(monkeypatch):
    """The plans of all rounds, as they ran."""
    plans, write = [], graph.materialise

    def recorded(df):
        written = write(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written

    monkeypatch.setattr(graph, "materialise", recorded)
    return plans


def test_rounds_of_reachable_types_send_nothing_to_the_driver(spark, monkeypatch):
    plans = plans_of(monkeypatch)
    chain = edges_of(spark, [("x", f"t{i}", f"t{i + 1}") for i in range(4)])
    seeds = spark.createDataFrame([("x", "t0")], ["service", "type_key"])
    assert graph.reachable_types(seeds, chain, ["service"]).count() == 5
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_recursive_types_over_long_ways(spark):
    n = 100_000
    chain = [("x", i, i + 1) for i in range(n)] + [("x", n, n - 3)]
    ring = [("y", i, (i + 1) % 5000) for i in range(5000)]
    # a ladder whose rungs lead back every thousand nodes, with chains between and tails that lead nowhere
    back = [("z", i, i + 1) for i in range(9_000)] + [("z", 3000, 1000), ("z", 8000, 5500), ("z", 2000, 20_000), ("z", 20_000, 2_500)]
    edges = spark.createDataFrame(chain + ring + back, "service string, from_key long, to_key long").repartition(8)
    start = time.perf_counter()
    found = {(r.service, r.type_key) for r in graph.recursive_types(edges, ["service"]).collect()}
    expected = {("x", i) for i in range(n - 3, n + 1)} | {("y", i) for i in range(5000)}
    expected |= {("z", i) for i in (*range(1000, 3001), *range(5500, 8001), 20_000)}
    assert found == expected
    assert time.perf_counter() - start < 120


@pytest.mark.parametrize("seed", range(6))
def test_recursive_types_of_mixed_shapes(spark, seed):
    rng = random.Random(seed)
    pairs = []
    for service in "xy":
        for _ in range(rng.randrange(3, 9)):  # chains
            at = rng.randrange(60)
            for _ in range(rng.randrange(1, 12)):
                to = rng.randrange(60) if rng.random() < 0.3 else at + 100
                pairs.append((service, f"t{at}", f"t{to}"))
                at = to
        pairs += [(service, f"t{rng.randrange(60)}", f"t{rng.randrange(60)}") for _ in range(seed * 8)]
    ahead = {}
    for s, a, b in pairs:
        ahead.setdefault((s, a), set()).add((s, b))

    def reached(node):
        seen, todo = set(), [node]
        while todo:
            for other in ahead.get(todo.pop(), ()):
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        return seen

    found = graph.recursive_types(edges_of(spark, pairs), ["service"])
    assert {(r.service, r.type_key) for r in found.collect()} == {n for n in ahead if n in reached(n)}


def test_flatten_embedded(spark):
    embeds = spark.createDataFrame([("A", 1, "B"), ("B", 0, "C"), ("A", 2, "C")], "type_key string, pos int, embedded_key string")
    fields = spark.createDataFrame(
        [("A", 0, "a0"), ("A", 3, "a3"), ("B", 1, "b1"), ("C", 0, "c0"), ("C", 1, "c1")], "type_key string, pos int, name string"
    )
    found = graph.flatten_embedded(embeds, fields).orderBy("type_key", "place").collect()
    names = {}
    for r in found:
        names.setdefault(r.type_key, []).append(r.name)
    assert names == {"A": ["a0", "c0", "c1", "b1", "c0", "c1", "a3"], "B": ["c0", "c1", "b1"], "C": ["c0", "c1"]}


def test_flatten_embedded_limit(spark):
    def chain(n):
        embeds = [(f"T{i}", 0, f"T{i + 1}") for i in range(n)]
        return spark.createDataFrame(embeds, "type_key string, pos int, embedded_key string")

    fields = spark.createDataFrame([("T0", 1, "x")], "type_key string, pos int, name string")
    assert graph.flatten_embedded(chain(10), fields).count() == 1
    assert graph.deep_embeds(chain(10)).count() == 0
    deep = chain(11).unionByName(spark.createDataFrame([("A", 0, "B"), ("B", 0, "A"), ("C", 0, "T11")], fields.schema).toDF("type_key", "pos", "embedded_key"))
    more = fields.unionByName(spark.createDataFrame([("T11", 0, "y"), ("A", 1, "z")], fields.schema))
    assert {r.type_key for r in graph.deep_embeds(deep).collect()} == {"T0", "A", "B"}
    found = {(r.type_key, r.name) for r in graph.flatten_embedded(deep, more).collect()}
    assert found == {("T11", "y"), ("C", "y"), *((f"T{i}", "y") for i in range(1, 11))}


def test_rounds_of_deep_embeds_send_nothing_to_the_driver(spark, monkeypatch):
    plans = plans_of(monkeypatch)
    pairs = [("x", f"T{i}", f"T{i + 1}") for i in range(11)] + [("x", "A", "T0"), ("x", "A", "T1"), ("y", "B", "T0"), (None, "T11", "T0")]
    embeds = spark.createDataFrame([*pairs, ("x", "C", None), ("x", None, "T0")], "service string, type_key string, embedded_key string")
    found = graph.deep_embeds(embeds, ["service"]).collect()
    assert {tuple(r) for r in found} == {("x", "A"), ("x", "T0")}
    assert {tuple(r) for r in graph.deep_embeds(embeds, ["service"], 0).collect()} == {
        *(("x", a) for _, a, _ in pairs[:12]), ("x", "C"), ("y", "B")
    }
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_resolve_aliases(spark):
    types = spark.createDataFrame(
        [("A", "alias", "[]B"), ("B", "alias", "map[string]C"), ("C", "alias", "D"), ("D", "struct", None), ("E", "alias", "string"), ("F", "alias", "Z")],
        "type_key string, kind string, target_key string",
    )
    found = {r.type_key: (r.target_key, r.resolved) for r in graph.resolve_aliases(types).collect()}
    assert found == {
        "A": ("[]map[string]D", True), "B": ("map[string]D", True), "C": ("D", True), "E": ("string", True), "F": ("Z", False),
    }
    circle = spark.createDataFrame([("A", "alias", "B"), ("B", "alias", "A")], types.schema)
    both = types.withColumn("service", F.lit("good")).unionByName(circle.withColumn("service", F.lit("bad")))
    found = {(r.service, r.type_key): (r.target_key, r.resolved) for r in graph.resolve_aliases(both, ["service"]).collect()}
    assert found["bad", "A"] == found["bad", "B"] == (None, False)
    assert found["good", "A"] == ("[]map[string]D", True) and len(found) == 7


def test_flatten_routes(spark):
    rng = random.Random(7)
    prefixes = ["a", "/a", "a/", "/a/", "/", ""]
    nodes, paths = [], {}
    for i in range(60):
        parent = rng.randrange(i) if i and rng.random() < 0.9 else None
        prefix = rng.choice(prefixes)
        base = paths[parent] if parent is not None else "/"
        joined = base.removesuffix("/") + "/" + prefix.removeprefix("/")
        paths[i] = joined.removesuffix("/") or "/"
        nodes.append((i, parent, prefix))
    df = spark.createDataFrame(nodes, "node int, parent int, prefix string")
    assert {r.node: r.path for r in routes.flatten_routes(df).collect()} == paths
    circle = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], df.schema)
    long = [(i, i - 1 if i else None, "x") for i in range(200)]
    mixed = (
        df.withColumn("service", F.lit("good"))
        .unionByName(circle.unionByName(spark.createDataFrame([(3, 1, "c"), (4, None, "d")], df.schema)).withColumn("service", F.lit("bad")))
        .unionByName(spark.createDataFrame(long, df.schema).withColumn("service", F.lit("long")))
    )
    found = {(r.service, r.node): r.path for r in routes.flatten_routes(mixed, ["service"]).collect()}
    assert {n: p for (s, n), p in found.items() if s == "good"} == paths
    assert {n: p for (s, n), p in found.items() if s == "bad"} == {1: None, 2: None, 3: None, 4: "/d"}
    assert found["long", 199] == "/x" * 200
