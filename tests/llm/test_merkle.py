"""The Merkle manifest against a tree built level by level."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pactscope.llm.merkle import folded, merkle_manifest, row_digest


def digest(text):
    return sha256(text.encode()).hexdigest()


def tree(nodes):
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def path(levels, i):
    steps = []
    for level in levels[:-1]:
        other = i ^ 1
        steps.append(("<" if other < i else ">") + level[other] if other < len(level) else "")
        i >>= 1
    return steps


def brute(rows):
    """``rows`` of group, key, leaf: their subroots, root and proofs."""
    groups = {}
    for group, key, leaf in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: tree([leaf for *_, leaf in sorted(groups[g])]) for g in names}
    above = tree([below[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (_, _, leaf) in enumerate(sorted(groups[g])):
            out.append((leaf, below[g][-1][0], above[-1][0], tuple(path(below[g], i) + path(above, at))))
    return sorted(out)


@pytest.mark.parametrize(("levels", "rows"), [(2, 100), (1, 33), (3, 64), (12, 50), (2, 1), (2, 4), (2, 5), (2, 17)])
def test_proofs(spark, levels, rows):
    # every group but the first is small; some keys are missing or repeated
    data = [(None if i % 11 == 3 else f"g{max(0, i % 7 - 4)}", None if i % 13 == 5 else i // 2 * 3 % 40, digest(str(i // 2))) for i in range(rows)]
    docs = spark.createDataFrame(data, "name string, pos long, leaf string").repartition(3)
    found = merkle_manifest(docs, "name", ["pos"], levels=levels)
    assert found.columns == ["name", "pos", "leaf", "subroot", "root", "proof"]
    got = found.withColumn("folded", folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.folded == r.root for r in got)
    assert sorted((r.leaf, r.subroot, r.root, tuple(r.proof)) for r in got) == brute(data)
    assert sorted((r.name or "", r.pos or 0, r.leaf) for r in got) == sorted((n or "", p or 0, d) for n, p, d in data)


def test_row_digest(spark):
    row = spark.createDataFrame([(1, "ü", None, "")], "a long, b string, c string, d string")
    assert row.select(row_digest("a", "b", "c", "d")).first()[0] == digest("1:12:ü-0:")


def test_edges(spark, edge_docs, no_docs):
    leaves = edge_docs.withColumn("leaf", row_digest("doc_id", "source", "lang", "text"))
    found = merkle_manifest(leaves, "lang", ["doc_id"], levels=2)
    rows = found.withColumn("folded", folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(rows) == 12 and all(r.folded == r.root and r.key == "key" for r in rows)
    assert len({r.root for r in rows}) == 1 and len({r.subroot for r in rows}) == 3
    changed = found.withColumn("folded", folded(F.sha2(F.col("leaf").cast("binary"), 256), F.col("proof")))
    assert changed.where("folded = root").count() == 0
    assert merkle_manifest(no_docs.withColumn("leaf", F.lit("x")), "lang", ["doc_id"]).count() == 0
