"""ProbMinHash classes against brute force, and the estimate against the exact similarity."""

import random
from collections import defaultdict

import numpy as np
import pytest
from brute_force import brute, classes, weighted

from pactscope.llm.graph import components
from pactscope.llm.near_dedup import _between, drop_near_duplicates, near_duplicates, probability_jaccard, shingles, signatures, similarity
from pactscope.llm.queries import QUERIES


def test_estimate_and_exact_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 8, 60, 200):
        words = [f"w{i}" for i in rng.integers(0, 40, n)]
        changed = [*words, *words[: n // 3]]
        for _ in range(max(1, n // 60)):
            changed[int(rng.integers(0, n))] = "X"
        a, b = " ".join(words), " ".join(changed).upper()
        exact = brute(weighted(a), weighted(b))
        assert similarity(a, b) == pytest.approx(exact)
        owner, hashed, weight = shingles([a, b, "", "!!"])
        made = signatures(owner, hashed, weight, 4, 4_000)
        assert (made[0] == made[1]).mean() == pytest.approx(exact, abs=0.04)
        assert not made[2:].any()


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert {r.doc_id: r.class_id for r in QUERIES["op1_probminhash"](spark, sf_dir).collect()} == classes(rows)


def test_groups_and_common_passages(spark):
    draw = random.Random(3)

    def words(n):
        return [f"{draw.randrange(10**6)}" for _ in range(n)]

    base, passage = words(150), words(100)
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(0, 150, 2)]  # one large group
    sharing = [" ".join(words(25) + passage + words(25)) for _ in range(120)]  # similar by half only
    chain = words(200)
    linked = [" ".join([*words(8 * k), *chain[8 * k :]]) for k in range(4)]  # each like the next
    texts = [*near, *sharing, *linked, *[near[0]] * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = classes(list(enumerate(texts)))
    found = {r.id: (r.class_id, r.class_size) for r in near_duplicates(docs).collect()}
    assert {i: c for i, (c, _) in found.items()} == expected
    assert found[0] == (0, 125) and all(found[i] == (i, 1) for i in range(75, 195))


def test_pairs_hidden_in_a_crowd(spark):
    draw = random.Random(11)

    # texts of one passage that are at 0.75 to 0.79 to each other, and among them pairs at 0.80 to 0.84
    passage = [f"{draw.randrange(10**9)}" for _ in range(400)]
    crowd = [[*passage, *(f"{draw.randrange(10**9)}" for _ in range(57))] for _ in range(420)]
    texts = [" ".join(w) for w in crowd] + [" ".join([*w[:400], *w[400:413], *(f"{draw.randrange(10**9)}" for _ in range(44))]) for w in crowd[:60]]
    assert 0.75 < similarity(texts[60], texts[61]) < 0.8 and 0.75 < similarity(texts[0], texts[421]) < 0.8
    assert all(0.8 <= similarity(texts[k], texts[420 + k]) < 0.84 for k in range(60))
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    sets = [set(weighted(t)) for t in texts]  # no shingle occurs twice, so shared ones are counted
    expected = {i: i for i in range(len(texts))}
    for i, mine in enumerate(sets):
        for j in range(i):
            shared = len(mine & sets[j])
            if shared / (len(mine) + len(sets[j]) - shared) >= 0.8:
                expected[i] = expected[j]
    assert len(set(expected.values())) == 420
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.id: r.class_id for r in found.collect()} == expected


def test_bounds_hold_the_similarity():
    draw = random.Random(13)
    for _ in range(200):
        sets = []
        for _ in range(5):
            hashed = np.array(sorted(draw.sample(range(12), draw.randrange(1, 12))), dtype=np.uint64)
            sets.append((hashed, np.array([float(draw.randrange(1, 4)) for _ in hashed])))
        low, high = _between(sets[0], sets[1:])
        exact = [probability_jaccard(sets[0], other) for other in sets[1:]]
        assert all(a - 1e-9 <= x <= b + 1e-9 for a, x, b in zip(low, exact, high, strict=True))


def test_edges(edge_docs, no_docs):
    found = near_duplicates(edge_docs).collect()
    assert len(found) == 12
    by_id = defaultdict(set)
    for r in found:
        by_id[r.id].add((r.class_id, r.class_size))
    assert by_id[1] == by_id[2] == {(1, 3)}
    assert by_id[3] == by_id[4] == {(3, 3)} and by_id[5] == {(5, 1)} and by_id[9] == {(9, 1)}
    assert by_id[None] == {(None, 1), (3, 3)}
    kept = drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 3, 5, 6, 7, 8, 9]
    assert next(r for r in rows if r.doc_id == 3).text is None
    assert near_duplicates(no_docs).count() == 0 and drop_near_duplicates(no_docs).count() == 0


def test_components(spark):
    draw = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, draw.randrange(101, 400)) for _ in range(80)] + [(500, 500), (601, 600), (602, 601)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {i: 0 for i in range(61)} | {n: 100 for a, b in links if a == 100 for n in (a, b)} | {600: 600, 601: 600, 602: 600}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
