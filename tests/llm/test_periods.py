"""Periodic runs against a search that tries every period at every word."""

import time
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactscope.llm.common import read
from pactscope.llm.periods import bundles, periodic_runs, side_by_side, stretches, summarised
from pactscope.llm.queries import QUERIES, with_planted_run


def smallest(words):
    """The smallest period of a sequence."""
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute(words):
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], dtype=np.int64)
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            length = int(b - a) + q
            if length >= max(6, 4 * q) and smallest(list(w[a : a + length])) == q:
                out.append((int(a), length, q))
    return sorted((a, length, q) for a, length, q in out)


def digests(words):
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    text = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    numbers = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *numbers, sha256(text.encode()).hexdigest(), sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, sf_dir):
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    docs = read(spark, sf_dir, "documents").collect()
    assert found == {r.doc_id: digests(with_planted_run(r.doc_id, r.text)) for r in docs}
    assert sum(r[0] for r in found.values()) > 10


CASES = {
    1: "a " * 5,
    2: "a " * 6,
    3: "a b " * 4,
    4: "x " + "a b c " * 4 + "a b y",
    5: ("a " * 7 + "b ") * 9,
    6: "a " * 700,
    7: ("a b a a b " * 13 + "c ") * 5,
    8: " ".join(f"w{i % 97}" for i in range(900)),
    9: " ".join("ab"[bin(i).count("1") % 2] for i in range(600)),
    10: " ".join("ab"[int(i * 0.6180339887) % 2] for i in range(600)),
    11: "\x0b".join(["ü\xa0ü"] * 8),
    12: "a b c d " * 3 + "a b c",
}


@pytest.mark.parametrize("size", [1 << 14, 64, 16])
def test_cases_in_bundles_of_any_size(spark, size):
    rng = np.random.default_rng(size)
    cases = dict(CASES)
    for i in range(40):
        words = [str(x) for x in rng.integers(0, 2 + i % 3, rng.integers(1, 400))]
        at, p = int(rng.integers(0, len(words))), int(rng.integers(1, 40))
        cases[100 + i] = " ".join(words[: at + p] + words[at : at + p] * int(rng.integers(1, 8)) + words[at:])
    rows = spark.createDataFrame(list(cases.items()), "id long, text string").withColumn("text_key", F.unhex(F.md5("text")))
    found = {}
    for r in periodic_runs(rows, size=size).collect():
        found.setdefault(r.id, []).append((r.start, r.length, r.period))
    for key, text in cases.items():
        assert sorted(found.get(key, [])) == brute(text.encode().split()), (key, size)


def test_bundles_cover_every_boundary():
    for n in (5, 6, 100, 1000, 4096):
        for size in (16, 64):
            parts = list(bundles(n, size))
            for octave in range((n // 4).bit_length() if n >= 6 else 0):
                stride = 2 << octave
                held = [b for low, high, a, z, begin, end in parts if low <= octave < high for b in range(a, z) if b % stride == 0]
                assert sorted(held) == list(range(0, n, stride))
                for low, high, a, z, begin, end in parts:
                    if low <= octave < high:
                        assert begin % stride == 0 and begin <= max(0, a - stride)
                        assert end >= min(n, (z - 1) // stride * stride + 2 * stride)


def test_time_grows_with_length():
    def seconds(n, period):
        words = np.tile(np.arange(period), n // period + 1)[:n].astype(np.uint32)
        start = time.perf_counter()
        found = stretches(side_by_side([(0, (n // 4).bit_length(), 0, 0, n, n, words)]))
        assert found.tolist() == [[0, period, 0, n]]
        return time.perf_counter() - start

    for period in (1, 7, 1000):
        assert seconds(400_000, period) < 8 * max(0.5, seconds(100_000, period))


def test_edges(spark, edge_docs, no_docs):
    found = summarised(edge_docs).collect()
    assert len(found) == 12 and summarised(no_docs).count() == 0
    assert all(r.runs == [] and r.best is None for r in found)
    assert {r.collapsed for r in found if r.id in (3, 4, 5)} == {""}
    none = edge_docs.withColumn("text", F.lit("x x x x x x x"))
    for r in summarised(none).collect():
        assert [tuple(x) for x in r.runs] == [(0, 1, 7)] and r.collapsed == "x"
