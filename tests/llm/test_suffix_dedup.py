"""Repeated bytes against brute force; sorting with a difference cover."""

import hashlib
import random

import numpy as np
import pytest
from brute_force import repeated_runs

from pactscope.llm.queries import QUERIES
from pactscope.llm.suffix_dedup import remove_repeats, repeated_bytes
from pactscope.llm.suffix_sort import PERIOD, difference_cover, sort_suffixes

L = 200


def check(found, texts):
    for spans, row, text in zip(repeated_runs(texts), found, texts, strict=True):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for a, b in spans:
            gone[a:b] = True
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        assert [tuple(s) for s in row.spans] == spans, row.id
        assert row.n_bytes == len(data) and row.kept_sha256 == hashlib.sha256(left).hexdigest()


def test_cover():
    cover = difference_cover()
    assert {(a - b) % PERIOD for a in cover for b in cover} == set(range(PERIOD)) and len(cover) <= 8


@pytest.mark.parametrize("seed", range(8))
def test_sort(seed):
    draw = np.random.default_rng(seed)
    n = int(draw.integers(50, 3_000))
    data = draw.integers(0, 2 if seed % 2 else 4, n).astype(np.uint8)
    if seed % 3 == 0:  # long ties
        data = np.tile(data[:40], n // 40 + 1)[:n]
    starts, buckets = draw.integers(0, n, 60), draw.integers(0, 3, 60)
    order, shared = sort_suffixes(data, starts, buckets, L)
    padded = bytes(data) + b"\0" * 600
    keys = [(buckets[i], padded[starts[i] : starts[i] + L]) for i in order]
    assert keys == sorted(keys)
    for i in range(1, 60):
        (a, one), (b, two) = keys[i - 1 : i + 1]
        assert shared[i] == (0 if a != b else next((k for k in range(L) if one[k] != two[k]), L))


def made_texts():
    draw = random.Random(7)

    def noise(n):
        return "".join(draw.choice("abcdefgh ij\nß") for _ in range(n))

    passage, short = noise(300), noise(150)
    base = noise(1_500)
    texts = [noise(100) + passage + noise(draw.randrange(90)) for _ in range(25)]
    texts += [noise(80) + short + noise(80) for _ in range(25)]  # shorter than a string: nothing goes
    texts += [base[:k] + "#" + base[k + 1 :] for k in range(50, 1_400, 90)]
    texts += ["x" * 450, "x" * 199, "x" * 200, "ab" * 300, noise(250) * 3, base, base, None, "", noise(199)]
    edge = noise(60)
    texts += [noise(45) + edge + passage[:140] for _ in range(6)]  # 200 bytes and more, ending at the end
    return texts


@pytest.mark.parametrize(("bucket", "largest"), [(4_096, 65_536), (3, 65_536), (3, 4)])
def test_buckets_of_any_size(spark, bucket, largest):
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(sorted(repeated_bytes(docs, bucket=bucket, largest=largest).collect(), key=lambda r: r.id), texts)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    found = sorted(QUERIES["op7_suffix_blocks"](spark, sf_dir).collect(), key=lambda r: r.doc_id)
    for spans, row, given in zip(repeated_runs([r.text for r in rows]), found, rows, strict=True):
        data, gone = given.text.encode(), sum(b - a for a, b in spans)
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + data[at:a], b
        kept += data[at:]
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len(data), gone, len(spans))
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_edges(edge_docs, no_docs):
    found = repeated_bytes(edge_docs).collect()
    assert len(found) == 12
    assert all([tuple(s) for s in r.spans] == [(0, r.n_bytes)] for r in found if r.id in (1, 2))
    assert not any(r.spans for r in found if r.id not in (1, 2))
    kept = remove_repeats(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == 9
    assert repeated_bytes(no_docs).count() == 0 and remove_repeats(no_docs).count() == 0


def test_cut_is_called_once(spark):
    docs = spark.createDataFrame([(1, "a" * 500), (2, "b")], "doc_id long, text string")
    assert remove_repeats(docs)._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_cut_characters(spark):
    repeated = "é" * 120
    docs = spark.createDataFrame([(1, "a" + repeated + "ö", 0), (2, "b" + repeated + "z", 0), (3, "fine", 4)], "doc_id long, text string, n_chars int")
    rows = {r.doc_id: (r.text, r.n_chars) for r in remove_repeats(docs).collect()}
    # the first byte of the last letter ends one more repeated string, so its second byte is left alone and goes
    assert rows == {1: ("a", 1), 2: ("bz", 2), 3: ("fine", 4)}
