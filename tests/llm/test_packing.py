"""Token ids as the tokenizer gives them, and best-fit packing over counts."""

import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pactscope.llm.packing import best_fit, pack_documents, sequences
from pactscope.llm.queries import QUERIES, tokenizer_path
from pactscope.llm.tokens import WordTokenizer

TRICKY = [
    "don't you're I'll we've 's'sa ''s x'd’s", "ΑΣ ΑΣΣ Σ", "a\x1cb\x85c\xa0d e　f", "<|endoftext|>x y<|startoftext|>", "１２３ ½ ² Ⅷ",
    "éa ẛ̣", "İstanbul", "", None, "!!??''ll 'LL 'Ve", "emoji 😀😀 zwj 👩‍👩‍👧", "नमस्ते दुनिया", "\x00\x01 \x7f", "a_b__c 3.14 x'", "'",
]


@pytest.fixture(scope="module")
def tokenizer():
    return WordTokenizer(tokenizer_path())


def expected(tokenizer, text):
    return tokenizer.whole.encode(text or "", add_special_tokens=False).ids


def test_tricky_texts(tokenizer):
    for text, ids in zip(TRICKY, tokenizer.encode(TRICKY), strict=True):
        assert ids.tolist() == expected(tokenizer, text), text


def test_kept_words_take_little_memory():
    tokenizer, n = WordTokenizer(tokenizer_path()), 60_000
    texts = [" ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(a, a + 1_000)) for a in range(0, n, 1_000)]
    tokenizer.encode(["a"])
    tracemalloc.start()
    try:
        for text in texts:
            tokenizer.encode([text])
        assert tracemalloc.get_traced_memory()[0] < 64 * n
    finally:
        tracemalloc.stop()


def test_code_points_that_are_not_assigned_here(tokenizer):
    texts = [":\U00013460", "a\U00013460b \U000323B0", "\u0378x"]
    for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
        assert ids.tolist() == expected(tokenizer, text), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(tokenizer, texts):
    for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
        assert ids.tolist() == expected(tokenizer, text)


def one_by_one(histogram, limit):
    """Best-fit decreasing over single pieces."""
    rooms = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(limit - length)
    return len(rooms)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=30))
def test_best_fit_places_all(histogram):
    places, count = best_fit(histogram, 64)
    used, placed = {}, {}
    for i, p in enumerate(places):
        last = min((q.rank for q in places if q.length == p.length and q.rank > p.rank), default=histogram[p.length])
        for rank in range(p.rank, last):
            nth = rank - p.rank
            sequence, offset = p.first + nth // p.per_bin, p.offset + nth % p.per_bin * p.length
            placed[p.length] = placed.get(p.length, 0) + 1
            used.setdefault(sequence, []).append((offset, p.length))
    assert placed == {x: n for x, n in histogram.items() if n}
    assert len(used) == count
    for pieces in used.values():
        pieces.sort()
        ends = np.cumsum([n for _, n in pieces])
        assert [o for o, _ in pieces] == [0, *ends[:-1]] and ends[-1] <= 64
    assert count == one_by_one(histogram, 64)


def law(rows, tokenizer, docs):
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        ends = np.cumsum([n for _, n in own])
        assert [o for o, _ in own] == [0, *ends[:-1]] and ends[-1] <= 4096
    for doc_id, text in docs:
        ids = np.array([*expected(tokenizer, text), 1], dtype="<u4")
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in own] == list(enumerate(range(0, len(ids), 4096)))
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + 4096].tobytes()) for r in own)
        assert sum(r.length for r in own) == len(ids)
    return len(places), sum(r.length for r in rows)


def test_query(spark, sf_dir, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    count, total = law(QUERIES["op6_best_fit"](spark, sf_dir).collect(), tokenizer, docs)
    assert count <= -(-total // 4096) + 1


def test_edges(spark, edge_docs, no_docs, tokenizer):
    packed = pack_documents(edge_docs, tokenizer_path(), with_ids=True)
    rows = packed.collect()
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert sum(r.length for r in rows) == sum(len(expected(tokenizer, t)) + 1 for _, t in docs)
    assert sorted(r.length for r in rows if r.id in (3, 4, 5)) == [1, 1, 1]
    assert sum(r.id == 1 and r.piece == 0 for r in rows) == 2 and any(r.id is None for r in rows)
    whole = [i for r in sequences(packed).collect() for i in r.ids]
    assert sorted(whole) == sorted(i for r in rows for i in r.ids) and whole.count(1) >= len(docs)
    assert pack_documents(no_docs, tokenizer_path()).count() == 0
