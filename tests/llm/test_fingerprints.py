"""SimHash fingerprints and the search by block tables, against brute force."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactscope.llm.common import read
from pactscope.llm.fingerprints import BITS, edited_fingerprints, fingerprints, likeness, within_radius
from pactscope.llm.queries import QUERIES


def test_query_equals_brute_force(spark, sf_dir):
    found = {r.doc_id: r for r in QUERIES["op13_simhash"](spark, sf_dir).collect()}
    docs = {r.doc_id: r.text or "" for r in read(spark, sf_dir, "documents").collect()}
    ids = sorted(docs, reverse=True)
    assert set(found) == set(ids)
    bits = np.unpackbits(fingerprints([docs[i] for i in ids]), axis=1)
    closer = 0
    for k, i in enumerate(ids):
        text, following = docs[i], docs[ids[(k + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        row, voted = found[i], np.unpackbits(fingerprints([edited])[0])
        assert (row.n_chars, row.edited_sha256) == (len(text), sha256(edited.encode()).hexdigest())
        assert row.fingerprint == np.packbits(bits[k]).tobytes().hex()
        assert row.edited_fingerprint == np.packbits(voted).tobytes().hex()
        differ = [int((bits[k] != other).sum()) for other in (voted, bits[(k + 1) % len(ids)])]
        expected = [max(0.0, float(np.cos(d * np.pi / BITS))) for d in differ]
        assert [row.near_edited, row.near_next] == pytest.approx(expected)
        closer += row.near_edited > row.near_next
        near = int(((bits != bits[k]).sum(axis=1) <= 7).sum()) - 1
        assert row.n_near == (near if i % 20 == 0 else None)
    assert closer >= 0.98 * len(ids)


def test_edges(spark, edge_docs, no_docs):
    found = edited_fingerprints(edge_docs).collect()
    assert len(found) == 12 and edited_fingerprints(no_docs).count() == 0
    zero = bytes(BITS // 8)
    by_id = {r.id: r for r in found}
    assert all(by_id[i].fingerprint == zero and by_id[i].n_chars == 0 for i in (3, 4))
    first, second = (r for r in found if r.id == 1)
    assert first.fingerprint == second.fingerprint == by_id[2].fingerprint != zero
    assert by_id[6].n_chars == 4 and by_id[6].fingerprint != zero
    # the next of 9 is 8, and the rows without an id come last
    text, following = "!!! ??? ...", "ß İ ΑΣ 日本語のテキスト 😀 \x00 end"
    assert by_id[9].edited_sha256 == sha256((text[:6] + following[:5]).encode()).hexdigest()
    assert by_id[9].following == by_id[8].fingerprint
    one = edited_fingerprints(edge_docs.where("doc_id = 6")).first()
    assert one.following == one.fingerprint and one.edited_sha256 == sha256(b"wowo").hexdigest()


def test_order_over_many_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        found = {r.id: r.edited_sha256 for r in edited_fingerprints(docs.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for i in range(3000):
        text, following = f"text number {i}", f"text number {(i - 1) % 3000}"
        half = len(text) // 2
        assert found[i] == sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()


@pytest.mark.parametrize(("radius", "blocks"), [(7, 8), (1, 2), (2, 4), (0, 1)])
def test_search_finds_all(spark, radius, blocks):
    draw = np.random.default_rng(radius)
    base = draw.integers(0, 256, (20, BITS // 8), dtype=np.uint8)
    rows = {b.tobytes() for b in base}
    for b in base:
        for _ in range(15):
            flipped = np.unpackbits(b)
            flipped[draw.choice(BITS, draw.integers(0, 12), replace=False)] ^= 1
            rows.add(np.packbits(flipped).tobytes())
    rows = sorted(rows)
    members = spark.createDataFrame([(bytearray(r),) for r in rows], "fingerprint binary")
    asked = members.where(F.substring(F.hex("fingerprint"), 1, 1) < "8")
    found = [(bytes(r.query), bytes(r.member), r.distance) for r in within_radius(members, asked, radius, blocks).collect()]
    bits = {r: np.unpackbits(np.frombuffer(r, dtype=np.uint8)) for r in rows}
    expected = [
        (a, b, d) for a in rows if a[0] < 128 for b in rows if (d := int((bits[a] != bits[b]).sum())) <= radius
    ]
    assert sorted(found) == sorted(expected)


def test_likeness(spark):
    rows = [(bytearray(32), bytearray(32)), (bytearray(32), bytearray([255] * 32)), (bytearray(32), bytearray([15] * 32))]
    found = [r[0] for r in spark.createDataFrame(rows, "a binary, b binary").select(likeness("a", "b")).collect()]
    assert found == pytest.approx([1.0, 0.0, 0.0], abs=1e-12)
