"""The pipeline against a brute-force version of its stages."""

import re
import zlib

import numpy as np
from brute_force import classes, repeated_runs

import corpus_pipeline
from pactscope.llm.queries import tokenizer_path
from pactscope.llm.tokens import WordTokenizer
from pactscope.llm.toxicity import learn_lexicon

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def without_benchmark(text, items):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    places = [m.span() for m in WORD.finditer(lowered)]
    words = [lowered[a:b] for a, b in places]
    hit = set()
    for item in items:
        n = min(10, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if item else set()
        for i in range(len(words) - n + 1):
            if windows and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
    if not hit:
        return text
    out, at = [], 0
    for i in sorted(hit):
        out.append(text[at : places[i][0]] if i - 1 not in hit else "")
        at = places[i][1]
    left = "".join(out) + text[at:]
    return left if len(hit) < len(words) else None


def brute(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if lexicon.score(r.text) < 0.3]
    first = classes(rows)
    rows = [(i, t) for i, t in rows if first[i] == i]
    left = []
    for (i, text), runs in zip(rows, repeated_runs([t for _, t in rows]), strict=True):
        data = text.encode()
        for a, b in reversed(runs):
            data = data[:a] + data[b:]
        text = data.decode("utf-8", "ignore")
        if not runs or re.sub(r"(?a)\s", "", text):
            left.append((i, text))
    items = []
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        items.append(WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)))
    return [(i, t) for i, t in ((i, without_benchmark(t, items)) for i, t in left) if t is not None]


def test_run_equals_brute_force(spark, sf_dir):
    rows = brute(spark, sf_dir)
    encode = WordTokenizer(tokenizer_path()).whole.encode
    expected = []
    for i, text in rows:
        ids = np.array([*encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        for n, start in enumerate(range(0, len(ids), 4096)):
            piece = ids[start : start + 4096]
            expected.append((i, n, start, len(piece), zlib.crc32(piece.tobytes())))
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    assert len({r.sequence_id for r in found}) <= -(-sum(e[3] for e in expected) // 4096) + 1


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(40), sf_dir).schema.names == docs.columns


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
