"""Operators that learn: toxicity, language and quality, by held-out accuracy and on edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactscope.llm.common import held_out
from pactscope.llm.language_id import LanguageModel, codewords, fit, identify_language, learn_languages, ngram_profile
from pactscope.llm.quality_bayes import score_quality
from pactscope.llm.toxicity import Lexicon, drop_toxic, fold, labelled_sample, learn_lexicon, score_toxicity

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def test_fold():
    assert fold("L0S3R,  l​oser\tЛ") == fold("loser LOSER л")
    assert fold("іdіоt ｉｄｉｏｔ") == fold("idiot idiot")
    assert fold("") == fold(" .. ") == "  "


def test_lexicon_measures():
    lexicon = Lexicon({fold("loser").strip(): 3.0, fold("trash").strip(): 2.0, fold("tras").strip(): 1.0}, frozenset({fold("trash can").strip()}), (-3.0, 1.0, 0.5))
    assert lexicon.measure("a l0ser, a LOSERS and closers") == (6.0, 2, 6)
    assert lexicon.measure("the trash can is full of trash") == (2.0, 1, 7)
    assert lexicon.measure(None) == lexicon.measure("") == (0.0, 0, 0) and lexicon.measure("!!!") == (0.0, 0, 0)
    assert lexicon.score("loser") > lexicon.score("loser " + "word " * 400) > lexicon.score("word")


def test_toxicity_held_out(spark, docs, labels):
    scored = score_toxicity(docs, learn_lexicon(docs, labels)).join(labels, "doc_id").where(held_out())
    rows = scored.select("score", "toxic").toPandas()
    order = rows["score"].rank().to_numpy()
    toxic = rows["toxic"].to_numpy() == 1
    n, m = toxic.sum(), (~toxic).sum()
    assert (order[toxic].sum() - n * (n + 1) / 2) / (n * m) > 0.75  # 38 toxic rows to learn from
    assert (rows["score"][~toxic] >= 0.3).mean() < 0.02


def test_labels_held_out_are_not_used(docs, labels):
    sample = labelled_sample(docs, labels, "toxic", 10_000, 10_000)
    assert sample.count() == labels.where(~held_out()).join(docs, "doc_id").count()
    assert labelled_sample(docs, labels, "toxic", 5, 7).groupBy("y").count().orderBy("y").collect() == [(0, 7), (1, 5)]


def test_toxicity_edges(spark, edge_docs, no_docs, docs, labels):
    lexicon = Lexicon({fold("owls").strip(): 9.0}, curve=(-3.0, 2.0, 1.0))
    scored = score_toxicity(edge_docs, lexicon)
    assert sorted(scored.columns) == sorted(edge_docs.columns)  # it has a column score, which is replaced
    rows = scored.collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.score >= 0.3} == {1, 2}
    kept = drop_toxic(edge_docs, lexicon)
    assert kept.columns == edge_docs.columns and kept.count() == 9 and {r.score for r in kept.collect()} == {"score"}
    assert drop_toxic(no_docs, lexicon).count() == 0
    nothing = learn_lexicon(docs, labels.where("false"))
    assert nothing.weights == {} and score_toxicity(edge_docs, nothing).select("score").distinct().count() == 1


def test_codewords():
    for n in (2, 4, 9):
        codes = codewords(n)
        gaps = (codes[:, None] != codes[None]).sum(axis=2)[~np.eye(n, dtype=bool)]
        assert gaps.min() >= 4 and (np.abs(codes.sum(axis=0)) < n).all()
    assert codewords(1).shape == (1, 15) and codewords(0).shape[1] == 15


def test_decoding_flags_ambiguity():
    codes = np.array([[1, 1, 1, 1], [-1, -1, -1, -1]], dtype=np.int8)
    model = LanguageModel(["a", "b"], codes, np.array([[2.0] * 4, [-2.0] * 4]), np.zeros(4), np.ones(4))
    best, score, near = model.decode(np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5001]]))
    assert best[:2].tolist() == [0, 1] and not near[:2].any() and score[0] > 0.99 and score[2] < 0.51


def test_languages_held_out(docs):
    found = identify_language(docs, learn_languages(docs)).withColumnRenamed("id", "doc_id")
    rows = found.join(docs, "doc_id").where(held_out()).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.99 * len(rows)


def test_language_edges(spark, docs, edge_docs, no_docs):
    profiles = np.stack([ngram_profile(t) for t in ("the cat and the dog", "der Hund und die Katze")] * 3)
    model = fit(profiles, ["en", "de"] * 3)
    rows = {r.id: r for r in identify_language(edge_docs, model).collect()}
    assert identify_language(edge_docs, model).count() == 12
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 9)) and rows[1].lang_pred == "en"
    assert identify_language(no_docs, model).count() == 0
    unlearnt = learn_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in identify_language(edge_docs, unlearnt).collect()} == {"und"}


def test_long_texts_are_profiled_whole():
    parts = ngram_profile("ab" * 600_000 + "z" * 600_000)
    assert np.count_nonzero(parts) == np.count_nonzero(ngram_profile("ab" * 600 + "z" * 600))


def test_quality_held_out(docs, labels):
    found = score_quality(docs, labels).withColumnRenamed("id", "doc_id").where("held_out").join(labels, "doc_id")
    rows = found.select("quality", "kept", "score").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) > 0.97 * len(rows)
    assert all(r.kept for r in rows if r.quality == 1)


def test_sparse_sites_shrink(spark):
    texts = [("fine words in a plain sentence, number %d of its kind.", 1), ("bad bad bad bad ### %d ###", 0)]
    rows, known = [], []
    for host, n, good in (("big", 400, 0.9), ("poor", 400, 0.2), ("tiny", 2, 0.0)):
        for i in range(n):
            text, y = texts[0 if i < good * n else 1]
            rows.append((len(rows), text % i, "en", host))
            known.append((len(known), y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    found = score_quality(docs, labels).withColumnRenamed("id", "doc_id").join(docs, "doc_id")
    rate = {r.source: r.r for r in found.groupBy("source").agg(F.avg("site_rate").alias("r")).collect()}
    assert rate["big"] > 0.85 and rate["poor"] < 0.25
    assert 0.03 < rate["tiny"] < rate["big"]  # none of its two documents is good, yet its rate is not 0


def test_quality_edges(edge_docs, no_docs, labels):
    rows = score_quality(edge_docs, labels.where("false")).collect()
    assert len(rows) == 12 and all(0 < r.score < 1 for r in rows) and all(r.held_out for r in rows if r.id is None)
    assert score_quality(no_docs, labels).count() == 0
