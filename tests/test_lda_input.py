"""The input of the LDA fits, and the two fits of lda_weighted."""

from threading import Barrier

import pytest
from pyspark.ml.feature import CountVectorizer

from trendspark.operators import bow, ml
from trendspark.plans import q_ml
from trendspark.sources.tables import table

DOCS = 60


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, "common " + " ".join(f"{a}{b}" for a in "abcde"[:1 + i % 5] for b in "qvz"[:1 + i % 3]), "en", "web") for i in range(DOCS - 1)]
    spark.createDataFrame(rows + [(DOCS, "lonely words", "en", "web")], "doc_id long, text string, lang string, source string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_lda_vocabulary_is_that_of_a_share_without_holding_all_tokens(spark, folder):
    feats, model = q_ml._lda_input(spark, folder)
    assert model.getMaxDF() == 0.95 * DOCS  # a share below 1 has the fit hold all tokens in memory
    tokens = table(spark, folder, "documents").selectExpr("doc_id", "split(text, ' ') AS tokens")
    share = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=5000, minDF=2.0, maxDF=0.95).fit(tokens)
    assert set(model.vocabulary) == set(share.vocabulary) - set(bow.english_stops())
    assert "common" not in model.vocabulary and "lonely" not in model.vocabulary and "aq" not in model.vocabulary and "bq" in model.vocabulary
    assert feats.count() == DOCS


def test_lda_weighted_fits_both_models_at_a_time(spark, folder, monkeypatch):
    both, fit = Barrier(2, timeout=60), ml.lda_fit

    def short_fit(features, k, _):
        both.wait()  # breaks unless the other fit is at it too
        return fit(features, k, 1)

    monkeypatch.setattr(ml, "lda_fit", short_fit)
    r = q_ml.lda_weighted(spark, folder).first()
    assert 0 < r["plain_confidence"] <= 1 and 0 < r["weighted_confidence"] <= 1
