import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firstlook.llm.quality_classifier import N_KINDS, estimated_prior, features, fit_quality, score_quality
from firstlook.llm.words import texts_of


@pytest.fixture(scope="module")
def mixture(spark):
    """700 documents, a fifth of them junk of three sorts; a third of the good ones are trusted."""
    random.seed(1)
    words = ["".join(random.choices("abcdeinorst", k=random.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(700):
        text = [random.choice(words) for _ in range(random.randint(30, 200))]
        if i % 5 == 0:
            text = [[w.upper() + "!!" for w in text], [w + random.choice(["$$$", "###"]) for w in text], [text[0]] * len(text)][i % 3]
        rows.append((i, " ".join(text) + ".", i % 5 != 0))
    return spark.createDataFrame(rows, "doc_id long, text string, good boolean").persist()


def test_junk_scores_low(mixture):
    trusted = mixture.filter("good AND doc_id % 3 = 0")
    model = fit_quality(mixture, trusted, mixture.join(trusted, "doc_id", "left_anti"))
    assert 0.55 < model.prior < 0.85  # 373 of 513
    rows = score_quality(mixture, model).collect()
    assert np.mean([(r.score >= 0.5) == r.good for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_prior_from_tails():
    random = np.random.default_rng(0)
    positive, mixed = random.normal(2, 1, 5000), np.concatenate([random.normal(2, 1, 3500), random.normal(-2, 1, 1500)])
    assert estimated_prior(positive, mixed) == pytest.approx(0.7, abs=0.05)


def test_features_by_hand():
    (texts,) = texts_of(pa.array(["aB aB\n\naB aB!", "", None]))
    x = features(texts)
    assert x[0, 0] == pytest.approx((4 / 13) ** 0.5) and x[0, 1] == pytest.approx((4 / 13) ** 0.5)  # small and capital letters
    assert x[0, N_KINDS] == pytest.approx(np.log(5))  # words
    assert not x[1].any() and not x[2].any()


def test_odd_rows(odd_docs, odd, mixture, no_docs):
    model = fit_quality(mixture, mixture.filter("good"), mixture.filter("doc_id < 50"), steps=20)
    got = score_quality(odd_docs, model).collect()  # odd_docs has a column score of its own
    assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.block == "b" for r in got)
    assert score_quality(no_docs, model).count() == 0


def test_nothing_to_learn_from(mixture):
    model = fit_quality(mixture, mixture.filter(F.lit(False)), mixture)
    assert score_quality(mixture, model).filter("score <> 0.5").count() == 0
