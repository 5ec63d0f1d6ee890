import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firstlook.llm.toxicity import fit_toxicity, score_toxicity

BAD = ["vile", "rotten", "grubby"]


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of some sentences; toxic ones hold bad words in one of them."""
    random.seed(3)
    words = ["".join(random.choices("abcdeinorst", k=random.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(800):
        sentences = [[random.choice(words) for _ in range(random.randint(3, 15))] for _ in range(random.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            sentences[random.randrange(len(sentences))] += random.sample(BAD, 2)
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int").persist()


@pytest.fixture(scope="module")
def model(labelled):
    return fit_toxicity(labelled, labelled.filter("doc_id % 2 = 0").select("doc_id", "label"), steps=150)


def test_unseen_documents(labelled, model):
    rows = score_toxicity(labelled, model).join(labelled, "doc_id").filter("doc_id % 2 = 1 OR label = 0").collect()
    assert np.mean([(r.score >= 0.3) == bool(r.label) for r in rows]) > 0.97


def test_the_worst_sentence_is_found(labelled, model):
    for r in score_toxicity(labelled, model).join(labelled.filter("label = 1"), "doc_id").collect():
        assert any(w in r.text.encode()[r.worst_start : r.worst_end].decode() for w in BAD)


def test_noisy_or(spark, model):
    docs = spark.createDataFrame([(1, "You vile one"), (2, "You grubby one"), (3, "You vile one. You grubby one"), (4, "fine " * 5000)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    base = 1 / (1 + np.exp(-model.bias))
    assert 1 - got[3].score == pytest.approx((1 - got[1].score) * (1 - got[2].score) / (1 - base))
    assert got[4].score == pytest.approx(base) and got[3].n_sentences == 2


def test_odd_rows(odd_docs, odd, model, no_docs):
    got = score_toxicity(odd_docs, model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert [r.worst_start for r in got if r.n_sentences == 0] == [None] * sum(t == "" for _, t in odd)
    assert score_toxicity(no_docs, model).count() == 0


def test_one_label_only(labelled):
    clean = fit_toxicity(labelled, labelled.filter("label = 0").select("doc_id", "label"))
    assert score_toxicity(labelled, clean).filter(F.col("score") >= 0.3).count() == 0
