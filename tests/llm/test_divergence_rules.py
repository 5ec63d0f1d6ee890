import random
from collections import Counter

import numpy as np
import pytest

from firstlook.llm.divergence_rules import distance, quality_rules

from .conftest import words


def plain(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, t in enumerate(zip(w, w[1:], w[2:])) if windows[t] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed


def test_counts(odd_docs, odd):
    got = quality_rules(odd_docs).collect()
    assert Counter((r.doc_id, *list(r)[1:7]) for r in got) == Counter((i, *plain(t)) for i, t in odd)
    assert not any(r.kept and r.base_failed for r in got)


def test_lines(spark):
    texts = ["a b\na b\n\n a b\na b", "x\nx", "\n\n", "x\n x\nx\n", "a\r\na\r\na"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert [r.n_dup_lines for r in quality_rules(docs).orderBy("doc_id").collect()] == [plain(t)[3] for t in texts] == [2, 1, 0, 1, 1]


def test_distance():
    a = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]])
    assert distance(a, np.array([1.0, 0.0])) == pytest.approx([0, 0.5579, 1], abs=1e-4)


def test_junk_goes_and_clean_text_stays(spark):
    random.seed(4)
    langs = {
        "en": ["".join(random.choices("abcdeinorst", k=random.randint(2, 7))) for _ in range(300)],
        "el": ["".join(random.choices("αβγδεικλνοπρστ", k=random.randint(2, 7))) for _ in range(300)], None: [f"z{k}" for k in range(300)],
    }
    rows = []
    for i in range(240):
        lang = ["en", "el", None][i % 3]
        text = [langs[lang][int(300 * random.random() ** 6)] for _ in range(200)]
        if i % 8 == 0:
            text = [[w + "$$%" for w in text], [w.upper() + "!!" for w in text], langs["el" if lang == "en" else "en"][:200]][i // 24 % 3]
        rows.append((i, " ".join(text), lang, i % 8 == 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, junk boolean")
    got = quality_rules(docs).join(docs.select("doc_id", "junk"), "doc_id").collect()
    assert np.mean([r.kept != r.junk for r in got if not r.base_failed]) > 0.95


def test_no_rows(no_docs):
    assert quality_rules(no_docs).count() == 0
