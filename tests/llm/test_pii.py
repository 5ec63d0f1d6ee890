import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from firstlook.llm import pii
from firstlook.llm.queries import op6_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(0, *m.span()) for m in EMAIL.finditer(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return found + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1.@-2 +3()é4", max_size=60))
def test_patterns(text):
    assert pii.rule_spans(text) == plain(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_runs_take_no_longer():
    text = "a" * 200_000 + " " + "1" * 200_000 + "@"
    assert pii.rule_spans(text) == []


@pytest.fixture(scope="module")
def private(spark):
    random.seed(5)
    number = lambda k: "".join(random.choices("0123456789", k=k))
    makers = [
        lambda: f"{random.choice('abcd')}.{number(2)}@mail{number(1)}.example.org", lambda: ".".join(str(random.randint(0, 255)) for _ in range(4)),
        lambda: next(n for n in iter(lambda: number(16), None) if pii.luhn(n)), lambda: f"+1 ({number(3)}) 555-{number(4)}",
        lambda: "token " + "".join(random.choices("0123456789abcdef", k=40)), lambda: number(3),
    ]
    rows = []
    for i in range(300):
        words = ["".join(random.choices("abcdeinorst", k=random.randint(2, 8))) for _ in range(60)]
        for _ in range(3):
            words.insert(random.randrange(len(words)), random.choice(makers)())
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").persist()


@pytest.fixture(scope="module")
def tagger(private):
    return pii.fit_tagger(private.filter("doc_id < 200"))


def test_tagger_finds_labelled_spans_in_unseen_texts(private, tagger):
    hit = total = wrong = 0
    for r in private.filter("doc_id >= 200").collect():
        want, got = set(pii.rule_spans(r.text)), set()
        for start in pii._window_starts(r.text, tagger.size):
            codes = np.full((1, tagger.size), 4)
            own = pii._classes(r.text[start : start + tagger.size])
            codes[0, : len(own)] = own
            got |= {(k, a + start, b + start) for k, a, b, p in tagger.decode(codes)[0] if p > 0.5}
        hit, total, wrong = hit + len(want & got), total + len(want), wrong + len(got - want)
    assert hit > 0.75 * total and wrong < 0.2 * total


def test_gradients():
    random_ = np.random.default_rng(0)
    tagger = pii.Tagger.fresh(3, 4, 9)
    codes, tags = random_.integers(0, pii.N_CLASSES, (3, 9)), np.zeros((3, 9), int)
    tags[0, 2:4], tags[1, 5:8] = (1, 2), (5, 6, 6)

    def loss():
        scores, _ = tagger._scores(codes)
        _, _, total = tagger._sums(scores)
        between, first = tagger._transitions()
        value = 0.0
        for i in range(3):
            value += first[tags[i, 0]] + sum(scores[t, i, tags[i, t]] for t in range(9)) + sum(between[tags[i, t], tags[i, t + 1]] for t in range(8))
        return -(value - total.sum()) / 3

    for param, gradient in zip(tagger.params, tagger.gradients(codes, tags)):
        at = np.unravel_index(np.abs(gradient).argmax(), param.shape)
        was = param[at]
        param[at] = was + 1e-5
        up = loss()
        param[at] = was - 1e-5
        down = loss()
        param[at] = was
        assert gradient[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_reconciled():
    rules = [(2, 10, 20)]
    tagged = [(0, 5, 11, 0.99), (3, 30, 40, 0.95), (3, 32, 44, 0.97), (1, 50, 60, 0.9), (1, 50, 60, 0.9), (2, 60, 70, 0.9)]
    assert pii.reconciled(rules, tagged) == [(1, 50, 60, False), (2, 10, 20, True), (2, 60, 70, False), (3, 32, 44, False)]


def test_odd_rows(odd_docs, odd, tagger, no_docs):
    got = pii.pii_spans(odd_docs, tagger).collect()
    key = lambda x: (str(x[0]), x[1])
    rules = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.by_rule]) for r in got]
    assert sorted(rules, key=key) == sorted(((i, plain(t)) for i, t in odd), key=key)
    clean = {r.text for r in pii.redact(odd_docs, None).collect()}
    assert "write [EMAIL] or [EMAIL]@d.e, [PHONE]; 10.0.0.300 [IP].[IP] 4111 1111-1111 1111 4111111111111112" in clean
    assert pii.redact(odd_docs, tagger).filter("block = 'b'").count() == len(odd)
    assert pii.pii_spans(no_docs, None).count() == 0 and pii.fit_tagger(no_docs) is None


def test_redacted():
    assert pii.redacted("abcdefgh", [(1, 3), (2, 5), (6, 7)], ["X", "Y", "Z"]) == "a[X]f[Z]h"


def test_query_counts_each_kind(spark, tmp_path):
    parts = ["a@b.org", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-2030"]
    texts = [f" {sep} ".join(parts[k] for k in kinds) for kinds in ([], [0], [1], [3], [2, 0], [0, 0, 1], [3, 1, 1], [0, 1, 2, 3], [1, 1, 1, 1, 0]) for sep in ("und", ";")]
    rows = [(k, t) for k, t in enumerate([*texts, None])] + [(None, texts[-1]), (3, texts[2])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        spans = plain(t or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want.append((str(i), *[sum(s[0] == k for s in spans) for k in range(4)], hashlib.sha256(listed.encode()).hexdigest()))
    columns = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert sorted((str(r.doc_id), *[r[c] for c in columns]) for r in op6_pii(spark, str(tmp_path)).collect()) == sorted(want)
