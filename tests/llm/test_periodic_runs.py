import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from firstlook.llm import periodic_runs as pr
from firstlook.llm.queries import repeats_of_words

from .conftest import SCHEMA, odd_rows, words

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def plain_runs(w: list, min_length: int = 24) -> list[tuple]:
    """For each period, stretches that no neighbour extends; of stretches found twice, the smaller period."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain(doc_id, text) -> tuple:
    w = words(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def strange_lists() -> list[list]:
    random.seed(3)
    fibonacci = ["b", "a"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(300))
    lists = [[], ["a"], list("a" * 23), list("a" * 24), list("ab" * 12), list("ab" * 12 + "a"), list("abc" * 8), list("abcdefgh" * 3), list("abcdefghi" * 3)[:-1]]
    lists += [list(fibonacci[-1]), list(thue), list(fibonacci[-1] * 3), list("a" * 30 + "b" + "a" * 30), list("aab" * 20 + "ab" * 20), list("a" * 300 + "ba" * 90)]
    for _ in range(60):
        one = random.choices("abc"[: random.randint(1, 3)], k=random.randint(1, 12))
        lists.append(random.choices("ab", k=5) + one * random.randint(3, 12) + one[: random.randint(0, len(one))] + random.choices("abc", k=random.randint(0, 50)) + one * 4)
    return lists + [random.choices("ab", k=random.randint(20, 200)) for _ in range(40)]


def runs_of_lists(lists: list[list], min_length: int = 24) -> list[list[tuple]]:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    prints = np.array([ord(c) for x in lists for c in x], np.uint64)
    start, end, period = pr.runs_of(prints, bounds, min_length)
    out = [[] for _ in lists]
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        doc = int(np.searchsorted(bounds, s, "right")) - 1
        out[doc].append((s - int(bounds[doc]), e - s, q))
    return out


@pytest.mark.parametrize("grid", [1 << 18, 7])
@pytest.mark.parametrize("min_length", [24, 3])
def test_runs_of_strange_words(monkeypatch, grid, min_length):
    monkeypatch.setattr(pr, "GRID", grid)
    lists = strange_lists()
    assert runs_of_lists(lists, min_length) == [plain_runs(x, min_length) for x in lists]


def test_grammar_gives_its_words_back_and_extensions():
    random.seed(5)
    docs = [random.choices("ab", k=200), list("a" * 100), list("abcabcab" * 30), ["x"]]
    symbol, place = [], []
    for k, doc in enumerate(docs):
        symbol.append(k)
        place += [(len(symbol), len(symbol) + len(doc))]
        symbol += [ord(c) for c in doc]
    symbol = np.array([*symbol, len(docs)])
    levels = pr.grammar(symbol, len(docs) + 1)
    assert len(levels[-1].symbol) == 2 * len(docs) + 1  # one symbol for each document
    assert all(len(level.symbol) > len(after.symbol) for level, after in zip(levels, levels[1:]))
    pairs = [(i, j) for s, e in place for _ in range(400) for i, j in [sorted(random.choices(range(s, e), k=2))] if i < j]
    a, b = np.array(pairs).T
    forward, last = pr.extension(levels, a, b), len(symbol) - 1
    back = pr.extension([level.mirrored() for level in levels], last - a, last - b)
    for (i, j), f, r in zip(pairs, forward, back):
        assert symbol[i : i + f].tolist() == symbol[j : j + f].tolist() and symbol[i + f] != symbol[j + f]
        assert symbol[i - r + 1 : i + 1].tolist() == symbol[j - r + 1 : j + 1].tolist() and symbol[i - r] != symbol[j - r]


def test_query_equals_a_plain_search(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    rows += [(5000 + k, " ".join(x)) for k, x in enumerate(strange_lists())]
    rows += [(7000 + k, " \t".join(f"w{i % (k + 2)}" for i in range(9 * k)) + "\n") for k in range(20)]
    rows = [r for r in rows if len(words(r[1] or "")) < 5000]
    docs = spark.createDataFrame([(i, t, *["k"] * 9) for i, t in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in repeats_of_words(pr.with_repeated_tails(docs)).select(*COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted((plain(*r) for r in rows), key=repr)


def test_no_rows_and_a_long_text(spark, no_docs):
    assert pr.periodic_runs(no_docs).collect() == []
    text = "a b " * 60_000 + "c " + "d" * 300_000 + " e" * 50
    row = pr.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 120_000, 2), (120_002, 50, 1)]
    assert row.kept == "a b c " + "d" * 300_000 + " e" and row.n_words == 120_052
