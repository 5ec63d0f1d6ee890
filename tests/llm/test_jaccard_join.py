from collections import Counter

import pytest

from firstlook.llm.components import components
from firstlook.llm.jaccard_join import jaccard_components, jaccard_links, without_near_copies

from .conftest import lower, words


def plain(rows, size, percent):
    """(id, size of the set, smallest id reachable) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        ids = smallest.setdefault(root(k), [])
        if i is not None:
            ids.append(i)
    return Counter((i, len(sets[k]), min(smallest[root(k)], default=None) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("size, percent, block_bytes", [(5, 80, 1 << 20), (5, 80, 4_000), (2, 40, 1 << 20)])
def test_equal_to_comparing_all_pairs(odd_docs, odd, size, percent, block_bytes):
    got = Counter(tuple(r) for r in jaccard_components(odd_docs, size, percent, block_bytes=block_bytes).collect())
    assert got == plain(odd, size, percent)


def test_chains_without_a_centre(spark):
    """Each text is near its neighbours in the chain alone, and all share a passage with texts that are near none."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([f"w{j}" for j in range(3 * k, 3 * k + 60)])) for k in range(30)]
    rows += [(100 + k, " ".join([f"x{k}_{j}" for j in range(20)] + base[:30])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard_components(docs).collect()) == plain(rows, 5, 80)


def link_counts(rows, size, percent):
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    near = lambda s, o: s and o and 100 * len(s & o) >= percent * len(s | o)
    return [sum(bool(near(s, o)) for o in sets) - bool(s) for s in sets]


@pytest.mark.parametrize("size, percent", [(5, 80), (2, 40)])
def test_all_links(odd_docs, odd, size, percent):
    got = jaccard_links(odd_docs, size, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(odd, size, percent)
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((i, n) for (i, _), n in zip(odd, link_counts(odd, size, percent)))


def test_all_links_inside_a_group_of_near_copies(spark):
    """Each text is the same one with one word or two changed: most pairs are similar, and all are in one component."""
    rows = []
    for k in range(24):
        w = [f"w{j}" for j in range(100)]
        w[4 * k] = f"x{k}"
        if k % 3 == 0:
            w[99 - 4 * k] = f"y{k}"
        rows.append((k, " ".join(w)))
    rows += [(100, rows[0][1]), (101, rows[0][1])]
    got = {r.doc_id: r.n_links for r in jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: n for (i, _), n in zip(rows, link_counts(rows, 5, 80))}
    assert got == want and sum(want.values()) > 6 * len(rows)


def test_rows_that_stay(odd_docs, odd):
    got = [(r.doc_id, r.text or "") for r in without_near_copies(odd_docs).collect()]
    assert len(got) == len(set(got))
    assert all(r.key == "k" for r in without_near_copies(odd_docs).collect())
    members = {}
    for r in jaccard_components(odd_docs).collect():
        members.setdefault(r.component_id, set()).add(r.doc_id)
    with_words = [g for g in got if words(g[1])]
    assert all(i in members[i] for i, _ in with_words)
    assert len(with_words) == sum(plain_groups(odd))


def plain_groups(rows):
    """One for each component of rows with words."""
    sets, seen = [], []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    for s in filter(None, sets):
        near = [g for g in seen if any(100 * len(s & o) >= 80 * len(s | o) for o in g)]
        seen = [g for g in seen if g not in near] + [[s] + [o for g in near for o in g]]
    return [1] * len(seen)


def test_no_rows(no_docs):
    assert jaccard_components(no_docs).count() == 0 and without_near_copies(no_docs).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(40) if k % 10 != 9] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: k - k % 10 for k in range(41) if k != 40} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_near_copies_keeps_all_columns_and_the_same_row(spark):
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, text, "b", "x", "own"), (1, text, "a", "y", "own"), (2, text + " more", "c", "z", "own"), (3, "another text of its own", "d", "w", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _hash string, _row string")
    got = without_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [rows[1], rows[3]]
    assert sorted(tuple(r) for r in without_near_copies(docs.repartition(4, "_hash")).collect()) == [rows[1], rows[3]]
