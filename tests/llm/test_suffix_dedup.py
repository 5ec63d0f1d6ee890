from collections import Counter
from itertools import groupby

from firstlook.llm.suffix_dedup import without_repeats

LAST = 1 << 63


def plain(rows, length):
    """Each row's removed runs and kept bytes, string by string."""
    first = {}
    for i, text in rows:
        data = text.encode()
        for k in range(len(data) - length + 1):
            key = data[k : k + length]
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = Counter()
    for i, text in rows:
        data, own = text.encode(), LAST if i is None else i
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < own:
                gone[k : k + length] = b"\1" * length
        spans, at = [], 0
        for flag, run in groupby(gone):
            n = len(list(run))
            spans += [(at, at + n)] * bool(flag)
            at += n
        out[i, len(data), sum(gone), tuple(spans), bytes(b for b, g in zip(data, gone) if not g)] += 1
    return out


def result(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, tuple(zip(r.starts, r.ends)), bytes(r.kept)) for r in df.collect())


def test_equal_to_string_by_string(odd_docs, odd):
    assert result(without_repeats(odd_docs, 50)) == plain(odd, 50)


def test_many_blocks_and_another_length(odd_docs, odd):
    assert result(without_repeats(odd_docs, 23, block_bytes=2_000)) == plain(odd, 23)


def test_other_columns_come_along(odd_docs):
    row = without_repeats(odd_docs, 50, rest=True).first()
    assert (row.rest.block, row.rest.kept, row.rest.key) == ("b", "t", "k")


def test_no_rows(no_docs):
    assert without_repeats(no_docs, 50).count() == 0
