import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F, types as T

from firstlook.llm import prefix_trie as pt
from firstlook.llm.queries import first_turns_shared

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("key", "block", "group", "id", "bytes", "_chunk", "ends")],
])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def order(row):
    role, text = row[2] or "", row[3] or ""
    return row[1] is not None, row[1] or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows: list[tuple], shared) -> list[tuple]:
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(own):
        group = conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)
        turns = own.get(group, [])[: shared(conv)] + own[conv][shared(conv) :]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    below = defaultdict(int)
    for node in members:
        if node:
            below[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += below[node] == 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return [
        (convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), below[node], leaves[node], saved[node], sha(ends[node]))
        for node, convs in members.items()
    ]


def strange_rows() -> list[tuple]:
    random.seed(4)
    rows = []
    for conv in [*range(0, 120), *range(-12, 0), 1 << 40, (1 << 62) + 1]:
        for turn in range(random.choice([1, 2, 3, 8, 12])):
            rows.append((conv, turn, random.choice(["user", "assistant", None]), random.choice(["é", "a", "b", None, ""])))
    rows += [(3, None, "x", "null turn"), (3, None, "x", "null turn"), (4, 2, "r", "tie"), (4, 2, "r", "tie too"), (None, 1, "r", "no one's")]
    rows += [(500 + k, t, "user", f"copy {t}") for k in range(60) for t in range(4)]  # many copies
    rows += [(700 + k, t, "user", f"copy {t}" if t < 20 else f"own {k}") for k in range(30) for t in range(25)]
    rows += [(1000 + k, 0, "user", f"fan {k}") for k in range(700)]  # more children than any small layout holds
    return rows + [(900, t, "user", f"long {t}" * 50) for t in range(3000)]


def ours(spark, rows, shared=first_turns_shared):
    table = spark.createDataFrame([(*r, *["c"] * 7) for r in rows], SCHEMA).repartition(6)
    got = pt.prefix_trie(table, F.col("conv_id") - F.col("conv_id") % 5, shared)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("block", [60_000, 40])
def test_nodes_equal_a_plain_count(spark, monkeypatch, block):
    monkeypatch.setattr(pt, "BLOCK_TURNS", block)
    rows = [r for r in strange_rows() if r[0] != 900 or r[1] < 40]
    assert ours(spark, rows) == sorted(plain(rows, first_turns_shared), key=repr)


def test_conversations_of_their_own(spark):
    rows = [r for r in strange_rows() if r[0] is None or r[0] < 100]
    got = pt.prefix_trie(spark.createDataFrame([(*r, *["c"] * 7) for r in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows, lambda c: 0), key=repr)


def test_a_long_conversation_and_no_rows(spark):
    rows = [r for r in strange_rows() if r[0] in (900, 901, 5)]
    found = ours(spark, rows, lambda c: 0)
    assert max(r[1] for r in found) == 3000
    assert ours(spark, []) == [] == ours(spark, [(None, 1, "a", "b")])


def test_tree_against_a_dictionary():
    random.seed(9)
    keys = [bytes(random.choices(range(256), k=random.randint(0, 6))) for _ in range(3000)] + [bytes([1, 2, b]) for b in range(256)] + [b"long" * 50, b"long" * 49 + b"lo"]
    root = pt.Radix(b"")
    for k, key in enumerate(keys):
        pt.insert(root, key, k)
    found, rooms, stack = defaultdict(list), set(), [(root, b"")]
    while stack:
        node, key = stack.pop()
        rooms.add(node.room)
        key += node.path
        found[key] += node.ends
        own = list(node.each())
        assert [b for b, _ in own] == sorted({b for b, _ in own}) and (node is root or node.ends or len(own) > 1)
        assert all(node.child(b) is child for b, child in own)
        stack += [(child, key + bytes([b])) for b, child in own]
    want = defaultdict(list)
    for k, key in enumerate(keys):
        want[key].append(k)
    assert {k: v for k, v in found.items() if v} == dict(want) and rooms == {4, 16, 48, 256}
