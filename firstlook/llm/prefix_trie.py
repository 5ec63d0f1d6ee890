"""A prefix tree of whole conversations: which ones begin with the same turns, and what a cache of shared prefixes saves.

Conversations are dealt by id into ranges, and each range is read in order into blocks of bounded size. A block numbers its distinct turns and grows
an adaptive radix tree over the numbers as four big-endian bytes each: inner nodes hold 4, 16, 48 or 256 children, chains of single children are
kept as one path. Only byte depths that end a turn are nodes of the prefix tree; a block gives one row for each, in depth-first order,
with what its own conversations know: members, the smallest one, those that end there.

Equal nodes of all blocks have the same name, a fingerprint of their turns, so their rows are added up; a node that a third of all
conversations share costs one row for each block. The totals go back to the blocks. Each node belongs to the block of its smallest member, which counts it
for all the nodes above it, so that sums over subtrees are again sums over blocks.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from firstlook.plans.ordered import CHUNK, add_chunk, chunk_count
from firstlook.plans.written import written

from .blocks import table_of

WIDTH = 4
#: A block is closed at the first group of conversations that ends after so many turns.
BLOCK_TURNS = 60_000
NODES = "key binary, block long, place long, parent long, size long, depth long, bytes long, convs long, least long, ends long, ids binary"
PARTS = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, children long, leaves long, saved long, ends_sha256 string"
NONE_SHA = hashlib.sha256(b"").hexdigest()


class Radix:
    """A node of the adaptive radix tree: up to 16 children under sorted bytes, up to 48 through a table of 256 slots, above that in a list of 256."""

    __slots__ = ("path", "room", "bytes", "children", "ends")

    def __init__(self, path: bytes):
        self.path, self.room, self.bytes, self.children, self.ends = path, 4, bytearray(), [], []

    def child(self, byte: int) -> "Radix | None":
        if self.room <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.room == 48:
            slot = self.bytes[byte]
            return self.children[slot - 1] if slot else None
        return self.children[byte]

    def put(self, byte: int, node: "Radix") -> None:
        """Set or add the child under a byte, in a larger layout if this one is full."""
        if self.child(byte) is None and self.room < 256 and len(self.children) == self.room:
            self._grow()
        if self.room <= 16:
            at = self.bytes.find(byte)
            if at < 0:
                at = sum(b < byte for b in self.bytes)
                self.bytes.insert(at, byte)
                self.children.insert(at, node)
            self.children[at] = node
        elif self.room == 48:
            if not self.bytes[byte]:
                self.children.append(node)
                self.bytes[byte] = len(self.children)
            self.children[self.bytes[byte] - 1] = node
        else:
            self.children[byte] = node

    def _grow(self) -> None:
        own = list(self.each())
        self.room = {4: 16, 16: 48, 48: 256}[self.room]
        if self.room == 48:
            self.bytes, self.children = bytearray(256), [node for _, node in own]
            for slot, (byte, _) in enumerate(own):
                self.bytes[byte] = slot + 1
        elif self.room == 256:
            self.bytes, self.children = bytearray(), [None] * 256
            for byte, node in own:
                self.children[byte] = node

    def each(self) -> Iterator[tuple[int, "Radix"]]:
        """(byte, child) by rising byte."""
        if self.room <= 16:
            yield from zip(self.bytes, self.children)
        elif self.room == 48:
            yield from ((b, self.children[slot - 1]) for b, slot in enumerate(self.bytes) if slot)
        else:
            yield from ((b, node) for b, node in enumerate(self.children) if node is not None)


def _agree(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of a path the key has from a place on."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, len(path)  # the first low bytes agree, the first high don't
    while high - low > 1:
        half = (low + high) // 2
        low, high = (half, high) if key.startswith(path[low:half], at + low) else (low, half)
    return low


def insert(root: Radix, key: bytes, end: int) -> None:
    """Let a key end in the tree; the root has an empty path."""
    node, at, above, byte = root, 0, None, 0
    while True:
        same = _agree(node.path, key, at)
        if same < len(node.path):
            fork = Radix(node.path[:same])
            fork.put(node.path[same], node)
            node.path = node.path[same + 1 :]
            above.put(byte, fork)
            node = fork
        at += same
        if at == len(key):
            node.ends.append(end)
            return
        above, byte = node, key[at]
        node = above.child(byte)
        at += 1
        if node is None:
            node = Radix(key[at:])
            node.ends.append(end)
            above.put(byte, node)
            return


def turn_nodes(root: Radix, turns: list[tuple[bytes, int]], block: int) -> list[tuple]:
    """Rows of NODES, depth first: one for each byte depth that ends a turn. turns has the id and the text's length of each numbered turn."""
    rows, stack = [], [(root, b"", 0, -1, b"")]
    while stack:
        node, edge, depth, parent, key = stack.pop()  # edge: the bytes since the last end of a turn
        edge += node.path
        whole = len(edge) // WIDTH
        if node is root:
            rows.append([b"\0" * 16, block, 0, -1, 1, 0, 0, 0, None, 0, b""])
            parent, key = 0, rows[0][0]
        for k in range(whole):
            turn, size = turns[int.from_bytes(edge[k * WIDTH : (k + 1) * WIDTH], "big")]
            key, depth = hashlib.md5(key + turn).digest(), depth + 1
            rows.append([key, block, len(rows), parent, 1, depth, size, 0, None, 0, b""])
            parent = len(rows) - 1
        if node.ends:
            ids = np.sort(np.array(node.ends, "<i8"))
            rows[parent][7:] = [len(ids), int(ids[0]), len(ids), ids.tobytes()]
        rest = edge[whole * WIDTH :]
        stack.extend((child, rest + bytes([byte]), depth, parent, key) for byte, child in reversed(list(node.each())))
    for row in reversed(rows[1:]):
        above = rows[row[3]]
        above[4] += row[4]
        above[7] += row[7]
        above[8] = row[8] if above[8] is None else min(above[8], row[8])
    return rows


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, list]]:
    """(chunk, group, conv_id, turns) for each conversation of sorted rows; a turn is its id and its text's length."""
    last, turns = None, []
    for batch in batches:
        ids = list(zip(batch["id"].to_pylist(), batch["bytes"].to_pylist()))
        conv = batch["conv_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), len(conv)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            now = (batch[CHUNK][start].as_py(), batch["group"][start].as_py(), int(conv[start]))
            if last is not None and now != last:
                yield *last, turns
                turns = []
            last = now
            turns += ids[start:end]
    if last is not None:
        yield *last, turns


def _blocks(shared: Callable[[int], int]) -> Callable:
    """Rows of NODES, block by block, from sorted turns."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, numbers, turns, held, flushed, head, current = Radix(b""), {}, [], 0, 0, [], None
        for chunk, group, conv, own in _conversations(batches):
            if group != current:
                if held >= BLOCK_TURNS:
                    yield from table_of(turn_nodes(root, turns, (chunk << 32) + flushed), NODES).to_batches()
                    root, numbers, turns, held, flushed = Radix(b""), {}, [], 0, flushed + 1
                head, current = [], group
            if conv == group:
                head = own
            own = head[: shared(conv)] + own[shared(conv) :]
            for turn in own:
                if turn[0] not in numbers:
                    numbers[turn[0]] = len(turns)
                    turns.append(turn)
            insert(root, struct.pack(f">{len(own)}I", *[numbers[turn[0]] for turn in own]), conv)
            held += len(own) + 1
        if held:
            yield from table_of(turn_nodes(root, turns, (chunk << 32) + flushed), NODES).to_batches()

    return read


def _told(table: pa.Table) -> pa.Table:
    """Rows of PARTS: what one block adds to each of its nodes, and all that is known of those that belong to it."""
    table = table.sort_by("place")
    of = {c: table[c].to_numpy() for c in ("place", "parent", "size", "depth", "bytes", "ends", "least", "all_convs", "all_least", "all_ends")}
    owned = of["least"] == of["all_least"]
    sums = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[of["place"] + of["size"]] - c[of["place"]]
    saved, leaves = sums(owned * (of["all_convs"] - 1) * of["bytes"]), sums((owned & (of["all_convs"] == of["all_ends"])).astype(np.int64))
    children = np.zeros(len(owned), np.int64)
    np.add.at(children, of["parent"][owned & (of["parent"] >= 0)], 1)
    ids = table["ids"].to_pylist()
    here = np.flatnonzero((of["ends"] > 0) & (of["ends"] == of["all_ends"]))  # all that end here are of this block
    digests = [None] * len(ids)
    for k in here.tolist():
        digests[k] = hashlib.sha256(_listed(ids[k])).hexdigest()
    only = lambda x: pa.array(x, pa.int64(), mask=~owned)
    above = pa.array(of["all_least"][of["parent"]], pa.int64(), mask=~owned | (of["parent"] < 0))
    return pa.table({
        "key": table["key"], "conv_id": only(of["all_least"]), "depth": only(of["depth"]), "parent_conv_id": above, "n_convs": only(of["all_convs"]),
        "children": pa.array(children), "leaves": pa.array(leaves), "saved": pa.array(saved), "ends_sha256": pa.array(digests, pa.string()),
    })


def _listed(ids: bytes) -> bytes:
    return ",".join(map(str, np.frombuffer(ids, "<i8").tolist())).encode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) from rows sorted by key and block: ids are hashed as they come, one block's at a time."""
    last, digest = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
            if key != last:
                if last is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(_listed(ids))
            else:
                digest.update(b"," + _listed(ids))
        if done:
            yield from table_of(done, "key binary, listed string").to_batches()
    if last is not None:
        yield from table_of([(last, digest.hexdigest())], "key binary, listed string").to_batches()


def prefix_trie(turns: DataFrame, group: Column | None = None, shared: Callable[[int], int] = lambda conv: 0) -> DataFrame:
    """The nodes of the prefix tree of conversations, from rows (conv_id, turn, role, text); other columns are not looked at.

    A conversation is its turns in the order of turn, null first; of equal numbers in the order of the md5 of role and text. A null role or text is empty.
    Rows that repeat are turns that repeat. Rows without a conv_id belong to no conversation and are left out; without any row there is no node.
    If given, group is the id of the conversation from which another takes its first shared(conv_id) turns (all if there are fewer, none if it is
    absent) in place of as many of its own; it must not fall as conv_id rises.

    A node of depth d is a distinct sequence of d turns that conversations begin with, its members; the root has none and is never missing. Returned for each:
    conv_id, the smallest member; depth; parent_conv_id, that of the node above; n_convs, members; n_children; n_leaves, nodes without
    children in its subtree, itself included; saved_tokens, the sum over its subtree of (n_convs - 1) times the bytes of the last text;
    ends_sha256 of the ids of members that end there, in ascending order and joined by commas.

    One conversation is never cut, and the ids that end in one node are hashed by one task, which holds those of one block at a time.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    conv = F.col("conv_id").cast("long")
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        conv.alias("conv_id"), (conv if group is None else group.cast("long")).alias("group"), "turn",
        named.alias("id"), F.octet_length(text).cast("long").alias("bytes"),
    )
    chunks = chunk_count(rows)
    dealt = add_chunk(rows, "group", chunks).repartitionById(chunks, F.col(CHUNK))
    ordered = dealt.sortWithinPartitions("group", F.col("conv_id") != F.col("group"), "conv_id", F.col("turn").asc_nulls_first(), "id").drop("turn")
    nodes = written(ordered.mapInArrow(_blocks(shared), NODES))

    whole = nodes.groupBy("key").agg(F.sum("convs").alias("all_convs"), F.min("least").alias("all_least"), F.sum("ends").alias("all_ends"))
    known = nodes.join(whole, "key")
    parts = known.groupBy("block").applyInArrow(_told, PARTS)
    one = ["conv_id", "depth", "parent_conv_id", "n_convs", "ends_sha256"]
    summed = parts.groupBy("key").agg(*[F.max(c).alias(c) for c in one], *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    spread = known.filter((F.col("ends") > 0) & (F.col("ends") < F.col("all_ends"))).select("key", "block", "ids")
    listed = spread.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_digests, "key binary, listed string")
    return summed.join(listed, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("listed", "ends_sha256", F.lit(NONE_SHA)).alias("ends_sha256"),
    )
