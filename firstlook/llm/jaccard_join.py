"""N-gram Jaccard join of documents whose sets of word shingles are similar, without comparing all pairs: components, or all links.

Documents with equal sets form a class at once. For the classes' sets, the corpus tells how many sets hold each shingle. Under several global
orders, all with rare shingles first, a set's prefix is so long that two similar sets share a shingle of both prefixes under every order.
A pair is verified only if it passes all of these filters, and bounds on sizes and positions. First, each class is verified
against the hub of each of its prefix shingles, the most central class that holds it; that settles groups of near copies with a few pairs
a class. What is known of two classes and their hub bounds what they can share with each other, so that few other pairs arise
from large groups. Of those that do, the filters are intersected and all survivors verified. Components need only those in classes
not yet connected; links inside a component are found by jaccard_links alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firstlook.functions.columns import free_name, q
from firstlook.plans.written import written

from . import blocks as B
from .components import components
from .words import distinct, mix, shingles_of, texts_of, words_of

_NO_ID = (1 << 63) - 1
_LIKELY = "key binary, n int, alone int, centre double, shared binary, tokens binary, places binary, heads binary"


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row bounds, ascending shingles, digests): each row's set and 16 bytes that tell it from others."""
    for texts in texts_of(column):
        row, prints, _ = distinct(*shingles_of(words_of(texts, lower=True), words))
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        digests = np.zeros((len(texts), 2), np.uint64)
        filled = np.flatnonzero(np.diff(bounds))
        if len(filled):
            for k, salt in enumerate((0x1D, 0x2E)):
                digests[filled, k] = np.add.reduceat(mix(prints * np.uint64(2 * salt + 1) + np.uint64(salt)), bounds[filled])
        yield texts.first, bounds, prints, digests


def set_keys(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, block, text_hash, n, key) for rows with a block: the size and digest of each set; no key for an empty one."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bounds, _, digests in _sets(batch["text"], words):
                n = np.diff(bounds)
                key = pa.array([d.tobytes() if size else None for d, size in zip(digests, n)], pa.binary())
                part = batch.slice(first, len(n))
                same = {c: part[c] for c in ("doc_id", "block", "text_hash")}
                yield pa.RecordBatch.from_pydict(same | {"n": pa.array(n, pa.int64()), "key": key})

    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    return hashed.mapInArrow(keys, "doc_id long, block long, text_hash long, n long, key binary")


def _chosen(texts: pa.Table, chosen: pa.Table, words: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The block's chosen keys, each set once: (keys, row bounds, shingles)."""
    wanted = {k.as_py() for k in chosen["key"]}
    keys, sets = [], []
    for _, column in B.texts_in(texts):
        for _, bounds, prints, digests in _sets(column, words):
            for i, digest in enumerate(digests):
                key = digest.tobytes()
                if key in wanted and bounds[i + 1] > bounds[i]:
                    wanted.discard(key)
                    keys.append(key)
                    sets.append(prints[bounds[i] : bounds[i + 1]])
    bounds = np.cumsum([0] + [len(s) for s in sets])
    return keys, bounds, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def _orders(prints: np.ndarray, spread: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Sort keys of several global orders of shingles: rare first, by classes of rarity that get wider, then by unlike hashes.

    Under each order, shingles that no other set holds come first.
    """
    for k in range(count):
        rarity = np.where(spread > 1, 1 + np.log2(spread) // k, 0) if k else spread
        yield mix(prints + np.uint64(0x9E37 * k)), rarity


def _likely(words: int, percent: int, orders: int, buckets: int):
    """For each chosen set that may have a partner: its shared shingles, and those of its prefix under each order with their places."""

    def using(texts: pa.Table, told: pa.Table) -> pa.Table:
        chosen = told.filter(pa.compute.equal(told["kind"], -1))
        keys, bounds, prints = _chosen(texts, chosen.rename_columns({"answer": "key"} | {c: c for c in chosen.column_names if c != "answer"}), words)
        names, of = np.unique(prints, return_inverse=True)
        spread = np.ones(len(names), np.int64)
        edges = B.bucket_edges(names, buckets)
        for bucket, kind, data in zip(told["bucket"].to_pylist(), told["kind"].to_pylist(), told["answer"].to_pylist()):
            if kind == 0:
                spread[edges[bucket] : edges[bucket + 1]] = B.unpacked(data)
        spread = spread[of]
        size = np.diff(bounds)
        row = np.repeat(np.arange(len(keys)), size)
        prefix = size - (percent * size + 99) // 100 + 1
        rows, heads = [], []
        for by in _orders(prints, spread, orders):
            order = np.lexsort((*by, row))
            place = np.arange(len(row)) - bounds[row]
            head = (place < prefix[row]) & (spread[order] > 1)
            heads.append((row[head], prints[order[head]], place[head]))
        can = np.all([np.bincount(h[0], minlength=len(keys)) > 0 for h in heads], axis=0) if len(keys) else np.zeros(0, bool)
        cuts = [np.searchsorted(h[0], np.arange(len(keys) + 1)) for h in heads]
        alone = np.bincount(row[spread == 1], minlength=len(keys))
        centre = np.bincount(row, weights=np.log(spread), minlength=len(keys)) / np.maximum(size, 1)
        for i in np.flatnonzero(can):
            own = slice(bounds[i], bounds[i + 1])
            shared = B.packed_names(prints[own][spread[own] > 1])
            parts = [(h[1][cut[i] : cut[i + 1]], h[2][cut[i] : cut[i + 1]]) for h, cut in zip(heads, cuts)]
            prefixes = b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t, _ in parts)
            known = (keys[i], int(size[i]), int(alone[i]), float(centre[i]), shared)
            rows.append((*known, parts[0][0].tobytes(), parts[0][1].astype(np.int32).tobytes(), prefixes))
        return B.table_of(rows, _LIKELY)

    return using


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [np.frombuffer(x, np.int64) for x in batch["tokens"].to_pylist()]
        places = [np.frombuffer(x, np.int32) for x in batch["places"].to_pylist()]
        if not tokens:
            continue
        repeat = np.repeat(np.arange(batch.num_rows), [len(x) for x in tokens])
        yield pa.RecordBatch.from_pydict({
            **{c: batch[c].take(pa.array(repeat)) for c in ("id", "n", "alone", "centre")},
            "token": pa.array(np.concatenate(tokens)), "place": pa.array(np.concatenate(places)),
        })


def _heads(data: bytes) -> list[np.ndarray]:
    """A set's prefix shingles under each order."""
    found, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        found.append(np.frombuffer(data, np.uint64, n, at + 8))
        at += 8 + 8 * n
    return found


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int, filtered: bool) -> DataFrame:
    """(a, b, n_a, n_b, common) for each pair: how many shingles both sets hold.

    filtered: a pair is only compared if it passes the filter of every order. Common shingles are in both prefixes, or after
    the prefix of the set whose prefix ends first; so the prefixes must share what the rest cannot make up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch["n_a"].to_numpy().astype(np.int64), batch["n_b"].to_numpy().astype(np.int64)
            needed = -(-percent * (n_a + n_b) // (100 + percent)) + 1 - (percent * np.maximum(n_a, n_b) + 99) // 100
            common, keep, last, b, heads_b = [], [], None, None, None
            columns = [batch[c] for c in ("shared_a", "shared_b", "heads_a", "heads_b")]
            for least, one, two, h_a, h_b in zip(needed, *columns):
                if two != last:
                    last, b, heads_b = two, B.unpacked_names(two.as_py()), _heads(h_b.as_py())
                near = not filtered or all(len(np.intersect1d(x, y)) >= max(1, least) for x, y in zip(_heads(h_a.as_py()), heads_b))
                keep.append(near)
                common.append(len(np.intersect1d(B.unpacked_names(one.as_py()), b, assume_unique=True)) if near else 0)
            same = {c: batch[c] for c in ("a", "b", "n_a", "n_b")}
            yield pa.RecordBatch.from_pydict(same | {"common": pa.array(common, pa.int64())}).filter(pa.array(keep, pa.bool_()))

    side = lambda s: sets.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "shared", "heads")]).withColumnRenamed(f"id_{s}", s)
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(count, "a long, b long, n_a int, n_b int, common long")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, orders: int = 3, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    A set holds a text's distinct shingles of so many words, in lower case; a shorter text is its only shingle. Rows link when their
    intersection is at least percent % of their union. component_id is the smallest id that a row reaches by links, its own included. A null or
    empty text, or one without words, has no shingles and links with nothing. A null id is larger than all others: it is a component's id
    only where there is no other, and rows of an id that repeats are rows of their own. Other columns are ignored.
    """
    found = _grouped(docs, words, percent, orders, block_bytes)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.nullif("lead.id", F.lit(_NO_ID)).alias("component_id"))


def jaccard_links(docs: DataFrame, words: int = 5, percent: int = 80, orders: int = 3, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """The rows of jaccard_components with n_links, the number of other rows that each row links with.

    All similar pairs of classes are verified, also inside a component: their number grows with the square of a group of near copies
    that are not equal. Pairs of rows are not written; rows with equal sets are counted by class.
    """
    found = _grouped(docs, words, percent, orders, block_bytes, every=True)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.nullif("lead.id", F.lit(_NO_ID)).alias("component_id"), "n_links")


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, orders: int = 3, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that have the smallest id of their component; equal (doc_id, text) stay once.

    Of rows that repeat that id with other texts, the one whose text hashes lowest stays; of rows that differ in other columns only, the one whose
    other columns come first as JSON. Rows without words all stay. Columns may have any names.
    """
    number, hashed, row = (free_name(docs, n) for n in ("_id", "_hash", "_row"))
    leads = _grouped(docs.select("doc_id", "text"), words, percent, orders, block_bytes)
    leads = leads.select(F.col("lead.id").alias(number), F.col("lead.text_hash").alias(hashed)).distinct()
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.withColumns({number: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), hashed: text_hash}).join(leads, [number, hashed], "left_semi")
    whole, others = F.struct(*[q(c) for c in docs.columns]), [q(c) for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min_by(whole, F.to_json(F.struct(*others)) if others else F.lit(0))
    return rows.groupBy(number, hashed).agg(first.alias(row)).select(*[F.col(row)[c].alias(c) for c in docs.columns])


def _grouped(docs: DataFrame, words: int, percent: int, orders: int, block_bytes: int, every: bool = False) -> DataFrame:
    """(doc_id, n, lead[, n_links]): lead is the smallest (id, text_hash) of the row's component; n_links if every link is asked for."""
    rows, count = B.in_blocks(docs, block_bytes)
    buckets = B.buckets_for(count, 0.16, block_bytes)
    keyed = written(set_keys(rows, words))
    own_lead = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text_hash")
    classes = keyed.filter("n > 0").groupBy("key").agg(F.min(own_lead).alias("first"), F.min("block").alias("block"))
    chosen = classes.select("block", F.lit(0).cast("long").alias("bucket"), F.lit(-1).alias("kind"), F.col("key").alias("answer"))

    def asking(texts: pa.Table, told: pa.Table) -> pa.Table:
        _, _, prints = _chosen(texts, told.select(["answer"]).rename_columns(["key"]), words)
        names, times = np.unique(prints, return_counts=True)
        return B.table_of(B.questions(texts["block"][0].as_py(), 0, names, times, buckets), B.ASKED)

    def answering(table: pa.Table) -> list[tuple]:
        lists = [B.unpacked_names(x.as_py()) for x in table["names"]]
        times = np.concatenate([B.unpacked(x.as_py()) for x in table["extra"]])
        names, of = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(of, weights=times, minlength=len(names)).astype(np.int64)[of]
        edges = np.cumsum([0] + [len(x) for x in lists])
        bucket = table["bucket"][0].as_py()
        return [(b, bucket, 0, B.packed(total[s:e])) for b, s, e in zip(table["block"].to_pylist(), edges, edges[1:])]

    answers = B.answer(B.told(rows, chosen, asking, B.ASKED), answering)
    likely = B.told(rows, answers.unionByName(chosen), _likely(words, percent, orders, buckets), _LIKELY)
    sets = written(likely.withColumn("id", F.monotonically_increasing_id()))
    postings = written(sets.select("id", "n", "alone", "centre", "tokens", "places").mapInArrow(
        _postings, "id long, n int, alone int, centre double, token long, place int"
    ))
    links = _links(postings, sets, percent, every)
    if every:
        links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    joined = components(links).join(sets.select("id", "key"), "id").join(classes.select("key", "first"), "key")
    smallest = joined.groupBy("component").agg(F.min("first").alias("lead"))
    by_key = joined.join(smallest, "component").select("key", "lead")
    leads = classes.select("key", "first").join(by_key, "key", "left").select("key", F.coalesce("lead", "first").alias("lead"))
    lead = F.when(F.col("n") > 0, F.col("lead")).otherwise(own_lead).alias("lead")
    if not every:
        return keyed.join(leads, "key", "left").select("doc_id", "n", lead)
    rows_of = keyed.filter("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    numbered = sets.select("id", "key").join(rows_of, "key")
    ends = links.select("a", "b").union(links.select("b", "a"))
    beside = ends.join(numbered.select(F.col("id").alias("b"), "n_rows"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n_rows").alias("beside"))
    by_class = rows_of.join(numbered.select("id", "key").join(beside, "id"), "key", "left")
    counts = by_class.select("key", (F.col("n_rows") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"))
    found = keyed.join(leads, "key", "left").join(counts, "key", "left")
    return found.select("doc_id", "n", lead, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _links(postings: DataFrame, sets: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Links that connect all similar sets: with the hubs of their shingles, then between what is still apart. every: all links there are."""
    similar = (F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("common")))
    in_size = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")

    hub = F.max(F.struct("centre", F.col("id").alias("hub"), F.col("n").alias("n_hub"))).alias("best")
    hubs = postings.groupBy("token").agg(hub).select("token", "best.hub", "best.n_hub")
    at_hub = postings.join(hubs, "token")
    to_hub = at_hub.select(F.col("id").alias("a"), F.col("hub").alias("b"), F.col("n").alias("n_a"), F.col("n_hub").alias("n_b"))
    shares = written(_overlaps(to_hub.filter(in_size & (F.col("a") != F.col("b"))).select("a", "b").distinct(), sets, percent, False))
    links = shares.filter(similar).select("a", "b")

    with_hub = shares.select(F.col("a").alias("id"), F.col("b").alias("hub"), "common")
    labelled = at_hub.join(with_hub, ["id", "hub"], "left").join(components(links), "id", "left")
    held = F.when(F.col("id") == F.col("hub"), F.col("n")).otherwise(F.col("common"))
    labelled = written(labelled.select(
        "token", "id", "n", "place", F.coalesce("component", "id").alias("component"),
        held.alias("held"), F.greatest(F.lit(0), F.col("n") - F.col("alone") - held).alias("beside"),
    ))
    apart = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    mixed = labelled if every else labelled.join(apart.select("token"), "token")
    one, two = (mixed.select("token", *[F.col(c).alias(f"{c}_{s}") for c in mixed.columns if c != "token"]) for s in "ab")
    least = F.lit(percent) * (F.col("n_a") + F.col("n_b"))  # of 100 + percent times the common shingles
    # Of all common shingles, one comes first; both sets have all others after it.
    by_place = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    # Common shingles are among those that both share with the hub, or among those that both share with others.
    by_hub = F.least("held_a", "held_b") + F.least("beside_a", "beside_b")
    known = F.col("held_a").isNotNull() & F.col("held_b").isNotNull()
    most = F.when(known, F.least(by_place, by_hub)).otherwise(by_place)
    unlike = F.col("id_a") < F.col("id_b")
    if not every:
        unlike &= F.col("component_a") != F.col("component_b")
    pairs = one.join(two, "token").filter(unlike & in_size & (least <= F.lit(100 + percent) * most))
    pairs = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    return links.union(written(_overlaps(pairs, sets, percent, True).filter(similar).select("a", "b")))
