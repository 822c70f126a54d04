"""Near duplicates by BagMinHash over five-word shingles, banding, and verified multiset overlap.

Signature. A shingle of multiplicity w stands for the weight range (0, w], cut at the discretised weights 0, 1, 2, 4, 8
and so on. Every range of every shingle has a Poisson process of its own whose rate is the range's length; its points
come in order of time, each with a signature component and a weight inside the range. A range that w covers in part
keeps the points whose weight is at most w. A component's value is its earliest point, so two documents agree on
it with a probability equal to the weighted Jaccard similarity of their multisets. Points are made in time order
only as far as the document's total weight makes a further minimum unlikely; documents with a component still
open are continued.

Candidates. Texts that are equal are one node. Nodes that share a band are one bucket; a bucket compares its members with
one leader at a time, never all with all: first the least node, then the member that meets the most nodes over all its open buckets (the
likely origin of edited copies, so that the buckets of a group have one hub and not one each), then a pseudo-random one. Leaders are only compared with members that no verified
link has joined to them yet. A last pass takes every pair of a bucket that is still in different classes and that their
differences from a common leader don't rule out (prefix filtering on those), so no link between candidates is lost. Each candidate pair is verified on the whole multisets.

Classes are connected components, by alternating large-star and small-star steps on the verified links. Nothing but
counters comes to the driver.

Defined results: null and empty texts are equal texts and one class; texts of fewer than five words have one shingle of
all their words; texts without words join only equal texts; repeated rows are in one class; a null doc_id
is carried as null and the class id is the least non-null doc_id; an empty table gives an empty result; other
columns don't take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernquery.llm.common import RangeHash, cut, mix64, slices, table, trimming, utf8, word_spans
from fernquery.llm.common import held as compact  # wide tables of small numbers take a fraction of a checkpoint

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Near:
    words: int = 5
    similarity: float = 0.8
    bands: int = 25
    rows: int = 5


def shingles(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, shingles per row), in text order."""
    start, end, count = word_spans(data, at)
    keys = RangeHash(data)(start, end) if len(start) else np.zeros(0, np.uint64)
    n = len(keys)
    per = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    acc = np.zeros(n, dtype=np.uint64)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    last = np.repeat(first + count, count)  # one past the row's last word
    place = np.arange(n)
    for k in range(words):
        there = place + k < last
        acc = acc * _GOLD + np.where(there, keys[np.minimum(place + k, max(n - 1, 0))], U64(k + 1)) if n else acc
    starts = np.repeat(per, count) > place - np.repeat(first, count)
    return mix64(acc[starts]), per


def numbered(keys: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by row and shingle: (order, occurrence number of each shingle within its row, from 0)."""
    of = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((keys, of))
    k, o = keys[order], of[order]
    n = len(k)
    new = np.ones(n, dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    start = np.flatnonzero(new)
    return order, np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def bag_signatures(keys: np.ndarray, weight: np.ndarray, of: np.ndarray, rows: int, size: int) -> np.ndarray:
    """(rows, size) signature values of multisets: distinct keys with integer weights, each in row `of`."""
    out = np.zeros((rows, size), dtype=np.uint64)
    if not len(keys):
        return out
    procs: list[tuple] = []
    low, k, left = 0, 0, np.arange(len(keys))
    while len(left):  # the ranges (0,1], (1,2], (2,4], ... that each weight reaches
        high = max(1, 2 * low)
        procs.append((of[left], mix64(keys[left] ^ mix64(np.full(1, k + 1, np.uint64))), np.full(len(left), high - low, np.float64), np.full(len(left), low, np.float64), weight[left].astype(np.float64)))
        left = left[weight[left] > high]
        low, k = high, k + 1
    owner, key, rate, base, top = (np.concatenate(x) for x in zip(*procs, strict=True))
    mass = np.bincount(of, weights=weight, minlength=rows)
    todo = mass > 0
    reach = np.zeros(rows)
    reach[todo] = size * (np.log(size) + 4) / mass[todo]
    while todo.any():
        live = np.flatnonzero(todo[owner])
        o, ky, rt, bs, tp = owner[live], key[live], rate[live], base[live], top[live]
        time, i = np.zeros(len(live)), 0
        slot_all, time_all, value_all = [], [], []
        while len(o):
            point = mix64(ky + U64((2 * i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(_uniform(point)) / rt
            keep = time <= reach[o]
            o, ky, rt, bs, tp, time, point = o[keep], ky[keep], rt[keep], bs[keep], tp[keep], time[keep], point[keep]
            more = mix64(point ^ _GOLD)
            slot = o * size + ((more >> U64(32)) % U64(size)).astype(np.int64)
            value = mix64(more + _GOLD)
            whole = bs + rt <= tp
            ok = whole | (bs + rt * _uniform(value) <= tp)
            slot_all.append(slot[ok])
            time_all.append(time[ok])
            value_all.append(value[ok])
            i += 1
        slot, time, value = np.concatenate(slot_all), np.concatenate(time_all), np.concatenate(value_all)
        least = np.full(rows * size, np.inf)
        np.minimum.at(least, slot, time)
        won = time == least[slot]
        out.reshape(-1)[slot[won]] = value[won]
        closed = np.isfinite(least).reshape(rows, size).all(axis=1)
        todo &= ~closed
        reach[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, near: Near) -> np.ndarray:
    parts = signatures.reshape(-1, near.bands, near.rows)
    acc = np.broadcast_to(np.arange(1, near.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(near.rows):
        acc = mix64(acc * _GOLD + parts[:, :, k])
    return acc.view(np.int64)


def _text_key():
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def bands_of(data: np.ndarray, at: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """(bands of each row, whether it has shingles). A row has about a thousand points however short it is, so rows are bounded and not just bytes."""
    found, size = [(np.zeros((0, near.bands), np.int64), np.zeros(0, bool))], near.bands * near.rows
    for lo, hi in slices(len(at) - 1, at, 1 << 20, 1 << 9):
        keys, per = shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], near.words)
        order, number = numbered(keys, per)
        of = np.repeat(np.arange(hi - lo), per)
        lastone = np.ones(len(number), dtype=bool)
        lastone[:-1] = number[1:] == 0
        pick = order[lastone]
        sig = bag_signatures(keys[pick], number[lastone] + 1, of[pick], hi - lo, size)
        found.append((band_keys(sig, near), per > 0))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def banded(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, text_key and the bands of every document, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bands, has = bands_of(*utf8(b.column(2)), near)
            ends = np.concatenate([[0], np.cumsum(has * near.bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[has].reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["doc_id", "text_key", "bands"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(trimming(run), "doc_id long, text_key binary, bands array<long>")


def multisets(docs: DataFrame, near: Near) -> DataFrame:
    """node and its occurrence-numbered shingles, sorted, as packed 64-bit numbers; docs has node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            out = []
            for lo, hi in slices(b.num_rows, at, 1 << 20):
                keys, per = shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], near.words)
                order, number = numbered(keys, per)
                items = mix64(keys[order] + mix64(number.astype(np.uint64)))
                cuts = np.concatenate([[0], np.cumsum(per)])
                out += [np.sort(items[cuts[k] : cuts[k + 1]]).tobytes() for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=pa.binary())], names=["node", "items"])

    return docs.select("node", "text").mapInArrow(trimming(run), "node long, items binary")


def verify(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """a, b, similarity of every pair whose nodes have multisets; the joins are on single keys that AQE can split."""
    left = pairs.select("a", "b").join(items.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    both = left.join(items.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b").select("a", "b", "items_a", "items_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, 3), dtype=np.int64)
            for k in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[k].as_buffer(), dtype=np.uint64) for c in (2, 3))
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0  # exact: the last pass counts on it
                out[k] = same, len(x), len(y)
            same, m, n = out.T
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same / np.maximum(m + n - same, 1)), *map(pa.array, (same, m, n))], names=["a", "b", "similarity", "same", "size_a", "size_b"])

    return both.mapInArrow(trimming(run), "a long, b long, similarity double, same long, size_a long, size_b long")


def differing(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """hub, node, label, k, least_k, item: the items that exactly one of each node and its hub holds."""
    names = ["hub", "node", "label", "k", "least_k"]
    left = nodes.select(*names).join(items.select("node", F.col("items").alias("own")), "node")
    both = left.join(items.select(F.col("node").alias("hub"), F.col("items").alias("others")), "hub").select(*names, "own", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                held = [np.setxor1d(*(np.frombuffer(part.column(c)[k].as_buffer(), dtype=np.uint64) for c in (5, 6)), assume_unique=True) for k in range(part.num_rows)]
                take = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in held]))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in range(5)), pa.array(np.concatenate(held).view(np.int64))], names=[*names, "item"])

    return both.mapInArrow(trimming(run), "hub long, node long, label long, k double, least_k double, item long")


def last_pairs(open_: DataFrame, hubs: DataFrame, known: DataFrame, items: DataFrame, near: Near, rows: int) -> DataFrame:
    """a, b: every pair of a bucket, in different classes, that can still be similar.

    Each node has been compared with its bucket's hub h. Let D(x) be the items that exactly one of x and h holds. Nodes a and b differ in
    |D(a)| + |D(b)| - 2 |D(a) & D(b)| items, and are similar only if that is at most c (|a| + |b|), c = (1 - s) / (1 + s). With the excess
    k(x) = |D(x)| - c |x| they must thus share (k(a) + k(b)) / 2 items of D, which is above 0 unless both are linked to h already. So the pair
    shares one of the rarest |D| - (k(a) + k(b)) / 2 + 1 items of both (prefix filtering), where an item that one class holds alone doesn't
    count. Copies of a hub with edits of their own share next to nothing of D, however many they are. Groups of up to three nodes pair directly."""
    c = (1 - near.similarity) / (1 + near.similarity)
    ways = [known.select(F.col(x).alias("node"), F.col(y).alias("hub"), "same", F.col(f"size_{x}").alias("size"), F.col(f"size_{y}").alias("hub_size")) for x, y in ("ab", "ba")]
    sides = ways[0].unionByName(ways[1]).distinct()
    mine = open_.join(hubs.select("bucket", F.col("to.node").alias("hub")), "bucket").filter("node <> hub").select("hub", "node", "label").distinct()
    differ = F.col("size") + F.col("hub_size") - 2 * F.col("same")
    nodes = mine.join(sides, ["node", "hub"]).select("hub", "node", "label", (differ - F.lit(c) * F.col("size")).alias("k"))
    nodes = few(cut(few(nodes, rows)), rows)
    groups = nodes.groupBy("hub").agg(F.count("*").alias("members"), F.min("k").alias("least_k"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    nodes = few(cut(nodes.join(groups.drop("lo", "hi"), "hub")), rows)
    twin = lambda df, more: df.select("hub", *[F.col(x).alias(f"{x}_b") for x in ("node", "label", "k")], *more)
    small = nodes.filter("members <= 3")
    direct = small.join(twin(small, []), "hub").filter("label < label_b")
    held = compact(differing(nodes.filter("members > 3"), items))
    common = held.groupBy("hub", "item").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("hub", "item", "n")
    own = W.partitionBy("hub", "node")
    held = held.join(common, ["hub", "item"]).withColumn("left", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("n", "item")))
    held = held.select("hub", "node", "label", "k", "least_k", "item", (F.col("left") - F.col("place") + 1).alias("rest"))
    # a pair is found by its node of lesser k in `index`, by the other in `probe`: they share at least k, and at least half of k and the least k
    at_least = lambda x: F.greatest(F.ceil(x - 1e-9), F.lit(1))
    held = compact(held.filter(F.col("rest") >= at_least((F.col("k") + F.col("least_k")) / 2)))
    index, probe = held.filter(F.col("rest") >= at_least(F.col("k"))), twin(held, [F.col("item"), F.col("rest").alias("rest_b")])
    # all that a pair shares stands at or behind its first common item in both, so this bound holds there
    close = index.join(probe, ["hub", "item"]).filter((F.col("label") != F.col("label_b")) & (F.col("k") <= F.col("k_b")) & (F.least("rest", "rest_b") >= (F.col("k") + F.col("k_b")) / 2 - 1e-9))
    return direct.select(F.col("node").alias("a"), F.col("node_b").alias("b")).unionByName(close.select(F.col("node").alias("a"), F.col("node_b").alias("b"))).distinct()


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df in no more partitions than its number of rows is worth, so that small tables don't make many small files."""
    return df.coalesce(max(2, rows // each + 1))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of an edge (a, b)."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen, rows = None, edges.count()
    while True:
        now = few(now, rows)
        count = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if count == seen or not count[0]:
            break
        seen = count
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = few(large, rows).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = cut(few(small.filter("u <> v"), rows).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def classes(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, text_key, class_id (the least doc_id of the class), class_size (documents), class_texts and label of every row of docs.
    Only the label names a class for sure: ids may be null or repeated."""
    rows = cut(banded(docs, near))
    # a text's first row stands for it; partial aggregation meets copies before the shuffle
    texts = rows.groupBy("text_key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    texts = cut(texts.withColumn("node", F.monotonically_increasing_id()))
    member = texts.select("node", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    buckets = compact(member.join(shared, "bucket").select("bucket", "node", "leader"))
    n = buckets.count()
    buckets = few(buckets, n)
    wanted = texts.join(buckets.select("node").distinct(), "node", "left_semi").select("text_key", "node")
    source = docs.select(_text_key().alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least = texts.select("text_key", F.col("least_id").alias("own"))
    # one row of each text: that of its least id; equal rows that are left make equal multisets and are merged
    held = source.join(few(wanted, n).join(least, "text_key"), "text_key").filter(F.col("doc_id").eqNullSafe(F.col("own")))
    items = cut(multisets(held, near).dropDuplicates(["node"]))
    items = few(items, n, 20_000)

    known = few(verified_pairs(buckets.select(F.col("node").alias("a"), F.col("leader").alias("b")), None, items, near, n), n)
    for step in range(3):
        labels = components(known.filter(F.col("similarity") >= near.similarity).select("a", "b"))
        labelled = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        labelled = few(labelled, n)
        mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
        open_ = few(compact(labelled.join(mixed, "bucket", "left_semi")), n)
        if open_.isEmpty():
            break
        if step == 0:
            met = open_.join(open_.groupBy("bucket").agg(F.count("*").alias("meets")), "bucket").groupBy("node").agg(F.sum("meets").alias("meets"))
            hubs = few(cut(open_.join(few(met, n), "node").groupBy("bucket").agg(F.max_by(F.struct("node", "label"), F.struct("meets", -F.col("node"))).alias("to"))), n)
            pairs = open_.join(hubs, "bucket").select(F.col("node").alias("a"), F.col("to.node").alias("b"))
        elif step == 1:
            lead = open_.groupBy("bucket").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", "bucket")).alias("to"))
            pairs = open_.join(lead, "bucket").filter("label <> to.label").select(F.col("node").alias("a"), F.col("to.node").alias("b"))
        else:
            pairs = last_pairs(open_, hubs, known, items, near, n)
        more = verified_pairs(few(pairs, n), known, items, near, n)
        known = few(cut(known.unionByName(few(more, n))), n)
    labels = components(known.filter(F.col("similarity") >= near.similarity).select("a", "b"))
    named = texts.join(labels, "node", "left").select("text_key", F.coalesce("label", "node").alias("label"), "least_id", "copies")
    heads = named.groupBy("label").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("class_texts"))
    return rows.select("doc_id", "text_key").join(named.join(heads, "label").select("text_key", "class_id", "class_size", "class_texts", "label"), "text_key")


def verified_pairs(pairs: DataFrame, known: DataFrame | None, items: DataFrame, near: Near, rows: int) -> DataFrame:
    fresh = pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    if known is not None:
        fresh = fresh.join(known.select("a", "b"), ["a", "b"], "left_anti")
    return cut(verify(few(fresh, rows), items))


def keep_one(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """docs without all but one document of each class: that with the least doc_id, nulls last (of equal ids that with the least text hash, of equal rows any)."""
    columns = docs.columns
    least = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    kept = classes(docs, near).groupBy("label").agg(F.min(least).alias("kept")).select(F.col("kept.doc_id").alias("_kept_id"), F.col("kept.text_key").alias("_kept_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), _text_key().alias("key"))
    chosen = rows.join(kept, (F.col("key") == F.col("_kept_key")) & F.col("id").eqNullSafe(F.col("_kept_id"))).dropDuplicates(["key"])
    return chosen.select([F.col("row").getField(c).alias(c) for c in columns])


def op9_nearcopies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("text_key", "label")
