"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of the last `window` lines ends a chunk where it is 0 modulo `spread`, so
boundaries depend on nearby lines only and come back after an insertion. A chunk has at least `least` and at most `most` lines;
what a text's end cuts off below `least` lines belongs to the chunk before it. Lines are compared without the line feed that ends the chunk.
A chunk of several lines that stands earlier (smaller doc_id, or the same document and an earlier chunk) with the same bytes is
removed; the first copy stays.

Chunk boundaries seldom fit a short passage. So each pair of neighbouring lines is judged too: pairs that stand in a document of a smaller doc_id are
joined to runs, and a run of over `words` words is removed, whatever chunks its lines are in.

Plan: one pass makes a slim row (digest, document, line, lines) for each chunk of several lines and each pair of lines; the earliest row of
each repeated digest is found by partial aggregation, which meets hot chunks before the shuffle. Repeats of one document
that follow one another in one earlier document are joined to ranges; each different range of an earlier document is fetched once as
bytes, sent to the documents that repeat it and compared there, and only what is equal goes. Both passes over texts join
on the document's key with the same exchange; texts without a line feed take no part in it.

Defined results: lines end at line feeds; null and empty texts have no lines and come out as empty text (null stays null);
a text of one chunk that is an earlier text's copy comes out empty; a null doc_id is later than all others; of different texts of one
(or no) id the one with the lesser hash is earlier; rows of equal doc_id and equal text are copies of the first of them, so their
chunks of several lines go; an empty table gives an empty result; all columns of docs pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernquery.llm.common import DIGITS, RangeHash, cut, mix64, runs_of, slices, table, trimming, utf8, word_spans

U64 = np.uint64
LATE = (1 << 63) - 1


@dataclass(frozen=True)
class Lines:
    window: int = 2
    spread: int = 4
    least: int = 2
    most: int = 64
    words: int = 50


def _bare(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ends without a final line feed."""
    return end - (data[end - 1] == 10) if len(end) else end


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte) of each line; a line's line feed belongs to it."""
    marks = np.flatnonzero(data == 10) + 1
    ends = np.unique(np.concatenate([marks, at[1:][np.diff(at) > 0]]))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    return np.searchsorted(at, starts, side="right") - 1, starts, ends


def rest_of_runs(pairs: np.ndarray, gone: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Lines left of runs of repeated pairs that have over `least` words. pairs: of each line and the next; gone: lines removed already."""
    edge = np.diff(np.concatenate([[0], pairs.astype(np.int8), [0]]))
    out = np.zeros(len(gone), dtype=bool)
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + 1).tolist(), strict=True):
        if words[a:b].sum() > least:
            out[a:b] = ~gone[a:b]
    return out


def chunks(data: np.ndarray, at: np.ndarray, rule: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte, lines) of each chunk; a line's line feed belongs to it."""
    row, starts, ends = lines_of(data, at)
    n = len(ends)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    hashes = RangeHash(data)(starts, _bare(data, starts, ends))
    roll = np.zeros(n, dtype=np.uint64)
    for k in range(rule.window):
        there = np.zeros(n, dtype=bool)
        there[k:] = row[k:] == row[: n - k]
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[k:] = hashes[: n - k]
        roll += np.where(there, mix64(shifted ^ DIGITS[k]), U64(0))
    hit = (mix64(roll) % U64(rule.spread) == 0).tolist()
    last = np.ones(n, dtype=bool)
    last[:-1] = row[1:] != row[:-1]
    stops, since = [], 0
    for k, final in enumerate(last.tolist()):
        since += 1
        if final and since < rule.least and stops and row[stops[-1]] == row[k]:
            stops[-1] = k
            since = 0
        elif final or since >= rule.most or (hit[k] and since >= rule.least):
            stops.append(k)
            since = 0
    stop = np.array(stops)
    begin = np.concatenate([[0], stop[:-1] + 1])
    return row[begin], starts[begin], ends[stop], stop - begin + 1


def _keyed(docs: DataFrame, keep: bool = True) -> DataFrame:
    """row (all columns), at_id and key (a hash of the text) of the rows whose text has a line feed (`keep`), or of all others."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    has = F.contains(text, F.lit("\n"))
    return docs.filter(has if keep else ~has).select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LATE)).alias("at_id"), F.xxhash64(text).alias("key"))


def slim_chunks(docs: DataFrame, rule: Lines) -> DataFrame:
    """at_id, key, line, n, pair, digest of the chunks of several lines and the pairs of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs_of(batches, 2):
            data, at = utf8(b.column(2))
            for lo, hi in slices(b.num_rows, at):
                part, own = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                row, start, end, n = chunks(part, own, rule)
                line = np.cumsum(n) - n
                line = line - line[np.searchsorted(row, row)]
                many = n > 1
                l_row, l_start, l_end = lines_of(part, own)
                two = np.flatnonzero(l_row[1:] == l_row[:-1])
                nth = np.arange(len(l_row)) - np.searchsorted(l_row, l_row)
                row, line, n = np.concatenate([row[many], l_row[two]]), np.concatenate([line[many], nth[two]]), np.concatenate([n[many], np.full(len(two), 2)])
                start, end = np.concatenate([start[many], l_start[two]]), np.concatenate([end[many], l_end[two + 1]])
                pair = np.arange(len(row)) >= many.sum()
                digest = RangeHash(part)(start, _bare(part, start, end)) if len(row) else np.zeros(0, np.uint64)
                digest = np.where(pair, mix64(digest ^ DIGITS[0]), digest).view(np.int64)  # a pair is never a copy of a chunk
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(line.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(pair), pa.array(digest)], names=["at_id", "key", "line", "n", "pair", "digest"])

    return _keyed(docs.select("doc_id", "text")).select("at_id", "key", "row.text").mapInArrow(trimming(run), "at_id long, key long, line int, n int, pair boolean, digest long")


def ranges_of(spans: list[dict]) -> list[tuple[int, int, int, int, int]]:
    """(line, lines, earlier document's id, key and line) that together hold all spans: neighbours in one earlier document are one range."""
    found: dict[tuple, list[list[int]]] = {}
    for s in sorted(spans, key=lambda s: (s["line"], -s["n"])):
        runs = found.setdefault((s["f_id"], s["f_key"], s["f_line"] - s["line"]), [])
        if runs and s["line"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s["line"] + s["n"])
        else:
            runs.append([s["line"], s["line"] + s["n"]])
    every = sorted(((a, b, f) for f, runs in found.items() for a, b in runs), key=lambda x: (x[0], -x[1]))
    out, reach = [], -1
    for a, b, (f_id, f_key, off) in every:
        if b > reach:  # else a range that is sent anyway holds it
            out.append((a, b - a, f_id, f_key, a + off))
            reach = b
    return out


def sought(spans: DataFrame) -> DataFrame:
    """The ranges of every document's spans, one row each."""
    names = ["at_id", "key", "line", "n", "f_id", "f_key", "f_line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(i, k, *r) for i, k, own in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True) for r in ranges_of(own)]
            columns = list(zip(*made, strict=True)) if made else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int32() if x in ("line", "n", "f_line") else pa.int64()) for c, x in zip(columns, names, strict=True)], names=names)

    return spans.select("at_id", "key", "spans").mapInArrow(trimming(run), "at_id long, key long, line int, n int, f_id long, f_key long, f_line int")


def fetch(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """f_id, f_key, f_line, n, bytes (without a final line feed) of the ranges in wanted (at_id, key, ranges)."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).field(at)
            for lo in range(0, b.num_rows, 64):
                ids, keys, line, n, got = [], [], [], [], []
                for r in range(lo, min(lo + 64, b.num_rows)):
                    data = np.frombuffer((texts[r].as_py() or "").encode(), np.uint8)
                    _, first, last = lines_of(data, np.array([0, len(data)]))
                    last = _bare(data, first, last)
                    for x in b.column(3)[r].as_py():
                        ids.append(b.column(0)[r].as_py())
                        keys.append(b.column(1)[r].as_py())
                        line.append(x["f_line"])
                        n.append(x["n"])
                        got.append(data[first[x["f_line"]] : last[x["f_line"] + x["n"] - 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(keys, type=pa.int64()), pa.array(line, type=pa.int32()), pa.array(n, type=pa.int32()), pa.array(got, type=pa.binary())], names=["f_id", "f_key", "f_line", "n", "bytes"])

    joined = _keyed(docs).join(wanted, ["at_id", "key"]).select("at_id", "key", "row", "ranges")
    return joined.mapInArrow(trimming(run), "f_id long, f_key long, f_line int, n int, bytes binary").dropDuplicates(["f_id", "f_key", "f_line", "n"])


def repeated(docs: DataFrame, rule: Lines = Lines()) -> DataFrame:
    """at_id, key, spans (line, n, pair) that stand earlier too, and proofs (line, n, bytes of an earlier document) for them."""
    slim = cut(slim_chunks(docs, rule))
    firsts = slim.groupBy("digest").agg(F.min(F.struct("at_id", "key", "line")).alias("first"), F.count("*").alias("many")).filter("many > 1").select("digest", "first")
    own = F.struct("at_id", "key", "line")
    elsewhere = (F.col("at_id") != F.col("first.at_id")) | (F.col("key") != F.col("first.key"))
    later = slim.join(firsts, "digest").filter((own > F.col("first")) & (elsewhere | ~F.col("pair")))
    span = F.struct("line", "n", "pair", F.col("first.at_id").alias("f_id"), F.col("first.key").alias("f_key"), F.col("first.line").alias("f_line"))
    spans = cut(later.groupBy("at_id", "key").agg(F.collect_set(span).alias("spans")))
    ranges = sought(spans)
    place = ["f_id", "f_key", "f_line", "n"]
    wanted = ranges.select(*place).distinct().groupBy(F.col("f_id").alias("at_id"), F.col("f_key").alias("key")).agg(F.collect_list(F.struct("f_line", "n")).alias("ranges"))
    proofs = ranges.join(fetch(wanted, docs), place).groupBy("at_id", "key").agg(F.collect_list(F.struct("line", "n", "bytes")).alias("proofs"))
    return spans.join(proofs, ["at_id", "key"]).select("at_id", "key", F.transform("spans", lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), x["pair"].alias("pair"))).alias("spans"), "proofs")


def lines_gone(data: np.ndarray, spans: list[dict], proofs: list[dict], copy: bool, rule: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, whether it goes) of each line of one text."""
    zero = np.array([0, len(data)])
    _, first, last = lines_of(data, zero)
    bare = _bare(data, first, last)
    gone, pairs, proven = np.zeros(len(first), dtype=bool), np.zeros(max(len(first) - 1, 0), dtype=bool), []
    for x in proofs:
        a, b = x["line"], x["line"] + x["n"]
        if data[first[a] : bare[b - 1]].tobytes() == x["bytes"]:
            proven.append((a, b))
    if copy:
        _, _, _, n = chunks(data, zero, rule)
        gone |= np.repeat(n > 1, n)
    for s in spans:
        a, b = s["line"], s["line"] + s["n"]
        if any(x <= a and b <= y for x, y in proven):
            if s["pair"]:
                pairs[a] = True
            else:
                gone[a:b] = True
    if pairs.any():
        gone |= rest_of_runs(pairs, gone, word_spans(data, np.append(first, len(data)))[2], rule.words)
    return first, last, gone


def dedup(docs: DataFrame, rule: Lines = Lines(), counts: bool = False) -> DataFrame:
    """docs with the repeated chunks taken out of `text`; with counts, also n_lines and n_removed."""
    from pyspark.sql.types import LongType, StructField, StructType

    columns = docs.columns
    at = columns.index("text")
    joined = _keyed(docs).join(repeated(docs, rule), ["at_id", "key"], "left")
    joined = joined.withColumn("nth", F.row_number().over(W.partitionBy("at_id", "key").orderBy("at_id")))
    flat = joined.select(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(columns)], "spans", "proofs", (F.col("nth") > 1).alias("copy"))
    schema = StructType([*flat.schema.fields[:-3], StructField("n_lines", LongType()), StructField("n_removed", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs_of(batches, at):
            n, k = b.num_rows, len(columns)
            copy = b.column(k + 2).to_pylist()
            hit = [r for r in range(n) if copy[r] or b.column(k)[r].is_valid]
            data, ends = utf8(b.column(at))
            n_lines, n_gone = np.bincount(lines_of(data, ends)[0], minlength=n), np.zeros(n, np.int64)
            texts = b.column(at)
            if hit:
                texts = texts.to_pylist()
                for r in hit:
                    own = data[ends[r] : ends[r + 1]]
                    first, last, gone = lines_gone(own, b.column(k)[r].as_py() or [], b.column(k + 1)[r].as_py() or [], copy[r], rule)
                    n_gone[r] = gone.sum()
                    if n_gone[r]:
                        texts[r] = b"".join(own[s:e].tobytes() for s, e, x in zip(first.tolist(), last.tolist(), gone.tolist(), strict=True) if not x).decode("utf-8")
                texts = pa.array(texts, type=pa.string())
            out = [texts if j == at else b.column(j) for j in range(k)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_lines.astype(np.int64)), pa.array(n_gone)], names=[f.name for f in schema.fields])

    done = flat.mapInArrow(trimming(run), schema)
    plain = _keyed(docs, keep=False).select(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(columns)])
    one = (F.length(F.coalesce(F.col(f"c{at}"), F.lit(""))) > 0).cast("long")
    done = done.unionByName(plain.withColumn("n_lines", one).withColumn("n_removed", F.lit(0).cast("long")))
    out = [F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]
    return done.select(*out, "n_lines", "n_removed") if counts else done.select(*out)


def op2_linechunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars_kept"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
