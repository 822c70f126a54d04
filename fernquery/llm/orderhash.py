"""Order MinHash fingerprints, with DataFrame functions only.

A text's tokens are its runs of up to 8 visible characters; its k-mers are runs of `k` tokens (a shorter text has one k-mer
of all its tokens). Equal k-mers are numbered in text order, so that each (k-mer, number) is an item of its own with a
hash of its own. The item's hash deals it to one of `cells` cells, and each cell keeps its `kept` least items; they
are put back in text order and hashed as a tuple. A cell thus agrees between two texts when they share its least
items and have them in the same order, which is what makes the signature sensitive to edit distance and not to
overlap alone. The likeness of two fingerprints is the share of agreeing cells among those that either fills.

All of it is one pass over arrays of 64-bit numbers inside a row: hash in the high bits, position in the low 30, so sorting is
on primitive arrays. No string that Spark can hold has more tokens.

The next document in descending order of ids comes from a window inside range buckets of ids; each bucket also gets a copy of the
first row of the next one, so no window spans the whole table. Bounds of buckets come from approximate percentiles, as many as the number of rows asks
for, and are looked up in two steps; at most MOST_BUCKETS of them.

Defined results: null text is empty; an empty text fills no cell, and is like another empty text (1.0) and no other (0.0);
equal texts have equal fingerprints; of rows with equal ids the order is that of their texts; a null id comes last; one row alone
is its own next; an empty table gives an empty result; other columns don't take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernquery.llm.common import table

MOST_BUCKETS = 4096
ROWS_A_BUCKET = 2000
_POSITIONS, _KEY = 30, 33
_LAST = (1 << _POSITIONS) - 1
_TUPLE = 57  # bits of a tuple's hash in a packed cell; cells are at most 64


@dataclass(frozen=True)
class Order:
    k: int = 3
    cells: int = 64
    kept: int = 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _head(v: Column) -> Column:
    return F.shiftright(v, _POSITIONS)


def _pack(key: Column, position: Column) -> Column:
    """Key's low bits above a position, so that packed numbers stay positive."""
    return F.shiftleft(key.bitwiseAND(F.lit((1 << _KEY) - 1)), _POSITIONS).bitwiseOR(position)


def _range(low: Column, high: Column) -> Column:
    """low .. high, or nothing."""
    return F.when(high >= low, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))


def cells(text: Column, rule: Order) -> Column:
    """Packed numbers of the filled cells, by cell: the cell in the top bits, 57 bits of its tuple's hash below."""
    one = F.lit(1)

    def kmers(tokens: Column) -> Column:
        n = F.size(tokens)
        hashed = F.transform(tokens, lambda t: F.xxhash64(t))
        full = let(hashed, lambda h: F.transform(_range(one, n - rule.k + 1), lambda i: _pack(F.xxhash64(*[F.get(h, i - 1 + j) for j in range(rule.k)]), F.least(i, F.lit(_LAST)).cast("long"))))
        return F.when(n >= rule.k, full).when(n > 0, F.array(_pack(F.xxhash64(F.array_join(tokens, "\n")), F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))

    def items(s: Column) -> Column:
        # s: packed k-mers, sorted; runs of equal heads are numbered 0, 1, ... in text order
        n = F.size(s)
        starts = F.filter(_range(F.lit(0), n - 1), lambda i: (i == 0) | (_head(F.get(s, i)) != _head(F.get(s, i - 1))))
        numbers = let(starts, lambda st: F.flatten(F.transform(st, lambda x, j: F.sequence(F.lit(0), F.coalesce(F.get(st, j + 1), n) - x - 1))))
        return F.sort_array(F.zip_with(s, numbers, lambda v, o: _pack(F.xxhash64(_head(v), o), v.bitwiseAND(F.lit(_LAST)))))

    cell = lambda v: F.shiftright(v, _POSITIONS + _KEY - (rule.cells - 1).bit_length())  # noqa: E731  the top bits of the key

    def tuples(t: Column) -> Column:
        least = F.filter(t, lambda v, i: (i < rule.kept) | (cell(F.get(t, i - rule.kept)) != cell(v)))

        def joined(q: Column) -> Column:
            first = F.filter(_range(F.lit(0), F.size(q) - 1), lambda i: (i == 0) | (cell(F.get(q, i)) != cell(F.get(q, i - 1))))

            def one_cell(i: Column) -> Column:
                own = F.filter(F.slice(q, i + 1, F.lit(rule.kept)), lambda v: cell(v) == cell(F.get(q, i)))
                in_order = F.array_sort(F.transform(own, lambda v: F.struct(v.bitwiseAND(F.lit(_LAST)).alias("at"), _head(v).alias("item"))))
                hashed = F.xxhash64(F.transform(in_order, lambda x: x["item"]))
                return F.shiftleft(cell(F.get(q, i)), _TUPLE).bitwiseOR(hashed.bitwiseAND(F.lit((1 << _TUPLE) - 1)))

            return F.transform(first, one_cell)

        return let(least, joined)

    tokens = F.regexp_extract_all(text, F.lit("\\S{1,8}"), F.lit(0))
    return let(tokens, lambda w: let(F.sort_array(kmers(w)), lambda s: let(items(s), tuples)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: agreeing cells among those that either fills; 1 for two empty ones."""
    same = F.size(F.array_intersect(a, b))
    filled = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, _TUPLE)), F.transform(b, lambda x: F.shiftright(x, _TUPLE))))
    return F.when(filled == 0, 1.0).otherwise(same / F.greatest(filled, F.lit(1)))


def written(a: Column) -> Column:
    """A fingerprint as text: each filled cell's packed number in hexadecimal."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def below(v: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are less than v: first among every `step`-th of them, then among those between."""
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*[F.lit(int(x)) for x in cuts[::step]])
    runs = F.array(*[F.array(*[F.lit(int(x)) for x in cuts[k : k + step]]) for k in range(0, len(cuts), step)])
    fewer = lambda xs: F.size(F.filter(xs, lambda x: x < v))
    return let(fewer(coarse), lambda n: F.when(n == 0, 0).otherwise((n - 1) * step + fewer(F.get(runs, n - 1))))


def with_next(docs: DataFrame, made: dict[str, Column]) -> DataFrame:
    """docs (doc_id, text) with the columns `made` and `next`, a struct of text and those of the next row by descending
    doc_id, cyclically. The columns are made once, just before the shuffle that deals rows to buckets."""
    count = docs.count()
    wanted = max(1, min(MOST_BUCKETS, count // ROWS_A_BUCKET))
    found = docs.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 10 * MOST_BUCKETS)).first()[0] if wanted > 1 else None
    cuts = sorted(set(found or []))
    bucket = F.lit(len(cuts)) - below(F.col("doc_id"), cuts) if cuts else F.lit(0)
    placed = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(bucket)).withColumn("extra", F.lit(False))
    # the first id of each bucket: one row for each of at most MOST_BUCKETS buckets
    heads = placed.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"), F.count("doc_id").alias("n"))
    ring = W.partitionBy(F.lit(0)).orderBy("bucket")
    last = W.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))
    heads = heads.withColumn("into", F.coalesce(F.lag("bucket").over(ring), F.first("bucket").over(last)))
    extra = placed.join(F.broadcast(heads.select("bucket", F.col("doc_id").alias("head"), "into")), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("head")))
    extra = extra.select(*[F.col("into").alias("bucket") if c == "bucket" else F.lit(True).alias("extra") if c == "extra" else F.col(c) for c in placed.columns])
    order = W.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), "text")
    rows = placed.unionByName(extra).withColumns(made)
    return rows.withColumn("next", F.lead(F.struct("text", *made)).over(order)).filter(~F.col("extra")).drop("bucket", "extra")


def fingerprints(docs: DataFrame, rule: Order = Order()) -> DataFrame:
    """doc_id, text, cells of every row."""
    return _slim(docs).withColumn("cells", cells(F.col("text"), rule))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def op5_orderhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Order()
    rows = with_next(_slim(table(spark, sf_dir, "documents")), {"cells": cells(F.col("text"), rule)})
    n = F.length("text")
    part = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next.text"), F.lit(1), part))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "cells", F.col("next.cells").alias("next_cells"), edited.alias("edited"))
    rows = rows.select("*", cells(F.col("edited"), rule).alias("edited_cells"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("cells")).alias("fingerprint"),
        written(F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("cells"), F.col("edited_cells")).alias("near_edited"),
        likeness(F.col("cells"), F.col("next_cells")).alias("near_next"),
    )
