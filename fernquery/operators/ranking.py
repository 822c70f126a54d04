"""Fusion, recency, title boost, candidate union, per-note dedup and browse order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernquery.functions import analyzer
from fernquery.operators.dense import dense_norm


@dataclass(frozen=True)
class Profile:
    alpha: float = 0.85
    title_boost: float = 0.5
    epsilon: float = 0.0
    half_life: float = 180.0
    key: str = "modified"
    coverage_power: float = 2.0


PRODUCT = Profile()
LIBRARY = Profile(title_boost=0.8, epsilon=0.02, key="created")


def date_column(text: Column) -> Column:
    """Epoch milliseconds of an ISO day inside a text; days past a month's end roll on; bad months and days are null."""
    part = lambda k: F.nullif(F.regexp_extract(text, "(\\d{4})-(\\d{2})-(\\d{2})", k), F.lit("")).cast("int")
    fine = part(2).between(1, 12) & part(3).between(1, 31)
    return F.when(fine, F.unix_millis(F.date_add(F.make_date(part(1), part(2), F.lit(1)), part(3) - 1).cast("timestamp")))


def recency(ms: Column, now_ms: int, half_life: float) -> Column:
    days = F.greatest(F.lit(0.0), (F.lit(now_ms) - ms) / 86_400_000.0)
    return F.coalesce(F.pow(F.lit(0.5), days / half_life), F.lit(0.0))


def bm25_norm(score: Column, bound: Column, greatest: Column) -> Column:
    """By the bound, clipped at one; without a bound by the best candidate."""
    return F.when(bound > 1e-10, F.least(F.lit(1.0), score / bound)).when(greatest < 1e-10, 0.0).otherwise(score / greatest)


def title_coverage(query: str, title: Column) -> Column:
    """Share of the title's distinct terms that the query names, if the title has all the query's terms; else 0."""
    words = {analyzer.fold_text(t) for t in analyzer.tokenize(query, derived=False)}
    kept = {w for w in words if w not in analyzer.STOPWORDS} or words
    asked = sorted({analyzer.singular_text(w) for w in kept})
    if not asked:
        return F.lit(0.0)
    terms = F.array_distinct(F.transform(analyzer.tokens(title), lambda t: analyzer.singular(analyzer.fold(t))))
    q = F.array(*[F.lit(a) for a in asked])
    inside = F.size(F.array_except(q, terms)) == 0
    return F.when(inside & (F.size(terms) > 0), F.least(F.lit(1.0), F.lit(float(len(asked))) / F.size(terms))).otherwise(0.0)


def title_boost(query: str, path: Column, aliases: Column, boost: float) -> Column:
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.md$", "")
    best = F.greatest(title_coverage(query, base), F.coalesce(F.array_max(F.transform(aliases, lambda a: title_coverage(query, a))), F.lit(0.0)))
    return boost * best


def top(rows: DataFrame, key: str, n: int, tie: str) -> DataFrame:
    """The n greatest by (key desc, tie): a bounded heap in each partition."""
    return rows.orderBy(F.desc(key), tie).limit(n)


def arm(rows: DataFrame, key: str, n: int, tie: str, ordinal: int) -> DataFrame:
    """chunk_id, arm, place of an arm's candidates; zero scores are candidates too."""
    kept = top(rows, key, n, tie)
    return kept.select("chunk_id", F.lit(ordinal).alias("arm"), F.row_number().over(W.orderBy(F.desc(key), tie)).alias("place"))


def union_of(*arms: DataFrame) -> DataFrame:
    """chunk_id with the first arm that found it and its place there."""
    every = arms[0]
    for a in arms[1:]:
        every = every.unionByName(a)
    return every.groupBy("chunk_id").agg(F.min(F.struct("arm", "place")).alias("first")).select("chunk_id", "first.arm", "first.place")


def fuse(rows: DataFrame, p: Profile) -> DataFrame:
    """rows: dense (null without a vector), lexical, coverage, bound, recency, boost; adds the signals and `score`."""
    rows = rows.withColumn("covered", F.col("lexical") * F.pow("coverage", F.lit(p.coverage_power)))
    ends = rows.agg(F.coalesce(F.min("dense"), F.lit(0.0)).alias("_floor"), F.max("covered").alias("_most"))
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    rows = rows.withColumn("dense_filled", F.coalesce("dense", "_floor")).withColumn("dense_n", dense_norm(F.col("dense_filled"))).withColumn("bm25_n", bm25_norm(F.col("covered"), F.col("bound"), F.col("_most"))).drop("_floor", "_most")
    rows = rows.withColumn("hybrid", p.alpha * F.col("dense_n") + (1 - p.alpha) * F.col("bm25_n"))
    return rows.withColumn("score", F.nanvl(F.col("hybrid") + p.epsilon * F.col("recency") + F.col("boost"), F.lit(0.0)))


def best_of_note(rows: DataFrame, order: list[Column], note: str = "note_path") -> DataFrame:
    """The first row of each note; the rank filter lets Spark keep one row a group before the shuffle."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(note).orderBy(*order))).filter("_place = 1").drop("_place")


def browse(rows: DataFrame, ms: str, n: int) -> DataFrame:
    """Newest first, undated last, then path and id (by code point)."""
    return rows.orderBy(F.desc_nulls_last(ms), "note_path", "chunk_id").limit(n)
