"""Vector tiers and dense candidates: signs, 8-bit quantisation, scores, background statistics and calibration, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(0.0)


def sign_bytes(v: Column) -> Column:
    """Packed signs: bit i of the whole is set if v[i] >= 0, lowest bit first."""
    n = F.size(v)
    return F.transform(
        F.sequence(F.lit(0), F.ceil(n / 8).cast("int") - 1),
        lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, i: s + F.when(F.get(v, k * 8 + i) >= 0, F.get(F.array(*[F.lit(1 << b) for b in range(8)]), i)).otherwise(0)),
    )


def signs(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x >= 0, 1.0).otherwise(-1.0))


def asymmetric(query: Column, v: Column) -> Column:
    """The query's components summed with the row's signs."""
    return dot(query, signs(v))


def scale(v: Column) -> Column:
    return F.array_max(F.transform(doubles(v), F.abs)) / 127


def quantise(v: Column) -> Column:
    """8-bit components: half up, as floor(x + 0.5); a zero vector is all zero. The scale is bound once for all components."""
    over = F.transform(F.array(scale(v)), lambda s: F.transform(doubles(v), lambda x: F.when(s > 0, F.floor(x * (1 / s) + 0.5)).otherwise(0).cast("int")))
    return F.get(over, F.lit(0))


def tiers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, s, q (8-bit components) and sign bytes of every vector, to be stored."""
    v = F.col(column)
    return vectors.select(key, scale(v).alias("s"), F.transform(quantise(v), lambda x: x.cast("tinyint")).alias("q"), F.transform(sign_bytes(v), lambda x: x.cast("smallint")).alias("bits"))


def nearest_stored(held: DataFrame, query: list[float], k: int, key: str = "vec_id") -> DataFrame:
    """The k nearest rows of a stored 8-bit tier; a cosine doesn't feel the scale. The squares of integers are exact."""
    q = F.array(*[F.lit(float(x)) for x in query])
    qq = sum(float(x) * float(x) for x in query) ** 0.5
    size = F.sqrt(F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x))
    top = F.aggregate(F.zip_with(q, F.col("q"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return held.select(key, F.when((size > 0) & F.lit(qq > 0), top / (size * qq)).otherwise(0.0).alias("score")).orderBy(F.desc("score"), key).limit(k)


def dequantise(q: Column, s: Column) -> Column:
    return F.transform(q, lambda x: x * s)


def dense_norm(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c + 1) / 2))


def pool_caps(rows: int) -> dict[str, int]:
    """Candidates of each arm: flat to 5000 rows, then with the square root, to a ceiling; recency stays."""
    grow = lambda floor, top: floor if rows <= 5000 else max(floor, min(top, math.floor(floor * math.sqrt(rows / 5000) + 0.5)))
    return {"binary": grow(200, 800), "bm25": grow(100, 400), "recency": 50}


def background_mean(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """n and the mean cosine of different unit vectors, (N |mean|^2 - 1) / (N - 1): one aggregation of d rows."""
    n = vectors.agg(F.count("*").alias("n"))
    dims = vectors.select(F.posexplode(doubles(F.col(column))).alias("dim", "x")).groupBy("dim").agg(F.sum("x").alias("s"))
    squares = dims.agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    return squares.crossJoin(n).select("n", F.when(F.col("n") >= 200, (F.col("q") / F.col("n") - 1) / (F.col("n") - 1)).alias("mean"))


def background_deviation(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", reservoir: int = 4096, pairs: int = 8000, seed: int = 7) -> DataFrame:
    """Population deviation of the cosines of at most `pairs` pairs of a reservoir of at most 4096 rows chosen by hash."""
    h = F.xxhash64(F.lit(seed), key)
    kept = vectors.orderBy(h, key).limit(reservoir).select(h.alias("h"), key, column)
    held = kept.select((F.row_number().over(W.orderBy("h", key)) - 1).alias("i"), F.col(column).alias("v"))  # at most `reservoir` rows
    total = held.agg(F.count("*").alias("n"))
    draws = vectors.sparkSession.range(pairs).crossJoin(F.broadcast(total)).filter("n > 1")
    a = F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("int")), F.col("n"))
    step = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id").cast("int")), F.col("n") - 1) + 1
    drawn = draws.select(a.cast("int").alias("i"), F.pmod(a + step, F.col("n")).cast("int").alias("j"))
    both = drawn.join(F.broadcast(held), "i").join(F.broadcast(held.select(F.col("i").alias("j"), F.col("v").alias("w"))), "j")
    return both.select(dot(F.col("v"), F.col("w")).alias("c")).agg(F.stddev_pop("c").alias("deviation"))


def confidence(c: Column, mean: Column, deviation: Column) -> Column:
    """Logistic of (z - 2) / 0.9."""
    return F.when(deviation > 0, 1 / (1 + F.exp(-(((c - mean) / deviation) - 2.0) / 0.9))).otherwise(0.0)


def match_strength(dense: Column, lexical: Column, lexical_only: Column, alpha: float = 0.85) -> Column:
    """Display strength: the lexical share where there is no vector, else the weighted sum; null without calibration."""
    both = F.least(F.lit(1.0), F.greatest(F.lit(0.0), alpha * dense + (1 - alpha) * lexical))
    return F.when(lexical_only, lexical).when(dense.isNull(), None).otherwise(both)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", tier: str = "exact") -> DataFrame:
    """The k rows of the highest score by (score desc, key): one scan, no shuffle but the last k of each partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col("embedding")
    score = {"exact": lambda: cosine(q, v), "sign": lambda: asymmetric(q, v), "int8": lambda: cosine(q, dequantise(quantise(v), scale(v)))}[tier]()
    return vectors.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)
