"""Quality classifier by positive-unlabelled learning: a small network under the non-negative unbiased risk.

Trusted positives are the labelled rows with quality 1 of the learning folds; the unlabelled sample is web text
(documents, whatever their label, which isn't looked at). The class prior is estimated from a first classifier
of positives against unlabelled rows by the best-bin rule: the least ratio, over score thresholds, of the
unlabelled share above it to the positive share above it, with a confidence margin. The network then minimises
prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]).

`SAMPLE` bounds how many positives and how many unlabelled rows are fitted on, whatever the input's size (chosen
by the order of a hash of their ids). Scoring reads every byte of every text in one pass without a shuffle.

Defined results: null and empty texts are scored by the features of an empty text; repeated rows score alike;
null ids count as empty text in fold and sample; with no positives or no unlabelled rows every score is 0.5;
an empty table gives an empty result; features come from the text alone, so other columns can't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernquery.llm.common import SPACE, RangeHash, crc_of_id, slices, table, trimming, utf8, word_spans

SAMPLE = 8_000
SLICE = 1 << 19  # bytes of text that are looked at together: arrays of features take up to 80 times as much
BLOCK = 64  # words whose worst share counts, so that junk after a clean start shows
_KINDS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 ASCII punctuation, 5 space, 6 beyond ASCII
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 6
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KINDS[SPACE] = 5
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "!#$%&*+/<=>@[]\\^_`{|}~"]] = True


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of features for each text of a UTF-8 buffer."""
    rows = len(at) - 1
    size = np.diff(at)
    owner = np.repeat(np.arange(rows), size)
    kinds = np.bincount(owner * 7 + _KINDS[data], minlength=7 * rows).reshape(rows, 7)
    marks = np.bincount(owner[_SYMBOL[data]], minlength=rows)
    breaks = np.bincount(owner[data == 10], minlength=rows)
    start, end, words = word_spans(data, at)
    of = np.repeat(np.arange(rows), words)
    n = len(start)
    long_ = end - start

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=x, minlength=rows)

    keys = RangeHash(data, fold=True)(start, end) if n else np.zeros(0, np.uint64)
    again = np.zeros(n)
    again[1:] = (keys[1:] == keys[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((keys, of))
    fresh = np.ones(n)
    fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order], weights=fresh, minlength=rows)
    # words of five, for repeated passages
    fives = np.zeros(n, dtype=np.uint64)
    if n > 4:
        acc = keys[:-4].copy()
        for k in range(1, 5):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + keys[k : n - 4 + k]
        fives[:-4] = acc
    whole = np.zeros(n, dtype=bool)
    if n > 4:
        whole[:-4] = of[4:] == of[:-4]
    f_of, f_key = of[whole], fives[whole]
    order = np.lexsort((f_key, f_of))
    new = np.ones(len(order))
    new[1:] = (f_key[order][1:] != f_key[order][:-1]) | (f_of[order][1:] != f_of[order][:-1])
    f_distinct, f_all = np.bincount(f_of[order], weights=new, minlength=rows), np.bincount(f_of, minlength=rows)

    sums = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    upper, symbol, punct = sums(_KINDS[data] == 2), sums(_SYMBOL[data]), sums(_KINDS[data] == 4)
    within = lambda s: s[end] - s[start]
    shout = (within(upper) >= 2) & (2 * within(upper) >= long_)
    noisy = within(symbol) >= 1
    noisy2 = within(punct) >= 2
    single = long_ == 1
    # the worst block of words of each text
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    block = (np.arange(n) - first[of]) // BLOCK
    per = np.maximum(1, -(-words // BLOCK))
    base = np.concatenate([[0], np.cumsum(per)])
    slot = base[of] + block
    filled = np.bincount(slot, minlength=base[-1])

    def worst(x: np.ndarray) -> np.ndarray:
        share = np.bincount(slot, weights=x, minlength=base[-1]) / np.maximum(filled, BLOCK / 4)
        return np.maximum.reduceat(share, base[:-1]) if rows else np.zeros(0)

    length = total(long_)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(breaks), _share(size, words), _share(words, breaks + 1),
        *[_share(kinds[:, k], size) for k in range(7)],
        _share(marks, size), _share(total(again), words), _share(distinct, words), np.log1p(distinct), _share(f_distinct, f_all),
        _share(total(shout), words), _share(total(noisy), words), _share(total(noisy2), words), _share(total(single), words),
        worst(again), worst(shout), worst(noisy), worst(noisy2), worst(single),
        np.sqrt(_share(total(long_.astype(float) ** 2), words)), _share(length, size), words == 0, words < 5, words < 20,
        _share(distinct, np.sqrt(np.maximum(words, 1))),
    ]
    return np.stack([np.asarray(c, dtype=np.float32) for c in columns], axis=1) if rows else np.zeros((0, 34), np.float32)


def all_features(texts: pa.Array) -> np.ndarray:
    data, at = utf8(texts)
    parts = [features(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in slices(len(at) - 1, at, SLICE)]
    return np.concatenate(parts) if parts else features(data, at)


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.maximum(z @ w1 + b1, 0) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)), -30, 30)))


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int, hidden: int = 24, epochs: int = 60) -> Network:
    """With a prior: the non-negative risk. Without: plain positives against unlabelled rows, for the prior's estimate."""
    rng = np.random.default_rng(seed)
    mean, spread = unl.mean(axis=0), unl.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / spread, -8, 8).astype(np.float64) for x in (pos, unl))
    d = p.shape[1]
    theta = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta], 0
    size = 256
    for _ in range(epochs):
        steps = max(1, min(len(u) // size, 40))
        pi_, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(steps):
            xp, xu = p[pi_[np.arange(k * size, (k + 1) * size) % len(p)]], u[ui[np.arange(k * size, (k + 1) * size) % len(u)]]
            x = np.concatenate([xp, xu])
            z = x @ theta[0] + theta[1]
            h = np.maximum(z, 0)
            g = 1 / (1 + np.exp(-np.clip(h @ theta[2] + theta[3][0], -30, 30)))  # the sigmoid loss of -1 is g, of +1 is 1 - g
            gp, gu = g[:size], g[size:]
            slope_p, slope_u = gp * (1 - gp) / size, gu * (1 - gu) / size
            if prior is None:
                out = np.concatenate([(gp - 1) / size, gu / size])
            elif gu.mean() - prior * gp.mean() >= 0:
                out = np.concatenate([-2 * prior * slope_p, slope_u])
            else:  # step back from the negative part, as the method asks
                out = np.concatenate([prior * slope_p, -slope_u])
            grads = [x.T @ (np.outer(out, theta[2]) * (z > 0)), ((np.outer(out, theta[2])) * (z > 0)).sum(axis=0), h.T @ out, np.array([out.sum()])]
            t += 1
            for j, grad in enumerate(grads):
                grad = grad + 1e-4 * theta[j]
                m[j] = 0.9 * m[j] + 0.1 * grad
                v[j] = 0.999 * v[j] + 0.001 * grad * grad
                theta[j] = theta[j] - 3e-3 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return Network(mean.astype(np.float64), spread.astype(np.float64), theta, prior or 0.0)


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 3) -> float:
    """Best-bin estimate: half of each sample trains the ranking, the other half gives the ratio."""
    half_p, half_u = len(pos) // 2, len(unl) // 2
    net = _train(pos[:half_p] if half_p else pos, unl[:half_u] if half_u else unl, None, seed)
    sp, su = np.sort(net.logits(pos[half_p:])), np.sort(net.logits(unl[half_u:]))
    grid = np.quantile(sp, np.linspace(0, 0.9, 400))
    above_p, above_u = 1 - np.searchsorted(sp, grid) / len(sp), 1 - np.searchsorted(su, grid) / len(su)
    margin = np.sqrt(np.log(40) / 2 / len(su)) + np.sqrt(np.log(40) / 2 / len(sp))
    best = int(np.argmin((above_u + margin) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from at most `sample` trusted positives and `sample` unlabelled ids of the learning folds; of rows of one id the least text counts."""
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(crc_of_id(), F.lit(3)).alias("fold"))
    trusted = labels.filter((F.col("quality") == 1) & (F.pmod(crc_of_id(), F.lit(3)) != 1)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    order = F.xxhash64(F.lit(11), "doc_id")
    chosen = trusted.orderBy(order, "doc_id").limit(sample)
    some = learn.filter("fold <> 1").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(12), "doc_id"), "doc_id").limit(sample)
    of = chosen.withColumn("kind", F.lit(1)).unionByName(some.withColumn("kind", F.lit(0)))  # at most 2 * sample ids
    rows = learn.select("doc_id", "text").join(F.broadcast(of), "doc_id").groupBy("kind", "doc_id").agg(F.min("text").alias("text")).select("kind", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = all_features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), type=pa.list_(pa.float32()))], names=["kind", "x"])

    got = rows.mapInArrow(trimming(run), "kind int, x array<float>").toPandas()
    if not len(got):
        return None
    x, kind = np.array(got["x"].to_list(), dtype=np.float64), got["kind"].to_numpy()
    order = np.lexsort(x.T[::-1])  # rows come in any order; the fit may not depend on it
    x, kind = x[order], kind[order]
    rng = np.random.default_rng(5)
    pos, unl = rng.permutation(x[kind == 1]), rng.permutation(x[kind == 0])
    if len(pos) < 2 or len(unl) < 2:
        return None
    return _train(pos, unl, class_prior(pos, unl), seed=4)


def score(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and `score`; one pass, no shuffle."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DoubleType, StructField, StructType

    taken = [*keep, "text"] if "text" not in keep else list(keep)
    slim = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in taken])
    at = taken.index("text")
    schema = [StructField(f"c{k}", slim.schema[c].dataType) for k, c in enumerate(keep)]  # own names: docs may have any
    kinds = [to_arrow_type(f.dataType) for f in schema]
    names = [f"c{k}" for k in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = net.scores(all_features(b.column(at))) if net is not None else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*[b.column(taken.index(c)).cast(k) for c, k in zip(keep, kinds, strict=True)], pa.array(s, type=pa.float64())], names=[*names, "score"])

    done = slim.mapInArrow(trimming(run), StructType([*schema, StructField("score", DoubleType())]))
    return done.toDF(*keep, "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score at least `threshold`, with all their columns."""
    columns = docs.columns
    name = "score"
    while name in columns:
        name += "_"
    return score(docs, fit(docs, labels), columns).toDF(*columns, name).filter(F.col(name) >= threshold).drop(name)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return got.select("doc_id", (F.pmod(crc_of_id(), F.lit(3)) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
