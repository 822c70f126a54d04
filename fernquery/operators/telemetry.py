"""Log roll-ups and suggestions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def floor_percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, least, greatest, mean, p50 and p95 at the index floor(q (n - 1)) of the sorted values. Rows are counted by value before any window, so
    a key's task holds its different values and not its rows. Null values don't count."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    own = W.partitionBy(*by)
    ranked = counted.withColumn("_upto", F.sum("_c").over(own.orderBy(value))).withColumn("_n", F.sum("_c").over(own))
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor(q * (F.col("_n") - 1)), F.col(value)))
    mean = F.sum(F.col(value) * F.col("_c")) / F.sum("_c")
    return ranked.groupBy(*by).agg(F.sum("_c").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), mean.alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def milestones(errors: DataFrame, message: str, at: list[str]) -> DataFrame:
    """The 1st, 2nd, 4th, 8th ... row of each message, and the last one (flush)."""
    own = W.partitionBy(message)
    n = F.row_number().over(own.orderBy(*at))
    rows = errors.withColumn("seen", n).withColumn("total", F.count("*").over(own))
    power = F.col("seen").bitwiseAND(F.col("seen") - 1) == 0
    return rows.withColumn("flush", ~power & (F.col("seen") == F.col("total"))).filter(power | F.col("flush"))


WIDE = 16  # slots that are worked on together


def overlaps(spans: DataFrame, tasks: DataFrame, slot: int = 3600) -> DataFrame:
    """For each task (task_id, start, end) the span (context, start, end) with the largest overlap, later start on ties, then greater context; an open span
    never ends. Both are dealt into stretches of time slots, in which `widest` finds a task's span without pairing all that overlap: where rows lie
    denser, pairs grow with their square. slot is in the unit of the numbers; no end lies before its start."""
    last = F.coalesce("end", F.lit((1 << 62)))
    top = tasks.agg(F.max("end").alias("hi"))
    cut = F.least(last, F.col("hi"))
    at = lambda c: F.floor(c / (slot * WIDE))
    to = lambda lo, hi: F.explode(F.sequence(at(F.col(lo)), at(hi))).alias("part")
    kind = tasks.schema["start"].dataType
    a = spans.crossJoin(F.broadcast(top)).filter("start <= hi").select("context", F.col("start").cast(kind).alias("lo"), last.cast(kind).alias("hi"), to("start", F.greatest(cut, F.col("start"))))
    b = tasks.select("task_id", F.col("start").alias("lo"), F.col("end").cast(kind).alias("hi"), to("start", F.col("end")))
    row = T.StructType([tasks.schema["task_id"], spans.schema["context"], T.StructField("s", kind), T.StructField("overlap", kind)])

    def best(s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values(["lo", "context"])
        task, found, overlap = widest(s["lo"].to_numpy(), s["hi"].to_numpy(), t["lo"].to_numpy(), t["hi"].to_numpy())
        return pd.DataFrame({"task_id": t["task_id"].to_numpy()[task], "context": s["context"].to_numpy()[found], "s": s["lo"].to_numpy()[found], "overlap": overlap})

    found = a.groupBy("part").cogroup(b.groupBy("part")).applyInPandas(best, row)  # a row for each task and stretch
    return found.groupBy("task_id").agg(F.max(F.struct("overlap", "s", "context")).alias("w")).select("task_id", "w.context", "w.overlap")


def widest(s: np.ndarray, e: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(task, span, overlap) of tasks [a, b) that overlap a span [s, e), with the largest overlap and then the last of the spans, which are in order of start.

    A span that covers a task beats all others, and then the last one does. Else the best is the one that reaches farthest from before the task, the first
    that starts inside and outlasts it, or the longest inside: each is found by searches over maxima, in n log n."""
    n, m = len(s), len(a)
    best, place = np.zeros(m, dtype=np.result_type(s, a, b)), np.full(m, -1, dtype=np.int64)
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), best[:0]

    def take(which: np.ndarray, span: np.ndarray, overlap: np.ndarray) -> None:
        better = (place[which] < 0) | (overlap > best[which]) | (overlap == best[which]) & (span > place[which])
        best[which[better]], place[which[better]] = overlap[better], span[better]

    tops = [e]  # tops[k][i]: the latest end of spans i to i + 2**k - 1
    while 2 << (len(tops) - 1) <= n:
        half = 1 << (len(tops) - 1)
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
    point = a == b
    before = np.where(point, np.searchsorted(s, a, side="left"), np.searchsorted(s, a, side="right"))  # spans that start before or with a task
    # the last of them that lasts as long as the task; one that covers a point goes beyond it
    at = before.copy()
    for k in reversed(range(len(tops))):
        fits = at >= 1 << k
        high = tops[k][np.where(fits, at - (1 << k), 0)]
        at -= np.where(fits & ((high < b) | point & (high == b)), 1 << k, 0)
    covered = np.flatnonzero(at > 0)
    take(covered, at[covered] - 1, b[covered] - a[covered])
    rest = np.flatnonzero((at == 0) & ~point)
    # from before: the latest end of all, the last of equals
    by_end = np.lexsort((np.arange(n), e))
    rank = np.empty(n, np.int64)
    rank[by_end] = np.arange(n)
    reach = np.maximum.accumulate(rank)
    r = rest[before[rest] > 0]
    far = by_end[reach[before[r] - 1]]
    r, far = r[e[far] > a[r]], far[e[far] > a[r]]
    take(r, far, e[far] - a[r])
    # the first that starts inside and lasts as long, and the last of those with the same start
    at = before[rest].copy()
    for k in reversed(range(len(tops))):
        fits = at + (1 << k) <= n
        at += np.where(fits & (tops[k][np.where(fits, at, 0)] < b[rest]), 1 << k, 0)
    inside = (at < n) & (s[np.minimum(at, n - 1)] < b[rest])
    r, first = rest[inside], at[inside]
    at = np.searchsorted(s, s[first], side="right")
    for k in reversed(range(len(tops))):
        fits = at >= 1 << k
        at -= np.where(fits & (tops[k][np.where(fits, at - (1 << k), 0)] < b[r]), 1 << k, 0)
    take(r, at - 1, b[r] - s[first])
    # the longest inside: spans enter a tree of suffix maxima in order of their ends
    by_length = np.lexsort((np.arange(n), e - s))
    rank[by_length] = np.arange(n)
    tree, ranks, after, k, got = [-1] * (n + 1), rank.tolist(), before.tolist(), 0, []
    entering, ending = by_end.tolist(), e[by_end].tolist()
    r = rest[np.argsort(b[rest], kind="stable")]
    for j, end in zip(r.tolist(), b[r].tolist(), strict=True):
        while k < n and ending[k] < end:
            i, x = n - entering[k], ranks[entering[k]]
            while i <= n:
                if tree[i] < x:
                    tree[i] = x
                i += i & -i
            k += 1
        i, x = n - after[j], -1
        while i > 0:
            if tree[i] > x:
                x = tree[i]
            i &= i - 1
        got.append(x)
    got = np.array(got, dtype=np.int64)
    r, found = r[got >= 0], by_length[got[got >= 0]]
    take(r, found, e[found] - s[found])
    task = np.flatnonzero(place >= 0)
    return task, place[task], best[task]


def facets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """key, value, n: one pass that stacks the columns and aggregates."""
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    return rows.select(stack.alias("f")).select("f.key", "f.value").filter("value IS NOT NULL").groupBy("key", "value").agg(F.count("*").alias("n"))


def worthwhile(counts: DataFrame, most: int = 40) -> DataFrame:
    """Keys with few values, or whose values come back twice as often as they are many."""
    by_key = counts.groupBy("key").agg(F.count("*").alias("card"), F.sum("n").alias("total"))
    return by_key.filter((F.col("card") <= most) | (F.col("total") >= 2 * F.col("card")))


def completions(counts: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    return counts.filter(F.lower("value").startswith(typed.lower())).orderBy(F.desc("n"), "value").limit(limit)


def roll_up(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))


def last_activity(rows: DataFrame, by: str, quiet: list[str]) -> DataFrame:
    """The type of the latest beat of each session that isn't one of the quiet ones."""
    loud = ~F.col("event_type").isin(*quiet)
    return rows.groupBy(by).agg(F.max_by(F.when(loud, F.col("event_type")), F.when(loud, F.struct("ts", "event_id"))).alias("last_type"))


def clicks_after(searches: DataFrame, clicks: DataFrame, by: str) -> DataFrame:
    """Each click with the latest search of its user before it: one union and a window, no range join."""
    both = searches.select(by, "ts", "event_id", F.lit(0).alias("is_click")).unionByName(clicks.select(by, "ts", "event_id", F.lit(1).alias("is_click")))
    before = W.partitionBy(by).orderBy("ts", "is_click", "event_id").rowsBetween(W.unboundedPreceding, -1)
    found = both.withColumn("search_id", F.last(F.when(F.col("is_click") == 0, F.col("event_id")), ignorenulls=True).over(before))
    return found.filter("is_click = 1").select(F.col("event_id").alias("click_id"), by, "search_id")
