"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame operations only.

Targets. Sources, by code point with null last, weigh `weights`, repeating, and share `total` of all words;
no target passes `most` times its source's words, and the excess is shared anew by weight (water filling,
solved in closed form over sources ordered by capacity per weight).

Draws. A hash of the document's id puts each document in one of `blocks` blocks of its source, so a hot source
is spread over as many keys as any other. A source's draws are its blocks in a permuted order, epoch
after epoch, until the target is met; the block in which it is met is divided once more into `blocks` sub-blocks,
and the documents of the one sub-block in which it is met give an equal share of their words. A source's draws
thus miss its target by less than a word for each document of one sub-block.

Splitting tree. The vector of block quotas of all sources is split over the output shards: each node splits its
vector in two halves by a draw from the multivariate hypergeometric law (one hypergeometric draw per source, each
given those before it), down to `2 ** levels` leaves. A leaf then takes the next run of each source's permuted blocks,
so shards are disjoint and together exact; `order_key` shuffles within a shard. All randomness comes from hashes of
the seed, so reruns agree.

Defined results: null or empty text has size 0 and takes 0; sources without words have target 0; a null source is a
source of its own; repeated rows share a block and are counted one by one; an empty table gives an empty
result; other columns don't take part, and their names can't clash with those made here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernquery.llm.common import WORD_PATTERN, cut, table


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    total: float = 1.5
    most: float = 2.0
    blocks: int = 1024
    levels: int = 4
    seed: int = 20240607


def _place(mix: Mix) -> list[Column]:
    key = F.xxhash64(F.lit(mix.seed), F.col("doc_id"), F.col("source"))
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD_PATTERN)).cast("long").alias("size"),
        F.col("source").isNull().alias("absent"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
        F.pmod(key, F.lit(mix.blocks)).cast("int").alias("block"),
        F.pmod(F.shiftright(key, 20), F.lit(mix.blocks)).cast("int").alias("sub"),
    ]


def sizes(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, source, size and the document's place: (absent, name) of the source, block, sub-block."""
    return docs.select(*_place(mix))


def targets(by_block: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: rank, source_size, weight, target, epochs (whole passes) and rest (words beyond them)."""
    sources = by_block.groupBy("absent", "name").agg(F.sum("words").alias("source_size"), F.count("*").alias("n_blocks"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in mix.weights]), (F.col("rank") % len(mix.weights) + 1).cast("int"))
    one = W.partitionBy()
    ordered = sources.withColumn("rank", F.row_number().over(one.orderBy("absent", "name")) - 1).withColumn("weight", weight)
    cap = F.lit(mix.most) * F.col("source_size")
    by_room = one.orderBy(cap / F.col("weight"), "rank")
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    level = (
        ordered.withColumn("capped_before", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_room.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("all_words", F.sum("source_size").over(one))
        .withColumn("level", (F.lit(mix.total) * F.col("all_words") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("full", cap / F.col("weight") <= F.col("level"))
        .withColumn("first_open", F.min(F.when(~F.col("full"), F.struct(cap / F.col("weight"), "rank", "level"))).over(one))
    )
    target = F.when(F.col("full") | F.col("first_open").isNull(), cap).otherwise(F.least(cap, F.col("first_open.level") * F.col("weight")))
    return (
        level.withColumn("target", target.cast("double"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
        .select("absent", "name", "rank", "source_size", "n_blocks", "target", "epochs", "rest")
    )


def permuted(parts: DataFrame, keys: list[str], piece: str, words: str, rest: str, mix: Mix) -> DataFrame:
    """Order the pieces of each key by a hash, and say what the rest takes of each: all, some or none of its words."""
    order = W.partitionBy(*keys).orderBy(F.xxhash64(F.lit(mix.seed + 1), *keys, F.col(piece)), piece)
    end = F.sum(words).over(order.rowsBetween(W.unboundedPreceding, 0))
    return (
        parts.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("before", end - F.col(words))
        .withColumn("takes", F.greatest(F.lit(0), F.least(F.col(words), F.col(rest) - F.col("before"))))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The number of marked balls among `drawn` of `total`, by inverting the distribution at u; weights are kept as logarithms."""
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked))
    high = F.least(marked, drawn)
    zero = F.lit(0.0)

    def up(log_weight: Column, k: Column) -> Column:
        return log_weight + F.log(((marked - k) * (drawn - k)).cast("double") / ((k + 1) * (total - marked - drawn + k + 1)).cast("double"))

    def over(steps: Column) -> Column:
        peak = F.aggregate(
            steps,
            F.struct(zero.alias("at"), zero.alias("top")),
            lambda a, k: let(up(a["at"], k), lambda w: F.struct(w.alias("at"), F.greatest(a["top"], w).alias("top"))),
            lambda a: a["top"],
        )
        return let(peak, lambda top: let(mass(steps, top), lambda m: found(steps, top, u * m)))

    def mass(steps: Column, top: Column) -> Column:
        return F.aggregate(
            steps,
            F.struct(zero.alias("at"), F.exp(-top).alias("sum")),
            lambda a, k: let(up(a["at"], k), lambda w: F.struct(w.alias("at"), (a["sum"] + F.exp(w - top)).alias("sum"))),
            lambda a: a["sum"],
        )

    def found(steps: Column, top: Column, goal: Column) -> Column:
        # the first count at which the summed weights reach the goal
        return F.aggregate(
            steps,
            F.struct(zero.alias("at"), F.exp(-top).alias("sum"), low.alias("x")),
            lambda a, k: let(
                up(a["at"], k),
                lambda w: F.struct(w.alias("at"), (a["sum"] + F.exp(w - top)).alias("sum"), F.when(a["sum"] < goal, k + 1).otherwise(a["x"]).alias("x")),
            ),
            lambda a: a["x"],
        )

    return F.when(high > low, let(F.sequence(low, F.greatest(low, high - 1)), over)).otherwise(low)


def split_tree(sources: DataFrame, mix: Mix) -> DataFrame:
    """(rank, ends): where each shard's run of a source's draws ends. `sources` has rank and draws."""
    tree = sources.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "draws"))), lambda x: x["draws"]).alias("quotas")).withColumn("node", F.lit(1).cast("long"))
    for depth in range(mix.levels):
        n = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        tree = tree.select("node", "quotas", n.alias("n")).withColumn("half", F.floor((F.col("n") + F.col("node") % 2) / 2).cast("long"))
        seats = F.transform("quotas", lambda x, i: F.struct(x.alias("k"), i.alias("i")))
        # a fold over the sources: what the node still has, what its left child still wants, and what each source gave
        tree = tree.withColumn("seats", seats).withColumn(
            "left",
            F.aggregate(
                "seats",
                F.struct(F.col("n").alias("have"), F.col("half").alias("want"), F.array().cast("array<bigint>").alias("out")),
                lambda a, s: _give(a, s, F.col("node"), mix.seed + 7 * depth),
                lambda a: a["out"],
            ),
        )
        tree = tree.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas")),
                )
            ).alias("half")
        ).select("half.node", "half.quotas")
    leaves = tree.select("node", F.posexplode("quotas").alias("rank", "quota"))
    ends = leaves.withColumn("end", F.sum("quota").over(W.partitionBy("rank").orderBy("node")))
    return ends.groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))


def _give(a: Column, s: Column, node: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(F.lit(seed), node, s["i"]), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return let(
        hypergeometric(a["have"], s["k"], a["want"], u),
        lambda x: F.struct((a["have"] - s["k"]).alias("have"), (a["want"] - x).alias("want"), F.concat(a["out"], F.array(x)).alias("out")),
    )


def plan(placed: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, blocks, subs): targets; the shards that each block's draws go to; the parts of blocks drawn in part."""
    keys = ["absent", "name"]
    by_sub = cut(placed.groupBy(*keys, "block", "sub").agg(F.sum("size").alias("words")))
    by_block = by_sub.groupBy(*keys, "block").agg(F.sum("words").alias("words"))
    sources = cut(targets(by_block, mix))
    own = W.partitionBy(*keys)
    blocks = permuted(by_block.join(sources, keys), keys, "block", "words", "rest", mix)
    blocks = blocks.withColumn("draws", (F.col("epochs") * F.col("n_blocks") + F.sum(F.when(F.col("takes") > 0, 1).otherwise(0)).over(own)).cast("long"))
    blocks = cut(blocks.select(*keys, "rank", "block", "words", "takes", "epochs", "n_blocks", "place", "draws"))
    ends = split_tree(blocks.select("rank", "draws").distinct(), mix)
    draw = lambda e: e * F.col("n_blocks") + F.col("place")
    shards = F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("epochs")), lambda e: (e < F.col("epochs")) | (F.col("takes") > 0)),
        lambda e: F.size(F.filter("ends", lambda end: end <= draw(e))),
    )
    split = blocks.filter("takes > 0 AND takes < words").select(*keys, "block", F.col("takes").alias("block_takes"))
    subs = permuted(by_sub.join(split, [*keys, "block"]), [*keys, "block"], "sub", "words", "block_takes", mix)
    subs = subs.select(*keys, "block", "sub", F.col("words").alias("sub_words"), F.col("takes").alias("sub_takes"))
    out = blocks.join(ends, "rank").select(*keys, "block", "words", "takes", "epochs", shards.alias("shards"))
    return sources.select(*keys, "source_size", "target"), out, subs


def decide(placed: DataFrame, mix: Mix) -> DataFrame:
    """Each row of `placed` with source_size, target, taken, part (the share of the last pass) and shards."""
    keys = ["absent", "name"]
    sources, blocks, subs = plan(placed.select(*keys, "block", "sub", "size"), mix)
    rows = placed.join(blocks, [*keys, "block"]).join(sources, keys).join(subs, [*keys, "block", "sub"], "left")
    part = (
        F.when(F.col("takes") >= F.col("words"), F.col("size"))
        .when(F.col("takes") <= 0, 0)
        .when(F.col("sub_takes") >= F.col("sub_words"), F.col("size"))
        .when(F.coalesce(F.col("sub_takes"), F.lit(0)) <= 0, 0)
        .otherwise(F.floor(F.col("size") * F.col("sub_takes") / F.col("sub_words")))
        .cast("long")
    )
    rows = rows.withColumn("part", part)
    taken = F.col("epochs") * F.col("size") + F.col("part")
    kept = F.when(F.col("part") > 0, F.col("shards")).otherwise(F.slice("shards", F.lit(1), F.col("epochs").cast("int")))
    return rows.withColumn("taken", taken.cast("long")).withColumn("shards", kept)


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shards (one for each copy) and order_key of every document."""
    rows = decide(cut(sizes(docs, mix)), mix)
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "shards", F.xxhash64(F.lit(mix.seed + 2), "doc_id").alias("order_key"))


def draw_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed documents: a row of `docs` for each copy drawn, with all its columns, dealt out by shard and
    shuffled in it. A document drawn in part stands in the last pass if at least half of it was drawn."""
    columns = docs.columns
    _, blocks, subs = plan(cut(sizes(docs, mix)).select("absent", "name", "block", "sub", "size"), mix)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *_place(mix)[3:])
    keys = ["absent", "name"]
    rows = rows.join(blocks, [*keys, "block"]).join(subs, [*keys, "block", "sub"], "left")
    whole = (F.col("takes") >= F.col("words")) | ((F.col("takes") > 0) & (2 * F.coalesce(F.col("sub_takes"), F.lit(0)) >= F.col("sub_words")))
    copies = F.when(whole, F.col("shards")).otherwise(F.slice("shards", F.lit(1), F.col("epochs").cast("int")))
    drawn = rows.select("row", F.posexplode(copies).alias("pass", "shard"))
    order = F.xxhash64(F.lit(mix.seed + 2), F.col("row.doc_id"), F.col("pass"))
    drawn = drawn.withColumn("at", order).repartition("shard", F.pmod("at", F.lit(64))).sortWithinPartitions("shard", "at")
    return drawn.select([F.col("row").getField(c).alias(c) for c in columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
