"""The ranked query: filters, three candidate arms, exact re-scoring, fusion, one row a note, snippets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernquery.functions import analyzer, notes
from fernquery.operators import dense, filters, lexical, ranking


@dataclass
class Corpus:
    """chunks: chunk_id, note_path, title, tags, properties, content (and date_ms, aliases); vectors: chunk_id, embedding."""

    chunks: DataFrame
    vectors: DataFrame
    index: lexical.Index

    @staticmethod
    def build(chunks: DataFrame, vectors: DataFrame, fields: list[str]) -> Corpus:
        return Corpus(chunks, vectors, lexical.Index.build(chunks, fields))


def search(corpus: Corpus, query: str, vector: list[float] | None, k: int = 10, profile: ranking.Profile = ranking.PRODUCT, context: filters.Context | None = None, now_ms: int = 0, fuzzy: bool = True, snippets: bool = True) -> DataFrame:
    """rank, note_path, chunk_id, title, score, the signals and a snippet. Statistics are the whole corpus's; filters only choose candidates."""
    spark = corpus.chunks.sparkSession
    text, found = filters.parse(query, context or filters.Context(dates=profile.epsilon > 0))
    chunks = corpus.chunks
    if "aliases" not in chunks.columns:
        chunks = chunks.withColumn("aliases", F.array().cast("array<string>"))
    if "date_ms" not in chunks.columns:
        chunks = chunks.withColumn("date_ms", F.lit(None).cast("long"))
    meta = chunks.drop("content")
    eligible = meta
    if found:
        eligible = eligible.filter(filters.compile_filters(found, date=F.col("date_ms")))
        if found.exclude:
            held = corpus.index.posts.filter(F.col("field").isin("title", "content") & F.col("term").isin(*found.exclude)).select("chunk_id", "term").join(meta.select("chunk_id", "note_path"), "chunk_id")
            eligible = filters.without_notes(eligible, held, found.exclude)
    if not text:
        rows = ranking.browse(eligible, "date_ms", k)
        return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("date_ms"), "note_path", "chunk_id"))).select("rank", "note_path", "chunk_id", "title", F.lit(0.0).alias("score"))
    caps = dense.pool_caps(corpus.index.total)
    asked = lexical.query_frame(spark, text)
    last = analyzer.query_terms(text)[-1:] or [None]
    words = lexical.query_list(text)
    terms = lexical.expand(asked, corpus.index, last[0], fuzzy) if fuzzy else words
    scored = corpus.index.scores(terms)
    base = eligible.select("chunk_id").join(scored, "chunk_id", "left").select("chunk_id", F.coalesce("score", F.lit(0.0)).alias("lexical"), F.coalesce("matched", F.lit(0)).alias("matched"))
    arms = [ranking.arm(base, "lexical", caps["bm25"], "chunk_id", 1)]
    dated = eligible.filter("date_ms IS NOT NULL").select("chunk_id", "date_ms")
    arms.append(ranking.arm(dated, "date_ms", caps["recency"], "chunk_id", 2))
    if vector is not None:
        q = F.array(*[F.lit(float(x)) for x in vector])
        near = corpus.vectors.join(eligible.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", dense.asymmetric(q, F.col("embedding")).alias("s"))
        arms.insert(0, ranking.arm(near, "s", caps["binary"], "chunk_id", 0))
    pool = ranking.union_of(*arms)  # at most the sum of the caps, 1250 rows
    rows = F.broadcast(pool)
    cand = corpus.vectors.join(rows.select("chunk_id"), "chunk_id")
    cos = cand.select("chunk_id", dense.cosine(F.array(*[F.lit(float(x)) for x in vector]), F.col("embedding")).alias("dense")) if vector is not None else pool.limit(0).select("chunk_id", F.lit(0.0).alias("dense"))
    known = corpus.index.known(words).withColumnRenamed("k", "asked_terms")
    full = meta.join(rows, "chunk_id").join(base, "chunk_id").join(cos, "chunk_id", "left").crossJoin(F.broadcast(corpus.index.bound(words))).crossJoin(F.broadcast(known))
    full = full.withColumn("coverage", F.when(F.col("asked_terms") <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.col("matched") / F.col("asked_terms"))))
    full = full.withColumn("recency", ranking.recency(F.col("date_ms"), now_ms, profile.half_life)).withColumn("boost", ranking.title_boost(text, F.col("note_path"), F.col("aliases"), profile.title_boost))
    fused = ranking.fuse(full, profile)
    order = [F.desc("score"), F.col("arm"), F.col("place")]
    best = ranking.best_of_note(fused, order).orderBy(*order).limit(k)
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    out = ranked.select("rank", "note_path", "chunk_id", "title", "score", "dense", "dense_n", "bm25_n", "hybrid", "recency", "boost")
    if not snippets:
        return out
    bodies = corpus.chunks.select("chunk_id", "content").join(F.broadcast(out), "chunk_id")  # at most k rows
    return with_snippets(bodies, text).select(*out.columns, "snippet")


def with_snippets(rows: DataFrame, query: str, length: int = 200) -> DataFrame:
    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = notes.passage_terms(query)
        for texts in batches:
            yield texts.map(lambda t: notes.snippet(t or "", terms, length))

    return rows.withColumn("snippet", cut(F.col("content")))
