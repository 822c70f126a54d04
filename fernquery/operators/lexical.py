"""Multi-field BM25+ over postings tables: index build, scores, coverage, bounds, expansions and synonyms.

Score of a term in a field: idf * (d + tf (k1 + 1) / (tf + k1 (1 - b + b len / avglen))), idf = ln(1 + (N - df + 0.5) / (df + 0.5)), with N the number
of chunks and len the number of indexed terms in the field. Query-side tables hold a few rows and are broadcast; postings stay put.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernquery.functions import analyzer
from fernquery.sources import store

FIELDS = {"title": 10.0, "aliases": 6.0, "tags": 3.0, "content": 3.0, "properties": 2.0, "headings": 3.0}
BOOSTED = FIELDS | {"aliases": 9.0, "tags": 2.0, "headings": 4.0}
NAME_FIELDS = ("title", "aliases")  # names keep their stopwords


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    d: float = 0.5
    coverage_power: float = 2.0


def _field_texts(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """chunk_id, field, text: a row for each field of a chunk."""
    kinds = dict(chunks.dtypes)
    held = {f: F.array_join(F.col(f), " ") if kinds[f].startswith("array") else F.col(f).cast("string") for f in fields}
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(c, F.lit("")).alias("text")) for f, c in held.items()])
    return chunks.select("chunk_id", F.explode(texts).alias("t")).select("chunk_id", "t.field", "t.text")


def _terms(field: Column, text: Column) -> Column:
    """The indexed terms of a field's text, as an array. Steps on the array keep the optimizer from moving a filter below the folding, which would then fold
    each token again for every place where the plural rules name it."""
    kept = F.filter(F.transform(analyzer.tokens(text), analyzer.fold), lambda t: (t != "") & (field.isin(*NAME_FIELDS) | ~t.isin(analyzer.STOPWORDS)))
    return F.transform(kept, analyzer.singular)


def field_terms(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """chunk_id, field, term: a row for each indexed occurrence; one pass over the chunks."""
    # an outer explosion: an inner one would be given a filter on the array's size, which makes the array twice
    return _field_texts(chunks, fields).select("chunk_id", "field", F.explode_outer(_terms(F.col("field"), F.col("text"))).alias("term")).filter("term IS NOT NULL")


def counted(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """chunk_id, field, len, term, tf. The texts of a chunk's field are brought together, so all its terms are counted as runs of one sorted array."""
    texts = _field_texts(chunks, fields).groupBy("chunk_id", "field").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    runs = texts.select("chunk_id", "field", F.sort_array(_terms(F.col("field"), F.col("text"))).alias("s"))
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda k: (k == 0) | (F.get("s", k) != F.get("s", k - 1)))
    runs = runs.select("chunk_id", "field", "s", F.when(F.size("s") > 0, first).alias("first"))  # a filter here would go below and make the array twice
    held = F.transform("first", lambda at, k: F.struct(F.get("s", at).alias("term"), (F.coalesce(F.get("first", k + 1), F.size("s")) - at).cast("long").alias("tf")))
    rows = runs.select("chunk_id", "field", F.size("s").cast("long").alias("len"), F.explode_outer(held).alias("t"))
    return rows.filter("t IS NOT NULL").select("chunk_id", "field", "len", "t.term", "t.tf")


def postings(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """chunk_id, field, term, tf."""
    return counted(chunks, fields).select("term", "field", "chunk_id", "tf")


def lengths(posts: DataFrame) -> DataFrame:
    return posts.groupBy("chunk_id", "field").agg(F.sum("tf").alias("len"))


def frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term", "field").agg(F.count("*").alias("df"))


def field_averages(lens: DataFrame, chunks_total: int | Column) -> DataFrame:
    """Average length over all chunks, also those whose field is empty."""
    n = F.lit(chunks_total) if isinstance(chunks_total, int) else chunks_total
    return lens.groupBy("field").agg((F.sum("len") / n).alias("avglen"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, average: Column, p: Bm25) -> Column:
    return p.d + tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * length / average))


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.select("term", "field", "chunk_id", "tf", "len", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))


@dataclass
class Index:
    """The tables of one corpus version. Statistics are those of the whole corpus, whatever a query filters."""

    posts: DataFrame  # term, field, chunk_id, tf, len, bucket
    terms: DataFrame  # term, field, df, bucket
    averages: DataFrame  # field, avglen
    total: int
    buckets: int = 16

    @staticmethod
    def build(chunks: DataFrame, fields: list[str], buckets: int = 16) -> Index:
        return Index._over(_bucketed(counted(chunks, fields), buckets), chunks.count(), buckets)

    @staticmethod
    def _over(posts: DataFrame, total: int, buckets: int) -> Index:
        """The index of postings that are there already."""
        return Index(posts, posts.groupBy("term", "field", "bucket").agg(F.count("*").alias("df")).select("term", "field", "df", "bucket"), field_averages(posts.select("field", F.col("tf").alias("len")), total), total, buckets)

    @staticmethod
    def stored(spark, name: str, chunks: DataFrame, fields: list[str], buckets: int = 16) -> Index:
        """The index of `name`, which the first call of an application builds and writes: postings and terms lie by bucket of the term, in its order.
        Terms and averages are counted from the postings as written, so texts are read once."""
        # a bucket's postings are sorted in several tasks
        laid = lambda df, *more: df.repartition("bucket", *more).sortWithinPartitions("bucket", "term")
        over = lambda held, total=0: Index._over(held["posts"], total, buckets)

        def averages(held: dict[str, DataFrame]) -> DataFrame:
            i = over(held, chunks.count())
            return i.averages.withColumn("total", F.lit(i.total))

        def make() -> dict[str, DataFrame]:
            posts = _bucketed(counted(chunks, fields), buckets)
            return {"posts": laid(posts, F.pmod(F.xxhash64("chunk_id"), F.lit(8))), "terms": lambda held: laid(over(held).terms), "averages": averages}

        held = store.once(spark, name, make, {"posts": ["bucket"], "terms": ["bucket"]})
        first = held["averages"].select("total").first()
        return Index(held["posts"], held["terms"], held["averages"].drop("total"), first["total"] if first else 0, buckets)

    def _of(self, table: DataFrame, words: list[str]) -> DataFrame:
        """Rows of a query's words: whole buckets and row groups are skipped."""
        spark = table.sparkSession
        where = [r["b"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64("w"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()] if words else []
        return table.filter(F.col("bucket").isin(where) & F.col("term").isin(words))

    def weighted(self, terms: DataFrame | list[tuple[str, str, float]], boosts: dict[str, float] = FIELDS, p: Bm25 = Bm25()) -> DataFrame:
        """chunk_id, source, part of every match; terms: term, source, weight, one row for each occurrence in the query. A list is a query's own words,
        which choose the files to read; a frame may hold any number of expansions, and the planner chooses its join."""
        spark = self.posts.sparkSession
        posts, df = self.posts, self.terms
        if isinstance(terms, list):
            words = sorted({t for t, _, _ in terms})
            posts, df = self._of(posts, words), self._of(df, words)
            terms = spark.createDataFrame(terms, "term string, source string, weight double")
        boost = F.create_map(*[x for f, w in boosts.items() for x in (F.lit(f), F.lit(w))])
        idfs = df.select("term", "field", "df").join(terms, "term").join(F.broadcast(self.averages), "field")  # averages: a row a field
        hits = posts.select("term", "field", "chunk_id", "tf", "len").join(idfs, ["term", "field"])
        part = F.col("weight") * F.coalesce(boost[F.col("field")], F.lit(0.0)) * idf(F.lit(self.total), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("avglen"), p)
        return hits.select("chunk_id", "source", "term", part.alias("part"))

    def scores(self, terms: DataFrame | list, boosts: dict[str, float] = FIELDS, p: Bm25 = Bm25()) -> DataFrame:
        """chunk_id, score, matched (distinct query terms hit, expansions counted for their source)."""
        return self.weighted(terms, boosts, p).groupBy("chunk_id").agg(F.sum("part").alias("score"), F.countDistinct("source").alias("matched"))

    def bound(self, asked: DataFrame | list, boosts: dict[str, float] = FIELDS, p: Bm25 = Bm25()) -> DataFrame:
        """One row, bound: the sum over query occurrences of the best single-term score."""
        spark = self.posts.sparkSession
        times: dict[str, int] = {}
        for t, _, _ in _own(asked):
            times[t] = times.get(t, 0) + 1
        each = self.weighted([(t, t, 1.0) for t in times], boosts, p).groupBy("term", "chunk_id").agg(F.sum("part").alias("s")).groupBy("term").agg(F.max("s").alias("best"))
        occurrences = spark.createDataFrame(list(times.items()), "term string, times int")
        return each.join(F.broadcast(occurrences), "term").agg(F.coalesce(F.sum(F.col("best") * F.col("times")), F.lit(0.0)).alias("bound"))

    def known(self, asked: DataFrame | list) -> DataFrame:
        """One row, k: how many of a query's distinct words the corpus has."""
        return self._of(self.terms, sorted({t for t, _, _ in _own(asked)})).agg(F.countDistinct("term").alias("k"))

    def vocabulary(self) -> DataFrame:
        return self.terms.select("term").distinct()


def stored_words(spark, name: str, chunks: DataFrame, fields: list[str]) -> DataFrame:
    """term: the vocabulary of `name`, from its index if this application has built one; else it is stored by itself, for which no postings are made."""
    if store.has(spark, name):
        return Index.stored(spark, name, chunks, fields).vocabulary()
    return store.once(spark, f"{name} words", lambda: {"words": field_terms(chunks, fields).select("term").distinct()})["words"]


def _own(asked: DataFrame | list) -> list[tuple[str, str, float]]:
    """A query's own words, which are few, as a list."""
    return asked if isinstance(asked, list) else [(r["term"], r["source"], r["weight"]) for r in asked.collect()]


def query_list(query: str) -> list[tuple[str, str, float]]:
    return [(t, t, 1.0) for t in analyzer.query_terms(query)]


def query_frame(spark, query: str) -> DataFrame:
    return spark.createDataFrame(query_list(query), "term string, source string, weight double")


def prefix_terms(vocabulary: DataFrame, last: str) -> DataFrame:
    """Longer vocabulary terms that start with the query's last term, weighing 0.375 * len / len'."""
    n = F.length("term")
    return vocabulary.filter(F.col("term").startswith(last) & (n > len(last))).select("term", F.lit(last).alias("source"), (0.375 * len(last) / n).alias("weight")) if len(last) >= 3 else vocabulary.limit(0).select("term", F.lit(last).alias("source"), F.lit(0.0).alias("weight"))


def edits_allowed(term: str) -> int:
    if len(term) <= 2 or any(c.isdigit() for c in term) or analyzer.has_cjk(term):
        return 0
    return 1 if len(term) <= 5 else 2


def fuzzy_terms(vocabulary: DataFrame, terms: list[str], decay: float = 0.45) -> DataFrame:
    """Vocabulary terms within the allowed edits of each query term; weight decay * len / (len + edits), the engine's own choice."""
    spark = vocabulary.sparkSession
    asked = spark.createDataFrame([(t, edits_allowed(t)) for t in terms if edits_allowed(t)] or [], "source string, allowed int")
    near = F.abs(F.length("term") - F.length("source")) <= F.col("allowed")
    pairs = vocabulary.join(F.broadcast(asked), near & (F.col("term") != F.col("source")))
    pairs = pairs.withColumn("edits", F.levenshtein("term", "source")).filter(F.col("edits") <= F.col("allowed"))
    return pairs.select("term", "source", "edits", (decay * F.length("source") / (F.length("source") + F.col("edits"))).alias("weight"))


def synonyms(members: DataFrame, df_share: DataFrame | None = None, ceiling: float = 0.05, weight: float = 0.8) -> DataFrame:
    """source, mate, weight from (class_id, token): tokens of more than one class are ambiguous and neither trigger nor join; very common mates stay out."""
    fine = members.filter((F.length("token") >= 2) & ~F.col("token").rlike("^[0-9]+$")).distinct()
    clear = fine.groupBy("token").agg(F.countDistinct("class_id").alias("classes")).filter("classes = 1").select("token")
    edges = fine.join(clear, "token", "left_semi")
    mates = edges.withColumnRenamed("token", "source").join(edges.withColumnRenamed("token", "mate"), "class_id").filter("source <> mate")
    if df_share is not None:
        mates = mates.join(df_share.filter(F.col("share") > ceiling).select(F.col("term").alias("mate")), "mate", "left_anti")
    return mates.select("source", "mate", F.lit(weight).alias("weight")).distinct()


def expand(terms: DataFrame, index: Index, last: str | None = None, fuzzy: bool = True, mates: DataFrame | None = None) -> DataFrame:
    """The query's terms with prefix, fuzzy and synonym expansions; a term reached by several ways keeps the best weight, prefix before fuzzy."""
    out = terms.select("term", "source", "weight", F.lit(0).alias("way"))
    words = [r["term"] for r in terms.select("term").distinct().collect()]  # a query's terms
    vocabulary = index.vocabulary()
    if last:
        out = out.unionByName(prefix_terms(vocabulary, last).withColumn("way", F.lit(1)))
    if fuzzy:
        out = out.unionByName(fuzzy_terms(vocabulary, words).select("term", "source", "weight", F.lit(2).alias("way")))
    if mates is not None:
        out = out.unionByName(mates.join(F.broadcast(terms.select("source").distinct()), "source").select(F.col("mate").alias("term"), "source", "weight", F.lit(3).alias("way")))
    derived = out.filter("way > 0").groupBy("term", "source").agg(F.min_by("weight", "way").alias("weight"))
    known = terms.select("term", "source").distinct()
    return terms.select("term", "source", "weight").unionByName(derived.join(F.broadcast(known), ["term", "source"], "left_anti").select("term", "source", "weight"))
