"""Stores, logs, fields and the stored index against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fernquery.functions import fields, markup
from fernquery.operators import lexical, stores, telemetry
from fernquery.plans import upkeep  # noqa: F401 - its queries register themselves
from fernquery.plans.catalog import QUERIES
from fernquery.sources import store, vault


def test_delta_apply_equals_rebuild(spark):
    """Incremental passes give the table that building anew would give."""
    rng = random.Random(2)
    live = {f"n{k}": [f"n{k}-{j}-0" for j in range(3)] for k in range(30)}
    frame = lambda notes: spark.createDataFrame([(p, c) for p, cs in notes.items() for c in cs], "note_path string, chunk_id string")
    table = frame(live)
    for step in range(1, 3):
        states = []
        for k in range(32):
            p, what = f"n{k}", rng.choice(["clean", "dirty", "deleted"])
            if what == "deleted" and p in live:
                del live[p]
                states.append((p, "deleted"))
            elif what == "dirty" or p not in live:
                live[p] = [f"{p}-{j}-{step}" for j in range(rng.randrange(1, 4))]
                states.append((p, "dirty"))
            else:
                states.append((p, "clean"))
        table = stores.apply_delta(table, spark.createDataFrame(states, "note_path string, state string"), frame(live))
        assert sorted(r["chunk_id"] for r in table.collect()) == sorted(c for cs in live.values() for c in cs)


def test_stored_index_scores_like_a_fresh_one(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(20)), [rng.choice(words)], None if k % 5 else "w1 w2") for k in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, tags array<string>, title string")
    asked = lexical.query_list("w1 w7 w7 unknown")
    a = lexical.Index.build(chunks, ["content", "tags", "title"]).scores(asked)
    b = lexical.Index.stored(spark, "test index", chunks, ["content", "tags", "title"])
    c = b.scores(spark.createDataFrame(asked, "term string, source string, weight double"))
    got = [{r["chunk_id"]: (round(r["score"], 9), r["matched"]) for r in x.collect()} for x in (a, b.scores(asked), c)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 50
    assert b.known(asked).first()["k"] == 2
    again = store.once(spark, "test index", lambda: 1 / 0)
    assert set(again) == {"posts", "terms", "averages"}


def test_index_of_nothing(spark):
    empty = lexical.Index.stored(spark, "nothing", spark.createDataFrame([], "chunk_id long, content string"), ["content"])
    assert empty.total == 0 and empty.scores(lexical.query_list("a word")).count() == 0


def test_records_are_read_shard_by_shard(spark):
    import numpy as np

    made = [vault.pack_record(np.arange(8) - k, 0.5 + k, bytes([k])) for k in range(4)]
    size = len(made[0])
    shards = spark.createDataFrame([("a", bytearray(made[0] + made[1])), ("b", bytearray(made[2][:-1] + b"\0" + made[3]))], "shard string, content binary")
    index = spark.createDataFrame([("0", "a", 0), ("1", "a", size), ("2", "b", 0), ("3", "b", size), ("4", "b", 2 * size), ("5", "c", 0), ("6", "a", -1)], "id string, shard string, off long")
    got = {r["id"]: (r["q"][0], r["s"]) for r in vault.read_records(shards, index, 8).collect()}
    assert got == {"0": (0, 0.5), "1": (-1, 1.5), "3": (-3, 3.5)}


def test_signatures_and_gates(spark):
    files = spark.createDataFrame([("b", 2, 5, "x"), ("a", 1, None, "x"), ("c", 9, 9, "own")], "path string, size long, mtime long, device string")
    assert stores.signature(files, "own").first()["signature"] == "a:1:-1|b:2:5"
    assert stores.must_reconcile("s", "s", True) and stores.must_reconcile("s", None, False) and not stores.must_reconcile("s", "s", False)
    placed = stores.placed(spark.range(10), ["id"], 400, 3, 1000).collect()
    assert [(r["seq"], r["off"]) for r in placed][:5] == [(3, 0), (3, 400), (4, 0), (4, 400), (5, 0)]


def test_failed_texts_are_tried_alone(spark):
    rows = spark.createDataFrame([(str(k), f"n{k // 4}", "bad" if k == 5 else f"text {k}") for k in range(12)], "chunk_id string, note_path string, input string")

    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return [[1.0, float(len(t))] for t in texts]

    got = stores.embedded(rows, embed)
    assert {r["chunk_id"] for r in got.filter("embedding IS NULL").collect()} == {"5"}
    assert [tuple(r) for r in stores.quarantine(got).collect()] == [("n1", 4, 1, False)]
    assert abs(sum(x * x for x in stores.hashed_embedding("one two")) - 1) < 1e-12


def test_dates_and_presets(spark):
    assert fields.presets(dt.date(2026, 3, 9))[:3] == [("2026-03", "this month"), ("2026", "this year"), ("2025", "last year")]
    rows = spark.createDataFrame([("2026-02-30",), ("2026-05-01T23:30:00Z",), ("soon",), (None,)], "t string")
    assert [r["d"] for r in rows.select(fields.shown_day(F.col("t")).alias("d")).collect()] == ["2026-03-02", "2026-05-01", "", ""]


def test_markup_reads_what_it_writes():
    """Texts without markup pass through; masks keep every offset."""
    rng = random.Random(8)
    for _ in range(200):
        t = "".join(rng.choice("ab [](){}<>!|#`%\n/:.h") for _ in range(60))
        assert len(markup.masked(t)) == len(t)
        assert all(a == b or a in " \n" for a, b in zip(markup.masked(t), t, strict=True))
        markup.Prose().read(t)
        markup.plain_snippet(t)
        markup.tags_in(t)
    assert markup.Prose().read("plain words, nothing else.") == "plain words, nothing else."


def test_index_folds_once_and_reads_texts_once(spark):
    chunks = spark.createDataFrame([(1, "Été's Ashes ashes"), (2, "the boxes"), (2, "boxes"), (3, "")], "chunk_id long, content string")
    for rows in (lexical.field_terms(chunks, ["content"]), lexical.postings(chunks, ["content"])):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1  # each token was folded dozens of times
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    index = lexical.Index.stored(spark, "read once", chunks.select("chunk_id", counted(F.col("content")).alias("content")), ["content"])
    assert seen.value == 4
    assert {(r["chunk_id"], r["term"], r["tf"], r["len"]) for r in index.posts.collect()} == {(1, "ete", 1, 3), (1, "ash", 2, 3), (2, "box", 2, 2)}
    assert {(r["term"], r["df"]) for r in index.terms.collect()} == {("ete", 1), ("ash", 1), ("box", 1)}
    assert index.total == 4 and index.averages.first()["avglen"] == 5 / 4


def test_vocabulary_needs_no_postings(spark):
    chunks = spark.createDataFrame([(1, "Boxes box"), (2, "an ash")], "chunk_id long, content string")
    assert {r["term"] for r in lexical.stored_words(spark, "few words", chunks, ["content"]).collect()} == {"box", "ash"}
    assert not store.has(spark, "few words")
    lexical.Index.stored(spark, "few words", chunks, ["content"])
    assert {r["term"] for r in lexical.stored_words(spark, "few words", chunks, ["content"]).collect()} == {"box", "ash"}


def test_clean_markup_of_odd_texts(spark, tmp_path):
    """As the SQL has it: an empty text leaves the blank before it, and tabs and wide blanks stay."""
    texts = ["", "\n \n", "!#", "one\ttwo\u3000 \n three\r\n", "\u00a0x", None, "plain  words"]
    rows = [(k, t, "en", "src1", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["seen"], r["lost"]) for r in QUERIES["clean_markup"](spark, str(tmp_path)).collect()}
    lead = "See src1 and t alt x org p q bold end. "
    assert [got[k][0] for k in range(7)] == [lead, lead, lead, lead + "one\ttwo\u3000 three\r", lead + "x", None, lead + "plain words"]
    assert {lost for _, lost in got.values()} == {"a.tiff b.png People/en http://u.v https://www.x.org.uk/p-q?z=1"}


def test_overlaps_without_pairs(spark):
    """Against all pairs, with open spans, points and ties; and rows that all overlap are not paired."""
    rng = random.Random(4)
    ends = lambda x: x + rng.choice([0, 1, 3, 30, 400])
    spans = [(f"c{k}", x := rng.randint(0, 300), None if k % 40 == 0 else ends(x)) for k in range(150)]
    tasks = [(k, x := rng.randint(0, 300), ends(x)) for k in range(150)]
    want = {}
    for t, a, b in tasks:
        found = [(min(b, 1 << 62 if e is None else e) - max(a, s), s, c) for c, s, e in spans if s < b and (e is None or a < e)]
        if found:
            best = max(found)
            want[t] = (best[2], best[0])
    frames = spark.createDataFrame(spans, "context string, start long, end long"), spark.createDataFrame(tasks, "task_id long, start long, end long")
    for slot in (1, 7, 3600):
        assert {r["task_id"]: (r["context"], r["overlap"]) for r in telemetry.overlaps(*frames, slot).collect()} == want
    dense = spark.range(2000).selectExpr("id context", "id start", "id + 5000 end")
    found = telemetry.overlaps(dense, dense.withColumnRenamed("context", "task_id"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().replace("Join Cross", "")
    assert all(r["task_id"] == r["context"] for r in found.collect())


def test_one_row_group_is_dealt_to_all_cores(spark):
    """Splits of a file with one row group are empty but for one, however many there are; and a task's share is bounded."""
    from fernquery.sources import tables

    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = tables.read(spark, "/root/testdata/sf0.001", "documents")
        assert rows.rdd.getNumPartitions() > 4 and rows.select(F.spark_partition_id()).distinct().count() == 1
        assert tables.spread(rows).select(F.spark_partition_id()).distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
