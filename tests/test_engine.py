"""Search, maintenance, sources and streams on small inputs."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from fernquery.functions import notes
from fernquery.operators import filters, lexical, maintenance, ranking
from fernquery.plans import search
from fernquery.sources import vault
from fernquery.streaming import events


def corpus(spark):
    rows = [
        ("c1", "a/Golden Gate.md", "Golden Gate", ["sf/bridge"], {"price": ["10"]}, "A red bridge in the city. Golden light."),
        ("c2", "a/Golden Gate.md", "Golden Gate > Walk", ["sf/bridge"], {"price": ["10"]}, "Walk the bridge at dawn."),
        ("c3", "b/Park.md", "Park", ["sf"], {"Price": ["30"]}, "The park is golden in autumn and has cars."),
        ("c4", "b/Ocean.md", "Ocean", [], {}, "Waves."),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, note_path string, title string, tags array<string>, properties map<string,array<string>>, content string")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.8, 0.6]), ("c3", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    return search.Corpus.build(chunks, vectors, ["title", "content"])


def test_search_ranks_filters_and_dedups(spark):
    c = corpus(spark)
    got = search.search(c, "golden gate", [1.0, 0.0], 10).orderBy("rank").collect()
    assert got[0]["note_path"] == "a/Golden Gate.md"
    assert len({r["note_path"] for r in got}) == len(got)
    assert "Golden" in got[0]["snippet"]
    only = search.search(c, "golden [price>20]", [1.0, 0.0], 10, snippets=False).collect()
    assert [r["note_path"] for r in only] == ["b/Park.md"]
    none = search.search(c, "golden [price>x]", [1.0, 0.0], 10, snippets=False).collect()
    assert none == []
    without = search.search(c, "golden -walk", [1.0, 0.0], 10, snippets=False).collect()
    assert "a/Golden Gate.md" not in {r["note_path"] for r in without}
    browse = search.search(c, "#sf", None, 10).collect()
    assert {r["note_path"] for r in browse} == {"a/Golden Gate.md", "b/Park.md"}


def test_bound_is_an_upper_bound(spark):
    index = corpus(spark).index
    asked = lexical.query_frame(spark, "golden bridge")
    bound = index.bound(asked).first()["bound"]
    assert bound >= index.scores(asked).agg(F.max("score")).first()[0] - 1e-9


def test_properties_ignore_key_case_and_quotes(spark):
    df = spark.createDataFrame([(1, {"Rel": ["[[People/Ann|A]]", "x"]}), (2, {"rel": ['"7"']}), (3, None)], "id int, properties map<string,array<string>>")
    where = lambda q: [r["id"] for r in df.withColumns({"tags": F.array().cast("array<string>"), "note_path": F.lit("n")}).filter(filters.compile_filters(filters.parse(q)[1])).collect()]
    assert where("[rel:people/ann]") == [1]
    assert where("[rel=7]") == [2]
    assert where('[rel:"x"]') == [1]


def test_lww_batch_equals_stream(spark, tmp_path):
    rows = [("a", "s1", 5, 1, 0, False), ("a", "s1", 5, 2, 0, True), ("a", "s2", 3, 1, 0, False), ("b", "s1", 1, 1, 0, True), ("c", "s1", 2, 1, 0, False), ("c", "s2", 2, 9, 0, False)]
    schema = "id string, shard string, mtime long, seq long, off long, tombstone boolean"
    log = spark.createDataFrame(rows, schema)
    batch = {r["id"]: (r["mtime"], r["shard"]) for r in maintenance.merge_log(log).collect()}
    assert batch == {"a": (3, "s2"), "c": (2, "s2")}
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    stream = events.merge_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("lww").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("lww").collect():
        last[r["id"]] = (r["mtime"], r["shard"]) if r["live"] else None
    assert {k: v for k, v in last.items() if v} == batch


def test_incremental_equals_rebuild(spark):
    c = corpus(spark).chunks
    changed = c.filter("chunk_id = 'c3'").withColumn("content", F.lit("Now about bridges."))
    patched = maintenance.upsert(lexical.postings(c.filter("chunk_id <> 'c3'"), ["content"]).withColumn("k", F.col("chunk_id")), lexical.postings(changed, ["content"]).withColumn("k", F.col("chunk_id")), "k").drop("k")
    rebuilt = lexical.postings(maintenance.upsert(c, changed, "chunk_id"), ["content"])
    assert sorted(map(tuple, patched.collect())) == sorted(map(tuple, rebuilt.select(*patched.columns).collect()))


def test_vault_roundtrip(spark, tmp_path):
    (tmp_path / "v" / "sub").mkdir(parents=True)
    (tmp_path / "v" / "a.md").write_text("# A\n" + "word " * 30)
    (tmp_path / "v" / "sub" / "b.md").write_text("short")
    (tmp_path / "v" / "sub" / "c.txt").write_text("no")
    rows = vault.read_vault(spark, str(tmp_path / "v"), ["sub"])
    assert [r["note_path"] for r in rows.collect()] == ["a.md"]
    chunks = notes.chunk_notes(vault.read_vault(spark, str(tmp_path / "v")))
    assert {r["note_path"] for r in chunks.collect()} == {"a.md", "sub/b.md"}
    vault.write_version({"chunks": chunks}, str(tmp_path / "store"), 1, {"chunker": 1})
    assert vault.open_version(spark, str(tmp_path / "store"), {"chunker": 1})
    assert vault.open_version(spark, str(tmp_path / "store"), {"chunker": 2}) is None
    assert vault.open_version(spark, str(tmp_path / "none"), {}) is None


def test_records(spark):
    q = np.arange(-4, 4, dtype=np.int8)
    raw = vault.pack_record(q, 0.25, b"\x05")
    assert vault.unpack_record(raw, 8)[1] == 0.25
    assert vault.unpack_record(raw[:-1] + b"\x00", 8) is None or raw[-1] == 0
    shards = spark.createDataFrame([("s", bytearray(raw + raw))], "shard string, content binary")
    index = spark.createDataFrame([("x", "s", 0), ("y", "s", len(raw)), ("late", "s", 2 * len(raw))], "id string, shard string, off long")
    assert {r["id"]: list(r["q"]) for r in vault.read_records(shards, index, 8).collect()} == {"x": list(range(-4, 4)), "y": list(range(-4, 4))}


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(k, t + dt.timedelta(minutes=10 * k), k % 2, "error" if k % 3 == 0 else "view", 1.0) for k in range(30)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    for name, df in (("w", events.windowed(stream)), ("s", events.sessions(stream)), ("d", events.distinct(stream))):
        q = df.writeStream.format("memory").queryName(f"t_{name}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp{name}")).start()
        q.awaitTermination()
    assert spark.table("t_d").count() == 30
    assert spark.table("t_w").agg(F.sum("n")).first()[0] > 20
    batch = events.windowed(spark.read.schema(schema).parquet(str(tmp_path / "e")))
    assert batch.agg(F.sum("n")).first()[0] == 30


def test_delta_states(spark):
    live = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("new", 1, "n"), ("f", 1, "x")], "note_path string, mtime_ms long, hash string")
    stored = spark.createDataFrame([("a", 1, "q", 0, None), ("b", 1, "y", 0, None), ("c", 1, "q", 0, None), ("gone", 1, "q", 0, None), ("f", 1, "x", 2, "v0")], "note_path string, mtime_ms long, hash string, embed_failed int, embed_fail_version string")
    got = {r["note_path"]: r["state"] for r in maintenance.classify_delta(live, stored, "v1").collect()}
    assert got == {"a": "clean", "b": "clean", "c": "dirty", "new": "dirty", "gone": "deleted", "f": "dirty"}


def test_lexical_only_rows_take_the_floor(spark):
    df = spark.createDataFrame([("a", 0.2, 1.0), ("b", None, 1.0), ("c", 0.6, 0.0)], "chunk_id string, dense double, lexical double").withColumns({"coverage": F.lit(1.0), "bound": F.lit(2.0), "recency": F.lit(0.0), "boost": F.lit(0.0)})
    got = {r["chunk_id"]: r["dense_filled"] for r in ranking.fuse(df, ranking.PRODUCT).collect()}
    assert got == {"a": 0.2, "b": 0.2, "c": 0.6}
