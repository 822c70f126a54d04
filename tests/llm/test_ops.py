"""The training-data operators against brute force on small fixtures, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernquery.llm import collisions, contextmix, linechunks, mixing, nearcopies, orderhash, packing, quality, suffixes, transcripts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, size long, label string, at_id long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = text(rng, 90)
    edited = base.split()
    edited[40] = "changed"
    passage = text(rng, 60)
    lines = "\n".join(text(rng, 6) for _ in range(9))
    out = [
        (1, base), (2, base), (3, " ".join(edited)), (4, text(rng, 20) + " " + passage + " " + text(rng, 9)), (5, passage + " " + text(rng, 30)), (6, None), (7, ""), (8, "   \n\t"),
        (9, "one two"), (10, "é" * 300), (11, text(rng, 4000)), (12, lines), (13, "intro line\n" + lines), (14, "x"), (14, "x"), (None, text(rng, 12)), (15, "ab " * 400),
    ]
    return [(i, t, "en", None if i == 9 else "s" + str((i or 0) % 3), len(t or ""), "r", 5, 6, "l", 7) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_round_trip(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter((r[0], tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    limits = packing.Limits(tokens=64, segments=5, loss=50, pool=16)
    got = packing.pack(docs, limits).collect()
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for doc, own in pieces.items():
        ids = sorted(own, key=lambda r: r["start"])
        if doc != 14:  # two rows have that id
            assert want[(doc, tuple(np.frombuffer(b"".join(bytes(r["ids"]) for r in ids), "<u4").tolist()))] == 1
    assert sum(r["length"] for r in got) == sum(len(k[1]) * n for k, n in want.items())
    for own in seqs.values():
        own = sorted(own, key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
        assert sum(r["length"] for r in own) <= 64 and len(own) <= 5 and sum(r["loss_tokens"] for r in own) <= 50
    assert packing.pack(none).count() == 0


def test_encoder_equals_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(packing.vocabulary())
    rng = random.Random(1)
    cases = ["", " ", "  a", "a  b", "a \n b", "a\n\n b ", " it's  we'll\t x", "  x   y", "<|endoftext|> z", "a <|endoftext|><|endoftext|>b  <|endof", "a\u0085b \x1c c", "日本 語"]
    cases += ["".join(rng.choice("ab '\n\t.é 5") for _ in range(40)) for _ in range(300)]
    for c in cases:
        assert np.frombuffer(encode(c), "<u4").tolist() == t.encode(c, add_special_tokens=False).ids, repr(c)


def removed_windows(rows):
    """(id, bytes, removed, spans, kept) of each row by brute force: documents in order of id (none last), of texts of one id in any order that
    is given by their key; a copy of a row before it loses all that it has."""
    every = sorted(((i is None, i if i is not None else 0, key, (t or "").encode()) for i, t, key in rows))
    seen: dict[bytes, tuple] = {}
    for k, (_, _, _, b) in enumerate(every):
        for s in range(len(b) - 99):
            seen.setdefault(b[s : s + 100], (k, s))
    out = []
    for k, (late, i, _, b) in enumerate(every):
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - 99):
            if seen[b[s : s + 100]] != (k, s):
                gone[s : s + 100] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((None if late else i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


def test_suffixes(spark, docs, rows, none):
    def check(df, given):
        keys = {(r["late"], r["at_id"], r["text"]): r["text_key"] for r in suffixes._texts(df).collect()}
        order = {(r["late"], r["text"]): r["at_id"] for r in suffixes._texts(df).collect()}
        ranked = [(i, t, (order[(i is None, t or "")] if i is None else 0, keys[(i is None, order[(True, t or "")] if i is None else i, t or "")])) for i, t in given]
        for rule in (suffixes.Repeats(), suffixes.Repeats(buffer=1)):
            got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup(df, rule).collect()]
            assert sorted(got, key=str) == removed_windows(ranked)

    check(docs, [(r[0], r[1]) for r in rows])
    rng = random.Random(41)
    a, b, c = text(rng, 60), text(rng, 60), text(rng, 60)
    some = [(None, a), (None, "x " + a), (None, b), (None, b), (5, c), (5, c[50:] + a[:200]), (5, c), (6, c[:150] + b[30:170]), (7, text(rng, 50)), (None, text(rng, 50)), (None, "")]
    check(spark.createDataFrame(some, "doc_id long, text string").repartition(3), some)
    phrase = text(rng, 9)[:60]
    many = [(k, text(rng, 12) + phrase + text(rng, 12) + (a[:130] if k % 3 == 0 else "")) for k in range(60)]
    check(spark.createDataFrame(many, "doc_id long, text string").repartition(5), many)
    assert suffixes.dedup(none).count() == 0


def test_radix_passes():
    """Groups that are left at full depth are exactly the windows of equal bytes; digits compare like bytes."""
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    for length in (8, 13, 20):
        begin = np.arange(0, 3900)
        live, group = suffixes.radix(data, begin, begin * 0, length)
        want = collections.defaultdict(list)
        for s in begin.tolist():
            want[data[s : s + length].tobytes()].append(s)
        got = collections.defaultdict(list)
        for s, g in zip(live.tolist(), group.tolist(), strict=True):
            got[g].append(s)
        assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)
    words = suffixes.words_at(data, np.arange(100))
    assert sorted(range(100), key=lambda k: data[k : k + 8].tobytes()) == np.argsort(words, kind="stable").tolist()


def test_near_copies(docs, rows, none):
    bags = {}
    for k, r in enumerate(rows):
        w = (r[1] or "").split()
        bags[k] = collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(bags, 2):
        both, all_ = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
        if (rows[a][1] or "") == (rows[b][1] or "") or (all_ and both / all_ >= 0.8):
            parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in bags:
        groups[find(k)].append(rows[k][0])
    want = {tuple(sorted(g, key=str)) for g in groups.values()}
    got = collections.defaultdict(list)
    for r in nearcopies.classes(docs).collect():
        got[(r["class_id"], r["text_key"] if r["class_id"] is None else b"")].append(r["doc_id"])
    assert {tuple(sorted(g, key=str)) for g in got.values()} == want
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(want)
    assert nearcopies.classes(none).count() == 0


def test_bag_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 62, 200).astype(np.uint64)
    a = rng.integers(0, 6, 200)
    b = np.maximum(0, a + rng.integers(-1, 2, 200))
    sig = [nearcopies.bag_signatures(keys[w > 0], w[w > 0], np.zeros(int((w > 0).sum()), int), 1, 6000)[0] for w in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.025


def test_near_copies_of_a_hub(spark):
    """Edited copies of one text that are similar to it and not to one another are one class."""
    rng = random.Random(5)
    base = text(rng, 150).split()
    made = []
    for k in range(60):
        w = list(base)
        for j in rng.sample(range(5, 145), 2):
            w[j] = f"new{k}_{j}"
        made.append((k + 100, " ".join(w)))
    df = spark.createDataFrame([*made, (999, " ".join(base)), (5, text(rng, 150))], "doc_id long, text string")
    sizes = sorted(r["n"] for r in nearcopies.classes(df).groupBy("class_id").agg(F.count("*").alias("n")).collect())
    assert sizes == [1, 61]


def test_near_copies_of_near_copies(spark):
    """Copies of edited copies, which link to one another but not to the text they all come from, against brute force over all pairs."""
    rng = random.Random(21)

    def edit(words, n):
        out = list(words)
        for j in rng.sample(range(len(out)), n):
            out[j] = f"new{rng.randrange(10**6)}"
        return out

    base = text(rng, 150).split()
    made = [base]
    for _ in range(40):
        child = edit(base, rng.choice((4, 5, 6, 7)))
        made += [child, *(edit(child, rng.choice((1, 2, 3))) for _ in range(rng.randrange(4)))]
    bags = [collections.Counter(tuple(w[j : j + 5]) for j in range(146)) for w in made]
    parent = list(range(len(made)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(made)), 2):
        same = sum((bags[a] & bags[b]).values())
        if same / (292 - same) >= 0.8:
            parent[find(a)] = find(b)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(made)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.classes(df).collect()}
    least = {}
    for k in range(len(made)):
        least.setdefault(find(k), k)
    assert got == {k: least[find(k)] for k in range(len(made))}
    assert 10 < len(least) < len(made) - 10


def test_signatures_of_many_short_rows_are_bounded():
    """Ten thousand short rows take no more memory than the bytes of a slice would, and have the bands of the rows one by one."""
    import tracemalloc

    rng = random.Random(4)
    texts = [text(rng, 7) for _ in range(10_000)]
    cut_ = lambda some: (np.frombuffer("".join(some).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in some])]))
    tracemalloc.start()
    bands, has = nearcopies.bands_of(*cut_(texts), nearcopies.Near())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    assert has.all() and bands.shape == (10_000, 25)
    for k in (0, 1023, 1024, 9_999):
        assert (nearcopies.bands_of(*cut_(texts[k : k + 1]), nearcopies.Near())[0][0] == bands[k]).all()


def test_signatures_of_long_rows_take_bounded_memory(monkeypatch):
    """Four MB of long rows are worked on in slices of one MB, and have the bands of the rows one by one."""
    import tracemalloc

    from fernquery.llm.common import RangeHash

    monkeypatch.setattr(RangeHash, "_up", RangeHash._up[:1])  # as in a new worker
    monkeypatch.setattr(RangeHash, "_down", RangeHash._down[:1])
    rng = random.Random(6)
    texts = [text(rng, 10_000) for _ in range(60)]
    cut_ = lambda some: (np.frombuffer("".join(some).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in some])]))
    data, at = cut_(texts)
    tracemalloc.start()
    bands, has = nearcopies.bands_of(data, at, nearcopies.Near())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 4_000_000 and peak < 80 << 20
    assert has.all() and bands.shape == (60, 25)
    for k in (0, 12, 13, 59):
        assert (nearcopies.bands_of(*cut_(texts[k : k + 1]), nearcopies.Near())[0][0] == bands[k]).all()


def test_last_pairs_join_items_once(spark, monkeypatch):
    """The pairs that differ from their hub alike are found, and rows of items meet no other table than that of common items."""
    hub = set(range(100))
    nodes = {0: hub, 1: hub - set(range(12)) | set(range(1000, 1012)), 2: hub - set(range(12)) | set(range(1000, 1011))}
    nodes |= {k: hub - set(range(12 * k, 12 * k + 12)) | set(range(1000 * k, 1000 * k + 12)) for k in (3, 4, 5)}
    held = [(k, np.array(sorted(x), dtype=np.uint64).tobytes()) for k, x in nodes.items()]
    items = spark.createDataFrame(held, "node long, items binary")
    open_ = spark.createDataFrame([(7, k, 0, k) for k in nodes], "bucket long, node long, leader long, label long")
    hubs = open_.filter("node = 0").select("bucket", F.struct("node", "label").alias("to"))
    known = spark.createDataFrame([(k, 0, len(x & hub), len(x), 100) for k, x in nodes.items() if k], "a long, b long, same long, size_a long, size_b long")
    plans, compact = {}, nearcopies.compact

    def planned(df):
        plans["rest" in df.columns] = df._jdf.queryExecution().optimizedPlan().toString()
        return compact(df)

    monkeypatch.setattr(nearcopies, "compact", planned)
    got = {frozenset((r["a"], r["b"])) for r in nearcopies.last_pairs(open_, hubs, known, items, nearcopies.Near(), 6).collect()}
    want = {frozenset(x) for x in itertools.combinations(range(1, 6), 2) if len(nodes[x[0]] & nodes[x[1]]) >= 0.8 * len(nodes[x[0]] | nodes[x[1]])}
    assert want == {frozenset((1, 2))} <= got
    assert plans[True].count("Join ") == 1


def test_one_of_each_class(spark):
    """One row stays of each class, also where ids are null or repeated."""
    rng = random.Random(22)
    a, b, c = (text(rng, 120) for _ in range(3))
    rows = [(None, a), (None, a), (None, a + " x"), (3, b), (3, c), (3, c), (4, c + " y"), (5, b), (None, b), (6, None), (None, "")]
    kept = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(None, next(r["text"] for r in kept if r["doc_id"] is None)), (3, b), (3, c), (6, None)], key=str)
    assert next(r["text"] for r in kept if r["doc_id"] is None) in (a, a + " x")


def test_line_chunks(docs, rows, none):
    rule = linechunks.Lines()
    done = {(r["doc_id"], r["n_chars"]): r for r in linechunks.dedup(docs, rule, counts=True).collect()}
    assert set(docs.columns) < set(linechunks.dedup(docs, rule, counts=True).columns)
    seen, pairs = set(), set()
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = np.frombuffer((r[1] or "").encode(), np.uint8)
        lines = (r[1] or "").splitlines(keepends=True)
        gone, own, at = [False] * len(lines), set(), 0
        for _, s, e, n in zip(*linechunks.chunks(b, np.array([0, len(b)]), rule), strict=True):
            part = b[s:e].tobytes().removesuffix(b"\n")
            if n > 1 and (part in seen or part in own):
                gone[at : at + n] = [True] * n
            own.add(part) if n > 1 else None
            at += n
        mine = [(x, y.removesuffix("\n")) for x, y in itertools.pairwise(lines)]
        k = 0
        while k < len(mine):  # runs of pairs that stand in earlier documents
            stop = k
            while stop < len(mine) and mine[stop] in pairs:
                stop += 1
            if stop > k and len(" ".join(lines[k : stop + 1]).split()) > rule.words:
                gone[k : stop + 1] = [True] * (stop + 1 - k)
            k = max(stop, k + 1)
        seen |= own
        pairs |= set(mine)
        got = done[(r[0], len(r[1] or ""))]
        assert (got["text"] or "") == "".join(x for x, g in zip(lines, gone, strict=True) if not g) and got["n_removed"] == sum(gone)
    assert done[(13, len("intro line\n" + rows[11][1]))]["n_removed"] > 0
    assert linechunks.dedup(none).count() == 0


def test_line_chunks_of_null_and_repeated_ids(spark):
    """Of copies without an id, or of one id, the first stays; different texts of one id are judged each by its own bytes."""
    rng = random.Random(14)
    a, b, c = ("\n".join(text(rng, 12) for _ in range(5)) for _ in range(3))
    own = "\n".join(text(rng, 30) for _ in range(3))
    rows = [(None, a), (None, a), (None, "own line\n" + b), (7, b), (7, c + "\n" + b), (8, c), (9, own), (9, own), (None, "single"), (None, "single"), (10, "single")]
    got = collections.defaultdict(list)
    for r in linechunks.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), counts=True).collect():
        got[r["doc_id"]].append((r["text"], r["n_removed"]))
    assert sorted(got[None])[0] == ("", 5) and {a, "single"} < {t for t, _ in got[None]}
    assert [t for t, _ in got[None]].count("single") == 2 and got[10] == [("single", 0)]
    assert sum(t == "" for t, _ in got[None]) == 1
    assert sorted(got[9]) == sorted([("", 3), (own, 0)])
    assert got[8] == [("", 5)]
    kept = "".join(t for t, _ in got[7])
    assert kept.count(b.split("\n")[2]) == 1 and c in kept and b.split("\n")[2] not in "".join(t for t, _ in got[None])


def test_line_chunks_of_copies(spark):
    """A copy of a text of several lines comes out empty, with and without a line feed at its end."""
    rng = random.Random(12)
    made = ["\n".join(text(rng, 5) for _ in range(2 + k)) for k in range(70)]
    rows = [(k, t) for k, t in enumerate(made)] + [(100 + k, t) for k, t in enumerate(made)] + [(200 + k, t + "\n") for k, t in enumerate(made)]
    done = {r["doc_id"]: r["text"] for r in linechunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(done[k] == t for k, t in enumerate(made))
    assert {done[k] for k in done if k >= 100} == {""}


def test_repeated_passages_of_lines(spark):
    """Passages of two and more lines and over 50 words go from later documents, wherever chunks end, single lines and short passages are no passages."""
    rng = random.Random(13)
    rows, want = [], {}
    for k in range(60):
        n = 2 + k % 4
        passage = [text(rng, 52 // n + 1) for _ in range(n)]
        some = lambda: [text(rng, 9) for _ in range(rng.randrange(1, 5))]
        rows.append((k, "\n".join([*some(), *passage] + some() * (k % 3 > 0))))
        before, after = some(), some()
        rows.append((100 + k, "\n".join([*before, *passage, *after])))
        want[100 + k] = (before, passage, after)
        rows.append((200 + k, "\n".join([before[-1], text(rng, 60), passage[0], text(rng, 9)])))
        want[200 + k] = ([rows[-1][1]], [], [])
    done = {r["doc_id"]: r["text"] for r in linechunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (before, passage, after) in want.items():
        assert done[k] == "\n".join([*before, *after])
    assert all(done[k] == t for k, t in rows if k < 100)


def test_mixing(docs, none):
    got = mixing.mix_documents(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["taken"] <= 2 * r["size"] and len(r["shards"]) <= 2
    total = sum(r["size"] for r in got)
    assert abs(sum(own[0]["target"] for own in by.values()) - 1.5 * total) < 1e-6 * total
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= len(own) + 1
    key = lambda r: (str(r["doc_id"]), r["taken"], r["shards"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix_documents(docs.repartition(5)).collect()))
    assert mixing.draw_documents(docs).columns == docs.columns
    assert mixing.mix_documents(none).count() == 0 and mixing.draw_documents(none).count() == 0


def test_hypergeometric_law(spark):
    n, k, d = 30, 11, 13
    u = (F.col("id") + 0.5) / 20000
    got = spark.range(20000).select(mixing.hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(d).cast("long"), u).alias("x")).groupBy("x").count().collect()
    for r in got:
        p = math.comb(k, r["x"]) * math.comb(n - k, d - r["x"]) / math.comb(n, d)
        assert abs(r["count"] / 20000 - p) < 2e-4


def test_order_hash(docs, rows, none):
    rule = orderhash.Order()
    got = orderhash.fingerprints(docs, rule).select("text", orderhash.written(F.col("cells")).alias("f"), orderhash.likeness(F.col("cells"), F.col("cells")).alias("own")).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r["text"]].add(r["f"])
        assert r["own"] == 1.0
    assert all(len(v) == 1 for v in by.values())
    pairs = orderhash.with_next(orderhash._slim(docs), {"cells": orderhash.cells(F.col("text"), rule)}).select("doc_id", "text", F.col("next.text").alias("n")).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = collections.Counter((order[k], order[(k + 1) % len(order)][1]) for k in range(len(order)))
    assert collections.Counter(((r["doc_id"], r["text"]), r["n"]) for r in pairs) == want
    assert orderhash.fingerprints(none).count() == 0


def test_order_hash_feels_order(spark):
    rng = random.Random(2)
    a = text(rng, 400).split()
    half = " ".join(a[200:] + a[:200])
    few = list(a)
    few[100] = "changed"
    df = spark.createDataFrame([(1, " ".join(a), half, " ".join(few))], "doc_id long, a string, half string, few string")
    c = lambda x: orderhash.cells(F.col(x), orderhash.Order())
    r = df.select(orderhash.likeness(c("a"), c("half")).alias("moved"), orderhash.likeness(c("a"), c("few")).alias("edited")).first()
    assert r["edited"] > 0.85 > 0.7 > r["moved"]  # moved halves share nearly all k-mers but not their order


def test_collisions(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(20, 16))
    v = centre[rng.integers(0, 20, 900)] + 0.4 * rng.normal(size=(900, 16))
    rows = [(int(k), [float(x) for x in row], 1) for k, row in enumerate(v)]
    bad = [(2000, None, 1), (2050, [0.0] * 16, 1), (2100, [float("nan")] * 16, 1), (2150, [None] * 16, 1), (None, [1.0] * 16, 1), (2200, [1.0] * 3, 1)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, rank int")
    got = collisions.search(df, df.filter("vec_id % 50 = 0"), 5, collisions.Collide(block=300)).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 900, 50):
        s = u @ u[q]
        s[q] = -9
        want = sorted(range(900), key=lambda k: (-s[k], k))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(want))
        total += 5
    assert hit / total >= 0.9
    assert {r["query_id"] for r in got} == set(range(0, 900, 50))
    few = df.filter("vec_id < 3")
    assert collisions.search(few, few, 5).count() == 6
    assert collisions.search(df.limit(0), df.limit(0), 5).count() == 0


def test_collisions_among_copies():
    """Of equal vectors the smallest ids are the nearest, however many there are and wherever they stand."""
    rng = np.random.default_rng(11)
    for d, n in itertools.product((16, 64, 100), (5, 40, 63, 64, 70, 301, 1001)):
        v, others = rng.normal(size=d), rng.normal(size=(90, d))
        x = np.concatenate([others[:45], np.repeat(v[None], n, axis=0), others[45:]])
        q = np.stack([v + 0.01 * rng.normal(size=d), v])
        _, found, scores = collisions.search_block(np.arange(len(x)), x, np.array([-1, -2]), q, 5, collisions.Collide())
        assert found.tolist() == [45, 46, 47, 48, 49] * 2
        assert len(set(scores[:5])) == len(set(scores[5:])) == 1


def test_transcripts(spark):
    model = transcripts.Model()
    rng = random.Random(6)
    for _ in range(20):
        seen = [(rng.randrange(4), rng.randrange(8), 0) for _ in range(4)]
        e = model.emit(seen)
        best = max(itertools.product(range(6), repeat=4), key=lambda p: model.start[p[0]] + e[0, p[0]] + sum(model.move[p[t - 1], p[t]] + e[t, p[t]] for t in range(1, 4)))
        score = lambda p: model.start[p[0]] + e[0, p[0]] + sum(model.move[p[t - 1], p[t]] + e[t, p[t]] for t in range(1, 4))  # noqa: B023, E731
        assert abs(score(model.viterbi(seen)) - score(best)) < 1e-9
    rows = [(1, 0, "System: be kind"), (1, 1, "User: hello?"), (1, 2, "plain reply without a marker"), (1, 3, "Human: again\nmore"), (1, 4, "<|assistant|>\nfine"), (2, 0, None), (None, 0, ""), (1, 4, "<|assistant|>\nfine")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, text string, role string")
    got = transcripts.parse(df, model).orderBy("conv_id", "turn", "first_line").collect()
    roles = [r["role"] for r in got if r["conv_id"] == 1 and r["first_line"] == 0]
    assert roles == ["system", "user", "assistant", "user", "assistant", "assistant"]
    assert next(r for r in got if r["turn"] == 1)["rendered"] == "<|user|>\nhello?\n<|end|>"
    assert transcripts.parse(df.limit(0), model).count() == 0
    long = spark.createDataFrame([(1, k, ("User: " if k % 2 else "Assistant: ") + "x") for k in range(200)], "conv_id long, turn long, text string")
    got = transcripts.parse(long, model).orderBy("turn").collect()
    assert [r["role"] for r in got] == ["user" if k % 2 else "assistant" for k in range(200)]


def test_transcripts_by_brute_force(spark):
    """Whole conversations by one Viterbi run each, and turns over several rows rendered with one head and one end."""
    rng = random.Random(51)
    model = transcripts.Model()
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 30)):
            lines = [rng.choice(["User: ", "Assistant: ", "", "", "", "[system] "]) + rng.choice(["why?", "so it is", "", text(rng, 40)]) for _ in range(rng.randrange(1, 5))]
            rows.append((c, t, "\n".join(lines), "role", t))
    rows += [(None, 1, "User: a"), (None, 1, "User: a"), (None, None, "b\nc"), (None, 2, None)]
    rows = [(*r, "role", 0)[:5] for r in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string, seq long").repartition(5)
    got = collections.defaultdict(list)
    for r in transcripts.parse(df, model).collect():
        got[r["conv_id"]].append(r)
    for c in range(12):
        seen, where = [], []
        for r in sorted(r for r in rows if r[0] == c):
            obs = transcripts._observe(r[2])
            where += [(r[1], k, line, o[2]) for k, (line, o) in enumerate(zip(r[2].split("\n"), obs, strict=True))]
            seen += obs
        turns = []
        for (_, _, line, cut), s in zip(where, model.viterbi(seen), strict=True):
            role, opens = transcripts.STATES[s]
            if opens or not turns:
                turns.append([role, [line[cut:] if opens else line]])
            else:
                turns[-1][1].append(line)
        pieces = sorted(got[c], key=lambda r: (r["turn"], r["first_line"]))
        made = "\n".join(r["rendered"] for r in pieces)
        want = "\n".join((f"<|{role}|>\n" if k or transcripts.STATES[model.viterbi(seen)[0]][1] else "") + "\n".join(ls) + "\n<|end|>" for k, (role, ls) in enumerate(turns))
        assert made == want
        assert made.count("<|end|>") == len(turns)
    assert sorted(r["rendered"] for r in got[None]) == sorted(["<|user|>\na\n<|end|>"] * 2 + [r["rendered"] for r in got[None] if r["turn"] != 1])
    assert len(got[None]) == 4


def test_features_take_bounded_memory():
    """Four MB of short texts are looked at in slices, with the features of the texts one by one."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(8)
    texts = pa.array([text(rng, 20) for _ in range(32_000)] + [None, "", text(rng, 9000)])
    quality.all_features(texts[:10])
    tracemalloc.start()
    got = quality.all_features(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 4_000_000 and peak < 64 << 20
    assert got.shape[0] == len(texts)
    for k in (0, 7, 12_345, 31_999, 32_000, 32_001, 32_002):
        assert (quality.all_features(texts[k : k + 1])[0] == got[k]).all()


def test_quality(spark, none):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        good = rng.random() < 0.8
        body = text(rng, 80)
        rows.append((k, body if good else rng.choice([body.upper().replace(" ", "!! ") + "!!", " ".join([rng.choice(WORDS)] * 80)])))
        if k % 2:
            labels.append((k, int(good)))
    rows += [(700, None), (701, ""), (702, "z" * 200_000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    net = quality.fit(docs, lab)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.drop("score"), net, ["doc_id"]).collect()}
    held = [(got[k], q) for k, q in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    pos, neg = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and 300 < kept.count() < 600
    assert quality.score(none, None, ["doc_id"]).count() == 0
    assert quality.fit(docs, lab.limit(0)) is None


def test_context_mixing(docs, rows, none):
    got = contextmix.score(docs, contextmix.Mixing(words=50, least_bits=10, most_bits=12)).collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    import re

    tokens = [(r[0], [*re.findall("[^\x20\x09-\x0d]+", low(r[1])), None]) for r in rows]
    learns = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 10 != 0
    c = collections.Counter(t for i, ts in tokens if learns(i) for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ts), sum(c[t] > 0 for t in ts), round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6), not learns(i)) for i, ts in tokens)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["held_out"]) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert contextmix.score(none, contextmix.Mixing(words=50, least_bits=10, most_bits=12)).count() == 0


def small_stream(rng, rows=5, symbols=9):
    tree = contextmix.huffman(np.array([rng.randrange(1, 60) for _ in range(symbols)]))
    n = [rng.randrange(1, 90) for _ in range(rows)]
    row, nth = np.repeat(np.arange(rows), n), np.concatenate([np.arange(k) for k in n])
    symbol = np.array([rng.randrange(symbols) for _ in row])
    contexts = {k: np.array([rng.randrange(4) for _ in row], dtype=np.uint64) * np.uint64(977) for k in ("a", "b")}
    plain = np.array([rng.randrange(-20, 20) for _ in range(symbols)], dtype=np.int8)
    codes = contextmix.packed_codes(tree)
    code = [tuple(tree[3][tree[0][k] : tree[0][k] + tree[1][k]].tolist()) for k in range(symbols)]
    guess = [np.array([rng.randrange(symbols) for _ in row])]
    shared = [np.array([next((j for j in range(len(code[g])) if j >= len(code[x]) or code[g][j] != code[x][j]), 64) if g != x else 64 for g, x in zip(y, symbol, strict=True)]) for y in guess]
    kinds = [np.array([rng.randrange(contextmix.IN) for _ in row])]
    assert len(set(codes.tolist())) == symbols
    return contextmix.Stream(tree, symbol, row, nth, 8, contexts, ("a",), plain, tuple(zip(shared, kinds, strict=True))), code, guess


def test_mixing_cost_by_brute_force():
    """Counts, and the coding cost with online refinement, bit by bit in plain Python."""
    rng = random.Random(31)
    stream, code, _ = small_stream(rng)
    first, size, nodes, bits = stream.tree
    held = {k: np.zeros(4 * 64, dtype=np.uint32) for k in ("a", "b")}
    stream.count(held, 1)
    mask = (1 << 64) - 1
    slot = lambda c, node, n: ((int(c) ^ (node * int(contextmix.ODD) & mask)) * int(contextmix.GOLD) & mask) >> (65 - n.bit_length())
    want = {k: np.zeros(4 * 64, dtype=np.uint32) for k in ("a", "b")}
    for t, x in enumerate(stream.symbol):
        for j, bit in enumerate(code[x]):
            for k in want:
                want[k][128 + 2 * slot(stream.contexts[k][t], int(nodes[first[x] + j]), 64) + bit] += 1
    assert all((held[k] == want[k]).all() for k in held)
    tables = {k: np.array([rng.randrange(-400, 400) for _ in range(64)], dtype=np.int16) for k in ("a", "b")}
    weights = np.array([[rng.uniform(-0.3, 0.8) for _ in range(5)] for _ in range(contextmix.GATES)])
    got = stream.cost(tables, weights, 5, 0.3)
    total, add = np.zeros(5), np.zeros((5, 5))
    for r in range(5):
        own = np.flatnonzero(stream.row == r)
        edges = [0, 8, 16, 32, 64, 128]
        for a, b in itertools.pairwise(edges):
            grad, seen = np.zeros(5), 0
            for t in own[(stream.nth[own] >= a) & (stream.nth[own] < b)]:
                x = stream.symbol[t]
                for j, bit in enumerate(code[x]):
                    node = int(nodes[first[x] + j])
                    found = {k: int(tables[k][slot(stream.contexts[k][t], node, 64)]) for k in tables}
                    v, gate, scale = [stream.plain[node] / 10, (found["a"] >> 2) / 10, (found["b"] >> 2) / 10], found["a"] & 3, 4
                    for shared, kind in stream.deep:
                        here = int(kind[t]) if shared[t] >= j else 0
                        says = bit if shared[t] > j else 1 - bit
                        v.append((3 if says else -3) if here else 0)
                        gate += scale * here
                    v = np.array([*v, 1.0])
                    p = 1 / (1 + math.exp(-min(18, max(-18, float((weights[gate] + add[r]) @ v)))))
                    total[r] -= math.log2(p if bit else 1 - p)
                    grad += (bit - p) * v
                    seen += 1
            add[r] += 0.3 * grad / (seen + 8)
    assert np.abs(got - total).max() < 1e-3 * total.max()


def test_mixing_is_a_distribution():
    """The probabilities of all symbols in one place sum to one, whatever is guessed there."""
    rng = random.Random(32)
    tree = contextmix.huffman(np.array([rng.randrange(1, 1000) for _ in range(40)]))
    codes = contextmix.packed_codes(tree)
    for guess in (3, 17):
        every = np.arange(40)
        _, e = np.frexp((codes[guess] ^ codes[every]).astype(np.float64))
        shared = np.where(every == guess, 64, 53 - e)
        ones = np.ones(40, dtype=np.int64)
        s = contextmix.Stream(tree, every, every, 0 * every, 8, {"a": ones.astype(np.uint64)}, ("a",), np.array([rng.randrange(-30, 30) for _ in range(40)], dtype=np.int8), ((shared, 2 * ones),))
        tables = {"a": np.array([rng.randrange(-300, 300) for _ in range(256)], dtype=np.int16)}
        bits = s.cost(tables, np.full((contextmix.GATES, 4), 0.4), 40, 0.05)
        assert abs((2.0**-bits).sum() - 1) < 1e-4


def test_a_text_that_stands_twice_is_told_apart(spark):
    """Learning rows are scored without their own counts: a text that stands once costs as much as a held-out one, a copy costs far less."""
    rng = random.Random(33)
    rows = [(k, text(rng, 150)) for k in range(400)]
    rows += [(1000 + k, rows[k][1]) for k in range(0, 40, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in contextmix.score(df, contextmix.Mixing(words=500, most_bits=16)).collect()}
    learns = lambda k: zlib.crc32(str(k).encode()) % 10 != 0
    once = [got[k]["bits_per_byte"] for k in range(40, 400) if learns(k)]
    held = [got[k]["bits_per_byte"] for k in range(40, 400) if not learns(k)]
    twice = [got[k]["bits_per_byte"] for k in [*range(0, 40, 2), *range(1000, 1040, 2)] if learns(k % 1000) and learns(k % 1000 + 1000)]
    assert abs(np.mean(once) / np.mean(held) - 1) < 0.03
    assert max(twice) < 0.8 * min(once)
    again = {r["doc_id"]: r["score"] for r in contextmix.score(df.repartition(3), contextmix.Mixing(words=500, most_bits=16)).collect()}
    assert all(abs(again[k] - got[k]["score"]) < 1e-3 * abs(got[k]["score"]) for k in again)


def test_anchors_and_planes():
    rng = np.random.default_rng(7)
    tok = rng.integers(-(1 << 30), 300_000, 500)
    assert (contextmix.from_planes(contextmix.planes(tok)) == tok).all()
    a, b = contextmix.anchors_of(tok, contextmix.Mixing()), contextmix.anchors_of(tok[100:], contextmix.Mixing())
    assert {(p - 100, k) for p, k in zip(*a, strict=True) if p > 110} == {(p, k) for p, k in zip(*b, strict=True) if p > 10}
    row, pos, key = contextmix.anchors_of_rows([tok[:200], tok[:0], tok[:3], tok[200:]], contextmix.Mixing())
    for r, own in ((0, tok[:200]), (3, tok[200:])):
        assert [(pos[row == r] == contextmix.anchors_of(own, contextmix.Mixing())[0]).all(), (key[row == r] == contextmix.anchors_of(own, contextmix.Mixing())[1]).all()] == [True, True]
    assert set(row.tolist()) == {0, 3}
    mean = 500 / contextmix.Mixing().anchor
    assert mean / 3 < len(a[0]) < 3 * mean and len(contextmix.anchors_of(tok[:3], contextmix.Mixing())[0]) == 0


def test_codes_are_complete():
    first, size, nodes, bits = contextmix.huffman(np.array([5, 1, 1, 9, 0]))
    assert abs(sum(2.0**-s for s in size) - 1) < 1e-12
    assert len({tuple(bits[first[k] : first[k] + size[k]]) for k in range(5)}) == 5
    assert len(nodes) == size.sum()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus: good prose in two sources, shouting junk, exact and near copies, a repeated passage, null and empty texts."""
    rng = random.Random(61)
    rows, labels = [], []
    for k in range(240):
        rows.append((k, ("\n" if k < 200 else " ").join(text(rng, 14) for _ in range(6)), "en", "ab"[k % 2], 0))
        labels.append((k, 1, 0))
    for k in range(240, 300):
        rows.append((k, " ".join(rng.choice(["BUY!!!", "$$$", "click", "NOW!!!"]) for _ in range(60)), "en", "a", 0))
        labels.append((k, 0, 0))
    rows += [(400 + k, rows[k][1], "en", "a", 0) for k in range(20)]
    rows += [(500 + k, rows[210 + k][1] + " more", "en", "b", 0) for k in range(20)]
    passage = "\n".join(text(rng, 20) for _ in range(3))
    rows += [(600 + k, text(rng, 40) + "\n" + passage + "\n" + text(rng, 40), "en", "a", 0) for k in range(4)]
    rows += [(700, None, "en", "a", 0), (701, "", None, None, 0), (None, text(rng, 50), "en", "b", 0), (5, rows[5][1], "en", "b", 0)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at), rows, passage


def test_pipeline(spark, corpus):
    """Every stage does its work on what the one before kept, and the last table holds all token ids of what the mix drew."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    at, rows, passage = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near duplicates", "source mixing", "packing"]
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), stage(spark, docs.limit(0), at).schema)
        seen.append(docs)
    good, fresh, one, mixed, packed = (d.collect() for d in seen)
    assert all(d.columns == corpus_pipeline.COLUMNS for d in seen[:4])
    ids = [r["doc_id"] for r in good]
    assert sum(i is not None and i < 240 for i in ids) >= 235 and not any(240 <= (i or 0) < 300 for i in ids)
    assert sum(passage.split("\n")[1] in (r["text"] or "") for r in fresh) == 1
    assert all(r["n_chars"] == len(r["text"] or "") for r in fresh)
    kept = {r["doc_id"] for r in one}
    assert not any(500 <= (i or 0) < 520 for i in kept) and not any(400 <= (i or 0) < 420 for i in kept)
    assert {i for i in ids if i is not None and i < 240 and i != 5} <= kept
    drawn = collections.Counter((r["doc_id"], r["text"]) for r in mixed)
    assert set(drawn) == {(r["doc_id"], r["text"]) for r in one} or max(drawn.values()) > 1
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(list)
    for r in packed:
        pieces[(r["doc_id"], r["row_id"])].append(r)
    made = collections.Counter((k[0], tuple(np.frombuffer(b"".join(bytes(r["ids"]) for r in sorted(own, key=lambda r: r["start"])), "<u4").tolist())) for k, own in pieces.items())
    assert made == collections.Counter({(i, (*t.encode(x or "", add_special_tokens=False).ids, 1)): n for (i, x), n in drawn.items()})


def test_pipeline_run(spark, corpus, tmp_path):
    import corpus_pipeline

    at, _, _ = corpus
    out = corpus_pipeline.run(spark, at)
    assert out.count() > 200 and {"doc_id", "ids", "sequence_id", "row_id"} <= set(out.columns)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double, row string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
