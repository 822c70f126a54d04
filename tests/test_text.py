"""Analyzer, query language, notes: hand-made cases."""

import pytest
from pyspark.sql import functions as F

from fernquery.functions import analyzer as A
from fernquery.functions import notes as N
from fernquery.operators import dense, filters, ranking


@pytest.mark.parametrize(
    ("text", "derived", "want"),
    [
        ("GPT-4", True, ["GPT", "4", "GPT4"]),
        ("U.S.A", True, ["U", "S", "A", "USA"]),
        ("getUserName", True, ["getUserName", "get", "User", "Name"]),
        ("HTTPServer", True, ["HTTPServer", "HTTP", "Server"]),
        ("one, two", True, ["one", "two"]),
        ("Anna's 1990's", False, ["Anna", "1990", "s"]),
        ("x=y a&b", False, ["x", "y", "a", "b"]),
        ("", True, []),
    ],
)
def test_tokenize(text, derived, want):
    assert A.tokenize(text, derived) == want


def test_column_analyzer_agrees_with_python(spark):
    words = "cars movies countries classes boxes dishes aliases alias news series analyses bus this shoes gas lenses Café naïve ALIAS ches".split()
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", A.fold(F.col("w")).alias("f")).select("w", A.singular(F.col("f")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == {w: A.singular_text(A.fold_text(w)) for w in words}


def test_query_terms_keep_stopwords_only_alone():
    assert A.query_terms("the cars") == ["car"]
    assert A.query_terms("the will") == ["the", "will"]


@pytest.mark.parametrize(
    ("raw", "left", "check"),
    [
        ("hello world", "hello world", lambda f: f is None),
        ("#work plan", "plan", lambda f: f.tags == ["work"]),
        ("a tag:#x/y", "a", lambda f: f.tags == ["x/y"]),
        ('path:"Daily notes/2022" z', "z", lambda f: f.paths == ["Daily notes/2022"]),
        ("[price > 3] q", "q", lambda f: f.numeric == [("price", ">", 3.0)]),
        ("[price>abc]", "", lambda f: f.mismatch == ["price"]),
        ("[kind:pub][town:Leith]tea", "tea", lambda f: f.properties == {"kind": "pub", "town": "Leith"}),
        ("[size :>= 3]", "", lambda f: f.mismatch == ["size"]),
        ("[size : < 3] [note:a>b]", "", lambda f: f.numeric == [("size", "<", 3.0)] and f.properties == {"note": "a>b"}),
        ("[ x]", "[ x]", lambda f: f is None),
        ("#tea/green/ #\u201cq", "/ #\u201cq", lambda f: f.tags == ["tea/green"]),
        ("#ours\u201d", "\u201d", lambda f: f.tags == ["ours"]),
        ('path:"" x', "x", lambda f: f.paths == [""]),
        ("[k:v1] [k:v2]", "", lambda f: f.properties == {"k": "v2"}),
        ("cats -dogs", "cats", lambda f: f.exclude == ["dog"]),
        ("cats -#dogs", "cats", lambda f: f is None),
        ("cats -the", "cats -the", lambda f: f is None),
        ("after:2026 before:2026-02 x", "x", lambda f: (f.after, f.before) == ("2026", "2026-02")),
        ("after:yesterday", "after:yesterday", lambda f: f is None),
        ("see shop.example/a#deals", "see shop.example/a#deals", lambda f: f is None),
        ("heritage:trail", "heritage:trail", lambda f: f is None),
    ],
)
def test_parse(raw, left, check):
    text, found = filters.parse(raw)
    assert text == left
    assert check(found)


def test_dates():
    day = 86_400_000
    assert filters.date_ms("2026-02-30") == filters.date_ms("2026-03-02")
    assert filters.end_ms("2026") == filters.date_ms("2027-01-01")
    assert filters.end_ms("2026-13") == filters.date_ms("2027-02-01")
    assert filters.end_ms("2026-13-01") is None
    assert filters.end_ms("2026-05-19") == filters.date_ms("2026-05-19") + day
    assert filters.date_ms("soon") is None


def test_chunk_ids():
    # Ids of existing stores.
    assert N.chunk_id("Notes/Foo.md", "Foo", "body text") == "1324c39d06d44a"
    assert N.chunk_id("Notes/Foo.md", "Foo", "body text", "project active") == "1c8096b6b2c2b8"


NOTE = """---
tags: [a, b]
aliases: [The Saloon]
kind: "bar"
---
Intro text that is long enough to stand on its own as a chunk, yes.

## Short
tiny

## Long
This section is long enough to be a chunk and mentions [[People/Ann Lee|Ann]] and https://www.example.com/some-page?x=1.

```
# not a heading [[raw]]
```
"""


def test_chunk_note():
    chunks = N.chunk_note("Places/Saloon.md", NOTE)
    assert [c["title"] for c in chunks] == ["Saloon | The Saloon", "Saloon | The Saloon > Long"]
    assert chunks[1]["content"].startswith("Short\ntiny\n\nThis section")
    assert "mentions Ann and example some page" in chunks[1]["content"]
    assert "# not a heading [[raw]]" in chunks[1]["content"]
    assert "People/Ann Lee" in chunks[1]["link_terms"]
    assert chunks[0]["tags"] == ["a", "b"]
    assert chunks[0]["properties"] == {"kind": ["bar"]}
    assert N.chunk_note("x.md", "")[0]["lexical_only"]
    assert len(N.chunk_note("x.md", "# A\nb\n# C\nd")) == 1


def test_atoms_and_fences():
    kinds = [a.kind for a in N.atoms("p\n\n> c\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n~~~\nx\n\n```\n")]
    assert kinds == ["paragraph", "callout", "table", "fence"]


def test_split_budget_keeps_words_and_budget():
    count = lambda s: len(s.split())
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(60)) for i in range(12))
    parts = N.split_budget("title here", text, count, 128)
    assert all(count("title here") + count(p) <= 128 for p in parts)
    assert {w for p in parts for w in p.split()} == set(text.split())


def test_sentences_and_snippets():
    text = "One is here. Two follows e.g. this. Three!\nFour"
    assert [text[a:b] for a, b in N.sentences(text)] == ["One is here.", "Two follows e.g. this.", "Three!", "Four"]
    long = "Nothing. " * 60 + "The golden gate stands."
    assert N.snippet(long, N.passage_terms("golden")).startswith("The golden gate")


def test_highlights():
    text = "---\ntea: x\n---\nTea rooms; ![[tea]] and `tea` or [[tea/list|teapots]], [[teas]] steatite the"
    found = [text[a:b] for a, b in N.highlights(text, ["tea", "room", "the", "t"])]
    assert found == ["Tea", "rooms", "teapots", "teas"]
    assert len(N.highlights("tea " * 50, ["tea"])) == 32
    assert N.highlights("abc abd", ["ab", "abc"]) == [(0, 3), (4, 7)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("#walk and #Walk, x#no #2024 #2024/w1", ["walk", "2024/w1"]),
        ("a %%#hidden%% #seen\n`#code` #after %% #gone", ["seen", "after"]),
        ("```\n#fenced\n```\n#out/of/it/ #\u201cq\u201d #a\u2028b", ["out/of/it", "a"]),
        ("`x`#y #日本語 #🎉 it", ["日本語", "🎉"]),
    ],
)
def test_inline_tags(text, want):
    assert N.inline_tags(text) == want


@pytest.mark.parametrize(
    ("text", "want", "lost"),
    [
        ("![[scan.tiff]] ![[Tea list]] ![[a.ogg]]", "Tea list a.ogg", "scan.tiff"),
        ("[[x/y#z|Why]] [[x/y#z]] [t](u v) ![alt]( pic.png )", "Why y t alt", "pic.png x/y#z x/y#z u v"),
        ("see <https://a.example/b> <b>bold</b> https://www.tea.example/green-leaf?x=1#y.", "see bold tea green leaf", "https://a.example/b https://www.tea.example/green-leaf?x=1#y."),
        ("[![badge](b.svg)](https://c.example)", "badge", "b.svg https://c.example"),
        ("a\n* * *\n\n\n\nb\t c \n d", "a\n\nb c\nd", ""),
        ("[open [[x]] and (no) <3 i<j", "[open x and (no) <3 i<j", ""),
    ],
)
def test_cleaning(text, want, lost):
    assert N.clean_body(text) == (want, lost)


def test_plain_snippets():
    from fernquery.functions.markup import plain_snippet

    assert plain_snippet("![[banner.png]]\nHi **there**\n\n\n\n```json\n{}\n```\n| a | b |\n|---|---|") == "Hi **there**\n\n{}"
    assert plain_snippet("| a | b |\n|:--|--:|\n| 1 |  |\n$$\nx = 1\n$$") == "a · b  |  1  —  x = 1"
    assert plain_snippet("a | b is prose") == "a | b is prose"


def test_scalars(spark):
    row = spark.range(1).select(
        dense.dense_norm(F.lit(0.5)).alias("n"),
        ranking.recency(F.lit(0).cast("long"), 83 * 86_400_000, 180.0).alias("r"),
        ranking.title_coverage("alex 1x1", F.lit("Alex 1x1 2026-05-19")).alias("t"),
        dense.confidence(F.lit(2.0), F.lit(0.0), F.lit(1.0)).alias("c"),
        F.get(dense.sign_bytes(F.array(*[F.lit(x) for x in (0.1, -0.2, 0.0, -1.0, 2.0, 0.3, -0.1, 0.4)])), F.lit(0)).alias("s"),
        ranking.date_column(F.lit("2026-02-30")).alias("d"),
    ).first()
    assert row["n"] == 0.75
    assert abs(row["r"] - 0.726427) < 1e-6
    assert row["t"] == 0.4
    assert row["c"] == 0.5
    assert row["s"] == 181
    assert row["d"] == filters.date_ms("2026-03-02")
    assert dense.pool_caps(20_000) == {"binary": 400, "bm25": 200, "recency": 50}


def test_plural_rules_of_columns_and_python_agree(spark):
    """Words of five letters in -ches or -shes lost only their s as a column."""
    words = ["ashes", "aches", "inches", "bushes", "shes", "axes", "boxes", "gazes", "ises", "gases", "losses", "dies", "parties", "movies", "lenses", "gas", "bus", "this", "chaos"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", A.singular(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in got} == {w: A.singular_text(w) for w in words}
    assert dict(map(tuple, got))["ashes"] == "ash"


def test_ids_of_many_texts_are_hashed_in_bounded_batches(monkeypatch):
    """Equal to a plain loop over each text's units, whatever lies together; no batch holds more than SLICE units and a text."""

    def plain(text):
        a, b, m = 0xDEADBEEF, 0x41C6CE57, 0xFFFFFFFF
        raw = text.encode("utf-16-le", "surrogatepass")
        for k in range(0, len(raw), 2):
            u = int.from_bytes(raw[k : k + 2], "little")
            a, b = (a ^ u) * 2654435761 & m, (b ^ u) * 1597334677 & m
        a = ((a ^ a >> 16) * 2246822507 & m) ^ ((b ^ b >> 13) * 3266489909 & m)
        b = ((b ^ b >> 16) * 2246822507 & m) ^ ((a ^ a >> 13) * 3266489909 & m)
        return f"{b & 0x1FFFFF:06x}{a:08x}"

    texts = [("aé漢😀" * k)[: 3 * k] for k in range(90)] + ["", "x" * 900]
    want, sizes, hashed = [plain(t) for t in texts], [], N._hashed
    monkeypatch.setattr(N, "_hashed", lambda ts: sizes.append(sum(map(len, ts))) or hashed(ts))
    assert N.chunk_hashes(texts) == want and len(sizes) == 1
    monkeypatch.setattr(N, "SLICE", 500)
    assert N.chunk_hashes(texts) == want and max(sizes[1:]) <= 1400
