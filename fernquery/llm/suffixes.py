"""Repeated byte windows by a depth-limited most-significant-digit radix sort of suffixes.

Suffixes are ordered only through the threshold (100 bytes), a digit at a time, and a suffix leaves as soon as its
group has no other member; the groups that are left at full depth are exactly the repeated windows. Digits are bytes of the text.

1. First digit: 24 bytes at the window's minimiser, its leftmost gram with the least hash (equal windows have equal minimisers at
   equal distances, so grouping by them before the window's first byte loses nothing). Neighbouring windows with one minimiser travel as one block, a row each 30 to
   40 bytes of text. Rows are dealt and sorted by these bytes. Blocks of one group whose covered bytes have one digest are decided at once: the earliest
   is the first, all windows of the others are proposed as repeats. A group with one block leaves.
2. Further digits: of groups that hold several digests, the earliest block of each is fetched as bytes, and the windows are sorted by
   eight bytes a pass, most significant first, through depth 100. A group without another member leaves after each pass.
3. Groups too large for one task's buffer (`buffer` blocks of different digests) are dealt out again by the first 24 bytes of each
   window, and decided like blocks.

What passes 1 and 3 propose by digests is confirmed on bytes: the earlier text's bytes travel to the later text, once for each range, and are compared
there. Every pass streams sorted rows with a constant carry, or a bounded buffer, so no group is ever held whole. Blocks that
repeat within a task are decided where they are read, which pre-aggregates hot passages before the shuffle.

Order of documents: by doc_id, a null doc_id later than all others; different texts of one or no id by the hash of the text. Defined results: null and
empty texts have no windows; of rows of equal doc_id (or none) and equal text, later copies are removed whole if they have 100 bytes, and the first is judged as any text; a
text is only ever cut by ranges of its own; an empty table gives an empty result; columns other than doc_id and text don't take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernquery.llm.common import RangeHash, held, mix64, runs_of, slices, table, utf8

U64 = np.uint64
GRAM = 24  # bytes of the first digit, as three 64-bit numbers
STARTS = 31  # low bits of a place: the start; above it are 32 bits of the text's hash
PROPOSED, EXACT = -1, -2  # ranges, in `away`
DOC = ["late", "at_id", "text_key"]


@dataclass(frozen=True)
class Repeats:
    length: int = 100
    buffer: int = 4096
    hot: int = 1 << 17  # repeated blocks that a task remembers


ROWS = "d1 long, d2 long, d3 long, t long, late boolean, at_id long, place long, n int, away int"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
KINDS = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 2 + [pa.int32()] * 2


def _rows(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x), type=k) for x, k in zip(columns, KINDS, strict=True)], names=NAMES)


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(NAMES))]


def words_at(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a number whose order is that of the bytes."""
    view = np.ndarray((max(len(data) - 7, 0),), dtype=">u8", buffer=np.ascontiguousarray(data), strides=(1,))
    return view[place].astype(np.uint64)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` neighbours, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def blocks(data: np.ndarray, at: np.ndarray, rule: Repeats) -> tuple[np.ndarray, ...]:
    """(row, first start, number of starts, distance to the minimiser, place of the minimiser, digest) of each block of windows."""
    n, width = len(data), rule.length - GRAM + 1
    if n < rule.length:
        return tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0, np.uint64),)
    hashes = RangeHash(data)
    place = np.arange(n - GRAM + 1)
    gram = hashes(place, place + GRAM)
    mask = U64((1 << max(1, int(n).bit_length())) - 1)
    mini = (_least((gram & ~mask) | place.astype(np.uint64), width) & mask).astype(np.int64)  # one for each start, 0 .. n - length
    has = np.diff(at) >= rule.length
    within = np.zeros(n + 1, dtype=np.int64)  # windows that stay within their row
    np.add.at(within, at[:-1][has], 1)
    np.add.at(within, at[1:][has] - rule.length + 1, -1)
    ok = np.cumsum(within)[: len(mini)] > 0
    new = ok.copy()
    new[1:] &= (mini[1:] != mini[:-1]) | ~ok[:-1]
    new[at[:-1][has]] = True
    first = np.flatnonzero(new)
    edge = np.flatnonzero(np.diff(np.concatenate([ok, [False]]).astype(np.int8)) == -1)  # last good start of each run
    stop = np.minimum(np.append(first[1:], len(mini)), edge[np.searchsorted(edge, first)] + 1) if len(first) else first
    row = np.searchsorted(at, first, side="right") - 1
    anchor = mini[first]
    digest = mix64(hashes(first, stop - 1 + rule.length) ^ mix64((anchor - first).astype(np.uint64) + U64(7)))
    return row, first - at[row], stop - first, anchor - first, anchor, digest


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] equals data[b : b + size], for each range."""
    off = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(of)) - off[of]
    differ = data[a[of] + step] != data[b[of] + step]
    return np.bincount(of[differ], minlength=len(size)) == 0


def _texts(docs: DataFrame) -> DataFrame:
    """late, at_id, text_key and text: the same columns wherever texts are joined, so that one exchange of them serves all joins of a plan."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at_id = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("late"), text))
    return docs.select(F.col("doc_id").isNull().alias("late"), at_id.alias("at_id"), F.xxhash64(text).bitwiseAND(F.lit((1 << 32) - 1)).alias("text_key"), text.alias("text"))


def _long_texts(docs: DataFrame, rule: Repeats) -> DataFrame:
    return _texts(docs).filter(F.octet_length("text") >= rule.length)


def cut_blocks(docs: DataFrame, rule: Repeats) -> DataFrame:
    """ROWS of all documents. In ranges, d1 to d3 name the source: its at_id, its place, whether its id is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}  # blocks that this task met more than once: digits to the earliest
        for b in batches:
            late, ids, keys = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            data, at = utf8(b.column(3))
            for lo, hi in slices(b.num_rows, at, 1 << 20):
                part = data[at[lo] : at[hi]]
                row, start, n, away, anchor, digest = blocks(part, at[lo : hi + 1] - at[lo], rule)
                if not len(row):
                    continue
                d = [words_at(part, anchor + 8 * k).view(np.int64) for k in range(3)]
                t, row = digest.view(np.int64), row + lo
                place = (keys[row] << STARTS) + start
                made = [*d, t, late[row], ids[row], place, n, away]
                order = np.lexsort((place, ids[row], late[row], t, d[2], d[1], d[0]))
                same = np.zeros(len(order), dtype=bool)
                same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in made[:4]])
                head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                begin = anchor - away
                again = order[same]
                lead = head[same]
                equal = equal_ranges(part, begin[again], begin[lead], n[again] + rule.length - 1)
                out = np.ones(len(order), dtype=bool)  # rows that travel as blocks: leads, and those whose digest deceived
                out[again[equal]] = False
                again, lead = again[equal], lead[equal]
                other = (place[again] != place[lead]) | (ids[row[again]] != ids[row[lead]]) | (late[row[again]] != late[row[lead]])
                if other.any():
                    yield from ranges([made[4][again[other]], made[5][again[other]], place[again[other]]], n[again[other]], EXACT)
                for k in np.unique(lead).tolist():  # hot blocks: a later one than this task has sent needn't travel
                    name = tuple(int(x[k]) for x in made[:4])
                    mine = (bool(made[4][k]), int(made[5][k]), int(place[k]))
                    first = seen.get(name)
                    if first is not None and first < mine:
                        out[k] = False
                        yield _rows([[first[1]], [first[2]], [int(first[0])], [0], [mine[0]], [mine[1]], [mine[2]], [int(n[k])], [PROPOSED]])
                    elif first is not None or len(seen) < rule.hot:
                        seen[name] = mine
                if out.any():
                    yield _rows([x[out] for x in made])

    return _long_texts(docs, rule).mapInArrow(run, ROWS)


def ranges(owner: list[np.ndarray], n: np.ndarray, kind: int, source: list[np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Neighbouring ranges of starts merged, where they have one source document at one distance. owner, source: late, at_id, place."""
    late, ids, place = owner
    zero = np.zeros(len(n), np.int64)
    s_late, s_id, s_place = source or (zero, zero, place)
    shift = s_place - place
    order = np.lexsort((place, shift, s_id, s_late, ids, late))
    late, ids, place, n, s_late, s_id, s_place, shift = (x[order] for x in (late, ids, place, n, s_late, s_id, s_place, shift))
    end = place + n
    new = np.ones(len(n), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (late, ids, s_late, s_id, shift)]) | (place[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.maximum.reduceat(end, first) if len(first) else end
    take = lambda x: x[first]
    yield _rows([take(s_id), take(s_place), take(s_late).astype(np.int64), np.zeros(len(first), np.int64), take(late), take(ids), take(place), last - place[first], np.full(len(first), kind)])


def decide(rows: DataFrame, all_leads: bool = True) -> DataFrame:
    """One pass over rows dealt and sorted by their digits: repeats come out as ranges, the leads of undecided groups as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_, many_before = None, False  # the last lead, and whether its group has sent one already
        for b in batches:
            if not b.num_rows:
                continue
            c = _columns(b)
            known = c[8] < 0
            if known.any():
                yield b.filter(pa.array(known))
                c = [x[~known] for x in c]
            if not len(c[0]):
                continue
            fresh = held_ is not None
            if fresh:  # put the last group's lead before this batch
                c = [np.concatenate([[x], y]) for x, y in zip(held_, c, strict=True)]
            size = len(c[0])
            new_d = np.ones(size, dtype=bool)
            new_d[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in c[:3]])
            new_t = new_d.copy()
            new_t[1:] |= c[3][1:] != c[3][:-1]
            head = np.maximum.accumulate(np.where(new_t, np.arange(size), 0))
            again = ~new_t & np.logical_or.reduce([x != x[head] for x in c[4:7]])
            if again.any():
                yield from ranges([x[again] for x in c[4:7]], c[7][again], PROPOSED, [x[head[again]] for x in (c[4].astype(np.int64), c[5], c[6])])
            lead = np.flatnonzero(new_t)
            group = np.cumsum(new_d)[lead]
            many = np.bincount(group)[group] > 1
            if fresh and many_before:
                many |= group == group[0]
            out = np.zeros(size, dtype=bool)
            out[lead[many]] = True
            if fresh and many_before:
                out[0] = False  # given already
            if all_leads and out.any():
                yield _rows([x[out] for x in c])
            held_, many_before = [x[lead[-1]] for x in c], bool(many[-1])

    return rows.repartition("d1", "d2", "d3").sortWithinPartitions("d1", "d2", "d3", "t", "late", "at_id", "place").mapInArrow(run, ROWS)


def _doc_of(late: str = "late", at_id: str = "at_id", place: str = "place") -> list:
    return [F.col(late).cast("boolean").alias("late"), F.col(at_id).alias("at_id"), F.shiftright(place, STARTS).alias("text_key")]


def start_of(place: str):
    return F.col(place).bitwiseAND(F.lit((1 << STARTS) - 1))


def slices_of(texts: DataFrame, wanted: DataFrame, schema: str) -> DataFrame:
    """Bytes of texts: wanted holds DOC and `list`, of structs whose first two fields are a start and a number of bytes; each gives a row of DOC, its other fields and bytes. A copy of
    the row before is passed over."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in runs_of(batches, 3):
            docs = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            fresh = np.array([d != e for d, e in zip(docs, [last, *docs[:-1]], strict=True)])
            last = docs[-1] if docs else last
            if not fresh.all():
                b = b.filter(pa.array(fresh))
            if not b.num_rows:
                continue
            data, at = utf8(b.column(3))
            lists = b.column(4)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            begin = at[row] + flat.field(0).to_numpy()
            long = flat.field(1).to_numpy().astype(np.int64)
            lo = 0
            while lo < len(row):
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(long[lo : lo + 20_000]), 1 << 22)))
                hi = min(hi, len(row), lo + 20_000)
                off = np.concatenate([[0], np.cumsum(long[lo:hi])])
                take = np.repeat(begin[lo:hi] - off[:-1], long[lo:hi]) + np.arange(off[-1])
                got = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())])
                of = pa.array(row[lo:hi])
                more = [flat.field(k).slice(lo, hi - lo) for k in range(flat.type.num_fields)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(of) for k in range(3)), *more, got], names=names)
                lo = hi

    return texts.join(wanted, DOC).select(*DOC, "text", "list").mapInArrow(run, schema)


def window_bytes(leads: DataFrame, docs: DataFrame, rule: Repeats) -> DataFrame:
    """The leads with the bytes that their windows cover."""
    cover = F.struct(start_of("place").alias("start"), (F.col("n") + F.lit(rule.length - 1)).alias("size"), "d1", "d2", "d3", "n", "away", "place")
    wanted = leads.withColumn("text_key", F.shiftright("place", STARTS)).groupBy(*DOC).agg(F.collect_list(cover).alias("list"))
    schema = "late boolean, at_id long, text_key long, start long, size int, d1 long, d2 long, d3 long, n int, away int, place long, bytes binary"
    return slices_of(_long_texts(docs, rule), wanted, schema).select("d1", "d2", "d3", "late", "at_id", "place", "away", "bytes")


def radix(data: np.ndarray, begin: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, groups) that are left when windows of one group each are ordered by eight bytes a pass through `length` bytes; groups of one leave
    after each pass. Members of a group then have equal bytes."""
    live = np.arange(len(begin))
    group = group.copy()

    def split(digit: np.ndarray | None) -> None:
        nonlocal live, group
        order = np.argsort(group, kind="stable") if digit is None else np.lexsort((digit, group))
        live, g = live[order], group[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = g[1:] != g[:-1]
        if digit is not None:
            x = digit[order]
            new[1:] |= x[1:] != x[:-1]
        number = np.cumsum(new) - 1
        stay = np.bincount(number)[number] > 1 if len(number) else new
        live, group = live[stay], number[stay]

    split(None)
    for off in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        if not len(live):
            break
        split(words_at(data, begin[live] + off))
    return live, group


def compare_windows(got: DataFrame, rule: Repeats) -> DataFrame:
    """ROWS: exact ranges of windows that repeat within their group; groups beyond the buffer as one row for each window, by its first 24 bytes."""

    def windows(part: list[pa.RecordBatch]) -> tuple:
        whole = pa.Table.from_batches(part).combine_chunks()
        data, at = utf8(whole.column("bytes"))
        n = np.maximum(np.diff(at) - rule.length + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        d1, d2, d3, late, ids, place, away = (whole.column(c).to_numpy() for c in ("d1", "d2", "d3", "late", "at_id", "place", "away"))
        return data, at[row] + step, row, step, (d1, d2, d3), late[row], ids[row], place[row] + step, away[row] - step

    def decided(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, begin, row, _, digits, late, ids, place, far = windows(part)
        new = np.zeros(len(digits[0]), dtype=np.int64)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in digits])
        # equal windows have one first digit at one distance
        live, group = radix(data, begin, np.cumsum(new)[row] * (2 * rule.length) + far, rule.length)
        order = np.lexsort((place[live], ids[live], late[live], group))
        live, group = live[order], group[order]
        again = np.zeros(len(live), dtype=bool)
        again[1:] = group[1:] == group[:-1]
        first = live[np.maximum.accumulate(np.where(again, 0, np.arange(len(live))))] if len(live) else live
        again &= (place[live] != place[first]) | (ids[live] != ids[first]) | (late[live] != late[first])
        if again.any():
            k = live[again]
            yield from ranges([late[k], ids[k], place[k]], np.ones(len(k), np.int64), EXACT)

    def dealt(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in part:
            for lo in range(0, b.num_rows, 512):
                data, begin, _, _, _, late, ids, place, _ = windows([b.slice(lo, 512)])
                if len(begin):
                    t = RangeHash(data)(begin, begin + rule.length).view(np.int64)
                    yield _rows([*(words_at(data, begin + 8 * k).view(np.int64) for k in range(3)), t, late, ids, place, np.ones(len(t), np.int64), np.zeros(len(t), np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []  # rows of whole groups, and of the last group so far
        tail = 0  # rows of the last group
        last, large = None, False
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                part = b.slice(lo, min(2048, b.num_rows - lo))
                lo += part.num_rows
                digits = [part.column(k).to_numpy() for k in range(3)]
                cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in digits])) + 1
                edges = [0, *cuts.tolist(), part.num_rows]
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    name = tuple(int(x[a]) for x in digits)
                    if name != last:
                        if sum(x.num_rows for x in open_) >= rule.buffer:
                            yield from decided(open_)
                            open_ = []
                        last, tail, large = name, 0, False
                    piece = part.slice(a, z - a)
                    tail += z - a
                    if large:
                        yield from dealt([piece])
                        continue
                    open_.append(piece)
                    if tail > rule.buffer:  # this group alone passes the buffer: its rows are the last ones of `open_`
                        whole = pa.Table.from_batches(open_)
                        before = whole.slice(0, whole.num_rows - tail).to_batches()
                        if before:
                            yield from decided(before)
                        yield from dealt(whole.slice(whole.num_rows - tail).combine_chunks().to_batches())
                        open_, large = [], True
        if open_:
            yield from decided(open_)

    return got.repartition("d1", "d2", "d3").sortWithinPartitions("d1", "d2", "d3").mapInArrow(run, ROWS)


def joined_ranges(proposed: DataFrame) -> DataFrame:
    """DOC, start, n, s_late, s_id, s_key, s_start: proposed ranges of one text from one source at one distance, merged."""
    names = [*DOC, "s_late", "s_id", "s_key", "start", "n", "s_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(6)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            start, n, s_start = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in range(3))
            order = np.lexsort((start, s_start - start, row))
            row, start, n, s_start = row[order], start[order], n[order], s_start[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | ((s_start - start)[1:] != (s_start - start)[:-1]) | (start[1:] > (start + n)[:-1])
            first = np.flatnonzero(new)
            stop = np.maximum.reduceat(start + n, first) if len(first) else n
            take = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(6)), pa.array(start[first]), pa.array(stop - start[first]), pa.array(s_start[first])], names=names)

    source = _doc_of("d3", "d1", "d2")
    rows = proposed.select(*_doc_of(), *[c.alias(x) for c, x in zip(source, ("s_late", "s_id", "s_key"), strict=True)], start_of("place").alias("start"), "n", start_of("d2").alias("s_start"))
    grouped = rows.groupBy(*names[:6]).agg(F.collect_list(F.struct("start", "n", "s_start")).alias("list"))
    return grouped.mapInArrow(run, "late boolean, at_id long, text_key long, s_late boolean, s_id long, s_key long, start long, n long, s_start long")


def repeated_starts(docs: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """DOC, exact (start, n: windows that start earlier too), proofs (start, n, bytes of the earlier text) of every text that has any."""
    first = held(decide(cut_blocks(docs, rule)))
    second = compare_windows(window_bytes(first.filter("away >= 0"), docs, rule), rule)
    third = decide(second.filter("away >= 0"), all_leads=False)
    merged = joined_ranges(first.filter(F.col("away") == PROPOSED).unionByName(third.filter(F.col("away") == PROPOSED)))
    place = ["s_late", "s_id", "s_key", "s_start", "n"]
    ask = merged.select(*place).distinct().groupBy(*[F.col(a).alias(b) for a, b in zip(place[:3], DOC, strict=True)]).agg(F.collect_list(F.struct("s_start", (F.col("n") + F.lit(rule.length - 1)).alias("size"), "n")).alias("list"))
    said = slices_of(_long_texts(docs, rule), ask, "s_late boolean, s_id long, s_key long, s_start long, size long, n long, bytes binary").drop("size").dropDuplicates(place)
    proofs = merged.join(said, place).groupBy(*DOC).agg(F.collect_list(F.struct("start", "n", "bytes")).alias("proofs"))
    exact = first.filter(F.col("away") == EXACT).unionByName(second.filter(F.col("away") == EXACT))
    exact = exact.select(*_doc_of(), start_of("place").alias("start"), F.col("n").cast("long").alias("n")).groupBy(*DOC).agg(F.collect_list(F.struct("start", "n")).alias("exact"))
    return exact.join(proofs, DOC, "full_outer")


def dedup(docs: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) and spans (start, end) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs_of(batches, 1):
            data, at = utf8(b.column(1))
            size = np.diff(at)
            flag = np.zeros(len(data) + 1, dtype=np.int64)

            def mark(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> None:
                np.add.at(flag, at[row] + start, 1)  # noqa: B023
                np.add.at(flag, np.minimum(at[row] + start + n - 1 + rule.length, at[row + 1]), -1)  # noqa: B023

            exact = b.column(2)
            row = np.repeat(np.arange(b.num_rows), np.diff(exact.offsets.to_numpy())) if not exact.null_count else np.repeat(np.arange(b.num_rows), [len(x) if x.is_valid else 0 for x in exact])
            flat = exact.flatten()
            mark(row, flat.field(0).to_numpy(), flat.field(1).to_numpy())
            for r, own in enumerate(b.column(3).to_pylist()):
                for x in own or ():
                    a = at[r] + x["start"]
                    if data[a : a + x["n"] + rule.length - 1].tobytes() == x["bytes"]:
                        mark(np.array([r]), x["start"], x["n"])
            for r in np.flatnonzero(b.column(4).to_numpy(zero_copy_only=False)).tolist():
                mark(np.array([r]), 0, size[r] - rule.length + 1)
            gone = np.cumsum(flag)[:-1] > 0
            ends = np.concatenate([[0], np.cumsum(~gone)])[at]
            kept = data[~gone]
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            edge[at[:-1][size > 0]] = gone[at[:-1][size > 0]]  # runs never cross rows
            stop = gone.copy()
            stop[:-1] &= ~gone[1:]
            stop[at[1:][size > 0] - 1] = gone[at[1:][size > 0] - 1]
            s, e = np.flatnonzero(edge), np.flatnonzero(stop) + 1
            of = np.searchsorted(at, s, side="right") - 1
            spans = np.bincount(of, minlength=b.num_rows)
            bounds = np.searchsorted(of, np.arange(b.num_rows + 1))
            pairs = np.stack([s - at[of], e - at[of]], axis=1) if len(s) else np.zeros((0, 2), np.int64)
            lists = pa.ListArray.from_arrays(pa.array((2 * bounds).astype(np.int32)), pa.array(pairs.reshape(-1)))
            text = pa.array([kept[ends[k] : ends[k + 1]].tobytes() for k in range(b.num_rows)], type=pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(size - np.diff(ends)), pa.array(spans.astype(np.int64)), text, lists], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    joined = _long_texts(docs, rule).join(repeated_starts(docs, rule), DOC, "left")
    joined = joined.withColumn("copy", F.row_number().over(W.partitionBy(*DOC).orderBy("at_id")) > 1)
    none = F.array().cast("array<struct<start: long, n: long>>")
    out = joined.select(F.when(~F.col("late"), F.col("at_id")).alias("doc_id"), "text", F.coalesce("exact", none).alias("exact"), "proofs", "copy").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>")
    small = _texts(docs).filter(F.octet_length("text") < rule.length)
    zero = F.lit(0).cast("long")
    rest = small.select(F.when(~F.col("late"), F.col("at_id")).alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"), F.array().cast("array<long>").alias("spans"))
    return out.unionByName(rest)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
