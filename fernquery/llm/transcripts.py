"""Transcript parsing: a hidden Markov model over speaker-marker and line features recovers roles by Viterbi.

Input rows are pieces of transcripts (conv_id, turn, text), read in order of turn. Each line of text is one observation: the
role that a speaker marker at its start names (if any), whether it opens a block (first line of a row, or after a blank line),
whether it ends as a question, and whether it is long. A hidden state is a role and whether the line opens that role's turn.
Viterbi finds the likeliest states of a conversation; runs of them are turns, rendered canonically as
`<|role|>` newline, text without the marker, newline `<|end|>`.

Parameters are counted, with add-one smoothing, from labelled transcripts (a few hundred numbers at most, summed
before they reach the driver), or the defaults.

Rows are dealt by conversation and streamed twice, so that a hot conversation needs no more memory than a row: forwards, where each line leaves the
best state before it for each of its states (six bytes a line), and backwards, where the likeliest path is read off these and turns are
rendered. The path is that of the whole conversation, however long it is. Output is one row for each piece of a turn within an input row: the first
piece of a turn opens it, the last one closes it, and the pieces of a turn joined by line feeds are the rendered turn.

Defined results: null and empty texts have one empty line, which continues the turn at hand; a row with a null conv_id is a conversation of its own;
null turns come first, rows of one turn by their text; repeated rows are parsed one after the other; ties go to the earlier state in STATES; an empty table gives an empty
result; other columns don't take part, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernquery.llm.common import table

ROLES = ("system", "user", "assistant")
STATES = tuple((role, opens) for role in ROLES for opens in (True, False))
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "me", "prompt"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent", "response"),
}
_NAMES = {name: role for role, names in MARKERS.items() for name in names}
_WORDS = "|".join(sorted(_NAMES, key=len, reverse=True))
MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?\s*({_WORDS})\s*\|?>?|\[({_WORDS})\]:?|\#{{2,4}}\s*({_WORDS})\s*:?(?=\s|$)|\*{{2}}({_WORDS}):?\*{{2}}:?|({_WORDS})\s*[:>])\s*", re.IGNORECASE)
LONG = 160


def read_line(line: str, opens: bool) -> tuple[int, int, int]:
    """(marker: 0 none or 1 + role, features as bits: opens a block, question, long; length of the marker)."""
    m = MARKER.match(line) if line else None
    mark = 1 + ROLES.index(_NAMES[next(g for g in m.groups() if g).lower()]) if m else 0
    bits = int(opens) | (line.rstrip().endswith("?") << 1) | ((len(line) > LONG) << 2)
    return mark, bits, m.end() if m else 0


def _default() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start = np.log(np.array([0.3, 1e-6, 0.6, 1e-6, 0.1, 1e-6]))
    move = np.full((6, 6), 1e-6)
    follow = {0: (0.02, 0.9, 0.08), 1: (0.02, 0.08, 0.9), 2: (0.02, 0.9, 0.08)}
    for r in range(3):
        for opens in range(2):
            move[2 * r + opens, 2 * r + 1] = 0.6
            for s, p in enumerate(follow[r]):
                move[2 * r + opens, 2 * s] = 0.4 * p
    mark = np.full((6, 4), 1e-3)
    for r in range(3):
        mark[2 * r, [0, 1 + r]] = 0.45, 0.55
        mark[2 * r + 1, 0] = 0.997
    bits = np.full((6, 8), 0.0)
    for s, (role, opens) in enumerate(STATES):
        for b in range(8):
            p = (0.9 if b & 1 else 0.1) if opens else (0.15 if b & 1 else 0.85)
            p *= (0.25 if b & 2 else 0.75) if role == "user" else (0.08 if b & 2 else 0.92)
            bits[s, b] = p * ((0.5 if b & 4 else 0.5) if role == "assistant" else (0.3 if b & 4 else 0.7))
    return start, np.log(move / move.sum(1, keepdims=True)), np.log(mark / mark.sum(1, keepdims=True)), np.log(bits / bits.sum(1, keepdims=True))


@dataclass
class Model:
    """Logarithms of the start, transition and emission probabilities."""

    start: np.ndarray = field(default_factory=lambda: _default()[0])
    move: np.ndarray = field(default_factory=lambda: _default()[1])
    mark: np.ndarray = field(default_factory=lambda: _default()[2])
    bits: np.ndarray = field(default_factory=lambda: _default()[3])

    def emit(self, seen: list[tuple[int, int, int]]) -> np.ndarray:
        x = np.array([(m, b) for m, b, _ in seen]).reshape(-1, 2)
        return self.mark[:, x[:, 0]].T + self.bits[:, x[:, 1]].T

    def forward(self, seen: list[tuple[int, int, int]], before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(scores of the last line's states, the best state before each line for each of its states), from the scores before the first line."""
        e = self.emit(seen)
        back = np.zeros((len(seen), len(STATES)), dtype=np.int8)
        v = before
        for t in range(len(seen)):
            if v is None:
                v = e[t] + self.start
                continue
            w = v[:, None] + self.move
            back[t] = w.argmax(axis=0)
            v = w.max(axis=0) + e[t]
        return v, back

    def viterbi(self, seen: list[tuple[int, int, int]]) -> list[int]:
        """The likeliest states of one conversation."""
        if not seen:
            return []
        v, back = self.forward(seen, None)
        return trace(back, int(v.argmax()))[0]


def trace(back: np.ndarray, last: int) -> tuple[list[int], int]:
    """(states of the lines, the state before them), given the state of the last line."""
    path = []
    for t in range(len(back) - 1, -1, -1):
        path.append(last)
        last = int(back[t, last])
    return path[::-1], last


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _observe(text: str | None) -> list[tuple[int, int, int]]:
    out, opens = [], True
    for line in _lines(text):
        out.append(read_line(line, opens))
        opens = not line.strip()
    return out


def parse(rows: DataFrame, model: Model) -> DataFrame:
    """Pieces of recovered turns: conv_id, turn, first_line, n_lines, role, opens, marked, rendered."""
    schema = "conv_id long, turn long, first_line long, n_lines long, role string, opens boolean, marked boolean, rendered string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.bool_(), pa.string()]

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scores, seq = None, None, 0
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                backs, seqs, finals = [], [], []
                for conv, text in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if conv is None or conv != now:
                        now, scores, seq = conv, None, 0
                    scores, back = model.forward(_observe(text), scores)
                    backs.append(back.tobytes())
                    seqs.append(seq)
                    finals.append(int(scores.argmax()))
                    seq += 1
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(seqs, type=pa.int64()), pa.array(backs, type=pa.binary()), pa.array(finals, type=pa.int32())], names=["deal", "conv_id", "turn", "text", "seq", "back", "final"])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, follows = None, 0, False  # follows: whether the next line goes on with this line's turn
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                out: list[tuple] = []
                for conv, turn, text, back, final in zip(*(b.column(k).slice(lo, 1024).to_pylist() for k in (1, 2, 3, 5, 6)), strict=True):
                    if conv is None or conv != now:
                        now, state, follows = conv, final, False
                    lines, seen = _lines(text), _observe(text)
                    own, state = trace(np.frombuffer(back, dtype=np.int8).reshape(-1, len(STATES)), state)
                    stop = len(own)
                    while stop:
                        k = stop - 1
                        while k and not STATES[own[k]][1]:
                            k -= 1
                        role, opens = STATES[own[k]]
                        body = "\n".join([lines[k][seen[k][2] :] if opens else lines[k], *lines[k + 1 : stop]])
                        out.append((conv, turn, k, stop - k, role, opens, seen[k][0] > 0, (f"<|{role}|>\n" if opens else "") + body + ("" if follows else "\n<|end|>")))
                        stop, follows = k, not opens
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    conv, turn, text = F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("text").cast("string")
    deal = F.coalesce(conv, F.xxhash64(turn, text))  # rows without a conversation are spread
    slim = rows.select(deal.alias("deal"), conv.alias("conv_id"), turn.alias("turn"), text.alias("text"))
    order = ["deal", "conv_id"]
    told = slim.repartition("deal").sortWithinPartitions(*order, "turn", "text").mapInArrow(forwards, "deal long, conv_id long, turn long, text string, seq long, back binary, final int")
    return told.repartition("deal").sortWithinPartitions(*order, F.desc("seq")).mapInArrow(backwards, schema)


def estimate(rows: DataFrame) -> Model:
    """A model counted from rows (conv_id, turn, role, text) whose role is known; other roles are skipped."""
    slim = rows.filter(F.col("role").isin(*ROLES)).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, int, int], int] = {}
        now, before = object(), None
        for b in batches:
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if conv != now:
                    now, before = conv, None
                for k, (mark, bits, _) in enumerate(_observe(text)):
                    s = 2 * ROLES.index(role) + (k > 0)
                    for key in ((0, 0, s) if before is None else (1, before, s), (2, s, mark), (3, s, bits)):
                        count[key] = count.get(key, 0) + 1
                    before = s
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*((*k, n) for k, n in count.items()), strict=True)], names=["kind", "i", "j", "n"])

    counts = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text").mapInArrow(run, "kind long, i long, j long, n long").groupBy("kind", "i", "j").agg(F.sum("n").alias("n"))
    held = [np.ones((1, 6)), np.ones((6, 6)), np.ones((6, 4)), np.ones((6, 8))]
    for r in counts.collect():  # at most 6 + 36 + 24 + 48 rows
        held[r["kind"]][r["i"], r["j"]] += r["n"]
    start, move, mark, bits = (np.log(x / x.sum(axis=1, keepdims=True)) for x in held)
    return Model(start[0], move, mark, bits)


STYLES = ("{}: ", "### {}\n", "<|{}|>\n", "[{}] ", "**{}:** ")


def as_transcripts(rows: DataFrame) -> DataFrame:
    """rows with text as a transcript would have it: three in four turns open with a marker, in a style by conversation."""
    h = F.xxhash64("conv_id", "turn", "text")
    style = F.element_at(F.array(*[F.lit(s) for s in STYLES]), (F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))) + 1).cast("int"))
    mark = F.when(F.pmod(h, F.lit(4)) > 0, F.replace(style, F.lit("{}"), F.initcap("role"))).otherwise("")
    return rows.withColumn("text", F.concat(F.coalesce(mark, F.lit("")), F.coalesce("text", F.lit(""))))


def op1_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    raw = as_transcripts(rows)
    model = estimate(raw.filter(F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) != 1))
    return parse(raw, model)
