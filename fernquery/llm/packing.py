"""Vector bin packing of token pieces under limits on tokens, segments and loss-bearing tokens.

Documents are cut freely: full-length pieces become sequences of their own, the tails are items of a
vector bin packing. The open bin takes the item whose demand vector has the largest dot product with
the capacity that is left (each dimension as a share of its limit); when no item fits, one is cut to
fill the bin. Tails that remain when a partition ends are packed likewise and the last sequences are cut
to powers of two, which need no padding.

Each partition packs its own documents while they stream through, with a pool of bounded size, so
nothing is shuffled and a lost task is redone from its input split alone.

Defined results: null or empty text has the closing id only; repeated rows are packed once each, and `row_id` tells their pieces apart; a null
doc_id is carried as null; an empty table gives an empty result; columns other than the id, the text
and `loss_tokens` are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernquery.llm.common import table, trimming

#: Pieces that are given out together; one holds up to 8 kB of ids.
GIVEN = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary, row_id long"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. `loss` counts tokens that bear loss (all but the first of a piece)."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048
    pool: int = 256  # tails held at a time; bounds the memory and the work for a placement


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public tokenizer's file, on whatever machine runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes, with a bounded cache of chunks.

    The pre-tokenizer never joins what stands before a space to what follows it, except a single space
    to the visible text after it, so a text may be cut before every space that visible text follows and
    each chunk encoded alone. Special tokens of the vocabulary stand for themselves wherever a text holds them, as a tokenizer reads them. The
    ids equal those of the same vocabulary's byte_bpe_50k.json.
    """

    loose = re.compile(r" (?=\s)| \Z")
    tight = re.compile(r" (?=\S)")

    def __init__(self, path: str, most: int = 400_000):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most = most
        self.cache: dict[str, bytes] = {}
        with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        if any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that change their surroundings aren't known here")
        self.special = {x["content"]: np.array([x["id"]], dtype="<u4").tobytes() for x in added}
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None

    def _chunk(self, chunk: str) -> bytes:
        return np.asarray(self.bpe.encode_ordinary(chunk), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.around and any(t in text for t in self.special):
            return b"".join(self.special[x] if x in self.special else self._plain(x) for x in self.around.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        parts = self.tight.split(text) if self.loose.search(text) else text.split(" ")
        first, cache = parts[0], self.cache
        rest = parts[1:]
        found = list(map(cache.get, rest))
        if None in found:
            for k, got in enumerate(found):
                if got is None:
                    part = rest[k]
                    got = cache.get(part)
                    if got is None:
                        got = self._chunk(" " + part)
                        if len(part) <= 64:
                            if len(cache) >= self.most:
                                cache.clear()
                            cache[part] = got
                    found[k] = got
        return (self._chunk(first) if first else b"") + b"".join(found)


class Packer:
    """Streams items (document, start, ids, doc_tokens, loss) into sequences and yields finished rows. A document is its doc_id and its row's number."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.items: list[tuple] = []

    def _piece(self, item: tuple, skip: int, n: int) -> tuple:
        doc_id, start, ids, total, loss = item
        part = ids[4 * skip : 4 * (skip + n)]
        left = len(ids) // 4
        bearing = min(n, max(0, loss * n // left)) if left else 0
        return doc_id, start + skip, part, total, bearing

    def _close(self, pieces: list[tuple], rows: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total, loss in pieces:
            n = len(ids) // 4
            rows.append((doc_id[0], start, n, zlib.crc32(ids), total, self.next_id, offset, loss, ids, doc_id[1]))
            offset += n
        self.next_id += 1

    def add(self, doc_id: tuple[int | None, int], ids: bytes, loss: int | None = None) -> list[tuple]:
        rows: list[tuple] = []
        size, total = self.limits.tokens, len(ids) // 4
        item = (doc_id, 0, ids, total, total if loss is None else loss)
        done = 0
        whole = min(size, self.limits.loss)
        while total - done >= whole:
            self._close([self._piece(item, done, whole)], rows)
            done += whole
        if done < total:
            self.items.append(self._piece(item, done, total - done))
            if len(self.items) >= self.limits.pool:
                rows += self.drain(self.limits.pool // 4)
        return rows

    def drain(self, keep: int) -> list[tuple]:
        """Pack until at most `keep` items are left (with 0, all of them)."""
        rows: list[tuple] = []
        limits = self.limits
        caps = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        items = self.items
        need = np.array([[len(x[2]) // 4, 1, x[4]] for x in items], dtype=float).reshape(-1, 3)
        live = np.ones(len(items), dtype=bool)
        while live.sum() > keep:
            if not keep and need[live, 0].sum() < limits.tokens:
                self._powers([x for x, ok in zip(items, live, strict=True) if ok], rows)
                live[:] = False
                break
            left, pieces = caps.copy(), []
            while left[0] >= 1 and left[1] >= 1 and left[2] >= 1 and live.any():
                fits = live & (need <= left).all(axis=1)
                if fits.any():
                    k = int(np.argmax(np.where(fits, (need / caps) @ (left / caps), -1.0)))
                    pieces.append(items[k])
                    left -= need[k]
                    live[k] = False
                    continue
                k = int(np.argmax(np.where(live, need[:, 0], -1.0)))
                n = int(min(left[0], need[k, 0] - 1))
                part = self._piece(items[k], 0, n)
                while n > 1 and part[4] > left[2]:
                    n = int(n * left[2] / part[4]) if part[4] < n * 2 else n // 2
                    n = max(1, n)
                    part = self._piece(items[k], 0, n)
                if n < 1 or part[4] > left[2]:
                    break
                rest_n = int(need[k, 0]) - n
                rest = self._piece(items[k], n, rest_n)
                rest = (*rest[:4], items[k][4] - part[4])
                pieces.append(part)
                items[k], need[k] = rest, (rest_n, 1, rest[4])
                left -= (n, 1, part[4])
            if not pieces:
                raise ValueError("limits allow no piece at all")
            self._close(pieces, rows)
        self.items = [x for x, ok in zip(items, live, strict=True) if ok]
        return rows

    def _powers(self, pieces: list[tuple], rows: list[tuple]) -> None:
        """The last tokens of a partition, in sequences whose lengths are powers of two."""
        queue = list(pieces)
        total = sum(len(x[2]) // 4 for x in queue)
        while total:
            room = 1 << (total.bit_length() - 1)
            took: list[tuple] = []
            loss = 0
            while room and len(took) < self.limits.segments:
                item = queue[0]
                n = len(item[2]) // 4
                use = min(n, room)
                part = self._piece(item, 0, use)
                if loss + part[4] > self.limits.loss:
                    break
                took.append(part)
                loss += part[4]
                room -= use
                total -= use
                if use == n:
                    queue.pop(0)
                else:
                    rest = self._piece(item, use, n - use)
                    queue[0] = (*rest[:4], item[4] - part[4])
            if not took:
                raise ValueError("limits allow no piece at all")
            self._close(took, rows)


def pack(docs: DataFrame, limits: Limits = Limits(), path: str | None = None, closing_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of `docs` (doc_id, text, and loss_tokens if present), as SCHEMA; `ids` is null unless asked for."""
    has_loss = "loss_tokens" in docs.columns
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col("loss_tokens").cast("long").alias("loss_tokens")] if has_loss else []))
    closing = np.array([closing_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path or vocabulary())
        row_id = TaskContext.get().partitionId() << 40
        packer = Packer(limits, row_id)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 8 + [pa.binary(), pa.int64()]

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(rows), GIVEN):
                columns = list(zip(*rows[low : low + GIVEN], strict=True))
                if not with_ids:
                    columns[8] = [None] * len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

        rows: list[tuple] = []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            loss = batch.column(2).to_pylist() if has_loss else None
            for k in range(batch.num_rows):
                tokens = encode(texts[k].as_py() or "") + closing
                n = len(tokens) // 4
                rows += packer.add((ids[k], row_id), tokens, None if loss is None else min(n, max(0, loss[k] if loss[k] is not None else n)))
                row_id += 1
                if len(rows) >= GIVEN:
                    yield from out(rows)
                    rows = []
        rows += packer.drain(0)
        yield from out(rows)

    return slim.mapInArrow(trimming(run), SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
