"""Packing token ids into sequences of a fixed length by bounded-space online packing.

Each partition keeps a fixed number of open windows. What of a document fills whole sequences is cut off first; the
rest goes to the open window with the least room that holds it. When none does, the fullest one is filled up with the
rest's first ids and emitted. What is left in open windows at the end is merged in rounds of a fixed number of
partitions a task, and the last ids are cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .stretches import StretchEncoder, batches, bpe_encode, lasting

#: Tokens of a sequence; open windows of a partition; partitions whose windows meet in one merging task.
LENGTH = 2048
WINDOWS = 16
FAN_IN = 32

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces of windows that are still open carry their ids; part and window tell where they lie.
PACKED = f"{PIECE}, part int, window int, ids binary"
NAMES = [c.split()[0] for c in PACKED.split(", ")]


class Packer:
    """The open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, length: int = LENGTH, windows: int = WINDOWS) -> None:
        self._next, self._length, self._windows = first_id, length, windows
        self.open: list[tuple[int, list[tuple]]] = []
        self._rows: list[tuple] = []

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        """Places a piece, in parts where it must be cut."""
        while len(ids) >= self._length:
            self._emit([(doc_id, start, ids[: self._length], doc_tokens)])
            start, ids = start + self._length, ids[self._length :]
        while len(ids):
            need, best = len(ids), -1
            for k, (used, _) in enumerate(self.open):
                if used + need <= self._length and (best < 0 or used > self.open[best][0]):
                    best = k
            if best < 0 and len(self.open) < self._windows:
                self.open.append((0, []))
                best = len(self.open) - 1
            if best < 0:
                best = max(range(len(self.open)), key=lambda k: self.open[k][0])
            used, pieces = self.open[best]
            take = min(need, self._length - used)
            pieces.append((doc_id, start, ids[:take], doc_tokens))
            self.open[best] = (used + take, pieces)
            start, ids = start + take, ids[take:]
            if used + take == self._length:
                self._emit(self.open.pop(best)[1])

    def close(self) -> None:
        """Emits all that is open: full sequences, then a power of two each."""
        left, self.open = [p for _, pieces in self.open for p in pieces], []
        total = sum(len(p[2]) for p in left)
        room, held = 0, []
        for doc_id, start, ids, doc_tokens in left:
            while len(ids):
                if not room:
                    room = min(self._length, 1 << (total.bit_length() - 1))
                take = min(room, len(ids))
                held.append((doc_id, start, ids[:take], doc_tokens))
                start, ids, room, total = start + take, ids[take:], room - take, total - take
                if not room:
                    self._emit(held)
                    held = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self._rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, self._next, offset, None, None, None))
            offset += len(ids)
        self._next += 1

    def taken(self) -> pa.RecordBatch:
        """The rows of sequences emitted since the last call."""
        rows, self._rows = self._rows, []
        return batch_of(rows)

    def left(self, part: int) -> pa.RecordBatch:
        """The pieces in open windows, with their ids."""
        return batch_of([(d, s, len(ids), None, n, None, None, part, w, ids.astype("<u4").tobytes()) for w, (_, pieces) in enumerate(self.open) for d, s, ids, n in pieces])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], NAMES)


def packed(encoder: StretchEncoder, source: Iterable[pa.RecordBatch], part: int, end_id: int, length: int, windows: int) -> Iterator[pa.RecordBatch]:
    """Encodes and packs the documents of one partition."""
    packer, end = Packer(part << 32, length, windows), np.array([end_id], np.uint32)
    for batch in source:
        doc_ids, texts = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for low, high in batches(sizes):
            flat, lens = encoder.ids(texts.slice(low, high - low))
            at = 0
            for doc_id, n in zip(doc_ids.slice(low, high - low).to_pylist(), lens.tolist()):
                packer.add(doc_id, 0, np.append(flat[at : at + n], end), n + 1)
                at += n
            yield packer.taken()
    yield packer.left(part)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH, windows: int = WINDOWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids without special tokens and end_id. All sequences hold `length` ids but the last ones, which
    hold powers of two; nothing is padded. length must be a power of two. Null text: the end id alone. Null doc_id: kept.
    Equal rows: each for itself. Very long texts: many whole sequences. Empty table: no rows. Other columns are not
    carried. A merging task sees at most FAN_IN * windows sequences, whatever the size of the table.
    """
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as f:
        known = f.read()
    digest, vocabulary = hashlib.sha256(known.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(known)

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = lasting(f"packing {digest}", lambda: StretchEncoder(bpe_encode(vocabulary.value), spaced=True))
        yield from packed(encoder, source, TaskContext.get().partitionId(), end_id, length, windows)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = common.saved(rows.mapInArrow(work, PACKED), "packed")
    done, open_ = made.filter("ids is null"), made.filter("ids is not null")
    tasks, level = (open_.agg(F.max("part")).first()[0] or 0) + 1, 1
    while True:
        tasks = -(-tasks // FAN_IN)
        merged = common.saved(merge(open_, level, tasks == 1, length, windows), "merged")
        done, open_ = done.unionAll(merged.filter("ids is null")), merged.filter("ids is not null")
        if tasks == 1:
            return done.select(*[c.split()[0] for c in PIECE.split(", ")])
        level += 1


def merge(open_: DataFrame, level: int, last: bool, length: int, windows: int) -> DataFrame:
    """Packs the open windows of FAN_IN tasks together; the last round leaves none open."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        task = key[0].as_py()
        packer = Packer((level << 56) + (task << 32), length, windows)
        rows = sorted(table.select(["part", "window", "doc_id", "start", "ids", "doc_tokens"]).to_pylist(), key=lambda r: (r["part"], r["window"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids"]))
        for r in rows:
            packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
        if last:
            packer.close()
        return pa.Table.from_batches([packer.taken(), packer.left(task)])

    return open_.withColumn("_task", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("_task").applyInArrow(work, PACKED)
