"""Packing of tokenised documents into sequences of a fixed capacity (operator 5).

Harmonic packing: a piece of length l is of class k = capacity // l, and a sequence of class k
holds exactly k pieces. Documents are cut first: into whole sequences, then into halves,
quarters and so on of the capacity (which fill their classes without padding) down to
``GRAIN``; what is left, shorter than that, stays whole and is of a class whose sequences are at least
k / (k + 1) full. Each task fills its own sequences as rows stream by and keeps at most
k - 1 open pieces of a class, so there is no shuffle, and a lost task is redone alike.
When a task's rows end, its open short pieces are cut into powers of two, and all open pieces, longest
first, fill sequences again; the last of them has power-of-two sizes, which need no padding.

Null or empty text is the end id alone. Repeated rows are packed once each, null doc_ids stay null.
Sequence ids: task in the upper bits, count in the lower 40.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.textual import batches
from quern.llm.tokens import encoder

CAPACITY, GRAIN, END_ID = 2048, 64, 1


def cut(length: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    out = [capacity] * (length // capacity)
    rest, half = length % capacity, capacity // 2
    while rest and half >= grain:
        if rest >= half:
            out.append(half)
            rest -= half
        half //= 2
    return [*out, rest] if rest else out


class Packer:
    """Pieces (anything, start, length) in, sequences (lists of pieces) out."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.open = capacity, {}

    def add(self, piece: tuple) -> list[tuple] | None:
        k = self.capacity // piece[2]
        own = self.open.setdefault(k, [])
        own.append(piece)
        if len(own) == k:
            del self.open[k]
            return own
        return None

    def close(self) -> Iterator[list[tuple]]:
        rest = []
        for own in self.open.values():
            for what, start, length in own:
                while length:
                    part = 1 << (length.bit_length() - 1)
                    rest.append((what, start, part))
                    start, length = start + part, length - part
        self.open = {}
        rest.sort(key=lambda p: -p[2])
        total = sum(p[2] for p in rest)
        at = 0
        while total:
            # descending powers of two meet every smaller power of two exactly
            room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= room
            own = []
            while room:
                own.append(rest[at])
                room -= rest[at][2]
                at += 1
            yield own


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: where it is in its document and in its sequence, and the crc32 of its ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary).encode, Packer(capacity)
        base, count = TaskContext.get().partitionId() << 40, 0

        def rows(sequences: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal count
            out: list[list[int]] = [[] for _ in SCHEMA]
            for own in sequences:
                offset = 0
                for (doc, tokens, ids, first), start, length in own:
                    crc = zlib.crc32(ids[4 * (start - first) : 4 * (start - first + length)])
                    for c, v in zip(out, (doc, start, length, crc, tokens, base + count, offset), strict=True):
                        c.append(v)
                    offset += length
                count += 1
            return pa.record_batch([pa.array(c, t.type) for c, t in zip(out, SCHEMA, strict=True)], schema=SCHEMA)

        for batch in it:
            full = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist()), strict=True):
                ids += end_id.to_bytes(4, "little")
                start, tokens = 0, len(ids) // 4
                for length in cut(tokens, capacity):
                    own = ids[4 * start : 4 * (start + length)]  # an open piece keeps its own ids only
                    if done := packer.add(((doc, tokens, own, start), start, length)):
                        full.append(done)
                    start += length
            yield rows(full)
        yield rows(list(packer.close()))

    batches(docs.sparkSession, 256)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DDL)
