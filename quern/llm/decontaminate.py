"""Documents that contain benchmark items (operator 10).

An item is contained in a document when at least 80 % of its five-word shingles are in it. Items
are partitioned by size (powers of two of their number of shingles); in a partition each
item keeps a MinHash sketch of a length fixed by the partition: its k smallest shingles under a
random order, k being one more than a fifth of the largest size. A contained item
misses at most a fifth of its shingles, so at least one of its k is in the document: the search
misses nothing. Every document whose shingles meet a sketch is verified by exact shingle
containment. Items are taken in blocks of ``BLOCK`` shingles, the most that is sent to the executors at once; the
documents, however long, are read once a block and never shuffled.

An item of fewer than five words is one shingle of all its words; an item without words is
contained nowhere. Null or empty text contains nothing. Rows with null ids take part; repeated rows are reported
once each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.textual import WIDTH, batch_shingles, batches, combine, mix, shingles, text_bytes, word_hashes
from quern.storage import scratch, stored

SHARE = 80
BLOCK = 1_000_000
ORDER = np.uint64(0x8EBC6AF09C88C6E3)
FILTER_BITS = 22


def sketch_length(n: int) -> int:
    """Of the size partition that n shingles belong to; at least n - ceil(0.8 n) + 1."""
    return (2 ** n.bit_length() - 1) * (100 - SHARE) // 100 + 1


def sketch(s: np.ndarray) -> np.ndarray:
    return s[np.argsort(mix(s ^ ORDER), kind="stable")[: sketch_length(len(s))]]


class Items:
    """A block of items: sorted shingles of each, and the sketch index over all."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        """rows: (item_id, words in a shingle, shingles)."""
        self.ids = [r[0] for r in rows]
        self.sets = [np.frombuffer(r[2], "u8") for r in rows]
        self.index = {}
        for width in sorted({r[1] for r in rows}):
            own = [k for k, r in enumerate(rows) if r[1] == width]
            hashes = [sketch(self.sets[k]) for k in own]
            h, item = np.concatenate(hashes), np.repeat(own, [len(x) for x in hashes])
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << FILTER_BITS, bool)
            table[h >> np.uint64(64 - FILTER_BITS)] = True
            self.index[width] = (h[order], item[order], table)

    def contained(self, s: np.ndarray, width: int) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items in a document with the sorted shingles ``s``."""
        h, item, table = self.index[width]
        near = s[table[s >> np.uint64(64 - FILTER_BITS)]]
        lo, hi = np.searchsorted(h, near, "left"), np.searchsorted(h, near, "right")
        found = {int(k) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) for k in item[a:b]}
        out = []
        for k in sorted(found):
            q = self.sets[k]
            at = np.searchsorted(s, q)
            shared = int((s[np.minimum(at, len(s) - 1)] == q).sum())
            if 100 * shared >= SHARE * len(q):
                out.append((k, shared))
        return out

    def search(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles)."""
        words, before = word_hashes(*text_bytes(column))
        out = []
        for width in self.index:
            if width == WIDTH:
                sets = [s if hi - lo >= WIDTH else s[:0] for s, lo, hi in zip(shingles(words, before), before[:-1], before[1:], strict=True)]
            else:
                sets = [np.unique(combine(words[lo:hi], width)) for lo, hi in zip(before[:-1], before[1:], strict=True)]
            out += [(row, k, shared) for row, s in enumerate(sets) if len(s) for k, shared in self.contained(s, width)]
        return sorted(out)


def _item_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        words, before = word_hashes(*text_bytes(b["text"]))
        sets = batch_shingles(b["text"])
        width = np.minimum(np.diff(before), WIDTH)
        yield pa.record_batch([b["item_id"], pa.array(width, pa.int32()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["item_id", "width", "n", "shingles"])


def _blocks(spark: SparkSession, benchmark: DataFrame) -> list[Broadcast]:
    """The items in blocks of about ``BLOCK`` shingles, each sent to the executors."""
    with scratch():
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        items = stored(items.mapInArrow(_item_rows, "item_id long, width int, n long, shingles binary").filter("n > 0").distinct(), "items")
        total = items.agg(F.sum("n")).first()[0] or 0
        count, out = max(1, math.ceil(total / BLOCK)), []
        for k in range(count):
            own = items.filter(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(count)) == k).orderBy("item_id", "n").collect()
            out.append(spark.sparkContext.broadcast(Items([(r.item_id, r.width, bytes(r.shingles)) for r in own])))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles) for each contained item of each document."""
    spark = docs.sparkSession
    batches(spark)
    docs, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None
    for block in _blocks(spark, benchmark):

        def search(it: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            x = block.value
            for b in it:
                hits = x.search(b["text"])
                yield pa.record_batch(
                    [b["doc_id"].take(pa.array([h[0] for h in hits], pa.int64())), pa.array([x.ids[h[1]] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()), pa.array([len(x.sets[h[1]]) for h in hits], pa.int64())],
                    ["doc_id", "item_id", "shared", "n_shingles"],
                )

        found = docs.mapInArrow(search, "doc_id long, item_id long, shared long, n_shingles long")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item: one filter a block of items, and no shuffle.

    Each row is judged by its own text, so a doc_id may be null, or stand by several texts.
    """
    spark, schema = docs.sparkSession, docs.schema
    batches(spark)
    for block in _blocks(spark, benchmark):

        def kept(it: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in it:
                own = np.ones(b.num_rows, bool)
                own[[row for row, _, _ in block.value.search(b["text"])]] = False
                yield b.filter(pa.array(own))

        docs = docs.mapInArrow(kept, schema)
    return docs
