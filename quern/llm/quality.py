"""Quality by compression: the text is compressed with a dictionary of good and one of bad text (operator 6).

Two zstandard dictionaries are trained from labelled texts. A text is cut into blocks of a
fixed size, all of which are compressed alone with either dictionary, so that a dictionary
matters alike in short and in long texts. The difference of both sizes, normalised by the bytes of the text, is
calibrated to the chance of label 1 by isotonic regression; nothing else enters the score. (Normalised by the
compressed sizes instead, texts of one word repeated would stand out by chance alone.) Fitting uses a bounded sample (``learning.SAMPLE_ROWS`` rows,
``DICTIONARY_BLOCKS`` blocks a label) of labelled rows that are not held out; one half makes
dictionaries, the other half calibrates.

Null or empty text has difference 0, and gets the score of that. Null doc_id: not held out. Without enough
labelled text for two dictionaries, every difference is 0 and every score is the base rate of the labels (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.learning import Isotonic, held_out, sample
from quern.llm.textual import batches

BLOCK, LEVEL, DICTIONARY, DICTIONARY_BLOCKS = 1024, 3, 64 << 10, 6000
#: Bytes added to a text's own, so that a few words do not weigh like a page.
EXTRA = 64
#: Below this score a document counts as rejected.
KEEP = 0.3


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class QualityModel:
    """Picklable: dictionaries are bytes, compressors are made where they are used."""

    def __init__(self, good: bytes, bad: bytes, calibration: Isotonic | None = None):
        self.good, self.bad, self.calibration = good, bad, calibration
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _compressors(self):
        if self._made is None:
            self._made = []
            for d in (self.good, self.bad):
                z = zstandard.ZstdCompressionDict(d)
                z.precompute_compress(LEVEL)
                self._made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_content_size=False, write_dict_id=False, write_checksum=False))
        return self._made

    def measure(self, text: str | None) -> float:
        """Size with the bad dictionary less size with the good one, over the bytes of the text and ``EXTRA``."""
        data = (text or "").encode("utf-8", "replace")
        if not data or not self.good or not self.bad:
            return 0.0
        good, bad = self._compressors()
        return sum(len(bad.compress(x)) - len(good.compress(x)) for x in blocks(data)) / (len(data) + EXTRA)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.calibration(np.array([self.measure(t) for t in texts], float))


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little text
        return b"".join(samples)[:DICTIONARY] if sum(map(len, samples)) >= 8 else b""


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    batches(docs.sparkSession)
    rows = sample(docs, labels, label)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for y, t in zip(b["label"].to_pylist(), b["text"].to_pylist(), strict=True):
                own = blocks((t or "").encode("utf-8", "replace"))
                yield pa.record_batch([pa.array([y] * len(own), pa.int32()), pa.array(own, pa.binary())], ["label", "block"])

    pieces = rows.filter("fold = 0").mapInArrow(cut, "label int, block binary")
    drawn = {y: [bytes(r.block) for r in pieces.filter(F.col("label") == y).distinct().orderBy(F.xxhash64("block"), "block").limit(DICTIONARY_BLOCKS).collect()] for y in (1, 0)}
    model = QualityModel(_dictionary(drawn[1]), _dictionary(drawn[0]))

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch([b["label"], pa.array([model.measure(t) for t in b["text"].to_pylist()], pa.float64())], ["label", "x"])

    got = sorted((r.x, r.label) for r in rows.filter("fold = 1").mapInArrow(measure, "label int, x double").collect())
    model.calibration = Isotonic(np.array([g[0] for g in got]), np.array([g[1] for g in got], float))
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch([b["doc_id"], b["held_out"], pa.array(model.score(b["text"].to_pylist()))], ["doc_id", "held_out", "score"])

    batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def keep(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``KEEP``."""
    schema = docs.schema

    def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array(model.score(b["text"].to_pylist()) >= KEEP))

    batches(docs.sparkSession)
    return docs.mapInArrow(kept, schema)
