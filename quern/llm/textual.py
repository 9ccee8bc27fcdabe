"""Words and word shingles of whole Arrow batches as 64-bit hashes, computed with numpy.

A word is a maximal run of bytes other than space and \\t..\\r, with A-Z lower-cased. Work goes
in segments of about 256 KB cut between words, so memory does not depend on a text's length
(beyond the text and 8 bytes a word).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

WIDTH = 5
SEGMENT = 1 << 18
#: Odd multipliers; any odd numbers do, but all workers must use the same.
BASE = np.uint64(0x9E3779B97F4A7C15)
STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], "u8") | np.uint64(1)

_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256)
_lower[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_byte = mix(np.arange(1, 257, dtype="u8") * BASE)[_lower]


def batches(spark: SparkSession, rows: int = 512) -> None:
    """Small Arrow batches: texts may be long, and two Python workers share an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least n of each."""
    if not _powers or len(_powers["up"]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for key, base in (("up", BASE), ("down", inverse)):
            x = np.full(n, base, "u8")
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column one after another, and where each text starts (and the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, starts, data = column.buffers()
    if not len(column):
        return np.zeros(0, "u1"), np.zeros(1, "i8")
    starts = np.frombuffer(starts, "i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, "u1")[starts[0] : starts[-1]] if data is not None and data.size else np.zeros(0, "u1")
    return data, starts - starts[0]


def _segment(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and hashes in a segment that begins and ends between words; first: the bytes where texts start."""
    n = len(data)
    up, down = _power(max(n + 1, SEGMENT + 1))
    black = ~_white[data]
    cut = np.zeros(n + 1, bool)
    cut[first] = True
    cut[0] = cut[n] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, black[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, black[1:]
    begin = np.flatnonzero(black & (~before | cut[:-1]))
    end = np.flatnonzero(black & (~after | cut[1:])) + 1
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, "u8")
        total[0] = 0
        np.cumsum(_byte[data] * up[:n], out=total[1:])
        return begin, mix((total[end] - total[begin]) * down[begin])


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text (and in all)."""
    n, at, begins, hashes = len(data), 0, [], []
    while at < n:
        end = min(n, at + SEGMENT)
        if end < n:
            back = np.flatnonzero(_white[data[at:end]])
            text = starts[np.searchsorted(starts, end, "right") - 1]
            end = max(at, int(text), at + int(back[-1]) + 1 if len(back) else at)
            while end == at:  # one word longer than a segment
                step = at + SEGMENT
                while step < n and not _white[data[step : step + SEGMENT]].any() and not np.any((starts > step) & (starts <= step + SEGMENT)):
                    step += SEGMENT
                white = np.flatnonzero(_white[data[step : step + SEGMENT]])
                later = starts[np.searchsorted(starts, at, "right") :]
                end = min([n, *(step + white[:1] + 1).tolist(), *later[later > at][:1].tolist()])
        lo, hi = np.searchsorted(starts, [at, end])
        b, h = _segment(data[at:end], starts[lo:hi] - at)
        begins.append(b + at)
        hashes.append(h)
        at = end
    begin = np.concatenate(begins) if begins else np.zeros(0, "i8")
    return np.concatenate(hashes) if hashes else np.zeros(0, "u8"), np.searchsorted(begin, starts)


def combine(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, in order."""
    if len(words) < width:
        return np.zeros(0, "u8")
    with np.errstate(over="ignore"):
        total = np.full(len(words) - width + 1, width, "u8")
        for i in range(width):
            total += words[i : len(words) - width + 1 + i] * STEPS[i]
        return mix(total)


def shingles(words: np.ndarray, before: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; fewer words than ``width`` make one shingle, none make none."""
    all_ = combine(words, width)
    out = []
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if hi - lo >= width:
            s = np.sort(all_[lo : hi - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(combine(words[lo:hi], hi - lo) if hi > lo else np.zeros(0, "u8"))
    return out


def batch_shingles(column: pa.Array | pa.ChunkedArray, width: int = WIDTH) -> list[np.ndarray]:
    return shingles(*word_hashes(*text_bytes(column)), width)
