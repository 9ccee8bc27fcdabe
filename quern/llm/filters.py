"""A bit filter of bounded size over 64-bit keys: tells quickly which keys are surely not in a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Powers of two between which the number of bits lies; 16 bits a key as far as that goes (2**28 bits are 32 MB).
LEAST, MOST = 20, 28
_WORD = 32768  # bits that Spark's bitmap functions put in a row


class BitFilter:
    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> BitFilter:
        """The filter of the bigint ``column``; bits are gathered by tasks, so the driver gets the bits only, no keys."""
        size = min(MOST, max(LEAST, (16 * keys.count()).bit_length()))
        place = (F.pmod(F.col(column), F.lit(1 << size)) + 1).alias("place")
        rows = keys.select(place).groupBy(F.bitmap_bucket_number("place").alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        table = np.zeros((1 << size) // 8, "u1")
        for r in rows.collect():
            table[(r["word"] - 1) * (_WORD // 8) : r["word"] * (_WORD // 8)] = np.frombuffer(r["bits"], "u1")
        return cls(table)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        """For each int64 key whether it may be in the table; false is certain."""
        place = keys.view("u8") & np.uint64(8 * len(self.table) - 1)
        return (self.table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype("u1") & 1).astype(bool)
