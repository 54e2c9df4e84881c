"""Bit maps of a fixed size that tell words which a table surely does not hold; they spare shuffles and need an exact join behind them."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A map has 2^BITS bits, 4 MB, whatever the table.
BITS = 25


def bitmap(words: DataFrame, word: Column) -> bytes:
    slot = F.crc32(F.encode(word, "utf-8")).bitwiseAND(F.lit((1 << BITS) - 1))
    parts = words.select(slot.alias("slot")).groupBy(F.expr("slot div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits")).collect()
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in parts:
        got = np.frombuffer(bytes(r.bits), np.uint8)
        out[r.part * 4096 : r.part * 4096 + len(got)] = got
    return out.tobytes()


class Members(dict):
    """Whether a bit map may hold a word; asked once a word for as long as this lives."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def __missing__(self, w: str) -> bool:
        slot = zlib.crc32(w.encode()) & ((1 << BITS) - 1)
        self[w] = out = bool(self.bits[slot >> 3] >> (slot & 7) & 1)
        return out
