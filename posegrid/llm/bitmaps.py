"""Bitmaps of hashed keys, by which most rows skip a shuffle.

A bitmap is a small table (slot, bits) of 4 KB rows. Its size follows the number of
keys up to a fixed bound, so it may be broadcast at any scale; beyond that bound it
lets more rows through, no more. Being in a bitmap proves nothing: an exact join
must follow. Being absent is sure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Bits of one row, fixed by bitmap_construct_agg, bits wanted a key, and rows at most: 16 MB are broadcast.
ROW_BITS, PER_KEY, MOST_ROWS = 32_768, 16, 4096


class Bitmap:
    """Hashes of `columns` of a table; the table should be cheap to read twice."""

    def __init__(self, keys: DataFrame, *columns: str):
        self.rows = 1
        wanted = -(-keys.count() * PER_KEY // ROW_BITS)
        while self.rows < min(wanted, MOST_ROWS):
            self.rows *= 2
        place = self._place([F.col(c) for c in columns])
        self.table = keys.select(place.alias("p")).groupBy(self._slot(F.col("p")).alias("slot")).agg(F.bitmap_construct_agg(F.col("p") % ROW_BITS).alias("bits"))

    def _place(self, columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns, F.lit(self.rows)), F.lit(self.rows * ROW_BITS))

    @staticmethod
    def _slot(place: Column) -> Column:
        return F.floor(place / ROW_BITS).cast("int")

    def split(self, df: DataFrame, *columns: str, held: bool) -> DataFrame:
        """Rows of df that may be among the keys (`held`), or those that surely are not."""
        slot, bits = unused("slot", df), unused("bits", df)
        place = self._place([F.col(c) for c in columns])
        bit = (place % ROW_BITS).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = (self._slot(place) == F.col(slot)) & (F.getbit(byte, bit % 8) == 1)
        return df.join(F.broadcast(self.table.toDF(slot, bits)), found, "left_semi" if held else "left_anti")
