"""Leaving out, before an exchange, rows that a join would drop.

The keys of the join's small side are marked in a bitmap of ``BITS`` bits by their hash.  It
has a bounded size whatever the number of keys, so it is broadcast, and rows whose bit isn't
set have no match.  Rows whose bit is set by another key stay, so the join itself is still
needed; with many more keys than bits nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 16 MB in words of 4 KB; the number of keys up to which most rows without a match go.
BITS = 1 << 27


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(BITS))


def may_match(rows: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` can equal one of ``kept``'s (a column of the same name and
    type): all that do, and a few more.  Rows with a NULL key may go."""
    places = kept.where(F.col(f"`{key}`").isNotNull()).select(_place(key).alias("_at"))
    words = (places.select(F.bitmap_bucket_number("_at").alias("_word"), F.bitmap_bit_position("_at").alias("_bit"))
             .repartition("_word").groupBy("_word").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    at = rows.withColumn("_at", _place(key)).withColumns({"_word": F.bitmap_bucket_number("_at"),
                                                          "_bit": F.bitmap_bit_position("_at").cast("int")})
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, F.col("_bit") % 8) == 1
    return at.join(F.broadcast(words), "_word").where(is_set).select(*[f"`{c}`" for c in rows.columns])
