"""Time blocks: a busy key is split over many tasks, with the overlap each frame needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import bin_of


def with_time_blocks(df: DataFrame, at: Column, block_us: int,
                     before_us: int = 0, after_us: int = 0) -> DataFrame:
    """Copy each row to every block with frames that can see it.

    Frames reach `before_us` back and `after_us` ahead. `_home` is the row's own
    block; rows with `_block = _home` are the ones to keep after the frame.
    """
    first = bin_of(at - F.lit(after_us), block_us) if after_us else bin_of(at, block_us)
    last = bin_of(at + F.lit(before_us), block_us) if before_us else bin_of(at, block_us)
    return df.withColumns({"_home": bin_of(at, block_us),
                           "_block": F.explode(F.sequence(first, last))})


def home_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_block") == F.col("_home")).drop("_block", "_home")
