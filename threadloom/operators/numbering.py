"""Positions, running totals and dense ids without a one-task window over the data.

A window over a whole table (or over one hot key) puts all its rows in one
task.  Here the rows are cut into *blocks* that follow the order, a window
runs inside each block, and only the per-block totals (one row per block) are
summed up in order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut_lineage

BLOCK_ROWS = 65_536
#: Borders of blocks that are looked up for every row.
MOST_BORDERS = 10_000


def file_order(df: DataFrame) -> DataFrame:
    """Add ``_file``, ``_split`` and ``_row``: the place of a row in the files it was read from.

    Must be applied to a scan, before any shuffle.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
    )


def file_block(rows: int = 16) -> Column:
    """Block of a row that carries the ``file_order`` columns (2**rows rows each)."""
    return F.struct(F.col("_file"), F.col("_split"), F.shiftright(F.col("_row"), rows))


def number_block(order: str, rows: int = BLOCK_ROWS) -> Column:
    """Block of a row whose order column counts up without large gaps."""
    return F.floor(F.col(order) / F.lit(rows))


def even_blocks(df: DataFrame, order: str, rows: int = BLOCK_ROWS, name: str = "_even") -> DataFrame:
    """Add the block of a row by a number column whose values may be spread in any way, such as hashed ids.

    Block borders are quantiles of the column, so a block has about ``rows``
    rows (more beyond ``MOST_BORDERS`` blocks) unless more rows share a value.
    Null comes first.  Borders change no result of ``running_start``, only how
    the work is shared out.
    """
    n = df.count()
    blocks = min(-(-n // rows), MOST_BORDERS)
    borders = df.approxQuantile(order, [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)) if blocks > 1 else []
    if not borders:
        return df.withColumn(name, F.lit(0))
    splits = [-math.inf, *sorted(set(borders)), math.inf]
    at = f"{name}_at"
    placed = df.withColumn(at, F.coalesce(F.col(order).cast("double"), F.lit(-math.inf)))
    return Bucketizer(splits=splits, inputCol=at, outputCol=name).transform(placed).drop(at)


def running_start(
    df: DataFrame,
    value: Column,
    order: Sequence[str],
    block: Column,
    keys: Sequence[str] = (),
    name: str = "start",
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the same keys.

    ``block`` must never decrease along ``order``.
    """
    keys = list(keys)
    rows = df.withColumn("_block", block).withColumn("_value", value.cast("bigint"))
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return (
        rows.join(starts, [*keys, "_block"])
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_block", "_value", "_total", "_base", "_inside")
    )


def block_ids(df: DataFrame, order: Sequence[str], block: Column, name: str = "doc_id") -> DataFrame:
    """Dense ids 0, 1, 2, ... along ``order``, cut into blocks that follow it."""
    return running_start(df, F.lit(1), order, block, name=name)


def hashed_ids(df: DataFrame, key: str, name: str = "term_id") -> DataFrame:
    """Dense ids over distinct string keys, in the order of (md5 prefix, key).

    The 65,536 md5 prefixes are even blocks whatever the keys look like, so
    neither a total sort nor a one-task window is needed.
    """
    prefix = F.substring(F.md5(F.col(key)), 1, 4)
    return block_ids(df, [key], prefix, name)


def sorted_ids(df: DataFrame, order: Sequence[str | Column], name: str = "doc_id") -> DataFrame:
    """Dense ids 0, 1, 2, ... in the order of arbitrary sort keys (which must be unique).

    One range shuffle.  The sorted rows are checkpointed so that the count per
    partition and the rows themselves come from the same sort; only one row per
    partition is summed up and broadcast.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mono"), 33)
    inside = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # one row per partition of the sort: bounded by spark.sql.shuffle.partitions
    return (
        placed.withColumn("_part", part)
        .withColumn("_inside", inside)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_mono", "_part", "_inside", "_base")
    )
