"""Joining the texts of many rows into one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.numbering import running_start

#: A merged text longer than this is stored as several numbered parts.
PART_CHARS = 64 * 1024 * 1024


def merge_text(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    column: str = "post_message",
    sep: str = "",
    part_chars: int = PART_CHARS,
    on_null: str = "skip",
) -> DataFrame:
    """Join the texts of equal keys in ``order``; returns the keys, ``part`` and the text.

    Null keys are dropped, null texts are skipped (``on_null="error"`` stops
    instead).  Nothing is cut away: a key whose text passes ``part_chars`` comes
    out as parts 0, 1, 2, ..., split between input rows, so that even a key
    that owns a third of all rows never meets in one task.  Each part holds at
    most ``part_chars`` plus one row.
    """
    if on_null not in ("skip", "error"):
        raise ValueError("on_null must be 'skip' or 'error'")
    keys, order = list(keys), list(order)
    rows = df
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    text = F.col(column)
    if on_null == "error":
        text = F.when(text.isNull(), F.raise_error(F.lit("null text in a merged group"))).otherwise(text)
    placed_at = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    rows = rows.select(*keys, *placed_at, block.alias("_given"), text.alias("_text"))
    names = [f"_o{i}" for i in range(len(order))]
    # one extra unit per row, so that endless empty fragments are split up too
    length = F.coalesce(F.char_length("_text"), F.lit(0)) + F.lit(len(sep) + 1)
    placed = running_start(rows, length, names, F.col("_given"), keys, "_first")
    parted = placed.withColumn("part", F.floor(F.col("_first") / F.lit(part_chars)))
    inside = F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("_first", *names, "_text"))))
    merged = F.array_join(F.transform(inside, lambda s: s["_text"]), sep)
    return parted.groupBy(*keys, "part").agg(merged.alias(column))


def merge_posts(
    posts: DataFrame,
    order: Sequence[str] = ("_file", "_split", "_row"),
    block: Column | None = None,
    keys: Sequence[str] = ("forum", "thread_title", "message_nr"),
    **options,
) -> DataFrame:
    """One document per message: its fragments joined in input order, without a separator."""
    from threadloom.operators.numbering import file_block

    return merge_text(posts, keys, order, block if block is not None else file_block(), **options)


def merge_threads(posts: DataFrame, keys: Sequence[str] = ("forum", "thread_title"), **options) -> DataFrame:
    """One document per thread."""
    return merge_posts(posts, keys=keys, **options)


def concat_corpus(
    df: DataFrame,
    order: Sequence[str],
    block: Column,
    column: str = "post_message",
    sep: str = " ",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """All texts joined by ``sep`` as rows ``(part, text)`` of exactly ``part_chars`` characters (the last may be shorter).

    Reading the parts in order gives the one long string; no task holds more
    than a part.
    """
    base = df.filter(F.col(column).isNotNull()).select(*order, block.alias("_given"), F.col(column).alias("_text"))
    placed = running_start(base, F.char_length("_text") + F.lit(len(sep)), order, F.col("_given"), name="_first")
    # every text carries the separator in front of it, except the first one
    placed = placed.select(
        F.when(F.col("_first") == 0, F.lit(0)).otherwise(F.col("_first") - len(sep)).alias("_first"),
        F.when(F.col("_first") == 0, F.col("_text")).otherwise(F.concat(F.lit(sep), F.col("_text"))).alias("_text"),
    ).filter(F.char_length("_text") > 0)
    low = F.floor(F.col("_first") / F.lit(part_chars))
    high = F.floor((F.col("_first") + F.char_length("_text") - 1) / F.lit(part_chars))
    pieces = placed.select("_first", "_text", F.explode(F.sequence(low, high)).alias("part"))
    begin = F.greatest(F.col("part") * part_chars - F.col("_first"), F.lit(0)).cast("int")
    end = F.least((F.col("part") + 1) * part_chars - F.col("_first"), F.char_length("_text")).cast("int")
    pieces = pieces.select("part", "_first", F.substring(F.col("_text"), begin + 1, end - begin).alias("_piece"))
    ordered = F.array_sort(F.collect_list(F.struct("_first", "_piece")))
    return pieces.groupBy("part").agg(F.array_join(F.transform(ordered, lambda s: s["_piece"]), "").alias("text"))
