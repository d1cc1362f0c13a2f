"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.numbering import sorted_ids
from threadloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SIGNS = r"[#*$%&|<>!]"
#: Documents of a source for each bucket of an octave of keys; only the bucket at the budget is sorted.
BUCKET_DOCS = 4096


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: str) -> Column:
    """1 for plain text, less the more signs stand among the words; never 0."""
    signs = F.coalesce(F.regexp_count(text, F.lit(SIGNS)), F.lit(0))
    return 1.0 / (1.0 + 4.0 * signs / F.greatest(F.lit(1), n_words(text)))


def bucket_of(key: Column, buckets: Column) -> Column:
    """Even steps of log2(key), ``buckets`` to the octave.

    -log(u) / w puts at most ln(2) / e = 0.26 of the documents of any weight
    into an octave, on the scale of logarithms where a weight is only a shift.
    So a bucket gets 0.26 * ``BUCKET_DOCS`` documents of a source, whatever
    their weights are.
    """
    return F.floor(F.log2(F.greatest(key, F.lit(1e-300))) * buckets)


def targets(sources: DataFrame, weights: Sequence[float], most_epochs: float) -> DataFrame:
    """``sources`` (``source, source_size``) with ``target``: shares of all sizes by weight, at most ``most_epochs`` times the size.

    Sources in the order of their code points, null last, take the weights in
    turn.  What capped sources leave is shared among the others by weight
    until a round caps no further source; each round is one sum over the sources, and
    only the sums reach the driver.
    """
    placed = sorted_ids(sources, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_place") % len(weights) + 1).cast("int"))
    rows = cut_lineage(placed.select("source", "source_size", weight.alias("_weight"), (most_epochs * F.col("source_size")).alias("_cap")))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, n_capped = 0.0, -1
    while True:
        capped = F.col("_cap") <= F.col("_weight") * level
        left = rows.agg(
            F.sum(F.when(capped, F.col("_cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(~capped, F.col("_weight"))).alias("weights"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        # the level rises and caps more sources each round, or none
        if not left["weights"] or left["n"] <= n_capped:
            break
        n_capped, level = left["n"], max(level, (total - left["caps"]) / left["weights"])
    return rows.select("source", "source_size", F.least("_cap", F.col("_weight") * level).alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    most_epochs: int = 3,
    seed: int = 0,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """``(key, size, source_size, target, copies, taken)`` of every row.

    ``size`` is the number of words.  A source takes every document as often
    as its target holds its whole size (complete epochs).  For the rest each
    document draws the key -log(u) / w, with u from a hash of its key and text
    and w its quality weight; in the order of keys, documents are taken until
    their sizes reach the rest.  The document at that border is taken if the
    sum is nearer to the rest with it than without, so a source misses its
    target by half a document at most.

    Keys are cut into buckets of a source; only sums of buckets are ordered,
    and only the bucket at the border is sorted, so no task gets a whole
    source.  The same rows give the same mix, however they are dealt.

    Null and empty texts have size 0 and take 0 words; a null source is a
    source of its own, the last.  Equal rows draw equal keys and stand next to
    each other; they are taken in turn.  Null keys are allowed; other columns
    are not returned.  An empty table gives an empty mix.
    """
    drawn = F.xxhash64(docs[key], docs[text], F.lit(seed))
    # 53 bits, never 0
    unit = (F.shiftrightunsigned(drawn, 11) + 0.5) / float(1 << 53)
    rows = cut_lineage(
        docs.select(
            docs[key].alias("_id"), docs[source].alias("source"), n_words(docs[text]).alias("size"),
            (-F.log(unit) / quality_weight(docs[text])).alias("_key"), drawn.alias("_draw"),
        )
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    goal = targets(sources.select("source", "source_size"), weights, most_epochs)
    counts = sources.select("source", F.greatest(F.lit(1), F.ceil(F.col("_docs") / BUCKET_DOCS)).alias("_buckets"))
    goal = goal.join(counts, goal["source"].eqNullSafe(counts["source"])).drop(counts["source"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = cut_lineage(
        goal.withColumn("_epochs", F.least(epochs, F.lit(most_epochs)).cast("bigint"))
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
        .withColumnRenamed("source", "_source")
    )
    bucket = bucket_of(F.col("_key"), F.col("_buckets"))
    placed = rows.join(goal, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_bucket", bucket)
    sums = placed.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"), F.first("_rest").alias("_rest"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_sum").over(before), F.lit(0))
    marks = sums.withColumn("_base", base).filter((F.col("_base") <= F.col("_rest")) & (F.col("_base") + F.col("_sum") > F.col("_rest")))
    marks = cut_lineage(marks.select(F.col("_source").alias("_mark"), F.col("_bucket").alias("_border"), "_base"))
    # a source whose rest is its whole size or 0 has no border, or a first one
    seen = placed.join(marks, F.col("_source").eqNullSafe(F.col("_mark")), "left")
    apart = F.col("_border").isNull() | (F.col("_bucket") != F.col("_border"))
    clear = seen.filter(apart).withColumn("_more", (F.col("_border").isNull() & (F.col("_rest") > 0)) | (F.col("_bucket") < F.col("_border")))
    order = Window.partitionBy("_source").orderBy("_key", "_draw", "_id", "size")
    upto = F.col("_base") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    edge = seen.filter(~apart).withColumn("_upto", upto)
    # taken if its middle is not beyond the rest
    edge = edge.withColumn("_more", F.col("_upto") - F.col("size") / 2.0 <= F.col("_rest"))
    copies = F.col("_epochs") + F.coalesce(F.col("_more"), F.lit(False)).cast("bigint")

    def shown(part: DataFrame) -> DataFrame:
        capped = F.least(copies, F.lit(most_epochs))
        return part.select(
            F.col("_id").alias(key), "size", "source_size", "target", capped.alias("copies"), (capped * F.col("size")).alias("taken")
        )

    return shown(clear).unionByName(shown(edge))
