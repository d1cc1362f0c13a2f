"""Clustering of document vectors.  Every clusterer returns ``(doc_id, topic)`` (and a strength where it has one)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import vectors as vx
from threadloom.operators import ward
from threadloom.operators.components import connected_components
from threadloom.operators.counting import mean_vectors
from threadloom.operators.joins import vector_similarity
from threadloom.operators.neighbors import knn_join
from threadloom.operators.spanning import BLOCK, spanning_tree
from threadloom.session import cut_lineage

#: Takes ``(doc_id, embedding)`` and returns ``(doc_id, topic)``; -1 means no topic.
Clusterer = Callable[[DataFrame], DataFrame]


def _ml(vectors: DataFrame) -> DataFrame:
    return vectors.select("doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def kmeans(vectors: DataFrame, k: int = 50, seed: int = 42, max_iter: int = 20) -> DataFrame:
    # a fixed row order makes the start centres, and so the result, repeatable
    rows = cut_lineage(_ml(vectors).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="topic").fit(rows)
    return model.transform(rows).select("doc_id", F.col("topic").cast("int").alias("topic"))


def agglomerative(vectors: DataFrame, k: int = 50, block: int = ward.BLOCK) -> DataFrame:
    """Ward clustering into ``k`` topics, numbered by their smallest document.

    Equal vectors are one weighted point.  Exact at every size; ``block``
    (clusters compared in one task) changes no result.
    """
    rows = cut_lineage(vectors.select("doc_id", vx.as_doubles(F.col("embedding")).alias("v")))
    points = cut_lineage(rows.groupBy("v").agg(F.min("doc_id").alias("node"), F.count("*").alias("w")))
    placed = ward.cut_merges(points, ward.ward_merges(points, block), k)
    return rows.join(points.join(placed, "node").select("v", "topic"), "v").select("doc_id", "topic")


def mutual_reachability(knn: DataFrame, min_samples: int, id_col: str = "doc_id") -> DataFrame:
    """Edges ``(src, dst, weight)``, ``src < dst``: the larger of the two core distances and the distance.

    The core distance is the distance to the ``min_samples``-th neighbour.
    """
    core = knn.filter(F.col("rank") == min_samples).select(F.col(id_col).alias("id"), F.col("distance").alias("core"))
    pairs = knn.groupBy(F.least(id_col, "neighbor").alias("src"), F.greatest(id_col, "neighbor").alias("dst")).agg(
        F.min("distance").alias("distance")
    )
    return (
        pairs.join(core.select(F.col("id").alias("src"), F.col("core").alias("_a")), "src")
        .join(core.select(F.col("id").alias("dst"), F.col("core").alias("_b")), "dst")
        .select("src", "dst", F.greatest("_a", "_b", "distance").alias("weight"))
    )


def dbscan_level(edges: DataFrame, nodes: DataFrame, level: float, min_size: int = 1) -> DataFrame:
    """``(doc_id, component)`` at one distance level; components below ``min_size`` become -1."""
    found = connected_components(edges.filter(F.col("weight") <= level), nodes.select(F.col("doc_id").alias("id")))
    sizes = found.groupBy("label").agg(F.count("*").alias("_n"))
    return found.join(sizes, "label").select(
        F.col("id").alias("doc_id"), F.when(F.col("_n") >= min_size, F.col("label")).otherwise(F.lit(-1)).alias("component")
    )


def level_grid(edges: DataFrame, levels: int, bins: int = 4_096) -> list[float]:
    """At most ``levels`` distances, evenly spread over the edges, from the smallest to the largest weight.

    Read off a histogram on a log scale, which unlike a quantile sketch does
    not depend on the order of the rows.
    """
    low, high = edges.filter("weight > 0").agg(F.min("weight"), F.max("weight")).first()
    if low is None:
        return []
    if high <= low:
        return [high]
    width = math.log(high / low) / bins
    place = F.least(F.floor(F.log(F.col("weight") / F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    counts = edges.filter("weight > 0").groupBy(place.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()
    total, seen, share, grid = sum(r["n"] for r in counts), 0, 1, [low]
    for r in counts:
        seen += r["n"]
        # a bin that completes one or more shares of the edges ends a level
        if seen * (levels - 1) >= share * total:
            grid.append(high if r["b"] == bins - 1 else low * math.exp(width * (r["b"] + 1)))
            share = seen * (levels - 1) // total + 1
    return sorted({*grid, high})


def density_clusters(
    vectors: DataFrame,
    min_topic_size: int = 100,
    min_samples: int = 15,
    levels: int = 24,
    allow_single: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, topic, strength)``: density clustering over a grid of distance levels, noise is -1.

    The components of the minimum spanning tree of mutual reachability, which
    are those of the graph of all pairs, are found at all levels at once.  A component of at least ``min_topic_size`` documents that
    splits into two or more of that size ends there; the most stable
    non-overlapping ones are the topics (stability = documents times the range
    of 1/distance over which they hold together).

    Equal vectors are one weighted point.  Against the exact hierarchy, levels
    are discrete.
    """
    if min_topic_size < 2:
        raise ValueError("min_topic_size must be at least 2")
    if min_samples < 1:
        raise ValueError("min_samples must be at least 1")
    k = min_samples
    rows = cut_lineage(vectors.select("doc_id", vx.as_doubles(F.col("embedding")).alias("v")))
    points = cut_lineage(rows.groupBy("v").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
    knn = cut_lineage(knn_join(points, k, "id", "v"))

    # a point with copies reaches its k-th neighbour sooner: its copies are at distance 0
    near = knn.join(points.select(F.col("id").alias("neighbor"), F.col("copies").alias("_c")), "neighbor").join(
        points.select("id", F.col("copies").alias("_own")), "id"
    )
    upto = Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    core = (
        near.withColumn("_seen", F.sum("_c").over(upto) + F.col("_own") - 1)
        .groupBy("id")
        .agg(
            F.first("_own").alias("copies"),
            F.min(F.when(F.col("_seen") >= k, F.col("distance"))).alias("_k"),
            F.max("distance").alias("_far"),
        )
        .select("id", "copies", F.when(F.col("copies") > k, 0.0).otherwise(F.coalesce("_k", "_far")).alias("core"))
    )
    core = cut_lineage(core)
    # components at any level are those of the tree's edges up to it, so no edge is missed
    edges = cut_lineage(spanning_tree(points.select("id", "v").join(core.select("id", "core"), "id"), block))
    grid = level_grid(edges, levels)
    if not grid:
        return rows.select("doc_id", F.lit(-1).alias("topic"), F.lit(0.0).alias("strength"))
    # a level below all edges: there only a pile of copies can be a component
    grid = [grid[0] / 2] + grid
    floor = max(grid[-1] * 1e-3, 1e-12)
    lam = [1.0 / max(g, floor) for g in grid]
    top = len(grid) - 1
    steps = F.array(*[F.lit(float(g)) for g in grid])
    # the first level at which an edge or a point exists, and all coarser ones
    first = lambda c: F.size(F.filter(steps, lambda g: g < c))

    def at_levels(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
        start = first(F.col(column))
        return df.filter(start <= top).select(F.explode(F.sequence(start, F.lit(top))).alias("level"), *keep)

    labels = cut_lineage(
        connected_components(
            at_levels(edges, "weight", ["src", "dst"]), at_levels(core, "core", ["id"]), graph=["level"]
        )
    )
    weighted = labels.join(core.select("id", "copies"), "id")
    big = cut_lineage(
        weighted.groupBy("level", "label").agg(F.sum("copies").alias("size")).filter(F.col("size") >= min_topic_size)
    )
    # the parent of a component is the one its smallest id has one level up
    up = labels.select((F.col("level") - 1).alias("level"), F.col("id").alias("label"), F.col("label").alias("parent"))
    tree = cut_lineage(big.join(up, ["level", "label"], "left"))
    kids = tree.filter("parent is not null").groupBy((F.col("level") + 1).alias("level"), F.col("parent").alias("label")).agg(
        F.count("*").alias("kids")
    )
    split = kids.select((F.col("level") - 1).alias("level"), F.col("label").alias("parent"), "kids")
    tree = tree.join(split, ["level", "parent"], "left").withColumn(
        "starts", F.col("parent").isNull() | (F.col("kids") >= 2)
    )
    tree = cut_lineage(tree.select("level", "label", "size", "starts"))
    # every component with all components above it: at most one per level
    above = (
        tree.select("level", "label")
        .join(labels.select(F.col("level").alias("a_level"), F.col("id").alias("label"), F.col("label").alias("a_label")), "label")
        .filter(F.col("a_level") >= F.col("level"))
        .join(tree.select(F.col("level").alias("a_level"), F.col("label").alias("a_label"), F.col("starts").alias("a_starts")), ["a_level", "a_label"])
        .filter("a_starts")
    )
    chains = above.groupBy("level", "label").agg(
        F.min(F.struct("a_level", "a_label")).alias("chain"),
        F.array_sort(F.collect_list(F.struct("a_level", "a_label"))).alias("path"),
    )
    # one row per level
    steps_table = F.broadcast(
        vectors.sparkSession.createDataFrame(
            [(i, x, x - lam[i + 1] if i < top else 0.0) for i, x in enumerate(lam)], "level int, lam double, step double"
        )
    )
    members = cut_lineage(
        chains.join(tree.select("level", "label", "size"), ["level", "label"])
        .join(steps_table.select("level", "step"), "level")
        .select("level", "label", "chain", "path", (F.col("size") * F.col("step")).alias("gain"))
    )
    nodes = members.groupBy("chain").agg(
        F.sum("gain").alias("stability"), F.first("path").alias("path")
    ).withColumn("depth", F.size("path")).withColumn("parent", F.get("path", F.lit(1)))
    n_roots = tree.filter(F.col("level") == top).count()
    if not allow_single and n_roots == 1:
        nodes = nodes.withColumn("stability", F.when(F.col("depth") == 1, F.lit(-1.0)).otherwise(F.col("stability")))
    nodes = cut_lineage(nodes)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    # bottom-up choice, one small join per depth of the tree of splits
    best = None
    chosen = None
    for depth in range(deepest, 0, -1):
        layer = nodes.filter(F.col("depth") == depth)
        if best is not None:
            below = best.groupBy(F.col("parent").alias("chain")).agg(F.sum("best").alias("_below"))
            layer = layer.join(below, "chain", "left")
        else:
            layer = layer.withColumn("_below", F.lit(None).cast("double"))
        keeps = F.col("_below").isNull() | (F.col("stability") >= F.col("_below"))
        layer = cut_lineage(
            layer.withColumn("picked", keeps & (F.col("stability") >= 0))
            .withColumn("best", F.greatest(F.coalesce("_below", F.lit(0.0)), F.greatest("stability", F.lit(0.0))))
            .select("chain", "parent", "best", "picked")
        )
        best = layer
        picks = layer.filter("picked").select("chain")
        chosen = picks if chosen is None else chosen.unionByName(picks)
    if chosen is None:
        return rows.select("doc_id", F.lit(-1).alias("topic"), F.lit(0.0).alias("strength"))
    # per point: its components with their chains; the topmost picked chain wins
    placed = labels.join(members.select("level", "label", "path"), ["level", "label"]).select(
        "id", "level", F.explode("path").alias("chain")
    )
    placed = placed.join(chosen, "chain")
    of_point = placed.groupBy("id").agg(F.max(F.struct("chain", (-F.col("level")).alias("fine"))).alias("_b"))
    of_point = cut_lineage(
        of_point.select("id", F.col("_b.chain").alias("chain"), (-F.col("_b.fine")).alias("level"))
        .join(steps_table.select("level", "lam"), "level")
        .select("id", "chain", "lam")
    )
    sizes = of_point.join(core.select("id", "copies"), "id").groupBy("chain").agg(
        F.sum("copies").alias("n"), F.max("lam").alias("_top")
    )
    # one row per topic
    numbered = sizes.withColumn("topic", (F.row_number().over(Window.orderBy(F.desc("n"), "chain")) - 1).cast("int"))
    topics = of_point.join(numbered, "chain").select("id", "topic", (F.col("lam") / F.col("_top")).alias("strength"))
    per_vector = points.join(topics, "id", "left").select(
        "v", F.coalesce("topic", F.lit(-1)).alias("topic"), F.coalesce("strength", F.lit(0.0)).alias("strength")
    )
    return rows.join(per_vector, "v").select("doc_id", "topic", "strength")


def topic_centroids(docs: DataFrame) -> DataFrame:
    """``(topic, vector)``: mean embedding of the members."""
    return mean_vectors(docs, "topic", "embedding", "vector")


def guided_blend(docs: DataFrame, seeds: DataFrame, share: float = 0.75) -> DataFrame:
    """Pull each vector towards its nearest seed topic.

    ``seeds`` is ``(seed, vector)``.  The corpus mean stands for "no seed": a
    document nearest to it stays as it is and gets ``seed = -1``.
    """
    mean = docs.select(F.lit(-1).alias("seed"), "embedding")
    centre = mean_vectors(mean, "seed", "embedding", "vector")
    targets = cut_lineage(seeds.select(F.col("seed").cast("int").alias("seed"), "vector").unionByName(centre))
    # seed lists are written by hand: far below the matrix limit, joined by key
    placed = vector_similarity(docs, targets, key="seed").drop("similarity")
    joined = placed.join(F.broadcast(targets.filter("seed >= 0")) if targets.count() < 10_000 else targets.filter("seed >= 0"), "seed", "left")
    return joined.withColumn(
        "embedding",
        F.when(F.col("vector").isNull(), vx.as_doubles(F.col("embedding"))).otherwise(
            vx.blend(F.col("embedding"), F.col("vector"), share)
        ),
    ).drop("vector")


def zeroshot_assign(docs: DataFrame, labels: DataFrame, min_similarity: float = 0.7) -> DataFrame:
    """Nearest label of each document, or null below ``min_similarity``; ``labels`` is ``(label, vector)``."""
    placed = vector_similarity(docs, labels, key="label")
    return placed.withColumn("label", F.when(F.round("similarity", 12) >= min_similarity, F.col("label")))


def combine_zeroshot(assigned: DataFrame, clustered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics of zero-shot and clustered documents in one numbering.

    Labels in use get 0..m-1 in label order, clusters follow; -1 stays.
    Returns ``(doc_id, topic)`` and ``(topic, label)``.
    """
    used = assigned.select("label").distinct()
    # one row per label in use
    names = used.withColumn("topic", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))
    shift = names.agg(F.count("*").cast("int").alias("m"))
    first = assigned.join(names, "label").select("doc_id", "topic")
    rest = clustered.select(
        "doc_id", F.when(F.col("topic") >= 0, F.col("topic") + shift.scalar()).otherwise(F.lit(-1)).cast("int").alias("topic")
    )
    return first.unionByName(rest), names.select("topic", "label")


def topic_probability(docs: DataFrame, topic_vectors: DataFrame, full: bool = False) -> DataFrame:
    """Cosine with every topic (``full``) or with the nearest one."""
    return vector_similarity(docs, topic_vectors, mode="all" if full else "best")


def predict_topics(docs: DataFrame, topic_vectors: DataFrame, doc_column: str = "embedding") -> DataFrame:
    """Nearest topic of new documents; topic -1 is no target.  Works on a streaming DataFrame too."""
    return vector_similarity(docs, topic_vectors.filter(F.col("topic") >= 0), doc_column=doc_column)

