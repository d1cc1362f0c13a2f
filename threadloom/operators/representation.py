"""Topic tables: names, keywords, documents, chains of representation steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import vectors as vx
from threadloom.operators.joins import join_frequent
from threadloom.operators.ranking import word_lists
from threadloom.session import cut_lineage

#: A representation step turns a table ``(topic, rank, word, score)`` into another one.
Step = Callable[[DataFrame], DataFrame]


def document_lists(rep_docs: DataFrame) -> DataFrame:
    """``(topic, docs)``: the representative documents of a topic as an array in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "document")))
    return rep_docs.groupBy("topic").agg(F.transform(ordered, lambda s: s["document"]).alias("docs"))


def topic_names(words: DataFrame, parts: int = 4) -> DataFrame:
    """``(topic, name)``: the topic number and its best words joined by an underscore."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "word")))
    first = F.transform(ordered, lambda s: s["word"])
    return (
        words.filter(F.col("rank") <= parts)
        .groupBy("topic")
        .agg(first.alias("_w"))
        .select("topic", F.concat_ws("_", F.col("topic").cast("string"), F.array_join("_w", "_")).alias("name"))
    )


def topic_info(sizes: DataFrame, words: DataFrame, rep_docs: DataFrame, n_words: int = 10, n_docs: int = 3) -> DataFrame:
    """One row per topic: size, name, keywords, and the documents spread over ``doc_0 .. doc_{n-1}``."""
    lists = word_lists(words, n_words).select("topic", F.transform("words", lambda s: s["word"]).alias("words"))
    docs = document_lists(rep_docs.filter(F.col("rank") <= n_docs))
    return (
        sizes.select("topic", "count")
        .join(topic_names(words), "topic", "left")
        .join(lists, "topic", "left")
        .join(docs, "topic", "left")
        .select("topic", "count", "name", "words", *[F.get("docs", F.lit(i)).alias(f"doc_{i}") for i in range(n_docs)])
    )


def intermediate_results(
    sizes: DataFrame, ctfidf_words: DataFrame, rep_docs: DataFrame, n_words: int = 10, n_docs: int = 3
) -> DataFrame:
    """Topic table before any model has relabelled it: size, keyword list as text, documents."""
    lists = word_lists(ctfidf_words, n_words).select(
        "topic", F.to_json(F.transform("words", lambda s: s["word"])).alias("ctfidf_words")
    )
    docs = document_lists(rep_docs.filter(F.col("rank") <= n_docs))
    return (
        sizes.select("topic", "count")
        .join(lists, "topic", "left")
        .join(docs, "topic", "left")
        .select("topic", "count", "ctfidf_words", *[F.get("docs", F.lit(i)).alias(f"doc_{i}") for i in range(n_docs)])
    )


def topic_markdown(info: DataFrame) -> DataFrame:
    """A Markdown section per topic, ``(topic, markdown)``; the report is these rows in topic order."""
    return info.select("topic", F.format_string("## Topic %s\n\n%s\n\n", F.col("topic").cast("string"), "name").alias("markdown"))


def _apply(steps: object, words: DataFrame, top_n: int, where: str) -> DataFrame:
    if not steps:
        return words.filter(F.col("rank") <= top_n)
    if callable(steps):
        return words.transform(steps)
    if isinstance(steps, (list, tuple)):
        for step in steps:
            words = words.transform(step)
        return words
    raise TypeError(f"unsupported type {type(steps).__name__} for {where}")


def representation_chain(
    base: DataFrame, representation: Step | Sequence[Step] | Mapping[str, object] | None = None, top_n: int = 10
) -> DataFrame:
    """Run representation steps over the base word list; returns ``(aspect, topic, rank, word, score)``.

    None keeps the ``top_n`` best words.  One step or a list is applied in
    order.  A mapping holds the steps of ``Main`` and of further named aspects,
    each starting from the base list.
    """
    if isinstance(representation, Mapping):
        parts = {"Main": representation.get("Main")}
        parts.update({k: v for k, v in representation.items() if k != "Main"})
    else:
        parts = {"Main": representation}
    out = None
    for aspect, steps in parts.items():
        where = f"representation[{aspect!r}]" if isinstance(representation, Mapping) else "representation"
        rows = _apply(steps, base, top_n, where).select(F.lit(aspect).alias("aspect"), "topic", "rank", "word", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def keyword_rerank(candidates: DataFrame, word_vectors: DataFrame, topic_vectors: DataFrame, n: int = 10) -> DataFrame:
    """Order the candidate words of each topic by cosine of word and topic vector."""
    scored = (
        candidates.select("topic", "word")
        .join(word_vectors.select("word", F.col("vector").alias("_wv")), "word")
        .join(topic_vectors.select("topic", F.col("vector").alias("_tv")), "topic")
        .select("topic", "word", F.round(vx.cosine(F.col("_wv"), F.col("_tv")), 9).alias("score"))
    )
    w = Window.partitionBy("topic").orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("topic", "rank", "word", "score")


def word_mean_vectors(candidates: DataFrame, tokens: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``(word, vector)``: mean embedding of the documents that hold each candidate word.

    Stands in for an encoder that embeds single words.
    """
    from threadloom.operators.counting import mean_vectors

    holders = tokens.join(candidates.select("word").distinct(), "word", "left_semi").select("doc_id", "word").distinct()
    return mean_vectors(holders.join(embeddings.select("doc_id", "embedding"), "doc_id"), "word")


def mmr_docs(weights: DataFrame, similarity: DataFrame, n: int = 10, diversity: float | None = 0.1) -> DataFrame:
    """``(topic, rank, doc_id, similarity)``: near to the topic, far from each other.

    ``weights`` is ``(topic, doc_id, word, weight)`` of all documents.  Each of
    the ``n`` rounds picks one document per topic and compares all others with
    it: a join with the few words of the picks and a sum per document, so no
    topic meets in one task.  Ties go to the smaller id.  ``diversity`` is
    clipped to [0, 1]; 0 or None gives the plain similarity order.
    """
    w = Window.partitionBy("topic").orderBy(F.desc("similarity"), "doc_id")
    if not diversity or diversity <= 0:
        return (
            similarity.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n)
            .select("topic", "rank", "doc_id", "similarity")
        )
    share = min(float(diversity), 1.0)
    doc = ["topic", "doc_id"]
    weights = cut_lineage(weights.select(*doc, "word", "weight"))
    # lengths belong to documents, so the words need not be gathered by document
    lengths = weights.groupBy(*doc).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    unit = lambda value: F.when(F.col("length") > 0, F.col(value) / F.col("length")).otherwise(F.lit(0.0))
    rest = cut_lineage(similarity.join(lengths, doc, "left").select(*doc, "similarity", "length", F.lit(None).cast("double").alias("worst")))
    chosen: DataFrame | None = None
    for rank in range(1, n + 1):
        value = F.when(F.col("worst").isNull(), F.col("similarity")).otherwise(
            (1 - share) * F.col("similarity") - share * F.col("worst")
        )
        best = F.min(F.struct((-F.round(value, 9)).alias("v"), "doc_id", "similarity", "length")).alias("_b")
        pick = cut_lineage(
            rest.groupBy("topic").agg(best).select("topic", F.lit(rank).alias("rank"), "_b.doc_id", "_b.similarity", "_b.length")
        )
        some = pick.drop("length")
        chosen = some if chosen is None else chosen.unionByName(some)
        if rank == n:
            break
        # the few words of the picks go to all words, not the other way round
        bag = cut_lineage(weights.join(pick.select(*doc, "length"), doc).select("topic", "word", unit("weight").alias("_w"), F.lit(1).alias("_uses")))
        near = join_frequent(weights, bag, ["topic", "word"], "_uses").groupBy(*doc).agg(F.sum(F.col("weight") * F.col("_w")).alias("_near"))
        rest = cut_lineage(
            rest.join(pick.select(*doc), doc, "left_anti")
            .join(near, doc, "left")
            .select(*doc, "similarity", "length", F.greatest("worst", F.coalesce(unit("_near"), F.lit(0.0))).alias("worst"))
        )
    return chosen
