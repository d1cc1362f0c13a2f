"""Top-n lists, samples and splits.

``row_number() <= n`` and ``rank() <= n`` are cut to n rows per key on the map
side by Spark (window group limit), so hot keys do not reach one task whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.counting import topic_sizes
from threadloom.operators.numbering import running_start
from threadloom.session import cut_lineage

#: Length of the base word list that representation models get.
BASE_WORDS = 30
#: Filler of an empty slot in a word list.
PAD_WORD, PAD_SCORE = "", 0.00001


def top_words(scores: DataFrame, n: int = 10, key: str = "topic") -> DataFrame:
    """``(topic, rank, word, score)``: the n best words, ties alphabetical."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "word")
    return (
        scores.select(key, "word", "score")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
        .select(key, "rank", "word", "score")
    )


def word_lists(ranked: DataFrame, n: int | None = None, pad: bool = False, key: str = "topic") -> DataFrame:
    """Ranked words as one array per topic (bounded by the list length)."""
    rows = ranked if n is None else ranked.filter(F.col("rank") <= n)
    words = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "word", "score"))),
        lambda s: F.struct(s["word"].alias("word"), s["score"].alias("score")),
    )
    if pad:
        if n is None:
            raise ValueError("padding needs a list length")
        filler = F.struct(F.lit(PAD_WORD).alias("word"), F.lit(PAD_SCORE).alias("score"))
        words = F.concat(words, F.array_repeat(filler, F.lit(n) - F.size(words)))
    return rows.groupBy(key).agg(words.alias("words"))


def base_words(scores: DataFrame, top_n: int = 10) -> DataFrame:
    """The list handed to representation models: at least 30 words with a positive score."""
    return top_words(scores.filter(F.col("score") > 0), max(top_n, BASE_WORDS))


def top_n_ties(scores: DataFrame, n: int = 15, key: str = "topic", score: str = "score") -> DataFrame:
    """Rows whose score is among the n best of their key; equal scores are all kept."""
    w = Window.partitionBy(key).orderBy(F.desc(score))
    return scores.withColumn("rank", F.rank().over(w)).filter(F.col("rank") <= n)


def relabel_topics(docs: DataFrame, topic: str = "topic") -> tuple[DataFrame, DataFrame]:
    """Renumber topics by falling size; -1 stays.  Returns the documents and the mapping ``(old_topic, topic)``."""
    sizes = topic_sizes(docs, topic).filter(F.col("topic") >= 0)
    # one row per topic
    order = Window.orderBy(F.desc("count"), "topic")
    mapping = sizes.select(F.col("topic").alias("old_topic"), (F.row_number().over(order) - 1).alias("topic"))
    moved = (
        docs.withColumnRenamed(topic, "old_topic")
        .join(mapping, "old_topic", "left")
        .withColumn("topic", F.coalesce("topic", F.lit(-1)).cast("int"))
        .drop("old_topic")
    )
    return moved, mapping


def hash_order(seed: int, key: str) -> Column:
    """A random but repeatable order, independent of how the data is partitioned."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def sample_per_topic(docs: DataFrame, n: int = 500, seed: int = 42, topic: str = "topic", key: str = "doc_id") -> DataFrame:
    """At most n documents per topic."""
    w = Window.partitionBy(topic).orderBy(hash_order(seed, key), key)
    return docs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def sample_exact(df: DataFrame, n: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Exactly n rows (or all, if fewer)."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def split_corpus(df: DataFrame, train: int = 70, validation: int = 15, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Add ``split``: train, validation or test, from a hash of the key."""
    bucket = F.conv(F.substring(hash_order(seed, key), 1, 6), 16, 10).cast("bigint") % 100
    return df.withColumn(
        "split",
        F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test"),
    )


def term_rank(words: DataFrame) -> DataFrame:
    """Score against rank, also as a logarithm, for the ranked words of each topic."""
    return words.select("topic", "rank", "word", "score", F.log10("score").alias("log_score"))


def ordinal_by_count(counts: DataFrame, count: str = "n") -> DataFrame:
    """Place of each word when sorted by count: 1 is the rarest, ties alphabetical.

    A block is a count and the first two letters of the word: only the words
    of one block are sorted together.
    """
    block = F.struct(F.col(count), F.substring("word", 1, 2))
    return running_start(counts, F.lit(1), [count, "word"], block, name="_before").select(
        *counts.columns, (F.col("_before") + 1).alias("ordinal")
    )


def top_words_head(counts: DataFrame, n: int = 6) -> DataFrame:
    return counts.orderBy(F.desc("n"), "word").limit(n)


def dtm_corner(counts: DataFrame, dictionary: DataFrame, docs: int = 10, terms: int = 10) -> DataFrame:
    """Corner of the document-term matrix: the first documents and term ids."""
    corner = dictionary.filter(F.col("term_id") < terms)
    return counts.filter(F.col("doc_id") < docs).join(corner, "word").select("doc_id", "term_id", "word", "n")


def unique_words(words: DataFrame) -> DataFrame:
    """Words that are in the list of one topic only."""
    return unique_words_threshold(words, 0.0)


def unique_words_threshold(words: DataFrame, threshold: float) -> DataFrame:
    """Words that at most ``int(threshold * topics)`` other topics list too."""
    listed = words.select("topic", "word").distinct()
    spread = listed.groupBy("word").agg((F.count("*") - 1).alias("_others"))
    topics = words.agg(F.countDistinct("topic").alias("_topics"))
    # the small step undoes binary fractions such as 0.29 * 100
    kept = spread.filter(F.col("_others") <= F.floor(F.lit(threshold) * topics.scalar() + F.lit(1e-9)))
    return listed.join(kept.select("word"), "word", "left_semi").select("topic", "word")


def representative_docs(
    doc_counts: DataFrame,
    class_counts: DataFrame,
    scores: DataFrame,
    n: int = 3,
    reduce_frequent_words: bool = True,
) -> DataFrame:
    """``(topic, rank, doc_id, similarity)``: documents closest to their topic.

    Cosine between the document's and the topic's c-TF-IDF vectors.
    ``doc_counts`` is ``(topic, doc_id, word, n)`` (see ``candidate_counts``);
    ``scores`` is the topics' c-TF-IDF.
    """
    similarity = doc_topic_cosine(doc_counts, class_counts, scores, reduce_frequent_words)
    w = Window.partitionBy("topic").orderBy(F.desc("similarity"), "doc_id")
    return (
        similarity.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
        .select("topic", "rank", "doc_id", "similarity")
    )


def doc_topic_cosine(
    doc_counts: DataFrame, class_counts: DataFrame, scores: DataFrame, reduce_frequent_words: bool = True
) -> DataFrame:
    """``(topic, doc_id, similarity)`` of each candidate with its own topic, to 9 decimals so that ties are ties."""
    from threadloom.operators import weighting as wt

    # one join gives a word's rarity and its score in the topic
    n = F.col("n") if "n" in scores.columns else F.lit(0)
    pairs = cut_lineage(scores.select("topic", "word", "score", n.cast("bigint").alias("n_pair")).join(wt.word_rarity(class_counts), "word").drop("n_word"))
    weight = wt.document_share(reduce_frequent_words) * F.col("rarity")
    weights = wt.join_frequent(wt.with_sizes(doc_counts), pairs, ["topic", "word"], "n_pair").select("topic", "doc_id", "score", weight.alias("weight"))
    lengths = scores.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("_topic_length"))
    dots = weights.groupBy("topic", "doc_id").agg(
        F.sum(F.col("weight") * F.col("score")).alias("_dot"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_doc_length"),
    )
    return dots.join(lengths, "topic").select(
        "topic", "doc_id", F.round(F.col("_dot") / (F.col("_doc_length") * F.col("_topic_length")), 9).alias("similarity")
    )


def candidate_counts(docs: DataFrame, tokens_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(topic, doc_id, word, n, n_doc)`` of all documents; ``n_doc`` counts the words of a document.

    ``docs`` is ``(doc_id, topic, document)``; ``tokens_of`` returns
    ``(doc_id, topic, word)``.  Every document can stand for its topic: ranking
    them is a sum per document and a top-n list, both cut on the map side.
    """
    counts = tokens_of(docs).groupBy("topic", "doc_id", "word").agg(F.count("*").alias("n"))
    # looked up here, where the words of a document may still be together
    return counts.withColumn("n_doc", F.sum("n").over(Window.partitionBy("doc_id")))


def class_counts_of(doc_counts: DataFrame) -> DataFrame:
    """``(topic, word, n)`` from the counts per document, without a second look at the texts."""
    return doc_counts.groupBy("topic", "word").agg(F.sum("n").alias("n"))
