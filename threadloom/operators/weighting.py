"""Word weights: c-TF-IDF per topic and TF-IDF per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.counting import document_count, document_frequency
from threadloom.operators.joins import join_frequent
from threadloom.session import cut_lineage


def class_statistics(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words per topic ``(topic, n_topic)`` and the one-row mean ``(mean_words)`` rounded down."""
    sizes = counts.groupBy("topic").agg(F.sum("n").alias("n_topic"))
    return sizes, sizes.agg(F.floor(F.avg("n_topic")).alias("mean_words"))


def ctfidf(counts: DataFrame, reduce_frequent_words: bool = True) -> DataFrame:
    """Class-based TF-IDF ``(topic, word, score)`` from class term counts.

    ``tf / words of the topic * ln(1 + mean words per topic / corpus count)``,
    with a square root on the first factor when frequent words are damped.
    The corpus count of a word comes from a window over the already reduced
    table, whose groups hold at most one row per topic.
    """
    sizes, mean = class_statistics(counts)
    share = F.col("n") / F.col("n_topic")
    if reduce_frequent_words:
        share = F.sqrt(share)
    return (
        counts.withColumn("n_word", F.sum("n").over(Window.partitionBy("word")))
        .join(F.broadcast(sizes), "topic")  # one row a topic
        .select("topic", "word", "n", (share * F.log(1 + mean.scalar() / F.col("n_word"))).alias("score"))
    )


def ctfidf_of_documents(doc_counts: DataFrame, class_counts: DataFrame, reduce_frequent_words: bool = True) -> DataFrame:
    """c-TF-IDF of single documents against the word statistics of all topics.

    ``doc_counts`` is ``(topic, doc_id, word, n)``, with the words of each
    document in ``n_doc`` if they are known.
    """
    words = cut_lineage(word_rarity(class_counts))
    weight = document_share(reduce_frequent_words) * F.col("rarity")
    return join_frequent(with_sizes(doc_counts), words, ["word"], "n_word").select("topic", "doc_id", "word", weight.alias("weight"))


def word_rarity(class_counts: DataFrame) -> DataFrame:
    """``(word, n_word, rarity)``: the logarithm that c-TF-IDF multiplies the share of a word with."""
    _, mean = class_statistics(class_counts)
    words = class_counts.groupBy("word").agg(F.sum("n").alias("n_word"))
    return words.select("word", "n_word", F.log(1 + mean.scalar() / F.col("n_word")).alias("rarity"))


def with_sizes(doc_counts: DataFrame) -> DataFrame:
    """``doc_counts`` with the words of each document in ``n_doc``."""
    if "n_doc" in doc_counts.columns:
        return doc_counts
    # a window over one document's words; a join would read the texts a second time
    return doc_counts.withColumn("n_doc", F.sum("n").over(Window.partitionBy("doc_id")))


def document_share(reduce_frequent_words: bool) -> Column:
    share = F.col("n") / F.col("n_doc")
    return F.sqrt(share) if reduce_frequent_words else share


def tfidf(counts: DataFrame, n_docs: DataFrame | None = None, fit_counts: DataFrame | None = None) -> DataFrame:
    """``tf * log2(N / df)`` with unit length per document; zero weights are dropped.

    Document frequencies come from ``fit_counts`` (the training part) when
    given; ``n_docs`` is a one-row table.  The join on the word is left to AQE,
    which splits the partitions of words that are in very many documents.
    """
    fit = counts if fit_counts is None else fit_counts
    if n_docs is None:
        n_docs = document_count(fit)
    idf = (
        document_frequency(fit)
        .select("word", F.log2(n_docs.scalar() / F.col("df")).alias("idf"))
        .filter(F.abs("idf") > 1e-12)
    )
    weighted = counts.join(idf, "word").select("doc_id", "word", (F.col("n") * F.col("idf")).alias("_w"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc_id")))
    return weighted.select("doc_id", "word", (F.col("_w") / length).alias("weight"))
