"""Counts, vocabularies and their limits.

Token rows are always reduced by a hash aggregate on (key, word) first, which
Spark combines on the map side; no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.numbering import hashed_ids


def _present(tokens: DataFrame, *columns: str) -> DataFrame:
    """Rows whose keys are not null.

    Stated here because a later join would push the same filter into only one
    of the uses of the counts; with equal plans Spark runs the scan and the
    shuffle once and reuses the exchange.
    """
    for c in columns:
        tokens = tokens.filter(F.col(c).isNotNull())
    return tokens


def word_counts(tokens: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Occurrences per word; ``low`` and ``high`` are exclusive bounds."""
    counts = tokens.groupBy("word").agg(F.count("*").alias("n"))
    if low is not None:
        counts = counts.filter(F.col("n") > low)
    if high is not None:
        counts = counts.filter(F.col("n") < high)
    return counts


def doc_term_counts(tokens: DataFrame) -> DataFrame:
    """Document-term matrix in long form ``(doc_id, word, n)``."""
    return _present(tokens, "doc_id", "word").groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def class_term_counts(tokens: DataFrame, topic: str = "topic") -> DataFrame:
    """Words of all documents of a topic as one bag ``(topic, word, n)``; the joined text is never built."""
    return _present(tokens, topic, "word").groupBy(F.col(topic).alias("topic"), "word").agg(F.count("*").alias("n"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """``(word, df)`` from the long document-term matrix, whose (doc_id, word) pairs are unique."""
    # every pair counts one; written with n, so that the plan below keeps it and its exchange is shared
    return counts.groupBy("word").agg(F.sum(F.least("n", F.lit(1).cast("bigint"))).alias("df"))


def document_count(counts: DataFrame) -> DataFrame:
    """One row ``(n_docs)``: the documents that have at least one word."""
    return counts.agg(F.countDistinct(F.when(F.col("n") > 0, F.col("doc_id"))).alias("n_docs"))


def df_bounds(n_docs: Column, min_df: int | float, max_df: int | float) -> tuple[Column, Column]:
    """Lowest and highest allowed document frequency; a float is a share of all documents."""
    # the small step keeps shares such as 0.07 * 100 from being rounded up by binary fractions
    low = F.ceil(n_docs * F.lit(min_df) - F.lit(1e-9)) if isinstance(min_df, float) else F.lit(min_df)
    high = F.floor(n_docs * F.lit(max_df) + F.lit(1e-9)) if isinstance(max_df, float) else F.lit(max_df)
    return low, high


def df_prune(
    counts: DataFrame, min_df: int | float = 1, max_df: int | float = 1.0, n_docs: DataFrame | None = None
) -> DataFrame:
    """Vocabulary ``(word, df)`` within the document-frequency bounds.

    ``n_docs`` is a one-row table ``(n_docs)``; by default the documents that have a word are counted.
    """
    if n_docs is None:
        n_docs = document_count(counts)
    return _within_df(document_frequency(counts), n_docs, min_df, max_df)


def _within_df(words: DataFrame, n_docs: DataFrame, min_df: int | float, max_df: int | float) -> DataFrame:
    low, high = df_bounds(n_docs.scalar(), min_df, max_df)
    return words.filter((F.col("df") >= low) & (F.col("df") <= high))


def topic_sizes(docs: DataFrame, topic: str = "topic") -> DataFrame:
    return docs.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("count"))


def topic_labels(docs: DataFrame, topic: str = "topic") -> DataFrame:
    return docs.select(F.col(topic).alias("topic")).distinct().orderBy("topic")


def build_dictionary(tokens: DataFrame) -> DataFrame:
    """``(term_id, word)`` over every distinct word, ids 0..V-1."""
    return hashed_ids(tokens.select("word").distinct(), "word", "term_id")


def matrix_shape(counts: DataFrame) -> DataFrame:
    """Documents, vocabulary size and stored cells of a document-term matrix."""
    # several distinct counts in one aggregate would copy every cell for each of them
    docs = counts.select("doc_id").distinct().agg(F.count("doc_id"))
    words = counts.select("word").distinct().agg(F.count("word"))
    cells = counts.agg(F.count("*").alias("n_cells"))
    return cells.select(docs.scalar().alias("n_docs"), words.scalar().alias("n_words"), "n_cells")


def mean_vectors(vectors: DataFrame, key: str = "topic", column: str = "embedding", name: str = "vector") -> DataFrame:
    """Mean vector per key.

    ``Summarizer`` keeps one running vector per key and task, so a topic that
    owns most documents costs no more than any other.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = vectors.select(F.col(key), array_to_vector(F.col(column).cast("array<double>")).alias("_v"))
    return rows.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(key, vector_to_array("_m").alias(name))


def preprocess_corpus(
    docs: DataFrame,
    stop_words: Sequence[str] = (),
    lemmas: DataFrame | None = None,
    min_chars: int = 1,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    min_words: int = 0,
    max_features: int | None = None,
    vocabulary: DataFrame | None = None,
    column: str = "document",
) -> DataFrame:
    """Long document-term counts after the whole clean-up chain.

    lower-case, punctuation, lemmas, stop words, short words, document
    frequency, vocabulary, short documents: in this order.
    """
    from threadloom.functions import text as tx
    from threadloom.operators.cleaning import lemmatize, min_words_docs, token_min_chars
    from threadloom.operators.joins import drop_stop_words
    from threadloom.operators.tokens import tokenize

    tokens = tokenize(
        docs.withColumn(column, F.lower(tx.remove_punctuation(F.col(column)))), column, "whitespace", position=False
    )
    if lemmas is not None:
        tokens = lemmatize(tokens, lemmas)
    tokens = token_min_chars(drop_stop_words(tokens, stop_words), min_chars)
    counts = doc_term_counts(tokens)
    words = None
    if (min_df, max_df) != (1, 1.0) or max_features is not None:
        # one table of word totals gives both limits
        one = F.least("n", F.lit(1).cast("bigint"))
        words = counts.groupBy("word").agg(F.sum(one).alias("df"), F.sum("n").alias("total"))
        words = _within_df(words, docs.agg(F.count("*").alias("n_docs")), min_df, max_df)
    if vocabulary is not None:
        known = vocabulary.select("word").distinct()
        words = known if words is None else words.join(known, "word")
    if max_features is not None:
        words = words.orderBy(F.desc("total"), "word").limit(max_features)
    if words is not None:
        # an inner join with unique words; a semi join would be moved below the counting, onto raw tokens
        counts = counts.join(words.select("word"), "word")
    return min_words_docs(counts, min_words) if min_words > 0 else counts
