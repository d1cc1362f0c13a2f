"""Row filters and document clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import text as tx
from threadloom.functions.words import STOP_WORD_LANGUAGES, language_stop_words
from threadloom.operators.tokens import compute_once


def clean_documents(df: DataFrame, column: str = "document") -> DataFrame:
    return df.withColumn(column, tx.clean_text(F.col(column)))


def first_posts(posts: DataFrame, number: str = "message_nr") -> DataFrame:
    """Opening post of every thread."""
    return posts.filter(F.col(number) == 1)


def drop_null_text(posts: DataFrame, column: str = "post_message") -> DataFrame:
    return posts.na.drop(subset=[column])


def combine_text(df: DataFrame, name: str = "combined_text") -> DataFrame:
    """All string columns of a row joined by a blank; other types and nulls are left out."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumn(name, F.concat_ws(" ", *[F.col(c) for c in strings]))


def longest_document(df: DataFrame, column: str = "document") -> DataFrame:
    return df.agg(F.max(F.char_length(column)).cast("bigint").alias("max_length"))


def lemmatize(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace words by their lemma where the ``(form, lemma)`` table has one.

    No hint: the table can be a full dictionary, so Spark chooses by its size.
    """
    return (
        tokens.join(lemmas.select(F.col("form").alias("word"), "lemma"), "word", "left")
        .withColumn("word", F.coalesce("lemma", "word"))
        .drop("lemma")
    )


def token_min_chars(tokens: DataFrame, n: int) -> DataFrame:
    return tokens.filter(F.char_length("word") >= n)


def min_words_docs(counts: DataFrame, n: int) -> DataFrame:
    """Keep documents with at least ``n`` words; input is the long ``(doc_id, word, n)`` table."""
    words = F.sum("n").over(Window.partitionBy("doc_id"))
    return counts.withColumn("_words", words).filter(F.col("_words") >= n).drop("_words")


def detect_language(df: DataFrame, column: str = "document", lists: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Vote for a language by counting stop words of each list; ties go to the first code.

    The lists are literals, so the vote is a hash lookup per token inside the
    row: no explode and no shuffle.
    """
    if lists is None:
        lists = {code: language_stop_words(name) for code, name in STOP_WORD_LANGUAGES.items()}
    tokens = F.col("_tokens")

    def hits(words: Sequence[str]) -> Column:
        return F.size(F.filter(tokens, lambda w: w.isin(list(words))))

    votes = F.array(*[F.struct((-hits(lists[c])).alias("h"), F.lit(c).alias("code")) for c in sorted(lists)])
    best = F.array_min(votes)
    rows = compute_once(df, "_tokens", tx.vectorizer_tokens(F.col(column)))
    return (
        compute_once(rows, "_best", best)
        .withColumn("language_hits", (-F.col("_best.h")).cast("bigint"))
        .withColumn("language", F.when(F.col("_best.h") < 0, F.col("_best.code")))
        .drop("_tokens", "_best")
    )


def language_filter(df: DataFrame, language: str = "en", column: str = "document") -> DataFrame:
    """Keep documents whose stop words point to one language."""
    return detect_language(df, column).filter(F.col("language") == language)


#: First letters of a word whose deletions are its keys.
KEY_LETTERS = 7


def deletion_keys(word: Column, max_distance: int) -> Column:
    """What is left of a word's first ``KEY_LETTERS`` letters when up to ``max_distance`` of them are deleted."""

    def without_one(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.lit(KEY_LETTERS)), lambda i: i <= F.char_length(w))
        return F.transform(at, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(KEY_LETTERS))))

    keys = last = F.array(F.substring(word, 1, KEY_LETTERS))
    for _ in range(max_distance):
        last = F.array_distinct(F.flatten(F.transform(last, without_one)))
        keys = F.array_union(keys, last)
    return keys


def spelling_table(vocabulary: DataFrame, dictionary: DataFrame, max_distance: int = 2) -> DataFrame:
    """Corrections ``(word, corrected, distance)`` for vocabulary words missing from the dictionary.

    A deletion index: two words within ``max_distance`` edits have a common
    deletion key, as each edit costs either word one letter at most and letters
    that an insertion moves past the first ``KEY_LETTERS`` are made up for by
    it.  Keys are whole beginnings of words less a letter or two, so few words
    share one.  The edit distance of the pairs is then checked.  Smallest
    distance first, then the most frequent dictionary word, then alphabetical.

    Only distinct words are joined, and none that is too long for all of the
    dictionary.  Tables: vocabulary ``(word)``, dictionary ``(word, n)``.
    """
    d = max_distance
    longest = dictionary.agg((F.max(F.char_length("word")) + d).alias("_longest"))
    size = F.char_length("word")
    unknown = (
        vocabulary.select("word")
        .distinct()
        .join(dictionary.select("word"), "word", "left_anti")
        .filter((size > 0) & (size <= longest.scalar()))
    )
    left = unknown.select("word", F.explode(deletion_keys(F.col("word"), d)).alias("_key"))
    right = dictionary.select(
        F.col("word").alias("candidate"), "n", F.explode(deletion_keys(F.col("word"), d)).alias("_key")
    )
    near = F.abs(size - F.char_length("candidate")) <= d
    pairs = left.join(right, "_key").filter(near).select("word", "candidate", "n").distinct()
    return (
        pairs.withColumn("distance", F.levenshtein(F.col("word"), F.col("candidate"), d))
        .filter(F.col("distance") >= 0)
        .groupBy("word")
        .agg(F.min(F.struct("distance", (-F.col("n")).alias("rare"), "candidate")).alias("_best"))
        .select("word", F.col("_best.candidate").alias("corrected"), F.col("_best.distance").cast("bigint").alias("distance"))
    )


def spell_correct(tokens: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replace misspelt tokens; the corrections table is unique per word."""
    return (
        tokens.join(corrections.select("word", "corrected"), "word", "left")
        .withColumn("word", F.coalesce("corrected", "word"))
        .drop("corrected")
    )
