"""Token tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators.numbering import running_start

TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "vectorizer": tx.vectorizer_tokens,
    "tidy": tx.tidy_tokens,
    "whitespace": tx.whitespace_tokens,
}


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose costly expression must not be copied into every place that uses it.

    The optimizer repeats a projected expression in filters and lambdas above
    it, but not the output of a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def tokenize(
    df: DataFrame,
    column: str = "document",
    tokenizer: str | Callable[[Column], Column] = "vectorizer",
    keep: Sequence[str] = ("doc_id",),
    position: bool = True,
) -> DataFrame:
    """One row per word: the kept columns, ``pos`` and ``word``."""
    split = TOKENIZERS[tokenizer] if isinstance(tokenizer, str) else tokenizer
    words = split(F.col(column))
    if position:
        return df.select(*keep, F.posexplode(words).alias("pos", "word"))
    return df.select(*keep, F.explode(words).alias("word"))


def unnest_tokens(df: DataFrame, column: str = "post_message") -> DataFrame:
    """Tidy text: one row per word, every other column kept."""
    keep = [c for c in df.columns if c != column]
    return tokenize(df, column, "tidy", keep, position=False)


def ngrams(
    df: DataFrame,
    column: str = "document",
    low: int = 1,
    high: int = 1,
    stop_words: Sequence[str] = (),
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """n-grams over the tokens that are left after stop-word removal."""
    tokens = tx.drop_listed(tx.vectorizer_tokens(F.col(column)), list(stop_words))
    return df.select(*keep, tokens.alias("_tokens")).select(
        *keep, F.posexplode(tx.ngram_tokens(F.col("_tokens"), low, high)).alias("pos", "word")
    )


def chunk_words(
    df: DataFrame,
    column: str = "document",
    words: int = 512,
    limit: int | None = None,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Cut each document into pieces of ``words`` words; ``limit`` keeps the first pieces, if given."""
    size = F.size("_words")
    pieces = F.ceil(size / F.lit(words)).cast("int")
    if limit is not None:
        pieces = F.least(pieces, F.lit(limit))
    starts = F.when(pieces > 0, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array().cast("array<int>"))
    return (
        df.select(*keep, tx.whitespace_tokens(F.col(column)).alias("_words"))
        .select(
            *keep,
            F.posexplode(
                F.transform(starts, lambda i: F.array_join(F.slice("_words", i * words + 1, words), " "))
            ).alias("chunk", "chunk_text"),
        )
    )


def corpus_chunks(
    df: DataFrame,
    order: Sequence[str],
    block: Column,
    column: str = "document",
    words: int = 512,
    limit: int | None = None,
) -> DataFrame:
    """Cut the whole corpus, read as one text, into pieces ``(chunk, chunk_text)`` of ``words`` words.

    The corpus is never joined to one string: each document learns how many
    words come before it, splits itself at the piece borders, and only the
    parts of one piece (at most ``words`` words) meet.
    """
    base = df.select(*order, block.alias("_given"), tx.whitespace_tokens(F.col(column)).alias("_words")).filter(
        F.size("_words") > 0
    )
    placed = running_start(base, F.size("_words"), order, F.col("_given"), name="_first")
    if limit is not None:
        placed = placed.filter(F.col("_first") < F.lit(words * limit))
    first, size = F.col("_first"), F.size("_words")
    low = F.floor(first / F.lit(words))
    high = F.floor((first + size - 1) / F.lit(words))
    if limit is not None:
        high = F.least(high, F.lit(limit - 1))
    pieces = placed.select("_first", "_words", F.explode(F.sequence(low, high)).alias("chunk"))
    begin = F.greatest(F.col("chunk") * words - F.col("_first"), F.lit(0)).cast("int")
    end = F.least((F.col("chunk") + 1) * words - F.col("_first"), F.size("_words")).cast("int")
    pieces = pieces.select("chunk", "_first", F.array_join(F.slice("_words", begin + 1, end - begin), " ").alias("_part"))
    return pieces.groupBy("chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_part"))), lambda s: s["_part"]), " ").alias(
            "chunk_text"
        )
    )
