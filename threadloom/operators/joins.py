"""Joins between tokens, vocabularies, documents and topics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest matrix (in numbers) that is shipped to every task.
MATRIX_LIMIT = 8_000_000
#: Keys whose values are sent to every task at most.
FREQUENT_KEYS = 1 << 17
#: Longest word list that is written into a plan as literals.
LITERAL_LIMIT = 10_000


def stop_table(tokens: DataFrame, stop_words: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(stop_words, DataFrame):
        return stop_words.select("word")
    return tokens.sparkSession.createDataFrame([(w,) for w in stop_words], "word string")


def drop_stop_words(tokens: DataFrame, stop_words: Sequence[str] | DataFrame) -> DataFrame:
    """Tokens whose word is not in the stop list.

    A list is a hash lookup inside the scan stage.  A table is an anti join
    that Spark broadcasts only if its measured size allows it.
    """
    if isinstance(stop_words, DataFrame) or len(stop_words) > LITERAL_LIMIT:
        return tokens.join(stop_table(tokens, stop_words), "word", "left_anti")
    return tokens.filter(~F.col("word").isin(list(stop_words))) if stop_words else tokens


def stopword_anti_join(tokens: DataFrame, stop_words: DataFrame) -> DataFrame:
    return tokens.join(stop_words.select("word"), "word", "left_anti")


def stopword_union(*lists: DataFrame) -> DataFrame:
    """Set union of stop-word tables."""
    out = lists[0].select("word")
    for other in lists[1:]:
        out = out.union(other.select("word"))
    return out.distinct()


def vocab_semi_join(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return tokens.join(vocabulary.select("word"), "word", "left_semi")


def attach_words(ids: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Look up the word of each ``term_id``."""
    return ids.join(dictionary.select("term_id", "word"), "term_id")


def union_forums(*tables: DataFrame) -> DataFrame:
    """Stack forum tables by column name; columns missing in one are null."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def docs_with_embeddings(docs: DataFrame, embeddings: DataFrame, check: bool = False) -> DataFrame:
    """Attach vectors by ``doc_id``; ``check`` stops when a document has none or the counts differ."""
    out = docs.join(embeddings.select("doc_id", "embedding"), "doc_id")
    if check:
        n_docs, n_vectors, n_both = docs.count(), embeddings.count(), out.count()
        if not n_docs == n_vectors == n_both:
            raise ValueError(f"{n_docs} documents, {n_vectors} embeddings, {n_both} in both")
    return out


def collect_matrix(vectors: DataFrame, key: str, column: str) -> tuple[list, np.ndarray] | None:
    """A small keyed vector table as (keys, matrix), or None when it is larger than ``MATRIX_LIMIT``."""
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size(column)).alias("d")).first()
    n, d = shape["n"], shape["d"] or 0
    if n * d > MATRIX_LIMIT:
        return None
    rows = vectors.select(key, F.col(column).cast("array<double>").alias("v")).orderBy(key).collect()
    return [r[key] for r in rows], np.array([r["v"] for r in rows], dtype=float).reshape(len(rows), d)


def vector_similarity(
    docs: DataFrame,
    targets: DataFrame,
    doc_column: str = "embedding",
    key: str = "topic",
    column: str = "vector",
    mode: str = "best",
    min_similarity: float | None = None,
) -> DataFrame:
    """Cosine of each document with each target vector.

    ``mode="best"`` adds the key and similarity of the nearest target (ties: the
    smaller key), one row per document.  ``mode="all"`` gives one row per pair,
    which is what a full probability matrix is, without the document's vector.

    The target matrix goes to the tasks while it is within ``MATRIX_LIMIT``;
    beyond that it is taken in slices of that size, and the best of the slices
    is kept per document.
    """
    if mode not in ("best", "all"):
        raise ValueError("mode must be 'best' or 'all'")
    found = collect_matrix(targets, key, column)
    if found is None:
        return _sliced_similarity(docs, targets, doc_column, key, column, mode, min_similarity)
    return _matrix_similarity(docs, found, targets.schema[key].dataType, doc_column, key, mode, min_similarity)


def _matrix_similarity(docs, found, key_type, doc_column, key, mode, min_similarity) -> DataFrame:
    keys, matrix = found
    if not keys:
        none = docs if mode == "best" else docs.drop(doc_column).limit(0)
        return none.withColumn(key, F.lit(None).cast(key_type)).withColumn("similarity", F.lit(None).cast("double"))
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)
    # a pair doesn't carry the vector of its document
    names = [c for c in docs.columns if mode == "best" or c != doc_column]
    kind = key_type.simpleString()

    def score(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.array(pdf[doc_column].tolist(), dtype=float)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            s = np.divide(x, n, out=np.zeros_like(x), where=n > 0) @ unit.T
            if mode == "best":
                # differences below 1e-12 are rounding noise: they count as ties
                best = (np.round(s, 12)).argmax(axis=1)
                yield pdf.assign(**{key: [keys[i] for i in best], "similarity": s[np.arange(len(s)), best]})
                continue
            rows, cols = np.indices(s.shape)
            rows, cols, flat = rows.ravel(), cols.ravel(), s.ravel()
            if min_similarity is not None:
                hit = flat >= min_similarity
                rows, cols, flat = rows[hit], cols[hit], flat[hit]
            out = pdf[names].iloc[rows].reset_index(drop=True)
            yield out.assign(**{key: [keys[i] for i in cols], "similarity": flat})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields] + [f"`{key}` {kind}", "similarity double"])
    out = docs.mapInPandas(score, schema)
    if mode == "best" and min_similarity is not None:
        out = out.filter(F.col("similarity") >= min_similarity)
    return out


def _sliced_similarity(docs, targets, doc_column, key, column, mode, min_similarity) -> DataFrame:
    """Targets too many for one matrix: one pass per slice, then the best per document."""
    width = targets.agg(F.max(F.size(column))).first()[0]
    per_slice = max(1, MATRIX_LIMIT // (2 * max(width, 1)))
    n = targets.count()
    n_slices = -(-n // per_slice) * 2
    piece = F.pmod(F.xxhash64(F.col(key)), F.lit(n_slices))
    from threadloom.session import cut_lineage

    targets = cut_lineage(targets.withColumn("_slice", piece))
    docs = cut_lineage(docs.withColumn("_mono", F.monotonically_increasing_id()))
    parts = []
    for i in range(n_slices):
        found = collect_matrix(targets.filter(F.col("_slice") == i), key, column)
        if found is None:
            raise ValueError("a slice of the target vectors is too large; raise MATRIX_LIMIT")
        if found[0]:
            parts.append(
                _matrix_similarity(docs, found, targets.schema[key].dataType, doc_column, key, mode, min_similarity)
            )
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    if mode == "all":
        return out.drop("_mono")
    names = [c for c in docs.columns if c != "_mono"]
    chosen = (
        out.select("_mono", F.col(key), "similarity")
        .groupBy("_mono")
        .agg(F.max(F.round("similarity", 12)).alias("_top"))
    )
    keyed = (
        out.join(chosen, "_mono")
        .filter(F.round("similarity", 12) == F.col("_top"))
        .groupBy("_mono")
        .agg(F.min(F.struct(F.col(key), F.col("similarity"))).alias("_best"))
    )
    return docs.join(keyed, "_mono").select(*names, F.col(f"_best.{key}").alias(key), F.col("_best.similarity").alias("similarity"))


def doc_topic_similarity(docs: DataFrame, topic_vectors: DataFrame, **options) -> DataFrame:
    """Cosine of every document with every topic vector."""
    return vector_similarity(docs, topic_vectors, mode="all", **options)


def join_frequent(rows: DataFrame, values: DataFrame, on: Sequence[str], count: str, most: int = FREQUENT_KEYS) -> DataFrame:
    """Inner join of many rows with a stored table of unique keys, without ``count``, the number of uses of a key.

    The values of the most used keys, ``most`` of them at most, are broadcast.
    Only rows with another key are shuffled, which in texts are few, and none
    of their keys is a hot one.
    """
    # classes of like counts: 500 rows at most
    size = F.coalesce(F.floor(8 * F.log2(F.greatest(F.col(count), F.lit(0)))).cast("int"), F.lit(-1))
    classes = sorted(values.groupBy(size.alias("c")).count().collect(), key=lambda r: -r["c"])
    on = list(on)
    if sum(r["count"] for r in classes) <= most:
        return rows.join(F.broadcast(values.drop(count)), on)
    least, keys = None, 0
    for r in classes:
        keys += r["count"]
        if keys > most:
            break
        least = r["c"]
    if least is None:
        return rows.join(values.drop(count), on)
    often, rarely = values.filter(size >= least).drop(count), values.filter(size < least).drop(count)
    rest = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(rarely, on)
    return rows.join(F.broadcast(often), on).unionByName(rest)
