"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.words import default_stop_words
from threadloom.sources.tables import read_table, spread_small

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


ENTRIES: dict[str, Entry] = {}
STOP = default_stop_words()


def plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, fractions as DOUBLE rounded to 6 places."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append((F.round(F.col(f.name).cast("double"), 6) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def keep(run: Run) -> Run:
        ENTRIES[name] = Entry(lambda spark, folder: plain_types(run(spark, folder)), sql)
        return run

    return keep


# Inputs -------------------------------------------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, document, topic, lang)``; the source stands for a topic."""
    table = read_table(spark, folder, "documents")
    return spread_small(
        table.select("doc_id", F.col("text").alias("document"), F.col("source").alias("topic"), "lang")
    )


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Forum posts from the chat table: role, conversation and turn (from 1)."""
    table = read_table(spark, folder, "conversations")
    return table.select(
        F.col("role").alias("forum"),
        F.col("conv_id").alias("thread_title"),
        (F.col("turn") + 1).alias("message_nr"),
        F.col("text").alias("post_message"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, embedding, topic)``."""
    table = read_table(spark, folder, "embeddings")
    return table.select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("topic"))


# SQL pieces ---------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]"
BLANK = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP_SQL = f"({quoted(STOP)})"


def r6(expression: str) -> str:
    return f"(round({expression}, 6) + 0.0)"


def strip_sql(expression: str) -> str:
    return rf"regexp_replace({expression}, '^{BLANK}+|{BLANK}+\z', '', 'g')"


TOKENS = rf"""
    tokens AS (
        SELECT doc_id, source AS topic, lang, unnest(regexp_extract_all(lower(text), '{WORD}{{2,}}')) AS word
        FROM documents
    )"""
KEPT = TOKENS + f""",
    kept AS (SELECT * FROM tokens WHERE word NOT IN {STOP_SQL})"""
CLASS_COUNTS = KEPT + """,
    counts AS (SELECT topic, word, count(*) AS n FROM kept GROUP BY ALL),
    sizes AS (SELECT topic, sum(n) AS n_topic FROM counts GROUP BY ALL),
    mean AS (SELECT floor(avg(n_topic)) AS a FROM sizes),
    totals AS (SELECT word, sum(n) AS f FROM counts GROUP BY ALL)"""
SCORES = CLASS_COUNTS + """,
    scores AS (
        SELECT topic, word, n, sqrt(n / n_topic) * ln(1 + a / f) AS score
        FROM counts JOIN sizes USING (topic) JOIN totals USING (word), mean
    ),
    ranked AS (
        SELECT topic, word, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS rank FROM scores
    )"""
DOC_COUNTS = KEPT + """,
    dtm AS (SELECT doc_id, word, count(*) AS n FROM kept GROUP BY ALL)"""
TFIDF = DOC_COUNTS + """,
    df AS (SELECT word, count(*) AS df FROM dtm GROUP BY ALL),
    total AS (SELECT count(DISTINCT doc_id) AS n_docs FROM dtm),
    raw AS (SELECT doc_id, word, n * log2(n_docs / df) AS w FROM dtm JOIN df USING (word), total WHERE n_docs > df),
    tfidf AS (SELECT doc_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""
RANKED_DOCS = """,
    cand AS (SELECT topic, doc_id, word, count(*) AS n FROM kept GROUP BY ALL),
    cand_size AS (SELECT doc_id, sum(n) AS n_doc FROM cand GROUP BY ALL),
    doc_weights AS (
        SELECT topic, doc_id, word, sqrt(n / n_doc) * ln(1 + a / f) AS weight
        FROM cand JOIN cand_size USING (doc_id) JOIN totals USING (word), mean
    ),
    topic_len AS (SELECT topic, sqrt(sum(score * score)) AS l FROM scores GROUP BY ALL),
    sims AS (
        SELECT w.topic, w.doc_id, round(sum(weight * score) / (sqrt(sum(weight * weight)) * any_value(l)), 9) AS similarity
        FROM doc_weights w JOIN scores s ON w.topic = s.topic AND w.word = s.word JOIN topic_len t ON t.topic = w.topic
        GROUP BY ALL
    ),
    reps AS (
        SELECT topic, doc_id, similarity, row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, doc_id) AS rank
        FROM sims
    )"""
REPS = SCORES + RANKED_DOCS
VECTORS = """
    vecs AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label::BIGINT AS topic FROM embeddings),
    cells AS (SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs),
    means AS (SELECT topic, i, avg(x) AS x FROM cells GROUP BY ALL),
    centres AS (SELECT topic, list(x ORDER BY i) AS c FROM means GROUP BY ALL)"""


def cosine_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


# Plans used by several queries ---------------------------------------------


def tokens_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, topic, word)`` without stop words."""
    from threadloom.operators.joins import drop_stop_words
    from threadloom.operators.tokens import tokenize

    return drop_stop_words(tokenize(docs, keep=("doc_id", "topic"), position=False), STOP)


def topic_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens_of(documents(spark, folder))


def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    from threadloom.operators.counting import class_term_counts

    return class_term_counts(topic_tokens(spark, folder))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    from threadloom.operators.weighting import ctfidf

    return ctfidf(class_counts(spark, folder))


def top_ten(spark: SparkSession, folder: str) -> DataFrame:
    from threadloom.operators.ranking import top_words

    return top_words(scores(spark, folder), 10)


def doc_counts(spark: SparkSession, folder: str) -> DataFrame:
    from threadloom.operators.counting import doc_term_counts

    return doc_term_counts(topic_tokens(spark, folder))


def counted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Words per document and per topic, from one look at the texts."""
    from threadloom.operators import ranking as rk
    from threadloom.session import cut_lineage

    # the texts are dealt by document, not their words: those of a document stay together, and its sums are made in one task
    docs = documents(spark, folder).repartition(F.col("doc_id"))
    per_doc = cut_lineage(rk.candidate_counts(docs, tokens_of))
    return per_doc, cut_lineage(rk.class_counts_of(per_doc))


def words_and_docs(spark: SparkSession, folder: str, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """Ten best words of each topic, and ``(topic, rank, doc_id, similarity, document)``."""
    from threadloom.operators import ranking as rk
    from threadloom.operators.weighting import ctfidf
    from threadloom.session import cut_lineage

    per_doc, counts = counted(spark, folder)
    weights = ctfidf(counts)
    picked = cut_lineage(rk.representative_docs(per_doc, counts, weights, n))
    return rk.top_words(weights, 10), picked.join(documents(spark, folder).select("doc_id", "document"), "doc_id")


def representative(spark: SparkSession, folder: str, n: int = 3) -> DataFrame:
    """``(topic, rank, doc_id, similarity, document)``."""
    return words_and_docs(spark, folder, n)[1]


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    from threadloom.operators.clustering import topic_centroids

    return topic_centroids(vectors(spark, folder))


def digest(column: str) -> Column:
    """Long texts are compared by their md5."""
    return F.md5(F.col(column))
