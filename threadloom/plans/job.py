"""Batch jobs: read, fit, write."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.embedding import Embedder, hash_embedder, load_or_embed, save_embeddings
from threadloom.operators.labelling import ask_model, build_prompts, parse_answers
from threadloom.operators.lda import LdaOutput, LdaSettings, train_lda
from threadloom.operators.ranking import split_corpus
from threadloom.operators.counting import preprocess_corpus
from threadloom.operators.representation import intermediate_results
from threadloom.plans.config import TopicJobConfig
from threadloom.plans.fit import TopicTables, fit_topics
from threadloom.sources import readers, writers

log = logging.getLogger("threadloom")


def run_topic_job(
    spark: SparkSession,
    data_path: str,
    result_path: str,
    cfg: TopicJobConfig = TopicJobConfig(),
    embeddings_path: str | None = None,
    embedder: Embedder | None = None,
    complete: Callable | None = None,
) -> TopicTables | None:
    """Documents to topics to files; None when the input is empty.

    Writes the topic tables before and after relabelling as CSV folders, the
    model as parquet and, on request, the embeddings.
    """
    docs = readers.read_documents(spark, data_path)
    if docs.isEmpty():
        log.warning("No data found")
        return None
    embedder = embedder or hash_embedder(cfg.embedding_dims, list(cfg.stop_words))
    store = f"{result_path}/embeddings"
    vectors = load_or_embed(docs, embeddings_path, embedder)
    if cfg.save_embeddings:
        # written once, then read back: the encoder runs a single time
        save_embeddings(vectors, store)
        vectors = spark.read.parquet(store)
    tables = fit_topics(docs, cfg, embeddings=vectors, complete=complete)
    tables.save(f"{result_path}/model")
    writers.write_topic_info(tables.topic_info, f"{result_path}/output")
    writers.write_intermediate(intermediate_table(tables, cfg), f"{result_path}/intermediate")
    return tables


def intermediate_table(tables: TopicTables, cfg: TopicJobConfig) -> DataFrame:
    sizes = tables.docs.groupBy("topic").agg(F.count("*").alias("count"))
    return intermediate_results(
        sizes, tables.ctfidf_words, tables.representative_docs, cfg.top_n_words, cfg.nr_representative_docs
    )


def relabel_saved(
    spark: SparkSession,
    model_path: str,
    result_path: str,
    complete: Callable,
    prompt: str | None = None,
    n_words: int = 10,
    ndjson: bool = False,
) -> DataFrame | None:
    """Label the topics of a saved model anew and write the labels; None when there is no model."""
    tables = TopicTables.load(spark, model_path)
    if tables is None:
        return None
    words = tables.ctfidf_words.filter(F.col("rank") <= n_words)
    answers = f"{result_path}/answers"
    ask_model(build_prompts(words, tables.prompt_docs, prompt), complete).write.mode("overwrite").parquet(answers)
    labels = parse_answers(spark.read.parquet(answers), ndjson).select("topic", "label")
    writers.write_labels(labels, f"{result_path}/labels")
    return labels


def lda_from_text(
    spark: SparkSession, path: str, settings: LdaSettings = LdaSettings(), **preprocessing
) -> LdaOutput:
    """LDA over a text file with one document per line, or a folder with parts of one."""
    if readers.path_kind(spark, path) is None:
        raise FileNotFoundError("The specified datapath does not exist")
    counts = preprocess_corpus(readers.read_text_documents(spark, path), **preprocessing)
    return train_lda(split_corpus(counts) if settings.use_partitions else counts, settings)
