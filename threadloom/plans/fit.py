"""Fitting topics: documents in, named tables out."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import clustering as cl
from threadloom.operators import counting as ct
from threadloom.operators import ranking as rk
from threadloom.operators import representation as rp
from threadloom.operators import weighting as wt
from threadloom.operators.embedding import Embedder, hash_embedder
from threadloom.operators.hierarchy import reduce_topics
from threadloom.operators.labelling import ask_model, ask_model_chat, build_prompts, chat_messages, parse_answers
from threadloom.operators.reduction import neighbor_embed, pca
from threadloom.plans.config import Clustering, Reduction, TopicJobConfig
from threadloom.session import cut_lineage
from threadloom.sources.readers import path_kind, read_text_documents

log = logging.getLogger("threadloom")


@dataclass
class TopicTables:
    """A fitted model; every member is a DataFrame."""

    docs: DataFrame  # doc_id, topic, probability
    topic_words: DataFrame  # topic, rank, word, score: the final representation
    ctfidf_words: DataFrame  # topic, rank, word, score: the base list of 30 or more words
    topic_vectors: DataFrame  # topic, vector
    representative_docs: DataFrame  # topic, rank, doc_id, document
    prompt_docs: DataFrame  # topic, rank, doc_id, document: the diverse choice for prompts
    topic_info: DataFrame
    labels: DataFrame  # topic, label
    probabilities: DataFrame | None = None  # doc_id, topic, similarity: only on request
    aspects: DataFrame | None = None  # aspect, topic, rank, word, score: the further parts of a representation

    def save(self, path: str) -> None:
        for f in fields(self):
            table = getattr(self, f.name)
            if table is not None:
                table.write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicTables | None:
        """A saved model, or None when the path does not exist."""
        if path_kind(spark, path) != "dir":
            return None
        tables = {}
        for f in fields(cls):
            at = f"{path}/{f.name}"
            tables[f.name] = spark.read.parquet(at) if path_kind(spark, at) == "dir" else None
        return cls(**tables)


def chosen_model(cfg: TopicJobConfig, complete: Callable | Mapping[str, Callable] | None) -> Callable | None:
    """The labelling model: the given function, or the one that ``representation_model`` names among several."""
    if not isinstance(complete, Mapping):
        return complete
    if cfg.representation_model is None:
        return None
    name = cfg.representation_model.value
    if name not in complete:
        raise ValueError(f"no model named {name} was given")
    return complete[name]


def reduce_vectors(vectors: DataFrame, cfg: TopicJobConfig) -> DataFrame:
    if cfg.reduction is Reduction.none:
        return vectors
    if cfg.reduction is Reduction.umap:
        return neighbor_embed(vectors, cfg.n_components or 5, cfg.n_neighbors, approximate=cfg.approximate_neighbors)
    return pca(vectors, cfg.n_components or 10)


def cluster_vectors(vectors: DataFrame, cfg: TopicJobConfig) -> DataFrame:
    """``(doc_id, topic)``, with ``strength`` where the method has one."""
    if cfg.clustering is Clustering.kmeans:
        return cl.kmeans(vectors, cfg.n_clusters, cfg.seed)
    if cfg.clustering is Clustering.agglomerative:
        return cl.agglomerative(vectors, cfg.n_clusters)
    return cl.density_clusters(vectors, cfg.min_topic_size, cfg.min_samples, cfg.levels)


def topic_tokens(docs: DataFrame, cfg: TopicJobConfig) -> DataFrame:
    """``(doc_id, topic, word)`` with stop words removed, n-grams if asked for."""
    tokens = tx.drop_listed(tx.vectorizer_tokens(F.col("document")), list(cfg.stop_words))
    if (cfg.ngram_low, cfg.ngram_high) != (1, 1):
        rows = docs.select("doc_id", "topic", tokens.alias("_t"))
        return rows.select("doc_id", "topic", F.explode(tx.ngram_tokens(F.col("_t"), cfg.ngram_low, cfg.ngram_high)).alias("word"))
    return docs.select("doc_id", "topic", F.explode(tokens).alias("word"))


def fit_topics(
    docs: DataFrame,
    cfg: TopicJobConfig = TopicJobConfig(),
    embeddings: DataFrame | None = None,
    embedder: Embedder | None = None,
    seeds: DataFrame | None = None,
    zeroshot: DataFrame | None = None,
    complete: Callable | Mapping[str, Callable] | None = None,
    representation: object = None,
    clusterer: cl.Clusterer | None = None,
) -> TopicTables:
    """Find and describe topics in ``(doc_id, document)``.

    ``embeddings`` skips the embedder; ``seeds`` ``(seed, vector)`` guides the
    vectors; ``zeroshot`` ``(label, vector)`` names known topics; ``complete``
    is the labelling model, or several by name, of which
    ``cfg.representation_model`` chooses one (none: topics keep their words);
    ``representation`` is a chain of steps.
    """
    complete = chosen_model(cfg, complete)
    docs = docs.select("doc_id", "document")
    if embeddings is None:
        embeddings = (embedder or hash_embedder(cfg.embedding_dims, list(cfg.stop_words)))(docs)
    vectors = cut_lineage(docs.select("doc_id").join(embeddings.select("doc_id", "embedding"), "doc_id"))
    if seeds is not None:
        vectors = cut_lineage(cl.guided_blend(vectors, seeds).select("doc_id", "embedding"))

    label_names = None
    rest, assigned = vectors, None
    if zeroshot is not None:
        placed = cut_lineage(cl.zeroshot_assign(vectors, zeroshot, cfg.zeroshot_min_similarity))
        assigned = placed.filter("label is not null").select("doc_id", "label")
        rest = placed.filter("label is null").select("doc_id", "embedding")
    strength = None
    if zeroshot is None or not rest.isEmpty():
        reduced = reduce_vectors(rest, cfg)
        clustered = cut_lineage(clusterer(reduced) if clusterer is not None else cluster_vectors(reduced, cfg))
        if "strength" in clustered.columns:
            strength = clustered.select("doc_id", "strength")
        clustered = clustered.select("doc_id", "topic")
    else:
        clustered = vectors.sparkSession.createDataFrame([], "doc_id bigint, topic int")
    if assigned is not None:
        clustered, label_names = cl.combine_zeroshot(assigned, clustered)
        clustered = cut_lineage(clustered)
    if cfg.nr_topics:
        # the number of topics is cut before they are numbered by size
        centres = cl.topic_centroids(clustered.join(vectors, "doc_id"))
        mapping = reduce_topics(centres, cfg.nr_topics)
        clustered = clustered.join(mapping, "topic").select("doc_id", F.col("merged").alias("topic"))
        if label_names is not None:
            # a topic made of several known ones has all their names
            names = F.array_join(F.array_sort(F.collect_set("label")), " / ").alias("label")
            label_names = label_names.join(mapping, "topic").groupBy(F.col("merged").alias("topic")).agg(names)
    numbered, renamed = rk.relabel_topics(clustered)
    numbered = cut_lineage(numbered.select("doc_id", "topic"))
    if label_names is not None:
        label_names = (
            label_names.withColumnRenamed("topic", "old_topic").join(renamed, "old_topic").select("topic", "label")
        )

    topical = docs.join(numbered, "doc_id")
    centres = cut_lineage(cl.topic_centroids(numbered.join(vectors, "doc_id")))
    # the texts are split once; the words of a topic are summed from those of its documents
    doc_counts = cut_lineage(rk.candidate_counts(topical, lambda some: topic_tokens(some, cfg)))
    class_counts = cut_lineage(rk.class_counts_of(doc_counts))
    scores = cut_lineage(wt.ctfidf(class_counts, cfg.reduce_frequent_words))
    base = cut_lineage(rk.base_words(scores, cfg.top_n_words))

    similarity = cut_lineage(rk.doc_topic_cosine(doc_counts, class_counts, scores, cfg.reduce_frequent_words))

    def with_text(picked: DataFrame) -> DataFrame:
        return cut_lineage(picked.join(docs, "doc_id").select("topic", "rank", "doc_id", "document"))

    rep = with_text(rp.mmr_docs(doc_counts, similarity, cfg.nr_representative_docs, 0))
    weights = wt.ctfidf_of_documents(doc_counts, class_counts, cfg.reduce_frequent_words)
    for_prompt = with_text(rp.mmr_docs(weights, similarity, cfg.nr_docs, cfg.document_diversity))

    labels = topical.sparkSession.createDataFrame([], "topic int, label string")
    steps = representation
    if steps is None and cfg.keyword_rerank:
        word_vectors = cut_lineage(rp.word_mean_vectors(base, topic_tokens(topical, cfg), vectors))
        steps = lambda words: rp.keyword_rerank(words, word_vectors, centres, cfg.top_n_words)
    if complete is not None:
        if cfg.chat:
            answers = ask_model_chat(chat_messages(for_prompt, cfg.doc_length), complete)
        else:
            answers = ask_model(build_prompts(base, for_prompt, cfg.prompt, cfg.doc_length), complete)
        # written down at once, so that no later step asks the model again
        labels = cut_lineage(parse_answers(answers, ndjson=False).select("topic", "label"))
        if steps is None:
            steps = lambda words: labels.select(
                "topic", F.lit(1).alias("rank"), F.col("label").alias("word"), F.lit(1.0).alias("score")
            )
    elif label_names is not None:
        labels = label_names
    described = cut_lineage(rp.representation_chain(base, steps, cfg.top_n_words))
    words = described.filter("aspect = 'Main'").drop("aspect")

    near = cl.topic_probability(vectors.join(numbered.select("doc_id"), "doc_id"), centres.filter("topic >= 0"))
    if strength is not None and zeroshot is None:
        own = numbered.join(strength, "doc_id").select("doc_id", "topic", F.col("strength").alias("probability"))
    else:
        own = numbered.join(near.select("doc_id", F.col("similarity").alias("probability")), "doc_id")
    info = rp.topic_info(
        ct.topic_sizes(numbered), words, rep, cfg.top_n_words, cfg.nr_representative_docs
    )
    full = None
    if cfg.calculate_probabilities:
        full = cl.topic_probability(vectors, centres.filter("topic >= 0"), full=True).select("doc_id", "topic", "similarity")
    return TopicTables(
        docs=cut_lineage(own),
        topic_words=words,
        ctfidf_words=base,
        topic_vectors=centres,
        representative_docs=rep,
        prompt_docs=for_prompt,
        topic_info=cut_lineage(info),
        labels=labels,
        probabilities=full,
        aspects=described.filter("aspect != 'Main'"),
    )


def topics_from_text(spark: SparkSession, path: str, cfg: TopicJobConfig = TopicJobConfig(), **options) -> DataFrame:
    """Topic table of a text file with one document per line, or of a folder with parts of one."""
    if path_kind(spark, path) is None:
        raise FileNotFoundError("The specified datapath does not exist")
    return fit_topics(read_text_documents(spark, path), cfg, **options).topic_info
