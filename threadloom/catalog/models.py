"""Trained models: clusters, reductions, LDA, whole fits.  SQL cannot express these."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from threadloom.catalog import registry as rg
from threadloom.catalog.registry import query
from threadloom.operators import charts as ch
from threadloom.operators import clustering as cl
from threadloom.operators import counting as ct
from threadloom.operators import hierarchy as hi
from threadloom.operators import lda
from threadloom.operators import reduction as rd
from threadloom.operators.approximate import approximate_knn
from threadloom.operators.ranking import split_corpus
from threadloom.plans.config import TopicJobConfig
from threadloom.plans.fit import fit_topics
from threadloom.session import cut_lineage


def flat(df):
    return df.select("doc_id", F.posexplode("embedding").alias("pos", "value"))


@query("pca")
def _(spark, d):
    return flat(rd.pca(rg.vectors(spark, d), 10))


@query("spectral_embed")
def _(spark, d):
    return flat(rd.neighbor_embed(rg.vectors(spark, d), 5, 15))


@query("approximate_neighbors")
def _(spark, d):
    return approximate_knn(rg.vectors(spark, d), 10)


@query("kmeans")
def _(spark, d):
    return cl.kmeans(rg.vectors(spark, d), 50)


@query("agglomerative")
def _(spark, d):
    return cl.agglomerative(rg.vectors(spark, d), 50)


@query("density_clusters")
def _(spark, d):
    return cl.density_clusters(rg.vectors(spark, d), 10, 5)


@query("reduce_topics")
def _(spark, d):
    return hi.reduce_topics(rg.centroids(spark, d), 4)


@query("topic_hierarchy")
def _(spark, d):
    return hi.topic_hierarchy(rg.centroids(spark, d)).select("parent", "left", "right", "distance")


@query("topic_map")
def _(spark, d):
    vectors = rg.vectors(spark, d)
    return ch.topic_map(rg.centroids(spark, d), ct.topic_sizes(vectors))


@query("document_map")
def _(spark, d):
    vectors = rg.vectors(spark, d)
    return ch.document_map(vectors, vectors.select("doc_id", "topic"))


def fitted(spark, d):
    docs = rg.documents(spark, d).select("doc_id", "document")
    return fit_topics(docs, TopicJobConfig(clustering="kmeans", n_clusters=12, nr_representative_docs=3, nr_docs=3))


@query("fit_topics")
def _(spark, d):
    return fitted(spark, d).docs


# LDA --------------------------------------------------------------------------------


def corpus(spark, d):
    """Prepared word counts; ``split`` marks the parts."""
    docs = rg.documents(spark, d).select("doc_id", "document")
    return split_corpus(ct.preprocess_corpus(docs, rg.STOP, min_chars=2, min_df=5, max_df=0.5))


TFIDF = lda.LdaSettings(num_topics=6, random_state=42, min_iterations=10)
WHOLE = TFIDF.partitioning(False)


@query("lda_train")
def _(spark, d):
    return lda.train_lda(corpus(spark, d), TFIDF).top_words


@query("lda_topic_word")
def _(spark, d):
    return lda.train_lda(corpus(spark, d), WHOLE).topic_words


@query("lda_top_words")
def _(spark, d):
    return lda.train_lda(corpus(spark, d), lda.LdaSettings(num_topics=6, random_state=42, min_iterations=10, top_words=50)).top_words


@query("lda_doc_topics")
def _(spark, d):
    return lda.train_lda(corpus(spark, d), WHOLE).doc_topics


@query("lda_test_topics")
def _(spark, d):
    return lda.train_lda(corpus(spark, d), TFIDF).test_doc_topics


@query("lda_update")
def _(spark, d):
    settings = replace(TFIDF, optimizer="variational").partitioning(True, update_with_test=True)
    return lda.train_lda(corpus(spark, d), settings).test_top_words


def counts_model(counts, k):
    settings = lda.LdaSettings(
        num_topics=k, random_state=42, weighting="counts", update_every=0, use_partitions=False, min_iterations=10, top_words=20
    )
    return lda.train_lda(counts, settings)


@query("lda_counts")
def _(spark, d):
    counts = cut_lineage(corpus(spark, d))
    eight = counts_model(counts, 8).top_words.select(F.lit(8).alias("k"), "topic", "rank", "word", "beta")
    three = counts_model(counts, 3).top_words.select(F.lit(3).alias("k"), "topic", "rank", "word", "beta")
    return eight.unionByName(three)


@query("lda_em")
def _(spark, d):
    settings = lda.LdaSettings(
        num_topics=2, random_state=42, optimizer="em", weighting="counts", use_partitions=False, min_iterations=10, top_words=15
    )
    return lda.train_lda(corpus(spark, d), settings).top_words


@query("lda_gibbs")
def _(spark, d):
    """Two and three topics by sampling."""
    counts = cut_lineage(corpus(spark, d))
    out = []
    for k in (2, 3):
        settings = lda.LdaSettings(
            num_topics=k, random_state=42, optimizer="gibbs", weighting="counts", use_partitions=False, min_iterations=20, top_words=15
        )
        out.append(lda.train_lda(counts, settings).top_words.select(F.lit(k).alias("k"), "topic", "rank", "word", "beta"))
    return out[0].unionByName(out[1])


@query("lda_perplexity")
def _(spark, d):
    return lda.train_lda(corpus(spark, d), replace(WHOLE, optimizer="variational", eval_every=5)).evaluations


@query("lda_auto_priors")
def _(spark, d):
    settings = replace(WHOLE, optimizer="variational", alpha="auto", eta="auto", iterations=100, gamma_threshold=1e-4)
    return lda.train_lda(corpus(spark, d), settings).top_words


@query("word_cloud_weights")
def _(spark, d):
    return ch.word_cloud_weights(counts_model(corpus(spark, d), 8).top_words)
