"""Jobs and files: what is written to the shared folder is read back, or a job runs on it and its output is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadloom.catalog import registry as rg
from threadloom.catalog.labelling import first_keyword
from threadloom.catalog.models import WHOLE, corpus
from threadloom.catalog.registry import query
from threadloom.catalog.texts import CLEAN_SQL
from threadloom.catalog.topics import INFO, topic_info
from threadloom.operators import counting as ct
from threadloom.operators import labelling as lb
from threadloom.operators import lda
from threadloom.operators import ranking as rk
from threadloom.operators import representation as rp
from threadloom.operators.lda import LdaSettings
from threadloom.plans import job
from threadloom.plans.config import TopicJobConfig
from threadloom.plans.fit import TopicTables, topics_from_text
from threadloom.session import ensure_checkpoint_dir
from threadloom.sources import readers, writers

SMALL_JOB = TopicJobConfig(clustering="kmeans", n_clusters=12, nr_representative_docs=3, nr_docs=3)


def folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_back(spark, path, schema, sep=","):
    options = readers.CSV_OPTIONS | {"sep": sep}
    return spark.read.options(**options).schema(schema).csv(path)


def forum_folder(spark, d):
    path = folder(spark, "forum")
    writers.write_csv(rg.posts(spark, d), path)
    return path


@query(
    "read_forum",
    f"""SELECT row_number() OVER (ORDER BY role, conv_id::VARCHAR, turn) - 1 AS doc_id, md5({CLEAN_SQL}) AS document
    FROM (SELECT role, conv_id, turn, coalesce(text, '') AS text FROM conversations)""",
)
def _(spark, d):
    docs = readers.read_documents(spark, forum_folder(spark, d))
    return docs.select("doc_id", rg.digest("document").alias("document"))


@query("written_corpus", f"SELECT md5({CLEAN_SQL}) AS document, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    path = folder(spark, "corpus")
    writers.write_corpus(rg.documents(spark, d), path)
    return readers.read_text_documents(spark, path).groupBy(rg.digest("document").alias("document")).agg(F.count("*").alias("n"))


@query("written_sample", "SELECT doc_id, lang, source FROM documents ORDER BY md5('42-' || doc_id::VARCHAR), doc_id LIMIT 50")
def _(spark, d):
    path = folder(spark, "sample")
    writers.write_sample(rk.sample_exact(rg.read_table(spark, d, "documents").select("doc_id", "lang", "source"), 50), path, "\t")
    return read_back(spark, path, "doc_id bigint, lang string, source string", "\t")


JSON_LIST = "'[\"' || array_to_string(w, '\",\"') || '\"]'"


@query("written_topic_info", f"{INFO} SELECT topic, count, name, {JSON_LIST} AS words FROM size_of JOIN names USING (topic) JOIN lists USING (topic)")
def _(spark, d):
    path = folder(spark, "info")
    writers.write_topic_info(topic_info(spark, d).select("topic", "count", "name", "words"), path)
    return read_back(spark, path, "topic string, count bigint, name string, words string")


@query("written_intermediate", f"{INFO} SELECT topic, count, {JSON_LIST} AS ctfidf_words FROM size_of JOIN lists USING (topic)")
def _(spark, d):
    path = folder(spark, "intermediate")
    sizes = ct.topic_sizes(rg.read_table(spark, d, "documents"), "source")
    writers.write_intermediate(rp.intermediate_results(sizes, *rg.words_and_docs(spark, d)).select("topic", "count", "ctfidf_words"), path)
    return read_back(spark, path, "topic string, count bigint, ctfidf_words string")


LABELS_SQL = f"""WITH {rg.SCORES} SELECT topic, string_agg(word, ', ' ORDER BY rank) AS label FROM ranked WHERE rank <= 3 GROUP BY ALL"""


@query("written_labels", LABELS_SQL)
def _(spark, d):
    path = folder(spark, "labels")
    writers.write_labels(lb.label_topics(*rg.words_and_docs(spark, d), first_keyword), path)
    return read_back(spark, path, "topic string, label string")


@query("relabel_saved", LABELS_SQL)
def _(spark, d):
    """A stored model, read and labelled anew."""
    words, docs = rg.words_and_docs(spark, d)
    model, result = folder(spark, "model"), folder(spark, "relabelled")
    none = spark.createDataFrame([], "topic string, label string")
    sizes = ct.topic_sizes(rg.read_table(spark, d, "documents"), "source")
    centres = rg.centroids(spark, d)
    TopicTables(rg.vectors(spark, d).select("doc_id", "topic"), words, words, centres, docs, docs, sizes, none).save(model)
    job.relabel_saved(spark, model, result, first_keyword)
    return read_back(spark, f"{result}/labels", "topic string, label string")


@query("topic_job")
def _(spark, d):
    """The batch job over a folder of forum files; the topic table it wrote."""
    result = folder(spark, "job")
    job.run_topic_job(spark, forum_folder(spark, d), result, SMALL_JOB)
    return read_back(spark, f"{result}/output", "topic int, count bigint, name string, words string")


def text_files(spark, d):
    """The documents as text, one a line; every task writes its part, and the parts in order are the corpus."""
    path = folder(spark, "lines")
    writers.write_corpus(rg.documents(spark, d), path)
    return path


@query("topics_from_text")
def _(spark, d):
    info = topics_from_text(spark, text_files(spark, d), SMALL_JOB)
    return info.select("topic", "count", "name", F.array_join("words", " ").alias("words"))


@query("lda_from_text")
def _(spark, d):
    settings = LdaSettings(num_topics=4, random_state=42, min_iterations=5)
    return job.lda_from_text(spark, text_files(spark, d), settings, stop_words=rg.STOP, min_chars=2, min_df=5, max_df=0.5).top_words


@query("lda_saved")
def _(spark, d):
    """Topics of the test part from a model that was saved and loaded."""
    counts = corpus(spark, d)
    path = folder(spark, "lda")
    lda.save_lda(lda.train_lda(counts, WHOLE), path)
    return lda.infer_topics(*lda.load_lda(spark, path), counts.filter("split = 'test'"))
