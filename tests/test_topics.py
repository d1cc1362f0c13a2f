import json
import os

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import Window
from pyspark.sql import functions as F

from fixtures import planted_vocabulary, tiny
from threadloom.functions import text as tx
from threadloom.operators import clustering as cl
from threadloom.operators import counting as ct
from threadloom.operators import labelling as lb
from threadloom.operators import em, lda
from threadloom.operators import ranking as rk
from threadloom.operators import representation as rp
from threadloom.operators import tokens as tk
from threadloom.operators import weighting as wt
from threadloom.plans.config import PRESETS, TopicJobConfig
from threadloom.plans.fit import TopicTables, chosen_model, fit_topics, topics_from_text
from threadloom.plans.job import lda_from_text, relabel_saved, run_topic_job
from threadloom.session import cut_lineage
from threadloom.streaming.assign import assign_topics


def test_answers_and_labels(spark):
    raw = [
        (0, '{"response":"Topic: a"}\nnot json\n\n{"response":" b"}', "Topic: a b", "a b"),
        (1, '{"message":{"role":"assistant","content":"none "}}', "none ", "none"),
        (2, '{"response":"x Topic: b Topic: c"}', "x Topic: b Topic: c", "b"),
        (3, '{"response":"The topic is: **d**\\n"}', "The topic is: **d**\n", "**d**"),
    ]
    df = spark.createDataFrame([(i, r) for i, r, _, _ in raw], "topic int, raw string")
    got = {r.topic: (r.response, r.label) for r in lb.parse_answers(df).collect()}
    assert got == {i: (a, b) for i, _, a, b in raw}
    strict = {r.topic: r.label for r in lb.parse_answers(df, strict=True).collect()}
    assert strict[3] == "The topic is: **d**"
    messages = df.select(tx.parse_ndjson_messages(F.col("raw")).alias("m")).collect()
    assert [len(r.m) for r in messages] == [0, 1, 0, 0]


def words_and_docs(spark):
    words = spark.createDataFrame([(0, 1, "care"), (0, 2, "home"), (1, 1, "memory")], "topic int, rank int, word string")
    docs = spark.createDataFrame([(0, 1, "first text"), (0, 2, "second text"), (1, 1, "third")], "topic int, rank int, document string")
    return words, docs


def test_prompts(spark):
    words, docs = words_and_docs(spark)
    got = {r.topic: r.prompt for r in lb.build_prompts(words, docs, "K=[KEYWORDS]|D=[DOCUMENTS]").collect()}
    assert got == {0: "K=care, home|D=- first text\n- second text\n", 1: "K=memory|D=- third\n"}
    assert {r.prompt for r in lb.build_prompts(words, docs, "plain").collect()} == {"plain"}
    short = {r.topic: r.prompt for r in lb.build_prompts(words, docs, "[DOCUMENTS]", 1, "whitespace").collect()}
    assert short[0] == "- first\n- second\n"


def test_chat_sends_each_document_once(spark):
    _, docs = words_and_docs(spark)
    rows = lb.chat_messages(docs).filter("topic = 0").orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 2, 3] and {r.role for r in rows} == {"user"}
    assert "- first text\n" in rows[1].content and "- second text\n" in rows[2].content

    def complete(transcript):
        assert transcript[-1]["role"] == "user"
        return f"Topic: {len(transcript)} messages"

    answers = lb.parse_answers(lb.ask_model_chat(lb.chat_messages(docs), complete), ndjson=False)
    assert {r.topic: r.label for r in answers.collect()} == {0: "7 messages", 1: "5 messages"}


def test_summary_messages(spark):
    chunks = spark.createDataFrame([(0, "a b"), (1, "c")], "chunk bigint, chunk_text string")
    rows = lb.summary_messages(chunks).orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 2, 3] and rows[2].content.endswith("chunk: c")


def test_summary_of_many_chunks(spark):
    chunks = spark.range(8).select(F.col("id").alias("chunk"), F.col("id").cast("string").alias("chunk_text"))
    rows = lb.summary_messages(chunks, per_chat=3).collect()
    assert sorted((r.chat, r.seq) for r in rows) == [(0, i) for i in range(5)] + [(1, i) for i in range(5)] + [(2, i) for i in range(4)]

    def complete(transcript):
        said = [m["content"] for m in transcript if m["role"] == "user" and "chunk: " in m["content"]]
        return " ".join(c.rsplit("chunk: ", 1)[1] for c in said)

    assert [r.summary for r in lb.summarize_chunks(chunks, complete, per_chat=3).collect()] == ["0 1 2 3 4 5 6 7"]
    assert lb.summarize_chunks(chunks.filter("chunk < 0"), complete).count() == 0


def test_representation_chain(spark):
    base = spark.createDataFrame(
        [(0, i + 1, w, 1.0 - i / 10) for i, w in enumerate("abcd")], "topic int, rank int, word string, score double"
    )
    assert rp.representation_chain(base, None, 2).count() == 2
    upper = lambda d: d.withColumn("word", F.upper("word"))
    first = lambda d: d.filter("rank = 1")
    assert [r.word for r in rp.representation_chain(base, [upper, first]).collect()] == ["A"]
    rows = rp.representation_chain(base, {"Main": None, "loud": upper}, 3).collect()
    assert sorted((r.aspect, r.word) for r in rows) == [("Main", "a"), ("Main", "b"), ("Main", "c")] + [("loud", w) for w in "ABCD"]
    for bad in ("text", {"Main": 5}, {"x": 1.5}):
        with pytest.raises(TypeError, match="unsupported type"):
            rp.representation_chain(base, bad)


@pytest.mark.parametrize("diversity", [0.0, 0.3, 1.2])
def test_mmr_against_a_plain_loop(spark, diversity):
    docs = tiny(spark).withColumn("topic", F.lit(0))
    tokens_of = lambda some: tk.tokenize(some, keep=("doc_id", "topic"))
    counts = ct.class_term_counts(tokens_of(docs))
    scores = wt.ctfidf(counts)
    candidates = rk.candidate_counts(docs, tokens_of)
    weights = wt.ctfidf_of_documents(candidates, counts)
    similarity = rk.doc_topic_cosine(candidates, counts, scores)
    got = [r.doc_id for r in rp.mmr_docs(weights, similarity, 4, diversity).orderBy("rank").collect()]
    bags = {}
    for r in weights.collect():
        bags.setdefault(r.doc_id, {})[r.word] = r.weight
    sim = {r.doc_id: r.similarity for r in similarity.collect()}

    def cosine(a, b):
        dot = sum(x * b.get(k, 0.0) for k, x in a.items())
        return dot / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    share, chosen = min(diversity, 1.0), []
    while len(chosen) < 4:
        def value(d):
            return sim[d] if not chosen else (1 - share) * sim[d] - share * max(cosine(bags[d], bags[c]) for c in chosen)
        chosen.append(min((d for d in sim if d not in chosen), key=lambda d: (-round(value(d), 9), d)))
    if share == 0:
        chosen = sorted(sim, key=lambda d: (-sim[d], d))[:4]
    assert got == chosen


def test_config_checks():
    for n in (0, -1):
        with pytest.raises(ValueError):
            TopicJobConfig(nr_representative_docs=n)
        with pytest.raises(ValueError):
            TopicJobConfig(nr_docs=n)
    for n in (1, 10, 20):
        assert TopicJobConfig(nr_docs=n).nr_docs == n
    assert TopicJobConfig(document_diversity=1.2).document_diversity == 1.0
    assert TopicJobConfig(document_diversity=-1).document_diversity == 0.0
    for bad in ({"reduction": "tsne"}, {"clustering": "x"}, {"representation_model": "y"}):
        with pytest.raises(ValueError):
            TopicJobConfig(**bad)
    with pytest.raises(ValueError, match="unknown options"):
        TopicJobConfig.from_mapping({"nope": 1})
    assert TopicJobConfig.from_mapping({"clustering": "kmeans", "nr_docs": 3}).nr_docs == 3
    assert len(PRESETS) == 6 and PRESETS["keyword_rerank"].keyword_rerank and PRESETS["plain"].min_topic_size == 10


@pytest.fixture(scope="module")
def planted(spark):
    rows = planted_vocabulary()
    return spark.createDataFrame(rows, "doc_id bigint, document string, truth int").repartition(4).persist()


SMALL = TopicJobConfig(
    reduction="none", clustering="kmeans", n_clusters=3, embedding_dims=32, nr_representative_docs=2, nr_docs=2, min_topic_size=20
)


@pytest.fixture(scope="module")
def fitted(planted):
    return fit_topics(planted, SMALL)


def test_fit_finds_the_planted_topics(planted, fitted):
    pairs = fitted.docs.join(planted.select("doc_id", "truth"), "doc_id").select("topic", "truth").distinct().collect()
    assert len(pairs) == 3
    words = fitted.topic_words.groupBy("topic").agg(F.countDistinct(F.substring("word", 1, 1)).alias("n")).collect()
    assert {r.n for r in words} == {1}
    info = fitted.topic_info.orderBy("topic").collect()
    assert [r["count"] for r in info] == [60, 60, 60] and info[0].name.startswith("0_")
    assert fitted.topic_info.columns == ["topic", "count", "name", "words", "doc_0", "doc_1"]
    assert all(len(r.words) == 10 for r in info)


def test_model_round_trip(spark, fitted, tmp_path):
    path = str(tmp_path / "model")
    assert TopicTables.load(spark, path) is None
    fitted.save(path)
    back = TopicTables.load(spark, path)
    assert sorted(map(str, back.topic_info.collect())) == sorted(map(str, fitted.topic_info.collect()))
    assert back.probabilities is None

    def complete(prompt):
        return json.dumps({"response": "Topic: " + prompt.split("keywords: ")[1].split(",")[0]})

    labels = relabel_saved(spark, path, str(tmp_path / "out"), complete, ndjson=True)
    first = {r.topic: r.word for r in fitted.ctfidf_words.filter("rank = 1").collect()}
    assert {r.topic: r.label for r in labels.collect()} == first
    assert spark.read.csv(str(tmp_path / "out/labels"), header=True).columns == ["topic", "label"]
    assert relabel_saved(spark, str(tmp_path / "none"), str(tmp_path / "out"), complete) is None


def test_fit_with_labels_zeroshot_and_fewer_topics(spark, planted, fitted):
    centres = fitted.topic_vectors
    vectors = cl.predict_topics  # the fitted centres serve as known labels
    assert vectors is not None
    labels = centres.filter("topic = 0").select(F.lit("known").alias("label"), "vector")
    cfg = SMALL.with_options(n_clusters=2, zeroshot_min_similarity=0.5, calculate_probabilities=True)
    out = fit_topics(planted, cfg, zeroshot=labels)
    assert out.docs.select("topic").distinct().count() == 3
    assert [r.label for r in out.labels.collect()] == ["known"]
    assert out.probabilities.count() == 180 * 3
    few = fit_topics(planted, SMALL.with_options(nr_topics=2), complete=lambda p: "Topic: x")
    assert {r.topic for r in few.docs.collect()} == {0, 1}
    assert {r.word for r in few.topic_words.collect()} == {"x"}


def test_representation_model_chooses_one_of_several():
    models = {"gpt4o": str.upper, "mistral-small": str.lower}
    assert chosen_model(PRESETS["model_labels"], models) is models["mistral-small"]
    assert chosen_model(PRESETS["plain"].with_options(representation_model="gpt4o"), models) is models["gpt4o"]
    assert chosen_model(PRESETS["plain"], models) is None and chosen_model(PRESETS["plain"], str.title) is str.title
    with pytest.raises(ValueError):
        chosen_model(PRESETS["model_labels"], {"gpt4o": str.upper})


def test_topic_job(spark, planted, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ["forum,thread_title,message_nr,post_message"] + [f"f{r.truth},t,{r.doc_id},{r.document}" for r in planted.collect()]
    (folder / "posts.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    out = str(tmp_path / "out")
    tables = run_topic_job(spark, str(folder), out, SMALL.with_options(save_embeddings=True, keyword_rerank=True))
    assert tables.docs.count() == 180
    assert spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(out + "/output").count() == 3
    assert spark.read.csv(out + "/intermediate", header=True).columns == ["topic", "count", "ctfidf_words", "doc_0", "doc_1"]
    assert spark.read.parquet(out + "/embeddings").count() == 180
    again = run_topic_job(spark, str(folder), str(tmp_path / "o2"), SMALL, embeddings_path=out + "/embeddings")
    assert not os.path.exists(tmp_path / "o2" / "embeddings") and again.docs.count() == 180
    empty = tmp_path / "empty"
    empty.mkdir()
    assert run_topic_job(spark, str(empty), out) is None


def test_topics_from_text(spark, planted, tmp_path):
    path = tmp_path / "docs.txt"
    path.write_text("".join(r.document + "\n" for r in planted.orderBy("doc_id").collect()), encoding="utf-8")
    info = topics_from_text(spark, str(path), SMALL.with_options(clustering="hdbscan", min_samples=5, levels=8))
    assert sum(r["count"] for r in info.collect()) == 180
    with pytest.raises(FileNotFoundError):
        topics_from_text(spark, str(tmp_path / "none.txt"))
    out = lda_from_text(spark, str(path), lda.LdaSettings(num_topics=3, random_state=1))
    assert out.topic_words.count() == 3 * 60
    with pytest.raises(FileNotFoundError):
        lda_from_text(spark, str(tmp_path / "none.txt"))


@pytest.mark.parametrize("optimizer,weighting", [("online", "tfidf"), ("online", "counts"), ("em", "counts"), ("variational", "tfidf"), ("variational", "counts")])
def test_lda_separates_vocabularies(planted, optimizer, weighting):
    counts = ct.doc_term_counts(tk.tokenize(planted))
    settings = lda.LdaSettings(num_topics=3, random_state=7, optimizer=optimizer, weighting=weighting, use_partitions=False, min_iterations=40)
    out = lda.train_lda(counts, settings, perplexity=True)
    sums = out.topic_words.groupBy("topic").agg(F.sum("beta").alias("s")).collect()
    assert len(sums) == 3 and all(abs(r.s - 1) < 1e-9 for r in sums)
    top = out.top_words.groupBy("topic").agg(F.collect_set(F.substring("word", 1, 1)).alias("v")).collect()
    assert sorted(r.v[0] for r in top) == ["a", "b", "c"] and all(len(r.v) == 1 for r in top)
    weights = out.doc_topics.groupBy("doc_id").agg(F.sum("weight").alias("s"))
    assert weights.count() == 180 and weights.filter("abs(s - 1) > 1e-6").count() == 0
    assert out.log_perplexity > 0


def test_lda_topic_words_do_not_sort_the_vocabulary_on_the_driver(planted, monkeypatch):
    asked, described = [], lda.LDAModel.describeTopics
    monkeypatch.setattr(lda.LDAModel, "describeTopics", lambda self, n=10: asked.append(n) or described(self, n))
    counts = ct.doc_term_counts(tk.tokenize(planted))
    out = lda.train_lda(counts, lda.LdaSettings(num_topics=3, random_state=7, use_partitions=False))
    found = {(r.topic, r.term_id): r.beta for r in out.topic_words.collect()}
    assert asked == [10]
    want = {(r.topic, t): w for r in described(out.model, 60).collect() for t, w in zip(r.termIndices, r.termWeights, strict=True)}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    named = {r.term_id: r.word for r in out.vocabulary.collect()}
    assert [named[i] for i in range(60)] == sorted(named.values())


def test_lda_documents_without_known_words_stay(spark):
    words = spark.createDataFrame([(0, "a"), (1, "b")], "term_id bigint, word string")
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "x", 3), (2, "x", 1), (3, "a", 0)], "doc_id bigint, word string, n bigint")
    found = {r.doc_id: r.counts.toArray().tolist() for r in lda.counted_vectors(rows, words, 2).collect()}
    assert found == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_lda_parts(planted):
    counts = rk.split_corpus(ct.doc_term_counts(tk.tokenize(planted)))
    settings = lda.LdaSettings(num_topics=3, random_state=7)
    out = lda.train_lda(counts, settings)
    n = {r.split: r.n for r in counts.groupBy("split").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert out.doc_topics.select("doc_id").distinct().count() == n["train"]
    assert out.test_doc_topics.select("doc_id").distinct().count() == n["test"]
    assert out.vocabulary.count() == 60
    updated = lda.train_lda(counts, settings.partitioning(True, update_with_test=True))
    assert updated.test_doc_topics.select("doc_id").distinct().count() == n["train"] + n["test"]
    assert updated.test_topic_words.count() == 180


@pytest.mark.parametrize("optimizer", ["online", "em", "variational"])
def test_saved_lda_gives_the_same_topics(spark, planted, tmp_path, optimizer):
    counts = ct.doc_term_counts(tk.tokenize(planted))
    out = lda.train_lda(counts, lda.LdaSettings(num_topics=3, random_state=7, optimizer=optimizer, use_partitions=False, min_iterations=5))
    path = str(tmp_path / "lda")
    lda.save_lda(out, path)
    more = counts.unionByName(counts.limit(1).withColumn("word", F.lit("never seen")))
    again = lda.infer_topics(*lda.load_lda(spark, path), more)
    one = {(r.doc_id, r.topic): r.weight for r in out.doc_topics.collect()}
    two = {(r.doc_id, r.topic): r.weight for r in again.collect()}
    # a loaded EM model starts its inference from other random numbers
    near = 0.02 if optimizer == "em" else 1e-9
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < near for k in one), max(abs(one[k] - two[k]) for k in one)
    assert lda.load_lda(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("weighting", ["counts", "tfidf"])
def test_em_without_a_graph_finds_what_mllib_finds(spark, planted, weighting, monkeypatch):
    """MLlib's EM kept and shuffled an edge for each word of each document."""
    counts = ct.doc_term_counts(tk.tokenize(planted))
    settings = lda.LdaSettings(num_topics=3, random_state=7, optimizer="em", weighting=weighting, use_partitions=False, min_iterations=6, top_words=9)
    tool = lda.Vectorizer(counts, counts, 3, weighting)
    features = tool.training(counts)
    want = settings.estimator(180).fit(features)
    monkeypatch.setattr(lda.LDA, "fit", lambda *a: pytest.fail("MLlib was asked"))
    monkeypatch.setattr(em, "STEP_CELLS", 500)
    out = lda.train_lda(counts, settings)
    cells = out.model.topicsMatrix().toArray()
    assert abs(cells - want.topicsMatrix().toArray()).max() < 1e-6
    best = {(r.topic, i): (t, b) for r in want.describeTopics(9).collect() for i, (t, b) in enumerate(zip(r.termIndices, r.termWeights, strict=True))}
    ids = {r.word: r.term_id for r in out.vocabulary.collect()}
    found = {(r.topic, r["rank"] - 1): (ids[r.word], r.beta) for r in out.top_words.collect()}
    assert found.keys() == best.keys() and all(abs(found[i][1] - best[i][1]) < 1e-9 for i in best)


def test_java_random():
    random = em.JavaRandom(42)
    random.STEPS = 4
    # java.util.Random(42).nextDouble()
    assert random.doubles(3).tolist() == [0.7275636800328681, 0.6832234717598454, 0.30871945533265976]
    assert random.doubles(1).tolist() == [0.27707849007413665]


def test_lda_settings():
    assert lda.LdaSettings(num_topics=2, alpha=0.1).concentration() == [0.1, 0.1]
    assert lda.LdaSettings(num_topics=2, alpha="asymmetric").concentration() == pytest.approx([2 / 3, 1 / 3])
    assert lda.LdaSettings(num_topics=2, alpha="auto").estimator(10).getOptimizeDocConcentration()
    assert lda.LdaSettings(num_topics=2, chunksize=10).estimator(100).getSubsamplingRate() == 0.1
    assert lda.LdaSettings(num_topics=2).estimator(10**9).getMaxIter() == 20
    assert lda.LdaSettings(num_topics=2, passes=3, update_every=0).estimator(10**9).getMaxIter() == 3
    for bad in ({"alpha": "odd"}, {"alpha": [0.1]}, {"eta": [[1.0]]}, {"num_topics": 1}):
        with pytest.raises(ValueError):
            lda.LdaSettings(**{"num_topics": 2, **bad}).estimator(10)


def test_stream_of_new_documents(spark, fitted, tmp_path):
    source = str(tmp_path / "in")
    rows = [(i, list(r.vector)) for i, r in enumerate(fitted.topic_vectors.orderBy("topic").collect())]
    new = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    new.write.parquet(source)
    stream = spark.readStream.schema(new.schema).parquet(source)
    query = assign_topics(stream, fitted.topic_vectors, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.topic) for r in got] == [(0, 0), (1, 1), (2, 2)]


def test_lda_training_vectors_need_no_python(planted):
    counts = ct.doc_term_counts(tk.tokenize(planted)).persist()
    tool = lda.Vectorizer(counts, counts, 3)
    seen = []
    cut, lda.cut_lineage = lda.cut_lineage, lambda df, *schema: seen.append(df._jdf.queryExecution().toString()) or cut(df, *schema)
    try:
        got = tool.training(counts).collect()
    finally:
        lda.cut_lineage = cut
    assert seen and not any("EvalPython" in p for p in seen)
    want = {r.doc_id: r for r in lda.vb.bags(counts, tool.vocabulary, tool.idf).collect()}
    assert len(got) == len(want) and [r.doc_id for r in got] == sorted(want)
    for r in got:
        assert r.features == SparseVector(tool.size, want[r.doc_id].terms, want[r.doc_id].amounts)


@pytest.mark.parametrize("most", [0, 1, 2, 4, 100])
def test_join_frequent_is_an_inner_join(spark, most):
    from threadloom.operators.joins import join_frequent

    rows = spark.createDataFrame([(i, w) for i in range(3) for w in ("a", "b", "c", "d", None)] + [(9, "a"), (9, "a")], "id int, word string")
    values = cut_lineage(spark.createDataFrame([("a", 1.0, 90), ("b", 2.0, 8), ("c", 3.0, None), ("e", 4.0, 0), (None, 5.0, 7)], "word string, v double, n bigint"))
    got = sorted(tuple(r) for r in join_frequent(rows, values, ["word"], "n", most).collect())
    assert got == sorted(tuple(r) for r in rows.join(values.drop("n"), "word").collect())


def test_words_of_documents_are_not_shuffled(spark):
    """Of the words of all documents only those that topics rarely use may be shuffled, none here."""
    rows = [("t", 10 * k + j, f"w{(k + j * j) % 13}", 1 + j % 3) for k in range(30) for j in range(9)]
    counts = spark.createDataFrame([(t, d // 10, w, n) for t, d, w, n in rows], "topic string, doc_id bigint, word string, n bigint")
    counts = counts.groupBy("topic", "doc_id", "word").agg(F.sum("n").alias("n"))
    full = cut_lineage(counts.withColumn("n_doc", F.sum("n").over(Window.partitionBy("doc_id"))))
    classes = cut_lineage(rk.class_counts_of(full))
    weights = wt.ctfidf_of_documents(full, classes)
    assert "Exchange hashpartitioning" not in weights._jdf.queryExecution().executedPlan().toString()
    old = wt.ctfidf_of_documents(full.drop("n_doc"), classes)
    assert {tuple(r) for r in weights.collect()} == {tuple(r) for r in old.collect()}
