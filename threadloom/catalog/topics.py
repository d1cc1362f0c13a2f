"""Words, documents and tables that describe topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.catalog import registry as rg
from threadloom.catalog.registry import REPS, SCORES, TFIDF, query, r6
from threadloom.functions import text as tx
from threadloom.operators import charts as ch
from threadloom.operators import counting as ct
from threadloom.operators import evaluation as ev
from threadloom.operators import ranking as rk
from threadloom.operators import representation as rp
from threadloom.operators import weighting as wt
from threadloom.session import cut_lineage


@query("topic_top_words", f"WITH {SCORES} SELECT topic, rank, word, {r6('score')} AS score FROM ranked WHERE rank <= 10")
def _(spark, d):
    return rg.top_ten(spark, d)


@query("ctfidf", f"WITH {SCORES} SELECT topic, word, n, {r6('score')} AS score FROM scores")
def _(spark, d):
    return rg.scores(spark, d)


@query(
    "ctfidf_plain",
    f"""WITH {rg.CLASS_COUNTS} SELECT topic, word, n, {r6('n / n_topic * ln(1 + a / f)')} AS score
    FROM counts JOIN sizes USING (topic) JOIN totals USING (word), mean""",
)
def _(spark, d):
    return wt.ctfidf(rg.class_counts(spark, d), reduce_frequent_words=False)


@query("tfidf", f"WITH {TFIDF} SELECT doc_id, word, {r6('weight')} AS weight FROM tfidf")
def _(spark, d):
    return wt.tfidf(rg.doc_counts(spark, d))


@query(
    "top_n_ties",
    f"""WITH {rg.CLASS_COUNTS} SELECT topic, word, n, rank FROM (
        SELECT topic, word, n, rank() OVER (PARTITION BY topic ORDER BY n DESC) AS rank FROM counts
    ) WHERE rank <= 15""",
)
def _(spark, d):
    return rk.top_n_ties(rg.class_counts(spark, d), 15, score="n")


@query(
    "relabel_topics",
    """WITH t AS (SELECT vec_id AS doc_id, label - 1 AS old FROM embeddings),
    m AS (SELECT old, row_number() OVER (ORDER BY count(*) DESC, old) - 1 AS topic FROM t WHERE old >= 0 GROUP BY old)
    SELECT doc_id, coalesce(topic, -1)::BIGINT AS topic FROM t LEFT JOIN m USING (old)""",
)
def _(spark, d):
    docs = rg.vectors(spark, d).select("doc_id", (F.col("topic") - 1).alias("topic"))
    return rk.relabel_topics(docs)[0].select("doc_id", "topic")


@query(
    "representative_docs",
    f"WITH {REPS} SELECT topic, rank, doc_id, {r6('similarity')} AS similarity FROM reps WHERE rank <= 3",
)
def _(spark, d):
    return rg.representative(spark, d).select("topic", "rank", "doc_id", "similarity")


@query(
    "term_rank",
    f"WITH {SCORES} SELECT topic, rank, word, {r6('score')} AS score, {r6('log10(score)')} AS log_score FROM ranked WHERE rank <= 10",
)
def _(spark, d):
    return rk.term_rank(rg.top_ten(spark, d))


UNIQUE = f"""WITH {SCORES}, top AS (SELECT topic, word FROM ranked WHERE rank <= 10),
    spread AS (SELECT word, count(*) - 1 AS others FROM top GROUP BY ALL),
    t AS (SELECT count(DISTINCT topic) AS t FROM top)"""


@query("unique_words", f"{UNIQUE} SELECT topic, word FROM top WHERE word IN (SELECT word FROM spread WHERE others = 0)")
def _(spark, d):
    return rk.unique_words(cut_lineage(rg.top_ten(spark, d)))


@query(
    "unique_words_threshold",
    f"{UNIQUE} SELECT topic, word FROM top WHERE word IN (SELECT word FROM spread, t WHERE others <= floor(0.2 * t))",
)
def _(spark, d):
    return rk.unique_words_threshold(cut_lineage(rg.top_ten(spark, d)), 0.2)


# Topic tables -------------------------------------------------------------------

INFO = f"""WITH {REPS},
    size_of AS (SELECT source AS topic, count(*) AS count FROM documents GROUP BY ALL),
    names AS (SELECT topic, topic || '_' || string_agg(word, '_' ORDER BY rank) AS name FROM ranked WHERE rank <= 4 GROUP BY topic),
    lists AS (SELECT topic, list(word ORDER BY rank) AS w FROM ranked WHERE rank <= 10 GROUP BY ALL),
    texts AS (SELECT topic, list(md5(text) ORDER BY rank) AS docs FROM reps JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY ALL)"""


def topic_info(spark, d):
    sizes = ct.topic_sizes(rg.read_table(spark, d, "documents"), "source")
    return rp.topic_info(sizes, *rg.words_and_docs(spark, d))


@query(
    "topic_info",
    f"""{INFO} SELECT topic, count, name, array_to_string(w, ' ') AS words, docs[1] AS doc_0, docs[2] AS doc_1, docs[3] AS doc_2
    FROM size_of JOIN names USING (topic) JOIN lists USING (topic) JOIN texts USING (topic)""",
)
def _(spark, d):
    docs = [F.md5(f"doc_{i}").alias(f"doc_{i}") for i in range(3)]
    return topic_info(spark, d).select("topic", "count", "name", F.array_join("words", " ").alias("words"), *docs)


@query(
    "intermediate_results",
    f"""{INFO} SELECT topic, count, '["' || array_to_string(w, '","') || '"]' AS ctfidf_words, docs[1] AS doc_0, docs[2] AS doc_1, docs[3] AS doc_2
    FROM size_of JOIN lists USING (topic) JOIN texts USING (topic)""",
)
def _(spark, d):
    sizes = ct.topic_sizes(rg.read_table(spark, d, "documents"), "source")
    table = rp.intermediate_results(sizes, *rg.words_and_docs(spark, d))
    docs = [F.md5(f"doc_{i}").alias(f"doc_{i}") for i in range(3)]
    return table.select("topic", "count", "ctfidf_words", *docs)


@query(
    "topic_markdown",
    f"""WITH {SCORES}, names AS (SELECT topic, topic || '_' || string_agg(word, '_' ORDER BY rank) AS name FROM ranked WHERE rank <= 4 GROUP BY topic)
    SELECT topic, '## Topic ' || topic || chr(10) || chr(10) || name || chr(10) || chr(10) AS markdown FROM names""",
)
def _(spark, d):
    return rp.topic_markdown(rp.topic_names(rg.top_ten(spark, d)))


@query(
    "representation_chain",
    f"""WITH {SCORES}, listed AS (SELECT * FROM ranked WHERE rank <= 30),
    spread AS (SELECT word, count(*) AS t FROM listed GROUP BY ALL),
    exclusive AS (
        SELECT topic, word, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS rank
        FROM listed JOIN spread USING (word) WHERE t = 1
    ),
    long AS (
        SELECT topic, word, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS rank
        FROM listed WHERE length(word) >= 5
    )
    SELECT 'Main' AS aspect, topic, rank, word, {r6('score')} AS score FROM listed WHERE rank <= 10
    UNION ALL SELECT 'exclusive', topic, rank, word, {r6('score')} FROM exclusive
    UNION ALL SELECT 'long', topic, rank, word, {r6('score')} FROM long WHERE rank <= 5""",
)
def _(spark, d):
    base = cut_lineage(rk.base_words(rg.scores(spark, d)))

    def exclusive(words):
        kept = words.join(rk.unique_words(words), ["topic", "word"], "left_semi")
        return rk.top_words(kept, 30)

    def long_words(words):
        return words.filter(F.char_length("word") >= 5)

    return rp.representation_chain(
        base, {"exclusive": exclusive, "long": [long_words, lambda w: rk.top_words(w, 5)]}
    )


@query(
    "keyword_rerank",
    f"""WITH {rg.TFIDF}, counts AS {SCORES.split('counts AS', 1)[1]}, {rg.VECTORS.strip()},
    cand AS (SELECT topic, word FROM ranked WHERE rank <= 30),
    docvec AS (SELECT vec_id AS doc_id, source AS topic, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON vec_id = doc_id),
    tcell AS (SELECT topic, i, avg(x) AS x FROM (SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM docvec) GROUP BY ALL),
    tvec AS (SELECT topic, list(x ORDER BY i) AS tv FROM tcell GROUP BY ALL),
    holders AS (SELECT DISTINCT word, doc_id FROM kept WHERE word IN (SELECT word FROM cand)),
    wcell AS (SELECT word, i, avg(x) AS x FROM (SELECT word, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM holders JOIN docvec USING (doc_id)) GROUP BY ALL),
    wvec AS (SELECT word, list(x ORDER BY i) AS wv FROM wcell GROUP BY ALL),
    scored AS (SELECT topic, word, round({rg.cosine_sql('wv', 'tv')}, 9) AS score FROM cand JOIN wvec USING (word) JOIN tvec USING (topic)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS rank FROM scored)
    SELECT topic, rank, word, {r6('score')} AS score FROM placed WHERE rank <= 10""",
)
def _(spark, d):
    candidates = cut_lineage(rk.base_words(rg.scores(spark, d)))
    embeddings = rg.vectors(spark, d).select("doc_id", "embedding")
    topics = rg.documents(spark, d).select("doc_id", "topic").join(embeddings, "doc_id")
    words = rp.word_mean_vectors(candidates, rg.topic_tokens(spark, d), embeddings)
    return rp.keyword_rerank(candidates, words, ct.mean_vectors(topics), 10)


def mmr_sql(n: int, share: float) -> str:
    """Each pick is compared with all documents of its topic that are left."""
    steps = """,
    units AS (SELECT topic, doc_id, word, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS u FROM doc_weights),
    left1 AS (SELECT topic, doc_id, similarity, NULL::DOUBLE AS worst, similarity AS value FROM sims)"""
    for k in range(1, n + 1):
        steps += f""",
    pick{k} AS (
        SELECT topic, doc_id, similarity FROM left{k}
        QUALIFY row_number() OVER (PARTITION BY topic ORDER BY value DESC, doc_id) = 1
    ),
    bag{k} AS (SELECT topic, word, u AS pu FROM units JOIN pick{k} USING (topic, doc_id)),
    near{k} AS (SELECT topic, doc_id, sum(u * pu) AS near FROM units JOIN bag{k} USING (topic, word) GROUP BY ALL),
    seen{k} AS (
        SELECT l.topic, l.doc_id, l.similarity, greatest(l.worst, coalesce(near, 0)) AS worst
        FROM left{k} l ANTI JOIN pick{k} p ON l.doc_id = p.doc_id
        LEFT JOIN near{k} USING (topic, doc_id)
    ),
    left{k + 1} AS (SELECT *, round({1 - share} * similarity - {share} * worst, 9) AS value FROM seen{k})"""
    picks = " UNION ALL ".join(f"SELECT topic, {k}::BIGINT AS rank, doc_id, {r6('similarity')} AS similarity FROM pick{k}" for k in range(1, n + 1))
    return f"WITH {REPS}{steps} {picks}"


@query("mmr_docs", mmr_sql(5, 0.1))
def _(spark, d):
    per_doc, counts = rg.counted(spark, d)
    similarity = cut_lineage(rk.doc_topic_cosine(per_doc, counts, wt.ctfidf(counts)))
    return rp.mmr_docs(wt.ctfidf_of_documents(per_doc, counts), similarity, 5, 0.1)


# Scores of word lists --------------------------------------------------------------


@query(
    "topic_diversity",
    f"WITH {SCORES} SELECT {r6('count(DISTINCT word) / (count(DISTINCT topic) * 10)')} AS diversity FROM ranked WHERE rank <= 10",
)
def _(spark, d):
    return ev.topic_diversity(rg.top_ten(spark, d))


WINDOWS = """
    words AS (SELECT DISTINCT word FROM top),
    texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents),
    placed AS (SELECT doc_id, len(w) AS l, unnest(w) AS word, unnest(range(len(w))) AS pos FROM texts),
    marked AS (SELECT * FROM placed WHERE word IN (FROM words)),
    started AS (
        SELECT DISTINCT doc_id, word, unnest(range(greatest(pos - 9, 0), least(pos, greatest(l - 10, 0)) + 1)) AS start FROM marked
    ),
    p1 AS (SELECT word, count(*) AS n FROM started GROUP BY ALL),
    p12 AS (
        SELECT a.word AS w1, b.word AS w2, count(*) AS n FROM started a JOIN started b
        ON a.doc_id = b.doc_id AND a.start = b.start AND a.word < b.word GROUP BY ALL
    ),
    total AS (SELECT sum(greatest(len(w) - 9, 1)) AS t FROM texts)"""


def token_arrays(spark, d):
    return rg.documents(spark, d).select("doc_id", tx.vectorizer_tokens(F.col("document")).alias("tokens"))


FREQUENT = f"""WITH {rg.KEPT}, top AS (SELECT word FROM kept GROUP BY ALL HAVING count(*) > 1000)"""


@query("cooccurrence", f"{FREQUENT}, {WINDOWS.strip()} SELECT w1, w2, n FROM p12")
def _(spark, d):
    return ev.cooccurrence(token_arrays(spark, d), ct.word_counts(rg.topic_tokens(spark, d), low=1000))


@query(
    "topic_coherence",
    f"""WITH {SCORES}, top AS (SELECT topic, word FROM ranked WHERE rank <= 10), {WINDOWS.strip()},
    pairs AS (SELECT a.topic, a.word AS w1, b.word AS w2 FROM top a JOIN top b ON a.topic = b.topic AND a.word < b.word),
    probs AS (
        SELECT topic, coalesce(p12.n, 0) / t AS p12, x.n / t AS pa, y.n / t AS pb
        FROM pairs LEFT JOIN p12 USING (w1, w2) LEFT JOIN p1 x ON x.word = w1 LEFT JOIN p1 y ON y.word = w2, total
    )
    SELECT topic, {r6('avg(coalesce(ln((p12 + 1e-12) / (pa * pb)) / -ln(p12 + 1e-12), 0))')} AS coherence FROM probs GROUP BY ALL""",
)
def _(spark, d):
    return ev.topic_coherence(token_arrays(spark, d), rg.top_ten(spark, d))


# Chart data -----------------------------------------------------------------------------


@query(
    "topic_barchart",
    f"""WITH {SCORES} SELECT topic, rank, word, {r6('score')} AS score,
        row_number() OVER (PARTITION BY topic ORDER BY score, word DESC) AS ordinal FROM ranked WHERE rank <= 8""",
)
def _(spark, d):
    return ch.topic_barchart(rg.scores(spark, d))


@query(
    "topic_similarity",
    f"""WITH {SCORES}, len AS (SELECT topic, sqrt(sum(score * score)) AS l FROM scores GROUP BY ALL)
    SELECT a.topic AS "left", b.topic AS "right", {r6('sum(a.score * b.score) / (any_value(x.l) * any_value(y.l))')} AS similarity
    FROM scores a JOIN scores b ON a.word = b.word AND a.topic < b.topic JOIN len x ON x.topic = a.topic JOIN len y ON y.topic = b.topic
    GROUP BY ALL""",
)
def _(spark, d):
    return ch.topic_similarity(cut_lineage(rg.scores(spark, d)))
