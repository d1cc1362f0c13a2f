"""Cleaning, tokens, merges, counts, samples and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.catalog import registry as rg
from threadloom.catalog.registry import BLANK, DOC_COUNTS, KEPT, STOP, STOP_SQL, TOKENS, WORD, query, strip_sql
from threadloom.functions import text as tx
from threadloom.functions.words import PUNCTUATION, STOP_WORD_LANGUAGES, language_stop_words
from threadloom.operators import cleaning as cn
from threadloom.operators import counting as ct
from threadloom.operators import joins as jn
from threadloom.operators import merging as mg
from threadloom.operators import ranking as rk
from threadloom.operators import tokens as tk
from threadloom.operators.numbering import even_blocks, sorted_ids

CLEAN_SQL = "translate(" + strip_sql("text") + r", chr(10) || chr(9) || chr(13), '   ')"


@query("assign_doc_ids", "SELECT doc_id, row_number() OVER (ORDER BY source, lang, doc_id) - 1 AS new_id FROM documents")
def _(spark, d):
    docs = rg.documents(spark, d).select("topic", "lang", "doc_id")
    return sorted_ids(docs, ["topic", "lang", "doc_id"], "new_id").select("doc_id", "new_id")


@query("union_forums", "SELECT source AS forum, lang AS thread_title, doc_id AS message_nr, md5(text) AS post FROM documents")
def _(spark, d):
    docs = rg.read_table(spark, d, "documents").select(
        F.col("source").alias("forum"), F.col("lang").alias("thread_title"), F.col("doc_id").alias("message_nr"), rg.digest("text").alias("post")
    )
    languages = ("de", "en", "es", "fr")
    parts = [docs.filter(F.col("thread_title") == c) for c in languages]
    return jn.union_forums(*parts, docs.filter(~F.coalesce(F.col("thread_title").isin(*languages), F.lit(False))))


@query("clean_text", f"SELECT doc_id, md5({CLEAN_SQL}) AS cleaned, length({CLEAN_SQL}) AS n_chars FROM documents")
def _(spark, d):
    docs = cn.clean_documents(rg.documents(spark, d).select("doc_id", "document"))
    return docs.select("doc_id", rg.digest("document").alias("cleaned"), F.char_length("document").alias("n_chars"))


@query("first_posts", "SELECT role AS forum, conv_id AS thread_title, md5(text) AS post FROM conversations WHERE turn = 0")
def _(spark, d):
    return cn.first_posts(rg.posts(spark, d)).select("forum", "thread_title", rg.digest("post_message").alias("post"))


@query("drop_null_text", "SELECT doc_id, quality::BIGINT AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def _(spark, d):
    labels = rg.read_table(spark, d, "labels").select("doc_id", "quality")
    return cn.drop_null_text(rg.read_table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left"), "quality")


@query("combine_text", "SELECT doc_id, md5(concat_ws(' ', text, lang, source)) AS combined FROM documents")
def _(spark, d):
    docs = cn.combine_text(rg.read_table(spark, d, "documents"))
    return docs.select("doc_id", rg.digest("combined_text").alias("combined"))


NORMAL_SQL = r"regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')"


@query("normalize_text", f"SELECT doc_id, md5({NORMAL_SQL}) AS normal FROM documents")
def _(spark, d):
    return rg.documents(spark, d).select("doc_id", F.md5(tx.normalize_text(F.col("document"))).alias("normal"))


@query(
    "remove_digits",
    rf"""SELECT doc_id, md5(regexp_replace(array_to_string(list_filter(string_split({NORMAL_SQL}, ' '),
        lambda x: x <> '' AND NOT list_contains([{rg.quoted(STOP)}], x)), ' '), '\p{{Nd}}+', '', 'g')) AS text_md5 FROM documents""",
)
def _(spark, d):
    words = tx.drop_listed(tx.whitespace_tokens(tx.normalize_text(F.col("document"))), STOP)
    return rg.documents(spark, d).select(
        "doc_id", F.md5(tx.remove_digits(F.array_join(words, " "))).alias("text_md5")
    )


@query(
    "remove_punctuation",
    f"SELECT doc_id, md5(translate(text, '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', '{' ' * 32}')) AS text_md5 FROM documents",
)
def _(spark, d):
    return rg.documents(spark, d).select("doc_id", F.md5(tx.remove_punctuation(F.col("document"))).alias("text_md5"))


def plural_table(tokens):
    """``(form, lemma)``: a word ending in s and the same word without it, when both are in use."""
    words = tokens.select("word").distinct()
    forms = words.filter(F.col("word").endswith("s")).select(
        F.col("word").alias("form"), F.expr("substring(word, 1, char_length(word) - 1)").alias("lemma")
    )
    return forms.join(words.select(F.col("word").alias("lemma")), "lemma", "left_semi").select("form", "lemma")


@query(
    "lemmatize",
    f"""WITH {TOKENS}, vocab AS (SELECT DISTINCT word FROM tokens),
    lemmas AS (SELECT v.word AS form, b.word AS lemma FROM vocab v JOIN vocab b ON v.word = b.word || 's')
    SELECT coalesce(lemma, word) AS word, count(*) AS n FROM tokens LEFT JOIN lemmas ON word = form GROUP BY ALL""",
)
def _(spark, d):
    tokens = tk.tokenize(rg.documents(spark, d), position=False)
    return ct.word_counts(cn.lemmatize(tokens, plural_table(tokens)))


@query("token_min_chars", f"WITH {TOKENS} SELECT word, count(*) AS n FROM tokens WHERE length(word) >= 4 GROUP BY ALL")
def _(spark, d):
    return ct.word_counts(cn.token_min_chars(tk.tokenize(rg.documents(spark, d), position=False), 4))


@query(
    "min_words_docs",
    f"""WITH {DOC_COUNTS} SELECT doc_id, sum(n)::BIGINT AS words FROM dtm GROUP BY ALL HAVING sum(n) >= 20""",
)
def _(spark, d):
    return cn.min_words_docs(rg.doc_counts(spark, d), 20).groupBy("doc_id").agg(F.sum("n").alias("words"))


def language_sql() -> str:
    tests = " UNION ALL ".join(
        f"SELECT doc_id, '{code}' AS language, count(*) AS hits FROM tokens WHERE word IN ({rg.quoted(list(language_stop_words(name)))}) GROUP BY ALL"
        for code, name in sorted(STOP_WORD_LANGUAGES.items())
    )
    return f"""WITH {TOKENS}, votes AS ({tests}),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, language) AS r FROM votes)
    SELECT doc_id, hits AS language_hits FROM best WHERE r = 1 AND language = 'en'"""


@query("language_filter", language_sql())
def _(spark, d):
    return cn.language_filter(rg.documents(spark, d)).select("doc_id", "language_hits")


# the SQL engine measures edits in bytes; lower-cased words leave the capitals free to stand for accented letters
ONE_BYTE = "translate(word, 'áâäàçéèêëíîïñóôöœúùûüß', 'ABCDEFGHIJKLMNOPQRSTUV')"


@query(
    "spell_correct",
    f"""WITH {TOKENS}, counts AS (SELECT word, count(*) AS n FROM tokens GROUP BY ALL),
    dictionary AS (SELECT word, {ONE_BYTE} AS one, n FROM counts WHERE n > 100),
    unknown AS (SELECT word, {ONE_BYTE} AS one FROM counts WHERE n <= 100),
    pairs AS (
        SELECT u.word, c.word AS candidate, levenshtein(u.one, c.one) AS d, c.n
        FROM unknown u JOIN dictionary c ON abs(length(u.word) - length(c.word)) <= 2
        WHERE levenshtein(u.one, c.one) <= 2
    ),
    best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, n DESC, candidate) AS r FROM pairs),
    fixes AS (SELECT word, candidate FROM best WHERE r = 1)
    SELECT coalesce(candidate, counts.word) AS word, sum(counts.n)::BIGINT AS n
    FROM counts LEFT JOIN fixes ON counts.word = fixes.word GROUP BY 1""",
)
def _(spark, d):
    # the words are replaced in the counted vocabulary: one row per word instead of one per token
    counts = ct.word_counts(tk.tokenize(rg.documents(spark, d), position=False))
    fixes = cn.spelling_table(counts.select("word"), counts.filter("n > 100"), 2)
    return cn.spell_correct(counts, fixes).groupBy("word").agg(F.sum("n").alias("n"))


SPLIT_SQL = rf"list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda x: x <> '')"


@query(
    "truncate_docs",
    rf"""SELECT doc_id, md5(substr(text, 1, 200)) AS by_char,
        md5(array_to_string(list_slice({SPLIT_SQL}, 1, 30), ' ')) AS by_blank,
        md5(array_to_string(list_slice(regexp_extract_all(lower(text), '{WORD}{{2,}}'), 1, 30), ' ')) AS by_token
    FROM documents""",
)
def _(spark, d):
    text = F.col("document")
    return rg.documents(spark, d).select(
        "doc_id",
        F.md5(tx.truncate_text(text, 200, "char")).alias("by_char"),
        F.md5(tx.truncate_text(text, 30, "whitespace")).alias("by_blank"),
        F.md5(tx.truncate_text(text, 30, "vectorizer")).alias("by_token"),
    )


@query("max_doc_length", "SELECT max(length(text)) AS max_length FROM documents")
def _(spark, d):
    return cn.longest_document(rg.documents(spark, d))


# Joins ----------------------------------------------------------------------


@query("stopword_anti_join", f"WITH {KEPT} SELECT topic, word, count(*) AS n FROM kept GROUP BY ALL")
def _(spark, d):
    tokens = tk.tokenize(rg.documents(spark, d), keep=("doc_id", "topic"), position=False)
    return ct.class_term_counts(jn.stopword_anti_join(tokens, jn.stop_table(tokens, STOP)))


BAND = """band AS (SELECT word FROM kept GROUP BY ALL HAVING count(*) > 2 AND count(*) < 5000)"""


@query(
    "vocab_semi_join",
    f"WITH {KEPT}, {BAND} SELECT doc_id, word, count(*) AS n FROM kept WHERE word IN (FROM band) GROUP BY ALL",
)
def _(spark, d):
    tokens = rg.topic_tokens(spark, d)
    return ct.doc_term_counts(jn.vocab_semi_join(tokens, ct.word_counts(tokens, 2, 5000)))


DICTIONARY = """dictionary AS (
        SELECT word, row_number() OVER (ORDER BY substr(md5(word), 1, 4), word) - 1 AS term_id FROM (SELECT DISTINCT word FROM kept)
    )"""


@query(
    "id2word_join",
    f"WITH {DOC_COUNTS}, {DICTIONARY} SELECT doc_id, term_id, word, n FROM dtm JOIN dictionary USING (word)",
)
def _(spark, d):
    counts = rg.doc_counts(spark, d)
    dictionary = ct.build_dictionary(counts)
    ids = counts.join(dictionary, "word").select("doc_id", "term_id", "n")
    return jn.attach_words(ids, dictionary)


@query("docs_with_embeddings", "SELECT doc_id, length(text) AS n_chars, len(embedding) AS dims FROM documents JOIN embeddings ON doc_id = vec_id")
def _(spark, d):
    docs = jn.docs_with_embeddings(rg.documents(spark, d), rg.vectors(spark, d))
    return docs.select("doc_id", F.char_length("document").alias("n_chars"), F.size("embedding").alias("dims"))


# Merges and counts -----------------------------------------------------------


def merged_sql(forum: str, keys: str, part_chars: int) -> str:
    """Merged texts; a text starts a new part after ``part_chars`` characters, each row counted as one more."""
    return f"""WITH rows AS (SELECT {forum} AS forum, conv_id AS thread_title, turn // 4 AS message_nr, turn, text FROM conversations),
    placed AS (
        SELECT *, coalesce(sum(length(text) + 1) OVER (
            PARTITION BY {keys} ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {part_chars} AS part
        FROM rows
    )
    SELECT {keys}, part, string_agg(text, '' ORDER BY turn) AS post_message FROM placed GROUP BY ALL"""


def fragments(spark, d, forum):
    rows = rg.read_table(spark, d, "conversations").select(
        forum.alias("forum"),
        F.col("conv_id").alias("thread_title"),
        F.floor(F.col("turn") / 4).alias("message_nr"),
        "turn",
        F.col("text").alias("post_message"),
    )
    return even_blocks(rows, "turn")


@query("merge_posts", merged_sql("role", "forum, thread_title, message_nr", mg.PART_CHARS))
def _(spark, d):
    return mg.merge_posts(fragments(spark, d, F.col("role")), ["turn"], F.col("_even"))


@query("merge_posts_in_parts", merged_sql("role", "forum, thread_title, message_nr", 300))
def _(spark, d):
    return mg.merge_posts(fragments(spark, d, F.col("role")), ["turn"], F.col("_even"), part_chars=300)


@query("merge_threads", merged_sql("'chat'", "forum, thread_title", mg.PART_CHARS))
def _(spark, d):
    return mg.merge_threads(fragments(spark, d, F.lit("chat")), order=["turn"], block=F.col("_even"))


@query("merge_threads_in_parts", merged_sql("'chat'", "forum, thread_title", 500))
def _(spark, d):
    return mg.merge_threads(fragments(spark, d, F.lit("chat")), order=["turn"], block=F.col("_even"), part_chars=500)


@query(
    "concat_corpus",
    """WITH whole AS (SELECT string_agg(text, ' ' ORDER BY doc_id) AS t FROM documents),
    parts AS (SELECT t, unnest(range(0, length(t), 100000)) AS s FROM whole)
    SELECT s // 100000 AS part, md5(substr(t, s + 1, 100000)) AS piece, length(substr(t, s + 1, 100000)) AS n_chars FROM parts""",
)
def _(spark, d):
    parts = mg.concat_corpus(even_blocks(rg.documents(spark, d), "doc_id"), ["doc_id"], F.col("_even"), "document", part_chars=100_000)
    return parts.select("part", rg.digest("text").alias("piece"), F.char_length("text").alias("n_chars"))


@query("word_counts", f"WITH {KEPT} SELECT word, count(*) AS n FROM kept GROUP BY ALL")
def _(spark, d):
    return ct.word_counts(rg.topic_tokens(spark, d))


@query("word_counts_min", f"WITH {KEPT} SELECT word, count(*) AS n FROM kept GROUP BY ALL HAVING count(*) > 1000")
def _(spark, d):
    return ct.word_counts(rg.topic_tokens(spark, d), low=1000)


@query("vocab_band", f"WITH {KEPT} SELECT word, count(*) AS n FROM kept GROUP BY ALL HAVING count(*) > 2 AND count(*) < 5000")
def _(spark, d):
    return ct.word_counts(rg.topic_tokens(spark, d), 2, 5000)


@query("doc_term_counts", f"WITH {DOC_COUNTS} SELECT doc_id, word, n FROM dtm")
def _(spark, d):
    return rg.doc_counts(spark, d)


@query(
    "df_prune",
    f"""WITH {DOC_COUNTS}, df AS (SELECT word, count(*) AS df FROM dtm GROUP BY ALL), total AS (SELECT count(DISTINCT doc_id) AS n FROM dtm)
    SELECT 'count' AS rule, word, df FROM df, total WHERE df >= 2 AND df <= floor(0.9 * n)
    UNION ALL SELECT 'share' AS rule, word, df FROM df, total WHERE df >= ceil(0.01 * n) AND df <= floor(0.5 * n)""",
)
def _(spark, d):
    counts = rg.doc_counts(spark, d)
    by_count = ct.df_prune(counts, 2, 0.9).select(F.lit("count").alias("rule"), "word", "df")
    by_share = ct.df_prune(counts, 0.01, 0.5).select(F.lit("share").alias("rule"), "word", "df")
    return by_count.unionByName(by_share)


@query("topic_sizes", "SELECT source AS topic, count(*) AS count FROM documents GROUP BY ALL")
def _(spark, d):
    return ct.topic_sizes(rg.read_table(spark, d, "documents"), "source")


@query("topic_labels", "SELECT DISTINCT source AS topic FROM documents")
def _(spark, d):
    return ct.topic_labels(rg.read_table(spark, d, "documents"), "source")


@query("class_term_counts", f"WITH {rg.CLASS_COUNTS} SELECT topic, word, n FROM counts")
def _(spark, d):
    return rg.class_counts(spark, d)


@query("build_dictionary", f"WITH {KEPT}, {DICTIONARY} SELECT term_id, word FROM dictionary")
def _(spark, d):
    return ct.build_dictionary(rg.topic_tokens(spark, d)).select("term_id", "word")


@query(
    "matrix_shape",
    f"WITH {DOC_COUNTS} SELECT count(DISTINCT doc_id) AS n_docs, count(DISTINCT word) AS n_words, count(*) AS n_cells FROM dtm",
)
def _(spark, d):
    return ct.matrix_shape(rg.doc_counts(spark, d))


# Rankings, samples, sets -------------------------------------------------------


@query(
    "ordinal_by_count",
    f"WITH {KEPT} SELECT word, count(*) AS n, row_number() OVER (ORDER BY count(*), word) AS ordinal FROM kept GROUP BY word",
)
def _(spark, d):
    return rk.ordinal_by_count(ct.word_counts(rg.topic_tokens(spark, d)))


@query("top_words_head", f"WITH {KEPT} SELECT word, count(*) AS n FROM kept GROUP BY ALL ORDER BY n DESC, word LIMIT 10")
def _(spark, d):
    return rk.top_words_head(ct.word_counts(rg.topic_tokens(spark, d)), 10)


@query(
    "dtm_corner",
    f"""WITH {DOC_COUNTS}, {DICTIONARY}
    SELECT doc_id, term_id, word, n FROM dtm JOIN dictionary USING (word) WHERE doc_id < 10 AND term_id < 1000""",
)
def _(spark, d):
    # the corner is the feature: ten documents, wide enough that the sparse matrix shows something
    counts = rg.doc_counts(spark, d)
    return rk.dtm_corner(counts, ct.build_dictionary(counts), 10, 1000)


@query("sample_exact", "SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id::VARCHAR), doc_id LIMIT 50")
def _(spark, d):
    return rk.sample_exact(rg.read_table(spark, d, "documents").select("doc_id"), 50)


@query(
    "sample_per_topic",
    """SELECT source AS topic, doc_id FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id::VARCHAR), doc_id) <= 20""",
)
def _(spark, d):
    docs = rg.read_table(spark, d, "documents").select(F.col("source").alias("topic"), "doc_id")
    return rk.sample_per_topic(docs, 20)


@query(
    "split_corpus",
    """WITH b AS (SELECT doc_id, ('0x' || substr(md5('42-' || doc_id::VARCHAR), 1, 6))::BIGINT % 100 AS b FROM documents)
    SELECT doc_id, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END AS split FROM b""",
)
def _(spark, d):
    return rk.split_corpus(rg.read_table(spark, d, "documents").select("doc_id"))


@query(
    "stopword_union",
    f"""WITH {TOKENS}, frequent AS (SELECT word FROM tokens GROUP BY ALL HAVING count(*) > 1000)
    SELECT word FROM frequent UNION SELECT unnest([{rg.quoted(STOP)}]) AS word""",
)
def _(spark, d):
    tokens = tk.tokenize(rg.documents(spark, d), position=False)
    return jn.stopword_union(ct.word_counts(tokens, low=1000), jn.stop_table(tokens, STOP))


# Tokens -------------------------------------------------------------------------


@query(
    "tokenize",
    rf"""SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}{{2,}}') AS w FROM documents)""",
)
def _(spark, d):
    return tk.tokenize(rg.documents(spark, d))


@query(
    "unnest_tokens",
    rf"""WITH t AS (SELECT source AS topic, lang, unnest(regexp_extract_all(lower(text), '{WORD}+(?:[''’]{WORD}+)*')) AS word FROM documents)
    SELECT topic, lang, word, count(*) AS n FROM t GROUP BY ALL""",
)
def _(spark, d):
    words = tk.unnest_tokens(rg.documents(spark, d).withColumnRenamed("document", "post_message"))
    return words.groupBy("topic", "lang", "word").agg(F.count("*").alias("n"))


@query(
    "split_whitespace",
    f"""SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({SPLIT_SQL}) AS word FROM documents) GROUP BY ALL""",
)
def _(spark, d):
    return ct.doc_term_counts(tk.tokenize(rg.documents(spark, d), tokenizer="whitespace", position=False))


@query("count_vectorize", f"WITH {DOC_COUNTS} SELECT doc_id, word, n FROM dtm")
def _(spark, d):
    tokens = tk.tokenize(rg.documents(spark, d), position=False)
    return ct.doc_term_counts(jn.drop_stop_words(tokens, STOP))


@query(
    "ngrams",
    rf"""WITH t AS (
        SELECT source AS topic, list_filter(regexp_extract_all(lower(text), '{WORD}{{2,}}'), lambda x: x NOT IN {STOP_SQL}) AS w FROM documents
    ), g AS (
        SELECT topic, unnest(w) AS word FROM t
        UNION ALL SELECT topic, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS word FROM t
    ) SELECT topic, word, count(*) AS n FROM g GROUP BY ALL""",
)
def _(spark, d):
    grams = tk.ngrams(rg.documents(spark, d), low=1, high=2, stop_words=STOP, keep=("topic",))
    return grams.groupBy("topic", "word").agg(F.count("*").alias("n"))


@query(
    "chunk_words",
    f"""WITH t AS (SELECT doc_id, {SPLIT_SQL} AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(0, ceil(len(w) / 512.0)::BIGINT)) AS chunk FROM t)
    SELECT doc_id, chunk, md5(array_to_string(list_slice(w, chunk * 512 + 1, chunk * 512 + 512), ' ')) AS chunk_md5 FROM c""",
)
def _(spark, d):
    chunks = tk.chunk_words(rg.documents(spark, d))
    return chunks.select("doc_id", "chunk", rg.digest("chunk_text").alias("chunk_md5"))


@query(
    "corpus_chunks",
    rf"""WITH t AS (SELECT regexp_split_to_array(string_agg(text, ' ' ORDER BY doc_id), '{BLANK}+') AS w FROM documents),
    f AS (SELECT list_filter(w, lambda x: x <> '') AS w FROM t),
    c AS (SELECT w, unnest(range(0, ceil(len(w) / 512.0)::BIGINT)) AS chunk FROM f)
    SELECT chunk, md5(array_to_string(list_slice(w, chunk * 512 + 1, chunk * 512 + 512), ' ')) AS chunk_md5 FROM c""",
)
def _(spark, d):
    chunks = tk.corpus_chunks(even_blocks(rg.documents(spark, d), "doc_id"), ["doc_id"], F.col("_even"), limit=None)
    return chunks.select("chunk", rg.digest("chunk_text").alias("chunk_md5"))


@query(
    "preprocess_corpus",
    rf"""WITH t AS (
        SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(translate(text, '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', '{' ' * 32}')), '{BLANK}+'), lambda x: x <> '')) AS word
        FROM documents
    ), vocab AS (SELECT DISTINCT word FROM t),
    lemmas AS (SELECT v.word AS form, b.word AS lemma FROM vocab v JOIN vocab b ON v.word = b.word || 's'),
    l AS (SELECT doc_id, coalesce(lemma, word) AS word FROM t LEFT JOIN lemmas ON word = form),
    k AS (SELECT * FROM l WHERE word NOT IN {STOP_SQL} AND length(word) >= 2),
    c AS (SELECT doc_id, word, count(*) AS n FROM k GROUP BY ALL),
    total AS (SELECT count(*) AS n_docs FROM documents),
    v AS (SELECT word FROM c, total GROUP BY word, n_docs HAVING count(*) >= ceil(0.01 * n_docs) AND count(*) <= floor(0.5 * n_docs)),
    p AS (SELECT * FROM c WHERE word IN (FROM v)),
    top AS (SELECT word FROM p GROUP BY ALL ORDER BY sum(n) DESC, word LIMIT 2000),
    q AS (SELECT * FROM p WHERE word IN (FROM top))
    SELECT doc_id, word, n FROM q WHERE doc_id IN (SELECT doc_id FROM q GROUP BY ALL HAVING sum(n) >= 20)""",
)
def _(spark, d):
    docs = rg.documents(spark, d).select("doc_id", "document")
    words = tk.tokenize(
        docs.select("doc_id", F.lower(tx.remove_punctuation(F.col("document"))).alias("document")), tokenizer="whitespace", position=False
    )
    return ct.preprocess_corpus(
        docs, STOP, plural_table(words), min_chars=2, min_df=0.01, max_df=0.5, min_words=20, max_features=2000
    ).select("doc_id", "word", "n")
