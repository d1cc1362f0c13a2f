import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixtures import WORD_LISTS, listed, tiny
from threadloom.functions import text as tx
from threadloom.functions.words import CUSTOM_STOP_WORDS, default_stop_words, language_stop_words
from threadloom.operators import cleaning as cn
from threadloom.operators import counting as ct
from threadloom.operators import evaluation as ev
from threadloom.operators import merging as mg
from threadloom.operators import numbering as nm
from threadloom.operators import ranking as rk
from threadloom.operators import tokens as tk
from threadloom.operators import weighting as wt


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def test_clean_text(spark):
    assert one(spark, tx.clean_text, " \n a\n\nb\tc\rd   ") == "a  b c d"


def test_normalize_digits_punctuation(spark):
    assert one(spark, tx.normalize_text, "Été, (2x)!") == "été 2x "
    assert one(spark, tx.remove_digits, "covid19 42 x") == "covid  x"
    assert one(spark, tx.remove_punctuation, "a-b'c.") == "a b c "


@pytest.mark.parametrize("text", ["Ab c dé_1, x", "don't stop", "", "été ñu 42 a"])
def test_vectorizer_tokens(spark, text):
    assert one(spark, tx.vectorizer_tokens, text) == re.findall(r"(?u)\b\w\w+\b", text.lower())


def test_tidy_tokens(spark):
    assert one(spark, tx.tidy_tokens, "It's 'quoted', OK!") == ["it's", "quoted", "ok"]


def test_ngrams(spark):
    docs = spark.createDataFrame([(0, "aa the bb cc"), (1, "aa")], "doc_id bigint, document string")
    rows = tk.ngrams(docs, low=1, high=2, stop_words=["the"]).orderBy("doc_id", "pos").collect()
    assert [r.word for r in rows] == ["aa", "bb", "cc", "aa bb", "bb cc", "aa"]


def test_chunks(spark):
    docs = spark.createDataFrame([(0, "a b c d e f g h i"), (1, "")], "doc_id bigint, document string")
    rows = tk.chunk_words(docs, words=4, limit=None).orderBy("chunk").collect()
    assert [r.chunk_text for r in rows] == ["a b c d", "e f g h", "i"]
    assert tk.chunk_words(docs, words=4, limit=2).count() == 2


@pytest.mark.parametrize("width,limit", [(2, None), (3, None), (5, None), (3, 2), (100, None)])
def test_corpus_chunks_and_concat(spark, width, limit):
    texts = ["a b c", "", "d", "e f g h i j k", "  ", "l m"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, document string")
    block = nm.number_block("doc_id", 2)
    rows = tk.corpus_chunks(docs, ["doc_id"], block, words=width, limit=limit).orderBy("chunk").collect()
    words = " ".join(texts).split()
    expected = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
    assert [r.chunk_text for r in rows] == (expected if limit is None else expected[:limit])
    parts = mg.concat_corpus(docs, ["doc_id"], block, "document", part_chars=width).orderBy("part").collect()
    assert "".join(r.text for r in parts) == " ".join(texts)


def test_blocks_of_scattered_ids(spark):
    """Ids spread over 62 bits, null and repeated ones: blocks stay even, and follow the order."""
    rng = random.Random(4)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(900)] + [None] * 3 + [7] * 5
    texts = [f"w{i} x" for i in range(len(ids))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, document string").repartition(6)
    placed = nm.even_blocks(df, "doc_id", 50)
    sizes = [r["count"] for r in placed.groupBy("_even").count().collect()]
    assert 15 <= len(sizes) <= 20 and max(sizes) <= 100
    order = sorted(placed.select("doc_id", "_even").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r._even for r in order] == sorted(r._even for r in order)
    rows = tk.corpus_chunks(placed, ["doc_id", "document"], F.col("_even"), words=7).orderBy("chunk").collect()
    words = " ".join(t for _, t in sorted(zip(ids, texts), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))).split()
    assert [r.chunk_text for r in rows] == [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]


def test_merge_splits_a_hot_key_without_losing_text(spark):
    rows = [("f", "t", 1, i, f"<{i}>") for i in range(500)] + [("f", "t", 2, 0, "only"), (None, "t", 3, 0, "dropped")]
    posts = spark.createDataFrame(rows, "forum string, thread_title string, message_nr int, seq int, post_message string")
    block = nm.number_block("seq", 16)
    whole = mg.merge_posts(posts.repartition(7), ["seq"], block)
    assert {(r.message_nr, r.part): r.post_message for r in whole.collect()} == {
        (1, 0): "".join(f"<{i}>" for i in range(500)), (2, 0): "only",
    }
    parts = mg.merge_posts(posts.repartition(7), ["seq"], block, part_chars=100).filter("message_nr = 1").orderBy("part").collect()
    assert len(parts) > 5 and max(len(r.post_message) for r in parts) <= 110
    assert "".join(r.post_message for r in parts) == "".join(f"<{i}>" for i in range(500))


def test_ids_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.md5(F.col("id").cast("string")).alias("word"))
    ids = nm.sorted_ids(df.repartition(5), ["k"], "n")
    assert ids.filter("n != k").count() == 0
    terms = sorted((r.term_id, r.word) for r in nm.hashed_ids(df, "word").collect())
    assert [t for t, _ in terms] == list(range(1000))


def test_spelling(spark):
    vocabulary = spark.createDataFrame([("recieve",), ("hause",), ("house",), ("zzzzzz",)], "word string")
    dictionary = spark.createDataFrame([("receive", 5), ("house", 9), ("horse", 3)], "word string, n bigint")
    fixes = {r.word: (r.corrected, r.distance) for r in cn.spelling_table(vocabulary, dictionary).collect()}
    assert fixes == {"recieve": ("receive", 2), "hause": ("house", 1)}


def test_spelling_against_all_pairs(spark):
    rng = random.Random(3)
    known = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(60)})
    other = sorted({"".join(rng.choices("abc", k=rng.randint(1, 11))) for _ in range(200)} - set(known)) + ["a" * 5000, "\U0001f600ab"]
    n = {w: i % 7 for i, w in enumerate(known)}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    expected = {}
    for w in other:
        near = [(e, -n[k], k) for k in known for e in [edits(w, k)] if e <= 2]
        if near:
            expected[w] = (min(near)[2], min(near)[0])
    vocabulary = spark.createDataFrame([(w,) for w in other + known + [""]], "word string")
    dictionary = spark.createDataFrame(list(n.items()), "word string, n bigint")
    fixes = {r.word: (r.corrected, r.distance) for r in cn.spelling_table(vocabulary, dictionary).collect()}
    assert fixes == expected and len(fixes) > 50


def test_language(spark):
    docs = spark.createDataFrame([(0, "this is the house"), (1, "das ist nicht mein haus"), (2, "xyz")], "doc_id bigint, document string")
    got = {r.doc_id: r.language for r in cn.detect_language(docs).collect()}
    assert got == {0: "en", 1: "de", 2: None}


def test_stop_word_lists():
    assert len(CUSTOM_STOP_WORDS) == len(set(CUSTOM_STOP_WORDS)) == 50
    assert len(language_stop_words("english")) == 181 and len(default_stop_words()) == 184


def test_ctfidf_by_hand(spark):
    tokens = tk.tokenize(tiny(spark), keep=("doc_id", "topic"))
    counts = ct.class_term_counts(tokens)
    got = {(r.topic, r.word): round(r.score, 6) for r in wt.ctfidf(counts).collect()}
    assert got[0, "money"] == got[0, "visit"] == 0.677221
    assert got[0, "home"] == 0.66963 and got[0, "care"] == 0.530878
    assert got[1, "memory"] == 0.642103 and got[1, "care"] == 0.306503
    assert got[-1, "hello"] == got[-1, "world"] == 1.266965
    plain = {(r.topic, r.word): round(r.score, 6) for r in wt.ctfidf(counts, False).collect()}
    assert plain[0, "care"] == 0.347542 and plain[1, "memory"] == 0.420355


def test_tfidf_by_hand(spark):
    counts = ct.doc_term_counts(tk.tokenize(tiny(spark)))
    got = {(r.doc_id, r.word): round(r.weight, 6) for r in wt.tfidf(counts).collect()}
    assert (got[0, "care"], got[0, "home"], got[0, "visit"]) == (0.483027, 0.433214, 0.760927)
    assert (got[3, "care"], got[3, "loss"], got[3, "memory"]) == (0.204994, 0.645867, 0.735414)


def test_representative_docs_by_hand(spark):
    docs = tiny(spark)
    tokens_of = lambda some: tk.tokenize(some, keep=("doc_id", "topic"))
    counts = ct.class_term_counts(tokens_of(docs))
    scores = wt.ctfidf(counts)
    candidates = rk.candidate_counts(docs, tokens_of)
    got = {r.doc_id: round(r.similarity, 6) for r in rk.doc_topic_cosine(candidates, counts, scores).collect()}
    assert got == {0: 0.839782, 1: 0.829536, 2: 0.819987, 3: 0.712546, 4: 1.0}
    top = rk.representative_docs(candidates, counts, scores, 1)
    assert sorted((r.topic, r.doc_id) for r in top.collect()) == [(-1, 4), (0, 0), (1, 2)]


def test_npmi_by_hand(spark):
    docs = tiny(spark).select(tx.vectorizer_tokens(F.col("document")).alias("tokens"))
    words = spark.createDataFrame(
        [(0, 1, "care"), (0, 2, "home"), (0, 3, "memory"), (1, 1, "hello"), (1, 2, "world")], "topic int, rank int, word string"
    )
    got = {(r.w1, r.w2): round(r.npmi, 6) for r in ev.pair_npmi(docs, words, window=3).collect()}
    assert got == {
        ("care", "home"): 0.660471, ("care", "memory"): -0.276989, ("home", "memory"): -0.938671, ("hello", "world"): 1.0,
    }


def test_npmi_in_groups_of_topics(spark, monkeypatch):
    docs = tiny(spark).select(tx.vectorizer_tokens(F.col("document")).alias("tokens"))
    whole = sorted(map(tuple, ev.topic_coherence(docs, listed(spark), 3).collect()))
    monkeypatch.setattr(ev, "LITERAL_LIMIT", 4)
    assert sorted(map(tuple, ev.topic_coherence(docs, listed(spark), 3).collect())) == whole


def test_cooccurrence_with_a_long_word_table(spark, monkeypatch):
    docs = tiny(spark).select("doc_id", tx.vectorizer_tokens(F.col("document")).alias("tokens"))
    words = ct.word_counts(tk.tokenize(tiny(spark))).filter("word <> 'home'")
    short = sorted(map(tuple, ev.cooccurrence(docs, words, 3).collect()))
    monkeypatch.setattr(ev, "LITERAL_LIMIT", 2)
    assert sorted(map(tuple, ev.cooccurrence(docs, words, 3).collect())) == short
    assert ("care", "visit", 2) in short and not any("home" in r for r in short)


def test_unique_words(spark):
    def lists(df):
        out = [[] for _ in WORD_LISTS]
        for r in df.collect():
            out[r.topic].append(r.word)
        return [sorted(x) for x in out]

    words = listed(spark)
    assert lists(rk.unique_words(words)) == [["visit"], ["loss"], ["clinic"], ["money"]]
    assert lists(rk.unique_words_threshold(words, 0.2)) == lists(rk.unique_words(words))
    for share in (0.25, 0.5):
        assert lists(rk.unique_words_threshold(words, share)) == [["home", "visit"], ["loss", "memory"], ["clinic", "memory"], ["home", "money"]]
    assert lists(rk.unique_words_threshold(words, 1.0)) == [sorted(w) for w in WORD_LISTS]
    assert round(ev.topic_diversity(words, 3).first().diversity, 6) == 0.583333


def test_df_bounds(spark):
    counts = spark.createDataFrame([(d, w, 1) for w, n in (("a", 10), ("b", 7), ("c", 2), ("d", 1)) for d in range(n)], "doc_id int, word string, n bigint")
    assert sorted(r.word for r in ct.df_prune(counts, 2, 0.7).collect()) == ["b", "c"]
    assert sorted(r.word for r in ct.df_prune(counts, 0.2, 1.0).collect()) == ["a", "b", "c"]
    assert sorted(r.word for r in ct.df_prune(counts, 0.1, 9).collect()) == ["b", "c", "d"]


def test_relabel_keeps_outliers(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([-1] * 9 + [5] * 2 + [3] * 4 + [7] * 2)], "doc_id int, topic int")
    moved, _ = rk.relabel_topics(docs)
    sizes = {r.topic: r["count"] for r in ct.topic_sizes(moved).collect()}
    assert sizes == {-1: 9, 0: 4, 1: 2, 2: 2}
    assert moved.filter("doc_id in (9, 10)").select("topic").distinct().first().topic == 1


def test_word_list_padding(spark):
    scores = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.7)], "topic int, word string, score double")
    words = rk.word_lists(rk.top_words(scores, 4), 4, pad=True).first().words
    assert [tuple(w) for w in words] == [("b", 0.7), ("a", 0.5), ("", 0.00001), ("", 0.00001)]


def test_results_do_not_depend_on_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", F.col("source").alias("topic"), F.col("text").alias("document")
    )

    def run(df):
        tokens = tk.tokenize(df, keep=("doc_id", "topic"))
        rows = rk.top_words(wt.ctfidf(ct.class_term_counts(tokens))).collect()
        picked = rk.sample_exact(df.select("doc_id"), 20).collect()
        return sorted((r.topic, r.rank, r.word, round(r.score, 9)) for r in rows), sorted(r.doc_id for r in picked)

    assert run(docs.coalesce(1)) == run(docs.orderBy(F.rand(1)).repartition(7))


def test_cooccurrence_counts_windows_without_shuffling_them(spark):
    rows = [(0, "a b a c b x a".split()), (1, "b a".split()), (2, None), (3, []), (4, "a a x b c c a b x x b".split()), (None, ["c", None, "a"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    for window in (2, 4, 9):
        want = Counter()
        for _, words in rows:
            for start in range(max(len(words) - window, 0) + 1 if words is not None else 0):
                met = sorted({w for w in words[start : start + window] if w in ("a", "b", "c")})
                want.update((one, two) for i, one in enumerate(met) for two in met[i + 1 :])
        found = ev.cooccurrence(docs, ["a", "b", "c"], window)
        assert {(r.w1, r.w2): r.n for r in found.collect()} == dict(want)
        assert "hashpartitioning(words" not in found._jdf.queryExecution().executedPlan().toString()
