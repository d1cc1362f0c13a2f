"""Vectors: similarity, neighbours, assignment."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadloom.catalog import registry as rg
from threadloom.catalog.registry import VECTORS, cosine_sql, query, r6
from threadloom.operators import clustering as cl
from threadloom.operators import counting as ct
from threadloom.operators import embedding as em
from threadloom.operators import joins as jn
from threadloom.operators import neighbors as nb
from threadloom.operators import weighting as wt
from threadloom.session import cut_lineage, ensure_checkpoint_dir

SIMS = f"""{VECTORS}, sims AS (
        SELECT d.doc_id, c.topic, {cosine_sql('v', 'c')} AS s FROM vecs d CROSS JOIN centres c
    ),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 12) DESC, topic) AS r FROM sims)"""
PAIRS = """pairs AS (
        SELECT a.doc_id, b.doc_id AS neighbor, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance
        FROM vecs a JOIN vecs b ON a.doc_id <> b.doc_id
    ),
    knn AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(distance, 12), neighbor) AS rank FROM pairs
        QUALIFY rank <= 10
    )"""
REACH = """core AS (SELECT doc_id AS id, distance AS core FROM knn WHERE rank = 5),
    five AS (SELECT least(doc_id, neighbor) AS src, greatest(doc_id, neighbor) AS dst, min(distance) AS d FROM knn GROUP BY ALL),
    edges AS (
        SELECT src, dst, greatest(a.core, b.core, d) AS weight FROM five JOIN core a ON a.id = src JOIN core b ON b.id = dst
    )"""


@query(
    "topic_centroids",
    f"WITH {VECTORS} SELECT topic, i - 1 AS pos, {r6('x')} AS value FROM means",
)
def _(spark, d):
    return rg.centroids(spark, d).select("topic", F.posexplode("vector").alias("pos", "value"))


@query("doc_topic_similarity", f"WITH {SIMS} SELECT doc_id, topic, {r6('s')} AS similarity FROM sims")
def _(spark, d):
    docs = rg.vectors(spark, d).select("doc_id", "embedding")
    return jn.doc_topic_similarity(docs, rg.centroids(spark, d)).select("doc_id", "topic", "similarity")


@query("topic_probability", f"WITH {SIMS} SELECT doc_id, {r6('max(s)')} AS probability FROM sims GROUP BY doc_id")
def _(spark, d):
    docs = rg.vectors(spark, d).select("doc_id", "embedding")
    return cl.topic_probability(docs, rg.centroids(spark, d)).select("doc_id", F.col("similarity").alias("probability"))


@query("predict_topics", f"WITH {SIMS} SELECT doc_id, topic, {r6('s')} AS similarity FROM best WHERE r = 1")
def _(spark, d):
    docs = rg.vectors(spark, d).select("doc_id", "embedding")
    return cl.predict_topics(docs, rg.centroids(spark, d)).select("doc_id", "topic", "similarity")


@query(
    "zeroshot_assign",
    f"""WITH {SIMS} SELECT doc_id, CASE WHEN round(s, 12) >= 0.3 THEN topic END AS label, {r6('s')} AS similarity
    FROM best WHERE r = 1""",
)
def _(spark, d):
    docs = rg.vectors(spark, d).select("doc_id", "embedding")
    labels = rg.centroids(spark, d).withColumnRenamed("topic", "label")
    return cl.zeroshot_assign(docs, labels, 0.3).select("doc_id", "label", "similarity")


@query(
    "guided_blend",
    f"""WITH {VECTORS}, whole AS (SELECT i, avg(x) AS x FROM cells GROUP BY ALL),
    targets AS (SELECT topic AS seed, c FROM centres UNION ALL SELECT -1, list(x ORDER BY i) FROM whole),
    sims AS (SELECT doc_id, v, seed, c, {cosine_sql('v', 'c')} AS s FROM vecs CROSS JOIN targets),
    best AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 12) DESC, seed) = 1),
    blended AS (
        SELECT doc_id, seed, CASE WHEN seed = -1 THEN v
            ELSE list_transform(list_zip(v, c), lambda z: 0.75 * z[1] + 0.25 * z[2]) END AS b FROM best
    )
    SELECT doc_id, seed::BIGINT AS seed, generate_subscripts(b, 1) - 1 AS pos, {r6('unnest(b)')} AS value FROM blended""",
)
def _(spark, d):
    docs = rg.vectors(spark, d).select("doc_id", "embedding")
    seeds = rg.centroids(spark, d).withColumnRenamed("topic", "seed")
    blended = cl.guided_blend(docs, seeds)
    return blended.select("doc_id", "seed", F.posexplode("embedding").alias("pos", "value"))


@query("knn_join", f"WITH {VECTORS}, {PAIRS} SELECT doc_id, rank, neighbor, {r6('distance')} AS distance FROM knn")
def _(spark, d):
    return nb.knn_join(rg.vectors(spark, d), 10)


@query("mutual_reachability", f"WITH {VECTORS}, {PAIRS}, {REACH} SELECT src, dst, {r6('weight')} AS weight FROM edges")
def _(spark, d):
    return cl.mutual_reachability(cut_lineage(nb.knn_join(rg.vectors(spark, d), 10)), 5)


@query(
    "dbscan_level",
    f"""WITH RECURSIVE {VECTORS}, {PAIRS}, {REACH},
    near AS (SELECT src AS a, dst AS b FROM edges WHERE weight <= 1.15 UNION ALL SELECT dst, src FROM edges WHERE weight <= 1.15),
    reach(id, seen) AS (SELECT doc_id, doc_id FROM vecs UNION SELECT r.id, n.b FROM reach r JOIN near n ON n.a = r.seen),
    comp AS (SELECT id, min(seen) AS label FROM reach GROUP BY ALL),
    size_of AS (SELECT label, count(*) AS n FROM comp GROUP BY ALL)
    SELECT id AS doc_id, CASE WHEN n >= 3 THEN label ELSE -1 END AS component FROM comp JOIN size_of USING (label)""",
)
def _(spark, d):
    vectors = rg.vectors(spark, d)
    edges = cl.mutual_reachability(cut_lineage(nb.knn_join(vectors, 10)), 5)
    return cl.dbscan_level(edges, vectors, 1.15, 3)


@query(
    "neighbor_graph",
    f"""WITH RECURSIVE {VECTORS}, {PAIRS},
    lists AS (
        SELECT doc_id, list(distance) AS ds, coalesce(min(distance) FILTER (distance > 0), 0) AS rho, greatest(max(distance), 1e-6) AS far
        FROM knn GROUP BY ALL
    ),
    grow(doc_id, ds, rho, hi, step) AS (
        SELECT doc_id, ds, rho, far, 0 FROM lists
        UNION ALL SELECT doc_id, ds, rho,
            CASE WHEN list_sum(list_transform(ds, lambda x: exp(-greatest(x - rho, 0) / hi))) < log2(10) THEN hi * 2 ELSE hi END, step + 1
        FROM grow WHERE step < 20
    ),
    halve(doc_id, ds, rho, lo, hi, step) AS (
        SELECT doc_id, ds, rho, 0::DOUBLE, hi, 0 FROM grow WHERE step = 20
        UNION ALL SELECT doc_id, ds, rho,
            CASE WHEN list_sum(list_transform(ds, lambda x: exp(-greatest(x - rho, 0) / ((lo + hi) / 2)))) < log2(10) THEN (lo + hi) / 2 ELSE lo END,
            CASE WHEN list_sum(list_transform(ds, lambda x: exp(-greatest(x - rho, 0) / ((lo + hi) / 2)))) < log2(10) THEN hi ELSE (lo + hi) / 2 END,
            step + 1 FROM halve WHERE step < 40
    ),
    solved AS (SELECT doc_id, rho, greatest(hi, 1e-9) AS sigma FROM halve WHERE step = 40),
    directed AS (SELECT doc_id AS a, neighbor AS b, exp(-greatest(distance - rho, 0) / sigma) AS w FROM knn JOIN solved USING (doc_id))
    SELECT least(a, b) AS src, greatest(a, b) AS dst,
        {r6('sum(w) - CASE WHEN count(*) > 1 THEN product(w) ELSE 0 END')} AS weight
    FROM directed GROUP BY ALL""",
)
def _(spark, d):
    return nb.fuzzy_graph(cut_lineage(nb.knn_join(rg.vectors(spark, d), 10)), 10)


@query(
    "hash_embed",
    f"""WITH {rg.TFIDF}, cell AS (
        SELECT doc_id, ('0x' || substr(md5(word), 1, 6))::BIGINT % 32 AS pos,
            sum(weight * CASE WHEN ('0x' || substr(md5(word), 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END) AS v
        FROM tfidf GROUP BY ALL
    ),
    len AS (SELECT doc_id, sqrt(sum(v * v)) AS l FROM cell GROUP BY ALL)
    SELECT doc_id, pos, {r6('v / l')} AS value FROM cell JOIN len USING (doc_id) WHERE abs(v / l) > 1e-9""",
)
def _(spark, d):
    # vectors are stored as 32-bit floats; the comparison is made on doubles
    made = em.hash_embed(wt.tfidf(rg.doc_counts(spark, d)), 32, "double")
    return made.select("doc_id", F.posexplode("embedding").alias("pos", "value")).filter("abs(value) > 1e-9")


@query(
    "load_or_embed",
    """SELECT d.doc_id, coalesce(len(e.embedding), 64)::BIGINT AS dims, e.vec_id IS NOT NULL AS stored
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def _(spark, d):
    # a part of the work is stored already: documents that have a vector keep it, all others are embedded
    docs = rg.documents(spark, d).select("doc_id", "document")
    path = f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    em.save_embeddings(rg.vectors(spark, d), path)
    both = em.load_or_embed(docs, path, em.hash_embedder(64, rg.STOP))
    saved = rg.vectors(spark, d).select("doc_id", F.col("embedding").cast("array<float>").alias("_saved"))
    own = F.coalesce(F.col("embedding") == F.col("_saved"), F.lit(False))
    return both.join(saved, "doc_id", "left").select("doc_id", F.size("embedding").alias("dims"), own.alias("stored"))
