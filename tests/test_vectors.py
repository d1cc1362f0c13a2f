import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import planted_groups
from threadloom.operators import approximate as ap
from threadloom.operators import charts as ch
from threadloom.operators import clustering as cl
from threadloom.operators import components as cp
from threadloom.operators import counting as ct
from threadloom.operators import hierarchy as hi
from threadloom.operators import joins as jn
from threadloom.operators import neighbors as nb
from threadloom.operators import reduction as rd
from threadloom.operators import spanning as sp
from threadloom.operators import ward as wd
from threadloom.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def planted(spark):
    rows = planted_groups()
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>, truth int").repartition(6)
    return df.persist()


def brute_knn(df, k, metric="euclidean"):
    pdf = df.toPandas().sort_values("doc_id")
    x, ids = np.array(pdf.embedding.tolist(), dtype=float), pdf.doc_id.to_numpy()
    if metric == "cosine":
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(len(x)):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 10)
        out[ids[i]] = [int(ids[j]) for j in np.lexsort((ids, d)) if j != i][:k]
    return out


def found(rows):
    out = {}
    for r in rows.orderBy("doc_id", "rank").collect():
        out.setdefault(r.doc_id, []).append(r.neighbor)
    return out


def test_knn_single_block(planted):
    assert found(nb.knn_join(planted, 7)) == brute_knn(planted, 7)
    assert found(nb.knn_join(planted, 3, metric="cosine")) == brute_knn(planted, 3, "cosine")


@pytest.mark.parametrize("block", [17, 90])
def test_knn_many_blocks(planted, monkeypatch, block):
    monkeypatch.setattr(nb, "BLOCK_VECTORS", block)
    monkeypatch.setattr(nb, "QUERY_VECTORS", 25)
    assert found(nb.knn_join(planted, 9)) == brute_knn(planted, 9)


def test_knn_with_a_pile_of_copies(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = np.round(rng.normal(size=(40, 4)), 3)
    rows = [(i, base[0 if i < 100 else i % 40].tolist()) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>").repartition(5)
    expected = brute_knn(df, 5)
    assert found(nb.knn_join(df, 5)) == expected
    monkeypatch.setattr(nb, "BLOCK_VECTORS", 8)
    assert found(nb.knn_join(df, 5)) == expected
    few = df.filter("doc_id >= 246")
    assert found(nb.knn_join(few, 10)) == brute_knn(few, 10)


@pytest.mark.parametrize(("folder", "block"), [("sf0.01", 64), ("sf0.1", 256)])
def test_approximate_neighbours_reach_their_recall(spark, folder, block):
    """Against all pairs, on vectors without much structure; distances are exact and lists complete."""
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id")
    want = brute_knn(df, 10)
    got = found(ap.approximate_knn(df, 10, block=block))
    assert got.keys() == want.keys() and all(len(g) == 10 and len(set(g)) == 10 for g in got.values())
    recall = np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want])
    assert recall >= 0.9, recall


def test_approximate_neighbours_of_copies_and_few_rows(spark, planted):
    rows = [(i, [float(i % 5 == 0), float(i % 3), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>").repartition(4)
    assert found(ap.approximate_knn(df, 4)) == brute_knn(df, 4)
    assert found(ap.approximate_knn(df.filter("doc_id < 3"), 5)) == brute_knn(df.filter("doc_id < 3"), 5)
    assert ap.approximate_knn(df.filter("1 = 0"), 3).count() == 0
    want, got = brute_knn(planted, 6, "cosine"), found(ap.approximate_knn(planted, 6, metric="cosine", block=50))
    assert np.mean([len(set(got[i]) & set(want[i])) / 6 for i in want]) >= 0.95


def test_fuzzy_graph_reaches_its_target(planted):
    k = 8
    knn = nb.knn_join(planted, k).toPandas()
    graph = {(r.src, r.dst): r.weight for r in nb.fuzzy_graph(planted.sparkSession.createDataFrame(knn), k).collect()}
    directed = {}
    for doc, part in knn.groupby("doc_id"):
        d = part.sort_values("rank").distance.to_numpy()
        rho, lo, hi_ = d[d > 0].min(), 0.0, 1e3
        for _ in range(200):
            mid = (lo + hi_) / 2
            if np.exp(-np.maximum(d - rho, 0) / mid).sum() < np.log2(k):
                lo = mid
            else:
                hi_ = mid
        for n, w in zip(part.sort_values("rank").neighbor, np.exp(-np.maximum(d - rho, 0) / hi_)):
            directed[doc, n] = w
    for (a, b), w in graph.items():
        x, y = directed.get((a, b), 0.0), directed.get((b, a), 0.0)
        assert abs(w - (x + y - x * y)) < 1e-6
    assert len(graph) == len({tuple(sorted(p)) for p in directed})


def test_components_of_two_graphs(spark):
    rng = np.random.default_rng(5)
    edges, want = [], {}
    for g in (0, 1):
        parent = list(range(300))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in rng.integers(0, 300, (180, 2)):
            edges.append((g, int(a), int(b)))
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
        # a long chain needs many plain propagation rounds
        for a in range(200, 299):
            edges.append((g, a, a + 1))
            ra, rb = root(a), root(a + 1)
            parent[max(ra, rb)] = min(ra, rb)
        want.update({(g, i): root(i) for i in range(300)})
    e = spark.createDataFrame(edges, "g int, src bigint, dst bigint")
    n = spark.createDataFrame([(g, i) for g in (0, 1) for i in range(300)], "g int, id bigint")
    got = {(r.g, r.id): r.label for r in cp.connected_components(e, n, ["g"]).collect()}
    assert got == want


@pytest.mark.parametrize(("n", "block"), [(250, 2_048), (150, 25)])
def test_spanning_tree_equals_all_pairs(spark, n, block):
    """In one block, and over many; a grid part has many equal distances."""
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(size=(n - 40, 3)) + 6 * rng.integers(0, 3, (n - 40, 1)), np.array([[i % 8, i // 8, 20.0] for i in range(40)])])
    core = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 1)[:, 4]
    weights = np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), np.maximum(core[:, None], core[None, :]))
    inside, total = {0}, []
    reach = weights[0].copy()
    while len(inside) < n:
        reach[list(inside)] = np.inf
        k = int(reach.argmin())
        total.append(reach[k])
        inside.add(k)
        reach = np.minimum(reach, weights[k])
    df = spark.createDataFrame([(i, x[i].tolist(), float(core[i])) for i in range(n)], "id bigint, v array<double>, core double").repartition(4)
    got = sp.spanning_tree(df, block).collect()
    assert len(got) == n - 1 and np.allclose(sorted(r.weight for r in got), sorted(total))
    assert all(r.src < r.dst and abs(weights[r.src, r.dst] - r.weight) < 1e-9 for r in got)
    edges = spark.createDataFrame([(r.src, r.dst) for r in got], "src bigint, dst bigint")
    assert cp.connected_components(edges, df.select("id")).select("label").distinct().count() == 1


def test_density_clusters(planted):
    got = cl.density_clusters(planted, 20, 5).join(planted.select("doc_id", "truth"), "doc_id").toPandas()
    assert len(got) == 428
    for group in (0, 1, 2):
        assert (got[got.truth == group].topic == group).mean() > 0.9
    assert (got[got.truth == -1].topic == -1).mean() > 0.9
    assert (got[got.truth == 3].topic == -1).mean() > 0.8
    assert got.strength.between(0, 1).all() and (got[got.topic == -1].strength == 0).all()


def test_density_counts_copies(spark):
    # 60 copies of one vector, 40 of another, and scattered points
    rng = np.random.default_rng(0)
    rows = [(i, [0.0, 0.0]) for i in range(60)] + [(i, [5.0, 5.0]) for i in range(60, 100)]
    rows += [(100 + i, x.tolist()) for i, x in enumerate(rng.uniform(-50, 50, (30, 2)))]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    got = {r.doc_id: r.topic for r in cl.density_clusters(df, 20, 5).collect()}
    assert {got[i] for i in range(60)} == {0} and {got[i] for i in range(60, 100)} == {1}


def test_ward_by_hand():
    x, w = np.array([[0.0], [1.0], [1.5], [10.0], [10.4], [30.0]]), np.ones(6)
    merges = hi.merge_tree(hi.ward_cost(x, w), w, "ward")
    assert [round(h, 6) for _, _, h in merges] == [0.08, 0.125, 1.041667, 105.281333, 538.480333]
    assert hi.cut_tree(6, merges, 3) == [0, 0, 0, 1, 1, 2]


def test_average_linkage_against_brute_force():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(25, 4))
    cost = hi.cosine_cost(x)
    groups = {i: [i] for i in range(25)}
    heights = []
    while len(groups) > 1:
        best = min(((cost[np.ix_(groups[a], groups[b])].mean(), a, b) for a in groups for b in groups if a < b))
        heights.append(best[0])
        groups[best[1]] += groups.pop(best[2])
    assert np.allclose([h for _, _, h in hi.merge_tree(cost, np.ones(25), "average")], heights)


def ward_heights(x, w):
    """Plain one-by-one Ward: heights, and the groups before the last k - 1 merges."""
    x, w, groups, out = list(x), list(w), [[i] for i in range(len(x))], []
    snapshots = {len(x): [sorted(g) for g in groups]}
    while len(x) > 1:
        a, b = np.array(x), np.array(w, dtype=float)
        cost = ((a[:, None] - a[None]) ** 2).sum(-1) * (b[:, None] * b) / (b[:, None] + b)
        np.fill_diagonal(cost, np.inf)
        i, j = sorted(divmod(int(cost.argmin()), len(x)))
        out.append(cost[i, j])
        x[i], w[i], groups[i] = (a[i] * b[i] + a[j] * b[j]) / (b[i] + b[j]), w[i] + w[j], groups[i] + groups[j]
        del x[j], w[j], groups[j]
        snapshots[len(x)] = [sorted(g) for g in groups]
    return out, snapshots


@pytest.mark.parametrize(("n", "block"), [(300, 2_048), (80, 24)])
def test_ward_equals_the_one_by_one_method(spark, n, block):
    """In one cell, and in so many that cells, lookups and joins all take part; some points are repeated."""
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 3)) + 4 * rng.integers(0, 3, (n, 1)), 3)
    rows = [(i, x[i].tolist()) for i in range(n)] + [(n + i, x[0 if i < 9 else i].tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>").repartition(5)
    weights = [1 + 9 * (i == 0) + (9 <= i < 20) for i in range(n)]
    heights, groups = ward_heights(x, weights)
    points = df.groupBy(F.col("embedding").alias("v")).agg(F.min("doc_id").alias("node"), F.count("*").alias("w"))
    merges = wd.ward_merges(points, block).persist()
    assert np.allclose(sorted(r.height for r in merges.collect()), sorted(heights))
    for k in (1, 4, 11):
        topics = {}
        for r in wd.cut_merges(points, merges, k).collect():
            topics.setdefault(r.topic, []).append(r.node)
        assert sorted(map(sorted, topics.values())) == sorted(groups[k])
        assert [min(topics[t]) for t in sorted(topics)] == sorted(min(g) for g in groups[k])


def test_ward_keeps_the_vectors_of_its_last_round_only(spark):
    """The tables of a round were left in the shared folder, so that it held the vectors once for every table of every round."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(i, rng.normal(size=3).tolist(), 1) for i in range(120)], "node bigint, v array<double>, w bigint")
    merges = wd.ward_merges(points, 24)
    left = [spark.read.parquet(f"{folder}/{name}").columns for name in set(os.listdir(folder)) - before if name.startswith("cut-")]
    assert len(left) > 2 and sum("v" in columns for columns in left) == 1
    assert merges.count() == 119 and merges.select("right").distinct().count() == 119


def test_agglomerative(planted):
    inner = planted.filter("truth >= 0")
    got = cl.agglomerative(inner, 4).join(inner, "doc_id").select("truth", "topic").distinct().collect()
    assert len(got) == 4
    one = planted.limit(1)
    assert [tuple(r) for r in cl.agglomerative(one, 3).select("topic").collect()] == [(0,)]
    assert cl.agglomerative(planted.filter("1 = 0"), 3).count() == 0


def test_kmeans_is_repeatable_and_nearest(planted):
    one = {r.doc_id: r.topic for r in cl.kmeans(planted, 4).collect()}
    two = {r.doc_id: r.topic for r in cl.kmeans(planted.orderBy(F.rand(3)).repartition(3), 4).collect()}
    groups = lambda a: {frozenset(k for k in a if a[k] == t) for t in set(a.values())}
    assert groups(one) == groups(two)
    pdf = planted.toPandas()
    x = np.array(pdf.embedding.tolist())
    labels = pdf.doc_id.map(one).to_numpy()
    centres = np.array([x[labels == t].mean(0) for t in range(4)])
    nearest = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    assert (nearest == labels).mean() > 0.99


def test_pca_against_svd(planted):
    pdf = planted.toPandas().sort_values("doc_id")
    x = np.array(pdf.embedding.tolist())
    x = x - x.mean(0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    got = np.array([r.embedding for r in rd.pca(planted, 3).orderBy("doc_id").collect()])
    assert np.allclose(np.abs(got), np.abs(x @ vt[:3].T), atol=1e-8)


def test_spectral_embedding_separates_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal([6.0 * (i % 3 == j) for j in range(4)], 0.3).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    graph = nb.fuzzy_graph(nb.knn_join(df, 8), 8).persist()
    got = {r.doc_id: np.array(r.embedding) for r in rd.spectral_embed(graph, 2).collect()}
    # columns are orthonormal eigenvectors of the normalised graph
    y = np.array([got[i] for i in range(90)])
    assert np.allclose(y.T @ y, np.eye(2), atol=1e-6)
    w = np.zeros((90, 90))
    for r in graph.collect():
        w[r.src, r.dst] = w[r.dst, r.src] = r.weight
    d = w.sum(1)
    a = w / np.sqrt(np.outer(d, d))
    top = np.sort(np.linalg.eigvalsh(a))[::-1][1:3]
    assert np.allclose(np.sort(np.diag(y.T @ a @ y))[::-1], top, atol=1e-3)
    scaled = y / np.sqrt(d)[:, None]
    centres = np.array([scaled[[i for i in range(90) if i % 3 == g]].mean(0) for g in range(3)])
    near = ((scaled[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    assert (near == np.arange(90) % 3).mean() > 0.95


def test_similarity_in_slices_equals_one_matrix(planted, monkeypatch):
    docs = planted.select("doc_id", "embedding")
    targets = ct.mean_vectors(planted.filter("truth >= 0"), "truth", "embedding", "vector").withColumnRenamed("truth", "topic")
    best = sorted((r.doc_id, r.topic, round(r.similarity, 9)) for r in jn.vector_similarity(docs, targets).collect())
    full = sorted((r.doc_id, r.topic, round(r.similarity, 9)) for r in jn.doc_topic_similarity(docs, targets).collect())
    assert len(best) == 428 and len(full) == 428 * 4
    monkeypatch.setattr(jn, "MATRIX_LIMIT", 40)
    assert sorted((r.doc_id, r.topic, round(r.similarity, 9)) for r in jn.vector_similarity(docs, targets).collect()) == best
    assert sorted((r.doc_id, r.topic, round(r.similarity, 9)) for r in jn.doc_topic_similarity(docs, targets).collect()) == full


def test_zeroshot_and_combine(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.7, 0.7])], "doc_id bigint, embedding array<double>")
    labels = spark.createDataFrame([("north", [0.0, 2.0]), ("east", [3.0, 0.0])], "label string, vector array<double>")
    got = {r.doc_id: r.label for r in cl.zeroshot_assign(docs, labels, 0.9).collect()}
    assert got == {0: "east", 1: "north", 2: None}
    assigned = cl.zeroshot_assign(docs, labels, 0.9).filter("label is not null").select("doc_id", "label")
    rest = spark.createDataFrame([(2, 0), (3, -1)], "doc_id bigint, topic int")
    topics, names = cl.combine_zeroshot(assigned, rest)
    assert {r.doc_id: r.topic for r in topics.collect()} == {0: 0, 1: 1, 2: 2, 3: -1}
    assert {r.topic: r.label for r in names.collect()} == {0: "east", 1: "north"}


def test_guided_blend(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.4, 0.6])], "doc_id bigint, embedding array<double>")
    seeds = spark.createDataFrame([(0, [2.0, 0.0])], "seed int, vector array<double>")
    got = {r.doc_id: (r.seed, list(r.embedding)) for r in cl.guided_blend(docs, seeds).collect()}
    assert got[0] == (0, [1.25, 0.0]) and got[1] == (-1, [0.0, 1.0]) and got[2] == (-1, [0.4, 0.6])


def test_hierarchy_and_reduction(spark):
    rows = [(-1, [9.0, 9.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])]
    topics = spark.createDataFrame(rows, "topic int, vector array<double>")
    tree = hi.topic_hierarchy(topics).orderBy("parent").collect()
    assert [(r.parent, r.left, r.right, r.topics) for r in tree] == [(3, 0, 1, [0, 1]), (4, 2, 3, [0, 1, 2])]
    assert {r.topic: r.merged for r in hi.reduce_topics(topics, 2).collect()} == {-1: -1, 0: 0, 1: 0, 2: 1}


def test_chart_tables(planted):
    sizes = ct.topic_sizes(planted, "truth")
    centres = cl.topic_centroids(planted.withColumnRenamed("truth", "topic"))
    assert ch.topic_map(centres, sizes).count() == 4
    flat = ch.document_map(planted, planted.select("doc_id", F.col("truth").alias("topic")))
    assert flat.columns == ["doc_id", "x", "y", "topic", "name"] and flat.count() == 428


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_knn_sends_vectors_to_tiles_not_to_blocks(spark, tmp_path, monkeypatch, spread):
    from threadloom.operators import neighbors as nb

    rng = np.random.default_rng(5)
    rows = rng.normal(0, 4, (12, 6))[rng.integers(0, 12, 900)] + rng.normal(0, spread, (900, 6))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "rep bigint, v array<double>")
    monkeypatch.setattr(nb, "BLOCK_VECTORS", 40)
    sent = []
    monkeypatch.setattr(nb, "cut_lineage", lambda df, cut=nb.cut_lineage: sent.append(cut(df)) or sent[-1])
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))
    want = {(i, int(j)) for i in range(900) for j in np.lexsort((np.arange(900), np.round(d[i], 12)))[:6]}
    for tile in (150, None):
        found = nb._search(points, 6, tile).collect()
        assert {(r.q, r.n) for r in found} == want and len(found) == len(want)
        assert all(r.distance == pytest.approx(d[r.q, r.n], abs=1e-12) for r in found)
    # no table of vectors is longer than the vectors themselves
    assert max(t.count() for t in sent if "v" in t.columns) == 900


def test_components_of_the_ends_of_edges(spark):
    """Without a table of nodes the ends of the edges are the nodes; loops and repeated edges change nothing."""
    edges = [(k + 1, k) for k in range(1, 40)] + [(7, 7), (100, 100), (203, 201), (201, 203), (202, 203), (202, 203)]
    got = {r.id: r.label for r in cp.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 201: 201, 202: 201, 203: 201}
    assert cp.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
