"""Operators that bring rows together, and the pipeline."""

import math
import random
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import mixing, near_dups, queries, revisits, url_filter

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return brute.odd_docs(spark).cache()


def empty(df):
    return df.filter("1 = 0")


# Near-duplicates ------------------------------------------------------------


def check_components(df, size):
    texts = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}
    want = brute.components(texts, size)
    got = near_dups.near_duplicates(df, size).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(brute.shingles(texts[r.doc_id], size)), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    return got


def test_near_duplicates_equal_brute_force(spark, odd):
    check_components(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 4)
    rows = check_components(odd, 4)
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5} and {r.component_id for r in rows if r.doc_id == 12} == {11}
    assert near_dups.near_duplicates(empty(odd)).count() == 0
    kept = near_dups.drop_near_duplicates(odd, 4)
    assert kept.columns == odd.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in rows if r.kept)


def test_groups_larger_than_a_hot_list(spark, monkeypatch):
    """Chains of edits, copies and a shared passage, with lists so short that all of them are hot."""
    monkeypatch.setattr(near_dups, "HOT", 6)
    monkeypatch.setattr(near_dups, "BLOCK_DOCS", 16)
    draw = random.Random(2)
    word = lambda: f"w{draw.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(6):
        base = [word() for _ in range(draw.choice([30, 120, 300]))]
        now = list(base)
        for _ in range(25):
            edited = list(now if g % 2 else base)
            for _ in range(max(1, len(base) // 60)):
                edited[draw.randrange(len(edited))] = word()
            now = edited
            rows.append(edited)
    rows += [[*[word() for _ in range(draw.choice([3, 15, 40, 90]))], *passage, *[word() for _ in range(draw.choice([0, 5, 60]))]] for _ in range(80)]
    rows += [passage] * 9
    draw.shuffle(rows)
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id bigint, text string").repartition(5)
    check_components(df, 4)


def test_rows_that_share_a_key_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    df = spark.createDataFrame([(5, a), (5, b), (3, a), (9, b), (7, c)], "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id) for r in near_dups.near_duplicates(df).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7)}


def test_one_row_of_each_component_stays_whatever_its_key(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    near = d.replace("d29", "other")
    rows = [(5, a), (5, b), (3, a), (9, b), (7, c), (7, c), (7, "another text of its own"), (None, c), (None, d), (None, d), (None, near), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = near_dups.drop_near_duplicates(df)
    assert kept.schema == df.schema
    got = sorted(map(tuple, kept.collect()), key=repr)
    last = [r for r in got if r[1] in (d, near)]
    assert len(last) == 1 and last[0][0] is None  # which of the keyless copies is open
    want = [(3, a), (5, b), (7, c), (7, "another text of its own"), (None, ""), (None, None)]
    assert sorted([r for r in got if r not in last], key=repr) == sorted(want, key=repr)


# Mixing ---------------------------------------------------------------------


def water_level(sizes, weights, most):
    total, left, target = float(sum(sizes)), set(range(len(sizes))), {}
    rest = total
    while left:
        share = sum(weights[i] for i in left)
        over = {i for i in left if rest * weights[i] / share >= most * sizes[i]}
        if not over:
            return [target.get(i, rest * weights[i] / share if i in left else 0) for i in range(len(sizes))]
        for i in over:
            target[i] = most * sizes[i]
            rest -= target[i]
        left -= over
    return [target[i] for i in range(len(sizes))]


def test_buckets_of_heavy_and_light_documents(spark):
    """A source of tables and code has no bucket above 0.26 of a source's documents an octave, as plain text has none."""
    drawn = spark.range(200_000).select((F.shiftrightunsigned(F.xxhash64("id"), 11) + 0.5).alias("u")).select((-F.log(F.col("u") / float(1 << 53))).alias("e"), F.rand(1).alias("r"))
    for weight in (F.lit(1.0), F.lit(1 / 17), F.when(F.col("r") < 0.5, 1 / 17).otherwise(1.0), 1 / (1 + 20 * F.col("r"))):
        sizes = [r["count"] for r in drawn.groupBy(mixing.bucket_of(F.col("e") / weight, F.lit(50))).count().collect()]
        assert sum(sizes) == 200_000 and max(sizes) < 0.27 * 200_000 / 50 * 1.1


def test_sharing_goes_on_until_nothing_is_left(spark):
    """Sources whose sizes double cap one after another."""
    sizes = [2**i for i in range(24)] + [2**40]
    sources = spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "source string, source_size bigint")
    got = [(r.source_size, r.target) for r in mixing.targets(sources, (5, 2, 1), 3).collect()]
    assert sum(t for _, t in got) == pytest.approx(sum(sizes)) and all(t <= 3 * n for n, t in got)


@pytest.mark.parametrize("bucket", [3, 4096])
def test_mix_meets_the_targets(spark, odd, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", bucket)
    for df in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd):
        rows = df.collect()
        by_source = defaultdict(list)
        for r in rows:
            by_source[r.source].append(len(brute.WORDS.findall(r.text or "")))
        names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
        want = dict(zip(names, water_level([sum(by_source[s]) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
        source_of = {r.doc_id: r.source for r in rows}
        got = mixing.mix(df).collect()
        assert len(got) == len(rows)
        taken = defaultdict(int)
        for r in got:
            s = source_of[r.doc_id]
            assert r.source_size == sum(by_source[s]) and r.target == pytest.approx(want[s], rel=1e-9)
            assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
            # complete epochs before the fraction
            assert r.copies - int(r.target // r.source_size if r.source_size else 0) in (0, 1)
            taken[s] += r.taken
        for s in names:
            assert abs(taken[s] - want[s]) <= max(by_source[s]) / 2 + 1e-6
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(empty(odd)).count() == 0


def test_keys_favour_weight(spark):
    """The first drawn document is heavy as often as its weight says."""
    text = "a b c d e f g h"
    df = spark.createDataFrame([(i, f"{text} {'!' * 4 if i % 2 else 'x'} {i}", "one") for i in range(4000)], "doc_id bigint, text string, source string")
    heavy = F.col("doc_id") % 2 == 0
    unit = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(0)), 11) + 0.5) / float(1 << 53)
    keyed = df.select(heavy.alias("heavy"), (-F.log(unit) / mixing.quality_weight("text")).alias("k")).toPandas().sort_values("k").heavy.to_numpy()
    w = 1 / (1 + 4.0 * 4 / 10)
    assert keyed[:400].mean() == pytest.approx(1 / (1 + w), abs=0.08)


# WARC -----------------------------------------------------------------------


RECORD = "record_id bigint, url string, captured_at bigint, status int, etag string, last_modified string, headers map<string,string>, payload_digest string, payload_length bigint, canonical_url string, resolved string"


@pytest.mark.parametrize("block", [4, 8192])
def test_revisits_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(revisits, "BLOCK_ROWS", block)
    draw = random.Random(7)
    rows = []
    for i in range(400):
        host = "hot.org" if draw.random() < 0.6 else draw.choice(["a.com", "WWW.a.com:80", "b.net"])
        url = f"http://{host}/p{'?b=2&a=1&utm_source=x' if draw.random() < 0.3 else '?a=1&b=2'}#f{i}"
        headers = {"Date": f"d{i}", "Content-Length": str(i)} if draw.random() < 0.9 else None
        rows.append((i, url, draw.randrange(120) if draw.random() < 0.95 else None, draw.choice([200, 304, 304, 404]), draw.choice(["e1", "W/e1", "e2", None]), draw.choice(["m1", None]), headers, f"p{i}", i, "clash", "clash"))
    rows.append((1000, None, 5, 304, "e1", None, None, None, None, None, None))
    rows.append((1001, None, 5, 200, "e1", None, None, None, None, None, None))
    df = spark.createDataFrame(rows, RECORD).repartition(6)
    canon = lambda u: u and u.split("#")[0].lower().replace("http://", "").replace("www.", "").replace(":80", "").split("?")[0] + "?a=1&b=2"
    got = {r.record_id: r for r in revisits.resolve_revisits(df).collect()}
    assert len(got) == sum(r[3] == 304 for r in rows)
    for r in (r for r in rows if r[3] == 304):
        g = got[r[0]]
        before = [f for f in rows if f[3] == 200 and None not in (f[1], f[2], r[1], r[2]) and canon(f[1]) == canon(r[1]) and f[2] < r[2]]
        f = max(before, key=lambda f: (f[2], f[0]), default=None)
        assert g.canonical_url == canon(r[1]) and g.refers_to == (f and f[0]), (r, g)
        strip = lambda e: e.removeprefix("W/")
        kind = None if f is None else "etag" if r[4] and f[4] else "last-modified" if r[5] and f[5] else None
        ok = bool(kind and (strip(r[4]) == strip(f[4]) if kind == "etag" else r[5] == f[5]))
        assert (g.validator, g.resolved) == (kind, ok)
        if ok:
            stored = {k.lower(): v for k, v in (f[6] or {}).items()}
            fresh = {k.lower(): v for k, v in (r[6] or {}).items() if k.lower() not in revisits.BODY_HEADERS}
            assert dict(map(tuple, g.headers)) == stored | fresh and g.payload_digest == f[7] and g.payload_length == f[8]
        else:
            assert g.headers is None and g.payload_digest is None
    assert revisits.resolve_revisits(empty(df)).count() == 0


def test_canonical_url(spark):
    pairs = {
        "HTTPS://WWW.Example.com:443/A/b/?z=1&a=2&utm_source=q#x": "example.com/A/b?a=2&z=1",
        "http://example.com": "example.com/",
        "example.com/?ref=1": "example.com/",
        "http://example.com:8080/x?": "example.com:8080/x",
    }
    rows = spark.createDataFrame([(k,) for k in pairs], "url string").select("url", revisits.canonical_url("url").alias("c")).collect()
    assert {r.url: r.c for r in rows} == pairs


# URL filter -----------------------------------------------------------------


def judge(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = brute.re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
        host, path = m[1].translate(brute.LOWER), m[2]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


def test_urls_equal_brute_force(spark, monkeypatch):
    # digests that collide: the strings tell them apart
    for digest in (url_filter.digest, lambda text: len(text) % 3):
        monkeypatch.setattr(url_filter, "digest", digest)
        urls = [None, "", "no scheme/en/", "http://", "http:///en/", "http://com", "http://com/", "HTTP://A.EXAMPLE.COM/en/x?q#f", "http://example.com/en", "x://www.example.com/en/?", "a://b://c.net/fr/",
                "http://net/es/", "http://xnet/es/", "http://a.net?/es/", "http://a.net#/es/", "http://a..net/es/1", "http://net./es/", "http://www.example.com/de", "http://üñ.NET/fr/é", "http://" + "a." * 500 + "net/fr/" + "x" * 3000]
        df = spark.createDataFrame([*enumerate(urls), (None, "http://q.net/es/"), (3, "http://")], "page_id bigint, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "_url": F.lit(3)})
        rules = [*queries.URL_RULES, ("é", "/q", "block")]
        # the rules travel to the workers as a file: digests of both sides must be of one kind
        path = f"/tmp/rules-{random.random()}"
        url_filter.Rules.write(rules, path)
        found = url_filter.Rules(path).judge([url_filter.parts_of(u) for u in urls])
        assert [(*url_filter.parts_of(u), r, v or "allow") for u, (r, v) in zip(urls, found, strict=True)] == [judge(u, rules) for u in urls]
        monkeypatch.undo()
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {(i, *judge(u, rules)) for i, u in [*enumerate(urls), (None, "http://q.net/es/"), (3, "http://")]}
    listed = url_filter.filter_urls(df, [], [("net", "/es/", "block")])
    blocked = sum(judge(u, [("net", "/es/", "block")])[3] == "block" for u in [*urls, "http://q.net/es/"])
    assert listed.filter("verdict = 'block'").count() == blocked and listed.filter("rule IS NOT NULL").count() == 0
    assert url_filter.filter_urls(empty(df), rules).count() == 0


# SQL ------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name, tmp_path):
    import duckdb

    folder = "/root/testdata/sf0.01"
    queries.QUERIES[name](spark, folder).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'; CREATE VIEW got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    con.execute(f"CREATE TABLE want AS {queries.SQL[name]}")
    columns = [c for (c,) in con.execute("SELECT column_name FROM (DESCRIBE want)").fetchall()]
    assert sorted(columns) == sorted(c for (c,) in con.execute("SELECT column_name FROM (DESCRIBE got)").fetchall())
    cols = ", ".join(columns)
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == []


# Pipeline -------------------------------------------------------------------


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    seen = docs
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, "/root/testdata/sf0.01").write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: getattr(r, "text", None) for r in seen.collect()}
        assert set(after) <= set(before)
        if k < 4:
            assert seen.schema == docs.schema
        if name == "near_duplicates":
            comp = brute.components(before, 5)
            assert set(after) == {i for i in before if comp[i] == i}
        if name == "decontamination":
            assert set(after) == {i for i in before if not brute.contamination(before[i], bench)[-1]}
        if name == "secrets":
            assert set(after) == set(before) and not any(brute.base_spans(t) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not brute.base_spans(t))
        if name == "mixing":
            assert set(after) == set(before)
        before = after
    total = seen.agg(F.sum("taken"), F.sum("size")).first()
    assert total[0] == pytest.approx(total[1], rel=0.05)


def test_run_takes_odd_rows(spark, odd, tmp_path):
    for name, df in (("odd", odd), ("none", empty(odd))):
        folder = f"{tmp_path}/{name}"
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None), (2, "a benchmark item of a few words")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert len(rows) == 0 if name == "none" else {1, 2, 3, None} <= {r.doc_id for r in rows}
    assert math.isfinite(np.sum([r.target for r in rows] or [0]))
