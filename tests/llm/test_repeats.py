"""Repeats inside and across texts: runs, repeated windows."""

import hashlib
import random

import brute
import pytest

from threadloom.llm import periodic_runs, queries, repeated_windows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return brute.odd_docs(spark).cache()


def test_lyndon_lengths_by_their_definition():
    draw = random.Random(1)
    for _ in range(400):
        letters = draw.choice([1, 2, 3])
        s = [draw.randrange(letters) for _ in range(draw.randrange(1, 14))]
        for i, length in enumerate(periodic_runs.lyndon_lengths(s, letters)):
            lyndon = [k for k in range(1, len(s) - i + 1) if all(s[i : i + k] < s[i + x : i + k] for x in range(1, k))]
            assert length == max(lyndon), (s, i)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    draw = random.Random(least)
    for _ in range(150):
        words = []
        for _ in range(draw.randrange(1, 4)):
            n, letters = draw.randrange(0, 80), draw.choice([1, 2, 3, 5, 30])
            s = [draw.randrange(letters) for _ in range(n)]
            if n and draw.random() < 0.6:
                a, p = draw.randrange(n), draw.randrange(1, n // 2 + 2)
                s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
            words.append([b"%d" % x for x in s])
        assert periodic_runs.runs_of(words, least) == [brute.runs(w, least) for w in words]


def test_long_runs_and_longer_steps(monkeypatch):
    monkeypatch.setattr(periodic_runs, "TOP_LEVEL", 2)
    draw = random.Random(3)
    words = [[b"a"] * 5000, [b"%d" % draw.randrange(2) for _ in range(700)], [b"x", b"y", b"z"] * 300 + [b"x", b"q"]]
    assert periodic_runs.runs_of(words, 12) == [brute.runs(w, 12) for w in words]
    assert periodic_runs.runs_of(words[:1], 12) == [[(0, 5000, 1)]]


def check_op12(rows, docs):
    want = sorted((repr((r.doc_id, *brute.op12(r.doc_id, r.text or ""))) for r in docs), key=str)
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((repr(tuple(r[c] for c in names)) for r in rows), key=str) == want


def test_op12_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows = queries.op12_periodic_runs(spark, SMALL).collect()
    check_op12(rows, docs)
    assert sum(r.n_runs > 0 for r in rows) > 10


def test_periodic_runs_of_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    check_op12(queries.op12_periodic_runs(spark, str(tmp_path)).collect(), odd.collect())
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(odd).collect()}
    assert found[9].collapsed == "word" and [tuple(r) for r in found[9].runs] == [(0, 3000, 1)]
    assert found[1].n_words == 0 and found[1].runs == [] and found[1].collapsed == ""
    assert periodic_runs.periodic_runs(odd.filter("1 = 0")).count() == 0
    twice = periodic_runs.periodic_runs(odd.union(odd)).collect()
    assert sorted(repr(r) for r in twice) == sorted(repr(r) for r in periodic_runs.periodic_runs(odd).collect() * 2)


# Repeated windows ------------------------------------------------------------


def check_spans(df, width, crowd):
    docs = df.select("doc_id", "text").collect()
    raw = [(r.text or "").encode() for r in docs]
    want = [(r.doc_id, len(t), spans, hashlib.sha256(kept).hexdigest()) for r, t, (spans, kept) in zip(docs, raw, brute.repeats(raw, width), strict=True)]
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256) for r in repeated_windows.repeated_windows(df, width, crowd=crowd).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return want


@pytest.mark.parametrize(("width", "crowd"), [(7, 4096), (20, 1), (33, 4)])
def test_repeated_windows_of_small_alphabets(spark, width, crowd):
    """Edited copies, shared passages, constant and periodic texts; with and without marks that are too many to gather."""
    draw = random.Random(width)
    text = lambda n, letters: "".join(draw.choices("abcdefgh é"[:letters], k=n))
    passage, base = text(60, 9), text(300, 9)
    rows = ["z" * 200, "z" * 50, "xy" * 90, "", None, text(width, 9), passage, passage, text(400, 1)]
    rows += [text(draw.randrange(30), 9) + passage + text(draw.randrange(30), 9) for _ in range(25)]
    for _ in range(25):
        copy = list(base)
        for _ in range(draw.randrange(5)):
            copy[draw.randrange(len(copy))] = "#"
        rows.append("".join(copy))
    rows += [text(draw.randrange(100), draw.choice([2, 3, 9, 10])) for _ in range(30)]
    df = spark.createDataFrame([(k if k % 9 else None, t, 5) for k, t in enumerate(rows)], "doc_id bigint, text string, spans int").repartition(5)
    want = check_spans(df, width, crowd)
    assert sum(bool(w[2]) for w in want) > 30


def test_op13_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    raw = [r.text.encode() for r in docs]
    want = [(r.doc_id, len(t), sum(n for _, n in spans), len(spans), hashlib.sha256(kept).hexdigest()) for r, t, (spans, kept) in zip(docs, raw, brute.repeats(raw, 200), strict=True)]
    rows = queries.op13_repeated_windows(spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(want)
    assert sum(w[2] > 0 for w in want) > 10


def test_repeated_windows_of_odd_rows(spark, odd):
    check_spans(odd, 200, 4096)
    assert repeated_windows.repeated_windows(odd.filter("1 = 0")).count() == 0
    twice = odd.filter("doc_id in (1, 6, 7)").union(odd.filter("doc_id = 7"))
    check_spans(twice, 20, 4096)
    kept = repeated_windows.without_repeats(odd, 20)
    assert kept.columns == odd.columns
    raw = [(r.text or "").encode() for r in odd.collect()]
    assert sorted(bytes(r.text) for r in kept.collect()) == sorted(k for _, k in brute.repeats(raw, 20))


@pytest.mark.parametrize(("width", "crowd"), [(200, 4), (64, 1)])
def test_windows_of_a_common_passage_are_counted_by_piece(spark, monkeypatch, width, crowd):
    """Many texts with one passage, some cut short or edited near its ends: few of the windows at its ends are counted one by one."""
    draw = random.Random(width)
    text = lambda n: "".join(draw.choices("abcdefghijklmnop ", k=n))
    passage, texts = text(width + 60), []
    for k in range(60):
        cut = passage[draw.randrange(12) :] if k % 3 == 0 else passage[: len(passage) - draw.randrange(12)] if k % 3 == 1 else passage
        texts.append(text(150 + draw.randrange(150)) + cut + text(150 + draw.randrange(150)))
    counted = []
    windows = repeated_windows._piece_windows
    monkeypatch.setattr(repeated_windows, "_piece_windows", lambda pieces, n: counted.append((pieces, windows(pieces, n))) or counted[-1][1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    want = check_spans(df, width, crowd)
    assert all(w[2] for w in want)
    assert 0 < counted[0][1].count() < 60 * 2 * 40
