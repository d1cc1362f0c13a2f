"""Benchmark decontamination with suffix arrays over shards of the training text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import LOWERED, slices
from threadloom.session import cut_lineage

#: Consecutive words that make a window.
WINDOW = 13
#: Words of one shard; its suffix array is built and searched by one task.
SHARD_WORDS = 1_000_000
#: Bytes of benchmark text searched in one pass; a larger benchmark takes several.
BLOCK_BYTES = 4 << 20

#: Letters to lower case, every other ASCII byte than letters and digits to a space.
WORD_BYTES = bytes(LOWERED[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


class Tests:
    """The windows of a block of benchmark items, and where they come from.

    Words have numbers from 1; 0 is a word no item has.  ``words`` holds all
    items one after another, each followed by a 0.  ``groups`` has, by window
    length, the distinct windows in sorted order and the items of each.
    """

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        runs, self.starts, at = [], [], 0
        for _, text in items:
            words = words_of(text or "")
            runs.append(np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in words), np.uint32, len(words)))
            self.starts.append(at)
            at += len(words) + 1
        self.words = np.concatenate([np.append(r, np.uint32(0)) for r in runs]) if runs else np.zeros(0, np.uint32)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for k, run in enumerate(runs):
            size = min(window, len(run))
            for j in range(len(run) - size + 1 if size else 0):
                by_length.setdefault(size, []).append((self.starts[k] + j, k))
        self.groups = {}
        for size, places in sorted(by_length.items()):
            at, item = np.array(places, np.int64).T
            keys = suffix_keys(self.words, at, size)
            distinct, which = np.unique(keys, return_inverse=True)
            order = np.argsort(which, kind="stable")
            bounds = np.searchsorted(which[order], np.arange(len(distinct) + 1))
            self.groups[size] = (distinct, at[order], item[order], bounds)


def suffix_keys(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` words of the suffixes at ``at``, as bytes that sort like the words."""
    found = words[at[:, None] + np.arange(size)].astype(">u4")
    return np.ascontiguousarray(found).view(f"V{4 * size}").ravel()


def suffix_array(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a shard that can match ``size`` words, in sorted order, and their keys.

    A suffix with a word that no item has among its first ``size`` words can
    match no window and is left out (a sparse suffix array).  Suffixes are
    ordered by as many words as a window has; longer matches are followed
    from there.
    """
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, f"V{4 * size}")
    known = np.concatenate([[0], np.cumsum(words > 0)])
    at = np.flatnonzero(known[size:] - known[:-size] == size)
    keys = suffix_keys(words, at, size)
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def follow(words: np.ndarray, at: np.ndarray, tests: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """Length of the match of each suffix pair that agrees in ``size`` words."""
    length = np.full(len(at), size, np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        a, b = at[open_] + length[open_], to[open_] + length[open_]
        inside = (a < len(words)) & (b < len(tests))
        open_, a, b = open_[inside], a[inside], b[inside]
        open_ = open_[(words[a] == tests[b]) & (words[a] > 0)]
        length[open_] += 1
    return length


#: Suffix pairs whose matches are followed at once.
PAIRS = 1 << 20


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``counts[i]`` numbers from ``starts[i]`` on, for every i, and the i of each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return starts[which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts), which


class Found:
    """What the search of a shard gives: hit words, (document, item) pairs, longest matches."""

    def __init__(self, words: np.ndarray, doc_of: np.ndarray, n_docs: int, tests: Tests) -> None:
        self.hits = np.zeros(len(words) + 1, np.int64)
        self.pairs: list[np.ndarray] = []
        self.longest = [(0, 0, 0)] * n_docs  # words, less the place, less the item
        for size, (distinct, at, item, bounds) in tests.groups.items():
            suffixes, keys = suffix_array(words, size)
            if len(suffixes):
                low, high = np.searchsorted(keys, distinct, "left"), np.searchsorted(keys, distinct, "right")
                where, window = spread(low, high - low)
                places = suffixes[where]
                np.add.at(self.hits, places, 1)
                np.add.at(self.hits, places + size, -1)
                times = np.diff(bounds)[window]
                for some in np.split(np.arange(len(places)), np.flatnonzero(np.diff(np.cumsum(times) // PAIRS)) + 1):
                    if len(some):
                        test, k = spread(bounds[window[some]], times[some])
                        self.add(words, doc_of, tests, places[some][k], at[test], item[test], size)

    def add(self, words: np.ndarray, doc_of: np.ndarray, tests: Tests, place: np.ndarray, at: np.ndarray, item: np.ndarray, size: int) -> None:
        """Suffixes of the shard at ``place`` that agree with tests at ``at`` in ``size`` words."""
        self.pairs.append(np.unique(doc_of[place] * len(tests.items) + item))
        # a match that goes on from the word before is followed from there
        new = (words[place - 1] == 0) | (words[place - 1] != tests.words[at - 1])
        place, at, item = place[new], at[new], item[new]
        length, doc = follow(words, place, tests.words, at, size), doc_of[place]
        order = np.lexsort((item, place, -length, doc))
        for k in order[np.unique(doc[order], return_index=True)[1]]:
            self.longest[doc[k]] = max(self.longest[doc[k]], (int(length[k]), -int(place[k]), -int(item[k])))


def search_shard(tests: Tests, texts: list[str]) -> list[dict]:
    """Of each text: ``n_words``, ``n_hit``, ``hit`` (a bit a word), ``items``, ``longest_words``, ``longest_at``, ``longest_item``."""
    nothing = np.zeros(1, np.uint32)  # before and between texts: no match crosses it
    numbers, lengths = [nothing], []
    for t in texts:
        words = words_of(t)
        lengths.append(len(words))
        numbers += [np.fromiter(map(tests.number.get, words, repeat(0)), np.uint32, len(words)), nothing]
    starts = 1 + np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + 1)])
    doc_of = np.repeat(np.arange(-1, len(texts)), np.array([1, *(n + 1 for n in lengths)]))
    found = Found(np.concatenate(numbers), doc_of, len(texts), tests)
    items: list[set[str]] = [set() for _ in texts]
    for pairs in found.pairs:
        for d, i in zip((pairs // len(tests.items)).tolist(), (pairs % len(tests.items)).tolist(), strict=True):
            items[d].add(str(tests.items[i]))
    hit, out = np.cumsum(found.hits) > 0, []
    for d, n in enumerate(lengths):
        words, place, item = found.longest[d]
        out.append(
            {
                "n_words": n,
                "n_hit": int(hit[starts[d] : starts[d] + n].sum()),
                "hit": np.packbits(hit[starts[d] : starts[d] + n]).tobytes(),
                "items": sorted(items[d]),
                "longest_words": words,
                "longest_at": -place - int(starts[d]) if words else None,
                "longest_item": str(tests.items[-item]) if words else None,
            }
        )
    return out


def merged(a: dict, b: dict) -> dict:
    """What two blocks of a benchmark give for one text."""
    hit = np.frombuffer(a["hit"], np.uint8) | np.frombuffer(b["hit"], np.uint8)
    best = a if a["longest_words"] >= b["longest_words"] else b
    return a | {"hit": hit.tobytes(), "n_hit": int(np.unpackbits(hit).sum()), "items": sorted({*a["items"], *b["items"]})} | {k: best[k] for k in best if k.startswith("longest")}


FOUND = "struct<n_words:bigint,n_hit:bigint,hit:binary,items:array<string>,longest_words:bigint,longest_at:bigint,longest_item:string>"


def shards(batches: Iterator[pa.RecordBatch], at: int, limit: int = SHARD_WORDS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows in pieces of about ``limit`` words (six bytes each); a longer text is a piece of its own."""
    for batch in slices(batches):
        found = ["" if t is None else t for t in batch.column(at).to_pylist()]
        start = size = 0
        for i, t in enumerate(found):
            if size and size + len(t) > 6 * limit:
                yield batch.slice(start, i - start), found[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(found):
            yield batch.slice(start), found[start:]


def blocks(benchmark: DataFrame, text: str, key: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of at most ``most`` bytes of text (an item of more is a block)."""
    block: list[tuple[object, str]] = []
    size = 0
    for row in benchmark.select(benchmark[key].alias("k"), benchmark[text].alias("t")).toLocalIterator():
        new = len((row["t"] or "").encode())
        if block and size + new > most:
            yield block
            block, size = [], 0
        block.append((row["k"], row["t"] or ""))
        size += new
    if block:
        yield block


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int, text: str, item_text: str, item_key: str, drop_text: bool) -> DataFrame:
    """``docs`` with a struct ``_found``; one pass a block of the benchmark, the last of which may empty ``text``."""
    spark, at = docs.sparkSession, docs.columns.index(text)
    out = docs.withColumn("_found", F.lit(None).cast(FOUND))
    parts = blocks(benchmark, item_text, item_key)
    block = next(parts, [])
    while block is not None:
        later = next(parts, None)
        shared, schema = spark.sparkContext.broadcast(block), out.schema

        def run(batches: Iterator[pa.RecordBatch], shared=shared, empty=drop_text and later is None) -> Iterator[pa.RecordBatch]:
            tests = Tests(shared.value, window)
            for batch, found in shards(batches, at):
                last = batch.num_columns - 1
                old = batch.column(last).to_pylist()
                new = search_shard(tests, found)
                rows = [n if o is None else merged(o, n) for o, n in zip(old, new, strict=True)]
                if empty:
                    batch = batch.set_column(at, batch.schema.field(at), pa.nulls(len(rows), batch.schema.field(at).type))
                yield batch.set_column(last, batch.schema.field(last), pa.array(rows, batch.schema.field(last).type))

        out = out.mapInArrow(run, schema)
        out, block = (out if later is None else cut_lineage(out)), later
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
) -> DataFrame:
    """Matches of every row with the benchmark.

    ``(key, n_words, n_hit, items, longest_words, longest_at, longest_item,
    contaminated)``: words, words inside an occurrence of a benchmark window,
    the items with such windows (as strings, sorted), the longest verbatim
    match with its first word and item, and the verdict (``n_hit > 0`` and
    ``20 * n_hit >= n_words``).

    Each task cuts its rows into shards, sorts the suffixes of a shard and
    searches every suffix of the benchmark in it; nothing is shuffled.  The
    benchmark is a stated query set and comes in blocks of ``BLOCK_BYTES``,
    so what a task holds does not grow with it.

    Null and empty texts have no words and no hits; a null or empty item has
    no window.  An empty benchmark hits nothing.  Equal items and repeated
    rows count each; null keys stay null; other columns are not returned.
    """
    found = with_matches(docs.select(docs[key].alias(key), docs[text].alias("_text")), benchmark, window, "_text", item_text, item_key, drop_text=True)
    n, hits = F.col("_found.n_words"), F.col("_found.n_hit")
    return found.select(
        key,
        n.alias("n_words"),
        hits.alias("n_hit"),
        F.col("_found.items").alias("items"),
        F.col("_found.longest_words").alias("longest_words"),
        F.col("_found.longest_at").alias("longest_at"),
        F.col("_found.longest_item").alias("longest_item"),
        ((hits > 0) & (20 * hits >= n)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that ``contamination`` finds clean, with all their columns."""
    found = with_matches(docs, benchmark, WINDOW, text, item_text, item_key, drop_text=False)
    hits = F.col("_found.n_hit")
    return found.filter((hits == 0) | (20 * hits < F.col("_found.n_words"))).drop("_found")
