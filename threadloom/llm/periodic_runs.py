"""Runs of words: stretches that repeat with some period, as far as they go.

A run's Lyndon root is the longest Lyndon word at its place under one of the
two orders of the alphabet (the given one or its reverse).  The Lyndon arrays
of both orders come directly from the first phase of Baier's suffix sorter,
which groups positions by their longest Lyndon word.  Each root is then
extended to both sides by longest common extensions.

Texts are cut down first to the stretches that runs can lie in: with at least
``PROBE * 2`` words, a run of period q has every window of ``PROBE`` words
that starts in it again q words on or back, but for at most ``PROBE - 1``
windows in a row around its middle.  A text without repeated windows, as most
prose, has no run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm.common import slices, texts

#: Steps of common extensions are powers of two up to 2**TOP_LEVEL words; longer ones take several of the largest.
TOP_LEVEL = 12
#: Texts whose stretches are sorted together.
TEXTS_AT_ONCE = 256

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def lyndon_lengths(s: list[int], letters: int) -> list[int]:
    """Length of the longest Lyndon word at each position, by the grouping phase of Baier's suffix sorter.

    ``s`` holds letters 0 to ``letters - 1``.  Groups hold positions with the
    same Lyndon word found so far and are linked in the order of these words.
    They are taken from the largest down.  The nearest earlier position in a
    smaller group is followed by the words of this group, once for each member
    that looks back to it: it moves to a group for the longer word, right
    above its own.
    """
    n = len(s)
    group = list(s)
    members: list[list[int]] = [[] for _ in range(letters)]
    for i, letter in enumerate(s):
        members[letter].append(i)
    size = [1] * letters
    lower, upper = list(range(-1, letters - 1)), list(range(1, letters + 1))
    upper[-1] = -1
    done = bytearray(n)
    before, length = [-1] * n, [0] * n
    g = letters - 1
    while g >= 0:
        word = size[g]
        mine = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in mine:
            done[i] = 1
        grown: dict[tuple[int, int], list[int]] = {}
        at, times = -1, 0
        for i in mine:
            length[i] = word
            j = i - 1
            while j >= 0 and done[j]:
                k = before[j]
                if k >= 0 and done[k]:
                    before[j] = before[k]
                j = k
            before[i] = j
            if j == at:
                times += 1
                continue
            if at >= 0:
                grown.setdefault((times, group[at]), []).append(at)
            at, times = j, 1
        if at >= 0:
            grown.setdefault((times, group[at]), []).append(at)
        for times, h in sorted(grown, reverse=True):
            new, above = len(size), upper[h]
            moved = grown[times, h]
            for j in moved:
                group[j] = new
            members.append(moved)
            size.append(size[h] + times * word)
            lower.append(h)
            upper.append(above)
            upper[h] = new
            lower[above] = new
        g = lower[g]
    return length


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Extensions:
    """How far two places of a sequence agree, for many pairs at once, by fingerprints of 1, 2, 4, ... items."""

    def __init__(self, items: np.ndarray) -> None:
        self.n = len(items)
        first = items.astype(np.uint64)
        self.levels = [_mixed(first, first)]
        while len(self.levels) <= TOP_LEVEL and 2 << (len(self.levels) - 1) <= self.n:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_mixed(last[:-step], last[step:]))

    def agree(self, a: np.ndarray, b: np.ndarray, forward: bool, most: np.ndarray | None = None) -> np.ndarray:
        """Common length of what starts (or, backwards, ends) at ``a`` and ``b``, where ``a < b``; up to ``most``."""
        total = np.zeros(len(a), np.int64)
        room = self.n - b if forward else a
        room = room if most is None else np.minimum(room, most)
        for k in range(len(self.levels) - 1, -1, -1):
            step, prints = 1 << k, self.levels[k]
            active = np.arange(len(a))
            while len(active):
                active = active[total[active] + step <= room[active]]
                off = total[active] if forward else -total[active] - step
                active = active[prints[a[active] + off] == prints[b[active] + off]]
                total[active] += step
                if k < len(self.levels) - 1:
                    break
        return total


def find_runs(items: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs of at least ``min_length`` items, by start and period."""
    n = len(items)
    if n < min_length:
        return (np.zeros(0, np.int64),) * 3
    letters, ranks = np.unique(items, return_inverse=True)
    places, roots = [], []
    for order in (ranks, len(letters) - 1 - ranks):
        lengths = np.array(lyndon_lengths(order.tolist(), len(letters)), np.int64)
        places.append(np.arange(n))
        roots.append(lengths)
    at, root = np.concatenate(places), np.concatenate(roots)
    extensions = Extensions(ranks)
    # one root of a run lies within its first period; the others are the same run
    left = extensions.agree(at, at + root, forward=False, most=root)
    first = left < root
    at, root, left = at[first], root[first], left[first]
    right = extensions.agree(at, at + root, forward=True)
    length = left + root + right
    found = (length >= 2 * root) & (length >= min_length)
    runs = np.unique(np.stack([at - left, root, length], 1)[found], axis=0)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def stretches(items: np.ndarray, owner: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that runs of ``2 * probe`` items or more can lie in; none crosses an owner."""
    none = np.zeros(0, np.int64)
    if len(items) < 2 * probe:
        return none, none
    prints = _mixed(items.astype(np.uint64), owner.astype(np.uint64))
    windows = prints[: len(prints) - probe + 1]
    for k in range(1, probe):
        windows = _mixed(windows, prints[k : len(prints) - probe + 1 + k])
    whole = np.flatnonzero(owner[: len(windows)] == owner[probe - 1 :])
    windows = windows[whole]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(len(whole), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = whole[again]
    if not len(at):
        return none, none
    cut = np.flatnonzero((np.diff(at) > probe) | (np.diff(owner[at]) != 0))
    starts, ends = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + probe
    long = ends - starts >= 2 * probe
    return starts[long], ends[long]


def runs_of(words: list[list[bytes]], min_length: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, as ``(start, length, period)`` by start and period."""
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = [len(w) for w in words]
    items = np.fromiter((ids[x] for w in words for x in w), np.int64, sum(sizes))
    owner = np.repeat(np.arange(len(words)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    starts, ends = stretches(items, owner, min_length // 2)
    if not len(starts):
        return out
    # all stretches as one sequence, each ended by an item of its own, which no run can hold
    parts = [np.append(items[a:b], len(ids) + k) for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))]
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    start, length, period = find_runs(np.concatenate(parts), min_length)
    part = np.searchsorted(begins, start, side="right") - 1
    start = start - begins[part] + starts[part]
    text = owner[start]
    for t, *run in sorted(zip(text.tolist(), (start - first[text]).tolist(), period.tolist(), length.tolist(), strict=True)):
        out[t].append((run[0], run[2], run[1]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, each run cut down to its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(compress(words, keep.tolist()))


def periodic_runs(docs: DataFrame, min_length: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, runs, collapsed)`` of each document.

    Words are what ASCII white space separates.  A run has a smallest period
    q, at least ``max(min_length, 2 * q)`` words, and no neighbouring word
    that goes on with period q; ``runs`` lists them by start and period, with
    word numbers from 0.  ``collapsed`` is the text without the words of any
    run that come after the run's first q.

    One pass without a shuffle; a task holds ``TEXTS_AT_ONCE`` texts.  A null
    or empty text has no words, no run and an empty ``collapsed``.  Rows are
    judged one by one, so repeated rows and keys, also null ones, each give a
    row; an empty table gives none.  Other columns, whatever their names, are
    left out.
    """
    if min_length < 2:
        raise ValueError("min_length must be 2 at least")
    kept = docs.select(docs[key], docs[text].alias("_text"))
    kind = kept.schema[0].dataType.simpleString()
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS_AT_ONCE):
            words = [t.encode().split() for t in texts(batch, "_text")]
            runs = runs_of(words, min_length)
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array(rows, runs_type),
                    pa.array([collapsed(w, r).decode() for w, r in zip(words, runs, strict=True)], pa.string()),
                ],
                [key, "n_words", "runs", "collapsed"],
            )

    return kept.mapInArrow(work, f"`{key}` {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
