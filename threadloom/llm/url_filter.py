"""URL filter: rules in a sorted array of digests that tasks map into memory."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.common import LOWER, UPPER

#: Most bytes of rules that one file may hold.
MOST_BYTES = 1 << 30
TO_LOWER = str.maketrans(UPPER.decode(), LOWER.decode())
SPLIT = "\x00"


def parts_of(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return rest[:end].translate(TO_LOWER), tail[:stop]


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


class Rules:
    """Rules ``(host, path, verdict)`` as arrays: digests in order, and the full strings behind them.

    The key of a rule is its host and path.  A rule's host alone is a key too,
    so that paths are only tried for hosts that have rules.
    """

    @staticmethod
    def write(rules: Sequence[tuple[str, str, str]], path: str) -> None:
        last = {(h.translate(TO_LOWER), p): v for h, p, v in rules}
        keys = {h + SPLIT + p: v for (h, p), v in last.items()} | {h: "" for h, _ in last}
        entries = sorted((digest(k), k.encode(), v.encode()) for k, v in keys.items())
        strings = [k + SPLIT.encode() + v for _, k, v in entries]
        ends = np.cumsum([0, *map(len, strings)])
        if 16 * len(entries) + int(ends[-1]) > MOST_BYTES:
            raise ValueError("more rules than one file may hold; filter by parts of the list one after another")
        hosts, lengths = [len(h) for h, _ in last], sorted({len(p) for _, p in last})
        head = np.array([len(entries), max(hosts, default=0), len(lengths), *lengths], np.int64)
        digests = np.array([d for d, _, _ in entries], np.uint64)
        with open(path, "wb") as f:
            f.write(b"".join([head.tobytes(), digests.tobytes(), ends.astype(np.int64).tobytes(), *strings]))

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, mode="r")
        n, self.longest_host, k = (int(x) for x in data[:24].view(np.int64))
        self.lengths = data[24 : 24 + 8 * k].view(np.int64).tolist()
        at = 24 + 8 * k
        self.digests = data[at : at + 8 * n].view(np.uint64)
        self.ends = data[at + 8 * n : at + 16 * n + 8].view(np.int64)
        self.strings = data[at + 16 * n + 8 :]

    def find(self, keys: list[str]) -> list[str | None]:
        """The verdict of each key, or None: one vectorised binary search, then a look at the full string."""
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        low = np.searchsorted(self.digests, wanted, "left")
        high = np.searchsorted(self.digests, wanted, "right")
        out: list[str | None] = [None] * len(keys)
        for i in np.flatnonzero(high > low):
            for j in range(low[i], high[i]):
                key, _, verdict = self.strings[self.ends[j] : self.ends[j + 1]].tobytes().decode().rpartition(SPLIT)
                if key == keys[i]:
                    out[i] = verdict
        return out

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """Rule and verdict of each (host, path); None without a rule.  The longest rule wins."""
        hosts: dict[str, list[str]] = {}
        for host in {h for h, _ in urls}:
            labels = [host, *(host[i + 1 :] for i, c in enumerate(host) if c == ".")] if host else []
            hosts[host] = [x for x in labels if len(x) <= self.longest_host]
        known = sorted({x for found in hosts.values() for x in found})
        ruled = {h for h, v in zip(known, self.find(known), strict=True) if v is not None}
        tries = [(i, h, path[:n]) for i, (host, path) in enumerate(urls) for h in hosts[host] if h in ruled for n in self.lengths if n <= len(path)]
        best: dict[int, tuple[int, int, str, str]] = {}
        for (i, h, p), verdict in zip(tries, self.find([h + SPLIT + p for _, h, p in tries]), strict=True):
            if verdict is not None:
                best[i] = max(best.get(i, (-1, 0, "", "")), (len(h) + len(p), len(h), h + p, verdict))
        return [best[i][2:] if i in best else (None, None) for i in range(len(urls))]


def ship(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> str:
    """Write the arrays and hand the file to Spark, which brings it to every executor, also to later ones.

    The driver's copy lies in Spark's own folder for added files and goes with the session.
    """
    name = f"rules-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(dir=SparkFiles.getRootDirectory())
    Rules.write(rules, os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    more: Sequence[tuple[str, str, str]] = (),
    default: str = "allow",
    url: str = "url",
    key: str = "page_id",
) -> DataFrame:
    """``(key, host, path, rule, verdict)`` of every row.

    A rule ``(host, path, verdict)`` fits its host and all its subdomains if
    the path starts with the rule's; the longest one wins and is shown.  Where
    none fits, ``more`` (a block list of the same form, not shown as a rule)
    decides in the same way, and then ``default``.

    Each list is one file of sorted 64-bit digests with the full strings
    behind them, at most ``MOST_BYTES``, which every executor maps into
    memory: its workers share the pages.  Equal digests of other strings are
    told apart by the strings.  If a list has a host and path twice, the later
    verdict holds.

    Null URLs and URLs without ``://`` have an empty host and path and take
    ``default``.  Null keys stay null, repeated rows are judged each, other
    columns are not returned.
    """
    spark = pages.sparkSession
    names = [ship(spark, rules), ship(spark, more)]
    source = pages.select(pages[key], pages[url].alias("_url"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = (Rules(SparkFiles.get(name)) for name in names)
        for batch in batches:
            urls = list(map(parts_of, batch.column(1).to_pylist()))
            shown, hidden = first.judge(urls), second.judge(urls)
            verdicts = [v or w or default for (_, v), (_, w) in zip(shown, hidden, strict=True)]
            hosts, paths = zip(*urls, strict=True) if urls else ((), ())
            columns = [hosts, paths, [r for r, _ in shown], verdicts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], [key, "host", "path", "rule", "verdict"])

    return source.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")
