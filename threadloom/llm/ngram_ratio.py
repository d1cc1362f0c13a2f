"""Quality rules: the log-likelihood ratio of hashed n-grams between a trusted and the raw corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ASCII_SPACE, Memo, passes, slices, texts
from threadloom.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
#: Hash buckets of the two multinomials: a power of two that follows the corpus between these bounds.  Both tables
#: of counts go to every task (4 MB at most), and a task passes on a count for each bucket it used.
FEWEST_BUCKETS, MOST_BUCKETS = 1 << 13, 1 << 18
#: Bytes of text for each bucket, about one for each word.
BUCKET_BYTES = 8
#: Counts that a bucket is taken to have besides its own: a few occurrences say little.
PULL = 2.0
#: Steps in which ratios are counted to find the threshold.
STEP = 1e-4
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(memo: Memo, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def hash_word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def buckets(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of every word and of every pair of neighbouring words."""
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))
    pairs = ((hashes[:-1] * MIX) ^ hashes[1:]) * MIX
    return (np.concatenate([hashes, pairs]) >> shift).astype(np.int64)


def repeated(windows: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    return times[place] > 1


def repeat_words(words: list[bytes], hashes: np.ndarray, size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur twice or more.

    Hashes only tell that no window repeats; if some may, windows are
    compared by exact word numbers, joined pair by pair.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = rolled * MIX + hashes[k : k + n]
    rolled.sort()
    if not (rolled[1:] == rolled[:-1]).any():
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    window = ids[:n]
    for k in range(1, size):
        window = np.unique(window * len(number) + ids[k : k + n], return_inverse=True)[1]
    ends = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(repeated(window))
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + size, -1)
    return int((np.cumsum(ends)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(ASCII_SPACE)]
    return len(lines) - len(set(lines))


def marked(docs: DataFrame, spot: Callable[[np.ndarray], np.ndarray], inside: bool) -> DataFrame:
    """``(_key, _text)`` of the documents whose key passes the bit map (``inside``), or of all others."""
    rows = docs.select("_key", "_text", F.xxhash64("_key").alias("_spot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = spot(batch.column(2).to_numpy(zero_copy_only=False)) == inside
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["_key", "_text"]).filter(pa.array(stay))

    return rows.mapInArrow(run, docs.schema)


def part_counts(docs: DataFrame, n_buckets: int) -> DataFrame:
    """``(bucket, n)``, one row a task and bucket: every task adds up its own documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = Memo(hash_word), np.zeros(n_buckets, np.int64)
        for batch in slices(batches):
            found = [buckets(word_hashes(memo, t.encode().split()), n_buckets) for t in texts(batch, "_text")]
            if found:
                counts += np.bincount(np.concatenate(found), minlength=n_buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    return docs.select("_text").mapInArrow(run, "bucket bigint, n bigint")


def bucket_count(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = FEWEST_BUCKETS
    while n < min(size / BUCKET_BYTES, MOST_BUCKETS):
        n *= 2
    return n


def table_of(counts: DataFrame, n_buckets: int) -> np.ndarray:
    """Counts by bucket; ``n_buckets`` rows at most reach the driver, whatever the corpus."""
    out = np.zeros(n_buckets)
    rows = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out[rows["bucket"]] = rows["n"]
    return out


def ratio(places: np.ndarray, raw: np.ndarray, target: np.ndarray, totals: tuple[float, float], trusted: bool) -> float:
    """Mean log ratio of a document's n-grams, from the counts of all other documents.

    Each n-gram compares its count in the trusted corpus with the count to be
    expected there from its share of the raw corpus.
    """
    if not len(places):
        return 0.0
    used, own = np.unique(places, return_counts=True)
    all_raw, all_target = totals[0] - len(places), totals[1] - trusted * len(places)
    expected = (raw[used] - own) * (all_target / max(all_raw, 1.0))
    return float((np.log((target[used] - trusted * own + PULL) / (expected + PULL)) * own).sum() / len(places))


def judged(rows: DataFrame, shared: Broadcast, key: str) -> DataFrame:
    """Base counts and the ratio of ``(_key, _text, _trusted)``."""
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (raw, target) = Memo(hash_word), shared.value
        totals = float(raw.sum()), float(target.sum())

        def one(text: str, trusted: bool) -> tuple:
            data = text.encode()
            words = data.split()
            n = len(words)
            hashes = word_hashes(memo, words)
            value = ratio(buckets(hashes, len(raw)), raw, target, totals, trusted)
            again = repeat_words(words, hashes)
            failed = n < 10 or 100 * again > 20 * n
            chars = len(text) - (len(data) - len(data.translate(None, ASCII_SPACE)))
            symbols = len(data) - len(data.translate(None, SYMBOLS))
            return n, chars, symbols, duplicate_lines(data), again, failed, value

        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64()]
        for batch in slices(batches):
            out = [one(t, k) for t, k in zip(texts(batch, "_text"), batch.column("_trusted").to_pylist(), strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [key, *NAMES])

    schema = f"`{key}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, ratio double"
    return rows.select("_key", "_text", "_trusted").mapInArrow(run, schema)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio"]


def threshold(ratios: DataFrame, lost: float) -> float:
    """The largest multiple of ``STEP`` below which at most a share ``lost`` of the ratios lie; without any, everything passes."""
    # one row for each step between the smallest and the largest mean ratio: some hundred thousand at most
    steps = sorted((r["s"], r["n"]) for r in ratios.groupBy(F.floor(F.col("ratio") / STEP).alias("s")).agg(F.count("*").alias("n")).collect())
    most, below = lost * sum(n for _, n in steps), 0
    for step, n in steps:
        if below + n > most:
            return step * STEP
        below += n
    return -np.inf


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    lost: float = 0.01,
    n_buckets: int | None = None,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Base counts, the n-gram ratio and the verdict of every row.

    Words are runs of bytes other than ASCII white space.  ``ratio`` is the
    mean over a document's words and word pairs of the log of how often the
    trusted corpus has them, against how often it would at their rate in the
    raw corpus.  A document is judged by the others: its own n-grams are taken
    off both counts, so being trusted doesn't speak for it.  ``trusted`` lists
    the keys of the trusted documents.  A document is kept if no base rule
    fails and its ratio is not below that of the trusted documents, of which
    a share ``lost`` (of those that pass the base rules) may fall below.
    Counts cover all documents; hash buckets grow with them up to
    ``MOST_BUCKETS``, above which more n-grams share one.

    Null is a text without words (ratio 0, fails the base rules).  If no key
    is trusted, every ratio is 0 and only base rules decide.  Null keys stay
    null and are not trusted, repeated rows count and are judged each, other
    columns are not returned; an empty table gives no rows.
    """
    both = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    ids = cut_lineage(trusted.select(F.col(key).alias("_id")).filter(F.col("_id").isNotNull()).distinct().withColumn("_hash", F.xxhash64("_id")))
    n = n_buckets or bucket_count(both)
    spot = passes(ids, "_hash")
    flag = F.col("_id").isNotNull().alias("_trusted")
    # merged at every size: the number of trusted keys has no bound
    likely = cut_lineage(marked(both, spot, True).join(ids.hint("merge"), F.col("_key") == F.col("_id"), "left").select("_key", "_text", flag))
    raw = table_of(part_counts(both, n), n)
    target = table_of(part_counts(likely.filter("_trusted"), n), n)
    shared = docs.sparkSession.sparkContext.broadcast((raw, target))
    own = cut_lineage(judged(likely, shared, "_key"))
    known = own.join(ids, F.col("_key") == F.col("_id"), "left_semi")
    least = threshold(known.filter("not base_failed"), lost)
    rest = judged(marked(both, spot, False).withColumn("_trusted", F.lit(False)), shared, "_key")
    rows = rest.unionByName(own)
    return rows.select(F.col("_key").alias(key), *NAMES, (~F.col("base_failed") & (F.col("ratio") >= F.lit(float(least)))).alias("kept"))
