"""Quality classifier: a label model over heuristic labellers trains a hashed linear scorer."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Memo, map_texts, slices, texts
from threadloom.session import cut_lineage

BAD, GOOD, NONE = 0, 1, 2
#: Hash buckets of the scorer's features.
DIMS = 1024
#: Documents the scorer is fitted on (those with the smallest hash of their key); the label model sees all.
FIT_DOCS = 4000
#: Log odds below which a text goes; those of very short texts hang on a few words.
LEAST_SCORE = -0.5

SIGNS = b"#*$%&<>|~^_=+\\"
UPPER, LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
#: Bytes that end a word of prose.
CLOSING = b".,;:!?)\"']"


def between(value: float, good: float, bad: float) -> int:
    """GOOD up to ``good``, BAD from ``bad`` on, no vote between."""
    return GOOD if value <= good else BAD if value >= bad else NONE


def bytes_of(data: bytes, kinds: bytes) -> int:
    """How many bytes of ``data`` are one of ``kinds``."""
    return len(data) - len(data.translate(None, kinds))


def votes(data: bytes, words: list[bytes]) -> tuple[int, ...]:
    """What each labeller says of a text; a labeller may keep silent.

    Two or three labellers look at each fault (signs, capitals, shouting,
    tables, repeats) from different sides, so their votes overlap.
    """
    n = len(words)
    if not n:
        return (NONE,) * 10
    low, up = bytes_of(data, LOWER), bytes_of(data, UPPER)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    bare = [w.rstrip(CLOSING) for w in words]
    signed = sum(bool(w) and w[-1] < 128 and not w[-1:].isalnum() for w in bare)
    return (
        between(bytes_of(data, SIGNS) / n, 0.05, 0.3),
        between(signed / n, 0.05, 0.3),
        between(sum(not w.strip(b"|#*$%&<>-=+_~/\\") for w in words) / n, 0.05, 0.2),
        between(up / max(1, up + low), 0.3, 0.6) if n >= 5 else NONE,
        between(sum(len(w) > 1 and w.isupper() for w in bare) / n, 0.2, 0.5) if n >= 5 else NONE,
        between(data.count(b"!") / n, 0.1, 0.4),
        between(same, 0.1, 0.3) if n >= 10 else NONE,
        between(1 - len(set(words)) / n, 0.7, 0.85) if n >= 20 else NONE,
        between(1 - len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), 0.3, 0.6) if n >= 10 else NONE,
        between(len(data) / n, 12, 24) if n >= 10 else NONE,
    )


N_LABELLERS = len(votes(b"", []))


def code_of(found: tuple[int, ...]) -> int:
    return sum(v * 3**k for k, v in enumerate(found))


def vote_codes(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``(_key, _hash, code)``: of every row its key, a hash of its text and its votes as one number."""

    def make():
        return lambda texts: {"code": [code_of(votes(d := t.encode(), d.split())) for t in texts]}

    found = map_texts(identified(docs, text, key).select(F.struct("_key", "_hash").alias("_row"), "_body"), make, "code bigint", "_body", "_row")
    return found.select("_row.*", "code")


def identified(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``(_key, _hash, _body)``: rows that agree in the first two are taken as the same document."""
    return docs.select(docs[key].alias("_key"), F.xxhash64(docs[text]).alias("_hash"), docs[text].alias("_body"))


@dataclass
class LabelModel:
    """``share[c, k, v]``: how often labeller k, where it votes, votes v on texts of class c; ``prior``: share of good texts."""

    prior: float
    share: np.ndarray
    posterior: dict[int, float]

    @property
    def accuracies(self) -> list[float]:
        """Of each labeller: how often its votes are right, where it votes."""
        w = np.array([1 - self.prior, self.prior])
        right = w[0] * self.share[0, :, BAD] + w[1] * self.share[1, :, GOOD]
        wrong = w[0] * self.share[0, :, GOOD] + w[1] * self.share[1, :, BAD]
        return (right / np.maximum(right + wrong, 1e-12)).tolist()


def label_model(patterns: dict[int, int], rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns (at most 3 to the number of labellers).

    Labellers are taken as independent given the class, and silence as no
    evidence.  The first guess
    doubts every text that some labeller calls bad; each round estimates how
    the labellers vote in each class, and then each pattern's class.
    """
    codes = np.array(sorted(patterns), np.int64)
    counts = np.array([patterns[c] for c in codes.tolist()], float)
    digits = (codes[:, None] // 3 ** np.arange(N_LABELLERS)) % 3
    one_hot = (digits[:, :, None] == np.arange(2)).astype(float)  # silence says nothing
    good = np.where((digits == BAD).any(axis=1), 0.1, 0.9)
    prior, share = 0.5, np.full((2, N_LABELLERS, 3), 1 / 3)
    for _ in range(rounds if len(codes) else 0):
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        share = np.einsum("cp,pkv->ckv", weight, one_hot) + 0.1
        share /= share.sum(axis=2, keepdims=True)
        bits = np.einsum("ckv,pkv->cp", np.log(share), one_hot) + np.log([[1 - prior], [prior]])
        good = 1 / (1 + np.exp(np.clip(bits[0] - bits[1], -50, 50)))
    return LabelModel(prior, share, dict(zip(codes.tolist(), good.tolist(), strict=True)))


SHAPE = bytes(97 if b >= 128 or chr(b).islower() else 65 if chr(b).isupper() else 48 if chr(b).isdigit() else b for b in range(256))
RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def bucket(feature: bytes) -> int:
    return xxhash.xxh3_64_intdigest(feature) % DIMS


#: The feature of a word that equals the one before.
SAME = bucket(b"=")


def word_features(word: bytes) -> tuple[int, int]:
    """Buckets of a word's shape (kinds of characters, runs as one) and of its last four characters' kinds.

    The kinds, not the words: what stands for good or bad texts must not hang
    on which words they happen to hold.
    """
    kinds = word.translate(SHAPE)
    return bucket(b"s" + RUNS.sub(rb"\1", kinds)), bucket(b"e" + kinds[-4:])


def repeats(words: list[bytes]) -> int:
    return sum(a == b for a, b in zip(words, words[1:], strict=False))


def features(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``features``: hashed features of each row's text, per word."""
    source = docs.select(*keep, docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_features)
        for batch in slices(batches):
            rows = []
            for t in texts(batch, "_text"):
                words = t.encode().split()
                found = [b for w in words for b in memo[w]] + [SAME] * repeats(words)
                rows.append(np.bincount(np.array(found, np.int64), minlength=DIMS) / max(1, len(words)))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(pa.float64()))], [*keep, "features"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, features array<double>")


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def fit_quality(docs: DataFrame, fit_docs: int = FIT_DOCS, text: str = "text", key: str = "doc_id") -> QualityModel:
    """Estimate the labellers over all rows, then fit the scorer to posterior labels of ``fit_docs`` rows.

    Rows are drawn by the hash of their key, those of one key by the hash of
    their text; rows that agree in both are scored once, with their number as
    weight.  What reaches the driver: one row a vote pattern, and the scorer's
    weights.
    """
    spark = docs.sparkSession
    codes = cut_lineage(vote_codes(docs, text, key))
    model = label_model({r["code"]: r["count"] for r in codes.groupBy("code").count().collect()})
    if not model.posterior:
        return QualityModel(model, np.zeros(DIMS), 0.0)
    posterior = spark.createDataFrame(sorted(model.posterior.items()), "code bigint, good double")
    drawn = codes.orderBy(F.xxhash64("_key"), "_key", "_hash", "code").limit(fit_docs)
    # at most fit_docs rows
    drawn = drawn.groupBy(F.col("_key").alias("_k"), F.col("_hash").alias("_h")).agg(F.count("*").alias("n"), F.min("code").alias("code"))
    drawn = cut_lineage(drawn.join(F.broadcast(posterior), "code").select("_k", "_h", "n", "good"))
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))
    picked = identified(docs, text, key).join(F.broadcast(drawn), same)
    picked = picked.groupBy("_key", "_hash").agg(*[F.first(c).alias(c) for c in ("n", "good", "_body")])
    table = features(picked, "_body", ["_key", "_hash", "n", "good"])
    good = F.least(F.greatest("good", F.lit(0.001)), F.lit(0.999))
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), good.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - good).alias("w")))).alias("side")
    rows = table.select("_key", "_hash", "n", sides, array_to_vector("features").alias("features"))
    rows = rows.select("_key", "_hash", "side.label", (F.col("side.w") * F.col("n")).alias("w"), "features")
    # one sorted part of bounded size: sums come out the same each time
    rows = cut_lineage(rows.repartition(1).sortWithinPartitions("_key", "_hash", "label"))
    fitted = LogisticRegression(weightCol="w", regParam=1e-3, maxIter=60).fit(rows)
    return QualityModel(model, fitted.coefficients.toArray(), float(fitted.intercept))


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.bias, self.same = bias, float(weights[SAME])
        self.memo = Memo(lambda word: float(sum(weights[b] for b in word_features(word))))

    def score(self, words: list[bytes]) -> float:
        """The scorer's log odds that a text is good."""
        if not words:
            return 0.0
        return self.bias + (sum(map(self.memo.__getitem__, words)) + self.same * repeats(words)) / len(words)


def quality(docs: DataFrame, model: QualityModel | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_bad, n_good, posterior, score, kept)`` of every row.

    ``n_bad`` and ``n_good`` are votes, ``posterior`` is the label model's
    chance that the text is good, ``score`` the linear scorer's log odds;
    texts with a score of ``LEAST_SCORE`` or more are kept.

    Null and empty texts get no vote and the score 0: nothing speaks against
    them.  Null keys stay null; repeated rows count and are judged each; other
    columns are not returned; an empty table has no rows and fits nothing.
    """
    model = model or fit_quality(docs, text=text, key=key)
    shared = docs.sparkSession.sparkContext.broadcast((model.labels.posterior, model.weights, model.bias))

    def make():
        posterior, weights, bias = shared.value
        scorer = Scorer(weights, bias)

        def work(texts: list[str]) -> dict:
            data = [t.encode() for t in texts]
            words = [d.split() for d in data]
            found = [votes(d, w) for d, w in zip(data, words, strict=True)]
            scores = [round(scorer.score(w), 6) for w in words]
            return {
                "n_bad": [v.count(BAD) for v in found],
                "n_good": [v.count(GOOD) for v in found],
                "posterior": [round(posterior.get(code_of(v), 0.5), 6) for v in found],
                "score": scores,
                "kept": [s >= LEAST_SCORE for s in scores],
            }

        return work

    return map_texts(docs, make, "n_bad bigint, n_good bigint, posterior double, score double, kept boolean", text, key)


def drop_low_quality(docs: DataFrame, model: QualityModel | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns."""
    model = model or fit_quality(docs, text=text, key=key)
    shared, at = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias)), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in slices(batches):
            kept = [round(scorer.score((t or "").encode().split()), 6) >= LEAST_SCORE for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
